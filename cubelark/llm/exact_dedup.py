"""Exact deduplication by content sort, in DataFrame operations only.

The texts are range-partitioned by sampled splitters.  The routing key is short
(leading code points and a hash), so the sample that Spark gathers is bounded
whatever the texts' length; ordering and equality are decided on whole texts.
Inside a range partition Spark's external sort puts equal texts next to each
other and the window operator compares neighbours in full.

A text that very many rows carry would fill one range.  Rows of such hot hashes
(more than HOT_ROWS rows, and a share of all rows) are salted by identifier, so
each salt is sorted on its own; what all salts of a hot text come to is aggregated
map-side by the whole text (there are about HOT_KEYS such texts at most, whatever
the input) and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A hash is hot with more rows than this, if these are one in HOT_KEYS of all rows; so there are at most HOT_KEYS of them.
HOT_ROWS = 1_000
HOT_KEYS = 2048
#: Parts that a hot group is dealt into.
SALTS = 64
#: Code points of the text in the routing key.
ROUTE_CHARS = 8


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest (`keep="max"`) or smallest
    (`"min"`) identifier stays.  A null text counts as empty; a null identifier
    loses against any other.  If a kept identifier occurs on several rows with
    the same text, one of these rows is kept.  An empty table gives no rows.
    """
    return _judged(df, id_col, text_col, keep, carry=[]).drop("row")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """`df` without the rows that `exact_dedup` drops; columns as they came.

    The rows travel with the sort, so nothing is joined back by identifier.
    """
    judged = _judged(df, id_col, text_col, keep, carry=df.columns)
    return judged.where("kept").select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])


def _judged(df: DataFrame, id_col: str, text_col: str, keep: str, carry: list[str]) -> DataFrame:
    best = {"max": F.max, "min": F.min}[keep]
    order = F.desc_nulls_last("doc_id") if keep == "max" else F.asc_nulls_last("doc_id")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    #: of the carried row, the text itself only where it is not `text` already (null)
    rest = [F.when(F.lit(c != text_col), F.col(c)).alias(f"c{i}") for i, c in enumerate(carry)]
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("h"),
        F.struct(F.isnull(text_col).alias("no_text"), *rest).alias("row"),
    )
    counts = docs.groupBy("h").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*")).scalar()
    hot = counts.where((F.col("n") > HOT_ROWS) & (F.col("n") * HOT_KEYS > total)).select(F.col("h").alias("hot_h"))
    routed = (
        docs.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
        .withColumn("hot", F.col("hot_h").isNotNull())
        .withColumn("salt", F.when(F.col("hot"), _salt()).otherwise(F.lit(0)))
        .withColumn("route", F.substring("text", 1, ROUTE_CHARS))
        .select("doc_id", "text", "h", "hot", "salt", "route", "row")
        .repartitionByRange("route", "h", "salt")
    )
    same = Window.partitionBy("route", "h", "salt", "text")
    local = (
        routed.withColumn("local_rank", F.row_number().over(same.orderBy(order)))
        .withColumn("local_keep", F.first("doc_id").over(same.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("local_size", F.count("*").over(same))
        .where(F.lit(not carry) | (F.col("local_rank") == 1))
        .select("doc_id", "hot", "salt", "local_rank", "local_keep", "local_size", F.sha2("text", 256).alias("text_sha256"), F.when(F.lit(bool(carry)), F.col("text")).alias("text"), "row")
    )
    # what all salts of a hot text come to: map-side aggregation leaves one row for each of these texts and task
    salted = docs.join(F.broadcast(hot), F.col("h") == F.col("hot_h")).select("text", "doc_id", _salt().alias("salt"))
    across = salted.groupBy("text").agg(best("doc_id").alias("all_keep"), F.count("*").alias("all_size"), F.min("salt").alias("first_salt"))
    across = across.select(F.sha2("text", 256).alias("sha"), "all_keep", "all_size", "first_salt")  # about HOT_KEYS rows of fixed length at most
    joined = local.join(F.broadcast(across), F.col("hot") & (F.col("text_sha256") == F.col("sha")), "left")
    wins = F.when(F.col("hot"), F.when(F.col("all_keep").isNull(), F.col("salt") == F.col("first_salt")).otherwise(F.col("doc_id").eqNullSafe(F.col("all_keep")))).otherwise(F.lit(True))
    whole = [F.when(~F.col("row.no_text"), F.col("text")).alias(f"c{i}") if c == text_col else F.col("row")[f"c{i}"].alias(f"c{i}") for i, c in enumerate(carry)]
    return joined.select(
        "doc_id",
        F.when(F.col("hot"), F.col("all_keep")).otherwise(F.col("local_keep")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("local_size")).cast("long").alias("group_size"),
        ((F.col("local_rank") == 1) & wins).alias("kept"),
        "text_sha256",
        F.struct(F.lit(1).alias("one"), *whole).alias("row"),
    )


def _salt():
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
