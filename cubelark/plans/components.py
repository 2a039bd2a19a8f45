"""Connected components of a large graph, by alternating large and small stars.

Every step is an aggregation and a join on node keys, so nothing is collected;
each round is written to the shared folder, which cuts the lineage and lets a
round survive lost executors.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that `join_counted` broadcasts at most.
HOT_KEYS = 4096
#: Rounds after which something must be wrong; each at least halves the longest path.
MOST_ROUNDS = 60


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, or the folder that the context was given; raises where neither is set, but in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cubelark-shared")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read back; removed when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cubelark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of `rows` to a table of one row per key, whose column `count` is at least the number of rows that have the key.

    The rows of a frequent key never meet in one task: keys that more than one in HOT_KEYS of the
    `total` rows have are HOT_KEYS at most and are broadcast, the others are joined by a shuffle.
    """
    least = total // HOT_KEYS
    hot = F.broadcast(keyed.where(F.col(count) > least))
    rest = rows.join(F.broadcast(keyed.where(F.col(count) > least).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(keyed.where(F.col(count) <= least), key))


#: Tables that `written` made and `discard` may remove, by identity of their frame.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` made and nothing lazy needs any more."""
    for table in tables:
        _, path = _PATHS.pop(id(table))
        _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may already be gone when Python ends
        pass


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) of all nodes that have an edge to another; a component is named by its smallest node."""
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    e = written(e, "edges")
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        last, e = e, written(_small_star(_large_star(e, state[0])), "edges")
        before, state = state, _state(e)
        discard(last)
        if state == before:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Every node's larger neighbours move to the smallest of its neighbours and itself.

    A hub has very many neighbours, so the join is by counted keys.
    """
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return join_counted(both, least, "u", "n", 2 * edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least.withColumnRenamed("u", "of"), F.col("u") == F.col("of")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
