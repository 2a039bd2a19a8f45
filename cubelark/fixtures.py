"""Cubes over the driver's tables: daily events on an 8 x 8 grid, monthly line items on a 10 x 10 grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import blocks as q
from .plans.mapping import Ontology
from .plans.processor import QueryProcessor, Response
from .plans.recipe import QueryRecipe
from .sources.base import Extent
from .sources.table import TableCube

KINDS = ("click", "error", "purchase", "signup", "view")


def _within(frame: DataFrame, column: str, extent: Extent | None, unit: str) -> DataFrame:
    """The rows that an extent in whole units of time can need, by a predicate on the stored column that reaches the scan."""
    if extent is None or extent.time is None:
        return frame
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (extent.time.start, extent.time.end))
    return frame.where((F.col(column) >= start) & (F.col(column) < end + F.expr(f"INTERVAL 1 {unit}")))


def events_cube(spark: SparkSession, sf_dir: str, extent: Extent | None = None) -> DataFrame:
    """time (day), y, x, kind (modal event type, the smallest of equally frequent ones), value, peak, n."""
    events = _within(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", extent, "DAY")
    code = F.lit(None).cast("int")
    for i, kind in enumerate(KINDS, 1):
        code = F.when(F.col("event_type") == kind, i).otherwise(code)
    cell = events.select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"),
        (F.floor(F.col("user_id") / 8) % 8).cast("int").alias("y"),
        (F.col("user_id") % 8).cast("int").alias("x"),
        code.alias("code"),
        "value",
    )
    return cell.groupBy("time", "y", "x").agg(F.mode("code", True).alias("kind"), F.avg("value").alias("value"), F.max("value").alias("peak"), F.count("*").alias("n"))


def items_cube(spark: SparkSession, sf_dir: str, extent: Extent | None = None) -> DataFrame:
    """time (month), y, x, qty, price, discount, tax, flag (modal return flag: 1 A, 2 N, 3 R)."""
    items = _within(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", extent, "MONTH")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_returnflag") == "R", 3)
    cell = items.select(
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"),
        (F.col("l_partkey") % 10).cast("int").alias("y"),
        (F.col("l_suppkey") % 10).cast("int").alias("x"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", flag.alias("flag"),
    )
    return cell.groupBy("time", "y", "x").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.mode("flag", True).alias("flag"))


def quadrants(spark: SparkSession, size: int = 8) -> DataFrame:
    """(y, x, feature) with the four quadrants as features 1 to 4."""
    half = size // 2
    cells = spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    return cells.withColumn("feature", (1 + 2 * (F.col("y") >= half).cast("int") + (F.col("x") >= half).cast("int")).cast("int"))


QUADRANT_NAMES = {1: "north-west", 2: "north-east", 3: "south-west", 4: "south-east"}

LAYOUT = {
    "appearance": {"kind": {"type": "ordinal", "table": "events", "values": [{"id": i, "label": k} for i, k in enumerate(KINDS, 1)]}},
    "reflectance": {"value": {"type": "continuous", "table": "events"}, "peak": {"type": "continuous", "table": "events"}},
    "artifacts": {"n": {"type": "discrete", "table": "events"}},
    "items": {
        "qty": {"type": "continuous", "table": "items"},
        "price": {"type": "continuous", "table": "items"},
        "discount": {"type": "continuous", "table": "items"},
        "tax": {"type": "continuous", "table": "items"},
        "flag": {"type": "nominal", "table": "items", "values": [{"id": 1, "label": "A"}, {"id": 2, "label": "N"}, {"id": 3, "label": "R"}]},
    },
}


def ontology() -> Ontology:
    kind, value = q.appearance("kind"), q.reflectance("value")
    return Ontology({
        "entity": {
            "error": {"kind": kind.evaluate("in", [q.label("error")])},
            "activity": {"kind": kind.evaluate("in", [1, 5])},
            "conversion": {"kind": kind.evaluate("in", q.interval(3, 4))},
            "hot": {"kind": kind.evaluate("equal", 2), "value": value.evaluate("greater", 100)},
            "above_own_mean": {"value": value.evaluate("greater", value.reduce("mean", "time"))},
        },
    })


def source(spark: SparkSession, sf_dir: str) -> TableCube:
    return TableCube(LAYOUT, {"events": lambda s, e: events_cube(s, sf_dir, e), "items": lambda s, e: items_cube(s, sf_dir, e)})


def run(spark: SparkSession, sf_dir: str, recipe: dict, features: bool = False, **config) -> Response:
    """Executes a recipe over both cubes, on request with the quadrants as features."""
    extent = Extent(spark, space=quadrants(spark) if features else None, feature_labels=QUADRANT_NAMES if features else None)
    return QueryProcessor.parse(QueryRecipe(recipe), source(spark, sf_dir), ontology(), spark=spark, extent=extent, **config).optimize().execute()
