"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .model import CubeArray
from .operators import verbs
from .plans import blocks as q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The events cube in SQL; every query's SQL begins with it.
EVENTS = """
WITH ev AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, CAST((user_id // 8) % 8 AS INT) AS y, CAST(user_id % 8 AS INT) AS x,
         CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS code, value
  FROM events),
kinds AS (SELECT time, y, x, code, count(*) AS c FROM ev GROUP BY ALL),
modal AS (SELECT time, y, x, arg_min(code, code - 1000 * c) AS kind FROM kinds GROUP BY ALL),
cube AS (
  SELECT ev.time, ev.y, ev.x, any_value(modal.kind) AS kind, avg(value) AS value, max(value) AS peak, CAST(count(*) AS DOUBLE) AS n
  FROM ev JOIN modal USING (time, y, x) GROUP BY ev.time, ev.y, ev.x),
grid AS (SELECT * FROM (SELECT DISTINCT time FROM cube), (SELECT DISTINCT y FROM cube), (SELECT DISTINCT x FROM cube)),
tpos AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS p FROM (SELECT DISTINCT time FROM cube))
"""
#: The items cube in SQL.
ITEMS = """
WITH it AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, CAST(l_partkey % 10 AS INT) AS y, CAST(l_suppkey % 10 AS INT) AS x,
         l_quantity, l_extendedprice, l_discount, l_tax, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS code
  FROM lineitem),
flags AS (SELECT time, y, x, code, count(*) AS c FROM it GROUP BY ALL),
modal AS (SELECT time, y, x, arg_min(code, code - 100000 * c) AS flag FROM flags GROUP BY ALL),
cube AS (
  SELECT it.time, it.y, it.x, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax, any_value(modal.flag) AS flag
  FROM it JOIN modal USING (time, y, x) GROUP BY it.time, it.y, it.x)
"""
FEATURE = "(1 + 2 * CAST(y >= 4 AS INT) + CAST(x >= 4 AS INT))"


def register(sql: str | None, cube: str = EVENTS) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = cube + sql
        return query

    return add


def rounded(value: Column) -> Column:
    """Sums in another order may differ in the last digits."""
    return F.round(value.cast("double"), 6)


def out(x: CubeArray, dense: bool = False) -> DataFrame:
    frame = x.to_dataframe(dense)
    return frame.withColumn("v", rounded(F.col("v")))


def side_by_side(**arrays: CubeArray) -> DataFrame:
    """Arrays on one frame as columns."""
    first = next(iter(arrays.values()))
    assert len({a.token for a in arrays.values()}) == 1, "the arrays don't share a frame"
    return first.base.select(*first.dims, *[rounded(a.expr).alias(k) for k, a in arrays.items()])


def one(spark: SparkSession, sf_dir: str, block: dict, features: bool = False, **config) -> CubeArray:
    return fixtures.run(spark, sf_dir, {"r": block}, features, **config)["r"]


def many(spark: SparkSession, sf_dir: str, features: bool = False, **recipe: dict) -> dict[str, CubeArray]:
    return fixtures.run(spark, sf_dir, recipe, features)


KIND, LEVEL, PEAK, N = q.appearance("kind"), q.reflectance("value"), q.reflectance("peak"), q.artifacts("n")
#: Where the peak is near its maximum.
HIGHEST = PEAK.evaluate("greater", PEAK.reduce("max", "time").reduce("max", "space").evaluate("multiply", 0.97))
ERROR, ACTIVITY = q.entity("error"), q.entity("activity")

# ---- concepts and references


@register("SELECT y, x, CAST(count(*) FILTER (kind = 2) AS DOUBLE) AS v FROM cube GROUP BY y, x")
def concept_count_map(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.reduce("count", "time")))


@register("SELECT time, CAST(count(*) FILTER (kind IN (1, 5)) AS DOUBLE) AS v FROM cube GROUP BY time")
def concept_count_series(spark, sf_dir):
    return out(one(spark, sf_dir, ACTIVITY.reduce("count", "space")))


@register("SELECT CAST(count(*) FILTER (kind BETWEEN 3 AND 4) AS DOUBLE) AS v FROM cube")
def concept_count_stat(spark, sf_dir):
    return out(one(spark, sf_dir, q.entity("conversion").reduce("count")))


@register("SELECT time, y, x, CAST(kind = 2 AND value > 100 AS DOUBLE) AS v FROM cube")
def two_property_concept(spark, sf_dir):
    return out(one(spark, sf_dir, q.entity("hot")))


@register("SELECT time, y, x, CAST(value > 100 AS DOUBLE) AS v FROM cube")
def single_property_of_concept(spark, sf_dir):
    return out(one(spark, sf_dir, q.entity("hot", property="value")))


@register("SELECT time, y, x, CAST(value > avg(value) OVER (PARTITION BY y, x) AS DOUBLE) AS v FROM cube")
def self_in_rule(spark, sf_dir):
    return out(one(spark, sf_dir, q.entity("above_own_mean")))


@register("SELECT y, x, round(100.0 * (count(*) FILTER (kind = 2)) / (count(*) FILTER (kind IN (1, 5))), 6) AS v FROM cube GROUP BY y, x HAVING count(*) FILTER (kind IN (1, 5)) > 0 UNION ALL SELECT y, x, NULL FROM cube GROUP BY y, x HAVING count(*) FILTER (kind IN (1, 5)) = 0")
def result_reference(spark, sf_dir):
    r = many(spark, sf_dir, errors=ERROR.reduce("count", "time"), share=q.result("errors").evaluate("divide", ACTIVITY.reduce("count", "time")).evaluate("multiply", 100))
    return out(r["share"])


# ---- operators


@register("""SELECT time, y, x, round(abs(value - 100), 6) AS absolute, ceil(value) AS ceiling, floor(value) AS floor, round(cbrt(value - 100), 6) AS cube_root, round(exp(value / 100), 6) AS exponential,
  round(CASE WHEN value > 50 THEN ln(value - 50) END, 6) AS natural_logarithm, round(CASE WHEN value >= 50 THEN sqrt(value - 50) END, 6) AS square_root, CAST(NOT (value > 50) AS DOUBLE) AS negation FROM cube""")
def op_uni_math(spark, sf_dir):
    return side_by_side(**many(
        spark, sf_dir,
        absolute=LEVEL.evaluate("subtract", 100).evaluate("absolute"), ceiling=LEVEL.evaluate("ceiling"), floor=LEVEL.evaluate("floor"),
        cube_root=LEVEL.evaluate("subtract", 100).evaluate("cube_root"), exponential=LEVEL.evaluate("divide", 100).evaluate("exponential"),
        natural_logarithm=LEVEL.evaluate("subtract", 50).evaluate("natural_logarithm"), square_root=LEVEL.evaluate("subtract", 50).evaluate("square_root"),
        negation=LEVEL.evaluate("greater", 50).evaluate("not"),
    ))


@register("""SELECT time, y, x, round(sin(n), 6) AS sine, round(cos(n), 6) AS cosine, round(tan(n), 6) AS tangent, round(CASE WHEN sin(n - 1) <> 0 THEN 1 / sin(n - 1) END, 6) AS cosecant,
  round(CASE WHEN cos(n) <> 0 THEN 1 / cos(n) END, 6) AS secant, round(CASE WHEN tan(n - 1) <> 0 THEN 1 / tan(n - 1) END, 6) AS cotangent, round(degrees(n), 6) AS to_degrees, round(radians(n), 6) AS to_radians FROM cube""")
def op_uni_trig(spark, sf_dir):
    less = N.evaluate("subtract", 1)
    return side_by_side(**many(
        spark, sf_dir,
        sine=N.evaluate("sine"), cosine=N.evaluate("cosine"), tangent=N.evaluate("tangent"), cosecant=less.evaluate("cosecant"), secant=N.evaluate("secant"),
        cotangent=less.evaluate("cotangent"), to_degrees=N.evaluate("to_degrees"), to_radians=N.evaluate("to_radians"),
    ))


@register("SELECT time, y, x, CAST(value IS NULL OR value <= 100 AS DOUBLE) AS v FROM grid LEFT JOIN cube USING (time, y, x)")
def op_is_missing(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.filter(LEVEL.evaluate("greater", 100)).evaluate("is_missing")))


@register("SELECT time, y, x, CAST(value IS NOT NULL AS DOUBLE) AS v FROM grid LEFT JOIN cube USING (time, y, x)")
def op_not_missing(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.evaluate("not_missing")))


@register("""SELECT time, y, x, round(value + peak, 6) AS "add", round(peak - value, 6) AS subtract, round(value * n, 6) AS multiply, round(value / nullif(n - 1, 0), 6) AS divide, round(pow(n, 3), 6) AS power FROM cube""")
def op_algebra(spark, sf_dir):
    return side_by_side(**many(
        spark, sf_dir, add=LEVEL.evaluate("add", PEAK), subtract=PEAK.evaluate("subtract", LEVEL), multiply=LEVEL.evaluate("multiply", N),
        divide=LEVEL.evaluate("divide", N.evaluate("subtract", 1)), power=N.evaluate("power", 3),
    ))


@register("SELECT time, y, x, round((peak - value) / nullif(peak + value, 0), 6) AS v FROM cube")
def op_normalized_difference(spark, sf_dir):
    return out(one(spark, sf_dir, PEAK.evaluate("normalized_difference", LEVEL)))


@register("""SELECT time, y, x, CASE WHEN a IS NOT NULL THEN CAST(a AND coalesce(b, false) AS DOUBLE) END AS "and", CASE WHEN a IS NOT NULL THEN CAST(a OR coalesce(b, false) AS DOUBLE) END AS "or",
  CASE WHEN a IS NOT NULL THEN CAST(a <> coalesce(b, false) AS DOUBLE) END AS exclusive_or
FROM (SELECT *, CASE WHEN n > 1 THEN kind = 2 END AS a, CASE WHEN peak > 200 THEN value > 100 END AS b FROM cube)""")
def op_bool_missing(spark, sf_dir):
    a = ERROR.filter(N.evaluate("greater", 1))
    b = LEVEL.evaluate("greater", 100).filter(PEAK.evaluate("greater", 200))
    return side_by_side(**many(spark, sf_dir, **{k: a.evaluate(k, b) for k in ("and", "or", "exclusive_or")}))


@register("""SELECT time, y, x, CAST(coalesce(value = b, false) AS DOUBLE) AS equal, CAST(coalesce(value <> b, true) AS DOUBLE) AS not_equal, CAST(coalesce(value > b, false) AS DOUBLE) AS greater,
  CAST(coalesce(value >= b, false) AS DOUBLE) AS greater_equal, CAST(coalesce(value < b, false) AS DOUBLE) AS less, CAST(coalesce(value <= b, false) AS DOUBLE) AS less_equal
FROM (SELECT *, CASE WHEN n < 3 THEN peak END AS b FROM cube)""")
def op_compare_missing(spark, sf_dir):
    b = PEAK.filter(N.evaluate("less", 3))
    return side_by_side(**many(spark, sf_dir, **{k: LEVEL.evaluate(k, b) for k in ("equal", "not_equal", "greater", "greater_equal", "less", "less_equal")}))


@register("""SELECT time, y, x, CAST(kind IN (1, 3, 5) AS DOUBLE) AS in_set, CAST(kind NOT IN (1, 3, 5) AS DOUBLE) AS not_in_set, CAST(value BETWEEN 100 AND 200 AS DOUBLE) AS in_interval,
  CAST(value NOT BETWEEN 100 AND 200 AS DOUBLE) AS not_in_interval FROM cube""")
def op_membership(spark, sf_dir):
    return side_by_side(**many(
        spark, sf_dir, in_set=KIND.evaluate("in", [1, 3, 5]), not_in_set=KIND.evaluate("not_in", [q.label("click"), q.label("purchase"), q.label("view")]),
        in_interval=LEVEL.evaluate("in", q.interval(100, 200)), not_in_interval=LEVEL.evaluate("not_in", q.interval(100, 200)),
    ))


@register("SELECT time, y, x, CAST(n IN (SELECT max(n) FROM cube GROUP BY time) AS DOUBLE) AS v FROM cube")
def op_membership_array(spark, sf_dir):
    return out(one(spark, sf_dir, N.evaluate("in", N.reduce("max", "space"))))


@register("""SELECT time, CAST(time > TIMESTAMP '2024-01-20' AS DOUBLE) AS after, CAST(time < TIMESTAMP '2024-01-10' AS DOUBLE) AS before,
  CAST(time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AS DOUBLE) AS during FROM (SELECT DISTINCT time FROM cube)""")
def op_temporal(spark, sf_dir):
    times = LEVEL.extract("time")
    interval = q.time_interval("2024-01-10", "2024-01-20")
    r = many(spark, sf_dir, after=times.evaluate("after", q.time_instant("2024-01-20")), before=times.evaluate("before", interval), during=times.evaluate("during", interval))
    first = r["after"]
    return first.base.select("time", *[rounded(a.expr).alias(k) for k, a in r.items()])


@register("SELECT time, coalesce(CAST(time > (SELECT max(time) FROM cube WHERE peak > 480) AS DOUBLE), 0) AS v FROM (SELECT DISTINCT time FROM cube)")
def op_after_array(spark, sf_dir):
    late = LEVEL.assign_time().filter(PEAK.evaluate("greater", 480))
    return out(one(spark, sf_dir, LEVEL.extract("time").evaluate("after", late)))


SQUARE = {"type": "Polygon", "coordinates": [[[1.5, 2.5], [5.5, 2.5], [5.5, 6.5], [1.5, 6.5], [1.5, 2.5]]]}


@register("SELECT DISTINCT y, x, CAST(x BETWEEN 1.5 AND 5.5 AND y BETWEEN 2.5 AND 6.5 AS DOUBLE) AS v FROM grid")
def op_intersects(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.extract("space").evaluate("intersects", q.geometry(SQUARE))))


@register("""SELECT DISTINCT y, x, CAST(x BETWEEN (SELECT min(x) FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube)) AND (SELECT max(x) FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube))
  AND y BETWEEN (SELECT min(y) FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube)) AND (SELECT max(y) FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube)) AS DOUBLE) AS v FROM grid""")
def op_intersects_array(spark, sf_dir):
    r = many(spark, sf_dir, high=LEVEL.filter(HIGHEST).assign_space(), r=LEVEL.extract("space").evaluate("intersects", q.result("high")))
    return out(r["r"])


@register("""SELECT time, CAST(year(time) AS DOUBLE) AS year, CAST(quarter(time) AS DOUBLE) AS quarter, CAST(month(time) AS DOUBLE) AS month, CAST(weekofyear(time) AS DOUBLE) AS week, CAST(day(time) AS DOUBLE) AS day,
  CAST(isodow(time) - 1 AS DOUBLE) AS dayofweek, CAST(dayofyear(time) AS DOUBLE) AS dayofyear, CAST(hour(time) AS DOUBLE) AS hour, CAST(minute(time) AS DOUBLE) AS minute, CAST(second(time) AS DOUBLE) AS second,
  CAST(CASE WHEN (month(time) % 12) // 3 = 0 THEN 4 ELSE (month(time) % 12) // 3 END AS DOUBLE) AS season FROM (SELECT DISTINCT time FROM cube)""", ITEMS)
def time_components(spark, sf_dir):
    names = ("year", "quarter", "month", "week", "day", "dayofweek", "dayofyear", "hour", "minute", "second", "season")
    r = many(spark, sf_dir, **{c: q.layer("items", "qty").extract("time", c) for c in names})
    return r["year"].base.select("time", *[rounded(r[c].expr).alias(c) for c in names])


@register(f"SELECT DISTINCT y, x, CAST({FEATURE} AS DOUBLE) AS v FROM grid")
def space_feature(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.extract("space", "feature"), features=True))


# ---- filter and assign


@register("SELECT time, y, x, round(CASE WHEN kind = 2 THEN value END, 6) AS v FROM cube")
def filter_basic(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.filter(ERROR)))


@register("SELECT time, y, x, CASE WHEN kind = 2 THEN 1.0 END AS v FROM cube")
def filter_self(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.filter(q.self_())))


@register("SELECT time, y, x, round(CASE WHEN sum(n) OVER (PARTITION BY time) > (SELECT sum(n) / count(DISTINCT time) FROM cube) THEN value END, 6) AS v FROM cube")
def filter_align_time(spark, sf_dir):
    daily = N.reduce("sum", "space")
    busy = daily.evaluate("greater", daily.reduce("mean"))
    return out(one(spark, sf_dir, LEVEL.filter(busy)))


@register("SELECT time, y, x, round(CASE WHEN isodow(time) - 1 >= 5 THEN value END, 6) AS v FROM cube")
def filter_time_sugar(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.filter_time("dayofweek", "greater_equal", 5)))


@register(f"SELECT time, y, x, round(CASE WHEN {FEATURE} = 3 THEN value END, 6) AS v FROM cube")
def filter_space_sugar(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.filter_space("feature", "equal", q.label("south-west")), features=True))


@register("SELECT time, y, x, 7.0 AS v FROM cube")
def assign_const(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.assign(7)))


@register("SELECT time, y, x, round(CASE WHEN kind = 2 THEN -1 ELSE value END, 6) AS v FROM grid LEFT JOIN cube USING (time, y, x)")
def assign_at(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.assign(-1.0, at=ERROR)))


@register("SELECT time, y, x, round(coalesce(value, 0), 6) AS v FROM grid LEFT JOIN cube USING (time, y, x)")
def assign_missing(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.assign(0.0, at=LEVEL.evaluate("is_missing"))))


@register("SELECT time, y, x, CAST(CASE WHEN kind = 2 THEN day(time) END AS DOUBLE) AS v FROM cube")
def assign_time(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.filter(q.self_()).assign_time("day")))


@register("SELECT time, y, x, CAST(CASE WHEN kind = 2 THEN x END AS DOUBLE) AS v FROM cube")
def assign_space(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.filter(q.self_()).assign_space("x")))


# ---- reducers

STATISTICS = ("mean", "median", "mode", "max", "min", "range", "n", "product", "standard_deviation", "sum", "variance")
LOGIC = ("all", "any", "none", "count", "percentage")


@register("""SELECT y, x, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(m), 6) AS mode, round(max(v), 6) AS max, round(min(v), 6) AS min, round(max(v) - min(v), 6) AS range, CAST(count(v) AS DOUBLE) AS n,
  round(ln(product(v)), 6) AS product, round(stddev_pop(v), 6) AS standard_deviation, round(sum(v), 6) AS sum, round(var_pop(v), 6) AS variance
FROM (SELECT y, x, CASE WHEN kind <> 4 THEN n END AS v FROM cube) LEFT JOIN (SELECT y, x, arg_min(v, v - 1000 * c) AS m FROM (SELECT y, x, n AS v, count(*) AS c FROM cube WHERE kind <> 4 GROUP BY y, x, n) GROUP BY y, x) USING (y, x)
GROUP BY y, x""")
def reduce_statistics(spark, sf_dir):
    x = one(spark, sf_dir, N.filter(KIND.evaluate("not_equal", 4)))
    frame = verbs.reduce_many(x, list(STATISTICS), "time")
    return frame.select("y", "x", *[rounded(F.ln(c) if c == "product" else F.col(c)).alias(c) for c in STATISTICS])


@register("""SELECT time, CAST(bool_and(v) AS DOUBLE) AS "all", CAST(bool_or(v) AS DOUBLE) AS "any", CAST(NOT bool_or(v) AS DOUBLE) AS "none", CAST(CASE WHEN count(v) > 0 THEN count(*) FILTER (v) END AS DOUBLE) AS count,
  round(100.0 * (count(*) FILTER (v)) / nullif(count(v), 0), 6) AS percentage FROM (SELECT time, CASE WHEN n > 2 THEN value > 100 END AS v FROM cube) GROUP BY time""")
def reduce_logic(spark, sf_dir):
    x = one(spark, sf_dir, LEVEL.evaluate("greater", 100).filter(N.evaluate("greater", 2)))
    frame = verbs.reduce_many(x, list(LOGIC), "space")
    return frame.select("time", *[rounded(F.col(c)).alias(c) for c in LOGIC])


@register("SELECT y, x, round(arg_min(value, time) FILTER (value > 100), 6) AS first, round(arg_max(value, time) FILTER (value > 100), 6) AS last FROM cube GROUP BY y, x")
def reduce_first_last(spark, sf_dir):
    x = one(spark, sf_dir, LEVEL.filter(LEVEL.evaluate("greater", 100)))
    return verbs.reduce_many(x, ["first", "last"], "time").select("y", "x", *[rounded(F.col(c)).alias(c) for c in ("first", "last")])


@register("SELECT time, x, round(median(price), 6) AS v FROM cube GROUP BY time, x", ITEMS)
def reduce_one_space_axis(spark, sf_dir):
    return out(one(spark, sf_dir, q.layer("items", "price").reduce("median", "y")))


@register("SELECT y, x, CAST(date_diff('second', min(time), max(time)) AS DOUBLE) * 1e9 AS v FROM cube WHERE kind = 2 GROUP BY y, x UNION ALL SELECT y, x, NULL FROM cube GROUP BY y, x HAVING count(*) FILTER (kind = 2) = 0")
def reduce_time_range(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.filter(q.self_()).assign_time().reduce("range", "time")))


# ---- windows


@register("SELECT b.time, y, x, round(value, 6) AS v FROM cube JOIN tpos a ON cube.time = a.time JOIN tpos b ON b.p = a.p + 2")
def shift_time_forward(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.shift("time", 2)))


@register("SELECT time, y, x, round(lead(value, 3) OVER (PARTITION BY y, x ORDER BY time), 6) AS v FROM grid LEFT JOIN cube USING (time, y, x)")
def shift_time_backward(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.shift("time", -3)), dense=True)


@register("SELECT time, y, x, round(lag(value, 1) OVER (PARTITION BY time ORDER BY y, x), 6) AS v FROM grid LEFT JOIN cube USING (time, y, x)")
def shift_space(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.shift("space", 1)), dense=True)


def _smooth_sql(aggregate: str, limit: int = 2) -> str:
    return f"""SELECT time, y, x, round(CASE WHEN value IS NOT NULL AND count(value) OVER w >= {limit} THEN {aggregate} OVER w END, 6) AS v
FROM (SELECT time, p, y, x, CASE WHEN n > 1 THEN value END AS value, n FROM cube JOIN tpos USING (time)) WINDOW w AS (PARTITION BY y, x ORDER BY p RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


GAPPY = LEVEL.filter(N.evaluate("greater", 1))


@register(_smooth_sql("avg(value)"))
def smooth_time_mean(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.smooth("mean", "time", 2)))


@register(_smooth_sql("median(value)"))
def smooth_time_median(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.smooth("median", "time", 2)))


@register(_smooth_sql("sum(value)", 5))
def smooth_time_limit(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.smooth("sum", "time", 2, limit=5)))


@register("""SELECT time, y, x, round(CASE WHEN count(value) OVER w >= 2 THEN max(value) OVER w - min(value) OVER w END, 6) AS v
FROM (SELECT time, y, x, CASE WHEN n > 1 THEN value END AS value FROM grid LEFT JOIN cube USING (time, y, x)) WINDOW w AS (PARTITION BY y, x ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def smooth_time_fill(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.smooth("range", "time", 1, fill=True)))


@register("SELECT a.time, a.y, a.x, round(CASE WHEN count(b.value) >= 2 THEN avg(b.value) END, 6) AS v FROM cube a JOIN cube b ON a.time = b.time AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.time, a.y, a.x")
def smooth_space_mean(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.smooth("mean", "space", 1)))


@register("SELECT a.time, a.y, a.x, round(CASE WHEN count(b.value) >= 2 THEN median(b.value) END, 6) AS v FROM cube a JOIN cube b ON a.time = b.time AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.time, a.y, a.x")
def smooth_space_median(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.smooth("median", "space", 1)))


@register("SELECT time, y, x, round(CASE WHEN peak > (SELECT 0.97 * max(peak) FROM cube) THEN value END, 6) AS v FROM cube WHERE time IN (SELECT time FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube))")
def trim_time(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.filter(HIGHEST).trim("time")))


@register("""SELECT time, y, x, round(CASE WHEN peak > (SELECT 0.97 * max(peak) FROM cube) THEN value END, 6) AS v FROM cube, (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube))
WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""")
def trim_space(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.filter(HIGHEST).trim("space")))


FILL_SQL = """SELECT g.time, g.y, g.x, round(CASE WHEN c.value IS NOT NULL THEN c.value WHEN b.time IS NULL AND a.time IS NULL THEN NULL {rule} END, 6) AS v
FROM grid g LEFT JOIN (SELECT * FROM cube WHERE n > 1) c ON g.time = c.time AND g.y = c.y AND g.x = c.x
LEFT JOIN LATERAL (SELECT time, value FROM cube k WHERE k.n > 1 AND k.y = g.y AND k.x = g.x AND k.time < g.time ORDER BY time DESC LIMIT 1) b ON true
LEFT JOIN LATERAL (SELECT time, value FROM cube k WHERE k.n > 1 AND k.y = g.y AND k.x = g.x AND k.time > g.time ORDER BY time LIMIT 1) a ON true"""


@register(FILL_SQL.format(rule="WHEN b.time IS NULL THEN a.value WHEN a.time IS NULL THEN b.value WHEN epoch(g.time) - epoch(b.time) <= epoch(a.time) - epoch(g.time) THEN b.value ELSE a.value"))
def fill_nearest(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.fill("time", "nearest")))


@register(FILL_SQL.format(rule="WHEN b.time IS NULL OR a.time IS NULL THEN NULL ELSE b.value + (a.value - b.value) * (epoch(g.time) - epoch(b.time)) / (epoch(a.time) - epoch(b.time))"))
def fill_linear(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.fill("time", "linear", extrapolate=False)))


@register(None)
def fill_cubic(spark, sf_dir):
    return out(one(spark, sf_dir, GAPPY.fill("time", "cubic", extrapolate=False)))


@register("""SELECT time, CAST(CASE WHEN busy THEN (SELECT count(*) FROM (SELECT p - row_number() OVER (ORDER BY p) AS r FROM d2 WHERE busy) GROUP BY () ) * 0 + dense_rank() OVER (PARTITION BY busy ORDER BY r) ELSE 0 END AS DOUBLE) AS v
FROM (SELECT *, p - row_number() OVER (PARTITION BY busy ORDER BY p) AS r FROM d2)""", EVENTS.rstrip() + """,
d1 AS (SELECT time, count(*) FILTER (kind = 2) AS c FROM cube GROUP BY time),
d2 AS (SELECT time, p, c > (SELECT avg(c) FROM d1) AS busy FROM d1 JOIN tpos USING (time))
""")  # fmt: skip
def delineate_time(spark, sf_dir):
    daily = ERROR.reduce("count", "space")
    return out(one(spark, sf_dir, daily.evaluate("greater", daily.reduce("mean")).delineate()))


CELLS = EVENTS.replace("WITH ev", "WITH RECURSIVE ev").rstrip() + """,
cells AS ({cells}),
reach(id, root) AS (SELECT id, id FROM cells UNION SELECT b.id, r.root FROM reach r JOIN cells a ON a.id = r.id JOIN cells b ON ({near}) WHERE b.id > 0),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
regions AS (SELECT id, dense_rank() OVER (ORDER BY root) AS region FROM roots)
"""


@register("SELECT m.y, m.x, CAST(coalesce(region, 0) AS DOUBLE) AS v FROM (SELECT y, x, 1 + y * 8 + x AS id FROM cube GROUP BY y, x) m LEFT JOIN regions USING (id)", CELLS.format(
    cells="SELECT y, x, 1 + y * 8 + x AS id FROM cube GROUP BY y, x HAVING count(*) FILTER (kind = 2) > 6", near="abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"))
def delineate_space(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.reduce("count", "time").evaluate("greater", 6).delineate()))


@register("SELECT c.time, c.y, c.x, CAST(coalesce(region, 0) AS DOUBLE) AS v FROM (SELECT *, 1 + p * 64 + y * 8 + x AS id FROM cube JOIN tpos USING (time)) c LEFT JOIN regions USING (id)", CELLS.format(
    cells="SELECT p, y, x, 1 + p * 64 + y * 8 + x AS id FROM cube JOIN tpos USING (time) WHERE peak > 450", near="(a.p = b.p AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) OR (abs(a.p - b.p) = 1 AND a.y = b.y AND a.x = b.x)"))
def delineate_spacetime(spark, sf_dir):
    return out(one(spark, sf_dir, PEAK.evaluate("greater", 450).delineate()))


# ---- collections


@register("SELECT year(time) AS year, round(avg(c), 6) AS v FROM (SELECT time, sum(CAST(flag = 3 AS INT)) AS c FROM cube GROUP BY time) GROUP BY year(time)", ITEMS)
def groupby_year_mean_of_counts(spark, sf_dir):
    returned = q.layer("items", "flag").evaluate("equal", q.label("R"))
    return out(one(spark, sf_dir, returned.groupby_time("year").reduce("count", "space").reduce("mean", "time").concatenate("year")))


@register("SELECT concat(CASE WHEN (month(time) % 12) // 3 = 0 THEN 'December, January, February' WHEN (month(time) % 12) // 3 = 1 THEN 'March, April, May' WHEN (month(time) % 12) // 3 = 2 THEN 'June, July, August' ELSE 'September, October, November' END) AS season, round(sum(qty), 6) AS v FROM cube GROUP BY 1", ITEMS)
def season_totals(spark, sf_dir):
    return out(one(spark, sf_dir, q.layer("items", "qty").groupby_time("season").reduce("sum").concatenate("season")))


@register("SELECT year(time) AS year, month(time) AS month, round(max(price), 6) AS v FROM cube GROUP BY ALL", ITEMS)
def groupby_year_month(spark, sf_dir):
    x = one(spark, sf_dir, q.layer("items", "price").groupby_time(["year", "month"]).reduce("max").concatenate("period"))
    return out(x).select(F.col("period.k0").alias("year"), F.date_format(F.to_date(F.col("period.k1"), "MMMM"), "M").cast("int").alias("month"), "v")


@register(f"SELECT CASE {FEATURE} WHEN 1 THEN 'north-west' WHEN 2 THEN 'north-east' WHEN 3 THEN 'south-west' ELSE 'south-east' END AS feature, time, round(avg(value), 6) AS v FROM cube GROUP BY ALL")
def per_feature_series(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.groupby_space("feature").reduce("mean", "space").concatenate("feature"), features=True))


@register("SELECT region AS object, round(avg(value), 6) AS v FROM (SELECT *, 1 + y * 8 + x AS id FROM cube) JOIN regions USING (id) GROUP BY region UNION ALL SELECT 0, round(avg(value), 6) FROM (SELECT *, 1 + y * 8 + x AS id FROM cube) WHERE id NOT IN (SELECT id FROM regions) HAVING count(*) > 0", CELLS.format(
    cells="SELECT y, x, 1 + y * 8 + x AS id FROM cube GROUP BY y, x HAVING count(*) FILTER (kind = 2) > 6", near="abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"))
def group_by_objects(spark, sf_dir):
    objects = ERROR.reduce("count", "time").evaluate("greater", 6).delineate()
    x = one(spark, sf_dir, LEVEL.groupby(objects).reduce("mean").concatenate("object"))
    return out(x).withColumn("object", F.col("object").cast("long"))


@register("SELECT time, y, x, round(value, 6) AS v FROM cube")
def groupby_concat_identity(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.groupby_time("dayofweek").concatenate("time")))


@register("SELECT time, y, x, round(CASE WHEN (value - lag(value) OVER w) IS NOT NULL THEN value - lag(value) OVER w END, 6) AS v FROM grid LEFT JOIN cube USING (time, y, x) WINDOW w AS (PARTITION BY y, x ORDER BY time)")
def shift_difference(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.evaluate("subtract", LEVEL.shift("time", 1))), dense=True)


@register("SELECT CASE b WHEN 1 THEN 'low' ELSE 'high' END AS band, time, y, x, round(CASE b WHEN 1 THEN value ELSE peak END, 6) AS v FROM cube, (SELECT unnest([1, 2]) AS b)")
def concat_new_dimension(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(LEVEL.name("low"), PEAK.name("high")).concatenate("band")))


@register("SELECT time, y, x, round(CASE WHEN n > 2 THEN value ELSE peak END, 6) AS v FROM cube")
def concat_existing_duplicates(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(LEVEL.filter(N.evaluate("greater", 2)), PEAK).concatenate("time")))


@register("SELECT time, y, x, CAST(CASE WHEN kind = 2 THEN 1 WHEN kind IN (1, 5) THEN 2 WHEN kind BETWEEN 3 AND 4 THEN 3 END AS DOUBLE) AS v FROM cube")
def compose_classes(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(ERROR.name("error"), ACTIVITY.name("activity"), q.entity("conversion").name("conversion")).compose()))


@register("""SELECT y, x, CAST(arg_min(v, v - 1000 * c) AS DOUBLE) AS v FROM (SELECT y, x, CASE WHEN kind = 2 THEN 1 WHEN kind IN (1, 5) THEN 2 ELSE 3 END AS v, count(*) AS c FROM cube GROUP BY ALL) GROUP BY y, x""")
def compose_then_mode(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(ERROR.name("error"), ACTIVITY.name("activity"), q.entity("conversion").name("conversion")).compose().reduce("mode", "time")))


@register("SELECT time, y, x, CAST(kind = 2 OR kind IN (1, 5) AS DOUBLE) AS v FROM cube")
def merge_any(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(ERROR, ACTIVITY).merge("any")))


@register("SELECT time, y, x, round(coalesce(CASE WHEN n > 2 THEN value END, 0) + peak, 6) AS v FROM cube")
def merge_sum(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(LEVEL.filter(N.evaluate("greater", 2)), PEAK).merge("sum")))


@register("SELECT time, y, x, round(100.0 * (CAST(kind = 2 AS INT) + CAST(kind IN (1, 5) AS INT) + CAST(value > 100 AS INT)) / 3, 6) AS v FROM cube")
def merge_percentage(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(ERROR, ACTIVITY, LEVEL.evaluate("greater", 100)).merge("percentage")))


@register("SELECT y, x, round(median(s), 6) AS v FROM (SELECT y, x, unnest([min(value), max(value), avg(value)]) AS s FROM cube GROUP BY y, x) GROUP BY y, x")
def merge_across_frames(spark, sf_dir):
    return out(one(spark, sf_dir, q.collection(LEVEL.reduce("min", "time"), LEVEL.reduce("max", "time"), LEVEL.reduce("mean", "time")).merge("median")))


# ---- recipes as users write them


@register("SELECT b AS band, y, x, round(median(CASE b WHEN 'value' THEN value ELSE peak END) FILTER (kind <> 2), 6) AS v FROM cube, (SELECT unnest(['value', 'peak']) AS b) GROUP BY ALL")
def composite(spark, sf_dir):
    clean = ERROR.evaluate("not")
    bands = q.collection(LEVEL.name("value"), PEAK.name("peak")).filter(clean).reduce("median", "time").concatenate("band")
    return out(one(spark, sf_dir, bands))


@register("SELECT time, CAST(100.0 * (count(*) FILTER (kind = 2)) / count(*) < 25 AS DOUBLE) AS v FROM cube GROUP BY time")
def image_selection(spark, sf_dir):
    return out(one(spark, sf_dir, ERROR.reduce("percentage", "space").evaluate("less", 25)))


@register("SELECT y, x, min(time) FILTER (kind = 2) AS v FROM cube GROUP BY y, x")
def first_seen(spark, sf_dir):
    return one(spark, sf_dir, ERROR.filter(q.self_()).assign_time().reduce("first", "time")).df


@register("SELECT time, y, x, round(value - avg(value) OVER (PARTITION BY y, x), 6) AS v FROM cube")
def anomaly(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.evaluate("subtract", LEVEL.reduce("mean", "time"))))


@register("SELECT time, y, x, CAST(n % 2 AS DOUBLE) AS v FROM cube")
def custom_operator(spark, sf_dir):
    return out(one(spark, sf_dir, N.evaluate("modulo", 2), custom_operators={"modulo": lambda x, y: x % y}))


@register("SELECT y, x, round(sum(value * value), 6) AS v FROM cube GROUP BY y, x")
def custom_reducer(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.reduce("sum_of_squares", "time"), custom_reducers={"sum_of_squares": lambda v, order: F.sum(v * v)}))


@register("SELECT time, y, x, 1.0 AS v FROM cube")
def custom_verb(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.apply_custom("ones"), custom_verbs={"ones": lambda x: x.with_expr(F.lit(1.0))}))


@register("SELECT time, round(sum(price * (1 - discount)), 4) AS v FROM cube WHERE time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY time", ITEMS)
def extent_in_time(spark, sf_dir):
    from .extent import TemporalExtent
    from .sources.base import Extent

    extent = Extent(spark, time=TemporalExtent("1996-01-01", "1996-12-31"))
    price, discount = q.layer("items", "price"), q.layer("items", "discount")
    sales = price.evaluate("multiply", discount.evaluate("multiply", -1).evaluate("add", 1)).reduce("sum", "space")
    from .plans.processor import QueryProcessor

    x = QueryProcessor.parse({"r": sales}, fixtures.source(spark, sf_dir), fixtures.ontology(), spark=spark, extent=extent).execute()["r"]
    return x.df.withColumn("v", F.round("v", 4))


# ---- mapped verbs: a verb on a collection works on each of its arrays


BANDS = "(SELECT unnest(['low', 'high']) AS band)"
BAND = "CASE band WHEN 'low' THEN value ELSE peak END"


def both(of=lambda x: x):
    return q.collection(of(LEVEL).name("low"), of(PEAK).name("high"))


@register(f"SELECT band, time, y, x, round({BAND} + 1, 6) AS v FROM cube, {BANDS}")
def mapped_evaluate(spark, sf_dir):
    return out(one(spark, sf_dir, both().evaluate("add", 1).concatenate("band")))


@register("SELECT band, time, CAST(day(time) AS DOUBLE) AS v FROM (SELECT DISTINCT time FROM cube), (SELECT unnest(['1', '2']) AS band)")  # coordinates have no name, so they are numbered
def mapped_extract(spark, sf_dir):
    return out(one(spark, sf_dir, both().extract("time", "day").concatenate("band")))


@register(f"SELECT band, time, y, x, 7.0 AS v FROM cube, {BANDS}")
def mapped_assign(spark, sf_dir):
    return out(one(spark, sf_dir, both().assign(7).concatenate("band")))


@register(f"SELECT band, b.time, y, x, round({BAND}, 6) AS v FROM cube JOIN tpos a ON cube.time = a.time JOIN tpos b ON b.p = a.p + 1, {BANDS}")
def mapped_shift(spark, sf_dir):
    return out(one(spark, sf_dir, both().shift("time", 1).concatenate("band")))


@register(f"""SELECT band, time, y, x, round(CASE WHEN count({BAND}) OVER w >= 2 THEN max({BAND}) OVER w END, 6) AS v
FROM cube JOIN tpos USING (time), {BANDS} WINDOW w AS (PARTITION BY band, y, x ORDER BY p RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def mapped_smooth(spark, sf_dir):
    return out(one(spark, sf_dir, both().smooth("max", "time", 1).concatenate("band")))


@register(f"SELECT band, time, y, x, round(CASE WHEN peak > (SELECT 0.97 * max(peak) FROM cube) THEN {BAND} END, 6) AS v FROM cube, {BANDS} WHERE time IN (SELECT time FROM cube WHERE peak > (SELECT 0.97 * max(peak) FROM cube))")
def mapped_trim(spark, sf_dir):
    return out(one(spark, sf_dir, both(lambda x: x.filter(HIGHEST)).trim("time").concatenate("band")))


_NEAREST = FILL_SQL.format(rule="WHEN b.time IS NULL THEN a.value WHEN a.time IS NULL THEN b.value WHEN epoch(g.time) - epoch(b.time) <= epoch(a.time) - epoch(g.time) THEN b.value ELSE a.value").replace("SELECT g.time", "SELECT '{band}' AS band, g.time")


@register(_NEAREST.format(band="low") + " UNION ALL " + _NEAREST.format(band="high").replace("value", "peak"))
def mapped_fill(spark, sf_dir):
    return out(one(spark, sf_dir, both(lambda x: x.filter(N.evaluate("greater", 1))).fill("time", "nearest").concatenate("band")))


@register(f"SELECT band, time, y, x, 1.0 AS v FROM cube, {BANDS}")
def mapped_apply_custom(spark, sf_dir):
    return out(one(spark, sf_dir, both().apply_custom("ones").concatenate("band"), custom_verbs={"ones": lambda x: x.with_expr(F.lit(1.0))}))


# ---- every reducer in a window and over a collection

IN_WINDOW = {
    "max": "max(value)", "min": "min(value)", "n": "count(value)", "product": "product(value / 100)", "variance": "var_pop(value)", "standard_deviation": "stddev_pop(value)",
    "range": "max(value) - min(value)", "first": "first_value(value IGNORE NULLS)", "last": "last_value(value IGNORE NULLS)",
}
OVER_COLLECTION = {
    "mean": "list_avg(s)", "max": "list_max(s)", "min": "list_min(s)", "n": "len(s)", "product": "list_product(s)", "range": "list_max(s) - list_min(s)",
    "variance": "list_var_pop(s)", "standard_deviation": "list_stddev_pop(s)", "first": "s[1]", "last": "s[-1]",
}
OF_FLAGS = {"all": "list_min(s)", "none": "1 - list_max(s)", "count": "list_sum(s)"}


def _smooth_with(reducer: str, aggregate: str) -> None:
    def query(spark, sf_dir):
        return out(one(spark, sf_dir, (GAPPY.evaluate("divide", 100) if reducer == "product" else GAPPY).smooth(reducer, "time", 2)))

    query.__name__ = f"smooth_time_with_{reducer}"
    over = " - ".join(f"{part} OVER w" for part in aggregate.split(" - "))
    register(_smooth_sql("{}").replace("{} OVER w", over))(query)


def _merge_with(reducer: str, parts: tuple, values: str, of: str) -> None:
    def query(spark, sf_dir):
        return out(one(spark, sf_dir, q.collection(*parts).merge(reducer)))

    query.__name__ = f"merge_with_{reducer}"
    register(f"SELECT time, y, x, round(CAST({of} AS DOUBLE), 6) AS v FROM (SELECT time, y, x, list_filter([{values}], lambda e: e IS NOT NULL) AS s FROM cube)")(query)


for _reducer, _sql in IN_WINDOW.items():
    _smooth_with(_reducer, _sql)
for _reducer, _sql in OVER_COLLECTION.items():
    _merge_with(_reducer, (GAPPY, PEAK, LEVEL.evaluate("divide", 2)), "CASE WHEN n > 1 THEN value END, peak, value / 2", _sql)
for _reducer, _sql in OF_FLAGS.items():
    _merge_with(_reducer, (ERROR, ACTIVITY, LEVEL.evaluate("greater", 100)), "CAST(kind = 2 AS INT), CAST(kind IN (1, 5) AS INT), CAST(value > 100 AS INT)", _sql)


# ---- extents, axes and sinks

TWO_AREAS = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}},
    {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "Polygon", "coordinates": [[[2, 2], [6, 2], [6, 6], [2, 6], [2, 2]]]}},
]}


@register("SELECT i + 0.5 AS y, j + 0.5 AS x, CASE WHEN i >= 2 AND j >= 2 THEN 2 WHEN i < 4 AND j < 4 THEN 1 END AS feature FROM (SELECT CAST(unnest(generate_series(0, 5)) AS DOUBLE) AS i), (SELECT CAST(unnest(generate_series(0, 5)) AS DOUBLE) AS j)", "")
def extent_rasterized(spark, sf_dir):
    from .extent import SpatialExtent

    return SpatialExtent.from_geojson(TWO_AREAS, "EPSG:3035").rasterize(spark, (-1, 1))


@register("SELECT CASE WHEN x >= 2 AND y >= 2 THEN 2 ELSE 1 END AS feature, time, round(avg(value), 6) AS v FROM cube WHERE (x <= 4 AND y <= 4) OR (x BETWEEN 2 AND 6 AND y BETWEEN 2 AND 6) GROUP BY ALL")
def extent_of_areas(spark, sf_dir):
    from .extent import SpatialExtent
    from .plans.processor import QueryProcessor
    from .sources.base import Extent

    cells = SpatialExtent.from_geojson(TWO_AREAS, "EPSG:3035").over(spark, list(range(8)), list(range(8))).where("feature IS NOT NULL")
    extent = Extent(spark, space=cells.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "feature"))
    by_area = LEVEL.groupby_space("feature").reduce("mean", "space").concatenate("feature")
    x = QueryProcessor.parse({"r": by_area}, fixtures.source(spark, sf_dir), fixtures.ontology(), spark=spark, extent=extent).execute()["r"]
    return out(x).withColumn("feature", F.col("feature").cast("int"))


@register("SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 2 DAY)) AS time", "")
def extent_discretized(spark, sf_dir):
    from .extent import TemporalExtent

    return TemporalExtent("2024-01-01", "2024-01-31").discretize(spark, "2 days")


@register("SELECT unnest([TIMESTAMP '2023-12-31 19:00:00', TIMESTAMP '2024-07-01 20:00:00']) AS time", "")
def extent_in_another_zone(spark, sf_dir):
    from .extent import TemporalExtent

    return TemporalExtent("2024-01-01", "2024-07-02", tz="UTC").discretize(spark, tz="America/New_York")


@register("SELECT time + INTERVAL 9 HOUR AS time, round(avg(value), 6) AS v FROM cube GROUP BY time")
def time_in_another_zone(spark, sf_dir):
    return out(verbs.tz_convert(one(spark, sf_dir, LEVEL.reduce("mean", "space")), "Asia/Tokyo"))


@register("SELECT DISTINCT y, CAST(y AS DOUBLE) AS v FROM cube")
def space_y(spark, sf_dir):
    return out(one(spark, sf_dir, LEVEL.extract("space", "y")))


@register("SELECT time AS moment, y AS line, x, round(value, 6) AS v FROM cube")
def dimensions_renamed(spark, sf_dir):
    return out(verbs.rename_dims(one(spark, sf_dir, LEVEL), {"time": "moment", "y": "line"}))


@register("SELECT DISTINCT y, x, concat('POINT (', x, ' ', y, ')') AS geometry FROM grid")
def points_of_the_grid(spark, sf_dir):
    return verbs.grid_points(one(spark, sf_dir, LEVEL))


@register("""SELECT y, x, v FROM (SELECT * FROM (SELECT CAST(unnest(generate_series(min(y), max(y))) AS INT) AS y FROM cube WHERE y % 3 = 0), (SELECT DISTINCT x FROM cube WHERE y % 3 = 0))
LEFT JOIN (SELECT y, x, round(avg(value), 6) AS v FROM cube WHERE y % 3 = 0 GROUP BY y, x) USING (y, x)""")
def space_regularized(spark, sf_dir):
    from .model import array

    means = one(spark, sf_dir, LEVEL.reduce("mean", "time")).df.where("y % 3 = 0")
    return out(verbs.regularize(array(means, ("y", "x"), "v", resolution=(1.0, 1.0))), dense=True)


@register("SELECT time, y, x, round(value, 6) AS v FROM cube")
def csv_read_back(spark, sf_dir):
    import uuid

    from .plans.components import shared_folder
    from .sources import export

    path = f"{shared_folder(spark)}/cubelark/csv-{uuid.uuid4().hex}"
    export.to_csv(one(spark, sf_dir, LEVEL), path, dense=False)
    back = spark.read.csv(path, header=True, schema="time timestamp_ntz, y int, x int, v double")
    return back.withColumn("v", rounded(F.col("v")))


@register("SELECT time, y, x, round(value, 6) AS v, concat('POINT (', x, ' ', y, ')') AS geometry, 'EPSG:3035' AS crs FROM grid LEFT JOIN cube USING (time, y, x)")
def points_of_the_cells(spark, sf_dir):
    from .sources import export

    frame = export.to_geodataframe(verbs.write_crs(one(spark, sf_dir, LEVEL), "EPSG:3035"))
    return frame.withColumnRenamed(frame.columns[3], "v").withColumn("v", rounded(F.col("v")))


@register("SELECT count(value) = 0 AS empty, count(value) FILTER (peak < 0) = 0 AS filtered_empty FROM cube")
def emptiness(spark, sf_dir):
    r = many(spark, sf_dir, whole=LEVEL, none=LEVEL.filter(PEAK.evaluate("less", 0)))
    return spark.createDataFrame([(r["whole"].is_empty(), r["none"].is_empty())], "empty boolean, filtered_empty boolean")


@register("""SELECT t.time, CAST(t.y AS DOUBLE) AS y, CAST(t.x AS DOUBLE) AS x, round(sum(s.value * (1 - abs(s.y - t.y) / 2.0) * (1 - abs(s.x - t.x) / 2.0)) / sum((1 - abs(s.y - t.y) / 2.0) * (1 - abs(s.x - t.x) / 2.0)), 6) AS v
FROM (SELECT time, y, x FROM cube WHERE y % 2 = 1 AND x % 2 = 1) AS t JOIN cube AS s ON s.time = t.time AND abs(s.y - t.y) <= 1 AND abs(s.x - t.x) <= 1 GROUP BY t.time, t.y, t.x""")
def resampled_bilinear(spark, sf_dir):
    """Cells of twice the size, whose centres lie on every second cell."""
    from .extent import SpatialExtent
    from .plans.mapping import Ontology
    from .plans.processor import QueryProcessor
    from .sources.table import TableCube

    cube = TableCube(fixtures.LAYOUT, {"events": lambda s, e: fixtures.events_cube(s, sf_dir, e)}, resamplers={"continuous": "bilinear"}, native=(0.0, 1.0, 0.0, 1.0))
    space = SpatialExtent({"type": "Polygon", "coordinates": [[[0, 0], [8, 0], [8, 8], [0, 8], [0, 0]]]}, "EPSG:3035")
    return out(QueryProcessor.parse({"r": LEVEL}, cube, Ontology(), space, spark=spark, spatial_resolution=(2, 2)).execute()["r"])


@register("SELECT DISTINCT y, x, round(degrees(x * 100000 / 6378137.0), 9) AS lon, round(degrees(atan((exp(y * 100000 / 6378137.0) - exp(-y * 100000 / 6378137.0)) / 2)), 9) AS lat FROM grid")
def points_in_degrees(spark, sf_dir):
    from .functions.projection import project

    points = verbs.grid_points(one(spark, sf_dir, LEVEL)).select("y", "x", (F.col("y") * 100000).alias("north"), (F.col("x") * 100000).alias("east"))
    moved = project(points, "EPSG:3857", "EPSG:4326", "east", "north", ("lon", "lat"))
    return moved.select("y", "x", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each place had the concept "error"."""
    return QUERIES["concept_count_map"](spark, sf_dir)


