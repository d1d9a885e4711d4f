"""Many plans as one table: checked set-wise, a row a violation, and run together in one scan.

A plan is a row (PLANS): an operator (rate, mean or count), a metric, dimensions, filters and a confidence. violations() checks
all plans of a table at once by joins with the vocabulary. run() makes every valid plan a conditional aggregate of a single scan: rows are
counted once by the dimensions that any plan asks for, with a plan's filters as its condition, and each plan rolls up its own
groups from those counts.

Defined results: a null or repeated plan_id is a violation of its plan; a null filter list or dimension list is an empty one; a
null operator, field or value is a violation; comparisons with null rows are false; groups of null dimensions are named null; an
empty table of plans, or of rows, gives no rows (a plan without groups gives one, of zero).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .catalog import Catalog
from .plan import MAX_DIMENSIONS, MAX_GROUPS, PlanError

PLANS = "plan_id string, op string, metric string, group_by array<string>, filters array<struct<field string, op string, value double, high double, word string>>, confidence double"
OPERATORS = ("rate", "mean", "count")
#: Filters by a number (value, and high for between), by a word, and by none.
BY_NUMBER, BY_WORD, BY_NONE = ("eq", "ne", "lt", "le", "gt", "ge", "between"), ("is", "is_not"), ("is_null", "is_not_null")
#: Plans of one scan: their conditions are one expression each.
MAX_PLANS = 500


def vocabulary(plans: DataFrame, cat: Catalog) -> DataFrame:
    """name, kind (metric or dimension), least: the catalog as a table."""
    rows = [(m.name, "metric", m.least) for m in cat.metrics.values()] + [(d, "dimension", None) for d in cat.dimensions]
    return plans.sparkSession.createDataFrame(rows, "name string, kind string, least double")


def violations(plans: DataFrame, cat: Catalog) -> DataFrame:
    """plan_id, rule, detail: everything that keeps a plan from being run. Plans without a row here are valid."""
    words = F.broadcast(vocabulary(plans, cat))  # the catalog's size, not the table's
    said = lambda df, rule, detail: df.select("plan_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    p = plans.withColumns({"group_by": F.coalesce("group_by", F.array().cast("array<string>")), "filters": F.coalesce("filters", F.expr("CAST(array() AS array<struct<field string, op string, value double, high double, word string>>)"))})
    f = p.select("plan_id", F.explode("filters").alias("f")).select("plan_id", "f.*")
    g = p.select("plan_id", F.explode("group_by").alias("name"))
    key = [k for k, v in cat.dimensions.items() if v == cat.key]
    known = f.join(words, f.field == words.name, "left")
    unknown = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    number = F.col("op").isin(*BY_NUMBER)
    metric = p.filter("op IN ('rate', 'mean')").join(words.filter("kind = 'metric'").select(F.col("name").alias("metric")), "metric", "left_anti")
    parts = [
        said(p.filter("plan_id IS NULL"), "plan without a name", F.lit(None)),
        said(p.groupBy("plan_id").count().filter("count > 1 AND plan_id IS NOT NULL"), "name is not unique", F.col("count")),
        said(p.filter(unknown("op", OPERATORS)), "unknown operator", F.col("op")),
        said(metric.filter("op = 'mean'"), "unknown metric", F.col("metric")),
        said(p.filter(F.size("group_by") > MAX_DIMENSIONS), "too many dimensions", F.size("group_by")),
        said(g.join(words.filter("kind = 'dimension'"), "name", "left_anti"), "unknown dimension", F.col("name")),
        said(g.filter(F.col("name").isin(*key)), "a key is no dimension", F.col("name")),
        said(p.filter(F.coalesce(~F.col("confidence").between(0.5, 0.999999), F.lit(False))), "confidence out of range", F.col("confidence")),
        said(f.filter(unknown("op", (*BY_NUMBER, *BY_WORD, *BY_NONE))), "unknown filter", F.col("op")),
        said(known.filter("kind IS NULL"), "unknown field", F.col("field")),
        said(f.filter(number & (F.col("value").isNull() | F.isnan("value") | ((F.col("op") == "between") & F.col("high").isNull()))), "filter without a value", F.col("field")),
        said(f.filter(F.col("op").isin(*BY_WORD) & F.col("word").isNull()), "filter without a value", F.col("field")),
        said(f.filter((F.col("op") == "between") & (F.col("high") < F.col("value"))), "empty range", F.col("field")),
        said(known.filter(number & (F.col("kind") == "dimension")), "a dimension is no number", F.col("field")),
        said(known.filter(F.col("op").isin(*BY_WORD) & (F.col("kind") == "metric")), "a metric is no word", F.col("field")),
        said(known.filter(number & (F.col("value") < F.col("least"))), "impossible value", F.col("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _condition(filters, cat: Catalog) -> Column:
    def one(f) -> Column:
        x = F.col(cat.column(f.field))
        match f.op:
            case "between":
                return x.between(f.value, f.high)
            case "is" | "is_not":
                return (x == f.word) if f.op == "is" else (x != f.word)
            case "is_null" | "is_not_null":
                return x.isNull() if f.op == "is_null" else x.isNotNull()
        return {"eq": x == f.value, "ne": x != f.value, "lt": x < f.value, "le": x <= f.value, "gt": x > f.value, "ge": x >= f.value}[f.op]

    return F.coalesce(reduce(lambda a, b: a & b, [one(f) for f in filters or ()], F.lit(True)), F.lit(False))


def valid(plans: DataFrame, cat: Catalog) -> DataFrame:
    return plans.join(violations(plans, cat).select("plan_id").distinct(), "plan_id", "left_anti").filter("plan_id IS NOT NULL")


def run(df: DataFrame, plans: DataFrame, cat: Catalog) -> DataFrame:
    """plan_id, grp, n, value, ci_lo, ci_hi: all valid plans' results from one scan of df.

    value is a rate in percent with its Wilson interval, a mean with its normal one, or the count of rows. A plan of more than
    MAX_GROUPS groups fails the query. The plans, MAX_PLANS of them at most, come to the driver.
    """
    todo = valid(plans, cat).orderBy("plan_id").limit(MAX_PLANS + 1).collect()
    if len(todo) > MAX_PLANS:
        raise PlanError(f"more than {MAX_PLANS} plans")
    result = "plan_id string, grp string, n long, value double, ci_lo double, ci_hi double"
    if not todo:
        return df.sparkSession.createDataFrame([], result)
    dims = sorted({cat.column(g) for p in todo for g in p.group_by or ()})
    conditions: dict[str, int] = {}  # plans of equal filters share theirs
    where: list[Column] = []
    sums: dict[tuple[int, str], str] = {}
    rows = []
    for p in todo:
        text = repr(p.filters or [])
        if text not in conditions:
            conditions[text] = len(where)
            where.append(_condition(p.filters, cat))
        c, x = conditions[text], cat.outcome if p.op == "rate" else cat.column(p.metric) if p.op == "mean" else ""
        if x:
            sums[c, x] = f"{c}_{x}"
        grp = F.concat_ws("/", *[F.coalesce(F.col(cat.column(g)).cast("string"), F.lit("null")) for g in p.group_by]) if p.group_by else F.lit("all")
        of = [F.col(f"_{k}_{c}_{x}") if x else F.lit(None) for k in ("n", "m", "v")]
        rows.append(F.struct(F.lit(p.plan_id).alias("plan_id"), F.lit(p.op).alias("op"), F.lit(S.z(p.confidence or 0.95)).alias("z"), F.lit(bool(p.group_by)).alias("grouped"), grp.alias("grp"), F.col(f"_r_{c}").alias("r"), of[0].cast("long").alias("n"), of[1].cast("double").alias("m"), of[2].cast("double").alias("v")))
    aggs = [F.count_if(w).alias(f"_r_{i}") for i, w in enumerate(where)]
    for c, x in sums:
        v = F.when(where[c], F.col(x).cast("double"))
        aggs += [F.count(v).alias(f"_n_{c}_{x}"), F.avg(v).alias(f"_m_{c}_{x}"), F.var_pop(v).alias(f"_v_{c}_{x}")]
    base = df.groupBy(*dims).agg(*aggs)
    long = base.select(F.explode(F.array(*rows)).alias("s")).select("s.*").filter("r > 0 OR NOT grouped")
    g = long.groupBy("plan_id", "op", "z", "grp").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * (F.coalesce("v", F.lit(0.0)) + F.col("m") * F.col("m"))).alias("q"))
    per = F.count(F.lit(1)).over(Window.partitionBy("plan_id"))
    g = g.withColumn("_many", F.when(per > MAX_GROUPS, F.raise_error(F.concat(F.lit(f"more than {MAX_GROUPS} groups: "), "plan_id"))).otherwise(F.lit(None).cast("string"))).filter("_many IS NULL")
    mean = F.try_divide("s", "n")
    half = F.col("z") * F.sqrt(F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))) / F.sqrt("n")
    low, high = S.wilson_at(F.col("s"), F.col("n"), F.col("z"))
    is_rate, some = F.col("op") == "rate", F.col("n") > 0
    value = F.when(F.col("op") == "count", F.col("rows").cast("double")).when(is_rate, 100 * mean).otherwise(mean)
    pick = lambda r, m: F.when(some & is_rate, 100 * r).when((F.col("op") == "mean") & (F.col("n") > 1), m)
    return g.select("plan_id", "grp", F.when(F.col("op") == "count", F.col("rows")).otherwise(F.col("n")).alias("n"), value.alias("value"), pick(low, mean - half).alias("ci_lo"), pick(high, mean + half).alias("ci_hi"))
