"""The analysis operators: a validated plan over a fact table gives one tidy DataFrame.

Cohorts are conditional aggregates of one scan, never a query each. All results are small by construction (groups are
limited) except records and root causes by row, which stay distributed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans.catalog import Catalog
from ..plans.plan import MAX_GROUPS, Binning, Cohort, Plan, PlanError, all_of
from .explore import explore as explore
from .quantiles import quantiles, summary


def _cohorts(plan: Plan) -> tuple[Cohort, ...]:
    return plan.cohorts or (Cohort("all"),)


def _metric_columns(plan: Plan, cat: Catalog) -> dict[str, str]:
    return {m: cat.column(m) for m in plan.metrics}


def describe(df: DataFrame, plan: Plan, cat: Catalog) -> DataFrame:
    """cohort, metric, n, mean with interval, sd, min, p25, median, p75, max, quality. Moments come with the quantiles' first
    pass, quantiles are exact and their state is bounded (see quantiles); the result has a row for each cohort and metric."""
    pairs = [(c, m) for c in _cohorts(plan) for m in plan.metrics]
    rows = df.filter(all_of(plan.filters, cat))
    found, told = summary(rows, {f"{i}": F.when(all_of(c.filters, cat), F.col(cat.column(m))) for i, (c, m) in enumerate(pairs)}, (0.25, 0.5, 0.75))
    one = lambda i, c, m: (c.name, m, *[told[f"{i}"][k] for k in ("n", "mean", "sd", "min", "max")], found[f"{i}"])
    out = df.sparkSession.createDataFrame([one(i, c, m) for i, (c, m) in enumerate(pairs)], "cohort string, metric string, n long, mean double, sd double, min double, max double, q array<double>")
    lo, hi = S.mean_interval(F.col("mean"), F.col("sd"), F.col("n"), plan.confidence)
    return out.select("cohort", "metric", "n", "mean", lo.alias("ci_lo"), hi.alias("ci_hi"), "sd", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", S.quality(F.col("n")).alias("quality"))


def edges(df: DataFrame, column: str, binning: Binning) -> list[float]:
    """Distinct ascending edges of a binning; one pass for widths, three for quantiles."""
    if binning.how == "explicit":
        return [float(e) for e in binning.bins]
    n = int(binning.bins)
    x = F.col(column).cast("double")
    if binning.how == "width":
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        return sorted({lo + (hi - lo) * i / n for i in range(n + 1)}) if lo is not None else []
    found = quantiles(df, {"x": x}, tuple(i / n for i in range(n + 1)))["x"]
    return sorted({v for v in found if v is not None})


def bin_index(column: str, e: list[float]) -> Column:
    """0-based bin of half-open bins whose last is closed; null outside and for null."""
    x = F.col(column).cast("double")
    inner = [(x >= edge).cast("int") for edge in e[1:-1]]
    return F.when((x >= e[0]) & (x <= e[-1]), reduce(lambda a, b: a + b, inner, F.lit(0)))


def _label(e: list[float], i: int) -> str:
    span = e[-1] - e[0]
    d = 0 if span >= 100 else 1 if span >= 10 else 2
    return f"{e[i]:.{d}f}-{e[i + 1]:.{d}f}"


def _grain(cat: Catalog, grain: str) -> Column:
    t = F.col(cat.time)
    if grain == "shift":
        return F.concat(F.date_format(F.date_trunc("day", t), "yyyy-MM-dd"), F.lit("-"), F.col(cat.column("shift")))
    return F.date_format(F.date_trunc(grain, t), "yyyy-MM-dd HH:mm")


def _grouped(df: DataFrame, plan: Plan, cat: Catalog) -> tuple[DataFrame, Column, list]:
    """(rows, group key, order of groups): dimensions, a binned axis, or a time grain. order columns are aggregates."""
    df = df.filter(all_of(plan.filters, cat))
    if plan.binning and plan.axis:
        col = cat.column(plan.axis)
        e = edges(df, col, plan.binning)
        if len(e) >= 2:
            names = [_label(e, i) for i in range(len(e) - 1)]
            df = df.withColumn("bin", F.coalesce(bin_index(col, e), F.lit(len(names))))
            key = F.element_at(F.array(*[F.lit(n) for n in names], F.lit("out_of_range")), F.col("bin") + 1)
            return df, key, [F.min("bin").alias("ord")]
        return df, F.lit("all"), []
    if plan.grain:
        return df, _grain(cat, plan.grain), []
    if plan.group_by:
        parts = [F.col(cat.column(g)).cast("string") for g in plan.group_by]
        return df, reduce(lambda a, b: F.concat(a, F.lit("/"), b), parts), []
    return df, F.lit("all"), []


def rate(df: DataFrame, plan: Plan, cat: Catalog, *, rollup: bool = False) -> DataFrame:
    """grp, ord, failures, n, rate (percent) and its Wilson interval; rollup adds the overall row. Too many groups are refused."""
    df, key, order = _grouped(df, plan, cat)
    y = F.col(cat.outcome)
    keyed = df.withColumn("grp", key)
    g = keyed.rollup("grp") if rollup else keyed.groupBy("grp")
    out = g.agg(F.sum(y).cast("bigint").alias("failures"), F.count(F.lit(1)).alias("n"), *(order or [F.lit(0).alias("ord")]), F.grouping("grp").alias("total") if rollup else F.lit(0).alias("total"))
    if plan.group_by:  # the few groups there may be come here, so that nothing is aggregated twice
        rows = out.limit(MAX_GROUPS + 2).collect()
        if len(rows) > MAX_GROUPS + rollup:
            raise PlanError(f"more than {MAX_GROUPS} groups")
        out = df.sparkSession.createDataFrame(rows, out.schema)
    out = out.withColumn("grp", F.when(F.col("total") == 1, F.lit("overall")).otherwise(F.col("grp"))).drop("total")
    lo, hi = S.wilson(F.col("failures"), F.col("n"), plan.confidence)
    return out.select("grp", "ord", "failures", "n", (100 * F.try_divide(F.col("failures").cast("double"), F.col("n"))).alias("rate"), (100 * lo).alias("ci_lo"), (100 * hi).alias("ci_hi"), S.quality(F.col("n")).alias("quality"))


def premise_shape(groups: DataFrame) -> DataFrame:
    """How the rate moves over at least three ordered groups, and the ratio of its ends; one row, from at most 200."""
    w = Window.partitionBy().orderBy("ord", "grp")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = groups.filter("grp <> 'out_of_range'").withColumn("prev", F.lag("rate").over(w)).withColumn("first", F.first("rate").over(full)).withColumn("last", F.last("rate").over(full)).withColumn("at", F.row_number().over(w)).withColumn("k", F.count(F.lit(1)).over(full))
    inner = F.when((F.col("at") > 1) & (F.col("at") < F.col("k")), F.col("rate"))
    a = r.agg(F.max("k").alias("n_groups"), F.max("first").alias("first_rate"), F.max("last").alias("last_rate"), F.min("rate").alias("lo"), F.max(inner).alias("inner_hi"), F.bool_and(F.coalesce(F.col("rate") >= F.col("prev"), F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("rate") <= F.col("prev"), F.lit(True))).alias("down"))
    ends_hi, ends_lo = F.greatest("first_rate", "last_rate"), F.least("first_rate", "last_rate")
    shape = F.when(F.col("n_groups") < 3, "undetermined").when(F.col("up"), "increases").when(F.col("down"), "decreases").when(ends_lo > 1.05 * F.col("lo"), "U-shaped").when(F.col("inner_hi") > 1.05 * ends_hi, "peaked in the middle").otherwise("non-monotonic")
    return a.select("n_groups", shape.alias("shape"), "first_rate", "last_rate", F.try_divide("first_rate", "last_rate").alias("low_high_ratio"))


def premise_rank(groups: DataFrame, subject: str) -> DataFrame:
    """Is the subject's rate the highest? Ties keep the order of keys."""
    w = Window.partitionBy().orderBy(F.desc("rate"), "grp")
    all_ = Window.partitionBy()
    r = groups.withColumn("rank", F.row_number().over(w)).withColumn("groups", F.count(F.lit(1)).over(all_)).withColumn("highest_rate", F.max("rate").over(all_)).withColumn("highest_group", F.first("grp").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return r.filter(F.col("grp") == subject).select(F.col("grp").alias("subject"), F.col("rate").alias("subject_rate"), "highest_group", "highest_rate", F.col("rank").cast("bigint").alias("rank"), "groups", F.when(F.col("rank") == 1, "supported").otherwise("refuted").alias("verdict"), F.try_divide("highest_rate", "rate").alias("ratio"))


def ranking_test(groups: DataFrame) -> DataFrame:
    """Could chance alone spread the rates so far? At most 200 groups' counts come to the driver."""
    rows = groups.select("failures", "n").limit(MAX_GROUPS + 1).collect()
    seen, chance, p = S.permutation_spread([(r.failures, r.n) for r in rows if r.n]) if len(rows) >= 3 else (None, None, None)
    return groups.sparkSession.createDataFrame([(seen and 100 * seen, chance and 100 * chance, p, p is not None and p > 0.05)], "spread_points double, chance_spread_points double, p_value double, ranking_is_chance boolean")


def compare(df: DataFrame, plan: Plan, cat: Catalog) -> DataFrame:
    """Two cohorts by metric: means, difference, Cohen's d with interval and magnitude; one scan, both cohorts as conditions."""
    a, b = plan.cohorts[:2]
    ina, inb = all_of(a.filters, cat), all_of(b.filters, cat)
    aggs = []
    for m, c in _metric_columns(plan, cat).items():
        x = F.col(c).cast("double")
        for side, cond in (("a", ina), ("b", inb)):
            v = F.when(cond, x)
            aggs += [F.count(v).alias(f"{side}_n_{m}"), F.avg(v).alias(f"{side}_mean_{m}"), F.stddev_samp(v).alias(f"{side}_sd_{m}")]
    one = df.filter(all_of(plan.filters, cat)).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{s}_{k}_{m}").alias(f"{s}_{k}") for s in "ab" for k in ("n", "mean", "sd")]) for m in plan.metrics])
    long = one.select(F.explode(rows).alias("s")).select("s.*")
    d = S.cohens_d(F.col("a_mean"), F.col("a_sd"), F.col("a_n"), F.col("b_mean"), F.col("b_sd"), F.col("b_n"))
    long = long.withColumn("d", d)
    lo, hi = S.d_interval(F.col("d"), F.col("a_n"), F.col("b_n"), plan.confidence)
    return long.select("metric", "a_n", "a_mean", "a_sd", "b_n", "b_mean", "b_sd", (F.col("a_mean") - F.col("b_mean")).alias("delta"), "d", lo.alias("d_lo"), hi.alias("d_hi"), S.magnitude(F.col("d")).alias("magnitude"))


def drivers(df: DataFrame, plan: Plan, cat: Catalog) -> DataFrame:
    """Metrics ranked by how far they separate the two cohorts; significant where the interval leaves out zero."""
    c = compare(df, plan, cat)
    w = Window.partitionBy().orderBy(F.desc(F.abs(F.col("d"))), "metric")
    return c.select(F.row_number().over(w).cast("bigint").alias("position"), "metric", F.col("d").alias("separation"), F.when(F.col("d") > 0, "higher").otherwise("lower").alias("direction"), "a_mean", "b_mean", ((F.col("d_lo") > 0) | (F.col("d_hi") < 0)).alias("significant"), ((F.col("a_n") < 2) | (F.col("b_n") < 2)).alias("abstain"))


def correlations(df: DataFrame, plan: Plan, cat: Catalog, threshold: float = 0.7) -> DataFrame:
    """All pairs of metrics in one aggregate."""
    m = list(plan.metrics)
    pairs = [(x, y) for i, x in enumerate(m) for y in m[i + 1 :]]
    one = df.filter(all_of(plan.filters, cat)).agg(*[S.corr(F.col(cat.column(x)).cast("double"), F.col(cat.column(y)).cast("double")).alias(f"{x}__{y}") for x, y in pairs])
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}__{y}").alias("r")) for x, y in pairs])
    return one.select(F.explode(rows).alias("s")).select("s.*").withColumn("collinear", F.coalesce(F.abs("r") >= threshold, F.lit(False)))


def trend(df: DataFrame, plan: Plan, cat: Catalog) -> DataFrame:
    """bucket, i, n, failures, failure_rate and each metric's mean, by binned axis or time grain."""
    df, key, order = _grouped(df, plan, cat)
    out = df.groupBy(key.alias("bucket")).agg(*(order or [F.lit(0).alias("ord")]), F.count(F.lit(1)).alias("n"), F.sum(cat.outcome).cast("bigint").alias("failures"), *[F.avg(F.col(c).cast("double")).alias(m) for m, c in _metric_columns(plan, cat).items()])
    out = out.filter("bucket <> 'out_of_range'")
    i = F.row_number().over(Window.partitionBy().orderBy("ord", "bucket")) - 1
    return out.select("bucket", i.cast("bigint").alias("i"), "n", "failures", (100.0 * F.col("failures") / F.col("n")).alias("failure_rate"), *plan.metrics)


def slope(buckets: DataFrame, y: str, confidence: float = 0.95) -> DataFrame:
    """Least-squares slope of y over the bucket number, its interval, and the direction that it supports."""
    a = buckets.agg(F.count(y).alias("n"), F.regr_slope(y, "i").alias("slope"), F.regr_sxx(y, "i").alias("sxx"), F.regr_syy(y, "i").alias("syy"), F.regr_sxy(y, "i").alias("sxy"), (F.max(y) - F.min(y)).alias("span"), F.avg(F.abs(F.col(y))).alias("size"))
    ssr = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.when(F.col("n") > 2, F.sqrt(ssr / (F.col("n") - 2) / F.col("sxx")))
    a = a.withColumn("lo", F.col("slope") - S.z(confidence) * se).withColumn("hi", F.col("slope") + S.z(confidence) * se)
    way = F.when(F.col("lo") > 0, "rising").when(F.col("hi") < 0, "falling").when(F.col("span") > F.col("size"), "not well described by a straight line").otherwise("flat")
    return a.select("n", "slope", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"), way.alias("direction"))


def changepoint(buckets: DataFrame, y: str) -> DataFrame:
    """The split that moves the mean most, if there are six buckets and the move is 0.4 of the range."""
    w = Window.partitionBy().orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    r = buckets.select("bucket", "i", (F.avg(y).over(after) - F.avg(y).over(before)).alias("shift"), F.count(F.lit(1)).over(all_).alias("k"), (F.max(y).over(all_) - F.min(y).over(all_)).alias("span"))
    r = r.filter((F.col("k") >= 6) & (F.col("i") >= 2) & (F.col("i") < F.col("k") - 1) & (F.col("span") > 0)).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.abs("shift")), "i")))
    return r.filter((F.col("place") == 1) & (F.abs("shift") / F.col("span") >= 0.4)).select(F.col("bucket").alias("at"), "i", "shift")


def records(df: DataFrame, plan: Plan, cat: Catalog, columns: list[str]) -> DataFrame:
    """The first rows of a stated order; the key settles ties."""
    order = {"closest_to_failure": [F.asc_nulls_last("worst_margin")], "most_recent": [F.desc(cat.time)] if cat.time else []}.get(plan.order, [])
    return df.filter(all_of(plan.filters, cat)).orderBy(*order, cat.key).limit(plan.limit).select(*columns)


OPERATORS = {"describe": describe, "rate": rate, "compare": compare, "drivers": drivers, "correlations": correlations, "trend": trend}


def execute(df: DataFrame, plan: Plan, cat: Catalog) -> DataFrame:
    plan = plan.validated(cat)
    if plan.op not in OPERATORS:
        raise PlanError(f"unknown operator: {plan.op}")
    return OPERATORS[plan.op](df, plan, cat)
