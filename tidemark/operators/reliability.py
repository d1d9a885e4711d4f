"""Trust in data and rules: audits, invariants, drift, threshold brackets, maintenance, fleet, remaining life, discovery."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans.process import Process
from .quantiles import summary


def data_quality(df: DataFrame) -> DataFrame:
    """Rows, failures, unexplained failures, random failures left out of the roll-up, tool-wear flags against the window, rule misses."""
    fail = F.col("machine_failure") == 1
    explained = (F.col("hdf") + F.col("pwf") + F.col("osf") + F.col("twf")) > 0
    audit = [F.count_if(F.col(f"{n}_rule") & (F.col(n) == 0)).alias(f"{n}_false_alarms") for n in ("hdf", "pwf", "osf")] + [F.count_if(~F.col(f"{n}_rule") & (F.col(n) == 1)).alias(f"{n}_surprises") for n in ("hdf", "pwf", "osf")]
    clean = F.lit(0) == reduce(lambda a, b: a + b, [F.count_if((F.col(f"{n}_rule") != (F.col(n) == 1))) for n in ("hdf", "pwf", "osf")])
    verdict = F.when(F.count(F.lit(1)) == 0, "no data").when(~clean, "labels contradict rules").when(F.count_if(fail & ~explained) > 0, "consistent, with unexplained failures").otherwise("consistent")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("machine_failure").cast("bigint").alias("failures"), F.count_if(fail & ~explained).alias("orphans"), F.avg(F.when(fail & ~explained, F.col("worst_margin"))).alias("orphan_margin"), F.avg(F.when(~fail, F.col("worst_margin"))).alias("healthy_margin"), F.count_if((F.col("rnf") == 1) & ~fail).alias("rnf_not_rolled_up"), F.sum("twf").cast("bigint").alias("twf_flags"), F.count_if("twf_rule").alias("twf_window"), *audit, verdict.alias("verdict"))


#: Expected levels and tolerances of the process's laws, and the channels that each speaks of.
LAWS = (("heat_order", 0.0, 0.0), ("temp_delta_mean", 10.0, 0.25), ("temp_delta_sd", 1.0, 0.25), ("speed_torque_corr", -0.875, 0.10), ("power_mean", 6280.0, 628.0))
LAW_CHANNELS = {"heat_order": ("air_temp_k", "process_temp_k", "temp_delta_k"), "temp_delta_mean": ("air_temp_k", "process_temp_k", "temp_delta_k"), "temp_delta_sd": ("air_temp_k", "process_temp_k", "temp_delta_k"), "speed_torque_corr": ("rotational_speed_rpm", "torque_nm"), "power_mean": ("power_w", "rotational_speed_rpm", "torque_nm")}


def _laws(where: Column | None = None) -> dict[str, Column]:
    """Each law's value as an aggregate over the rows that meet a condition."""
    of = (lambda c: F.col(c)) if where is None else (lambda c: F.when(where, F.col(c)))
    dt = of("temp_delta_k")
    wrong = F.count_if(of("process_temperature_k") <= of("air_temperature_k")).cast("double")
    return dict(zip([n for n, *_ in LAWS], (wrong, F.avg(dt), F.stddev_samp(dt), S.corr(of("rotational_speed_rpm"), of("torque_nm")), F.avg(of("power_w"))), strict=True))


def _holds(value: Column, expected: float, tolerance: float) -> Column:
    return F.coalesce(F.abs(value - expected) <= tolerance, F.lit(False))


def invariants(df: DataFrame) -> DataFrame:
    """Five laws of the process, measured in one pass: name, value, expected, tolerance, holds (null-safe on an empty window)."""
    a = df.agg(*[v.alias(n) for n, v in _laws().items()])
    rows = F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(n).alias("value"), F.lit(e).alias("expected"), F.lit(t).alias("tolerance"), _holds(F.col(n), e, t).alias("holds")) for n, e, t in LAWS])
    return a.select(F.explode(rows).alias("s")).select("s.*")


def invariant_flags(laws: DataFrame, touched: set[str] | None = None) -> DataFrame:
    """The laws of invariants() that don't hold and speak of a channel that an analysis touches (of any, where it names none)."""
    names = [n for n, channels in LAW_CHANNELS.items() if not touched or touched & set(channels)]
    return laws.filter(~F.col("holds") & F.col("invariant").isin(*names)).select("invariant", "value", "expected", "tolerance")


def health(df: DataFrame) -> DataFrame:
    """One row for each law and each rule's calibration: kind, name, whether it is in order, and why not."""
    laws = invariants(df).select(F.lit("invariant").alias("kind"), F.col("invariant").alias("name"), F.col("holds").alias("ok"), F.when(F.col("holds"), "holds").otherwise("violated").alias("detail"))
    rules = calibration_audit(df).select(F.lit("calibration").alias("kind"), F.col("rule").alias("name"), (F.col("verdict") == "calibrated").alias("ok"), F.col("verdict").alias("detail"))
    return laws.unionByName(rules)


def with_previous(df: DataFrame, key: str, columns: tuple[str, ...], *, block: int = 10_000) -> DataFrame:
    """df with each column's value in the row before, in the order of key, as <column>_prev.

    No task orders the whole table: rows are ordered inside blocks of the key, and a block's first row takes the last row of the
    block before, from a table with one row a block. Rows without a key are kept and have no row before them.
    """
    none = F.col(key).isNull()
    at = F.when(none, F.pmod(F.xxhash64(*columns), F.lit(1024))).otherwise(F.floor(F.col(key) / block))  # keyless rows are spread
    inside = Window.partitionBy("_none", "_block").orderBy(key)
    rows = df.withColumn("_none", none).withColumn("_block", at).withColumn("_place", F.row_number().over(inside)).withColumns({f"{c}_prev": F.lag(c).over(inside) for c in columns})
    last = df.filter(~none).groupBy(at.alias("_block")).agg(F.max_by(F.struct(*columns), key).alias("_r"))
    before = last.select(F.lit(False).alias("_none"), "_block", F.lag("_r").over(Window.partitionBy().orderBy("_block")).alias("_before"))
    joined = rows.join(before, ["_none", "_block"], "left")
    first = F.col("_place") == 1
    shown = {f"{c}_prev": F.when(~F.col("_none"), F.when(first, F.col(f"_before.{c}")).otherwise(F.col(f"{c}_prev"))) for c in columns}
    return joined.withColumns(shown).drop("_none", "_block", "_place", "_before")


def drift(df: DataFrame, window: Column, *, threshold: float = 5.0, block: int = 10_000) -> DataFrame:
    """Is the window's shift against the baseline a sensor's or the process's?

    z scores of the means use sample sizes corrected for lag-one correlation. The process doesn't move the temperature
    difference alone: if only that has moved, or a law is broken while speed and torque stand still, a sensor has; if speed or
    torque has moved, the process has.
    """
    chans = {"dt": "temp_delta_k", "rpm": "rotational_speed_rpm", "tq": "torque_nm"}
    src = df.select("udi", window.alias("now"), "process_temperature_k", "air_temperature_k", "power_w", *chans.values())
    r = with_previous(src, "udi", tuple(chans.values()), block=block)
    aggs = [v.alias(n) for n, v in _laws(F.col("now")).items()]
    for k, c in chans.items():
        old, new = F.when(~F.col("now"), F.col(c)), F.when(F.col("now"), F.col(c))
        aggs += [F.avg(old).alias(f"{k}_m0"), F.stddev_samp(old).alias(f"{k}_s0"), F.avg(new).alias(f"{k}_m1"), F.count(new).alias(f"{k}_n1"), S.corr(old, F.when(~F.col("now"), F.col(f"{c}_prev"))).alias(f"{k}_rho")]
    a = r.agg(*aggs)
    z = {k: F.try_divide(F.col(f"{k}_m1") - F.col(f"{k}_m0"), F.col(f"{k}_s0") / F.sqrt(S.effective_n(F.col(f"{k}_n1"), F.col(f"{k}_rho")))) for k in chans}
    broken = reduce(lambda x, y: x | y, [~_holds(F.col(n), e, t) for n, e, t in LAWS])
    a = a.select(*[v.alias(f"z_{k}") for k, v in z.items()], broken.alias("law_broken"))
    hot = F.coalesce(F.abs("z_dt") > threshold, F.lit(False))
    mech = F.coalesce(F.abs("z_rpm") > threshold, F.lit(False)) | F.coalesce(F.abs("z_tq") > threshold, F.lit(False))
    return a.withColumn("verdict", F.when(mech, "process").when(hot | F.col("law_broken"), "sensor").otherwise("ok"))


def injected(df: DataFrame, p: Process, channel: str, shift: float, window: Column) -> DataFrame:
    """One sensor reads wrong inside the window; everything derived from it follows."""
    moved = df.withColumn(channel, F.when(window, F.col(channel) + shift).otherwise(F.col(channel)))
    return p.judged(p.physics(moved))


def calibration_audit(df: DataFrame, control_limit: int = 3) -> DataFrame:
    """Rule against label: surprises mean a loose limit, false alarms a tight one."""
    a = df.agg(*[f for n in ("hdf", "pwf", "osf") for f in (F.count_if(~F.col(f"{n}_rule") & (F.col(n) == 1)).alias(f"{n}_s"), F.count_if(F.col(f"{n}_rule") & (F.col(n) == 0)).alias(f"{n}_f"), F.count_if(F.col(f"{n}_rule") & (F.col(n) == 1)).alias(f"{n}_h"))])
    rows = F.array(*[F.struct(F.lit(n.upper()).alias("rule"), F.col(f"{n}_h").alias("hits"), F.col(f"{n}_s").alias("surprises"), F.col(f"{n}_f").alias("false_alarms")) for n in ("hdf", "pwf", "osf")])
    s, f = F.col("surprises") > control_limit, F.col("false_alarms") > control_limit
    return a.select(F.explode(rows).alias("x")).select("x.*").withColumn("verdict", F.when(s & f, "conflicted").when(s, "loose").when(f, "tight").otherwise("calibrated"))


def calibration_sweep(df: DataFrame, p: Process, errors: tuple[float, ...] = (-0.1, -0.05, 0.0, 0.05, 0.1)) -> DataFrame:
    """The overstrain limit off by each error, audited in one pass."""
    limit = p.mode("OSF").terms[0].bound(F.col(p.variant))
    aggs = []
    for i, e in enumerate(errors):
        rule = F.col("overstrain_min_nm") > limit * (1 + e)
        aggs += [F.count_if(~rule & (F.col("osf") == 1)).alias(f"s{i}"), F.count_if(rule & (F.col("osf") == 0)).alias(f"f{i}")]
    rows = F.array(*[F.struct(F.lit(e).alias("error"), F.col(f"s{i}").alias("surprises"), F.col(f"f{i}").alias("false_alarms")) for i, e in enumerate(errors)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def threshold_bracket(df: DataFrame) -> DataFrame:
    """By variant: where the overstrain limit must lie, between the largest healthy and the smallest failing value."""
    x, y = F.col("overstrain_min_nm"), F.col("osf") == 1
    g = df.groupBy("product_type").agg(F.max(F.when(~y, x)).alias("max_healthy"), F.min(F.when(y, x)).alias("min_failing"), F.count_if(y).alias("support"))
    return g.withColumn("midpoint", (F.col("max_healthy") + F.col("min_failing")) / 2)


# fleet


def fleet(df: DataFrame, upto: Column | None = None) -> DataFrame:
    """Latest reading of every machine with its binding rule and state, worst first. One map-side combined aggregate."""
    names = ("hdf", "pwf", "osf")
    binding = F.array_min(F.array(*[F.struct(F.col(f"{n}_distance").alias("d"), F.lit(n.upper()).alias("rule")) for n in names]))["rule"]
    row = F.struct("udi", "product_type", "worst_margin", "tool_wear_min", "torque_nm", binding.alias("binding"))
    src = df.filter(upto) if upto is not None else df
    g = src.groupBy("machine_id").agg(F.max_by(row, "udi").alias("r"), F.count(F.lit(1)).alias("cycles"), F.sum("machine_failure").cast("bigint").alias("failures"))
    state = F.when(F.col("worst_margin") < 0, "critical").when(F.col("worst_margin") < 0.05, "watch").otherwise("normal")
    return g.select("machine_id", "r.*", "cycles", "failures").withColumn("state", state).orderBy("worst_margin", "machine_id")


def history(df: DataFrame, n: int = 20) -> DataFrame:
    """Last n margins of every machine, oldest first. Each task keeps n rows a machine (max-heap of structs), whatever the history."""
    top = df.select("machine_id", "udi", "worst_margin")
    # two levels: per slice of a machine's rows first, so a hot machine is spread
    slice_ = F.pmod(F.floor(F.col("udi") / 1000), F.lit(64))
    w1 = Window.partitionBy("machine_id", slice_).orderBy(F.desc("udi"))
    w2 = Window.partitionBy("machine_id").orderBy(F.desc("udi"))
    few = top.withColumn("k", F.row_number().over(w1)).filter(F.col("k") <= n).withColumn("k", F.row_number().over(w2)).filter(F.col("k") <= n)
    got = F.sort_array(F.collect_list(F.struct("udi", F.round("worst_margin", 6).alias("m"))))
    return few.groupBy("machine_id").agg(got.alias("h")).select("machine_id", F.transform("h", lambda s: s["m"]).alias("margins"), F.size("h").cast("bigint").alias("points"))


def conformal_correction(df: DataFrame, p: Process, *, share: float = 0.9, least: int = 5) -> float:
    """How many cycles the model still expects where the overstrain limit was crossed: the share's quantile over all such rows.

    The interval of remaining life is widened by it. Zero with fewer than least crossings, which calibrate nothing.
    """
    limit, rate = p.mode("OSF").terms[0].bound(F.col(p.variant)), p.by_variant(p.wear_rate)
    off = F.abs(limit - F.col("tool_wear_min") * F.col("torque_nm")) + 1
    crossed = df.filter((F.col("osf") == 1) & (F.col("torque_nm") > 0)).select((off / (rate * F.col("torque_nm"))).alias("cycles"))
    found, told = summary(crossed, {"cycles": F.col("cycles")}, (share,), discrete=True)
    return found["cycles"][0] if told["cycles"]["n"] >= least else 0.0


#: Fixed value: the deviation of torque that the remaining life is spread by.
SIGMA_TORQUE = 9.8


def remaining_life(df: DataFrame, p: Process, *, sigma: float = SIGMA_TORQUE, confidence: float = 0.9) -> DataFrame:
    """Cycles until each machine's overstrain margin is used up, with an interval widened by conformal_correction, worst first."""
    f = fleet(df)
    wider, q = conformal_correction(df, p), S.z(confidence)
    limit, rate = p.mode("OSF").terms[0].bound(F.col("product_type")), p.by_variant(p.wear_rate)
    margin = limit - F.col("tool_wear_min") * F.col("torque_nm")
    mu, sd = S.first_passage(margin, rate * F.col("torque_nm"), rate * sigma)
    gone = margin <= 0
    left = lambda c: F.when(gone, 0.0).otherwise(c)
    out = f.select("machine_id", margin.alias("margin"), left(mu).alias("cycles"), left(F.greatest(mu - q * sd - wider, F.lit(0.0))).alias("cycles_lo"), left(mu + q * sd + wider).alias("cycles_hi"), F.when(gone, "crossed").when(mu < 50, "imminent").otherwise("running").alias("status"))
    return out.orderBy("cycles", "machine_id")


def tool_lives(df: DataFrame) -> DataFrame:
    """machine_id, life, cycles, first and last udi, wear at the end: a machine's rows from one fall of its wear to the next.

    Falls are found against the row before in the machine's own order; machines are few and hot, so their rows are dealt by
    blocks of the key. A life that runs over a block's end is put together from its parts.
    """
    block = 10_000
    rows = df.select("machine_id", "udi", "tool_wear_min", F.floor(F.col("udi") / block).alias("block"))
    w = Window.partitionBy("machine_id", "block").orderBy("udi")
    rows = rows.withColumn("fell", F.coalesce(F.col("tool_wear_min") < F.lag("tool_wear_min").over(w), F.lit(False)).cast("int"))
    parts = rows.withColumn("k", F.sum("fell").over(w)).groupBy("machine_id", "block", "k").agg(F.count(F.lit(1)).alias("cycles"), F.min("udi").alias("first_udi"), F.max("udi").alias("last_udi"), F.min_by("tool_wear_min", "udi").alias("wear_first"), F.max_by("tool_wear_min", "udi").alias("wear_last"))
    order = Window.partitionBy("machine_id").orderBy("block", "k")
    new = F.coalesce((F.col("k") > 0) | (F.col("wear_first") < F.lag("wear_last").over(order)), F.lit(True))
    lives = parts.withColumn("new", new.cast("int")).withColumn("life", F.sum("new").over(order))
    return lives.groupBy("machine_id", "life").agg(F.sum("cycles").alias("cycles"), F.min("first_udi").alias("first_udi"), F.max("last_udi").alias("last_udi"), F.max_by("wear_last", "last_udi").alias("wear_end"))


def wear_trajectory(df: DataFrame, p: Process, horizon: int = 200) -> DataFrame:
    """Each machine's first cycle, from its latest reading, at which wear alone breaks the overstrain limit."""
    limit, rate = p.mode("OSF").terms[0].bound(F.col("product_type")), p.by_variant(p.wear_rate)
    f = fleet(df).withColumn("limit", limit).withColumn("rate", rate)
    s = f.select("machine_id", "limit", "rate", "tool_wear_min", "torque_nm", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("cycle"))
    s = s.withColumn("margin", F.col("limit") - (F.col("tool_wear_min") + F.col("cycle") * F.col("rate")) * F.col("torque_nm"))
    return s.groupBy("machine_id").agg(F.min(F.when(F.col("margin") <= 0, F.col("cycle"))).cast("bigint").alias("crossing_cycle"), F.min("margin").alias("last_margin"))


#: Cuts to a stretch.
STEP = 12


def ranked(counted: DataFrame, by: str, counts: tuple[str, ...], buckets: int = 128) -> DataFrame:
    """counted (by, x, counts...; one row per value) with running and total counts in the order of x, and the next x, by group.

    No task sorts a whole group: x falls into buckets between quantiles of a sketch of the group's values, so heavy tails fill no
    bucket; running sums are taken inside a bucket, and what lies before one comes from the small table of buckets.
    """
    # the cuts look at the counts too: without them the optimizer prunes these, and counts all rows once more for the cuts alone
    told = counted.filter(reduce(lambda a, c: a & c, [F.col(c) >= 0 for c in counts]))
    cuts = told.groupBy(by).agg(F.percentile_approx("x", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_cuts"))
    # every STEP-th cut tells the stretch, the cuts of the stretch the bucket
    coarse = reduce(lambda a, i: a + (F.element_at("_cuts", i) <= F.col("x")).cast("int"), range(STEP, buckets, STEP), F.lit(0)) * STEP
    b = coarse + F.size(F.filter(F.slice("_cuts", coarse + 1, F.lit(STEP)), lambda c: c <= F.col("x")))
    keyed = counted.join(cuts, by).withColumn("_b", b).drop("_cuts")
    per = keyed.groupBy(by, "_b").agg(*[F.sum(c).alias(c) for c in counts], F.min("x").alias("_first"))
    w, whole = Window.partitionBy(by).orderBy("_b"), Window.partitionBy(by)
    per = per.select(by, "_b", F.lead("_first").over(w).alias("_next"), *[(F.sum(c).over(w) - F.col(c)).alias(f"{c}_before") for c in counts], *[F.sum(c).over(whole).alias(f"{c}_all") for c in counts])
    inside = Window.partitionBy(by, "_b").orderBy("x")
    out = keyed.join(per, [by, "_b"])
    return out.select(by, "x", *counts, *[(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in counts], *[f"{c}_all" for c in counts], F.coalesce(F.lead("x").over(inside), F.col("_next")).alias("next"))


def counted_values(df: DataFrame, by: str, column: str) -> DataFrame:
    """Distinct values x of a column by group with their rows c; rows without a value (null or not a number) aren't counted."""
    return df.select(F.col(by), F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").groupBy(by, "x").agg(F.count(F.lit(1)).alias("c"))


def counted_pairs(df: DataFrame, metrics: tuple[str, ...], outcome: Column, *also: Column) -> DataFrame:
    """Distinct values x of each metric, with their rows n and those of the outcome k; rows without the metric's value, or an outcome, aren't counted."""
    values = F.array(*[F.col(m).cast("double") for m in metrics])
    rows = df.select(*also, outcome.cast("int").alias("_y"), F.posexplode(values).alias("_m", "x")).filter("x IS NOT NULL AND NOT isnan(x) AND _y IS NOT NULL")
    given = [c for c in rows.columns if c not in ("_y", "_m", "x")]
    # numbers of metrics until the rows are counted: their names would be hashed and compared for every row and metric
    counted = rows.groupBy(*given, "_m", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("k"))
    return counted.select(*given, F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("_m") + 1).alias("metric"), "x", "n", "k")


def conformal(df: DataFrame, column: str, by: str, alpha: float = 0.1) -> DataFrame:
    """Split-conformal interval by group: order statistics k and n + 1 - k of its values, exact by counting them map-side."""
    r = ranked(counted_values(df, by, column), by, ("c",)).withColumnsRenamed({"c_upto": "upto", "c_all": "n"})
    k = F.floor(F.lit(alpha) * (F.col("n") + 1) / 2)
    kk = F.greatest(k, F.lit(1))
    return r.groupBy(by).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") >= kk, F.col("x"))).alias("lo"), F.min(F.when(F.col("upto") >= F.col("n") + 1 - kk, F.col("x"))).alias("hi"), F.max(k >= 1).alias("valid"))


# alerts, outcomes, maintenance


def signals(df: DataFrame) -> DataFrame:
    """machine_id, at, mode (of an alert: a row within a twentieth of a limit; else null), failed: the rows that are an alert, a failure or both."""
    d = F.array_min(F.array(*[F.struct(F.col(f"{n}_distance").alias("d"), F.lit(n.upper()).alias("mode")) for n in ("hdf", "pwf", "osf")]))
    near = (F.col("worst_margin") >= 0) & (F.col("worst_margin") < 0.05)
    row = F.struct("machine_id", F.col("udi").alias("at"), F.when(near, d["mode"]).alias("mode"), (F.col("machine_failure") == 1).alias("failed"))
    # the margins are worked out once: a generator is no place to push a filter through
    return df.select(F.explode(F.filter(F.array(row), lambda r: r["mode"].isNotNull() | r["failed"])).alias("s")).select("s.*")


def matched(signals_: DataFrame, horizon: int = 600) -> DataFrame:
    """Each alert with the earliest failure of its machine within the horizon, if any: machine_id, at, mode, failed_at, lead.

    An interval join without a join: failures stand in their own bucket of the horizon, alerts in theirs and the next, and inside
    a bucket an alert looks ahead. One pass over the signals; a machine's history is spread over its buckets.
    """
    b = F.floor(F.col("at") / horizon)
    copy = lambda at, alert, fail: F.struct(at.alias("bucket"), alert.alias("mode"), fail.alias("failed_at"))
    none, when = F.lit(None), F.when(F.col("failed"), F.col("at"))
    copies = F.filter(F.array(copy(b, F.col("mode"), when), copy(b + 1, F.col("mode"), none.cast("bigint"))), lambda s: s["mode"].isNotNull() | s["failed_at"].isNotNull())
    s = signals_.select("machine_id", "at", F.explode(copies).alias("c")).select("machine_id", "at", "c.*")
    ahead = Window.partitionBy("machine_id", "bucket").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("next", F.min("failed_at").over(ahead)).filter("mode IS NOT NULL")
    out = s.groupBy("machine_id", "at", "mode").agg(F.min(F.when(F.col("next") <= F.col("at") + horizon, F.col("next"))).alias("failed_at"))
    return out.withColumn("lead", F.col("failed_at") - F.col("at"))


def scorecard(found: DataFrame, *, actionable: int = 5) -> DataFrame:
    """Precision, actionable precision and median lead by mode. Leads are whole cycles up to the horizon, so the exact median holds no more values than that."""
    g = found.groupBy("mode").agg(F.count(F.lit(1)).alias("alerts"), F.count("lead").alias("correct"), F.count_if(F.col("lead") >= actionable).alias("actionable"), F.count_if(F.col("lead") == 0).alias("lead_zero"), F.percentile("lead", F.lit(0.5)).alias("median_lead"))
    return g.withColumn("precision", F.col("correct") / F.col("alerts")).withColumn("actionable_precision", F.col("actionable") / F.col("alerts"))


def recall(signals_: DataFrame, found: DataFrame) -> DataFrame:
    """Share of failures that at least one alert foresaw; found is matched(signals_)."""
    hit = found.filter("failed_at IS NOT NULL").select("machine_id", F.col("failed_at").alias("at")).distinct().withColumn("seen", F.lit(1))
    j = signals_.filter("failed").select("machine_id", "at").join(hit, ["machine_id", "at"], "left")
    return j.agg(F.count(F.lit(1)).alias("failures"), F.count("seen").alias("foreseen")).withColumn("recall", F.try_divide(F.col("foreseen").cast("double"), F.col("failures")))


def work_orders(df: DataFrame) -> DataFrame:
    """Made-up but fixed work orders of the failures: raised, then closed for seven in ten. An append-only event log."""
    mode = F.when(F.col("hdf") == 1, "HDF").when(F.col("pwf") == 1, "PWF").when(F.col("osf") == 1, "OSF").when(F.col("twf") == 1, "TWF").otherwise("UNDETERMINED")
    base = df.filter("machine_failure = 1").select(F.col("udi").alias("wo"), "machine_id", "product_type", mode.alias("mode"))
    found = (F.col("wo") * 31) % 10 < 8
    raised = base.withColumn("seq", F.lit(0)).withColumn("status", F.lit("open")).withColumn("found_fault", F.lit(None).cast("boolean"))
    closed = base.filter((F.col("wo") * 17) % 10 < 7).withColumn("seq", F.lit(1)).withColumn("status", F.lit("closed")).withColumn("found_fault", found)
    return raised.unionByName(closed)


def latest(log: DataFrame) -> DataFrame:
    """Current row of every work order."""
    return log.groupBy("wo").agg(F.max_by(F.struct("machine_id", "product_type", "mode", "status", "found_fault"), "seq").alias("r")).select("wo", "r.*")


def newest_orders(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest work orders in their current state."""
    return latest(log).orderBy(F.desc("wo")).limit(limit)


def work_order_summary(log: DataFrame) -> DataFrame:
    g = latest(log).groupBy("mode").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("found_fault")).alias("confirmed"), F.count_if(~F.col("found_fault")).alias("false_alarms"))
    return g.withColumn("precision", F.try_divide(F.col("confirmed").cast("double"), F.col("confirmed") + F.col("false_alarms")))


def feedback(log: DataFrame, *, gain: float = 0.002, alarm: float = 0.10) -> DataFrame:
    """Weights by mode and variant: confirmed orders raise them, false alarms take half as much back; many false alarms are flagged."""
    g = latest(log).filter("status = 'closed'").groupBy("mode", "product_type").agg(F.count(F.lit(1)).alias("closed"), F.count_if("found_fault").alias("confirmed"))
    fp = (F.col("closed") - F.col("confirmed")) / F.col("closed")
    return g.select("mode", "product_type", "closed", "confirmed", (1 + gain * F.col("confirmed") - gain / 2 * (F.col("closed") - F.col("confirmed"))).alias("weight"), fp.alias("fp_rate"), ((fp > alarm) & (F.col("closed") >= 5)).alias("flagged")).orderBy(F.desc("fp_rate"), "mode", "product_type")


# discovery


def channel_profile(df: DataFrame, channels: tuple[str, ...], block: int = 10_000) -> DataFrame:
    """Mean, sd, range, share of repeats and of rises of every channel, and the split of its steps' variance into process and instrument.

    Steps d have Var(d) = q + 2 r and Cov(d, previous d) = -r for a random walk seen through noise; a covariance that isn't
    negative leaves all of it to the instrument.
    """
    one = with_previous(df.select("udi", *channels), "udi", channels, block=block)
    steps = one.withColumns({f"{c}_step": F.col(c) - F.col(f"{c}_prev") for c in channels})
    two = with_previous(steps, "udi", tuple(f"{c}_step" for c in channels), block=block)
    aggs = []
    for c in channels:
        d, before = F.col(f"{c}_step"), F.col(f"{c}_step_prev")
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg((F.col(c) == F.col(f"{c}_prev")).cast("double")).alias(f"{c}_repeat"), F.avg((F.col(c) >= F.col(f"{c}_prev")).cast("double")).alias(f"{c}_up"), F.var_pop(d).alias(f"{c}_g0"), F.covar_pop(d, before).alias(f"{c}_g1")]
    keys = ("mean", "sd", "min", "max", "repeat", "up")

    def row(c: str) -> Column:
        g0, g1 = F.col(f"{c}_g0"), F.col(f"{c}_g1")
        walk = g1 < 0
        process = F.sqrt(F.greatest(F.when(walk, g0 + 2 * g1).otherwise(0.0), F.lit(0.0)))
        return F.struct(F.lit(c).alias("channel"), *[F.col(f"{c}_{k}").alias(k) for k in keys], process.alias("process_sd"), F.sqrt(F.when(walk, -g1).otherwise(g0 / 2)).alias("instrument_sd"))

    return two.agg(*aggs).select(F.explode(F.array(*[row(c) for c in channels])).alias("s")).select("s.*").withColumn("counter", F.col("up") >= 0.95)


def leakage(df: DataFrame, columns: tuple[str, ...], outcome: str = "machine_failure") -> DataFrame:
    """Rare 0/1 columns that lie nearly inside the outcome give it away."""
    a = df.agg(F.count(F.lit(1)).alias("n"), *[f for c in columns for f in (F.count_if(F.col(c) == 1).alias(f"{c}_on"), F.count_if((F.col(c) == 1) & (F.col(outcome) == 1)).alias(f"{c}_in"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_on").alias("on"), F.col(f"{c}_in").alias("inside"), F.col("n")) for c in columns])
    r = a.select(F.explode(rows).alias("s")).select("s.*")
    share = F.try_divide(F.col("inside").cast("double"), F.col("on"))
    return r.select("column", "on", "inside", share.alias("share"), F.coalesce((F.col("on") * 2 <= F.col("n")) & (share >= 0.9), F.lit(False)).alias("leaks"))


def best_split(df: DataFrame, metrics: tuple[str, ...], outcome: str) -> DataFrame:
    """For every metric the threshold and side with the best F1 for the outcome, over all distinct values (exact).

    Distinct values are counted map-side; prefix sums run over counts, bucket by bucket. Rows without a metric's value fire at
    no threshold of it and aren't counted; a metric of fewer than two values has no row.
    """
    r = ranked(counted_pairs(df, metrics, F.col(outcome)), "metric", ("n", "k")).withColumnsRenamed({"n_upto": "n_lo", "k_upto": "k_lo"})
    f1 = lambda k, n: F.try_divide(2.0 * k, n + F.col("k_all"))
    r = r.filter("next IS NOT NULL").withColumn("cut", (F.col("x") + F.col("next")) / 2)
    sides = F.array(F.struct(f1(F.col("k_lo"), F.col("n_lo")).alias("f1"), F.lit("<").alias("side")), F.struct(f1(F.col("k_all") - F.col("k_lo"), F.col("n_all") - F.col("n_lo")).alias("f1"), F.lit(">").alias("side")))
    best = r.select("metric", "cut", F.array_max(sides).alias("b")).select("metric", "cut", "b.f1", "b.side")
    top = best.groupBy("metric").agg(F.max(F.struct("f1", (-F.col("cut")).alias("cut"), "side")).alias("b"))
    return top.select("metric", (-F.col("b.cut")).alias("cut"), "b.f1", "b.side")


#: Bytes of query vectors that go to every task in one pass over all vectors, and queries that are multiplied at once.
QUERY_BYTES, QUERY_BLOCK = 32 << 20, 512


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact cosine neighbours of a stated query set: query_id, vec_id, similarity, rank. Of equal similarities the smaller vec_id is nearer.

    A pass over the vectors serves query_bytes of queries: each task multiplies them, block by block, with its own vectors and
    keeps the k best of each query; the tasks' winners are merged by query. The queries are the only thing that is sent around,
    and their size is bounded; a larger set takes more passes, whose winners are disjoint.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    schema = "query_id bigint, vec_id bigint, similarity double"

    def unit(x) -> np.ndarray:
        v = np.stack(x).astype(np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def search(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows]), unit([r.embedding for r in rows])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best = np.full((len(ids), k), -np.inf)
            whose = np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                if not len(b):
                    continue
                v, own = unit(b["embedding"].to_numpy()), b["vec_id"].to_numpy()
                for at in range(0, len(ids), QUERY_BLOCK):
                    part = slice(at, at + QUERY_BLOCK)
                    s = q[part] @ v.T
                    s[ids[part][:, None] == own[None, :]] = -np.inf
                    floor = best[part][:, -1:]
                    hits = np.flatnonzero((s >= floor).any(axis=1) & np.isfinite(s).any(axis=1))
                    for i in hits:  # few once the best are known
                        near = np.flatnonzero((s[i] >= floor[i, 0]) & np.isfinite(s[i]))
                        sims, names = np.r_[best[at + i], s[i, near]], np.r_[whose[at + i], own[near]]
                        top = np.lexsort((names, -sims))[:k]
                        best[at + i], whose[at + i] = sims[top], names[top]
            there = np.isfinite(best)
            yield pd.DataFrame({"query_id": np.repeat(ids, k)[there.ravel()], "vec_id": whose[there], "similarity": best[there]})

        return vectors.select("vec_id", "embedding").mapInPandas(run, schema)

    parts, held, size = [], [], 0
    for r in queries.select("vec_id", "embedding").toLocalIterator():
        held.append(r)
        size += 8 * len(r.embedding)
        if size >= query_bytes:
            parts.append(search(held))
            held, size = [], 0
    if held:
        parts.append(search(held))
    if not parts:
        return spark.createDataFrame([], schema + ", rank bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
