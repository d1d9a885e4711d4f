"""Rules over the process: causes, what-if shifts, safe envelopes, first-passage forecasts, interval verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..plans.process import RAD_PER_RPM, Process

#: Tool-wear failures seen among the cycles in the window, and the conditions taken where nothing was observed.
WEAROUT_SEEN = (43, 790)
NOMINAL = {"air_temperature_k": 300.0, "process_temperature_k": 310.0, "rotational_speed_rpm": 1500.0, "torque_nm": 40.0, "tool_wear_min": 0.0}


def power_limits(p: Process) -> tuple[float, float]:
    return float(p.limit("PWF", "power_w", "<")), float(p.limit("PWF", "power_w", ">"))


def heat_limits(p: Process) -> tuple[float, float]:
    """(temperature difference, speed) under which heat isn't carried off."""
    return float(p.limit("HDF", "temp_delta_k")), float(p.limit("HDF", "rotational_speed_rpm"))


def _certain(p: Process) -> list[str]:
    return [m.name.lower() for m in p.modes if m.terms and not m.stochastic]


def root_causes(df: DataFrame, p: Process) -> DataFrame:
    """Every row's verdict: the modes that fired, an undetermined cause, or the closest rule of a healthy row."""
    names = _certain(p)
    fired = F.filter(F.array(*[F.when(F.col(f"{n}_rule"), F.lit(n.upper())) for n in names], F.when(F.col("twf") == 1, F.lit("TWF"))), lambda x: x.isNotNull())
    nearest = F.array_min(F.array(*[F.struct(F.col(f"{n}_distance").alias("d"), F.lit(n.upper()).alias("rule")) for n in names]))
    verdict = F.when(F.size(fired) > 0, F.array_join(fired, " + ")).when(F.col("machine_failure") == 1, "cause_undetermined").otherwise("healthy")
    rate, torque = p.by_variant(p.wear_rate), F.col("torque_nm")
    limit = p.mode("OSF").terms[0].bound(F.col(p.variant))
    return df.select("udi", "product_type", "machine_failure", verdict.alias("verdict"), F.size(fired).cast("bigint").alias("mode_count"), nearest["rule"].alias("closest_rule"), nearest["d"].alias("closest_distance"), F.try_divide(limit, torque).alias("osf_crossing_wear"), F.greatest(F.col("tool_wear_min") - F.try_divide(limit, torque), F.lit(0.0)).alias("osf_exceeded_by"), F.col("twf_rule").alias("twf_in_window"), F.when(F.col("twf_rule"), WEAROUT_SEEN[0] / WEAROUT_SEEN[1]).otherwise(0.0).alias("twf_probability"), ((F.col("rnf") == 1) & (F.col("machine_failure") == 0)).alias("rnf_not_rolled_up"), rate.alias("wear_rate"))


def root_cause_summary(df: DataFrame, p: Process) -> DataFrame:
    """Counts by mode of the failures of a cohort, in one pass."""
    names = _certain(p)
    any_rule = reduce(lambda a, b: a | b, [F.col(f"{n}_rule") for n in names])
    many = reduce(lambda a, b: a + b, [F.col(f"{n}_rule").cast("int") for n in names]) + F.col("twf")
    fail = F.col("machine_failure") == 1
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("machine_failure").cast("bigint").alias("failures"), *[F.count_if(F.col(f"{n}_rule")).alias(n) for n in names], F.sum("twf").cast("bigint").alias("twf"), F.sum("rnf").cast("bigint").alias("rnf"), F.count_if(fail & ~any_rule & (F.col("twf") == 0)).alias("orphans"), F.count_if(many > 1).alias("multi_mode"), F.count_if(any_rule).alias("explained"))
    top = F.array_max(F.array(*[F.struct(F.col(n).alias("c"), F.lit(-i).alias("o"), F.lit(n.upper()).alias("mode")) for i, n in enumerate([*names, "twf"])]))
    return one.withColumn("dominant", top["mode"]).withColumn("explained_share", 100.0 * F.try_divide(F.col("explained").cast("double"), F.col("failures")))


def counterfactual(df: DataFrame, p: Process, **shift: float) -> DataFrame:
    """Rule firings before and after a shift of base channels, rescued and newly failing rows, and the mean margins' moves."""
    names = _certain(p)
    before = df.select(*[F.col(f"{n}_rule").alias(f"b_{n}") for n in names], *[F.col(c).alias(f"b_{c}") for c in ("pwf_margin_0", "pwf_margin_1", "osf_margin")], p.variant, *p.base)
    both = p.perturbed(before, **shift)
    was = reduce(lambda a, b: a | b, [F.col(f"b_{n}") for n in names])
    now = reduce(lambda a, b: a | b, [F.col(f"{n}_rule") for n in names])
    aggs = [F.count(F.lit(1)).alias("n")]
    for n in names:
        aggs += [F.count_if(f"b_{n}").alias(f"before_{n}"), F.count_if(f"{n}_rule").alias(f"after_{n}")]
    aggs += [F.count_if(was).alias("before_any"), F.count_if(now).alias("after_any"), F.count_if(was & ~now).alias("rescued"), F.count_if(~was & now).alias("newly_failing")]
    aggs += [F.avg(F.col(c) - F.col(f"b_{c}")).alias(f"shift_{c}") for c in ("pwf_margin_0", "pwf_margin_1", "osf_margin")]
    out = both.agg(*aggs)
    return out.withColumn("verdict", F.when(F.col("after_any") < F.col("before_any"), "helps").when(F.col("after_any") > F.col("before_any"), "harms").otherwise("no change"))


def torque_band(p: Process, rpm: Column, wear: Column, limit: Column) -> tuple[Column, Column]:
    """Torques that keep power and overstrain safe at a speed; null where there is none."""
    w, (low, high) = rpm * F.lit(RAD_PER_RPM), power_limits(p)
    lo = F.try_divide(F.lit(low), w)
    hi = F.least(F.try_divide(F.lit(high), w), F.coalesce(F.try_divide(limit, wear), F.lit(1e308)))
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def envelope_points(df: DataFrame, p: Process) -> DataFrame:
    """Each row's safe torque band, what bounds it, and the slowest speed that heat allows."""
    limit = p.mode("OSF").terms[0].bound(F.col(p.variant))
    lo, hi = torque_band(p, F.col("rotational_speed_rpm"), F.col("tool_wear_min"), limit)
    delta, slowest = heat_limits(p)
    power_hi = F.lit(power_limits(p)[1]) / (F.col("rotational_speed_rpm") * F.lit(RAD_PER_RPM))
    binding = F.when(lo.isNull(), "infeasible").when(F.coalesce(F.try_divide(limit, F.col("tool_wear_min")), F.lit(1e308)) < power_hi, "overstrain").otherwise("power")
    return df.select("udi", lo.alias("torque_min"), hi.alias("torque_max"), (hi - lo).alias("torque_width"), binding.alias("binding_ceiling"), F.coalesce((F.col("torque_nm") >= lo) & (F.col("torque_nm") <= hi), F.lit(False)).alias("inside"), F.when(F.col("temp_delta_k") < delta, slowest).alias("min_safe_speed"))


def envelope_curve(df: DataFrame, p: Process, points: int = 12, lo: float = 1200.0, hi: float = 2800.0) -> DataFrame:
    """The band at evenly spaced speeds, by variant, at the variant's mean wear."""
    at = df.groupBy(p.variant).agg(F.avg("tool_wear_min").alias("wear"))
    speeds = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * F.lit((hi - lo) / (points - 1)))
    c = at.select(p.variant, "wear", F.explode(speeds).alias("rpm"))
    a, b = torque_band(p, F.col("rpm"), F.col("wear"), p.mode("OSF").terms[0].bound(F.col(p.variant)))
    return c.select(p.variant, "rpm", a.alias("torque_min"), b.alias("torque_max"))


def envelope_fix(df: DataFrame, p: Process, safety: float = 0.02) -> DataFrame:
    """For each row that breaks a rule, the smallest verified change of one channel that clears every rule, with a safety factor."""
    names = _certain(p)
    broken = reduce(lambda a, b: a | b, [F.col(f"{n}_rule") for n in names])
    limit = p.mode("OSF").terms[0].bound(F.col(p.variant))
    w = F.col("rotational_speed_rpm") * F.lit(RAD_PER_RPM)
    up, down = 1 + safety, 1 - safety
    (low, high), (delta, slowest) = power_limits(p), heat_limits(p)
    torque, rpm, wear = F.col("torque_nm"), F.col("rotational_speed_rpm"), F.col("tool_wear_min")
    wanted = [("torque_nm", low * up / w), ("torque_nm", high * down / w), ("torque_nm", F.try_divide(limit * down, wear)), ("rotational_speed_rpm", F.lit(slowest * up)), ("rotational_speed_rpm", F.try_divide(F.lit(low * up / RAD_PER_RPM), torque)), ("rotational_speed_rpm", F.try_divide(F.lit(high * down / RAD_PER_RPM), torque)), ("tool_wear_min", F.try_divide(limit * down, torque))]

    def clear(t: Column, r: Column, x: Column) -> Column:
        power = t * r * F.lit(RAD_PER_RPM)
        return ~((F.col("temp_delta_k") < delta) & (r < slowest)) & (power >= low) & (power <= high) & (x * t <= limit)

    options = []
    for name, value in wanted:
        now = {"torque_nm": torque, "rotational_speed_rpm": rpm, "tool_wear_min": wear}
        old = now[name]
        now[name] = value
        ok = clear(now["torque_nm"], now["rotational_speed_rpm"], now["tool_wear_min"]) & (value >= 0)
        if name == "tool_wear_min":
            ok = ok & (value < old)  # wear only goes back by a change of tool
        options.append(F.when(F.coalesce(ok, F.lit(False)), F.struct(F.abs(value / old - 1).alias("size"), F.lit(name).alias("variable"), (value - old).alias("delta"), value.alias("new_value"))))
    best = F.array_min(F.filter(F.array(*options), lambda s: s.isNotNull()))
    return df.filter(broken).select("udi", best["variable"].alias("variable"), best["delta"].alias("delta"), best["new_value"].alias("new_value"), best.isNotNull().alias("available"))


def operating_point(df: DataFrame, p: Process, given: dict[str, float | str] | None = None) -> DataFrame:
    """One row: the point that a question is about. What is given counts; the rest is the mean of the rows of df, or nominal where there are none.

    An air temperature without a process temperature keeps the observed difference of the two. An unknown variant counts as
    the one with the lowest overstrain limit. Without rows and without anything given there is no point, and no row.
    """
    given = dict(given or {})
    if bad := [k for k in given if k not in (*p.base, p.variant)]:
        raise ValueError(f"not a base channel: {bad[0]}")
    limits = p.limit("OSF", "overstrain_min_nm")
    strictest = min(limits, key=limits.get)
    one = df.agg(*[F.avg(c).alias(c) for c in p.base], F.min(p.variant).alias(p.variant), F.count(F.lit(1)).alias("matched"))
    one = one.withColumns({c: F.coalesce(F.col(c), F.lit(NOMINAL[c])) for c in p.base}).withColumn(p.variant, F.coalesce(p.variant, F.lit(strictest)))
    told = {c: F.lit(float(given[c])) for c in p.base if c in given}
    if "air_temperature_k" in told and "process_temperature_k" not in told:
        told["process_temperature_k"] = told["air_temperature_k"] + (F.col("process_temperature_k") - F.col("air_temperature_k"))
    if p.variant in given:
        name = str(given[p.variant]).upper()
        told[p.variant] = F.lit(name if name in limits else strictest)
    assumed = [c for c in p.base if c not in given]
    point = one.withColumns(told) if told else one
    point = point.withColumn("assumed", F.array(*[F.lit(c) for c in assumed]).cast("array<string>"))
    return point if given else point.filter("matched > 0")


def envelope_at(df: DataFrame, p: Process, given: dict[str, float | str] | None = None) -> DataFrame:
    """The safe torque band, its ceiling's cause, and the rules at an operating point."""
    point = p.judged(p.physics(operating_point(df, p, given)))
    lo, hi = torque_band(p, F.col("rotational_speed_rpm"), F.col("tool_wear_min"), p.mode("OSF").terms[0].bound(F.col(p.variant)))
    strain = F.coalesce(F.try_divide(p.mode("OSF").terms[0].bound(F.col(p.variant)), F.col("tool_wear_min")), F.lit(1e308))
    ceiling = F.lit(power_limits(p)[1]) / (F.col("rotational_speed_rpm") * F.lit(RAD_PER_RPM))
    safe = ~reduce(lambda a, b: a | b, [F.col(f"{n}_rule") for n in _certain(p)])
    return point.select(p.variant, *p.base, "matched", F.array_join("assumed", ",").alias("assumed"), lo.alias("torque_min"), hi.alias("torque_max"), F.when(lo.isNull(), "infeasible").when(strain < ceiling, "overstrain").otherwise("power").alias("binding_ceiling"), safe.alias("safe"), "worst_margin")


def forecast_overstrain(df: DataFrame, p: Process, *, cycle_s: float = 120.0, confidence: float = 0.95) -> DataFrame:
    """By variant: cycles until mean wear and torque cross the overstrain limit (inverse-Gaussian first passage)."""
    g = df.groupBy(p.variant).agg(F.avg("tool_wear_min").alias("wear"), F.avg("torque_nm").alias("torque"), F.stddev_samp("torque_nm").alias("sigma"))
    rate = p.by_variant(p.wear_rate)
    limit = p.mode("OSF").terms[0].bound(F.col(p.variant))
    margin = limit - F.col("wear") * F.col("torque")
    mu, sd = S.first_passage(margin, rate * F.col("torque"), rate * F.coalesce("sigma", F.lit(10.0)))
    q = S.z(confidence)
    return g.select(p.variant, margin.alias("margin"), mu.alias("cycles"), F.greatest(mu - q * sd, F.lit(0.0)).alias("cycles_lo"), (mu + q * sd).alias("cycles_hi"), (mu * cycle_s / 60.0).alias("lead_min"), F.try_divide(limit, F.col("torque")).alias("crossing_wear"), F.when(margin <= 0, "exceeded").when(mu < 10, "critical").otherwise("running").alias("status"))


def hazard_bands(df: DataFrame, width: float = 10.0, low: float = 180.0, high: float = 260.0) -> DataFrame:
    """Wear-out rate by band of tool wear from low up to high, with Wilson intervals and a fit that never falls with wear (pooled on the driver over the few bands)."""
    band = (F.floor(F.col("tool_wear_min") / width) * width).alias("band_lo")
    g = df.filter((F.col("tool_wear_min") >= low) & (F.col("tool_wear_min") < high)).groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.sum("twf").cast("bigint").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    g = g.select(F.col("band_lo").cast("double").alias("band_lo"), "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("ci_lo"), hi.alias("ci_hi"))
    rows = g.orderBy("band_lo").collect()  # a row per band of a fixed window
    fit = S.isotonic([r.rate for r in rows], [r.n for r in rows])
    table = [(*r, float(f)) for r, f in zip(rows, fit, strict=True)]
    return df.sparkSession.createDataFrame(table, "band_lo double, n bigint, k bigint, rate double, ci_lo double, ci_hi double, hazard double")


def forecast_wearout(points: DataFrame, p: Process, bands: DataFrame, width: float = 10.0) -> DataFrame:
    """points (variant, tool_wear_min, ...) with the outlook on wear-out, which is a chance and never a crossing.

    Before the window: cycles until it. Inside: the fitted hazard of the point's band (the documented rate where no band was
    seen), its interval, the cycles left and the chance that one of them fails. Past it: only that.
    """
    start, end = map(float, p.limit("TWF", "tool_wear_min"))
    wear, rate = F.col("tool_wear_min"), p.by_variant(p.wear_rate)
    b = bands.select("band_lo", "hazard", "ci_lo", "ci_hi", F.col("n").alias("seen"))
    j = points.withColumn("band_lo", (F.floor(wear / width) * width).cast("double")).join(F.broadcast(b), "band_lo", "left")  # a row per band of a fixed window
    inside = (wear >= start) & (wear < end)
    chance = F.coalesce("hazard", F.lit(WEAROUT_SEEN[0] / WEAROUT_SEEN[1]))
    left = (end - wear) / rate
    only = lambda c: F.when(inside, c)
    out = {
        "status": F.when(wear >= end, "past").when(inside, "inside").otherwise("before"),
        "cycles_to_window": F.when(wear < start, (start - wear) / rate), "wear_to_window": F.when(wear < start, start - wear),
        "cycles_left": only(left), "per_cycle": only(chance), "per_cycle_lo": only(F.col("ci_lo")), "per_cycle_hi": only(F.col("ci_hi")),
        "band_n": only(F.col("seen")), "cumulative": only(1 - F.pow(1 - chance, left)),
    }
    return j.select(*[F.col(c) for c in points.columns], *[c.alias(n) for n, c in out.items()])


def hazard_at(df: DataFrame, bands: DataFrame, width: float = 10.0) -> DataFrame:
    """Each row's hazard: an equi-join on the computed band, not a range join; a few bands are broadcast."""
    b = F.broadcast(bands.select("band_lo", "hazard"))
    return df.withColumn("band_lo", (F.floor(F.col("tool_wear_min") / width) * width).cast("double")).join(b, "band_lo", "left")


#: Half-widths of the declared sensor accuracies.
ACCURACY = {"air_temperature_k": 0.5, "process_temperature_k": 0.5, "rotational_speed_rpm": 1.0, "torque_nm": 0.25, "tool_wear_min": 0.5}


def interval_verdicts(df: DataFrame, p: Process, accuracy: dict[str, float] | None = None) -> DataFrame:
    """Three-state verdicts when each channel is only known within its accuracy: alert, safe, or abstain."""
    acc = accuracy or ACCURACY
    lo = {c: F.col(c) - acc[c] for c in p.base}
    hi = {c: F.col(c) + acc[c] for c in p.base}
    limit = p.mode("OSF").terms[0].bound(F.col(p.variant))
    (low, high), (delta, slowest) = power_limits(p), heat_limits(p)
    dt = (lo["process_temperature_k"] - hi["air_temperature_k"] - delta, hi["process_temperature_k"] - lo["air_temperature_k"] - delta)
    sp = (lo["rotational_speed_rpm"] - slowest, hi["rotational_speed_rpm"] - slowest)
    k = F.lit(RAD_PER_RPM)
    power = (lo["torque_nm"] * lo["rotational_speed_rpm"] * k, hi["torque_nm"] * hi["rotational_speed_rpm"] * k)
    p_lo, p_hi = (power[0] - low, power[1] - low), (high - power[1], high - power[0])
    strain = (limit - hi["torque_nm"] * hi["tool_wear_min"], limit - F.greatest(lo["torque_nm"], F.lit(0.0)) * F.greatest(lo["tool_wear_min"], F.lit(0.0)))
    neg = lambda m: m[1] < 0
    pos = lambda m: m[0] >= 0
    both = F.when(neg(dt) & neg(sp), "alert").when(pos(dt) | pos(sp), "safe").otherwise("abstain")
    either = F.when(neg(p_lo) | neg(p_hi), "alert").when(pos(p_lo) & pos(p_hi), "safe").otherwise("abstain")
    one = F.when(neg(strain), "alert").when(pos(strain), "safe").otherwise("abstain")
    v = df.select("udi", both.alias("hdf"), either.alias("pwf"), one.alias("osf"))
    has = lambda s: (F.col("hdf") == s) | (F.col("pwf") == s) | (F.col("osf") == s)
    return v.withColumn("verdict", F.when(has("alert"), "alert").when(has("abstain"), "abstain").otherwise("safe"))
