"""Rule induction, linear anomaly baseline, coverage of conformal intervals, audits of found against documented limits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import unit
from ..plans.process import RAD_PER_RPM, Process
from . import reliability as rel
from .physics import power_limits

#: Precision and new positives that a rule needs, and rounds at most.
PRECISION, POSITIVES, ROUNDS = 0.90, 15, 8


def _splits(df: DataFrame, metrics: tuple[str, ...], outcome: str) -> DataFrame:
    """Every cut of every metric with its precision and the positives it holds, either side."""
    r = rel.ranked(rel.counted_pairs(df, metrics, F.col(outcome)), "metric", ("n", "k")).filter("next IS NOT NULL")
    side = lambda k, n, s: F.struct(k.alias("k"), F.try_divide(k.cast("double"), n).alias("precision"), F.lit(s).alias("side"))
    both = F.array(side(F.col("k_upto"), F.col("n_upto"), "<"), side(F.col("k_all") - F.col("k_upto"), F.col("n_all") - F.col("n_upto"), ">"))
    return r.select("metric", ((F.col("x") + F.col("next")) / 2).alias("cut"), F.explode(both).alias("s")).select("metric", "cut", "s.*")


def induce(df: DataFrame, metrics: tuple[str, ...], outcome: str) -> DataFrame:
    """Separate and conquer: the precise cut with the most positives, again on the rows that it leaves, until none is left.

    One row per rule with its precision and cumulative coverage. Each round is one aggregate; a round brings one row here.
    """
    positives = df.agg(F.sum(outcome)).first()[0] or 0
    rest, found, rules = df, 0, []
    for i in range(ROUNDS):
        best = _splits(rest, metrics, outcome).filter((F.col("precision") >= PRECISION) & (F.col("k") >= POSITIVES)).orderBy(F.desc("k"), F.desc("precision"), "metric", "cut").limit(1).collect()
        if not best:
            break
        b = best[0]
        found += b.k
        rules.append((i + 1, b.metric, b.side, b.cut, b.precision, int(b.k), found / positives))
        inside = F.col(b.metric) < b.cut if b.side == "<" else F.col(b.metric) > b.cut
        rest = rest.filter(~F.coalesce(inside, F.lit(False)))  # a row without the metric's value is not inside
    return df.sparkSession.createDataFrame(rules, "rule long, metric string, side string, cut double, precision double, positives long, coverage double")


# conjunctions


@dataclass(frozen=True)
class Rule:
    """Terms (metric, op, value) that together mean a failure, with the evidence: rows, failures and healthy rows among them."""

    terms: tuple[tuple[str, str, float], ...]
    fires: int
    support: int
    grade: str

    @property
    def precision(self) -> float:
        return self.support / self.fires

    def __str__(self) -> str:
        return " AND ".join(f"{m} {op} {v:.6g}" for m, op, v in self.terms)


def simplified(terms: tuple[tuple[str, str, float], ...]) -> tuple[tuple[str, str, float], ...]:
    """The tightest bound of each metric and side."""
    best: dict[tuple[str, str], float] = {}
    for m, op, v in terms:
        old = best.get((m, op))
        best[m, op] = v if old is None else max(old, v) if op == ">" else min(old, v)
    return tuple((m, op, v) for (m, op), v in best.items())


def _meets(terms: tuple[tuple[str, str, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(m) <= v if op == "<=" else F.col(m) > v for m, op, v in terms], F.lit(True))


def grow(df: DataFrame, metrics: tuple[str, ...], target: Column, *, depth: int = 3, least: int = POSITIVES) -> list[tuple[tuple[tuple[str, str, float], ...], float, float]]:
    """Leaves (terms, weight of the target, weight of the rest) of a tree of threshold tests, both classes weighing the same.

    One aggregate a level, whatever the number of nodes: distinct values are counted map-side by node and metric, and the
    exact cut with the lowest weighted impurity is taken from their running counts. A row a node comes here. A row without a
    metric's value meets no test of it; one whose target is null is no target.
    """
    y = F.coalesce(target, F.lit(False)).cast("int")
    n, k = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    if not n or not k or n == k:
        return [((), float(k or 0), float((n or 0) - (k or 0)))]
    up, down = n / (2 * k), n / (2 * (n - k))
    done, open_ = [], [((), k * up, (n - k) * down)]
    for _ in range(depth):
        node = F.coalesce(*[F.when(_meets(t), F.lit(i)) for i, (t, _, _) in enumerate(open_)]) if open_ else None
        if node is None:
            break
        rows = df.withColumn("_node", node).filter("_node IS NOT NULL")
        counted = rel.counted_pairs(rows, metrics, y, F.col("_node")).select(F.struct(F.col("_node").alias("node"), "metric").alias("g"), "x", "n", "k")
        r = rel.ranked(counted, "g", ("n", "k")).filter(F.col("next").isNotNull() & (F.col("n_upto") >= least) & (F.col("n_all") - F.col("n_upto") >= least))
        left = (F.col("k_upto") * up, (F.col("n_upto") - F.col("k_upto")) * down)
        right = ((F.col("k_all") - F.col("k_upto")) * up, (F.col("n_all") - F.col("n_upto") - F.col("k_all") + F.col("k_upto")) * down)
        impure = lambda a, b: 2 * a * b / (a + b)
        cut = F.struct(F.round(impure(*left) + impure(*right), 9).alias("impurity"), F.col("g.metric").alias("metric"), ((F.col("x") + F.col("next")) / 2).alias("cut"), left[0].alias("lp"), left[1].alias("ln"), right[0].alias("rp"), right[1].alias("rn"))
        best = {b.node: b.c for b in r.groupBy(F.col("g.node").alias("node")).agg(F.min(cut).alias("c")).collect()}
        after = []
        for i, (terms, p, q) in enumerate(open_):
            c = best.get(i)
            if c is None or not p or not q or c.impurity >= 2 * p * q / (p + q) - 1e-9:
                done.append((terms, p, q))
                continue
            after += [((*terms, (c.metric, "<=", c.cut)), c.lp, c.ln), ((*terms, (c.metric, ">", c.cut)), c.rp, c.rn)]
        open_ = after
    return done + open_


def induce_paths(df: DataFrame, metrics: tuple[str, ...], outcome: str, *, depth: int = 3) -> tuple[list[Rule], float]:
    """(rules, share of all failures that they cover): conjunctions that are enough for a failure, by separate and conquer.

    A tree is grown on the failures that no rule explains yet; its leaves are held against the true label, and those with
    PRECISION and POSITIVES new failures are rules. What they explain is taken out, and the next tree finds the next mode.
    A rule without a false alarm is verified, any other a candidate.
    """
    df = df.select(*metrics, outcome).persist()  # a pass a level of each tree; a lost part is worked out again
    try:
        return _induced(df, metrics, outcome, depth)
    finally:
        df.unpersist()


def _induced(df: DataFrame, metrics: tuple[str, ...], outcome: str, depth: int) -> tuple[list[Rule], float]:
    y, rules, covered = F.coalesce(F.col(outcome) == 1, F.lit(False)), [], F.lit(False)
    for _ in range(ROUNDS):
        left = y & ~covered
        leaves = [simplified(t) for t, p, q in grow(df, metrics, left, depth=depth) if t and p > q]
        if not leaves:
            break
        hits = [_meets(t) for t in leaves]
        one = df.agg(*[a for i, h in enumerate(hits) for a in (F.count_if(h).alias(f"f{i}"), F.count_if(h & y).alias(f"s{i}"), F.count_if(h & left).alias(f"n{i}"))]).first()
        found = [Rule(t, one[f"f{i}"], one[f"s{i}"], "verified" if one[f"f{i}"] == one[f"s{i}"] else "candidate") for i, t in enumerate(leaves) if one[f"f{i}"] and one[f"s{i}"] >= PRECISION * one[f"f{i}"] and one[f"n{i}"] >= POSITIVES]
        if not found:
            break
        rules += found
        covered = F.coalesce(reduce(lambda a, b: a | b, [_meets(r.terms) for r in rules]), F.lit(False))
    share = df.agg(F.try_divide(F.count_if(covered & y).cast("double"), F.count_if(y))).first()[0]
    return sorted(rules, key=lambda r: (-r.support, -r.precision, str(r))), share or 0.0


def rule_table(df: DataFrame, rules: list[Rule], coverage: float) -> DataFrame:
    rows = [(i + 1, str(r), len(r.terms), r.fires, r.support, r.precision, r.grade, coverage) for i, r in enumerate(rules)]
    return df.sparkSession.createDataFrame(rows, "rule long, terms string, n_terms long, fires long, support long, precision double, grade string, coverage double")


def tree_f1(df: DataFrame, metrics: tuple[str, ...], outcome: str, depth: int = 3) -> float:
    """F1 in sample of one tree that calls a failure where failures weigh more."""
    y = F.col(outcome) == 1
    hit = reduce(lambda a, b: a | b, [_meets(t) for t, p, q in grow(df, metrics, y, depth=depth) if p > q], F.lit(False))
    k, n, s = df.agg(F.count_if(hit & y), F.count_if(hit), F.count_if(y)).first()
    return 2.0 * k / (n + s) if n + s else 0.0


def constructed(units: dict[str, str], counters: tuple[str, ...]) -> dict[str, Column]:
    """Quantities that the channels' units ask for: differences of temperatures, torque times angular speed, a counter of time times torque."""
    of = lambda u: [c for c, x in units.items() if unit(x) == unit(u)]
    heat, out = of("K") + of("°C"), {}
    for i, a in enumerate(heat):
        for b in heat[i + 1 :]:
            out[f"{b}_minus_{a}"] = F.col(b) - F.col(a)
    for t in of("N·m"):
        for s in of("rpm"):
            out[f"power_from_{t}_{s}"] = F.col(t) * F.col(s) * F.lit(RAD_PER_RPM)
        for m in of("min"):
            if m in counters:
                out[f"{m}_x_{t}"] = F.col(m) * F.col(t)
    return out


def one_hot(df: DataFrame, columns: tuple[str, ...], most: int = 12) -> dict[str, Column]:
    """A 0/1 column for each level of the columns that have two to most levels."""
    few = _few(df, columns, most)
    seen = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first() if few else None
    return {f"{c}_is_{v}": (F.col(c) == v).cast("double") for c in few for v in seen[c]}


def _few(df: DataFrame, columns: tuple[str, ...], most: int) -> list[str]:
    """The columns of two to most levels, by counts that no task has to hold the levels for."""
    n = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if n[c] <= 2 * most and 2 <= df.select(c).dropna().distinct().limit(most + 1).count() <= most]


def as_yaml(rules: list[Rule], variant: str, wear_rate: dict[str, float]) -> str:
    """Rules as a process definition that from_yaml reads: a mode a rule, for an engineer to confirm, tighten or delete."""
    import yaml

    modes = [{"name": f"RULE{i + 1}", "how": "all_of", "terms": [{"metric": m, "op": op, "limit": float(v)} for m, op, v in r.terms]} for i, r in enumerate(rules)]
    return yaml.safe_dump({"variant": variant, "wear_rate": wear_rate, "modes": modes}, sort_keys=False)


def audit(splits: DataFrame, documented: dict[str, float]) -> DataFrame:
    """Found cuts beside the nearest documented limit of the same metric; verified within ten percent."""
    docs = F.create_map(*[x for k, v in documented.items() for x in (F.lit(k), F.lit(float(v)))])
    known = F.try_element_at(docs, F.col("metric"))
    err = F.abs(F.col("cut") - known) / F.abs(known)
    return splits.select("metric", "cut", "f1", known.alias("documented"), err.alias("error"), F.coalesce(err < 0.10, F.lit(False)).alias("verified"))


def linear_baseline(df: DataFrame, channels: tuple[str, ...], components: int = 3) -> Column:
    """Reconstruction error of each row under its leading principal components, as a column.

    The covariance is one aggregate; its few eigenvectors are settled on the driver and put into the expression.
    """
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(channels)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(channels)], *[F.covar_pop(channels[i], channels[j]).alias(f"c{i}_{j}") for i in range(len(channels)) for j in range(i + 1)]).first()
    n = len(channels)
    m, s = [one[f"m{i}"] for i in range(n)], np.array([one[f"s{i}"] or 1.0 for i in range(n)])
    cov = np.array([[one[f"c{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]) / np.outer(s, s)
    v = np.linalg.eigh(cov)[1][:, ::-1][:, components:]  # what the components leave out
    z = [(F.col(c) - m[i]) / float(s[i]) for i, c in enumerate(channels)]
    left = [reduce(lambda a, b: a + b, [zi * float(v[i, k]) for i, zi in enumerate(z)]) for k in range(v.shape[1])]
    return reduce(lambda a, b: a + b, [x * x for x in left])


def anomalies(df: DataFrame, channels: tuple[str, ...], healthy: Column, false_rate: float = 1e-3) -> DataFrame:
    """Threshold at the healthy rows' quantile, and how many rows of each kind pass it."""
    e = df.withColumn("error", linear_baseline(df.filter(healthy), channels)).withColumn("healthy", healthy)
    cut = e.filter("healthy").agg(F.percentile_approx("error", 1 - false_rate, 100_000)).first()[0]
    g = e.groupBy("healthy").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") > cut).alias("flagged"))
    return g.withColumn("share", F.col("flagged") / F.col("n"))


def leave_one_out(df: DataFrame, column: str, by: str, alpha: float = 0.1) -> DataFrame:
    """Share of rows inside the conformal interval of all other rows of their group, from order statistics alone.

    Without the row itself the interval runs from the k-th to the (n-k)-th of the others; a row at either end moves that end
    one place inward.
    """
    r = rel.ranked(rel.counted_values(df, by, column), by, ("c",)).withColumn("k", F.floor(F.lit(alpha) * F.col("c_all") / 2))
    below, upto, n, k = F.col("c_upto") - F.col("c"), F.col("c_upto"), F.col("c_all"), F.col("k")
    # of ties some row is always inside, so a value is outside only when all its places are
    outside = F.when(k < 1, F.lit(False)).otherwise((upto <= k) | (below >= n - k))
    return r.groupBy(by).agg(F.max("c_all").alias("n"), (F.sum(F.when(~outside, F.col("c")).otherwise(0)) / F.sum("c")).alias("coverage"))


def envelope_projection(df: DataFrame, p: Process, horizon: int = 200, step: int = 5) -> DataFrame:
    """Each machine's safe torque band over its future wear: width now, the cycle at which it closes or its ceiling turns."""
    limit = p.mode("OSF").terms[0].bound(F.col("product_type"))
    rate = F.element_at(F.create_map(*[x for k, v in p.wear_rate.items() for x in (F.lit(k), F.lit(v))]), F.col("product_type"))
    now = df.groupBy("machine_id").agg(F.max_by(F.struct("product_type", "tool_wear_min", "rotational_speed_rpm"), "udi").alias("r")).select("machine_id", "r.*")
    s = now.withColumn("limit", limit).withColumn("rate", rate).withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(step))))
    w, (low, high) = F.col("rotational_speed_rpm") * F.lit(RAD_PER_RPM), power_limits(p)
    wear = F.col("tool_wear_min") + F.col("cycle") * F.col("rate")
    strain = F.coalesce(F.try_divide(F.col("limit"), wear), F.lit(1e308))
    s = s.select("machine_id", "cycle", (low / w).alias("lo"), F.least(high / w, strain).alias("hi"), (strain < high / w).alias("by_strain"))
    g = s.groupBy("machine_id").agg(F.max(F.when(F.col("cycle") == 0, F.col("hi") - F.col("lo"))).alias("width_now"), F.max(F.when(F.col("cycle") == horizon, F.col("hi") - F.col("lo"))).alias("width_then"), F.min(F.when(F.col("hi") < F.col("lo"), F.col("cycle"))).cast("bigint").alias("closes_at"), F.min(F.when(F.col("by_strain"), F.col("cycle"))).cast("bigint").alias("strain_binds_at"))
    return g.withColumn("shrink", 100.0 * (1 - F.greatest(F.col("width_then"), F.lit(0.0)) / F.col("width_now")))
