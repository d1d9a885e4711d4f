"""Exact quantiles of many columns at once, with bounded state: a sketch brackets each, counts settle it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks are bracketed within this share of the rows, each side.
ACCURACY = 50_000


#: Distinct values up to which counting them all is less than bracketing: the state of one column's exact quantiles.
FEW_VALUES = 20_000


def _place(q: float, size: int, discrete: bool) -> tuple[float, tuple[int, int]]:
    place = math.ceil(q * size) - 1 if discrete else q * (size - 1)
    return place, (max(0, math.floor(place + 1e-9)), min(size - 1, math.ceil(place - 1e-9)))


def quantiles(df: DataFrame, values: dict[str, Column], at: tuple[float, ...], *, discrete: bool = False, accuracy: int = ACCURACY, few: int = FEW_VALUES) -> dict[str, list[float | None]]:
    """For each named column its quantiles at the shares, nulls left out; interpolated, or (discrete) the value at rank ceil(share n)."""
    return summary(df, values, at, discrete=discrete, accuracy=accuracy, few=few)[0]


def summary(df: DataFrame, values: dict[str, Column], at: tuple[float, ...], *, discrete: bool = False, accuracy: int = ACCURACY, few: int = FEW_VALUES) -> tuple[dict[str, list[float | None]], dict[str, dict]]:
    """(quantiles, {n, mean, sd, min, max}) of each named column, nulls left out.

    One aggregate takes the moments and sketches every column (state: accuracy, not rows): the number of distinct values, and a low and a
    high value around each quantile. Columns of few distinct values are then counted by value; for the others a second aggregate
    counts what lies below the low value, and the distinct values between the two, which are 4 / accuracy of the rows or a few heavy
    values, are counted. Only those counts are shuffled, and only the settled numbers come here.
    """
    if not values:
        return {}, {}
    grid = sorted({min(1.0, max(0.0, q + s / accuracy)) for q in at for s in (-2, 2)}) or [0.5]
    x = {n: v.cast("double") for n, v in values.items()}
    moments = lambda n, v: (F.count(v).alias(f"n_{n}"), F.avg(v).alias(f"mean_{n}"), F.stddev_samp(v).alias(f"sd_{n}"), F.min(v).alias(f"min_{n}"), F.max(v).alias(f"max_{n}"), F.approx_count_distinct(v, 0.01).alias(f"d_{n}"), F.percentile_approx(v, grid, accuracy).alias(f"p_{n}"))
    seen = df.agg(*[a for n, v in x.items() for a in moments(n, v)]).first()
    told = {n: {k: seen[f"{k}_{n}"] for k in ("n", "mean", "sd", "min", "max")} for n in x}
    out: dict[str, list[float | None]] = {n: [None] * len(at) for n in x}
    light = [n for n in x if seen[f"n_{n}"] and seen[f"d_{n}"] <= few]
    wanted = []  # (name, place in at, low, high, place, ranks)
    for n in x:
        if not seen[f"n_{n}"] or n in light:
            continue
        found = dict(zip(grid, seen[f"p_{n}"], strict=True))
        for k, q in enumerate(at):
            low, high = (found[min(1.0, max(0.0, q + s / accuracy))] for s in (-2, 2))
            wanted.append((n, k, low, high, *_place(q, seen[f"n_{n}"], discrete)))
    asked = [(n, k, *_place(q, seen[f"n_{n}"], discrete)) for n in light for k, q in enumerate(at)]
    if asked:
        kept = F.array(*[F.struct(F.lit(i).alias("i"), x[n].alias("x")) for i, n in enumerate(light)])
        counted = df.select(F.explode(kept).alias("s")).filter("s.x IS NOT NULL").groupBy("s.i", "s.x").agg(F.count(F.lit(1)).alias("c"))
        ranks = F.create_map(*[z for i, n in enumerate(light) for z in (F.lit(i), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e"), F.lit(r[e]).alias("r")) for m, k, _, r in asked if m == n for e in (0, 1)]))])
        upto = counted.withColumn("u", F.sum("c").over(Window.partitionBy("i").orderBy("x")))
        hits = upto.select("i", "x", F.explode(F.filter(F.element_at(ranks, F.col("i")), lambda r: (r["r"] < F.col("u")) & (r["r"] >= F.col("u") - F.col("c")))).alias("r"))
        got = {(r.i, r.k, r.e): r.x for r in hits.select("i", "x", "r.k", "r.e").collect()}
        for n, k, place, r in asked:
            a, b = (got[light.index(n), k, e] for e in (0, 1))
            out[n][k] = a + (b - a) * (place - r[0]) if r[1] > r[0] else a
    if not wanted:
        return out, told
    beside = df.agg(*[a for i, (n, _, low, high, _, _) in enumerate(wanted) for a in (F.count_if(x[n] < low).alias(f"b{i}"), F.max(F.when(x[n] < low, x[n])).alias(f"l{i}"), F.min(F.when(x[n] > high, x[n])).alias(f"h{i}"))]).first()
    inside = F.array(*[F.when((x[n] >= low) & (x[n] <= high), F.struct(F.lit(i).alias("i"), x[n].alias("x"))) for i, (n, _, low, high, _, _) in enumerate(wanted)])
    some = F.greatest(*[((x[n] >= low) & (x[n] <= high)).cast("int") for n, _, low, high, _, _ in wanted], F.lit(0)) > 0
    counted = df.filter(some).select(F.explode(F.filter(inside, lambda s: s.isNotNull())).alias("s")).groupBy("s.i", "s.x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("x"))
    rank = lambda e: F.element_at(F.array(*[F.lit(r[e] - beside[f"b{i}"]) for i, (_, _, _, _, _, r) in enumerate(wanted)]), F.col("i") + 1)
    settled = counted.withColumn("u", upto).groupBy("i").agg(*[F.min(F.when(F.col("u") > rank(e), F.col("x"))).alias(f"r{e}") for e in (0, 1)], F.max("u").alias("all"))
    got = {r.i: r for r in settled.collect()}
    for i, (n, k, _, _, place, ranks) in enumerate(wanted):
        ends = []
        for e in (0, 1):
            below = beside[f"b{i}"]
            ends.append(beside[f"l{i}"] if ranks[e] < below else beside[f"h{i}"] if ranks[e] >= below + got[i]["all"] else got[i][f"r{e}"])
        share = place - ranks[0]
        out[n][k] = ends[0] + (ends[1] - ends[0]) * share if ranks[1] > ranks[0] else ends[0]
    return out, told
