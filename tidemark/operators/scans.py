"""Recursions along a machine's history as block scans, so that one machine's rows are many tasks' work.

Each recursion is a composition of maps of one small family, and so of their summaries by block:

* CUSUM, c = max(0, c + u - k): the maps x -> max(a, x + b), closed under composition (max-plus); a block's b is its sum, its
  a the sum's rise over its lowest running value.
* The settled filter, x = g x + (1 - g) z: affine maps x -> A x + B; blocks are as long as makes A smaller than a
  rounding error, so a block starts from the B of a few blocks before.
* Runs of a condition: a row's run starts behind the last row without it, which a block has or hands on.

Rows are numbered first (counts by block of the key, then places inside a block), so that blocks have a stated number of rows
whatever the keys are. Windows order the rows of a block, or one row a block of a machine; never a machine's rows.

Defined results: a null or non-finite value is no step (u = k, z unchanged level, condition false); rows without a machine are one
more machine; ties of the order are broken by the row's hash; repeated rows are rows each; an empty table stays one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096
#: A block of the settled filter ends when its start counts for less than 2 to the power -this.
SETTLED_BITS = 40


def numbered(df: DataFrame, by: str, order: str, *, block: int = BLOCK, name: str = "_n", ties: list[str] | None = None) -> DataFrame:
    """df with each row's number from 0 in its machine's order; rows of equal order by a hash of the columns ties (all by default).

    The order is a whole number; blocks of it are counted, and a row's number is the count before its block and its place
    there. Keys that are sparse make small blocks, and keys that repeat make large ones.
    """
    at = F.floor(F.col(order) / block).alias("_at")
    rows = df.withColumn("_at", at)
    counts = rows.groupBy(by, "_at").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by).orderBy("_at")
    before = counts.select(by, "_at", (F.sum("_c").over(w) - F.col("_c")).alias("_before"))
    inside = Window.partitionBy(by, "_at").orderBy(order, F.xxhash64(*(ties or df.columns)))
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1)
    b = before.select(F.col(by).alias("_by"), F.col("_at").alias("_of"), "_before")
    joined = placed.join(b, F.col(by).eqNullSafe(F.col("_by")) & F.col("_at").eqNullSafe(F.col("_of")))
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_at", "_place", "_by", "_of", "_before")


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < 1.7e308), c)


def _started(rows: DataFrame, starts: DataFrame, by: str) -> DataFrame:
    """rows with what their block starts from; starts has a row a machine and block (_by, _k)."""
    s = starts.withColumnsRenamed({by: "_by", "_b": "_k"})
    return rows.join(s, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_k"))).drop("_by", "_k")


def cusum(df: DataFrame, by: str, order: str, value: str, *, slack: float = 0.5, block: int = BLOCK) -> DataFrame:
    """df with the two-sided CUSUM of a standardised value, up and down, on every row.

    With running sums P of the steps, c at a row is P - min(0 and all P so far) from a start of zero. Blocks: the sum b and the rise
    a = b - min P inside; a block starts from max(0, highest over earlier blocks j of a_j + the b of those between).
    """
    x = F.coalesce(_finite(F.col(value)), F.lit(None))
    rows = numbered(df, by, order, block=block).withColumn("_b", F.floor(F.col("_n") / block))
    for side, step in (("up", x - slack), ("down", -x - slack)):
        rows = rows.withColumn(f"_{side}", F.coalesce(step, F.lit(0.0)))
    inside = Window.partitionBy(by, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    for side in ("up", "down"):
        rows = rows.withColumn(f"_{side}_sum", F.sum(f"_{side}").over(inside))
    for side in ("up", "down"):
        rows = rows.withColumn(f"_{side}_low", F.min(f"_{side}_sum").over(inside))
    last = F.max_by(F.struct(*[f"_{s}_{k}" for s in ("up", "down") for k in ("sum", "low")]), "_n").alias("e")
    blocks = rows.groupBy(by, "_b").agg(last).select(by, "_b", "e.*")
    w = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for side in ("up", "down"):
        # total T before the block; the start is T - min(0, over earlier blocks of their T + lowest inside)
        blocks = blocks.withColumn(f"_{side}_t", F.coalesce(F.sum(f"_{side}_sum").over(w), F.lit(0.0)))
    for side in ("up", "down"):
        lowest = F.min(F.col(f"_{side}_t") + F.col(f"_{side}_low")).over(w)
        blocks = blocks.withColumn(f"_{side}_start", F.col(f"_{side}_t") - F.least(F.lit(0.0), F.coalesce(lowest, F.lit(0.0))))
    out = _started(rows, blocks.select(by, "_b", "_up_start", "_down_start"), by)
    at = lambda s: F.greatest(F.col(f"_{s}_start") + F.col(f"_{s}_sum"), F.col(f"_{s}_sum") - F.col(f"_{s}_low"), F.lit(0.0))
    return out.select(*df.columns, at("up").alias(f"{value}_up"), at("down").alias(f"{value}_down"))


def settled_block(gain: float) -> int:
    """Rows after which a level's start is below rounding."""
    keep = 1.0 - gain
    return 1 if keep <= 0 else max(1, math.ceil(SETTLED_BITS / -math.log2(keep)))


def settled(df: DataFrame, by: str, order: str, value: str, *, gain: float, block: int = BLOCK) -> DataFrame:
    """df with the level of a filter of constant gain, level = level + gain (value - level), from the first value on.

    Within a block of settled_block(gain) rows the level is a running sum of values over powers of the rest, which stay within
    2 ** SETTLED_BITS; before it, the ends of the three blocks before are all that counts.
    """
    if not 0.0 < gain <= 1.0:
        raise ValueError("a gain lies in (0, 1]")
    keep, size = 1.0 - gain, settled_block(gain)
    z = _finite(F.col(value))
    given = numbered(df.withColumn("_z", z), by, order, block=block, ties=df.columns)
    # values only: a row without one keeps the level
    seen = numbered(given.filter("_z IS NOT NULL"), by, "_n", block=block, name="_m").withColumn("_b", F.floor(F.col("_m") / size))
    place = F.pmod(F.col("_m"), F.lit(size))
    power = lambda e: F.pow(F.lit(keep), e)
    inside = Window.partitionBy(by, "_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(F.lit(gain))  # the first value is the level
    term = weight * F.col("_z") * power(-place) if keep else F.col("_z")
    own = F.sum(term).over(inside) * power(place) if keep else F.col("_z")
    seen = seen.withColumn("_own", own).withColumn("_place", place)
    ends = seen.groupBy(by, "_b").agg(F.max_by("_own", "_m").alias("_end"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by).orderBy("_b")
    start = F.lit(0.0)
    for back in (3, 2, 1):
        start = F.coalesce(F.lag("_end", back).over(w), F.lit(0.0)) + power(F.lit(float(size))) * start
    levels = _started(seen, ends.select(by, "_b", start.alias("_start")), by)
    levels = levels.withColumn("_level", F.col("_own") + F.col("_start") * power(F.col("_place") + 1))
    level = levels.select(F.col(by).alias("_by"), F.col("_n").alias("_at"), "_level")
    out = given.join(level, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_n") == F.col("_at")), "left").drop("_by", "_at").withColumn("_b", F.floor(F.col("_n") / block))
    # the last level before a row without a value: in its block, or the last of the blocks before
    latest = F.last("_level", ignorenulls=True)
    kept = out.withColumn("_here", latest.over(Window.partitionBy(by, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    tails = kept.groupBy(by, "_b").agg(F.max_by("_here", "_n").alias("_tail"))
    carried = tails.select(by, "_b", F.last("_tail", ignorenulls=True).over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return _started(kept, carried, by).select(*df.columns, F.coalesce("_here", "_carry").alias(f"{value}_level"))


def runs(df: DataFrame, by: str, order: str, condition: Column, *, name: str = "run", block: int = BLOCK) -> DataFrame:
    """df with the length of the run of rows meeting the condition that ends at each row; zero where it doesn't hold."""
    rows = numbered(df.withColumn("_hit", F.coalesce(condition, F.lit(False))), by, order, block=block, ties=df.columns).withColumn("_b", F.floor(F.col("_n") / block))
    miss = F.when(~F.col("_hit"), F.col("_n"))
    rows = rows.withColumn("_miss", F.max(miss).over(Window.partitionBy(by, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy(by, "_b").agg(F.max(miss).alias("_m"))
    w = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    out = _started(rows, blocks.select(by, "_b", F.max("_m").over(w).alias("_miss_before")), by)
    return out.select(*df.columns, (F.col("_n") - F.coalesce("_miss", "_miss_before", F.lit(-1))).alias(name))
