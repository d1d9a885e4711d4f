"""Alerts and their outcomes as streams: an interval join whose state is as old as the horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(alerts: DataFrame, outcomes: DataFrame, *, horizon: str = "600 seconds", delay: str = "60 seconds") -> DataFrame:
    """alerts (machine_id, mode, raised) with each outcome (machine_id, failed) of their machine within the horizon, null where none came.

    Streams and tables alike. On streams an alert is kept until the watermark has passed its horizon, then it retires: with its
    outcomes, or as one that nothing followed.
    """
    a = alerts.select("machine_id", "mode", F.col("raised").cast("timestamp").alias("raised"))
    o = outcomes.select(F.col("machine_id").alias("_machine"), F.col("failed").cast("timestamp").alias("failed"))
    if a.isStreaming:
        a, o = a.withWatermark("raised", delay), o.withWatermark("failed", delay)
    on = (F.col("machine_id") == F.col("_machine")) & (F.col("failed") >= F.col("raised")) & (F.col("failed") <= F.col("raised") + F.expr(f"INTERVAL {horizon}"))
    return a.join(o, on, "leftOuter").drop("_machine")


def score(ledger_: DataFrame) -> DataFrame:
    """By mode: alerts that an outcome followed, and all, from a ledger at rest (the first outcome of an alert counts)."""
    first = ledger_.groupBy("machine_id", "mode", "raised").agg(F.min("failed").alias("failed"))
    g = first.groupBy("mode").agg(F.count(F.lit(1)).alias("alerts"), F.count("failed").alias("correct"))
    return g.withColumn("precision", F.col("correct") / F.col("alerts"))
