"""Keyed intake: one transition function per machine, run by Structured Streaming state or by batch replay alike.

Each message gets a verdict, in this order: malformed (no machine), future, duplicate, too_late, gap_before, accepted.
Watermarks are each machine's own, and late rows are reported, not dropped silently; a late row never moves the watermark
back. A message without a time counts as measured when it arrived; one without a sequence number is known by its time.
"""

from __future__ import annotations

import math
from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds and counts of the intake contract.
LATENESS_S, STALE_S, FUTURE_S, GAP_FACTOR, MEMORY = 30.0, 300.0, 5.0, 3.0, 4096
PERIODS, MIN_PERIODS = 64, 8


@dataclass
class Intake:
    """State of one machine; plain values, so that it can be pickled into a state store."""

    high: float | None = None
    last: float | None = None
    seen: OrderedDict = field(default_factory=OrderedDict)
    periods: deque = field(default_factory=lambda: deque(maxlen=PERIODS))

    def offer(self, t: float | None, now: float, seq: int | None = None) -> tuple[str, bool]:
        """(verdict, stale)."""
        if t is None or not math.isfinite(t):
            t = now
        if t > now + FUTURE_S:
            return "future", False
        key = ("s", seq) if seq is not None else ("t", t)
        if key in self.seen:
            return "duplicate", False
        self.seen[key] = True
        if len(self.seen) > MEMORY:
            self.seen.popitem(last=False)
        stale = now - t > STALE_S
        if self.high is not None and self.high - t > LATENESS_S:
            return "too_late", stale
        verdict = "accepted"
        if self.last is not None:
            step = t - self.last
            if step > 0:
                self.periods.append(step)
            if len(self.periods) >= MIN_PERIODS:
                usual = sorted(self.periods)[len(self.periods) // 2]
                if step > GAP_FACTOR * usual:
                    verdict = "gap_before"
        self.last = t
        self.high = t if self.high is None else max(self.high, t)
        return verdict, stale


SCHEMA = "machine_id string, seq bigint, t double, now double, verdict string, stale boolean"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _number(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def _verdicts(state: Intake, b: pd.DataFrame) -> list[tuple]:
    """Of one machine's messages, in order. Sequence numbers come as text, so that none loses digits beside a null."""
    out = []
    for m, s, t, now in zip(b["machine_id"], b["seq"], b["t"], b["now"], strict=True):
        t, seq = _number(t), None if s is None or pd.isna(s) else int(s)
        out.append((m, seq, t, float(now), *(("malformed", False) if m is None else state.offer(t, float(now), seq))))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if n == "seq" else c for n, c in zip(_NAMES, zip(*rows, strict=True), strict=True)})


def _prepared(messages: DataFrame) -> DataFrame:
    return messages.withColumn("seq", F.col("seq").cast("string"))


def replay(messages: DataFrame) -> DataFrame:
    """Batch: (machine_id, seq, t, now, order) -> verdicts. Rows are dealt by machine and sorted; state is a machine's, not its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, state = None, Intake()
        for b in batches:
            out = []
            for m, of in b.groupby("machine_id", sort=False, dropna=False):
                m = None if pd.isna(m) else m
                if m != machine:
                    machine, state = m, Intake()
                out += _verdicts(state, of)
            if out:
                yield _frame(out)

    # messages without a machine are each judged by themselves, so they needn't meet
    key = F.coalesce("machine_id", F.concat(F.lit("?"), F.pmod(F.xxhash64("seq", "t", "order"), F.lit(64)).cast("string")))
    parts = 4 * int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not drawn together by their few bytes
    dealt = _prepared(messages).repartition(parts, key).sortWithinPartitions("machine_id", "order")
    return dealt.select("machine_id", "seq", "t", "now").mapInPandas(run, SCHEMA)


def stream(messages: DataFrame) -> DataFrame:
    """Streaming: the same transitions on arbitrary state keyed by machine, for the same messages, nulls included."""
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s: Intake = pickle.loads(state.get[0]) if state.exists else Intake()
        out = _verdicts(s, pd.concat(list(batches)).sort_values("order"))
        state.update((pickle.dumps(s),))
        yield _frame(out)

    return _prepared(messages).groupBy("machine_id").applyInPandasWithState(step, SCHEMA, "state binary", "append", GroupStateTimeout.NoTimeout)


def stats(verdicts: DataFrame) -> DataFrame:
    """Messages by machine and verdict, the share accepted, and the longest time under way of those."""
    ok = F.col("verdict").isin("accepted", "gap_before")
    g = verdicts.groupBy("machine_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(ok).alias("accepted"), F.count_if("stale").alias("stale"), F.max(F.when(ok, F.col("now") - F.coalesce("t", "now"))).alias("max_latency_s"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("malformed", "future", "duplicate", "too_late", "gap_before")])
    return g.withColumn("accept_rate", F.try_divide(F.col("accepted").cast("double"), F.col("messages")))
