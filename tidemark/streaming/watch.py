"""Watching machines for silence: keyed stream processing with typed state and event-time timers.

No message tells that messages stopped, so each machine sets a timer when it is heard: STALE_S after its latest reading, in event time. When the
stream's watermark passes it and nothing came since, the machine is reported STALE, once; the next reading reports it BACK, with the
time of its silence. State is typed and bounded: the latest time, the numbers seen in the last MEMORY_S of event time (a map), the
latest intervals (a list of at most PERIODS), and one timer.

replay() gives the same rows from a table at rest by windows alone: a silence is a gap between neighbouring readings, or one
that the given watermark has passed.

Defined results: readings without a machine or a time are left out; a sequence number that was seen in its machine's last
MEMORY_S is a repeated reading and left out (replay() knows all numbers, however old); a time is taken to the nearest millisecond, halves away from 1970, as epoch_ms of SQL says it; of equal times one counts; readings older than the latest are late and change nothing; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intake import PERIODS, STALE_S

#: Seconds for which a sequence number is remembered, and by which the stream waits for late readings.
MEMORY_S, DELAY = 3600, "0 seconds"
SCHEMA = "machine_id string, event string, at timestamp, silence_s double, usual_s double"
#: What stateful streams of this kind ask of the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(at: Column) -> Column:
    """A time's milliseconds since 1970, to the nearest; halves go away from zero. unix_millis cuts."""
    return F.round(F.unix_micros(at.cast("timestamp")) / 1000.0).cast("bigint")


def _processor(stale_s: float):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Watch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType()), T.StructField("stale", T.BooleanType())]))
            self.steps = handle.getListState("steps", T.StructType([T.StructField("s", T.DoubleType())]))
            self.seen = handle.getMapState("seen", T.StructType([T.StructField("seq", T.LongType())]), T.StructType([T.StructField("ms", T.LongType())]))

        def _usual(self) -> float | None:
            steps = sorted(x[0] for x in self.steps.get())
            return steps[len(steps) // 2] if steps else None

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            out, steps, numbers = [], [x[0] for x in self.steps.get()], []
            last, stale = self.last.get() if self.last.exists() else (None, False)
            before = last
            batch = pd.concat(list(rows)).sort_values(["at", "seq"])
            for at, seq in zip(batch["at"], batch["seq"], strict=True):
                us = at.value // 1000
                ms = (abs(us) + 500) // 1000 * (1 if us >= 0 else -1)
                if seq is not None and not pd.isna(seq):
                    number = (int(seq),)
                    if number in numbers or self.seen.containsKey(number):
                        continue
                    numbers.append(number)
                    self.seen.updateValue(number, (ms,))
                if last is not None and ms <= last:
                    continue
                if last is not None:
                    gap = (ms - last) / 1000.0
                    usual = sorted(steps)[len(steps) // 2] if steps else None
                    if gap > stale_s and not stale:  # found out by the next reading, before any timer could
                        out.append((key[0], "STALE", pd.Timestamp(last + int(stale_s * 1000), unit="ms"), stale_s, usual))
                    if gap > stale_s:
                        out.append((key[0], "BACK", pd.Timestamp(ms, unit="ms"), gap, usual))
                    steps = [*steps, gap][-PERIODS:]
                last, stale = ms, False
            for number in [k for k, v in self.seen.iterator() if last is not None and v[0] < last - MEMORY_S * 1000]:
                self.seen.removeKey(number)
            if last is not None and last != before:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(last + int(stale_s * 1000))
                self.last.update((last, False))
                if steps:
                    self.steps.put([(x,) for x in steps])
            if out:
                yield pd.DataFrame(out, columns=["machine_id", "event", "at", "silence_s", "usual_s"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, stale = self.last.get()
            if not stale and expiredTimerInfo.getExpiryTimeInMs() >= last + int(stale_s * 1000):
                self.last.update((last, True))
                yield pd.DataFrame([(key[0], "STALE", pd.Timestamp(last + int(stale_s * 1000), unit="ms"), stale_s, self._usual())], columns=["machine_id", "event", "at", "silence_s", "usual_s"])

        def close(self) -> None:
            pass

    return Watch()


def stream(readings: DataFrame, *, stale_s: float = STALE_S, delay: str = DELAY) -> DataFrame:
    """readings (machine_id, at timestamp, seq) of a stream -> STALE and BACK events. The session needs PROVIDER."""
    r = readings.filter("machine_id IS NOT NULL AND at IS NOT NULL").select("machine_id", "at", F.col("seq").cast("bigint").alias("seq")).withWatermark("at", delay)
    return r.groupBy("machine_id").transformWithStateInPandas(_processor(stale_s), SCHEMA, "Append", "EventTime")


def replay(readings: DataFrame, watermark: Column, *, stale_s: float = STALE_S) -> DataFrame:
    """The same events from a table at rest, of which all is told up to the watermark."""
    r = readings.filter("machine_id IS NOT NULL AND at IS NOT NULL")
    at_ms = millis(F.col("at"))
    first = r.groupBy("machine_id", F.coalesce(F.col("seq").cast("string"), F.concat(F.lit("t"), at_ms.cast("string"))).alias("k")).agg(F.min(at_ms).alias("ms")).select("machine_id", "ms").distinct()
    w = Window.partitionBy("machine_id").orderBy("ms")
    gap = (F.lead("ms").over(w) - F.col("ms")) / 1000.0
    steps = first.withColumn("gap", gap).withColumn("before", F.lag("gap").over(w))
    usual = F.array_sort(F.collect_list("before").over(w.rowsBetween(-PERIODS + 1, 0)))
    rows = steps.withColumn("usual", F.try_element_at(usual, (F.floor(F.size(usual) / 2) + 1).cast("int")))
    silent = F.col("gap") > stale_s
    told = F.col("gap").isNull() & (millis(watermark) > F.col("ms") + int(stale_s * 1000))
    stale = F.when(silent | told, F.struct(F.lit("STALE").alias("event"), (F.col("ms") + int(stale_s * 1000)).alias("ms"), F.lit(float(stale_s)).alias("silence_s")))
    back = F.when(silent, F.struct(F.lit("BACK").alias("event"), (F.col("ms") + F.round(F.col("gap") * 1000)).cast("bigint").alias("ms"), F.col("gap").alias("silence_s")))
    events = rows.select("machine_id", "usual", F.explode(F.filter(F.array(stale, back), lambda e: e.isNotNull())).alias("e"))
    return events.select("machine_id", "e.event", F.timestamp_millis("e.ms").alias("at"), "e.silence_s", F.col("usual").alias("usual_s"))
