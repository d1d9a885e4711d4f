"""Work orders as an append-only log of events, written exactly once by batch, compacted beside its readers, read as of any time.

An event is (order_id, version, kind, at, ...): created, closed, reopened. Batches lie in folders of their own, complete once
their marker file is there, so a batch that is delivered again finds itself written; an event that another batch brings again is
the same (order_id, version) and counts once, from the earliest batch. An order's state follows from its events in the order of their
versions, whatever the order of arrival: a creation sets the order up anew and opens it, a closing counts while it is open, a reopening while
it is closed. As-of reads leave out events that happened later, or that later batches brought.

Compaction writes the distinct events of all batches so far into a snapshot beside them. Readers take the newest complete snapshot and the
batches behind it, so neither a running nor a failed compaction is seen, and nothing that a reader may hold is taken away.

Defined results: events without an order or a version are no events; of equal (order_id, version) in one batch the smallest row
counts; an event without a time is in every as-of state; unknown kinds change nothing; an empty log has no orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "order_id bigint, version bigint, kind string, at timestamp, machine_id string, mode string, product_type string, outcome string, technician string, notes string"
_FIELDS = [c.split()[0] for c in EVENT.split(", ")]
#: How an order can end.
OUTCOMES = ("confirmed", "false_alarm", "wrong_mode", "inconclusive")


def distinct_events(events: DataFrame, batch: str = "batch") -> DataFrame:
    """Each (order_id, version) once: the smallest row of its earliest batch. Map-side combined."""
    rest = [c for c in _FIELDS if c not in ("order_id", "version")]
    known = events.filter("order_id IS NOT NULL AND version IS NOT NULL")
    first = known.groupBy("order_id", "version").agg(F.min(F.struct(F.col(batch).alias("batch"), *rest)).alias("e"))
    return first.select("order_id", "version", *[f"e.{c}" for c in rest], "e.batch")


def current(events: DataFrame) -> DataFrame:
    """One row an order: its state after all given events, which are distinct. Orders that were never created have none.

    An event counts where its kind differs from the kind of the one before it, creations always: only kinds that change
    something alternate, and a repeated one changes nothing.
    """
    by = Window.partitionBy("order_id")
    e = events.filter(F.col("kind").isin("created", "closed", "reopened"))
    made = e.withColumn("_made", F.max(F.when(F.col("kind") == "created", F.col("version"))).over(by)).filter(F.col("version") >= F.col("_made"))
    closed = F.col("kind") == "closed"
    before = F.coalesce(F.lag(closed).over(by.orderBy("version")), F.lit(False))
    live = made.withColumn("_counts", (F.col("kind") == "created") | (closed != before)).filter("_counts")
    last = lambda c, where: F.max_by(F.when(where, F.col(c)), F.when(where, F.col("version")))
    made_ = F.col("kind") == "created"
    g = live.groupBy("order_id").agg(
        *[last(c, made_).alias(c) for c in ("machine_id", "mode", "product_type")], last("at", made_).alias("raised_at"),
        F.max(F.struct("version", closed.alias("closed"), "at", "outcome", "technician", "notes")).alias("l"), F.count_if(F.col("kind") == "reopened").alias("reopened"),
    )
    is_closed = F.col("l.closed")
    return g.select("order_id", "machine_id", "mode", "product_type", "raised_at", F.when(is_closed, "closed").otherwise("open").alias("status"), *[F.when(is_closed, F.col(f"l.{c}")).alias(n) for c, n in (("at", "closed_at"), ("outcome", "outcome"), ("technician", "technician"), ("notes", "notes"))], "reopened", F.col("l.version").alias("version"))


def as_of(events: DataFrame, at: Column) -> DataFrame:
    """The state that the events up to a time make, those without a time included."""
    return current(events.filter(F.coalesce(F.col("at") <= at, F.lit(True))))


def summary(orders: DataFrame) -> DataFrame:
    """Orders, open ones, each outcome, and the share confirmed of those judged."""
    one = orders.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("open"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return one.withColumn("precision", F.try_divide(F.col("confirmed").cast("double"), F.col("confirmed") + F.col("false_alarm")))


def weights(orders: DataFrame, *, gain: float = 0.002) -> DataFrame:
    """What closed orders teach: by mode and variant the weight that confirmed ones raise and false alarms lower by half as much, each order once."""
    g = orders.filter("status = 'closed'").groupBy("mode", "product_type").agg(F.count(F.lit(1)).alias("closed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES[:2]])
    return g.withColumn("weight", 1 + gain * F.col("confirmed") - gain / 2 * F.col("false_alarm"))


class OrderLog:
    """The log at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind whose marker is there, ascending."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def append(self, events: DataFrame, batch: int) -> None:
        """Writes a batch, once: a batch that is complete is not written again, one that broke off is written anew."""
        if batch not in self._complete("batch"):
            cols = [F.col(c) if c in events.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in EVENT.split(", "))]
            events.select(*cols).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={batch}")

    def sink(self, stream: DataFrame, checkpoint: str):
        """The stream's batches as the log's, until all that is there now is written."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def events(self, upto: int | None = None) -> DataFrame:
        """The distinct events of the batches up to a number (of all): the newest snapshot that is not past it, and the batches behind."""
        snapshots = [s for s in self._complete("snapshot") if upto is None or s <= upto]
        base = snapshots[-1] if snapshots else -1
        read = self.spark.read.schema(f"{EVENT}, batch bigint").parquet
        parts = [read(f"{self.path}/snapshot={base}")] if snapshots else []
        for b in self._complete("batch"):
            if b > base and (upto is None or b <= upto):
                parts.append(self.spark.read.schema(EVENT).parquet(f"{self.path}/batch={b}").withColumn("batch", F.lit(b).cast("bigint")))
        if not parts:
            return self.spark.createDataFrame([], f"{EVENT}, batch bigint")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return distinct_events(whole)

    def compact(self) -> int | None:
        """Writes all complete batches so far into a snapshot and tells its number; None where there is nothing new."""
        done = self._complete("batch")
        if not done or done[-1] in self._complete("snapshot"):
            return None
        self.events(done[-1]).repartitionByRange("order_id").sortWithinPartitions("order_id", "version").write.mode("overwrite").parquet(f"{self.path}/snapshot={done[-1]}")
        return done[-1]

    def orders(self, *, at: Column | None = None, upto: int | None = None) -> DataFrame:
        """Current orders, or those as of a time, or as of a batch."""
        e = self.events(upto)
        return current(e) if at is None else as_of(e, at)

    def get(self, order_id: int) -> DataFrame:
        return current(self.events().filter(F.col("order_id") == order_id))

    def newest(self, limit: int = 100, *, open_only: bool = False) -> DataFrame:
        """The orders raised last, a report of limit rows."""
        o = self.orders()
        return (o.filter("status = 'open'") if open_only else o).orderBy(F.desc("raised_at"), F.desc("order_id")).limit(limit)
