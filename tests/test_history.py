"""Block scans against row-by-row recursions, the work-order log against a dict, fused plans against single runs."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import core, scans
from tidemark.plans import catalog, fused
from tidemark.plans.plan import Filter, Plan, PlanError
from tidemark.queries import many_plans
from tidemark.sources.tables import observations
from tidemark.streaming import orders, scorer, watch

CAT = catalog.MILLING


def history(rng, n, machines=("a", "b", None)):
    at, rows = 0, []
    for _ in range(n):
        at += rng.choice((0, 1, 1, 1, 5, 300))
        z = rng.choice((None, float("nan"))) if rng.random() < 0.05 else rng.gauss(0.2, 1.0)
        rows.append((rng.choice(machines), at, z, len(rows)))
    return rows


def by_machine(rows, seen):
    """Rows of each machine in the order of (at, as numbered): ties are told by the id that the result brings."""
    out = {}
    for m, at, z, i in sorted(rows, key=lambda r: (r[1], seen[r[3]])):
        out.setdefault(m, []).append((i, z))
    return out


def usable(z):
    return z is not None and math.isfinite(z)


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_block_scans_equal_the_recursions(block, spark):
    rows = history(random.Random(block), 900)
    df = spark.createDataFrame(rows, "m string, at long, z double, i long").repartition(5)
    place = {r.i: r.n for r in scans.numbered(df, "m", "at", block=block, name="n").collect()}
    up = {r.i: r for r in scans.cusum(df, "m", "at", "z", slack=0.5, block=block).collect()}
    level = {r.i: r.z_level for r in scans.settled(df, "m", "at", "z", gain=0.3, block=block).collect()}
    run = {r.i: r.run for r in scans.runs(df, "m", "at", F.col("z") > 0, block=block).collect()}
    assert len(place) == len(up) == len(level) == len(run) == len(rows)
    for of in by_machine(rows, place).values():
        assert [place[i] for i, _ in of] == list(range(len(of)))
        hi = lo = length = 0.0
        x = None
        for i, z in of:
            if usable(z):
                hi, lo = max(0.0, hi + z - 0.5), max(0.0, lo - z - 0.5)
                x = z if x is None else x + 0.3 * (z - x)
            hit = z is not None and (z > 0 or math.isnan(z))  # the engine orders NaN above all numbers
            length = length + 1 if hit else 0
            assert (up[i].z_up, up[i].z_down) == (pytest.approx(hi, abs=1e-9), pytest.approx(lo, abs=1e-9)) and run[i] == length
            assert level[i] is None if x is None else level[i] == pytest.approx(x, rel=1e-9)
    assert scans.cusum(df.limit(0), "m", "at", "z").count() == scans.settled(df.limit(0), "m", "at", "z", gain=1.0).count() == scans.runs(df.limit(0), "m", "at", F.lit(True)).count() == 0


def test_the_observer_and_the_scan_sum_alike(spark):
    """The stream's channel and the batch scan of the same standardised innovations."""
    rng, c, rows = random.Random(8), scorer.Channel(), []
    for i in range(400):
        x = 40 + rng.gauss(0, 1)
        before = (c.up, c.down, c.energy, c.level, c.p, c.q, c.r, c.age)
        c.observe(x)
        if before[2] is not None:
            s = before[4] + before[5] * (1 + before[7]) + before[6]
            rows.append(("a", i, (x - before[3]) / math.sqrt(s) / math.sqrt(before[2]), c.up, c.down))
    got = scans.cusum(spark.createDataFrame(rows, "m string, at long, u double, up double, down double"), "m", "at", "u", slack=scorer.CUSUM_SLACK, block=16).collect()
    assert len(got) == 300 and all(r.u_up == pytest.approx(r.up, abs=1e-9) and r.u_down == pytest.approx(r.down, abs=1e-9) for r in got)


def test_one_machine_is_many_tasks(spark):
    """A million rows of one machine: no task of any window holds more than a few blocks."""
    df = spark.range(1_000_000).select(F.when(F.col("id") >= 0, "a").otherwise("b").alias("m"), F.col("id").alias("at"), F.sin("id").alias("z"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        plan = scans.cusum(df, "m", "at", "z")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        sizes = [r[1] for r in scans.cusum(df, "m", "at", "z").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 1_000_000 and len(sizes) > 4 and max(sizes) < 250_000


# work orders


def plain(events):
    """(order -> state) by folding each order's events in the order of versions, the earliest batch's first."""
    first = {}
    for e in sorted(events, key=lambda e: (e["batch"], repr(e))):
        first.setdefault((e["order_id"], e["version"]), e)
    state = {}
    for (o, _), e in sorted(first.items()):
        s = state.get(o)
        if e["kind"] == "created":
            state[o] = {"status": "open", "mode": e["mode"], "outcome": None, "reopened": 0}
        elif s and e["kind"] == "closed" and s["status"] == "open":
            s.update(status="closed", outcome=e["outcome"])
        elif s and e["kind"] == "reopened" and s["status"] == "closed":
            s.update(status="open", outcome=None, reopened=s["reopened"] + 1)
    return state


def made(rng, n, batch):
    out = []
    for _ in range(n):
        o, v = rng.randrange(30), rng.randrange(12)
        kind = "created" if v == 0 or rng.random() < 0.05 else rng.choice(("closed", "closed", "reopened", "looked at"))
        out.append({"order_id": o, "version": v, "kind": kind, "at": None, "machine_id": "m", "mode": f"M{o % 3}", "product_type": "L", "outcome": rng.choice(orders.OUTCOMES) if kind == "closed" else None, "technician": None, "notes": f"{batch}-{v}-{kind}", "batch": batch})
    return out


def shown(df):
    return {r.order_id: {"status": r.status, "mode": r["mode"], "outcome": r.outcome, "reopened": r.reopened} for r in df.collect()}


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in orders._FIELDS) for e in events], orders.EVENT)


def test_the_log_equals_a_dict(spark, tmp_path):
    rng, log = random.Random(6), orders.OrderLog(spark, f"file://{tmp_path}/log")
    assert log.orders().count() == 0 and log.compact() is None and log.newest().count() == 0
    told, held, upto = [], None, {}
    for b in range(6):
        events = made(rng, 40, b)
        log.append(frame(spark, events), b)
        log.append(frame(spark, made(rng, 5, b)), b)  # a batch that is delivered again changes nothing
        told += events
        upto[b] = plain(told)
        if b == 2:
            held = log.orders()  # a reader from before the compaction
            assert log.compact() == 2 and log.compact() is None
            assert shown(held) == shown(log.orders()) == upto[2]
        assert shown(log.orders()) == upto[b]
    assert log.compact() == 5 and shown(held) == upto[2]
    for b in upto:
        assert shown(log.orders(upto=b)) == upto[b]
    assert sum(log.events().count() for _ in (0,)) == len({(e["order_id"], e["version"]) for e in told})
    broken = tmp_path / "log" / "snapshot=9"
    broken.mkdir()  # a compaction that broke off has no marker
    (tmp_path / "log" / "batch=9").mkdir()
    assert shown(log.orders()) == upto[5]
    one = next(iter(upto[5]))
    assert shown(log.get(one)) == {one: upto[5][one]}
    want = [s for s in upto[5].values()]
    got = orders.summary(log.orders()).first()
    assert (got.total, got.open, got.confirmed) == (len(want), sum(s["status"] == "open" for s in want), sum(s["outcome"] == "confirmed" for s in want))


def test_a_stream_of_events_is_written_once(spark, tmp_path):
    rng, log = random.Random(7), orders.OrderLog(spark, f"file://{tmp_path}/log")
    told = []
    for part in range(3):
        events = made(rng, 30, part)
        frame(spark, events).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told += events
        stream = spark.readStream.schema(orders.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for _ in range(2):  # started again from its checkpoint, with nothing new the second time
            log.sink(stream, f"{tmp_path}/checkpoint").awaitTermination(120)
        assert shown(log.orders()) == plain(told)
    assert log._complete("batch") == [0, 1, 2]


def test_states_as_of_a_time(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(1, 0, "created", at(1)), (1, 1, "closed", at(5)), (1, 2, "reopened", at(9)), (2, 0, "created", at(4)), (None, 0, "created", at(1)), (3, None, "created", at(1)), (4, 1, "closed", at(2)), (5, 0, "created", None)]
    e = spark.createDataFrame(rows, "order_id long, version long, kind string, at string").withColumn("at", F.to_timestamp("at"))
    e = orders.distinct_events(e.select(*[F.col(c) if c in e.columns else F.lit(None).cast("string").alias(c) for c in orders._FIELDS], F.lit(0).alias("batch")))
    state = lambda h: {r.order_id: r.status for r in orders.as_of(e, F.lit(at(h)).cast("timestamp")).collect()}
    assert state(0) == {5: "open"} and state(4) == {1: "open", 2: "open", 5: "open"} and state(6) == {1: "closed", 2: "open", 5: "open"} and state(10)[1] == "open"


# plans in one scan


def test_a_hundred_plans_in_one_scan_equal_single_runs(spark, sf):
    o = observations(spark, sf)
    plans = many_plans(100)
    df = fused.run(o, spark.createDataFrame(plans, fused.PLANS), CAT)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {}
    for r in df.collect():
        got.setdefault(r.plan_id, {})[r.grp] = r
    assert set(got) <= {p[0] for p in plans} and len(got) > 90
    to = {"is": "eq", "is_not": "ne"}
    for name, op, metric, dims, filters, confidence in plans[::6]:
        fs = tuple(Filter(f, to.get(k, k), (a, b) if k == "between" else w if w is not None else a) for f, k, a, b, w in filters)
        rows = o.filter(F.coalesce(core.all_of(fs, CAT), F.lit(False)))
        if op == "rate":
            want = {r.grp: (r.n, r.rate, r.ci_lo, r.ci_hi) for r in core.execute(o, Plan("rate", filters=fs, group_by=tuple(dims), confidence=confidence or 0.95), CAT).collect()}
            assert {g: (r.n, pytest.approx(r.value), pytest.approx(r.ci_lo), pytest.approx(r.ci_hi)) for g, r in got.get(name, {}).items()} == want, name
        else:
            key = F.concat_ws("/", *dims) if dims else F.lit("all")
            want = {r[0]: (r.n, r.v) for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.avg(metric) if op == "mean" else F.count(F.lit(1)).cast("double")).alias("v")).collect()}
            assert {g: (r.n, pytest.approx(r.value)) for g, r in got.get(name, {}).items()} == want, name


def test_plans_are_checked_as_a_table(spark, sf):
    f = lambda *x: tuple(list(x) + [None] * (5 - len(x)))
    rows = [
        ("ok", "rate", None, ["shift"], [f("torque_nm", "gt", 3.0)], None), ("bare", "count", None, None, None, 0.9), ("op", "sum", None, [], [], None), ("metric", "mean", "weight", [], [], None), ("null", "mean", None, [], [], None),
        ("dims", "rate", None, ["shift", "machine_id", "product_type"], [], None), ("dim", "rate", None, ["tint"], [], None), ("key", "rate", None, ["udi"], [], None), ("conf", "rate", None, [], [], 1.0), ("how", "rate", None, [], [f("torque_nm", "like", 1.0)], None),
        ("field", "rate", None, [], [f("colour", "is", None, None, "red")], None), ("value", "rate", None, [], [f("torque_nm", "gt")], None), ("range", "rate", None, [], [f("torque_nm", "between", 5.0, 1.0)], None), ("low", "rate", None, [], [f("torque_nm", "lt", -1.0)], None),
        ("word", "rate", None, [], [f("torque_nm", "is", None, None, "x")], None), ("number", "rate", None, [], [f("shift", "gt", 1.0)], None), ("twice", "count", None, [], [], None), ("twice", "count", None, [], [], None), (None, "count", None, [], [], None), (None, None, None, None, [None], None),
    ]
    plans = spark.createDataFrame(rows, fused.PLANS)
    v = {}
    for r in fused.violations(plans, CAT).collect():
        v.setdefault(r.plan_id, set()).add(r.rule)
    assert set(v) == {r[0] for r in rows} - {"ok", "bare"}
    assert v["op"] == {"unknown operator"} and v["metric"] == v["null"] == {"unknown metric"} and v["low"] == {"impossible value"} and v["twice"] == {"name is not unique"} and v["range"] == {"empty range"} and v["key"] == {"a key is no dimension"}
    assert {r.plan_id for r in fused.run(observations(spark, sf), plans, CAT).collect()} == {"ok", "bare"}
    assert fused.run(observations(spark, sf), plans.limit(0), CAT).count() == 0
    with pytest.raises(PlanError):
        fused.run(observations(spark, sf), spark.createDataFrame([(f"p{i}", "count", None, [], [], None) for i in range(fused.MAX_PLANS + 1)], fused.PLANS), CAT)
    many = spark.range(500).select(F.col("id").cast("string").alias("machine_id"), F.lit(0).alias("machine_failure"))
    with pytest.raises(Exception, match="more than 200 groups"):
        fused.run(many, spark.createDataFrame([("p", "rate", None, ["machine_id"], [], None)], fused.PLANS), CAT).collect()


# silence


def test_a_silent_machine_is_told_by_a_timer(spark, tmp_path):
    """Typed state and event-time timers: the stream, in batches and restarted, equals the table at rest; a pause is STALE once."""
    t0, rng, told, read, batches = datetime.datetime(2024, 1, 1), random.Random(2), [], [], 0
    spark.conf.set(*watch.PROVIDER)
    try:
        now = dict.fromkeys("abc", 0.0)
        for part in range(3):
            rows = []
            for m in now:
                for _ in range(12):
                    now[m] += rng.choice((5, 10, 20)) if rng.random() < 0.85 else rng.choice((301, 900))
                    rows.append((m, t0 + datetime.timedelta(seconds=now[m]), len(read) + len(rows)))
            rows += [rows[3], (None, t0, 1), ("a", None, 2)]  # said twice, without a machine, without a time
            read += rows
            late = min(now.values())
            now = {m: max(x, late) for m, x in now.items()}
            spark.createDataFrame(rows, "machine_id string, at timestamp, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            batches += 1
            readings = spark.readStream.schema("machine_id string, at timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            q = watch.stream(readings, delay="2 hours").writeStream.foreachBatch(lambda df, i: told.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None and (q.lastProgress is None or sum(o.numRowsTotal for o in q.lastProgress.stateOperators) <= 3 * (len(read) + 70))
    finally:
        spark.conf.unset(watch.PROVIDER[0])
    at_rest = spark.createDataFrame(read, "machine_id string, at timestamp, seq long")
    want = [tuple(r) for r in watch.replay(at_rest, F.lit("2023-01-01").cast("timestamp")).collect()]
    assert sorted(told, key=str) == sorted(want, key=str) and len({r[:3] for r in told}) == len(told) and sum(r[1] == "STALE" for r in told) == sum(r[1] == "BACK" for r in told) > 5
    last = {m: max(a for x, a, _ in read if x == m and a is not None) for m in "abc"}
    quiet = [tuple(r) for r in watch.replay(at_rest, F.lit("2024-01-02").cast("timestamp")).collect()]
    assert {(m, a + datetime.timedelta(seconds=300)) for m, a in last.items()} == {(r[0], r[2]) for r in quiet if r[1] == "STALE"} - {(r[0], r[2]) for r in want}


def test_times_are_taken_to_the_nearest_millisecond(spark, tmp_path):
    """Halves away from 1970, as SQL's epoch_ms: at rest, and in the stream (whose watermark starts at 1970, so that older ones are late)."""
    micros = (-700_000_000_500, -300_000_001_400, 100_000_000_499, 500_000_000_500, 900_000_001_500, 1_300_000_000_600)
    ms = (-700_000_001, -300_000_001, 100_000_000, 500_000_001, 900_000_002, 1_300_000_001)
    spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in micros]))).select(F.lit("a").alias("machine_id"), F.timestamp_micros("col").alias("at"), F.col("pos").cast("bigint").alias("seq")).coalesce(1).write.parquet(f"{tmp_path}/in")
    want = [(a + 300_000, b) for a, b in zip(ms, ms[1:])]
    told = []
    spark.conf.set(*watch.PROVIDER)
    try:
        readings = spark.readStream.schema("machine_id string, at timestamp, seq long").parquet(f"{tmp_path}/in")
        watch.stream(readings).writeStream.foreachBatch(lambda df, i: told.extend(df.selectExpr("event", "unix_millis(at) AS ms", "silence_s").collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset(watch.PROVIDER[0])
    e = watch.replay(spark.read.parquet(f"{tmp_path}/in"), F.lit("1960-01-01").cast("timestamp")).selectExpr("event", "unix_millis(at) AS ms", "silence_s").collect()
    for rows, want in ((told, want[2:]), (e, want)):
        stale, back = sorted(r.ms for r in rows if r.event == "STALE"), sorted((r.ms, r.silence_s) for r in rows if r.event == "BACK")
        assert stale == [a for a, _ in want] and back == [(b, (b - a + 300_000) / 1000) for a, b in want]


def test_silence_at_rest_equals_its_sql_to_the_millisecond(spark):
    """The registered statement as it stands; this DuckDB reads its arrow under the setting that it names itself."""
    import duckdb

    from tidemark import queries as q

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute("SET lambda_syntax='ENABLE_SINGLE_ARROW'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = c.sql(q.ORACLES["silence_events"]).fetchall()
    assert len(want) > 800 and sorted(tuple(r) for r in q.QUERIES["silence_events"](spark, sf).collect()) == sorted(want)


def test_the_watermark_alone_tells_of_silence(spark, tmp_path):
    """No reading of the silent machine follows: another's moves the watermark, and the timer goes off."""
    t0, told = datetime.datetime(2024, 1, 1), []
    spark.conf.set(*watch.PROVIDER)
    try:
        for rows in ([("a", 0, 1), ("b", 10, 1)], [("b", 250, 2)], [("b", 500, 3)], [("b", 600, 4)]):
            spark.createDataFrame([(m, t0 + datetime.timedelta(seconds=x), q) for m, x, q in rows], "machine_id string, at timestamp, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            readings = spark.readStream.schema("machine_id string, at timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            watch.stream(readings).writeStream.foreachBatch(lambda df, i: told.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset(watch.PROVIDER[0])
    assert told == [("a", "STALE", t0 + datetime.timedelta(seconds=300), 300.0, None)]
