"""Laws of plans, rules, statistics and state machines."""

import math
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions import units
from tidemark.operators import core, discovery, physics
from tidemark.operators import reliability as rel
from tidemark.operators.quantiles import quantiles
from tidemark.plans import catalog
from tidemark.plans.plan import Binning, Cohort, Filter, Plan, PlanError, plan_from_dict
from tidemark.plans.process import MILLING, from_yaml
from tidemark.sources import io
from tidemark.sources.tables import observations
from tidemark.streaming import intake, scorer

CAT = catalog.MILLING


def test_plans_are_validated_at_one_place():
    with pytest.raises(ValueError):
        Plan("rate", group_by=("colour",)).validated(CAT)
    for bad in (dict(limit=0), dict(limit=501), dict(confidence=0.2), dict(grain="week"), dict(group_by=("udi",)), dict(group_by=("shift", "machine_id", "product_type"))):
        with pytest.raises(PlanError):
            Plan("rate", **bad).validated(CAT)
    with pytest.raises(PlanError):
        Binning("explicit", (2.0, 1.0))
    with pytest.raises(PlanError):
        Cohort("Bad Name")
    with pytest.raises(PlanError):
        plan_from_dict({"op": "rate", "filters": [{"field": "torque_nm", "op": "like", "value": 1}]}, CAT)
    p = plan_from_dict({"op": "describe", "metrics": ["torque_nm"], "filters": [{"field": "torque_nm", "op": "between", "value": [1, 2]}], "bin": {"how": "width", "bins": 4}}, CAT)
    assert p.filters[0].value == (1, 2) and p.binning.bins == 4


def test_too_many_groups_are_refused(spark):
    df = spark.range(500).select(F.col("id").alias("udi"), F.col("id").cast("string").alias("machine_id"), F.lit(0).alias("machine_failure"))
    with pytest.raises(PlanError):
        core.execute(df, Plan("rate", group_by=("machine_id",)), CAT)


def test_rules_fire_exactly_where_margins_are_negative(spark, sf):
    o = observations(spark, sf)
    wrong = o.filter((F.col("osf_rule") != (F.col("osf_margin") < 0)) | (F.col("pwf_rule") != ((F.col("pwf_margin_0") < 0) | (F.col("pwf_margin_1") < 0))) | (F.col("hdf_rule") != ((F.col("hdf_margin_0") < 0) & (F.col("hdf_margin_1") < 0))))
    assert wrong.count() == 0
    any_rule = F.col("hdf_rule") | F.col("pwf_rule") | F.col("osf_rule")
    assert o.filter(any_rule != (F.col("worst_margin") < 0)).count() == 0


def test_a_null_shift_changes_nothing(spark, sf):
    r = physics.counterfactual(observations(spark, sf), MILLING, torque_nm=0.0).first()
    assert r.rescued == r.newly_failing == 0 and r.verdict == "no change"
    with pytest.raises(ValueError):
        physics.counterfactual(observations(spark, sf), MILLING, power_w=1.0)


def test_fixes_are_verified(spark, sf):
    o = observations(spark, sf)
    fix = physics.envelope_fix(o, MILLING).filter("available")
    j = o.join(fix, "udi")
    new = lambda c: F.when(F.col("variable") == c, F.col("new_value")).otherwise(F.col(c))
    again = MILLING.judged(MILLING.physics(j.withColumns({c: new(c) for c in ("torque_nm", "rotational_speed_rpm", "tool_wear_min")})))
    assert fix.count() > 0 and again.filter("hdf_rule OR pwf_rule OR osf_rule").count() == 0


def test_a_second_process_is_a_file(spark):
    p = from_yaml("""
variant: kind
wear_rate: {A: 1}
modes:
  - {name: HOT, terms: [{metric: temp, op: ">", limit: {A: 90, B: 80}}]}
  - {name: BAND, stochastic: true, terms: [{metric: temp, op: between, limit: [10, 20]}]}
""")
    df = p.judged(spark.createDataFrame([("A", 95.0), ("A", 85.0), ("B", 85.0), ("B", None), ("A", 15.0)], "kind string, temp double"))
    assert [r.hot_rule for r in df.collect()] == [True, False, True, False, False]
    assert [r.band_rule for r in df.collect()] == [False, False, False, False, True]


def test_empty_cohorts_abstain(spark, sf):
    df = observations(spark, sf)
    r = core.execute(df, Plan("describe", ("torque_nm",), cohorts=(Cohort("none", (Filter("torque_nm", "gt", 1e9),)),)), CAT).first()
    assert r.n == 0 and r["mean"] is None and r.quality == "abstain"
    assert rel.invariants(df.limit(0)).filter("holds").count() <= 1


def test_free_sql_is_guarded(spark, sf, tmp_path):
    o = observations(spark, sf)
    n = o.count()
    (tmp_path / "f.txt").write_text("secret")
    for good, want in (
        ("WITH x AS (SELECT * FROM observations) SELECT count(*) AS n FROM x", n),
        ("SELECT count(*) AS n FROM observations o JOIN (SELECT DISTINCT machine_id AS m FROM observations) d ON o.machine_id = d.m", n),
        ("SELECT (SELECT count(*) FROM observations) AS n", n),
        ("WITH a AS (SELECT * FROM observations), b AS (SELECT * FROM a) SELECT (SELECT count(*) FROM b) AS n", n),
        ("SELECT count(*) AS n FROM (WITH a AS (SELECT upper(product_type) AS t FROM observations WHERE torque_nm IS NOT NULL) SELECT * FROM a WHERE t IN ('L', 'M', 'H'))", n),
        ("SELECT sum(c) AS n FROM (SELECT product_type, count(*) OVER () AS w, 1 AS c FROM observations) -- done", n),
        ("SELECT count(*) AS n FROM observations WHERE udi IN (SELECT udi FROM observations WHERE torque_nm > -1)", n),
    ):
        assert core.explore(o, good).first().n == want, good
    assert core.explore(o, "SELECT * FROM observations").count() == min(n, 10_000)
    bad = [
        "DROP TABLE observations", "INSERT INTO observations VALUES (1)", "SELECT 1; SELECT 2", f"SELECT * FROM parquet.`{sf}/nation.parquet`; DROP VIEW observations",
        f"SELECT * FROM text.`{tmp_path}/f.txt`", f"SELECT * FROM parquet.`{sf}/nation.parquet`", f"SELECT * FROM csv.`{tmp_path}/f.txt`", f"SELECT * FROM json.`{tmp_path}/f.txt`", f"SELECT * FROM binaryFile.`{tmp_path}/f.txt`",
        f"SELECT (SELECT first(value) FROM text.`{tmp_path}/f.txt`) AS v", f"SELECT * FROM observations WHERE EXISTS (SELECT 1 FROM text.`{tmp_path}/f.txt`)",
        f"WITH t AS (SELECT * FROM text.`{tmp_path}/f.txt`) SELECT * FROM t", f"SELECT 1 AS a UNION ALL SELECT 2 FROM text.`{tmp_path}/f.txt`", f"SELECT * FROM observations o, LATERAL (SELECT * FROM text.`{tmp_path}/f.txt`)",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS h", "SELECT reflect('java.lang.System', 'getenv', 'PATH') AS h", "SELECT try_reflect('java.lang.System', 'getenv', 'PATH')", "SELECT max(reflect('java.lang.System', 'getenv', 'PATH')) FROM observations",
        "SELECT * FROM global_temp.observations", "SELECT * FROM spark_catalog.default.x", "SELECT * FROM nothing", "SELECT input_file_name() FROM observations",
        f"SELECT * FROM IDENTIFIER('text.`{tmp_path}/f.txt`')", "WITH observations2 AS (SELECT 1) SELECT * FROM other", "EXPLAIN SELECT 1", "",
        "SELECT p.secret FROM (WITH payroll AS (SELECT 1 AS x) SELECT x FROM payroll) a, payroll p", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "SELECT (WITH t AS (SELECT 1) SELECT * FROM t) AS v FROM t",
        "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", "SELECT * FROM range(1000000000000)", "SELECT explode(sequence(1, 100000000))", "SELECT repeat('x', 1000000000)", "SELECT my_udf(torque_nm) FROM observations", "SELECT current_user()",
    ]
    spark.range(2).withColumn("secret", F.lit("s")).createOrReplaceTempView("payroll")
    spark.udf.register("my_udf", lambda x: x)
    for q in bad:
        with pytest.raises(PlanError):
            core.explore(o, q)
    spark.catalog.dropTempView("payroll")
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("observations")]


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    for n, heavy in ((0, 0), (1, 0), (2, 0), (7, 0), (10, 0), (997, 0), (5000, 4000), (30000, 0)):
        xs = [7.0] * heavy + [rng.lognormvariate(0, 4) for _ in range(n - heavy)]
        df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
        at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
        for accuracy, few in ((100, 0), (50_000, 0), (100, 50_000)):
            got = quantiles(df, {"x": F.col("x"), "y": -F.col("x")}, at, accuracy=accuracy, few=few)
            want = [float(np.quantile(xs, q)) if xs else None for q in at]
            assert got["x"] == pytest.approx(want, rel=1e-9) if xs else got["x"] == want
            if xs:
                assert got["y"] == pytest.approx([float(np.quantile([-x for x in xs], q)) for q in at], rel=1e-9)
                assert quantiles(df, {"x": F.col("x")}, (0.9,), discrete=True, accuracy=accuracy, few=few)["x"][0] == sorted(xs)[math.ceil(0.9 * len(xs)) - 1]


def test_running_counts_of_heavy_tails(spark):
    rng = random.Random(4)
    xs = [rng.lognormvariate(0, 8) for _ in range(3000)] + [1e300, -1e300]
    rows = [("a", x, rng.randint(1, 5)) for x in sorted(set(xs))] + [("b", 1.0, 2)]
    got = rel.ranked(spark.createDataFrame(rows, "g string, x double, c long"), "g", ("c",)).orderBy("g", "x").collect()
    total = 0
    for i, r in enumerate(x for x in got if x.g == "a"):
        total += r.c
        assert r.c_upto == total and r.next == (got[i + 1].x if got[i + 1].g == "a" else None)
    assert got[-1].c_upto == 2 and got[-1].next is None


def test_the_row_before_is_found_over_block_ends(spark):
    ids = [0, 1, 2, 9, 10, 11, 500, 501, 1999, 2000, 31000]
    df = spark.createDataFrame([(i, float(i * i), float(-i)) for i in ids], "udi long, a double, b double")
    got = rel.with_previous(df, "udi", ("a", "b"), block=10).orderBy("udi").collect()
    assert [(r.a_prev, r.b_prev) for r in got] == [(None, None)] + [(float(i * i), float(-i)) for i in ids[:-1]]


def test_alerts_meet_the_first_failure_in_their_horizon(spark):
    rng = random.Random(6)
    rows = sorted({(f"m{rng.randint(0, 2)}", rng.randint(0, 4000)) for _ in range(900)})
    sig = [(m, at, rng.choice(["HDF", "OSF", None, None]), rng.random() < 0.05) for m, at in rows]
    sig = [x for x in sig if x[2] or x[3]]
    got = {(r.machine_id, r.at): r.failed_at for r in rel.matched(spark.createDataFrame(sig, "machine_id string, at long, mode string, failed boolean"), 300).collect()}
    want = {(m, at): min((f for n, f, _, bad in sig if bad and n == m and at <= f <= at + 300), default=None) for m, at, mode, _ in sig if mode}
    assert got == want


def test_units_of_filters_and_numbers(spark):
    assert Filter("air_temp_k", "gt", 25.0, "degC").bound(CAT) == pytest.approx(298.15)
    assert Filter("power_w", "between", (3.5, 9.0), "kW").bound(CAT) == (3500.0, 9000.0)
    assert Filter("tool_wear_min", "in", [1, 2], "h").bound(CAT) == [60.0, 120.0]
    assert Filter("temp_delta_k", "lt", 9, "Δ°C").bound(CAT) == 9 and Filter("torque_nm", "lt", 9, "n.m").bound(CAT) == 9
    for name, u in (("air_temp_k", "W"), ("air_temp_k", "ΔK"), ("temp_delta_k", "K"), ("torque_nm", "parsec"), ("machine_id", "K")):
        with pytest.raises(PlanError):
            Filter(name, "gt", 1.0, u).bound(CAT)
    for f in (Filter("torque_nm", "lt", -5.0), Filter("air_temp_k", "gt", -300.0, "°C"), Filter("rotational_speed_rpm", "between", (-1, 5))):
        with pytest.raises(PlanError):
            Plan("rate", filters=(f,)).validated(CAT)
    Plan("rate", filters=(Filter("air_temp_k", "gt", -10.0, "°C"), Filter("temp_delta_margin_k", "lt", -3.0))).validated(CAT)
    assert plan_from_dict({"op": "rate", "filters": [{"field": "air_temp_k", "op": "gt", "value": 25, "unit": "celsius"}]}, CAT).filters[0].unit == "celsius"
    got = spark.createDataFrame([(1234567.0,), (0.0,), (3.14159,), (1234.5678,), (0.00012345,), (None,)], "x double").select(units.rendered(F.col("x"))).collect()
    assert [r[0] for r in got] == ["1,234,567", "0", "3.142", "1,235", "0.000123", None]


def test_modes_of_a_file_replace_the_limits(spark, sf):
    from dataclasses import replace

    looser = replace(MILLING, modes=tuple(replace(m, terms=tuple(replace(t, limit=t.limit * (0.5 if t.op == "<" else 2.0)) for t in m.terms)) if m.name == "PWF" else m for m in MILLING.modes))
    o = observations(spark, sf)
    band = lambda p: {r.udi: r for r in physics.envelope_points(o, p).filter("torque_min IS NOT NULL").collect()}
    a, b = band(MILLING), band(looser)
    assert all(b[k].torque_min == pytest.approx(a[k].torque_min / 2) for k in a)
    alerts = lambda p: scorer.replay(o, p).filter("alerts LIKE '%CROSSED:PWF%'").count()
    assert alerts(looser) <= alerts(MILLING)


def test_points_are_resolved(spark, sf):
    o = observations(spark, sf)
    mean = o.agg(*[F.avg(c).alias(c) for c in MILLING.base]).first()
    p = physics.operating_point(o, MILLING, {"air_temperature_k": 310.0}).first()
    assert p.process_temperature_k == pytest.approx(310.0 + mean.process_temperature_k - mean.air_temperature_k) and p.torque_nm == pytest.approx(mean.torque_nm)
    none = o.filter("udi < 0")
    assert physics.operating_point(none, MILLING).count() == 0
    p = physics.operating_point(none, MILLING, {"torque_nm": 12, "product_type": "zz"}).first()
    assert (p.torque_nm, p.rotational_speed_rpm, p.product_type, p.matched) == (12.0, 1500.0, "L", 0)
    with pytest.raises(ValueError):
        physics.operating_point(o, MILLING, {"power_w": 1})


def test_worst_comes_first(spark, sf):
    o = observations(spark, sf)
    m = [r.worst_margin for r in rel.fleet(o).collect()]
    c = [r.cycles for r in rel.remaining_life(o, MILLING).collect()]
    f = [r.fp_rate for r in rel.feedback(rel.work_orders(o)).collect()]
    assert m == sorted(m) and c == sorted(c) and f == sorted(f, reverse=True)


def test_conformal_correction_is_the_plain_quantile(spark, sf):
    o = observations(spark, sf)
    rows = o.filter("osf = 1").select("product_type", "tool_wear_min", "torque_nm").collect()
    limit, rate = MILLING.mode("OSF").terms[0].limit, MILLING.wear_rate
    left = sorted((abs(limit[r.product_type] - r.tool_wear_min * r.torque_nm) + 1) / (rate[r.product_type] * r.torque_nm) for r in rows)
    want = left[math.ceil(0.9 * len(left)) - 1] if len(left) >= 5 else 0.0
    assert rel.conformal_correction(o, MILLING) == pytest.approx(want)
    assert rel.conformal_correction(o.filter("udi < 0"), MILLING) == 0.0


def test_sensor_and_process_drift(spark):
    rng = random.Random(9)

    def frame(heat, load):
        rows = []
        for i in range(4000):
            late = i >= 2000
            t = rng.gauss(40, 10) + load * late
            rpm = 1540 - 16 * (t - 40) + rng.gauss(0, 60)
            rows.append((i, 300.0, 310.0 + rng.gauss(0, 1) + heat * late, rpm, t, t * rpm * 2 * math.pi / 60))
        return spark.createDataFrame(rows, "udi long, air_temperature_k double, process_temperature_k double, rotational_speed_rpm double, torque_nm double, power_w double").withColumn("temp_delta_k", F.expr("process_temperature_k - air_temperature_k"))

    late = F.col("udi") >= 2000
    assert rel.drift(frame(3, 0), late).first().verdict == "sensor"
    assert rel.drift(frame(0, 8), late).first().verdict == "process"
    assert rel.drift(frame(3, 8), late).first().verdict == "process"


def test_conjunctions_are_found(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(4000):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((a, b, c, int((a > 0.8 and b > 0.7) or c < 0.05)))
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    rules, coverage = discovery.induce_paths(df, ("a", "b", "c"), "y")
    assert coverage > 0.95 and all(r.precision >= 0.9 for r in rules)
    assert any({m for m, _, _ in r.terms} >= {"a", "b"} for r in rules) and any([m for m, _, _ in r.terms] == ["c"] or "c" in {m for m, _, _ in r.terms} for r in rules)
    assert discovery.simplified((("a", ">", 1.0), ("a", ">", 2.0), ("a", "<=", 9.0), ("a", "<=", 8.0))) == (("a", ">", 2.0), ("a", "<=", 8.0))
    p = from_yaml(discovery.as_yaml(rules, "k", {"x": 1.0}))
    assert len(p.modes) == len(rules)
    hot = discovery.one_hot(spark.createDataFrame([("a", str(i)) for i in range(40)] + [("b", "0")], "p string, q string"), ("p", "q"))
    assert sorted(hot) == ["p_is_a", "p_is_b"]


def test_trees_agree_with_plain_search(spark):
    """One level: the cut with the lowest balanced impurity, of all cuts of all metrics."""
    rng = random.Random(12)
    rows = [(rng.randint(0, 60) / 4, rng.gauss(0, 1)) for _ in range(600)]
    y = [int(a > 9 and rng.random() < 0.7 or b > 1.8) for a, b in rows]
    df = spark.createDataFrame([(a, b, k) for (a, b), k in zip(rows, y, strict=True)], "a double, b double, y int")
    up, down = len(y) / (2 * sum(y)), len(y) / (2 * (len(y) - sum(y)))
    best = None
    for j, m in enumerate("ab"):
        xs = sorted({r[j] for r in rows})
        for lo, hi in zip(xs, xs[1:], strict=False):
            cut, cost = (lo + hi) / 2, 0.0
            sides = [[k for r, k in zip(rows, y, strict=True) if (r[j] <= cut) == s] for s in (True, False)]
            if min(map(len, sides)) < 15:
                continue
            for s in sides:
                p, q = sum(s) * up, (len(s) - sum(s)) * down
                cost += 2 * p * q / (p + q)
            best = min(best or (9e9,), (round(cost, 9), m, cut))
    leaves = discovery.grow(df, ("a", "b"), F.col("y") == 1, depth=1)
    assert sorted(leaves)[0][0][0][::2] == best[1:]


def test_rule_induction_is_separate_and_conquer(spark, sf):
    o = observations(spark, sf)
    metrics = ("torque_nm", "tool_wear_min", "overstrain_min_nm")
    rest = o.select(*metrics, "osf").toPandas()
    total, found = rest.osf.sum(), 0
    for r in discovery.induce(o, metrics, "osf").orderBy("rule").collect():
        best = None
        for m in metrics:
            xs = np.sort(rest[m].unique())
            for cut in (xs[1:] + xs[:-1]) / 2:
                for side, hit in (("<", rest[m] < cut), (">", rest[m] > cut)):
                    k = int(rest.osf[hit].sum())
                    if k >= discovery.POSITIVES and k / hit.sum() >= discovery.PRECISION:
                        best = min(best or (0,), (-k, -k / hit.sum(), m, cut, side))
        assert (r.metric, r.side, r.positives) == (best[2], best[4], -best[0]) and r.cut == pytest.approx(best[3])
        found += r.positives
        assert r.coverage == pytest.approx(found / total)
        rest = rest[~((rest[r.metric] < r.cut) if r.side == "<" else (rest[r.metric] > r.cut))]


def test_linear_baseline_is_a_projection(spark, sf):
    o = observations(spark, sf)
    x = o.select(*MILLING.base).toPandas().to_numpy()
    zs = (x - x.mean(axis=0)) / x.std(axis=0)
    v = np.linalg.eigh(np.cov(zs.T, bias=True))[1][:, ::-1][:, 3:]
    got = [r[0] for r in o.orderBy("udi").select(discovery.linear_baseline(o, MILLING.base)).collect()]
    order = np.argsort([r.udi for r in o.select("udi").collect()])
    assert np.allclose(got, ((zs @ v) ** 2).sum(axis=1)[order], atol=1e-8)
    a = {r.healthy: r for r in discovery.anomalies(o, MILLING.base, F.col("machine_failure") == 0).collect()}
    assert a[True].share <= 0.01 and a[True].n + a[False].n == o.count()


def test_ranking_is_told_from_chance(spark):
    one = lambda rows: core.ranking_test(spark.createDataFrame(rows, "failures long, n long")).first()
    r = one([(1, 1000), (90, 1000), (5, 1000)])
    assert not r.ranking_is_chance and r.spread_points == pytest.approx(8.9)
    r = one([(50, 1000), (52, 1000), (49, 1000)])
    assert r.ranking_is_chance and r.chance_spread_points > 0.3


def test_nearest_is_exact_in_several_passes(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    v[600:] = v[:100]  # ties
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in rel.nearest(df, df.filter("vec_id % 7 = 0"), k=4, query_bytes=2000).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.similarity)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(0, 700, 7):
        s = u @ u[i]
        want = sorted((j for j in range(700) if j != i), key=lambda j: -s[j])[:4]
        assert [got[i][k][1] for k in (1, 2, 3, 4)] == pytest.approx([s[j] for j in want], abs=1e-9)
    assert rel.nearest(df, df.filter("vec_id < 0")).count() == 0


def test_questions_have_shapes(spark):
    from tidemark.functions.text import DIM, embedding, normalise

    q = spark.createDataFrame([("What is the average Torque of L-07 above 12.5, please?",), ("the",), (None,), ("",)], "t string")
    got = q.select(normalise(F.col("t"), {"torque": "torque_nm"}).alias("n")).withColumn("v", embedding(F.col("n"))).collect()
    assert got[0].n == "what average torque_nm <machine> above <n>" and got[1].n == "" and got[2].n is None
    want = np.zeros(DIM)
    for w in got[0].n.split():
        want[zlib.crc32(f"w:{w}".encode()) % DIM] += 1.0
    padded = f"  {got[0].n}  "
    for i in range(len(padded) - 2):
        want[zlib.crc32(f"c:{padded[i : i + 3]}".encode()) % DIM] += 0.5
    assert np.allclose(got[0].v, want / np.linalg.norm(want)) and set(got[1].v) == {0.0}


def test_values_are_counted_once_for_their_ranks(spark):
    """The cuts, the buckets and the rows of a ranking read one count of the values, and whatever the cuts, ranks are exact."""
    df = spark.range(3000).select((F.col("id") * 7919 % 1009 / 8).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b"), (F.col("id") % 7 == 0).alias("hit"))
    r = rel.ranked(rel.counted_pairs(df, ("a", "b"), F.col("hit")), "metric", ("n", "k"))
    got = {(x.metric, x.x): x for x in r.collect()}
    assert r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Generate ") == 1
    rows = [(i * 7919 % 1009 / 8, None if i % 5 == 0 else float(i % 3), i % 7 == 0) for i in range(3000)]
    for at, m in enumerate("ab"):
        known = sorted((x[at], x[2]) for x in rows if x[at] is not None)
        for v in {x for x, _ in known}:
            assert (got[m, v].n_upto, got[m, v].k_upto, got[m, v].n_all) == (sum(x <= v for x, _ in known), sum(h for x, h in known if x <= v), len(known))
            assert got[m, v].next == min((x for x, _ in known if x > v), default=None)


def test_a_question_costs_in_proportion_to_its_text(spark):
    """Whatever stands inside a lambda is worked out for every element: the text's clean-up for every stretch of it, its length for every place."""
    from tidemark.functions.text import DIM, embedding, normalise

    long = " ".join(f"valve{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} opens" for i in range(400))
    start = time.monotonic()
    got = spark.createDataFrame([(long,)], "t string").select(normalise(F.col("t")).alias("n")).withColumn("v", embedding(F.col("n"))).withColumn("w", embedding(F.col("n"), 100)).first()
    assert time.monotonic() - start < 60
    for v, dim in ((got.v, DIM), (got.w, 100)):  # 100 places don't fill their last group
        want, padded = np.zeros(dim), f"  {got.n}  "
        for x in [f"w:{w}" for w in got.n.split()]:
            want[zlib.crc32(x.encode()) % dim] += 1.0
        for i in range(len(padded) - 2):
            want[zlib.crc32(f"c:{padded[i : i + 3]}".encode()) % dim] += 0.5
        assert np.allclose(v, want / np.linalg.norm(want))


def test_statistics():
    assert S.z(0.95) == pytest.approx(1.959964, abs=1e-6)
    assert S.chi2_quantile(0.999, 3) == pytest.approx(16.2662, abs=1e-3)
    assert S.chi2_quantile(1e-4, 24) == pytest.approx(6.2230, abs=1e-3)
    assert S.cusum_threshold(2000.0) == pytest.approx(6.4392, abs=2e-3)
    assert S.isotonic([1, 3, 2, 4], [1, 1, 1, 1]) == [1, 2.5, 2.5, 4]
    seen, chance, p = S.permutation_spread([(5, 100), (6, 100), (5, 100)])
    assert seen < 0.02 and p > 0.5 > chance
    assert S.permutation_spread([(1, 1000), (90, 1000), (5, 1000)])[2] < 0.01


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_isotonic_is_monotone_and_keeps_the_mean(xs):
    y = S.isotonic(xs, [1.0] * len(xs))
    assert all(a <= b + 1e-12 for a, b in zip(y, y[1:], strict=False)) and math.isclose(sum(y), sum(xs), abs_tol=1e-9)


def test_times_and_numbers(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("junk",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(io.parse_time(F.col("v"))).collect()] == [1.7e9, 1.7e9, 1.7e9, None, None, None]
    assert [r[0] for r in df.select(io.number(F.col("v"))).collect()] == [1.7e9, 1.7e12, None, None, None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text(",".join(io.HEADERS) + "\n1,M1,L,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n")
    r = io.build_source(spark, "csv", str(tmp_path / "c.csv")).first()
    assert (r.udi, r.product_type, r.torque_nm) == (1, "L", 42.8)
    (tmp_path / "m.jsonl").write_text('{"torque_nm": 1.5}\n{broken\n')
    got = io.build_source(spark, "jsonl", str(tmp_path / "m.jsonl")).select("torque_nm", "_malformed").collect()
    assert got[0].torque_nm == 1.5 and got[1]._malformed.startswith("{broken")
    with pytest.raises(ValueError):
        io.build_source(spark, "mqtt", "x")
    wide = io.tag_map(spark.createDataFrame([("m", 1, "T1", 5.0), ("m", 1, "X", 9.0), ("m", 1, "S1", 7.0)], "machine_id string, t int, tag string, value double"), {"T1": "torque_nm", "S1": "rotational_speed_rpm"}).first()
    assert (wide.torque_nm, wide.rotational_speed_rpm) == (5.0, 7.0)
    (tmp_path / "wo.csv").write_text("cycle,asset,work_type,found_fault,mode,wo\n5,m1,corrective,Yes,HDF,a\nx,m1,corrective,1,HDF,b\n")
    w = io.read_work_orders(spark, str(tmp_path / "wo.csv")).collect()
    assert len(w) == 1 and w[0].at == 5 and w[0].found_fault


def test_intake_verdicts_in_order():
    i = intake.Intake()
    assert i.offer(100.0, 101.0, 1) == ("accepted", False)
    assert i.offer(100.0, 101.0, 1)[0] == "duplicate"
    assert i.offer(200.0, 101.0, 2)[0] == "future"
    for k in range(20):
        assert i.offer(110.0 + 10 * k, 111.0 + 10 * k, 10 + k)[0] == "accepted"
    assert i.offer(200.0, 301.0, 50)[0] == "too_late"
    assert i.offer(290.0, 301.0, 51)[0] == "accepted" and i.high == 300.0
    assert i.offer(400.0, 400.0, 52)[0] == "gap_before"
    assert i.offer(405.0, 900.0, 53) == ("accepted", True)
    assert i.offer(None, 406.0) == ("accepted", False) and i.offer(float("nan"), 407.0)[0] == "accepted" and i.high == 407.0


_MSG = "machine_id string, seq long, t double, now double, order double"


def _messages(n=400):
    rng, rows = random.Random(5), []
    for k in range(n):
        t = 1000.0 + 10 * k + (500 if k > 300 else 0)
        row = [f"m{k % 3}" if k % 17 else None, 2**60 + k if k % 5 else None, t if k % 11 else None, t + 1.0 + (400 if k % 37 == 0 else 0), float(k)]
        rows.append(tuple(row))
        if k % 13 == 0:
            rows.append((*row[:4], k + 0.5))
        if k % 29 == 0:
            rows.append((row[0], 5 * 10**9 + k, t - 300.0, t, k + 0.25))
    return rows


def test_intake_replay_matches_a_plain_loop(spark):
    rows = _messages()
    got = sorted((r.machine_id or "", r.seq or -1, r.t or -1.0, r.now, r.verdict, r.stale) for r in intake.replay(spark.createDataFrame(rows, _MSG)).collect())
    want = []
    for m in {r[0] for r in rows}:
        seen, high, last, steps = [], None, None, []
        for _, seq, t0, now, _ in sorted((r for r in rows if r[0] == m), key=lambda r: r[4]):
            t, verdict, stale = now if t0 is None else t0, "accepted", False
            key = seq if seq is not None else ("t", t)
            if m is None:
                verdict = "malformed"
            elif t > now + 5:
                verdict = "future"
            elif key in seen:
                verdict = "duplicate"
            else:
                seen.append(key)
                stale = now - t > 300
                if high is not None and high - t > 30:
                    verdict = "too_late"
                else:
                    if last is not None:
                        steps = (steps + [t - last] * (t > last))[-64:]
                        if len(steps) >= 8 and t - last > 3 * sorted(steps)[len(steps) // 2]:
                            verdict = "gap_before"
                    last, high = t, t if high is None else max(high, t)
            want.append((m or "", seq or -1, t0 or -1.0, now, verdict, stale))
    assert got == sorted(want)
    s = {r.machine_id: r for r in intake.stats(intake.replay(spark.createDataFrame(rows, _MSG))).collect()}
    assert s[None].malformed == s[None].messages and s["m1"].accepted == sum(w[0] == "m1" and w[4] in ("accepted", "gap_before") for w in want)


def test_streamed_intake_equals_replay(spark, tmp_path):
    df = spark.createDataFrame(_messages(), _MSG)
    df.repartition(1).sortWithinPartitions("order").write.parquet(str(tmp_path / "in"))
    q = intake.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("taken").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(spark.table("taken")) == key(intake.replay(df))


def test_observer_tells_its_channels(spark):
    rng, c = random.Random(1), scorer.Channel()
    assert not {"frozen", "untracked", "unavailable"} & {c.observe(300 + rng.gauss(0, 1)) for _ in range(400)}
    assert "frozen" in [c.observe(301.0) for _ in range(40)]
    gone = [c.observe(None) for _ in range(70)]
    assert gone[:3] == ["missing"] * 3 and set(gone[3:]) == {"lost"}
    c = scorer.Channel()
    for _ in range(200):
        c.observe(rng.gauss(0, 1))
    assert c.observe(25.0) == "jump" and abs(c.level) < 5 and c.age == 1
    assert "untracked" in [c.observe(25.0 + rng.gauss(0, 1)) for _ in range(6)]
    c = scorer.Channel()
    for _ in range(200):
        c.observe(rng.gauss(0, 1))
    some = [c.observe(rng.gauss(0, 1) if k % 10 else None) for k in range(200)]
    assert "intermittent" in some and "unavailable" not in some
    few = [c.observe(rng.gauss(0, 1) if k % 3 else None) for k in range(200)]
    assert "unavailable" in few
    assert c.half_width("ok", "torque_nm") == 2 * scorer.DECLARED["torque_nm"] and c.half_width("frozen", "torque_nm") == 10 * math.sqrt(c.r)
    assert scorer.Channel().half_width("learning", "torque_nm") == scorer.WIDE["torque_nm"]
    steps = scorer.Channel()
    for k in range(60):
        steps.observe(float(k // 2))
    assert steps.repeat_limit > 5  # every second reading repeats


def _reading(rng, **other):
    t = rng.gauss(40, 6)
    row = {"air": 300 + rng.gauss(0, 0.3), "proc": 310 + rng.gauss(0, 0.3), "rpm": 1540 - 16 * (t - 40) + rng.gauss(0, 30), "torque": t, "wear": 10.0}
    return tuple((row | other).values())


def test_faults_are_told_apart():
    rng, m = random.Random(3), scorer.Machine()
    rules = scorer.Rules.of(MILLING, "L")
    wear = iter(range(1000))
    first = [m.score(_reading(rng, wear=0.1 * next(wear)), rules) for _ in range(150)]
    assert first[0][2] == "warming" and first[0][3] == "instrument" and first[-1][2:4] == ("ok", "none")
    hot = [m.score(_reading(rng, wear=0.1 * next(wear), air=295.0 + rng.gauss(0, 0.3), proc=315.0 + rng.gauss(0, 0.3)), rules) for _ in range(3)]
    assert any(r[3] == "model" for r in hot) and sum("SENSOR_SUSPECT" in r[5] for r in hot) <= 1
    calm = [m.score(_reading(rng, wear=0.1 * next(wear)), rules) for _ in range(120)]
    assert calm[-1][2] == "ok"
    changes = m.tool_changes
    assert m.score(_reading(rng, wear=0.0), rules)[3] == "none" and m.tool_changes == changes + 1
    m.score(_reading(rng, wear=50.0), rules)
    assert m.score(_reading(rng, wear=20.0), rules)[3] == "model"
    blind = m.score(_reading(rng, torque=None, wear=20.0), rules)
    assert blind[0] is None and blind[1] == "abstain" and blind[2] == "blind"


def test_interval_verdicts_of_the_stream_agree_with_the_batch(spark, sf):
    """At the declared accuracies the scorer's rules say what the column version says."""
    o = observations(spark, sf)
    batch = {r.udi: r for r in physics.interval_verdicts(o, MILLING).collect()}
    h = physics.ACCURACY
    for r in o.collect():
        rules = scorer.Rules.of(MILLING, r.product_type)
        v = [r[c] for c in scorer.CHANNELS]
        e = [h[c] for c in scorer.CHANNELS]
        low = scorer._metrics(v[0] + e[0], v[1] - e[1], v[2] - e[2], v[3] - e[3], max(v[4] - e[4], 0.0))
        high = scorer._metrics(v[0] - e[0], v[1] + e[1], v[2] + e[2], v[3] + e[3], v[4] + e[4])
        firing, unsure = rules.verdicts(low, high)
        said = {n: "alert" if n in firing else "abstain" if n in unsure else "safe" for n in ("HDF", "PWF", "OSF")}
        assert said == {n: batch[r.udi][n.lower()] for n in said}
        assert min(rules.distances(scorer._metrics(*v)).values()) == pytest.approx(r.worst_margin)


def test_ledger_of_streams(spark, tmp_path):
    from tidemark.streaming import ledger

    a = spark.createDataFrame([("m1", "HDF", "2024-01-01 00:00:00"), ("m1", "OSF", "2024-01-01 01:00:00"), ("m2", "HDF", "2024-01-01 00:00:00"), ("m9", "X", "2024-01-02 00:00:00")], "machine_id string, mode string, raised string")
    o = spark.createDataFrame([("m1", "2024-01-01 00:05:00"), ("m1", "2024-01-01 00:09:00"), ("m2", "2024-01-01 00:30:00"), ("m9", "2024-01-03 00:00:00")], "machine_id string, failed string")
    batch = ledger.ledger(a, o)
    assert {(r.mode, r.alerts, r.correct) for r in ledger.score(batch).collect()} == {("HDF", 2, 1), ("OSF", 1, 0), ("X", 1, 0)}
    for n, d in (("a", a), ("o", o)):
        d.write.json(str(tmp_path / n))
    s = ledger.ledger(spark.readStream.schema(a.schema).json(str(tmp_path / "a")), spark.readStream.schema(o.schema).json(str(tmp_path / "o")))
    q = io.append_stream(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in batch.collect()}
    assert {r for r in want if r[3]} <= got <= want


def test_one_regime_in_steady_data():
    rng, r = random.Random(2), scorer.Regimes()
    seen = {r.track((rng.gauss(1540, 100), rng.gauss(40, 6), rng.gauss(10, 0.6))) for _ in range(500)}
    assert seen == {-1, 0}
    assert {r.track((2500 + rng.gauss(0, 50), 15 + rng.gauss(0, 2), 10.0)) for _ in range(60)} >= {1}


def test_streaming_equals_replay(spark, sf, tmp_path):
    o = observations(spark, sf).select(*scorer._IN)
    o.repartition(1).sortWithinPartitions("udi").write.parquet(str(tmp_path / "in"))
    q = scorer.stream(spark.readStream.schema(o.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    a = sorted(map(tuple, spark.table("scored").collect()))
    assert a == sorted(map(tuple, scorer.replay(o).collect())) and len(a) == o.count()


def test_dedupe_and_tiles_stream(spark, sf):
    o = observations(spark, sf).select("machine_id", "udi", "ts", "worst_margin")
    twice = o.unionByName(o)
    assert scorer.deduplicated(twice).count() == o.count()
    hourly, daily = scorer.tiles(o), scorer.tiles(o, "1 day")
    assert sorted(map(tuple, scorer.rolled(hourly).collect())) == sorted(map(tuple, daily.collect()))


def test_values_that_are_missing_fire_nowhere(spark):
    """Null and NaN metrics, null outcomes and null keys, against plain versions."""
    rows = [(i, float(i % 10) if i >= 5 else None, int(i < 5 or i % 10 >= 8) if i != 17 else None) for i in range(60)] + [(60, float("nan"), 1)]
    df = spark.createDataFrame(rows, "udi bigint, x double, y int")
    real = [(x, y) for _, x, y in rows if x is not None and not math.isnan(x) and y is not None]

    def f1(cut, side):
        hit = [y for x, y in real if (x < cut if side == "<" else x > cut)]
        return 2.0 * sum(hit) / (len(hit) + sum(y for _, y in real))

    values = sorted({x for x, _ in real})
    want = max((f1((a + b) / 2, s), -(a + b) / 2) for a, b in zip(values, values[1:]) for s in "<>")
    got = rel.best_split(df, ("x",), "y").first()
    assert (got.f1, got.cut) == pytest.approx((want[0], -want[1])) and (got.cut, got.f1, got.side) == (7.5, 1.0, ">")
    assert [r.cut for r in discovery.induce(spark.createDataFrame(rows * 3, "udi bigint, x double, y int"), ("x",), "y").collect()] == [7.5]
    leaves = discovery.grow(df, ("x",), F.col("y") == 1, depth=1, least=2)
    assert {t[0][2] for t, _, _ in leaves if t} == {7.5}
    c = spark.createDataFrame([("a", float(i)) for i in range(1, 41)] + [("a", None)] * 20 + [("a", float("nan"))], "g string, x double")
    r = rel.conformal(c, "x", "g").first()
    assert (r.n, r.lo, r.hi, r.valid) == (40, 2.0, 39.0, True)
    assert discovery.leave_one_out(c, "x", "g").first().n == 40
    k = spark.createDataFrame([(None, 1.0), (3, 3.0), (None, 9.0), (25, 5.0), (4, None), (26, 6.0)], "udi bigint, x double")
    got = rel.with_previous(k, "udi", ("x",), block=10).collect()
    assert sorted(((r.udi, r.x, r.x_prev) for r in got), key=str) == sorted([(None, 1.0, None), (None, 9.0, None), (3, 3.0, None), (4, None, 3.0), (25, 5.0, None), (26, 6.0, 5.0)], key=str)


def test_half_widths_follow_the_verdict():
    c = scorer.Channel()
    assert all(c.half_width(v, "torque_nm") == scorer.WIDE["torque_nm"] for v in ("learning", "frozen", "missing"))
    values = [40 + math.sin(i) for i in range(3 * scorer.WARMUP)]
    for i, x in enumerate(values):
        c.observe(x)
        if 4 <= i + 1 <= scorer.WARMUP:
            assert c.half_width("learning", "torque_nm") == pytest.approx(2 * float(np.std(values[: i + 1], ddof=1)))
    assert c.half_width("lost", "torque_nm") == 10 * math.sqrt(c.r) and c.half_width("drift", "torque_nm") == 2 * scorer.DECLARED["torque_nm"]
    c.observe(None)
    assert c.half_width("ok", "torque_nm") == pytest.approx(2 * math.sqrt(scorer.DECLARED["torque_nm"] ** 2 + c.q))
