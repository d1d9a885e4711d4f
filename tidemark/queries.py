"""The registered queries of the analysis engine, each with an independent DuckDB statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import core, discovery, physics, scans
from .operators import reliability as rel
from .plans import catalog, fused
from .plans.plan import Binning, Cohort, Filter, Plan
from .plans.process import MILLING as P
from .sources.sql import OBS, SALES
from .sources.tables import observations, sales, table
from .streaming import orders, watch

CAT = catalog.MILLING
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIVE = ("torque_nm", "rotational_speed_rpm", "tool_wear_min", "temp_delta_k", "power_w")
BASE = ("air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min")
FAILED = Cohort("failed", (Filter("failure", "eq", 1),))
HEALTHY = Cohort("healthy", (Filter("failure", "eq", 0),))


def rounded(df: DataFrame, dp: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[(F.round(c, dp) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])  # no negative zero


def _longs(sql: str) -> str:
    """DuckDB's count_if is a HUGEINT; a count is a BIGINT."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 0, i + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
            if not depth:
                break
        out += sql[at:i] + f"CAST({sql[i:j]} AS BIGINT)"
        at = j
    return out + sql[at:]


def query(name: str, sql: str | None = None, dp: int = 6):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda s, d: rounded(f(s, d), dp)
        if sql:
            ORACLES[name] = _longs(sql)
        return f

    return add


def r(*exprs: str, dp: int = 6) -> str:
    """'x AS y' items rounded."""
    out = []
    for e in exprs:
        x, _, y = e.rpartition(" AS ")
        out.append(f"round({x or y}, {dp}) + 0e0 AS {y}")
    return ", ".join(out)


def _wilson(k: str = "failures", n: str = "n") -> str:
    z = "1.959963984540054e0"
    p = f"(CAST({k} AS DOUBLE) / {n})"
    mid = f"({p} + {z}*{z}/(2e0*{n}))"
    half = f"({z} * sqrt({p}*(1e0-{p})/{n} + {z}*{z}/(4e0*{n}*{n})))"
    den = f"(1e0 + {z}*{z}/{n})"
    return f"round(100e0*greatest(({mid}-{half})/{den}, 0e0), 6) AS ci_lo, round(100e0*least(({mid}+{half})/{den}, 1e0), 6) AS ci_hi"


_QUALITY = "CASE WHEN n = 0 THEN 'abstain' WHEN n < 30 THEN 'low_sample' ELSE 'ok' END AS quality"


def _rate_sql(groups: str) -> str:
    """groups: a query with grp, ord, y."""
    return f"{OBS}, g AS ({groups}), a AS (SELECT grp, min(ord) AS ord, CAST(sum(y) AS BIGINT) AS failures, count(*) AS n FROM g GROUP BY grp) SELECT grp, CAST(ord AS INT) AS ord, failures, n, round(100e0 * failures / n, 6) AS rate, {_wilson()}, {_QUALITY} FROM a"


# frame

_FRAME = ["air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min", "temp_delta_k", "power_w", "overstrain_min_nm", "hdf_margin_0", "hdf_margin_1", "pwf_margin_0", "pwf_margin_1", "osf_margin", "hdf_distance", "pwf_distance", "osf_distance", "worst_margin"]
_FLAGS = ["udi", "product_type", "machine_id", "shift", "hdf_rule", "pwf_rule", "osf_rule", "twf_rule", "hdf", "pwf", "osf", "twf", "rnf", "machine_failure"]


@query("frame_observations", f"{OBS} SELECT {', '.join(_FLAGS)}, {r(*_FRAME)} FROM obs")
def _(s, d):
    return observations(s, d).select(*_FLAGS, *_FRAME)


@query("units_converted", f"{OBS} SELECT udi, {r('air_temperature_k - 273.15e0 AS air_c', 'rotational_speed_rpm * 2e0 * pi() / 60e0 AS speed_rad_s', 'torque_nm / 1.3558179483314004e0 AS torque_lbf_ft', 'power_w / 1000e0 AS power_kw', 'tool_wear_min / 60e0 AS wear_h')} FROM obs")
def _(s, d):
    from .functions.units import convert

    c = F.col
    return observations(s, d).select("udi", convert(c("air_temperature_k"), "K", "°C").alias("air_c"), convert(c("rotational_speed_rpm"), "rpm", "rad/s").alias("speed_rad_s"), convert(c("torque_nm"), "N·m", "lbf·ft").alias("torque_lbf_ft"), convert(c("power_w"), "W", "kW").alias("power_kw"), convert(c("tool_wear_min"), "min", "h").alias("wear_h"))


@query("frame_fingerprint", f"{OBS} SELECT count(*) AS n, sha256(concat(CAST(count(*) AS VARCHAR), ':', CAST(CAST(floor(sum(torque_nm * 10e0) + 0.5e0) AS BIGINT) AS VARCHAR), ':', CAST(CAST(sum(tool_wear_min) AS BIGINT) AS VARCHAR))) AS fingerprint FROM obs")
def _(s, d):
    a = observations(s, d).agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(F.col("torque_nm") * 10.0) + 0.5).cast("string").alias("t"), F.sum("tool_wear_min").cast("bigint").cast("string").alias("w"))
    return a.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "t", "w"), 256).alias("fingerprint"))


# describe


def _describe_sql(metrics: tuple[str, ...], cohorts: dict[str, str]) -> str:
    parts = [f"SELECT '{c}' AS cohort, '{m}' AS metric, CAST({CAT.column(m)} AS DOUBLE) AS x FROM obs WHERE {w}" for c, w in cohorts.items() for m in metrics]
    return f"""{OBS}, l AS ({' UNION ALL '.join(parts)}),
a AS (SELECT cohort, metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS mi, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS ma FROM l GROUP BY ALL)
SELECT cohort, metric, n, {r('mean', 'mean - CASE WHEN n > 1 AND sd > 0 THEN 1.959963984540054e0 * sd / sqrt(n) ELSE 0 END AS ci_lo', 'mean + CASE WHEN n > 1 AND sd > 0 THEN 1.959963984540054e0 * sd / sqrt(n) ELSE 0 END AS ci_hi', 'sd', 'mi AS min', 'p25', 'median', 'p75', 'ma AS max')}, {_QUALITY} FROM a"""


@query("describe_all", _describe_sql(("air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min", "power_w"), {"all": "true"}))
def _(s, d):
    return core.execute(observations(s, d), Plan("describe", ("air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min", "power_w")), CAT)


@query("describe_cohorts", _describe_sql(FIVE, {"failed": "machine_failure = 1", "healthy": "machine_failure = 0"}))
def _(s, d):
    return core.execute(observations(s, d), Plan("describe", FIVE, cohorts=(FAILED, HEALTHY)), CAT)


# rate


@query("rate_overall", _rate_sql("SELECT 'all' AS grp, 0 AS ord, machine_failure AS y FROM obs"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate"), CAT)


@query("rate_by_variant", _rate_sql("SELECT product_type AS grp, 0 AS ord, machine_failure AS y FROM obs"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", group_by=("product_type",)), CAT)


@query("rate_two_dims", _rate_sql("SELECT product_type || '/' || shift AS grp, 0 AS ord, machine_failure AS y FROM obs"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", group_by=("product_type", "shift")), CAT)


@query("rate_by_machine", _rate_sql("SELECT machine_id AS grp, 0 AS ord, machine_failure AS y FROM obs"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", group_by=("machine_id",)), CAT)


@query("rate_rollup", _rate_sql("SELECT product_type AS grp, 0 AS ord, machine_failure AS y FROM obs UNION ALL SELECT 'overall', 0, machine_failure FROM obs"))
def _(s, d):
    return core.rate(observations(s, d), Plan("rate", group_by=("product_type",)).validated(CAT), CAT, rollup=True)


_GRAIN = {"hour": "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M')", "day": "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M')", "shift": "strftime(ts, '%Y-%m-%d') || '-' || shift"}


@query("rate_by_day", _rate_sql(f"SELECT {_GRAIN['day']} AS grp, 0 AS ord, machine_failure AS y FROM obs"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", grain="day"), CAT)


def _binned(col: str, edges_sql: str, n: int, fmt: str) -> str:
    """Rows with bin number and label, bins found by counting the inner edges at or below the value."""
    return f"""SELECT CASE WHEN {col} IS NULL OR {col} < e[1] OR {col} > e[len(e)] THEN 'out_of_range' ELSE printf('{fmt}-{fmt}', e[b], e[b + 1]) END AS grp,
  CASE WHEN {col} IS NULL OR {col} < e[1] OR {col} > e[len(e)] THEN len(e) - 1 ELSE b - 1 END AS ord, machine_failure AS y, *
FROM (SELECT *, least(greatest(len(list_filter(e, lambda v: v <= {col})), 1), len(e) - 1) AS b FROM obs, ({edges_sql}))"""


_Q5 = "SELECT list_sort(list_distinct(quantile_cont(rotational_speed_rpm, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM obs"
_W6 = "SELECT [lo + (hi - lo) * i / 6e0 FOR i IN range(7)] AS e FROM (SELECT min(torque_nm) AS lo, max(torque_nm) AS hi FROM obs)"
_X4 = "SELECT [0e0, 60e0, 120e0, 180e0, 240e0] AS e"
BIN_Q, BIN_W, BIN_X = Binning("quantile", 5), Binning("width", 6), Binning("explicit", (0.0, 60.0, 120.0, 180.0, 240.0))


def _bin_rate(edges: str, col: str, fmt: str) -> str:
    return _rate_sql(f"SELECT grp, ord, y FROM ({_binned(col, edges, 0, fmt)})")


@query("rate_bin_quantile", _bin_rate(_Q5, "rotational_speed_rpm", "%.0f"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", axis="rotational_speed_rpm", binning=BIN_Q), CAT)


@query("rate_bin_width", _bin_rate(_W6, "torque_nm", "%.1f"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", axis="torque_nm", binning=BIN_W), CAT)


@query("rate_bin_explicit", _bin_rate(_X4, "tool_wear_min", "%.0f"))
def _(s, d):
    return core.execute(observations(s, d), Plan("rate", axis="tool_wear_min", binning=BIN_X), CAT)


_SHAPE = """, q AS (SELECT *, lag(rate) OVER (ORDER BY ord) AS prev, row_number() OVER (ORDER BY ord) AS i, count(*) OVER () AS k FROM base WHERE grp <> 'out_of_range'),
m AS (SELECT max(k) AS n_groups, max(CASE WHEN i = 1 THEN rate END) AS f, max(CASE WHEN i = k THEN rate END) AS l, min(rate) AS lo, max(CASE WHEN i > 1 AND i < k THEN rate END) AS hi, bool_and(prev IS NULL OR rate >= prev) AS up, bool_and(prev IS NULL OR rate <= prev) AS down FROM q)
SELECT n_groups, CASE WHEN n_groups < 3 THEN 'undetermined' WHEN up THEN 'increases' WHEN down THEN 'decreases' WHEN least(f, l) > 1.05e0 * lo THEN 'U-shaped' WHEN hi > 1.05e0 * greatest(f, l) THEN 'peaked in the middle' ELSE 'non-monotonic' END AS shape,
round(f, 6) AS first_rate, round(l, 6) AS last_rate, round(CASE WHEN l <> 0 THEN f / l END, 6) AS low_high_ratio FROM m"""


def _as_base(rate_sql: str, rest: str) -> str:
    """rate_sql's last SELECT becomes the table base."""
    head, _, tail = rate_sql.rpartition(" SELECT grp, CAST(ord AS INT)")
    return f"{head}, base AS (SELECT grp, CAST(ord AS INT){tail}){rest}"


@query("premise_shape", _as_base(_bin_rate(_Q5, "rotational_speed_rpm", "%.0f"), _SHAPE))
def _(s, d):
    return core.premise_shape(rounded(core.execute(observations(s, d), Plan("rate", axis="rotational_speed_rpm", binning=BIN_Q), CAT)))


@query("premise_rank", _as_base(_rate_sql("SELECT product_type AS grp, 0 AS ord, machine_failure AS y FROM obs"), """, q AS (SELECT grp, rate, row_number() OVER (ORDER BY rate DESC, grp) AS rank, count(*) OVER () AS groups FROM base)
SELECT grp AS subject, rate AS subject_rate, (SELECT grp FROM q WHERE rank = 1) AS highest_group, (SELECT max(rate) FROM q) AS highest_rate, rank, groups, CASE WHEN rank = 1 THEN 'supported' ELSE 'refuted' END AS verdict, round((SELECT max(rate) FROM q) / rate, 6) AS ratio FROM q WHERE grp = 'L'"""))
def _(s, d):
    return core.premise_rank(rounded(core.execute(observations(s, d), Plan("rate", group_by=("product_type",)), CAT)), "L")


@query("ranking_permutation")
def _(s, d):
    return core.ranking_test(core.execute(observations(s, d), Plan("rate", group_by=("machine_id",)), CAT))


@query("rate_ratio", f"""{OBS}, a AS (SELECT sum(CASE WHEN product_type = 'L' THEN machine_failure END) AS ka, count_if(product_type = 'L') AS na, sum(CASE WHEN product_type = 'H' THEN machine_failure END) AS kb, count_if(product_type = 'H') AS nb FROM obs)
SELECT {r('CAST(ka AS DOUBLE) / na AS rate_a', 'CAST(kb AS DOUBLE) / nb AS rate_b', '(CAST(ka AS DOUBLE) / na) / nullif(CAST(kb AS DOUBLE) / nb, 0) AS ratio', 'CAST(ka AS DOUBLE) / na - CAST(kb AS DOUBLE) / nb AS difference')} FROM a""")
def _(s, d):
    ina, inb = F.col("product_type") == "L", F.col("product_type") == "H"
    a = observations(s, d).agg(F.avg(F.when(ina, F.col("machine_failure").cast("double"))).alias("rate_a"), F.avg(F.when(inb, F.col("machine_failure").cast("double"))).alias("rate_b"))
    return a.select("rate_a", "rate_b", F.try_divide("rate_a", "rate_b").alias("ratio"), (F.col("rate_a") - F.col("rate_b")).alias("difference"))


# compare, drivers, correlations


def _compare_sql(select: str, metrics: tuple[str, ...] = FIVE, rest: str = "") -> str:
    parts = [f"SELECT '{m}' AS metric, machine_failure AS f, CAST({CAT.column(m)} AS DOUBLE) AS x FROM obs" for m in metrics]
    return f"""{OBS}, l AS ({' UNION ALL '.join(parts)}),
a AS (SELECT metric, count(x) FILTER (f = 1) AS a_n, avg(x) FILTER (f = 1) AS a_mean, stddev_samp(x) FILTER (f = 1) AS a_sd, count(x) FILTER (f = 0) AS b_n, avg(x) FILTER (f = 0) AS b_mean, stddev_samp(x) FILTER (f = 0) AS b_sd FROM l GROUP BY metric),
c AS (SELECT *, CASE WHEN a_n >= 2 AND b_n >= 2 AND (a_n - 1) * a_sd * a_sd + (b_n - 1) * b_sd * b_sd > 0 THEN (a_mean - b_mean) / sqrt(((a_n - 1) * a_sd * a_sd + (b_n - 1) * b_sd * b_sd) / (a_n + b_n - 2)) ELSE 0 END AS d FROM a),
e AS (SELECT *, 1.959963984540054e0 * sqrt((a_n + b_n) / CAST(a_n * b_n AS DOUBLE) + d * d / (2e0 * (a_n + b_n))) AS h FROM c){rest} {select}"""


@query("compare_cohorts", _compare_sql(f"SELECT metric, a_n, b_n, {r('a_mean', 'a_sd', 'b_mean', 'b_sd', 'a_mean - b_mean AS delta', 'd', 'd - h AS d_lo', 'd + h AS d_hi')}, CASE WHEN abs(d) < 0.2e0 THEN 'negligible' WHEN abs(d) < 0.5e0 THEN 'small' WHEN abs(d) < 0.8e0 THEN 'medium' ELSE 'large' END AS magnitude FROM e"))
def _(s, d):
    return core.execute(observations(s, d), Plan("compare", FIVE, cohorts=(FAILED, HEALTHY)), CAT)


_DRIVERS = ("air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min", "temp_delta_k", "power_w", "overstrain_min_nm")


@query("drivers_rank", _compare_sql(f"SELECT row_number() OVER (ORDER BY abs(d) DESC, metric) AS position, metric, {r('d AS separation', 'a_mean', 'b_mean')}, CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END AS direction, d - h > 0 OR d + h < 0 AS significant, a_n < 2 OR b_n < 2 AS abstain FROM e", _DRIVERS))
def _(s, d):
    return core.execute(observations(s, d), Plan("drivers", _DRIVERS, cohorts=(FAILED, HEALTHY)), CAT)


@query("corr_pairs", f"{OBS} " + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r, abs(corr({x}, {y})) >= 0.7e0 AS collinear FROM obs" for i, x in enumerate(FIVE) for y in FIVE[i + 1 :]))
def _(s, d):
    return core.execute(observations(s, d), Plan("correlations", FIVE), CAT)


# trend

_TREND_A = "SELECT grp AS bucket, row_number() OVER (ORDER BY min(ord), grp) - 1 AS i, count(*) AS n, CAST(sum(y) AS BIGINT) AS failures, 100e0 * sum(y) / count(*) AS failure_rate, avg(power_w) AS power_w FROM g WHERE grp <> 'out_of_range' GROUP BY grp"
_TREND_B = f"{OBS}, g AS ({{g}}), t AS ({_TREND_A})"
_T = "SELECT bucket, i, n, failures, round(failure_rate, 6) AS failure_rate, round(power_w, 6) AS power_w FROM t"
_WEAR = _binned("tool_wear_min", _X4, 0, "%.0f")


@query("trend_metric_axis", _TREND_B.format(g=_WEAR) + _T)
def _(s, d):
    return core.execute(observations(s, d), Plan("trend", ("power_w",), axis="tool_wear_min", binning=BIN_X), CAT)


def _grain_rows(g: str) -> str:
    return f"SELECT {_GRAIN[g]} AS grp, 0 AS ord, machine_failure AS y, power_w FROM obs"


def _trend_by(grain: str) -> None:
    @query(f"trend_{grain}", _TREND_B.format(g=_grain_rows(grain)) + _T)
    def _(s, d):
        return core.execute(observations(s, d), Plan("trend", ("power_w",), grain=grain), CAT)


for _g in ("hour", "day", "shift"):
    _trend_by(_g)


@query("trend_slope", _TREND_B.format(g=_grain_rows("day")) + """, a AS (SELECT count(*) AS n, regr_slope(failure_rate, i) AS s, regr_sxx(failure_rate, i) AS sxx, regr_syy(failure_rate, i) AS syy, regr_sxy(failure_rate, i) AS sxy, max(failure_rate) - min(failure_rate) AS span, avg(abs(failure_rate)) AS size FROM t),
b AS (SELECT *, 1.959963984540054e0 * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS h FROM a)
SELECT n, round(s, 6) AS slope, round(s - h, 6) AS ci_lo, round(s + h, 6) AS ci_hi, CASE WHEN s - h > 0 THEN 'rising' WHEN s + h < 0 THEN 'falling' WHEN span > size THEN 'not well described by a straight line' ELSE 'flat' END AS direction FROM b""")
def _(s, d):
    return core.slope(core.execute(observations(s, d), Plan("trend", ("power_w",), grain="day"), CAT), "failure_rate")


@query("trend_changepoint", _TREND_B.format(g=_WEAR.replace("[0e0, 60e0, 120e0, 180e0, 240e0]", "[i * 25e0 FOR i IN range(11)]")) + """, s AS (SELECT a.bucket, a.i, (SELECT avg(failure_rate) FROM t b WHERE b.i >= a.i) - (SELECT avg(failure_rate) FROM t b WHERE b.i < a.i) AS shift FROM t a WHERE a.i >= 2 AND a.i < (SELECT count(*) FROM t) - 1 AND (SELECT count(*) FROM t) >= 6)
SELECT bucket AS at, i, round(shift, 6) AS shift FROM s WHERE abs(shift) / (SELECT max(failure_rate) - min(failure_rate) FROM t) >= 0.4e0 ORDER BY abs(shift) DESC, i LIMIT 1""")
def _(s, d):
    b = Binning("explicit", tuple(25.0 * i for i in range(11)))
    return core.changepoint(core.execute(observations(s, d), Plan("trend", ("power_w",), axis="tool_wear_min", binning=b), CAT), "failure_rate")


# filters, records, free SQL

_FILTERS = [("eq", "product_type", "eq", "L", "product_type = 'L'"), ("ne", "product_type", "ne", "L", "product_type <> 'L'"), ("lt", "torque_nm", "lt", 30.0, "torque_nm < 30e0"), ("le", "tool_wear_min", "le", 20.0, "tool_wear_min <= 20e0"), ("gt", "power_w", "gt", 7000.0, "power_w > 7000e0"), ("ge", "tool_wear_min", "ge", 200.0, "tool_wear_min >= 200e0"), ("between", "torque_nm", "between", (35.0, 45.0), "torque_nm BETWEEN 35e0 AND 45e0"), ("in", "shift", "in", ["A", "C"], "shift IN ('A', 'C')"), ("is_null", "machine_id", "is_null", False, "machine_id IS NOT NULL")]


@query("filter_ops", f"{OBS} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n, CAST(coalesce(sum(machine_failure), 0) AS BIGINT) AS failures FROM obs WHERE {w}" for n, *_, w in _FILTERS))
def _(s, d):
    """All filters in one scan."""
    conds = {n: Filter(f, op, v).column(CAT) for n, f, op, v, _ in _FILTERS}
    a = observations(s, d).agg(*[x for n, c in conds.items() for x in (F.count_if(c).alias(f"{n}_n"), F.coalesce(F.sum(F.when(c, F.col("machine_failure"))), F.lit(0)).cast("bigint").alias(f"{n}_k"))])
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_k").alias("failures")) for n in conds])).alias("x")).select("x.*")


_UNITS = [("warm_air", "air_temp_k", "gt", 27.0, "°C", "air_temperature_k > 27e0 + 273.15e0"), ("strong", "power_w", "ge", 7.0, "kW", "power_w >= 7000e0"), ("fast", "rotational_speed_rpm", "between", (150.0, 160.0), "rad/s", "rotational_speed_rpm BETWEEN 150e0 / (2e0 * pi() / 60e0) AND 160e0 / (2e0 * pi() / 60e0)"), ("worn", "tool_wear_min", "ge", 2.0, "h", "tool_wear_min >= 120e0"), ("small_delta", "temp_delta_k", "lt", 9.0, "Δ°C", "temp_delta_k < 9e0")]


@query("filter_units", f"{OBS} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n, CAST(coalesce(sum(machine_failure), 0) AS BIGINT) AS failures FROM obs WHERE {w}" for n, *_, w in _UNITS))
def _(s, d):
    """Literals in other units than the columns'."""
    conds = {n: Filter(f, op, v, u).column(CAT) for n, f, op, v, u, _ in _UNITS}
    a = observations(s, d).agg(*[x for n, c in conds.items() for x in (F.count_if(c).alias(f"{n}_n"), F.coalesce(F.sum(F.when(c, F.col("machine_failure"))), F.lit(0)).cast("bigint").alias(f"{n}_k"))])
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_k").alias("failures")) for n in conds])).alias("x")).select("x.*")


_REC = ["udi", "product_type", "machine_id", "machine_failure", "torque_nm", "rotational_speed_rpm", "worst_margin"]
_REC_SQL = f"SELECT udi, product_type, machine_id, machine_failure, {r('torque_nm', 'rotational_speed_rpm', 'worst_margin')} FROM obs"


@query("records_closest", f"{OBS} {_REC_SQL} ORDER BY obs.worst_margin, udi LIMIT 50")
def _(s, d):
    return core.records(observations(s, d), Plan("records", order="closest_to_failure").validated(CAT), CAT, _REC)


@query("records_recent", f"{OBS} {_REC_SQL} WHERE machine_failure = 1 ORDER BY ts DESC, udi LIMIT 25")
def _(s, d):
    return core.records(observations(s, d), Plan("records", filters=(Filter("failure", "eq", 1),), order="most_recent", limit=25).validated(CAT), CAT, _REC)


@query("explore_sql", f"{OBS} SELECT machine_id, count(*) AS n, round(avg(power_w), 6) AS p FROM obs GROUP BY machine_id HAVING count(*) > 10")
def _(s, d):
    return core.explore(observations(s, d), "SELECT machine_id, count(*) AS n, avg(power_w) AS p FROM observations GROUP BY machine_id HAVING count(*) > 10")


@query("explore_sets", f"{OBS} SELECT product_type, shift FROM obs WHERE torque_nm > 50 EXCEPT SELECT product_type, shift FROM obs WHERE torque_nm < 22 AND shift = 'A' UNION SELECT 'all', NULL")
def _(s, d):
    """Set operations and a common table expression through the free query."""
    return core.explore(observations(s, d), "WITH o AS (SELECT * FROM observations) SELECT product_type, shift FROM o WHERE torque_nm > 50 EXCEPT SELECT product_type, shift FROM o WHERE torque_nm < 22 AND shift = 'A' UNION SELECT 'all', NULL")


# physics

_FIRED = "concat_ws(' + ', CASE WHEN hdf_rule THEN 'HDF' END, CASE WHEN pwf_rule THEN 'PWF' END, CASE WHEN osf_rule THEN 'OSF' END, CASE WHEN twf = 1 THEN 'TWF' END)"
_CLOSEST = "CASE WHEN hdf_distance = worst_margin THEN 'HDF' WHEN osf_distance = worst_margin THEN 'OSF' ELSE 'PWF' END"


@query("root_cause_rows", f"""{OBS} SELECT udi, product_type, machine_failure, CASE WHEN {_FIRED} <> '' THEN {_FIRED} WHEN machine_failure = 1 THEN 'cause_undetermined' ELSE 'healthy' END AS verdict,
CAST(hdf_rule AS BIGINT) + CAST(pwf_rule AS BIGINT) + CAST(osf_rule AS BIGINT) + twf AS mode_count, {_CLOSEST} AS closest_rule, {r('worst_margin AS closest_distance', 'lim / torque_nm AS osf_crossing_wear', 'greatest(tool_wear_min - lim / torque_nm, 0e0) AS osf_exceeded_by')}, twf_rule AS twf_in_window, round(CASE WHEN twf_rule THEN 43e0 / 790e0 ELSE 0e0 END, 6) AS twf_probability, rnf = 1 AND machine_failure = 0 AS rnf_not_rolled_up, CASE product_type WHEN 'L' THEN 2e0 WHEN 'M' THEN 3e0 ELSE 5e0 END AS wear_rate FROM obs""")
def _(s, d):
    return physics.root_causes(observations(s, d), P)


@query("root_cause_cohort", f"""{OBS}, a AS (SELECT count(*) AS n, CAST(sum(machine_failure) AS BIGINT) AS failures, count_if(hdf_rule) AS hdf, count_if(pwf_rule) AS pwf, count_if(osf_rule) AS osf, CAST(sum(twf) AS BIGINT) AS twf, CAST(sum(rnf) AS BIGINT) AS rnf,
count_if(machine_failure = 1 AND NOT (hdf_rule OR pwf_rule OR osf_rule) AND twf = 0) AS orphans, count_if(CAST(hdf_rule AS INT) + CAST(pwf_rule AS INT) + CAST(osf_rule AS INT) + twf > 1) AS multi_mode, count_if(hdf_rule OR pwf_rule OR osf_rule) AS explained FROM obs)
SELECT *, CASE greatest(hdf, pwf, osf, twf) WHEN hdf THEN 'HDF' WHEN pwf THEN 'PWF' WHEN osf THEN 'OSF' ELSE 'TWF' END AS dominant, round(100e0 * explained / failures, 6) AS explained_share FROM a""")
def _(s, d):
    return physics.root_cause_summary(observations(s, d), P)


@query("counterfactual_torque_minus5", f"""{OBS}, c AS (SELECT *, greatest(torque_nm - 5e0, 0e0) AS t2 FROM obs),
k AS (SELECT *, t2 * rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE) AS p2, tool_wear_min * t2 AS s2 FROM c),
j AS (SELECT *, p2 < 3500e0 OR p2 > 9000e0 AS pwf2, s2 > lim AS osf2, hdf_rule OR pwf_rule OR osf_rule AS was, hdf_rule OR p2 < 3500e0 OR p2 > 9000e0 OR s2 > lim AS now_ FROM k)
SELECT count(*) AS n, count_if(hdf_rule) AS before_hdf, count_if(hdf_rule) AS after_hdf, count_if(pwf_rule) AS before_pwf, count_if(pwf2) AS after_pwf, count_if(osf_rule) AS before_osf, count_if(osf2) AS after_osf, count_if(was) AS before_any, count_if(now_) AS after_any,
count_if(was AND NOT now_) AS rescued, count_if(NOT was AND now_) AS newly_failing, {r('avg(p2 - power_w) AS shift_pwf_margin_0', 'avg(power_w - p2) AS shift_pwf_margin_1', 'avg(overstrain_min_nm - s2) AS shift_osf_margin')}, CASE WHEN count_if(now_) < count_if(was) THEN 'helps' WHEN count_if(now_) > count_if(was) THEN 'harms' ELSE 'no change' END AS verdict FROM j""")
def _(s, d):
    return physics.counterfactual(observations(s, d), P, torque_nm=-5.0)


_W = "(rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE))"
_CEIL = f"least(9000e0 / {_W}, coalesce(lim / nullif(tool_wear_min, 0), 1e308))"


@query("envelope_band", f"""{OBS}, b AS (SELECT *, 3500e0 / {_W} AS lo, {_CEIL} AS hi FROM obs)
SELECT udi, round(CASE WHEN lo <= hi THEN lo END, 6) AS torque_min, round(CASE WHEN lo <= hi THEN hi END, 6) AS torque_max, round(CASE WHEN lo <= hi THEN hi - lo END, 6) AS torque_width,
CASE WHEN lo > hi THEN 'infeasible' WHEN coalesce(lim / nullif(tool_wear_min, 0), 1e308) < 9000e0 / {_W} THEN 'overstrain' ELSE 'power' END AS binding_ceiling, lo <= hi AND torque_nm >= lo AND torque_nm <= hi AS inside, CASE WHEN temp_delta_k < 8.6e0 THEN 1380e0 END AS min_safe_speed FROM b""")
def _(s, d):
    return physics.envelope_points(observations(s, d), P)


@query("envelope_curve", f"""{OBS}, m AS (SELECT product_type, any_value(lim) AS lim, avg(tool_wear_min) AS wear FROM obs GROUP BY product_type), c AS (SELECT *, 1200e0 + i * (1600e0 / 11e0) AS rpm FROM m, (SELECT unnest(range(12)) AS i)),
b AS (SELECT *, 3500e0 / (rpm * 2e0 * pi() / 60e0) AS lo, least(9000e0 / (rpm * 2e0 * pi() / 60e0), lim / wear) AS hi FROM c)
SELECT product_type, {r('rpm', 'CASE WHEN lo <= hi THEN lo END AS torque_min', 'CASE WHEN lo <= hi THEN hi END AS torque_max')} FROM b""")
def _(s, d):
    return physics.envelope_curve(observations(s, d), P)


_FIXES = (("torque_nm", "3500e0 * 1.02e0 / w", "torque_nm"), ("torque_nm", "9000e0 * 0.98e0 / w", "torque_nm"), ("torque_nm", "lim * 0.98e0 / nullif(tool_wear_min, 0)", "torque_nm"), ("rotational_speed_rpm", "1380e0 * 1.02e0", "rotational_speed_rpm"), ("rotational_speed_rpm", "3500e0 * 1.02e0 / kw / nullif(torque_nm, 0)", "rotational_speed_rpm"), ("rotational_speed_rpm", "9000e0 * 0.98e0 / kw / nullif(torque_nm, 0)", "rotational_speed_rpm"), ("tool_wear_min", "lim * 0.98e0 / nullif(torque_nm, 0)", "tool_wear_min"))


@query("envelope_fix", f"""{OBS}, bad AS (SELECT *, CAST(0.10471975511965977 AS DOUBLE) AS kw, rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE) AS w FROM obs WHERE hdf_rule OR pwf_rule OR osf_rule),
opt AS ({' UNION ALL '.join(f"SELECT udi, '{n}' AS variable, {v} AS v, {n} AS was, {'v' if n == 'torque_nm' else 'torque_nm'} AS t, {'v' if n == 'rotational_speed_rpm' else 'rotational_speed_rpm'} AS rp, {'v' if n == 'tool_wear_min' else 'tool_wear_min'} AS x, temp_delta_k, kw, lim FROM bad" for n, v, _ in _FIXES)}),
good AS (SELECT *, row_number() OVER (PARTITION BY udi ORDER BY abs(v / was - 1), variable, v - was, v) AS i FROM opt WHERE v >= 0 AND (variable <> 'tool_wear_min' OR v < was) AND NOT (temp_delta_k < 8.6e0 AND rp < 1380e0) AND t * rp * kw BETWEEN 3500e0 AND 9000e0 AND x * t <= lim)
SELECT bad.udi, g.variable, {r('g.v - g.was AS delta', 'g.v AS new_value')}, g.udi IS NOT NULL AS available FROM bad LEFT JOIN good g ON g.udi = bad.udi AND g.i = 1""")
def _(s, d):
    return physics.envelope_fix(observations(s, d), P)


def _point_sql(given: dict[str, str], where: str = "true") -> str:
    """The mean conditions, or the nominal ones, with what is given on top."""
    nominal = {"air_temperature_k": "300e0", "process_temperature_k": "310e0", "rotational_speed_rpm": "1500e0", "torque_nm": "40e0", "tool_wear_min": "0e0"}
    cols = {c: f"coalesce(avg({c}), {v})" for c, v in nominal.items()}
    if "air_temperature_k" in given:
        cols["process_temperature_k"] = f"{given['air_temperature_k']} + ({cols['process_temperature_k']} - {cols['air_temperature_k']})"
    cols |= {k: v for k, v in given.items() if k in cols}
    kind = given.get("product_type", "coalesce(min(product_type), 'L')")
    assumed = ",".join(c for c in nominal if c not in given)
    return f"""{OBS}, pt AS (SELECT {', '.join(f'{v} AS {c}' for c, v in cols.items())}, {kind} AS product_type, count(*) AS matched FROM obs WHERE {where}),
p2 AS (SELECT *, rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE) AS w, CASE product_type WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 ELSE 13000e0 END AS lim FROM pt),
p3 AS (SELECT *, 3500e0 / w AS lo, least(9000e0 / w, coalesce(lim / nullif(tool_wear_min, 0), 1e308)) AS hi, greatest((process_temperature_k - air_temperature_k - 8.6e0) / 8.6e0, (rotational_speed_rpm - 1380e0) / 1380e0) AS dh, least((torque_nm * w - 3500e0) / 3500e0, (9000e0 - torque_nm * w) / 9000e0) AS dp, (lim - torque_nm * tool_wear_min) / lim AS ds FROM p2)
SELECT product_type, {r(*nominal)}, matched, '{assumed}' AS assumed, {r('CASE WHEN lo <= hi THEN lo END AS torque_min', 'CASE WHEN lo <= hi THEN hi END AS torque_max')}, CASE WHEN lo > hi THEN 'infeasible' WHEN coalesce(lim / nullif(tool_wear_min, 0), 1e308) < 9000e0 / w THEN 'overstrain' ELSE 'power' END AS binding_ceiling, dh >= 0 AND dp >= 0 AND ds >= 0 AS safe, {r('least(dh, dp, ds) AS worst_margin')} FROM p3"""


@query("envelope_point", _point_sql({"tool_wear_min": "200e0"}, "product_type = 'M'"))
def _(s, d):
    """What torque is safe at 200 minutes of wear, on M machines as they run?"""
    return physics.envelope_at(observations(s, d).filter("product_type = 'M'"), P, {"tool_wear_min": 200})


@query("envelope_hypothetical", _point_sql({"air_temperature_k": "305e0", "rotational_speed_rpm": "1300e0", "product_type": "'L'"}, "udi < 0"))
def _(s, d):
    """A point that was never run: nominal conditions, a warm hall, a slow spindle, a variant that nobody knows."""
    return physics.envelope_at(observations(s, d).filter("udi < 0"), P, {"air_temperature_k": 305, "rotational_speed_rpm": 1300, "product_type": "x"})


@query("degenerate_margins", f"{OBS} SELECT count(*) AS n, " + ", ".join(f"count_if(abs({m}) <= 8e0 * 2.220446049250313e-16 * greatest({', '.join(f'abs({x})' for x in ops)})) AS {m}" for m, ops in (("hdf_margin_0", ("process_temperature_k", "air_temperature_k", "8.6e0")), ("hdf_margin_1", ("rotational_speed_rpm", "1380e0")), ("osf_margin", ("overstrain_min_nm", "lim")))) + " FROM obs")
def _(s, d):
    """How many margins have a sign that rounding decides."""
    from .plans.process import degenerate

    c, lit = F.col, F.lit
    limit = P.mode("OSF").terms[0].bound(c("product_type"))
    of = {"hdf_margin_0": (c("process_temperature_k"), c("air_temperature_k"), lit(8.6)), "hdf_margin_1": (c("rotational_speed_rpm"), lit(1380.0)), "osf_margin": (c("overstrain_min_nm"), limit)}
    return observations(s, d).agg(F.count(lit(1)).alias("n"), *[F.count_if(degenerate(c(m), *ops)).alias(m) for m, ops in of.items()])


@query("mode_regimes", "SELECT * FROM (VALUES ('HDF', 'exact'), ('PWF', 'exact'), ('OSF', 'exact'), ('TWF', 'statistical'), ('RNF', 'irreducible')) AS t(mode, regime)")
def _(s, d):
    return s.createDataFrame(P.regimes(), "mode string, regime string")


@query("forecast_overstrain", f"""{OBS}, g AS (SELECT product_type, any_value(lim) AS lim, avg(tool_wear_min) AS w, avg(torque_nm) AS t, stddev_samp(torque_nm) AS sg, CASE product_type WHEN 'L' THEN 2e0 WHEN 'M' THEN 3e0 ELSE 5e0 END AS rt FROM obs GROUP BY product_type),
k AS (SELECT *, lim - w * t AS margin, (lim - w * t) / (rt * t) AS mu FROM g), q AS (SELECT *, 1.959963984540054e0 * sqrt(mu * mu * mu / (margin * margin / (rt * sg * rt * sg))) AS h FROM k)
SELECT product_type, {r('margin', 'mu AS cycles', 'greatest(mu - h, 0) AS cycles_lo', 'mu + h AS cycles_hi', 'mu * 2e0 AS lead_min', 'lim / t AS crossing_wear', dp=5)}, CASE WHEN margin <= 0 THEN 'exceeded' WHEN mu < 10 THEN 'critical' ELSE 'running' END AS status FROM q""", dp=5)
def _(s, d):
    return physics.forecast_overstrain(observations(s, d), P)


_HZ = f"""{OBS}, hb AS (SELECT floor(tool_wear_min / 10e0) * 10e0 AS band_lo, count(*) AS n, CAST(sum(twf) AS BIGINT) AS k FROM obs WHERE tool_wear_min >= 180 AND tool_wear_min < 260 GROUP BY 1),
hw AS (SELECT a.band_lo AS a, b.band_lo AS b, sum(c.k) / CAST(sum(c.n) AS DOUBLE) AS m FROM hb a JOIN hb b ON b.band_lo >= a.band_lo JOIN hb c ON c.band_lo BETWEEN a.band_lo AND b.band_lo GROUP BY 1, 2),
hi AS (SELECT x.band_lo, max(lowest) AS hazard FROM hb x JOIN (SELECT a, i.band_lo AS at, min(m) AS lowest FROM hw JOIN hb i ON i.band_lo BETWEEN a AND b GROUP BY 1, 2) y ON y.at = x.band_lo GROUP BY 1)"""


@query("hazard_bands", _HZ + f", t AS (SELECT hb.band_lo, n, k, hazard FROM hb JOIN hi USING (band_lo)), u AS (SELECT *, {_wilson('k', 'n').replace('100e0*', '')} FROM t) SELECT {r('band_lo', 'k / CAST(n AS DOUBLE) AS rate', 'ci_lo', 'ci_hi', 'hazard')}, n, k FROM u")
def _(s, d):
    """The least-squares fit that never falls is, at each band, the largest over earlier starts of the smallest mean up to a later end."""
    return physics.hazard_bands(observations(s, d))


@query("hazard_of_rows", _HZ + f" SELECT udi, {r('tool_wear_min', 'floor(tool_wear_min / 10e0) * 10e0 AS band_lo', 'hazard')} FROM obs LEFT JOIN hi ON hi.band_lo = floor(tool_wear_min / 10e0) * 10e0")
def _(s, d):
    o = observations(s, d)
    return physics.hazard_at(o.select("udi", "tool_wear_min"), physics.hazard_bands(o))


@query("forecast_wearout", _HZ + f""", lt AS (SELECT machine_id, product_type, tool_wear_min, CASE product_type WHEN 'L' THEN 2e0 WHEN 'M' THEN 3e0 ELSE 5e0 END AS rt FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY udi DESC) AS rn FROM obs) WHERE rn = 1),
w AS (SELECT t.band_lo, t.n, t.hazard, {_wilson('t.k', 't.n').replace('100e0*', '')} FROM (SELECT hb.band_lo, hb.n, hb.k, hazard FROM hb JOIN hi USING (band_lo)) t),
j AS (SELECT lt.*, w.*, tool_wear_min >= 200 AND tool_wear_min < 240 AS inside, (240e0 - tool_wear_min) / rt AS lft, coalesce(hazard, 43e0 / 790e0) AS h FROM lt LEFT JOIN w ON w.band_lo = floor(tool_wear_min / 10e0) * 10e0)
SELECT machine_id, product_type, {r('tool_wear_min')}, CASE WHEN tool_wear_min >= 240 THEN 'past' WHEN inside THEN 'inside' ELSE 'before' END AS status, {r('CASE WHEN tool_wear_min < 200 THEN (200e0 - tool_wear_min) / rt END AS cycles_to_window', 'CASE WHEN tool_wear_min < 200 THEN 200e0 - tool_wear_min END AS wear_to_window', 'CASE WHEN inside THEN lft END AS cycles_left', 'CASE WHEN inside THEN h END AS per_cycle', 'CASE WHEN inside THEN ci_lo END AS per_cycle_lo', 'CASE WHEN inside THEN ci_hi END AS per_cycle_hi', 'CASE WHEN inside THEN 1 - pow(1 - h, lft) END AS cumulative')}, CASE WHEN inside THEN n END AS band_n FROM j""")
def _(s, d):
    o = observations(s, d)
    return physics.forecast_wearout(rel.fleet(o).select("machine_id", "product_type", "tool_wear_min"), P, physics.hazard_bands(o))


_PW = "* CAST(0.10471975511965977 AS DOUBLE)"


@query("interval_verdicts", f"""{OBS}, m AS (SELECT udi, (process_temperature_k - 0.5e0) - (air_temperature_k + 0.5e0) - 8.6e0 AS d0, (process_temperature_k + 0.5e0) - (air_temperature_k - 0.5e0) - 8.6e0 AS d1, rotational_speed_rpm - 1e0 - 1380e0 AS s0, rotational_speed_rpm + 1e0 - 1380e0 AS s1,
(torque_nm - 0.25e0) * (rotational_speed_rpm - 1e0) {_PW} AS p0, (torque_nm + 0.25e0) * (rotational_speed_rpm + 1e0) {_PW} AS p1, lim - (torque_nm + 0.25e0) * (tool_wear_min + 0.5e0) AS o0, lim - greatest(torque_nm - 0.25e0, 0e0) * greatest(tool_wear_min - 0.5e0, 0e0) AS o1 FROM obs),
v AS (SELECT udi, CASE WHEN d1 < 0 AND s1 < 0 THEN 'alert' WHEN d0 >= 0 OR s0 >= 0 THEN 'safe' ELSE 'abstain' END AS hdf, CASE WHEN p1 < 3500e0 OR p0 > 9000e0 THEN 'alert' WHEN p0 >= 3500e0 AND p1 <= 9000e0 THEN 'safe' ELSE 'abstain' END AS pwf, CASE WHEN o1 < 0 THEN 'alert' WHEN o0 >= 0 THEN 'safe' ELSE 'abstain' END AS osf FROM m)
SELECT *, CASE WHEN 'alert' IN (hdf, pwf, osf) THEN 'alert' WHEN 'abstain' IN (hdf, pwf, osf) THEN 'abstain' ELSE 'safe' END AS verdict FROM v""")
def _(s, d):
    return physics.interval_verdicts(observations(s, d), P)


# reliability


@query("data_quality", f"""{OBS} SELECT count(*) AS n, CAST(sum(machine_failure) AS BIGINT) AS failures, count_if(machine_failure = 1 AND hdf + pwf + osf + twf = 0) AS orphans, round(avg(worst_margin) FILTER (machine_failure = 1 AND hdf + pwf + osf + twf = 0), 6) AS orphan_margin, round(avg(worst_margin) FILTER (machine_failure = 0), 6) AS healthy_margin,
count_if(rnf = 1 AND machine_failure = 0) AS rnf_not_rolled_up, CAST(sum(twf) AS BIGINT) AS twf_flags, count_if(twf_rule) AS twf_window, """ + ", ".join(f"count_if({n}_rule AND {n} = 0) AS {n}_false_alarms, count_if(NOT {n}_rule AND {n} = 1) AS {n}_surprises" for n in ("hdf", "pwf", "osf")) + ", CASE WHEN count(*) = 0 THEN 'no data' WHEN " + " OR ".join(f"count_if({n}_rule <> ({n} = 1)) > 0" for n in ("hdf", "pwf", "osf")) + " THEN 'labels contradict rules' WHEN count_if(machine_failure = 1 AND hdf + pwf + osf + twf = 0) > 0 THEN 'consistent, with unexplained failures' ELSE 'consistent' END AS verdict FROM obs")
def _(s, d):
    return rel.data_quality(observations(s, d))


_LAWS = [("heat_order", "CAST(count_if(process_temperature_k <= air_temperature_k) AS DOUBLE)", 0, 0), ("temp_delta_mean", "avg(temp_delta_k)", 10, 0.25), ("temp_delta_sd", "stddev_samp(temp_delta_k)", 1, 0.25), ("speed_torque_corr", "corr(rotational_speed_rpm, torque_nm)", -0.875, 0.10), ("power_mean", "avg(power_w)", 6280, 628)]


@query("invariants", f"{OBS} " + " UNION ALL ".join(f"SELECT '{n}' AS invariant, round({v}, 6) AS value, CAST({e} AS DOUBLE) AS expected, CAST({t} AS DOUBLE) AS tolerance, abs({v} - ({e}e0)) <= {t}e0 AS holds FROM obs" for n, v, e, t in _LAWS))
def _(s, d):
    return rel.invariants(observations(s, d))


_HALF = "(SELECT max(udi) / 2 FROM obs)"


def _drift_sql(frame: str) -> str:
    chans = (("dt", "temp_delta_k"), ("rpm", "rotational_speed_rpm"), ("tq", "torque_nm"))
    lag = ", ".join(f"lag({c}) OVER (ORDER BY udi) AS {k}_p, {c} AS {k}" for k, c in chans)
    z = ", ".join(f"((avg({k}) FILTER (w)) - (avg({k}) FILTER (NOT w))) / ((stddev_samp({k}) FILTER (NOT w)) / sqrt(greatest((count({k}) FILTER (w)) * (1 - greatest(least(corr({k}, {k}_p) FILTER (NOT w), 0.99e0), -0.99e0)) / (1 + greatest(least(corr({k}, {k}_p) FILTER (NOT w), 0.99e0), -0.99e0)), 1))) AS z_{k}" for k, _ in chans)
    now = {n: v for n, v, *_ in _LAWS}
    broken = " OR ".join(f"NOT (SELECT abs({now[n]} - ({e}e0)) <= {t}e0 FROM src WHERE udi > (SELECT max(udi) // 2 FROM obs))" for n, _, e, t in _LAWS)
    return f"{OBS}, src AS ({frame}), l AS (SELECT udi > (SELECT max(udi) // 2 FROM obs) AS w, {lag} FROM src), q AS (SELECT {z}, ({broken}) AS law_broken FROM l) SELECT round(z_dt, 4) AS z_dt, round(z_rpm, 4) AS z_rpm, round(z_tq, 4) AS z_tq, law_broken, CASE WHEN abs(z_rpm) > 5 OR abs(z_tq) > 5 THEN 'process' WHEN abs(z_dt) > 5 OR law_broken THEN 'sensor' ELSE 'ok' END AS verdict FROM q"


def _second_half(df: DataFrame):
    return F.col("udi") > F.lit(df.agg(F.max("udi")).first()[0] // 2)


@query("drift", _drift_sql("SELECT * FROM obs"), dp=4)
def _(s, d):
    o = observations(s, d)
    return rel.drift(o, _second_half(o))


@query("drift_injected", _drift_sql("SELECT * REPLACE (CASE WHEN udi > (SELECT max(udi) // 2 FROM obs) THEN process_temperature_k + 2e0 - air_temperature_k ELSE temp_delta_k END AS temp_delta_k) FROM obs"), dp=4)
def _(s, d):
    o = observations(s, d)
    w = _second_half(o)
    return rel.drift(rel.injected(o, P, "process_temperature_k", 2.0, w), w)


def _worn_labels(s, d) -> DataFrame:
    """Labels of a process whose overstrain limit really is 4 % lower than documented."""
    o = observations(s, d)
    return o.withColumn("osf", (F.col("overstrain_min_nm") > P.mode("OSF").terms[0].bound(F.col("product_type")) * 0.96).cast("int"))


_WORN = f"{OBS}, worn AS (SELECT * REPLACE (CAST(overstrain_min_nm > lim * 0.96e0 AS INT) AS osf) FROM obs)"


@query("kb_audit", f"{_WORN} " + " UNION ALL ".join(f"SELECT '{n.upper()}' AS rule, count_if({n}_rule AND {n} = 1) AS hits, count_if(NOT {n}_rule AND {n} = 1) AS surprises, count_if({n}_rule AND {n} = 0) AS false_alarms, CASE WHEN count_if(NOT {n}_rule AND {n} = 1) > 3 AND count_if({n}_rule AND {n} = 0) > 3 THEN 'conflicted' WHEN count_if(NOT {n}_rule AND {n} = 1) > 3 THEN 'loose' WHEN count_if({n}_rule AND {n} = 0) > 3 THEN 'tight' ELSE 'calibrated' END AS verdict FROM worn" for n in ("hdf", "pwf", "osf")))
def _(s, d):
    return rel.calibration_audit(_worn_labels(s, d))


@query("kb_sweep", f"{_WORN} " + " UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS error, count_if(NOT overstrain_min_nm > lim * (1e0 + {e}) AND osf = 1) AS surprises, count_if(overstrain_min_nm > lim * (1e0 + {e}) AND osf = 0) AS false_alarms FROM worn" for e in ("-0.1e0", "-0.05e0", "0e0", "0.05e0", "0.1e0")))
def _(s, d):
    return rel.calibration_sweep(_worn_labels(s, d), P)


@query("threshold_bracket", f"{_WORN} SELECT product_type, {r('max(overstrain_min_nm) FILTER (osf = 0) AS max_healthy', 'min(overstrain_min_nm) FILTER (osf = 1) AS min_failing', '((max(overstrain_min_nm) FILTER (osf = 0)) + (min(overstrain_min_nm) FILTER (osf = 1))) / 2 AS midpoint')}, count_if(osf = 1) AS support FROM worn GROUP BY product_type")
def _(s, d):
    return rel.threshold_bracket(_worn_labels(s, d))


@query("health", f"{OBS} " + " UNION ALL ".join(f"SELECT 'invariant' AS kind, '{n}' AS name, abs({v} - ({e}e0)) <= {t}e0 AS ok, CASE WHEN abs({v} - ({e}e0)) <= {t}e0 THEN 'holds' ELSE 'violated' END AS detail FROM obs" for n, v, e, t in _LAWS) + "".join(f" UNION ALL SELECT 'calibration', '{n.upper()}', count_if({n}_rule <> ({n} = 1)) = 0, CASE WHEN count_if({n}_rule <> ({n} = 1)) = 0 THEN 'calibrated' ELSE 'other' END FROM obs" for n in ("hdf", "pwf", "osf")))
def _(s, d):
    return rel.health(observations(s, d))


@query("invariant_flags", f"{OBS}, hot AS (SELECT * REPLACE (temp_delta_k + 3e0 AS temp_delta_k) FROM obs), v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS invariant, {v} AS value, CAST({e} AS DOUBLE) AS expected, CAST({t} AS DOUBLE) AS tolerance FROM hot" for n, v, e, t in _LAWS if n.startswith("temp")) + f") SELECT invariant, {r('value')}, expected, tolerance FROM v WHERE abs(value - expected) > tolerance")
def _(s, d):
    """A plan over temperatures, on data whose temperatures break a law."""
    hot = observations(s, d).withColumn("temp_delta_k", F.col("temp_delta_k") + 3.0)
    return rel.invariant_flags(rel.invariants(hot), {"temp_delta_k"}).filter("invariant LIKE 'temp%'")


# fleet and remaining life

_LATEST = f", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY udi DESC) AS rn, count(*) OVER (PARTITION BY machine_id) AS cycles, CAST(sum(machine_failure) OVER (PARTITION BY machine_id) AS BIGINT) AS fails, {_CLOSEST} AS binding, CASE product_type WHEN 'L' THEN 2e0 WHEN 'M' THEN 3e0 ELSE 5e0 END AS rt FROM obs) WHERE rn = 1)"


@query("fleet_latest", f"{OBS}{_LATEST} SELECT machine_id, udi, product_type, {r('worst_margin', 'tool_wear_min', 'torque_nm')}, binding, cycles, fails AS failures, CASE WHEN worst_margin < 0 THEN 'critical' WHEN worst_margin < 0.05e0 THEN 'watch' ELSE 'normal' END AS state FROM f")
def _(s, d):
    return rel.fleet(observations(s, d))


@query("fleet_history", f"{OBS}, h AS (SELECT machine_id, udi, worst_margin, row_number() OVER (PARTITION BY machine_id ORDER BY udi DESC) AS k FROM obs) SELECT machine_id, row_number() OVER (PARTITION BY machine_id ORDER BY udi) AS point, round(worst_margin, 6) + 0e0 AS margin FROM h WHERE k <= 20")
def _(s, d):
    h = rel.history(observations(s, d))
    return h.select("machine_id", F.posexplode("margins").alias("p", "margin")).select("machine_id", (F.col("p") + 1).cast("bigint").alias("point"), "margin")


@query("fleet_rul", f"""{OBS}{_LATEST}, cr AS (SELECT (abs(lim - tool_wear_min * torque_nm) + 1e0) / (CASE product_type WHEN 'L' THEN 2e0 WHEN 'M' THEN 3e0 ELSE 5e0 END * torque_nm) AS c FROM obs WHERE osf = 1 AND torque_nm > 0),
cc AS (SELECT CASE WHEN count(*) < 5 THEN 0e0 ELSE quantile_disc(c, 0.9) END AS wider FROM cr),
k AS (SELECT machine_id, lim - tool_wear_min * torque_nm AS margin, rt, (lim - tool_wear_min * torque_nm) / (rt * torque_nm) AS mu, wider FROM f, cc), q AS (SELECT *, 1.6448536269514722e0 * sqrt(mu * mu * mu / (margin * margin / (rt * 9.8e0 * rt * 9.8e0))) AS h FROM k WHERE margin > 0 UNION ALL SELECT *, NULL FROM k WHERE margin <= 0)
SELECT machine_id, {r('margin', 'CASE WHEN margin <= 0 THEN 0e0 ELSE mu END AS cycles', 'CASE WHEN margin <= 0 THEN 0e0 ELSE greatest(mu - h - wider, 0e0) END AS cycles_lo', 'CASE WHEN margin <= 0 THEN 0e0 ELSE mu + h + wider END AS cycles_hi', dp=5)}, CASE WHEN margin <= 0 THEN 'crossed' WHEN mu < 50 THEN 'imminent' ELSE 'running' END AS status FROM q""", dp=5)
def _(s, d):
    return rel.remaining_life(observations(s, d), P)


@query("tool_lives", f"{OBS}, l AS (SELECT machine_id, udi, tool_wear_min, CASE WHEN lag(tool_wear_min) OVER (PARTITION BY machine_id ORDER BY udi) <= tool_wear_min THEN 0 ELSE 1 END AS b FROM obs), n AS (SELECT *, CAST(sum(b) OVER (PARTITION BY machine_id ORDER BY udi) AS BIGINT) AS life FROM l) SELECT machine_id, life, count(*) AS cycles, min(udi) AS first_udi, max(udi) AS last_udi, {r('arg_max(tool_wear_min, udi) AS wear_end')} FROM n GROUP BY machine_id, life")
def _(s, d):
    return rel.tool_lives(observations(s, d))


@query("wear_trajectory", f"{OBS}{_LATEST}, t AS (SELECT machine_id, c, lim - (tool_wear_min + c * rt) * torque_nm AS m FROM f, (SELECT unnest(range(201)) AS c)) SELECT machine_id, min(c) FILTER (m <= 0) AS crossing_cycle, round(min(m), 6) AS last_margin FROM t GROUP BY machine_id")
def _(s, d):
    return rel.wear_trajectory(observations(s, d), P)


@query("conformal_interval", f"{OBS}, o AS (SELECT product_type, torque_nm AS x, row_number() OVER (PARTITION BY product_type ORDER BY torque_nm) AS i, count(*) OVER (PARTITION BY product_type) AS n FROM obs), k AS (SELECT *, greatest(CAST(floor(0.1e0 * (n + 1) / 2e0) AS BIGINT), 1) AS k FROM o) SELECT product_type, max(n) AS n, max(x) FILTER (i = k) AS lo, max(x) FILTER (i = n + 1 - k) AS hi, max(floor(0.1e0 * (n + 1) / 2e0)) >= 1 AS valid FROM k GROUP BY product_type")
def _(s, d):
    return rel.conformal(observations(s, d), "torque_nm", "product_type")


# alerts, maintenance

_MATCH = f"{OBS}, al AS (SELECT machine_id, udi AS raised, {_CLOSEST} AS mode FROM obs WHERE worst_margin >= 0 AND worst_margin < 0.05e0), oc AS (SELECT machine_id, udi AS failed_at FROM obs WHERE machine_failure = 1), mt AS (SELECT al.*, (SELECT min(failed_at) FROM oc WHERE oc.machine_id = al.machine_id AND failed_at BETWEEN raised AND raised + 600) AS failed_at FROM al)"


@query("alert_outcome_join", f"{_MATCH} SELECT machine_id, raised AS \"at\", mode, coalesce(failed_at, -1) AS failed_at, coalesce(failed_at - raised, -1) AS lead FROM mt")
def _(s, d):
    return rel.matched(rel.signals(observations(s, d))).fillna(-1, ["failed_at", "lead"])


@query("scorecard_by_mode", f"{_MATCH} SELECT mode, count(*) AS alerts, count(failed_at) AS correct, count_if(failed_at - raised >= 5) AS actionable, count_if(failed_at = raised) AS lead_zero, round(median(failed_at - raised), 6) AS median_lead, round(count(failed_at) / CAST(count(*) AS DOUBLE), 6) AS precision, round(count_if(failed_at - raised >= 5) / CAST(count(*) AS DOUBLE), 6) AS actionable_precision FROM mt GROUP BY mode")
def _(s, d):
    return rel.scorecard(rel.matched(rel.signals(observations(s, d))))


@query("alert_recall", f"{_MATCH} SELECT count(*) AS failures, count_if(EXISTS (SELECT 1 FROM mt WHERE mt.machine_id = oc.machine_id AND mt.failed_at = oc.failed_at)) AS foreseen, round(count_if(EXISTS (SELECT 1 FROM mt WHERE mt.machine_id = oc.machine_id AND mt.failed_at = oc.failed_at)) / CAST(count(*) AS DOUBLE), 6) AS recall FROM oc")
def _(s, d):
    found = rel.signals(observations(s, d))
    return rel.recall(found, rel.matched(found))


_WO = f"{OBS}, wo AS (SELECT udi, machine_id, product_type, CASE WHEN hdf = 1 THEN 'HDF' WHEN pwf = 1 THEN 'PWF' WHEN osf = 1 THEN 'OSF' WHEN twf = 1 THEN 'TWF' ELSE 'UNDETERMINED' END AS mode, (udi * 17) % 10 < 7 AS closed, (udi * 31) % 10 < 8 AS found FROM obs WHERE machine_failure = 1)"


@query("workorder_summary", f"{_WO} SELECT mode, count(*) AS orders, count_if(NOT closed) AS open, count_if(closed AND found) AS confirmed, count_if(closed AND NOT found) AS false_alarms, round(count_if(closed AND found) / nullif(CAST(count_if(closed) AS DOUBLE), 0), 6) AS precision FROM wo GROUP BY mode")
def _(s, d):
    return rel.work_order_summary(rel.work_orders(observations(s, d)))


@query("newest_orders", f"{_WO} SELECT udi AS wo, machine_id, product_type, mode, CASE WHEN closed THEN 'closed' ELSE 'open' END AS status, CASE WHEN closed THEN found END AS found_fault FROM wo ORDER BY udi DESC LIMIT 100")
def _(s, d):
    return rel.newest_orders(rel.work_orders(observations(s, d)))


@query("feedback_weights", f"{_WO} SELECT mode, product_type, count(*) AS closed, count_if(found) AS confirmed, round(1 + 0.002e0 * count_if(found) - 0.001e0 * count_if(NOT found), 6) AS weight, round(count_if(NOT found) / CAST(count(*) AS DOUBLE), 6) AS fp_rate, count_if(NOT found) / CAST(count(*) AS DOUBLE) > 0.1e0 AND count(*) >= 5 AS flagged FROM wo WHERE closed GROUP BY mode, product_type")
def _(s, d):
    return rel.feedback(rel.work_orders(observations(s, d)))


# discovery


def _profile_sql(c: str) -> str:
    g0, g1 = f"var_pop({c} - {c}_p)", f"covar_pop({c} - {c}_p, {c}_p - {c}_pp)"
    values = r(f"avg({c}) AS mean", f"stddev_samp({c}) AS sd", f"min({c}) AS min", f"max({c}) AS max", f"avg(CAST({c} = {c}_p AS INT)) AS repeat", f"avg(CAST({c} >= {c}_p AS INT)) AS up", f"sqrt(greatest(CASE WHEN {g1} < 0 THEN {g0} + 2e0 * {g1} ELSE 0e0 END, 0e0)) AS process_sd", f"sqrt(CASE WHEN {g1} < 0 THEN -{g1} ELSE {g0} / 2e0 END) AS instrument_sd", dp=5)
    return f"SELECT '{c}' AS channel, {values}, avg(CAST({c} >= {c}_p AS INT)) >= 0.95e0 AS counter FROM l"


@query("channel_profile", f"{OBS}, l AS (SELECT *, " + ", ".join(f"lag({c}) OVER (ORDER BY udi) AS {c}_p, lag({c}, 2) OVER (ORDER BY udi) AS {c}_pp" for c in BASE) + " FROM obs) " + " UNION ALL ".join(_profile_sql(c) for c in BASE), dp=5)
def _(s, d):
    return rel.channel_profile(observations(s, d), BASE)


@query("leakage_scan", f"{OBS}, n AS (SELECT count(*) AS n FROM obs) " + " UNION ALL ".join(f"SELECT '{c}' AS column, count_if({c} = 1) AS on, count_if({c} = 1 AND machine_failure = 1) AS inside, round(count_if({c} = 1 AND machine_failure = 1) / nullif(CAST(count_if({c} = 1) AS DOUBLE), 0), 6) AS share, coalesce(count_if({c} = 1) * 2 <= count(*) AND count_if({c} = 1 AND machine_failure = 1) / nullif(CAST(count_if({c} = 1) AS DOUBLE), 0) >= 0.9e0, false) AS leaks FROM obs" for c in ("hdf", "pwf", "osf", "twf", "rnf")))
def _(s, d):
    return rel.leakage(observations(s, d), ("hdf", "pwf", "osf", "twf", "rnf"))


def _split_sql(where: str = "true", obs: str = OBS) -> str:
    """The best cut of each metric, as the table p with i = 1."""
    counts = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS x, count(*) AS n, sum(osf) AS k FROM obs WHERE {where} AND {m} IS NOT NULL AND osf IS NOT NULL GROUP BY {m}" for m in (*FIVE, "overstrain_min_nm"))
    return f"""{obs}, c AS ({counts}),
w AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY x) AS nl, sum(k) OVER (PARTITION BY metric ORDER BY x) AS kl, sum(n) OVER (PARTITION BY metric) AS na, sum(k) OVER (PARTITION BY metric) AS ka, lead(x) OVER (PARTITION BY metric ORDER BY x) AS nx FROM c),
f AS (SELECT metric, (x + nx) / 2 AS cut, 2e0 * kl / (nl + ka) AS f_lt, 2e0 * (ka - kl) / (na - nl + ka) AS f_gt FROM w WHERE nx IS NOT NULL),
p AS (SELECT *, greatest(f_lt, f_gt) AS f1, row_number() OVER (PARTITION BY metric ORDER BY greatest(f_lt, f_gt) DESC, cut) AS i FROM f)"""


@query("rule_split", _split_sql() + " SELECT metric, round(cut, 6) AS cut, round(f1, 6) AS f1, CASE WHEN f_gt >= f_lt THEN '>' ELSE '<' END AS side FROM p WHERE i = 1")
def _(s, d):
    return rel.best_split(observations(s, d), FIVE + ("overstrain_min_nm",), "osf")


#: Every seventh row without torque, every fifth without speed: what is derived from them stays.
GAPS = OBS + ", whole AS (SELECT * FROM obs), gaps AS (SELECT * REPLACE (CASE WHEN udi % 7 <> 0 THEN torque_nm END AS torque_nm, CASE WHEN udi % 5 <> 0 THEN rotational_speed_rpm END AS rotational_speed_rpm) FROM whole)"


def _gaps(df: DataFrame) -> DataFrame:
    return df.withColumns({"torque_nm": F.when(F.col("udi") % 7 != 0, F.col("torque_nm")), "rotational_speed_rpm": F.when(F.col("udi") % 5 != 0, F.col("rotational_speed_rpm"))})


@query("rule_split_gaps", _split_sql(obs=GAPS).replace("FROM obs WHERE true", "FROM gaps WHERE true") + " SELECT metric, round(cut, 6) AS cut, round(f1, 6) AS f1, CASE WHEN f_gt >= f_lt THEN '>' ELSE '<' END AS side FROM p WHERE i = 1")
def _(s, d):
    return rel.best_split(_gaps(observations(s, d)), FIVE + ("overstrain_min_nm",), "osf")


@query("conformal_gaps", f"{GAPS}, o AS (SELECT product_type, torque_nm AS x, row_number() OVER (PARTITION BY product_type ORDER BY torque_nm) AS i, count(*) OVER (PARTITION BY product_type) AS n FROM gaps WHERE torque_nm IS NOT NULL), k AS (SELECT *, greatest(CAST(floor(0.1e0 * (n + 1) / 2e0) AS BIGINT), 1) AS k FROM o) SELECT product_type, max(n) AS n, max(x) FILTER (i = k) AS lo, max(x) FILTER (i = n + 1 - k) AS hi, max(floor(0.1e0 * (n + 1) / 2e0)) >= 1 AS valid FROM k GROUP BY product_type")
def _(s, d):
    return rel.conformal(_gaps(observations(s, d)), "torque_nm", "product_type")


@query("rule_induction")
def _(s, d):
    return discovery.induce(observations(s, d), FIVE + ("overstrain_min_nm",), "osf")


@query("rule_audit", _split_sql("product_type = 'L'") + " SELECT metric, round(cut, 6) AS cut, round(f1, 6) AS f1, CASE WHEN metric = 'overstrain_min_nm' THEN 11000e0 END AS documented, round(CASE WHEN metric = 'overstrain_min_nm' THEN abs(cut - 11000e0) / 11000e0 END, 6) AS error, metric = 'overstrain_min_nm' AND abs(cut - 11000e0) / 11000e0 < 0.10e0 AS verified FROM p WHERE i = 1")
def _(s, d):
    cuts = rel.best_split(observations(s, d).filter("product_type = 'L'"), FIVE + ("overstrain_min_nm",), "osf")
    return discovery.audit(cuts, {"overstrain_min_nm": 11000.0})


_RAW_UNITS = {"air_temperature_k": "K", "process_temperature_k": "K", "rotational_speed_rpm": "rpm", "torque_nm": "N·m", "tool_wear_min": "min"}


def _features(o: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The raw channels, what their units construct, and the variants as 0/1 columns."""
    made = discovery.constructed(_RAW_UNITS, ("tool_wear_min",)) | discovery.one_hot(o, ("product_type",))
    return o.withColumns(made), (*BASE, *made)


@query("constructed_features", f"{OBS} SELECT udi, {r('process_temperature_k - air_temperature_k AS process_temperature_k_minus_air_temperature_k', 'power_w AS power_from_torque_nm_rotational_speed_rpm', 'overstrain_min_nm AS tool_wear_min_x_torque_nm')}, " + ", ".join(f"CASE WHEN product_type = '{v}' THEN 1e0 ELSE 0e0 END AS product_type_is_{v}" for v in "HLM") + " FROM obs")
def _(s, d):
    df, names = _features(observations(s, d))
    return df.select("udi", *[n for n in names if n not in BASE])


@query("rule_paths")
def _(s, d):
    """Conjunctions found in the features, with union coverage."""
    df, names = _features(observations(s, d))
    return discovery.rule_table(df, *discovery.induce_paths(df, names, "machine_failure"))


@query("feature_f1")
def _(s, d):
    """One tree over raw channels against one over constructed features."""
    df, names = _features(observations(s, d))
    rows = [("raw", discovery.tree_f1(df, BASE, "osf", 2)), ("constructed", discovery.tree_f1(df, names, "osf", 2))]
    return s.createDataFrame(rows, "features string, f1 double")


@query("linear_baseline")
def _(s, d):
    return discovery.anomalies(observations(s, d), BASE, F.col("machine_failure") == 0)


@query("conformal_coverage", f"""{OBS}, o AS (SELECT udi, product_type, torque_nm AS x, rank() OVER (PARTITION BY product_type ORDER BY torque_nm) - 1 AS below, count(*) OVER (PARTITION BY product_type ORDER BY torque_nm) AS upto, count(*) OVER (PARTITION BY product_type) AS n FROM obs)
SELECT product_type, max(n) AS n, round(avg(CASE WHEN floor(0.1e0 * n / 2e0) < 1 OR (upto > floor(0.1e0 * n / 2e0) AND below < n - floor(0.1e0 * n / 2e0)) THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM o GROUP BY product_type""")
def _(s, d):
    return discovery.leave_one_out(observations(s, d), "torque_nm", "product_type")


@query("envelope_projection", f"""{OBS}{_LATEST}, g AS (SELECT machine_id, c, 3500e0 / (rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE)) AS lo, 9000e0 / (rotational_speed_rpm * CAST(0.10471975511965977 AS DOUBLE)) AS pw, coalesce(lim / nullif(tool_wear_min + c * rt, 0), 1e308) AS st FROM f, (SELECT unnest(range(0, 201, 5)) AS c)),
a AS (SELECT machine_id, max(least(pw, st) - lo) FILTER (c = 0) AS w0, max(least(pw, st) - lo) FILTER (c = 200) AS w1, min(c) FILTER (least(pw, st) < lo) AS closes, min(c) FILTER (st < pw) AS binds FROM g GROUP BY machine_id)
SELECT machine_id, round(w0, 6) AS width_now, round(w1, 6) AS width_then, coalesce(closes, -1) AS closes_at, coalesce(binds, -1) AS strain_binds_at, round(100e0 * (1 - greatest(w1, 0e0) / w0), 5) AS shrink FROM a""")
def _(s, d):
    r = discovery.envelope_projection(observations(s, d), P).fillna(-1, ["closes_at", "strain_binds_at"])
    return r.withColumn("shrink", F.round("shrink", 5) + 0.0)


@query("telemetry_page", f"{OBS} SELECT udi, machine_id, {r('torque_nm')} FROM obs ORDER BY obs.torque_nm DESC, udi LIMIT 50 OFFSET 100")
def _(s, d):
    from .sources.io import page

    return page(observations(s, d), "torque_nm", ("udi", "torque_nm"), descending=True, offset=100).select("udi", "machine_id", "torque_nm")


@query("nearest_vectors", """WITH q AS (SELECT vec_id AS query_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(v, [CAST(x AS DOUBLE) FOR x IN embedding]) AS c FROM q JOIN embeddings ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(c, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    return rel.nearest(e, e.filter("vec_id % 100 = 0"))


@query("question_shapes")
def _(s, d):
    """Benchmark questions reduced to their shape and hashed: how many places of the vector are taken, and its largest weight."""
    from .functions.text import embedding, normalise

    q = table(s, d, "benchmark").select("item_id", normalise(F.col("text")).alias("shape"))
    v = q.withColumn("v", embedding(F.col("shape")))
    return v.select("item_id", "shape", F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("places"), F.array_max("v").alias("largest"))


@query("rendered_numbers", f"{OBS} SELECT udi, CASE WHEN torque_nm = floor(torque_nm) THEN printf('%d', CAST(torque_nm AS BIGINT)) WHEN torque_nm >= 10 THEN printf('%.2f', torque_nm) ELSE printf('%.3f', torque_nm) END AS torque, CASE WHEN rotational_speed_rpm >= 1000 THEN printf('%d,%03d', CAST(rotational_speed_rpm AS BIGINT) // 1000, CAST(rotational_speed_rpm AS BIGINT) % 1000) ELSE printf('%d', CAST(rotational_speed_rpm AS BIGINT)) END AS speed FROM obs")
def _(s, d):
    from .functions.units import rendered

    return observations(s, d).select("udi", rendered(F.col("torque_nm")).alias("torque"), rendered(F.col("rotational_speed_rpm")).alias("speed"))


# streams, by batch replay of the same transitions


def _messages(s, d) -> DataFrame:
    """Events as messages: every 50th arrives twice, every 70th a hundred seconds late."""
    e = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    e = e.select(F.concat(F.lit("m"), (F.col("user_id") % 16).cast("string")).alias("machine_id"), F.col("event_id").alias("seq"), "t", F.col("event_id").cast("double").alias("order"))
    twice = e.filter("seq % 50 = 0").withColumn("order", F.col("order") + 0.5)
    late = e.filter("seq % 70 = 1").withColumn("t", F.col("t") - 100000.0).withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("order", F.col("order") + 0.25)
    return e.unionByName(twice).unionByName(late).withColumn("now", F.col("t") + 1.0)


@query("stream_intake")
def _(s, d):
    from .streaming import intake

    return intake.replay(_messages(s, d)).groupBy("machine_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("intake_stats")
def _(s, d):
    from .streaming import intake

    return intake.stats(intake.replay(_messages(s, d)))


@query("stream_duplicates", """WITH e AS (SELECT 'm' || CAST(user_id % 16 AS VARCHAR) AS machine_id, event_id AS seq FROM events) SELECT machine_id, count(*) AS messages, count(*) FILTER (seq % 50 = 0) AS duplicates FROM e GROUP BY machine_id""")
def _(s, d):
    from .streaming import intake

    v = intake.replay(_messages(s, d)).filter("seq < 1000000000")
    return v.groupBy("machine_id").agg(F.count_if(F.col("verdict") != "duplicate").alias("messages"), F.count_if(F.col("verdict") == "duplicate").alias("duplicates"))


@query("stream_scorer")
def _(s, d):
    from .streaming import scorer

    return scorer.replay(observations(s, d))


@query("tile_min_rollup", f"{OBS} SELECT machine_id, date_trunc('day', ts) AS start, round(min(worst_margin), 6) + 0e0 AS worst, count(*) AS n FROM obs GROUP BY ALL")
def _(s, d):
    from .streaming import scorer

    t = scorer.rolled(scorer.tiles(observations(s, d)))
    return t.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events), i AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), s AS (SELECT user_id, k, count(*) AS c FROM i GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(c) AS longest FROM s GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("c").alias("longest"))


# the same operators over order lines


@query("sales_rate_by_segment", f"{SALES}, a AS (SELECT c_mktsegment AS grp, CAST(sum(returned) AS BIGINT) AS failures, count(*) AS n FROM sales GROUP BY 1) SELECT grp, 0 AS ord, failures, n, round(100e0 * failures / n, 6) AS rate, {_wilson()}, {_QUALITY} FROM a")
def _(s, d):
    return core.execute(sales(s, d), Plan("rate", group_by=("segment",)), catalog.SALES)


@query("sales_describe", f"{SALES}, l AS (" + " UNION ALL ".join(f"SELECT 'all' AS cohort, '{m}' AS metric, CAST({catalog.SALES.column(m)} AS DOUBLE) AS x FROM sales" for m in ("quantity", "price", "discount", "revenue")) + f"), a AS (SELECT cohort, metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS mi, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS ma FROM l GROUP BY ALL) SELECT cohort, metric, n, {r('mean', 'mean - 1.959963984540054e0 * sd / sqrt(n) AS ci_lo', 'mean + 1.959963984540054e0 * sd / sqrt(n) AS ci_hi', 'sd', 'mi AS min', 'p25', 'median', 'p75', 'ma AS max', dp=4)}, {_QUALITY} FROM a", dp=4)
def _(s, d):
    return core.execute(sales(s, d), Plan("describe", ("quantity", "price", "discount", "revenue")), catalog.SALES)


@query("sales_rate_region_flag", f"{SALES}, a AS (SELECT r_name || '/' || l_linestatus AS grp, CAST(sum(returned) AS BIGINT) AS failures, count(*) AS n FROM sales GROUP BY 1) SELECT grp, 0 AS ord, failures, n, round(100e0 * failures / n, 6) AS rate, {_wilson()}, {_QUALITY} FROM a")
def _(s, d):
    return core.execute(sales(s, d), Plan("rate", group_by=("region", "linestatus")), catalog.SALES)


# recursions as block scans

_STEP = "(torque_nm - 40e0) / 10e0"
_RUN_UP = "OVER (PARTITION BY machine_id ORDER BY udi ROWS UNBOUNDED PRECEDING)"


@query("cusum_blocks", f"{OBS}, s AS (SELECT machine_id, udi, sum({_STEP} - 0.5e0) {_RUN_UP} AS p, sum(-{_STEP} - 0.5e0) {_RUN_UP} AS q FROM obs) SELECT machine_id, udi, round(p - least(min(p) {_RUN_UP}, 0e0), 6) + 0e0 AS step_up, round(q - least(min(q) {_RUN_UP}, 0e0), 6) + 0e0 AS step_down FROM s")
def _(s, d):
    o = observations(s, d).select("machine_id", "udi", ((F.col("torque_nm") - 40.0) / 10.0).alias("step"))
    return scans.cusum(o, "machine_id", "udi", "step").drop("step")


@query("run_lengths", f"{OBS}, s AS (SELECT machine_id, udi, torque_nm > 38e0 AS hit, row_number() OVER (PARTITION BY machine_id ORDER BY udi) AS i FROM obs) SELECT machine_id, udi, i - coalesce(max(CASE WHEN NOT hit THEN i END) {_RUN_UP}, 0) AS run FROM s")
def _(s, d):
    o = observations(s, d).select("machine_id", "udi", "torque_nm")
    return scans.runs(o, "machine_id", "udi", F.col("torque_nm") > 38.0).drop("torque_nm")


@query("settled_level", f"{OBS}, s AS (SELECT machine_id, udi, power_w AS z, row_number() OVER (PARTITION BY machine_id ORDER BY udi) - 1 AS i FROM obs) SELECT a.machine_id, a.udi, round(sum(b.z * pow(0.75e0, a.i - b.i) * CASE WHEN b.i = 0 THEN 1e0 ELSE 0.25e0 END), 4) AS power_w_level FROM s a JOIN s b ON a.machine_id = b.machine_id AND b.i BETWEEN a.i - 150 AND a.i GROUP BY a.machine_id, a.udi", dp=4)
def _(s, d):
    o = observations(s, d).select("machine_id", "udi", "power_w")
    return scans.settled(o, "machine_id", "udi", "power_w", gain=0.25).drop("power_w")


# work orders as a log of events


def order_events(df: DataFrame) -> DataFrame:
    """Made-up but fixed events of the failures' work orders, in batches; some closed, reopened, closed again or twice, and some delivered again by a later batch."""
    u, at = F.col("udi"), lambda hours: F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")
    done = (u * 17) % 10 < 7
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("confirmed",) * 6 + ("false_alarm",) * 2 + ("wrong_mode", "inconclusive")]), ((u * 31) % 10 + 1).cast("int"))
    mode = F.when(F.col("hdf") == 1, "HDF").when(F.col("pwf") == 1, "PWF").when(F.col("osf") == 1, "OSF").when(F.col("twf") == 1, "TWF").otherwise("UNDETERMINED")
    event = lambda v, kind, when, hours, out=None: F.when(when, F.struct(F.lit(v).cast("bigint").alias("version"), F.lit(kind).alias("kind"), at(hours).alias("at"), (F.lit(None).cast("string") if out is None else out).alias("outcome")))
    made = [event(0, "created", F.lit(True), 0), event(1, "closed", done, 2, outcome), event(2, "reopened", done & (u % 3 == 0), 5), event(3, "closed", done & (u % 6 == 0), 9, F.lit("wrong_mode")), event(4, "closed", done & (u % 5 == 0), 11, F.lit("inconclusive"))]
    rows = df.filter("machine_failure = 1").select(u.alias("order_id"), "machine_id", mode.alias("mode"), "product_type", F.explode(F.filter(F.array(*made), lambda e: e.isNotNull())).alias("e"))
    flat = rows.select("order_id", "e.version", "e.kind", "e.at", "machine_id", "mode", "product_type", "e.outcome", F.lit(None).cast("string").alias("technician"), F.lit(None).cast("string").alias("notes"))
    again = F.when(F.col("order_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return flat.withColumn("batch", F.explode(again.cast("array<bigint>"))).withColumn("outcome", F.when(F.col("batch") == 0, F.col("outcome")))


_EVENTS = f"""{OBS}, f AS (SELECT *, (udi * 17) % 10 < 7 AS done, (['confirmed', 'confirmed', 'confirmed', 'confirmed', 'confirmed', 'confirmed', 'false_alarm', 'false_alarm', 'wrong_mode', 'inconclusive'])[CAST((udi * 31) % 10 + 1 AS INT)] AS o,
  CASE WHEN hdf = 1 THEN 'HDF' WHEN pwf = 1 THEN 'PWF' WHEN osf = 1 THEN 'OSF' WHEN twf = 1 THEN 'TWF' ELSE 'UNDETERMINED' END AS mode FROM obs WHERE machine_failure = 1),
e AS (SELECT udi, 0 AS v, false AS shut, ts AS happened, NULL AS outcome FROM f UNION ALL SELECT udi, 1, true, ts + INTERVAL 2 HOUR, o FROM f WHERE done UNION ALL SELECT udi, 2, false, ts + INTERVAL 5 HOUR, NULL FROM f WHERE done AND udi % 3 = 0
  UNION ALL SELECT udi, 3, true, ts + INTERVAL 9 HOUR, 'wrong_mode' FROM f WHERE done AND udi % 6 = 0 UNION ALL SELECT udi, 4, true, ts + INTERVAL 11 HOUR, 'inconclusive' FROM f WHERE done AND udi % 5 = 0)"""


def _asof_sql(then: str) -> str:
    """Each order's last event that changed whether it is shut, of those up to a time."""
    return f"""{_EVENTS}, l AS (SELECT *, lag(shut) OVER (PARTITION BY udi ORDER BY v) AS was FROM e WHERE happened <= {then}),
c AS (SELECT *, row_number() OVER (PARTITION BY udi ORDER BY v DESC) AS i, sum(CAST(NOT shut AND v > 0 AS INT)) OVER (PARTITION BY udi) AS again FROM l WHERE was IS NULL OR was <> shut),
st AS (SELECT f.udi, f.machine_id, f.mode, f.product_type, epoch_us(f.ts) AS raised_us, c.shut, c.happened, c.outcome, c.again, c.v FROM c JOIN f ON f.udi = c.udi WHERE c.i = 1)"""


@query("workorder_asof", _asof_sql("TIMESTAMP '2024-01-15 12:00:00'") + " SELECT udi AS order_id, machine_id, mode, product_type, raised_us, CASE WHEN shut THEN 'closed' ELSE 'open' END AS status, CASE WHEN shut THEN epoch_us(happened) END AS closed_us, CASE WHEN shut THEN outcome END AS outcome, CAST(again AS BIGINT) AS reopened, CAST(v AS BIGINT) AS version FROM st")
def _(s, d):
    e = orders.distinct_events(order_events(observations(s, d)))
    o = orders.as_of(e, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return o.select("order_id", "machine_id", "mode", "product_type", F.unix_micros(F.col("raised_at").cast("timestamp")).alias("raised_us"), "status", F.unix_micros(F.col("closed_at").cast("timestamp")).alias("closed_us"), "outcome", "reopened", "version")


@query("workorder_outcomes", _asof_sql("TIMESTAMP '2100-01-01'") + " SELECT count(*) AS total, count_if(NOT shut) AS open, count_if(shut AND outcome = 'confirmed') AS confirmed, count_if(shut AND outcome = 'false_alarm') AS false_alarm, count_if(shut AND outcome = 'wrong_mode') AS wrong_mode, count_if(shut AND outcome = 'inconclusive') AS inconclusive, round(count_if(shut AND outcome = 'confirmed') / nullif(CAST(count_if(shut AND outcome IN ('confirmed', 'false_alarm')) AS DOUBLE), 0), 6) AS precision FROM st")
def _(s, d):
    return orders.summary(orders.current(orders.distinct_events(order_events(observations(s, d)))))


@query("workorder_weights", _asof_sql("TIMESTAMP '2100-01-01'") + " SELECT mode, product_type, count(*) AS closed, count_if(outcome = 'confirmed') AS confirmed, count_if(outcome = 'false_alarm') AS false_alarm, round(1 + 0.002e0 * count_if(outcome = 'confirmed') - 0.001e0 * count_if(outcome = 'false_alarm'), 6) AS weight FROM st WHERE shut GROUP BY mode, product_type")
def _(s, d):
    return orders.weights(orders.current(orders.distinct_events(order_events(observations(s, d)))))


# silence


@query("silence_events", f"""{OBS}, r AS (SELECT DISTINCT machine_id, epoch_ms(ts) AS ms FROM obs), g AS (SELECT *, (lead(ms) OVER w - ms) / 1000e0 AS gap, (ms - lag(ms) OVER w) / 1000e0 AS before FROM r WINDOW w AS (PARTITION BY machine_id ORDER BY ms)),
u AS (SELECT *, list_sort(list_filter(array_agg(before) OVER (PARTITION BY machine_id ORDER BY ms ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), x -> x IS NOT NULL)) AS steps FROM g)
SELECT machine_id, 'STALE' AS event, ms + 14400000 AS at_ms, 14400e0 AS silence_s, round(steps[len(steps) // 2 + 1], 6) AS usual_s FROM u WHERE gap > 14400 OR gap IS NULL AND epoch_ms(TIMESTAMP '2024-02-01') > ms + 14400000
UNION ALL SELECT machine_id, 'BACK', CAST(round(ms + gap * 1000) AS BIGINT), round(gap, 6), round(steps[len(steps) // 2 + 1], 6) FROM u WHERE gap > 14400""")
def _(s, d):
    readings = observations(s, d).select("machine_id", F.col("ts").alias("at"), F.col("udi").alias("seq"))
    e = watch.replay(readings, F.lit("2024-02-01 00:00:00").cast("timestamp"), stale_s=14400.0)
    return e.select("machine_id", "event", F.unix_millis("at").alias("at_ms"), "silence_s", "usual_s")


# many plans in one scan

_PLAN_DIMS = ((), ("product_type",), ("shift", "machine_id"), ("machine_id",))


def many_plans(n: int = 60) -> list[tuple]:
    """n plans of all operators over changing filters and dimensions, as rows of fused.PLANS."""
    out = []
    for i in range(n):
        metric = ("torque_nm", "power_w", "tool_wear_min", "temp_delta_k")[i % 4]
        filters = [("torque_nm", "gt", 30.0 + i / 4, None, None)] if i % 5 else []
        if i % 7 == 0:
            filters.append(("product_type", "is_not" if i % 2 else "is", None, None, "L"))
        if i % 11 == 0:
            filters.append(("tool_wear_min", "between", 20.0, 200.0 - i, None))
        out.append((f"p{i:03d}", ("rate", "mean", "count")[i % 3], metric if i % 3 == 1 else None, list(_PLAN_DIMS[i // 3 % 4]), filters, (None, 0.9, 0.99)[i % 3 - 1]))
    return out


def _plan_sql(p: tuple) -> str:
    name, op, metric, dims, filters, confidence = p
    from .functions.stats import z

    q = f"CAST({z(confidence or 0.95)!r} AS DOUBLE)"
    say = {"gt": "{0} > {2}", "between": "{0} BETWEEN {2} AND {3}", "is": "{0} = '{4}'", "is_not": "{0} <> '{4}'"}
    where = " AND ".join(say[f[1]].format(*f) for f in filters) or "true"
    grp = " || '/' || ".join(dims) or "'all'"
    body = {
        "count": ("count(*)", "CAST(count(*) AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
        "mean": ("count(*)", f"avg({metric})", f"avg({metric}) - {q} * stddev_samp({metric}) / sqrt(count(*))", f"avg({metric}) + {q} * stddev_samp({metric}) / sqrt(count(*))"),
        "rate": ("count(*)", "100e0 * avg(machine_failure)", *(f"100e0 * {f}((avg(machine_failure) + {q} * {q} / (2 * count(*)) {sign} {q} * sqrt(avg(machine_failure) * (1 - avg(machine_failure)) / count(*) + {q} * {q} / (4e0 * count(*) * count(*)))) / (1 + {q} * {q} / count(*)), {end})" for f, sign, end in (("greatest", "-", "0e0"), ("least", "+", "1e0")))),
    }[op]
    n, value, lo, hi = body
    return f"SELECT '{name}' AS plan_id, {grp} AS grp, {n} AS n, round({value}, 4) AS value, round({lo}, 4) AS ci_lo, round({hi}, 4) AS ci_hi FROM obs WHERE {where}" + (f" GROUP BY {', '.join(dims)}" if dims else "")


@query("plans_in_one_scan", f"{OBS} " + " UNION ALL ".join(_plan_sql(p) for p in many_plans()), dp=4)
def _(s, d):
    return fused.run(observations(s, d), s.createDataFrame(many_plans(), fused.PLANS), CAT)


def plans_of_events(events: DataFrame) -> DataFrame:
    """A plan an event, valid and not, as a table that has to be checked: names, bounds and dimensions follow the event's numbers."""
    e = F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(e, F.lit(k)) % len(names) + 1).cast("int"))
    f = F.struct(pick(("torque_nm", "power_w", "shift", "colour", "air_temp_k"), 35).alias("field"), pick(("gt", "is", "between", "like", "le", "is_null"), 66).alias("op"), F.when(e % 13 > 0, (e % 97 - 5).cast("double")).alias("value"), F.when(e % 3 > 0, (e % 50).cast("double")).alias("high"), F.when(e % 4 > 0, F.lit("A")).alias("word"))
    dims = F.when(e % 9 < 6, F.slice(F.array(F.lit("shift"), F.lit("machine_id"), F.lit("udi"), F.lit("tint")), (e % 4 + 1).cast("int"), (e % 3 + 1).cast("int")))
    return events.select(F.concat(F.lit("e"), e.cast("string")).alias("plan_id"), pick(("rate", "mean", "count", "sum"), 28).alias("op"), pick(("torque_nm", "weight", "shift"), 21).alias("metric"), dims.alias("group_by"), F.when(e % 8 > 0, F.array(f)).alias("filters"), F.when(e % 6 == 0, F.lit(0.3)).when(e % 6 == 1, F.lit(0.9)).alias("confidence"))


_VIOLATIONS = """WITH p AS (SELECT event_id AS e, 'e' || CAST(event_id AS VARCHAR) AS plan_id, (['rate', 'mean', 'count', 'sum'])[event_id % 28 % 4 + 1] AS op, (['torque_nm', 'weight', 'shift'])[event_id % 21 % 3 + 1] AS metric,
  CASE WHEN event_id % 9 < 6 THEN list_slice(['shift', 'machine_id', 'udi', 'tint'], event_id % 4 + 1, event_id % 4 + event_id % 3 + 1) ELSE [] END AS dims,
  (['torque_nm', 'power_w', 'shift', 'colour', 'air_temp_k'])[event_id % 35 % 5 + 1] AS field, (['gt', 'is', 'between', 'like', 'le', 'is_null'])[event_id % 66 % 6 + 1] AS how, CASE WHEN event_id % 13 > 0 THEN event_id % 97 - 5e0 END AS value, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS high, CASE WHEN event_id % 4 > 0 THEN 'A' END AS word FROM events),
f AS (SELECT * FROM p WHERE e % 8 > 0), v AS (
SELECT 'unknown operator' AS rule, plan_id FROM p WHERE op = 'sum' UNION ALL SELECT 'unknown metric', plan_id FROM p WHERE op = 'mean' AND metric <> 'torque_nm' UNION ALL SELECT 'too many dimensions', plan_id FROM p WHERE len(dims) > 2
UNION ALL SELECT 'unknown dimension', plan_id FROM p WHERE list_contains(dims, 'tint') UNION ALL SELECT 'a key is no dimension', plan_id FROM p WHERE list_contains(dims, 'udi') UNION ALL SELECT 'confidence out of range', plan_id FROM p WHERE e % 6 = 0
UNION ALL SELECT 'unknown filter', plan_id FROM f WHERE how = 'like' UNION ALL SELECT 'unknown field', plan_id FROM f WHERE field = 'colour'
UNION ALL SELECT 'filter without a value', plan_id FROM f WHERE how IN ('gt', 'le', 'between') AND (value IS NULL OR how = 'between' AND high IS NULL) OR how = 'is' AND word IS NULL UNION ALL SELECT 'empty range', plan_id FROM f WHERE how = 'between' AND high < value
UNION ALL SELECT 'a dimension is no number', plan_id FROM f WHERE how IN ('gt', 'le', 'between') AND field = 'shift' UNION ALL SELECT 'a metric is no word', plan_id FROM f WHERE how = 'is' AND field IN ('torque_nm', 'power_w', 'air_temp_k')
UNION ALL SELECT 'impossible value', plan_id FROM f WHERE how IN ('gt', 'le', 'between') AND field IN ('torque_nm', 'power_w', 'air_temp_k') AND value < 0)
SELECT rule, count(*) AS n, count(DISTINCT plan_id) AS plans, min(plan_id) AS first_plan FROM v GROUP BY rule"""


@query("plan_violations", _VIOLATIONS)
def _(s, d):
    """All plans of a table checked at once."""
    plans = plans_of_events(table(s, d, "events").select("event_id"))
    v = fused.violations(plans, CAT)
    return v.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("plan_id").alias("plans"), F.min("plan_id").alias("first_plan"))
