"""Free queries: one read-only SELECT over the view observations, checked as a parsed plan before anything is analysed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame

from ..plans.plan import PlanError

#: What a free query may read, and the rows that it may return.
VIEW, ROWS = "observations", 10_000
#: Table functions that only make rows of a row's own arrays.
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer".split())
#: Functions that a query may call: of values alone, and none that makes much of little. Any other is refused, registered ones too.
FUNCTIONS = frozenset(
    """
    any any_value approx_count_distinct approx_percentile avg bool_and bool_or corr count count_if covar_pop covar_samp every first first_value kurtosis last last_value max max_by mean median min
    min_by mode percentile percentile_approx percentile_cont percentile_disc regr_count regr_intercept regr_r2 regr_slope skewness some std stddev stddev_pop stddev_samp sum try_avg try_sum var_pop var_samp variance
    grouping grouping_id cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    abs acos asin atan atan2 bround cbrt ceil ceiling cos cosh degrees div e exp floor greatest hypot isnan least ln log log10 log2 mod nanvl negative pi pmod positive pow power radians rint round sign
    signum sin sinh sqrt tan tanh try_add try_divide try_multiply try_subtract width_bucket
    coalesce if iff ifnull isnotnull isnull nullif nullifzero nvl nvl2 zeroifnull
    ascii btrim char_length character_length concat contains endswith initcap instr left length locate lower ltrim position regexp_count regexp_extract regexp_like regexp_replace replace
    right rtrim split_part startswith substr substring translate trim ucase lcase upper
    bigint boolean date double float int string timestamp cast try_cast to_date to_timestamp try_to_timestamp
    date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear extract hour minute month quarter second timestampadd timestampdiff trunc unix_timestamp weekday weekofyear window year
    array array_contains array_max array_min element_at named_struct struct size
    """.split()
)
#: Nodes of a query. Any other kind, such as a command, is refused.
NODES = frozenset({"Project", "Filter", "Aggregate", "Sort", "Distinct", "GlobalLimit", "LocalLimit", "Offset", "Join", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "WithWindowDefinition", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "OneRowRelation", "LocalRelation", "Generate", "LateralJoin", "Pivot", "Unpivot", "Sample", "Expand", "GroupingSets", "ResolvedInlineTable"})


def _items(seq) -> Iterator:
    for i in range(seq.length()):
        yield seq.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _plans(plan, names: frozenset[str]) -> Iterator[tuple]:
    """Every node of a parsed query with the names that can be read there: children, and the plans of subqueries inside expressions.

    A common table expression is seen by those after it in its WITH and by what that WITH heads, and nowhere else.
    """
    yield plan, names
    inner = list(_items(plan.innerChildren()))
    if _name(plan) == "UnresolvedWith":
        for c in inner:
            yield from _plans(c, names)
            names = names | {c.alias().lower()}
        inner = []
    for child in [*_items(plan.children()), *inner]:
        if hasattr(child, "innerChildren"):
            yield from _plans(child, names)


def _expressions(e) -> Iterator:
    yield e
    for child in _items(e.children()):
        yield from _expressions(child)


def refusal(spark, sql: str) -> str | None:
    """Why a text is no query that may run; None where it may."""
    if not re.match(r"\s*(select|with)\b", sql, re.IGNORECASE):
        return "only SELECT or WITH"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        return f"no single SELECT: {str(e).splitlines()[0]}"
    for node, named in _plans(plan, frozenset({VIEW})):
        kind = _name(node)
        if kind == "UnresolvedWith" and node.allowRecursion():
            return "a query may not call itself"
        if kind not in NODES:
            return f"{kind} can't stand in a query"
        if kind == "UnresolvedRelation":
            parts = [str(p) for p in _items(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in named:
                return f"only the view {VIEW} can be read, not {'.'.join(parts)}"
        if kind == "UnresolvedTableValuedFunction":
            parts = [str(p) for p in _items(node.name())]
            if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                return f"the table function {'.'.join(parts)} can't be used"
        for e in (x for top in _items(node.expressions()) for x in _expressions(top)):
            if _name(e) == "UnresolvedFunction":
                parts = [str(p) for p in _items(e.nameParts())]
                if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                    return f"the function {'.'.join(parts)} can't be used"
            elif "UnresolvedIdentifier" in _name(e) or _name(e) == "CallMethodViaReflection":
                return f"{_name(e)} can't be used"
    return None


def explore(df: DataFrame, sql: str) -> DataFrame:
    """A read-only query over the view observations, in a session of its own; at most ROWS rows come back.

    The text is parsed first and its whole plan looked at, subqueries included: it may read the view and its own common table
    expressions, each in its scope, and call only functions of a stated list. Only then is it analysed.
    """
    spark = df.sparkSession
    if why := refusal(spark, sql):
        raise PlanError(why)
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    source = f"{VIEW}_{uuid.uuid4().hex}"
    df.createGlobalTempView(source)
    try:
        session.sql(f"CREATE TEMPORARY VIEW {VIEW} AS SELECT * FROM global_temp.{source}")
        return session.sql(f"SELECT * FROM ({sql}\n) LIMIT {ROWS}")
    finally:
        spark.catalog.dropGlobalTempView(source)
