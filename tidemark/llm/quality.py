"""Quality rules: robust multivariate outliers among text statistics, in DataFrame expressions only.

Each text has a vector of DIMS transformed statistics: log mean word length, log symbol density, share of words in
repeated 5-word windows, log share of distinct words. Ratios are shrunk by PRIOR_WORDS, so short texts don't stray. Each
group (language and source) has a minimum-covariance-determinant estimate of centre and scatter:
start from medians and quartile spreads; in each concentration step keep the half of the group nearest by
Mahalanobis distance and estimate from it, which never raises the determinant; last, scale for consistency and
re-estimate from all texts within the 97.5 % quantile. A text is rejected when its distance from its group's
reweighted estimate passes the CUTOFF quantile. FLOOR, a tolerance per statistic, is added to every scatter: a group
that is all alike doesn't make small deviations outliers.

Scale: statistics are whole numbers (units of 1 / UNIT), so sums are exact in any order. A step is one scan of the
small statistics table with map-side sums by group and distance bin, whatever the size of the hot source; half of a
group is found on the bins' counts. No group is collected anywhere. Groups of fewer than MIN_GROUP texts are
estimated together: first by language, then as one.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored

DIMS = 4
UNIT = 256
PRIOR_WORDS = 20
#: Tolerance (standard deviation) that is added to each statistic's scatter.
FLOOR = (0.10, 0.15, 0.05, 0.10)
#: Texts beyond this quantile of the chi-square distribution are rejected.
CUTOFF = 1 - 1e-7
CORE = 0.5
STEPS = 5
MIN_GROUP = 100
#: Bins a doubling of the squared distance, and the smallest and largest distance told apart.
BINS_PER_OCTAVE, LOWEST, HIGHEST = 16, 2.0**-12, 2.0**24
#: Groups whose estimates are broadcast (about 250 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 20_000

_SPACE = "[ \\t-\\r]+"
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def chi2_cdf(x: float, k: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float) -> float:
    """Makes the scatter of a normal sample's inner share estimate that of the sample."""
    return share / chi2_cdf(chi2_quantile(share, DIMS), DIMS + 2)


def text_statistics(text: Column) -> dict[str, Column]:
    """words (array) and lines (array), from which base_columns() counts."""
    text = F.coalesce(text, F.lit(""))
    return {"__text": text, "__words": F.filter(F.split(text, _SPACE), lambda w: w != ""), "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))}


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct __q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, base_failed.

    Repeated windows are found by sorting a text's window hashes (64 bits) with their places: equal neighbours are
    repeats, and a word counts once however many repeated windows cover it.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.select(*keep, *[c.alias(n) for n, c in text_statistics(F.col(f"`{text_col}`")).items()])
    w = F.col("__words")
    at = F.when(F.size(w) >= 5, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>"))
    window = F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(5)]).alias("h"), i.alias("i")))
    d = d.select(*keep, "__text", "__words", "__lines", F.sort_array(window).alias("__sorted"))
    s = F.col("__sorted")
    h = lambda i: F.get(s, i)["h"]
    repeated = F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(h(i - 1) == x["h"], F.lit(False)) | F.coalesce(h(i + 1) == x["h"], F.lit(False))).alias("again"))), lambda x: x["again"]), lambda x: x["i"])
    d = d.select(*keep, "__text", "__words", "__lines", F.sort_array(repeated).alias("__again"))
    r = F.col("__again")
    covered = F.aggregate(F.transform(r, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(r, i + 1) - x, F.lit(5)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size(w).cast("bigint")
    q = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": covered,
        "n_distinct": F.size(F.array_distinct(w)).cast("bigint"),
    }
    d = d.select(*keep, F.struct(*[c.alias(k) for k, c in q.items()]).alias("__b"))
    b = lambda k: F.col(f"__b.{k}")
    failed = (b("n_words") < 10) | (100 * b("n_repeat_words") > 20 * b("n_words"))
    return d.select(*keep, F.struct(*[b(k).alias(k) for k in q], failed.alias("base_failed")).alias("__q"))


def vector(q: str = "__q") -> list[Column]:
    """The statistics, in whole units."""
    f = lambda k: F.col(f"{q}.{k}").cast("double")
    n = f("n_words") + PRIOR_WORDS
    return [F.round(c * UNIT).cast("bigint") for c in (F.log((f("word_chars") + 5 * PRIOR_WORDS) / n), F.log(1 + 10 * f("n_symbols") / n), f("n_repeat_words") / n, F.log((f("n_distinct") + PRIOR_WORDS) / n))]


def _distance(params_cols: bool = True) -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the Cholesky factor l00.. of the group's scatter (forward substitution)."""
    y: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") / float(UNIT) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _with_factor(df: DataFrame) -> DataFrame:
    """The columns l00.. : Cholesky factor of the scatter s00.. plus FLOOR² on the diagonal."""
    for i, j in _PAIRS:
        v = F.col(f"s{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    return df.select("g", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _PAIRS])


def _moments(agg: DataFrame, scale: float) -> DataFrame:
    """Centre and scaled scatter from count n, sums a0.. and products p00.. in units."""
    n = F.col("n").cast("double")
    df = agg.select("g", "n", *[F.col(f"a{i}").cast("double").alias(f"a{i}") for i in range(DIMS)], *[F.col(f"p{i}{j}").cast("double").alias(f"p{i}{j}") for i, j in _PAIRS])
    means = [(F.col(f"a{i}") / n / float(UNIT)).alias(f"m{i}") for i in range(DIMS)]
    scatter = [(scale * (F.col(f"p{i}{j}") / n - F.col(f"a{i}") / n * F.col(f"a{j}") / n) / float(UNIT**2)).alias(f"s{i}{j}") for i, j in _PAIRS]
    return _with_factor(df.select("g", *means, *scatter))


def _sums() -> list[Column]:
    one = [F.count(F.lit(1)).alias("n")]
    return one + [F.sum(f"x{i}").alias(f"a{i}") for i in range(DIMS)] + [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,0)")).alias(f"p{i}{j}") for i, j in _PAIRS]


def _again(cols: list[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def groups(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, g): the group that each language and source is estimated in."""
    from pyspark.sql import Window

    n = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_group
    pooled = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    name = lambda *c: F.to_json(F.array(*c))
    nul = F.lit(None).cast("string")
    g = F.when(~small, name("lang", "source")).when(pooled >= min_group, name("lang", nul, nul)).otherwise(name(nul, nul, nul))
    return n.select("lang", "source", g.alias("g"), "n")


def _joined(stats: DataFrame, params: DataFrame, n_groups: int, counts: DataFrame, total: int) -> DataFrame:
    if n_groups <= MAX_BROADCAST:
        return stats.join(F.broadcast(params), "g")
    return hot_join(stats, params.join(counts, "g"), "g", "n_of", total)


def estimate(stats: DataFrame, n_groups: int, counts: DataFrame, total: int) -> DataFrame:
    """Reweighted MCD of each group g of stats (g, x0..): m0.., l00.. ."""
    from pyspark.sql import Window

    sums = ["n"] + [f"a{i}" for i in range(DIMS)] + [f"p{i}{j}" for i, j in _PAIRS]
    # start: medians and quartile spreads, on counts of each value
    long = stats.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(DIMS)])).alias("d", "x")).groupBy("g", "d", "x").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "d").orderBy("x")
    long = long.withColumn("below", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "d")))
    at = lambda s: F.min(F.when(F.col("below") >= s * F.col("all"), F.col("x"))) / float(UNIT)
    quart = long.groupBy("g", "d").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda i, c: F.max(F.when(F.col("d") == i, c))
    spread = ((F.col("q3") - F.col("q1")) / 1.349) ** 2
    first = quart.groupBy("g").agg(*[pick(i, F.col("q2")).alias(f"m{i}") for i in range(DIMS)], *[pick(i, spread).alias(f"s{i}{i}") for i in range(DIMS)])
    params = stored(_with_factor(first.withColumns({f"s{i}{j}": F.lit(0.0) for i, j in _PAIRS if i != j})), "mcd")
    # concentration
    bin_ = F.floor(F.log2(F.greatest(F.least(_distance(), F.lit(HIGHEST)), F.lit(LOWEST))) * BINS_PER_OCTAVE).cast("int")
    for step in range(STEPS):
        near = _joined(stats, params, n_groups, counts, total).groupBy("g", bin_.alias("bin")).agg(*_sums())
        w = Window.partitionBy("g")
        near = near.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w))
        core = near.filter(F.col("before") < F.ceil(F.col("all") * CORE)).groupBy("g").agg(*_again(sums))
        params = stored(_moments(core, consistency(CORE) if step == STEPS - 1 else 1.0), "mcd")
    inside = _joined(stats, params, n_groups, counts, total).filter(_distance() <= chi2_quantile(0.975, DIMS)).groupBy("g").agg(*_sums())
    # a group with nothing inside keeps its core's estimate
    last = _moments(inside, consistency(0.975))
    return stored(last.unionByName(params.join(last, "g", "left_anti")), "mcd")


def with_verdict(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP, with_text: bool = True) -> DataFrame:
    """docs with __q (base statistics), __distance (squared) and __kept; with_text=False leaves the text out.

    The rows and their statistics are stored once, and both the estimates and the verdicts read them from there.
    """
    based = with_base(docs, text_col)
    if not with_text:
        docs = docs.drop(text_col)
        based = based.drop(text_col)
    based = stored(based, "based")
    key = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    raw = stored(based.select(*key, *[v.alias(f"x{i}") for i, v in enumerate(vector())]), "statistics")
    named = stored(groups(raw, min_group), "groups")
    n_named = named.count()
    small = n_named <= MAX_BROADCAST
    total = raw.count()
    stats = raw.join(F.broadcast(named.drop("n")), ["lang", "source"]) if small else stored(_by_two(raw, named, total), "statistics")
    counts = named.groupBy("g").agg(F.sum("n").alias("n_of"))
    params = estimate(stats.select("g", *[f"x{i}" for i in range(DIMS)]), counts.count(), counts, total)
    lookup = named.join(params, "g").drop("g")
    row = based.select(*[F.col(f"`{c}`") for c in docs.columns], "__q", *[k.alias(f"__{n}") for k, n in zip(key, ("lang", "source"), strict=True)], *[v.alias(f"__x{i}") for i, v in enumerate(vector())])
    lookup = lookup.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "n", *[F.col(c).alias(f"__{c}") for c in lookup.columns if c not in ("lang", "source", "n")])
    if small:
        row = row.join(F.broadcast(lookup.drop("n")), ["__lang", "__source"], "left")
    else:
        row = _by_two(row, lookup, total, "__lang", "__source")
    y: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"__x{i}") / float(UNIT) - F.col(f"__m{i}")
        for j in range(i):
            rest = rest - F.col(f"__l{i}{j}") * y[j]
        y.append(rest / F.col(f"__l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [v * v for v in y])
    kept = ~F.col("__q.base_failed") & F.coalesce(d2 <= chi2_quantile(CUTOFF, DIMS), F.lit(True))
    return row.select(*[F.col(f"`{c}`") for c in docs.columns], "__q", d2.alias("__distance"), kept.alias("__kept"))


def _by_two(left: DataFrame, right: DataFrame, total: int, a: str = "lang", b: str = "source") -> DataFrame:
    """hot_join on two columns."""
    key = lambda df: df.withColumn("__key", F.to_json(F.array(a, b)))
    return hot_join(key(left), key(right).drop(a, b), "__key", "n", total).drop("__key")


def op1(docs: DataFrame) -> DataFrame:
    q = with_verdict(docs.select("doc_id", "text", "lang", "source"), with_text=False)
    return q.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("__kept").alias("kept"), F.round("__distance", 3).alias("distance"))
