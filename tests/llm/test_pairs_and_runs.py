"""Operators 11 to 13 against plain versions, packing with a full pool, hand-labelled pages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import align, html, jaccard, packing, queries, runs
from tidemark.llm.common import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (None, "plain words of a text that has no id at all, but ten", "en", "s", 5), (3, " \n\t ", "en", "s", 3),
    (4, "same text here", "en", "s", 1), (4, "same text here", "en", "s", 1), (5, "alpha beta gamma delta " * 5000 + "tail", "de", None, 9), (6, "ünï çødé 日本 ☃ a\x1cb c d  e f", "fr", "s", 1),
    (8, "a\r\nb;\r\n\x0bc", "en", "s", 1), (9, "<|endoftext|> it's  \n\n 3.5% </s><0x41>", "en", "s", 1), (10, "a piece▁mark", "en", "s", 1), (11, "x " * 40, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in ("n", "node", "key", "start", "block", "pair", "root")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 11 Jaccard join


def joined(rows):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, x in enumerate(sets):
        shared = Counter(j for g in x for j in by[g])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(x) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for g in x:
            by[g].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(x), low.get(root(i)) if x else d) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True))), key=str)


def made_up():
    rng, rows = random.Random(3), []
    names = [f"w{i}" for i in range(3000)]
    for _ in range(12):
        base = [rng.choice(names) for _ in range(rng.choice([3, 8, 20, 60, 200, 500]))]
        for _ in range(rng.choice([1, 2, 5, 12, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(names)
            rows.append((len(rows) * 7 + 3, " ".join(w[: max(1, int(len(w) * rng.choice((1, 1, rng.uniform(0.85, 1)))))])))
    rows += [(1000 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))) for k in range(15)]
    return [*rows, (None, "some words without an id"), (None, None), (4, rows[0][1]), (4, rows[0][1]), (None, rows[5][1])]


@pytest.mark.parametrize(("small", "double"), [(6, None), (2, True), (1, False)])
def test_components_of_the_jaccard_join(small, double, spark, monkeypatch):
    """Small keys, keys taken in rounds, and both thresholds give the links of all pairs."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "FEW", 10_000 if double is None else 0)
    rows = made_up()
    got = jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), force=double)
    assert sorted((tuple(r) for r in got.collect()), key=str) == joined(rows)


def test_jaccard_join_of_documents_and_odd_rows(docs, odd, spark):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted((tuple(r) for r in jaccard.op11(df).collect()), key=str) == joined(rows)
    assert jaccard.op11(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("double", "extra"), [(0, 0), (3, 0), (6, 0), (0, 2), (4, 3), (8, 4)])
def test_linked_sets_share_a_key(double, extra):
    """The pigeonhole: whatever sets differ in at most 12 shingles meet at a key, with and without keys of empty segments."""
    rng, band = np.random.default_rng(1), jaccard.Band(13 + extra, double, extra)
    for n in (0, 5, 12, 40, 90):
        for _ in range(200):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            off = int(rng.integers(0, min(12, n) + 1))
            more = rng.integers(0, 2**63, 12 - off).astype(np.uint64)
            y = np.unique(np.r_[rng.permutation(x)[off:], more])
            assert len(np.setxor1d(x, y)) <= 12 and np.intersect1d(jaccard.keys(x, 4, band), jaccard.keys(y, 4, band)).size


def test_fewest_shingles_are_left_out():
    """A set indexes as many segments as links can differ in and one, whatever it has empty, and long sets are given units enough for that."""
    rng, band = np.random.default_rng(2), jaccard.Band(17, 0, 4)
    for n in (0, 5, 12, 40, 90):
        assert len(jaccard.keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), 4, band)) == 13
    long = jaccard.allocate(2000, 10_000, 2434)
    assert 2435 * math.exp(-10_000 / long.units) < long.extra and long.units == 2435 + long.extra


@pytest.mark.parametrize("middle", [0, 4])
def test_jaccard_rounds_after_middle_keys(middle, spark, monkeypatch):
    """Prefixes and their rounds give the links that keys of up to MIDDLE nodes don't, and components are joined step by step."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "MIDDLE", middle)
    monkeypatch.setattr(jaccard, "FEW", 3)
    rows = made_up()
    got = jaccard.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == joined(rows)


def test_bounds_of_the_join():
    rule = jaccard.Rule()
    for x in range(1, 200):
        for y in range(1, x + 1):
            for i in range(y + 1):
                if 100 * i >= 85 * (x + y - i):
                    assert x + y - 2 * i <= rule.most_apart(x + y) and x <= rule.largest(y)
    few, many = jaccard.allocate(1000, 300, 48), jaccard.allocate(10**9, 300, 48)
    assert few.double == 0 and few.extra < many.extra and many.units == 49 + many.extra
    assert jaccard.allocate(10**9, 5, 1) == jaccard.Band(2, 1) and jaccard.cost(10**9, 300, many) < jaccard.cost(10**9, 300, jaccard.Band(49)) / 1000
    a, b = (np.unique(np.random.default_rng(k).integers(0, 2**63, 500).astype(np.uint64)) for k in (1, 2))
    b = np.r_[a[:480], b[:30]]
    for places in (10, 1000, 100):
        apart = int(np.bitwise_count((jaccard.sketch(a, places) ^ jaccard.sketch(b, places)).view(np.uint64)).sum())
        assert 0 < apart <= len(np.setxor1d(a, b))
    wide, narrow = jaccard.sketch(a, 400), jaccard.sketch(a, 200)
    assert len(wide) == 2 * len(narrow) and (wide[: len(narrow)] ^ wide[len(narrow) :]).tolist() == narrow.tolist()


# 12 periodic runs


def all_runs(ids):
    """From the definition: at every period the longest stretches, each at its smallest period."""
    n, found = len(ids), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_with_runs(rng, n):
    for _ in range(n):
        k, x = rng.choice([1, 2, 2, 3, 5, 50]), []
        while len(x) < rng.choice([10, 60, 300, 700]):
            if rng.random() < 0.5:
                x += [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
            else:
                x += ([rng.randrange(k) for _ in range(rng.randrange(1, 30))] * rng.randrange(2, 9))[: rng.randrange(1, 200)]
        yield np.unique(np.array(x), return_inverse=True)[1]


@pytest.mark.parametrize("floor", [None, 5])
def test_lags_and_runs_match_the_definition(floor, monkeypatch):
    """floor 5: most words go through the FFT."""
    if floor:
        monkeypatch.setattr(runs, "heavy_floor", lambda n: floor)
    texts = list(texts_with_runs(random.Random(5), 120))
    for ids, counts in zip(texts, runs.lag_counts(texts), strict=True):
        assert counts.tolist() == [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, len(ids) // 3 + 1)]
        assert runs.find_runs(ids, counts) == all_runs(ids)
    assert runs.lag_counts([]) == [] and runs.find_runs(np.zeros(0, np.int64), runs.lag_counts([np.zeros(0, np.int64)])[0]) == []


def run_row(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words(text))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
    found = all_runs([number[x] for x in w])
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    out = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in out)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_documents_and_odd_rows(docs, odd):
    for df in (docs.filter("length(text) < 20000"), odd.filter("doc_id <> 5 or doc_id is null")):
        want = sorted((run_row(r.doc_id, r.text) for r in df.collect()), key=str)
        assert sorted((tuple(r) for r in runs.op12(df).select(*RUN_COLUMNS).collect()), key=str) == want
    long = runs.op12(odd.filter("doc_id = 5")).first()
    assert (long.n_runs, long.start, long.period) == (1, 0, 4) or zlib.crc32(b"5") % 10 == 0
    assert runs.op12(odd.limit(0)).count() == 0


def test_runs_come_with_texts_and_chunks_change_nothing(spark, monkeypatch):
    rows = [(k, "to be or not " * 12 + f"that is the question number {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = runs.detect(df, with_text=True).collect()
    assert all(bytes(r.collapsed).decode() == f"to be or not that is the question number {r.doc_id}" and [tuple(x) for x in r.runs] == [(0, 48, 4)] for r in got)
    want = runs.lag_counts([np.array([0, 1] * 40), np.array([0] * 9), np.zeros(0, np.int64)])
    monkeypatch.setattr(runs, "FLUSH", 3)
    assert [x.tolist() for x in runs.lag_counts([np.array([0, 1] * 40), np.array([0] * 9), np.zeros(0, np.int64)])] == [x.tolist() for x in want]


def test_a_long_text_of_one_word_is_quick():
    ids = np.zeros(200_000, np.int64)
    assert runs.find_runs(ids, runs.lag_counts([ids])[0]) == [(0, 200_000, 1)]


# 13 alignment


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


def aligned(texts, paths):
    """By the libraries' own calls over whole texts and sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(paths[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    made, count = [], Counter()
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b), strict=True)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            made.append(None)
            continue
        at_a, at_b = ({e: i for i, e in enumerate(np.cumsum([len(x) for x in parts]).tolist())} for parts in (bytes_a, bytes_b))
        cut, i, j, parts, links = sorted(set(at_a) & set(at_b)), 0, 0, [], []
        for c in cut:
            parts.append(",".join(map(str, a[i : at_a[c] + 1])) + "|" + ",".join(map(str, b[j : at_b[c] + 1])))
            links.append((a[at_a[c]], b[at_b[c]]))
            i, j = at_a[c] + 1, at_b[c] + 1
        count.update(links)
        made.append((len(a), len(b), len(cut), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    assert ends([b"ab", b"c"]) == [2, 3]
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(count[x] == top[x[1]] for x in m[3]), sum(count[x] for x in m[3]), m[4]) for m in made]


@pytest.mark.parametrize("block", [16 << 20, 20_000])
def test_alignment_matches_the_libraries(block, spark, docs, odd, paths):
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((d, *x) for (d, _), x in zip(rows, aligned([t for _, t in rows], paths), strict=True)), key=str)
    assert sorted((tuple(r) for r in align.align(df, *paths, block_bytes=block)[0].collect()), key=str) == want


def test_pairs_of_the_corpus_and_odd_tables(spark, odd, paths):
    rows, pairs = align.align(odd, *paths)
    assert rows.count() == len(ODD) and rows.filter("doc_id in (1, 2, 10)").agg(F.sum("n_a")).first()[0] == 0
    assert pairs.agg(F.sum("n")).first()[0] == rows.agg(F.sum("n_links")).first()[0]
    top = pairs.groupBy("b").agg(F.max("n").alias("m"), F.max(F.when(F.col("best"), F.col("n"))).alias("t"))
    assert top.filter("m <> t").isEmpty() and align.op13(odd.limit(0), *paths).count() == 0


def test_stabbing_queries_list_overlaps():
    rng = random.Random(4)
    for _ in range(300):
        total = rng.randint(1, 30)
        sizes = []
        for _ in range(2):
            cuts = sorted({0, total, *(rng.randint(0, total) for _ in range(rng.randint(0, 9)))})
            sizes.append(np.diff(cuts))
        first, last = align.overlaps(*sizes)
        ends = [np.cumsum(s) for s in sizes]
        for i, e in enumerate(ends[0]):
            over = [j for j, f in enumerate(ends[1]) if f > e - sizes[0][i] and f - sizes[1][j] < e]
            assert [first[i], last[i]] == [over[0], over[-1]]
        end_a, end_b, _ = align.groups(*sizes)
        assert ends[0][end_a].tolist() == ends[1][end_b].tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


# 10 packing with a full pool


def placed_right(rows, ids_of):
    """Each piece's bytes and digest are those of its place in its document, and the places leave no gap."""
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for doc_id, of in by.items():
        ids, at = ids_of(doc_id), 0
        for r in sorted(of, key=lambda r: r.start):
            want = ids[4 * r.start : 4 * (r.start + r.length)]
            assert r.start == at and zlib.crc32(want) == r.ids_crc32 and r.doc_tokens == len(ids) // 4
            assert "ids" not in r or bytes(r.ids) == want
            at += r.length
        assert at == len(ids) // 4
    return len(by)


def library_ids(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer(name))
    return lambda text: np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()


@pytest.mark.parametrize("pool", [1, 8, 200])
def test_ids_are_right_when_the_pool_overflows(pool, spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").coalesce(1)
    encode = library_ids("byte_bpe_50k.json")
    text = {r.doc_id: encode(r.text) for r in docs.collect()}
    for limits in (packing.QUERY_LIMITS, packing.Limits(64, 3, 50)):
        got = packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), limits=limits, prompt=packing.first_line(), pool=pool).collect()
        assert placed_right(got, text.__getitem__) == len(text)
        bins = defaultdict(lambda: [0, 0, 0])
        for r in got:
            for k, v in enumerate((r.length, 1, r.loss_tokens)):
                bins[r.sequence_id][k] += v
        assert all(t <= limits.tokens and s <= limits.segments and x <= limits.loss for t, s, x in bins.values())


def test_ids_are_right_at_the_production_pool(spark, sf):
    """The larger table in one task overflows the real pool, in the query and in the pipeline's last stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf.replace("sf0.001", "sf0.1"), "documents").coalesce(1)
    assert docs.count() > packing.POOL
    encode = library_ids("byte_bpe_50k.json")
    text = {r.doc_id: encode(r.text) for r in docs.collect()}
    for got in (packing.op10(docs, queries.tokenizer("byte_bpe_50k.json")), pipeline.packed(spark, docs, sf)):
        assert placed_right(got.collect(), text.__getitem__) == len(text)


# 9 pages that no generator made

ONE = "The river rose for three days before the town moved its boats to higher ground."
TWO = "By the fourth morning the water stood at the second step of the old hall, and people came to look."
PAGES = [
    (f"<div><p>{ONE}</p><p>{TWO}</p></div>", [ONE, TWO]),
    (f"<html><body><div id='bodyContent'><h1>Flood</h1><p>{ONE}</p><p>{TWO}</p></div></body></html>", ["Flood", ONE, TWO]),
    (f"<body><article><p>{ONE}</p></article><div id='disqus_thread'><p>Nice story, thanks for it.</p><p>I was there as well.</p></div>", [ONE]),
    (f"<body><div class='content'><p>{ONE}</p><p>{TWO}</p></div><div id='disqus_thread'><p>Nice story, thanks for it.</p></div>", [ONE, TWO]),
    (f"<table><tr><td class='nav'>Home</td><td><p>{ONE}</p><p>{TWO}</p></td></tr></table>", [ONE, TWO]),
    (f"<article><p>{ONE}</p><!--><p>{TWO}</p></article>", [ONE, TWO]),
    (f"<article><p>{ONE}</p><!-- x --!><p>{TWO}</p></article>", [ONE, TWO]),
    (f"<article><p>{ONE}</p><!---><p>{TWO}</p></article>", [ONE, TWO]),
    (f"<body><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul><div class=x><h2>A flood</h2><p>{ONE}</p><p>{TWO}</p></div><div class=footer>Copyright 2020 The Paper</div>", ["A flood", ONE, TWO]),
    (f"<body><p>{ONE}</p><p>{TWO}</p>", [ONE, TWO]),
    (f"<p>{ONE}</p>", [ONE]),
    (f"<div id=page><div id=menu><a href=/>Home</a> <a href=/a>About</a></div><div id=story><p>{ONE}<p>{TWO}</div><div class=sidebar><p>Subscribe to our letter today.</p></div></div>", [ONE, TWO]),
    (f"<main role=main><section><h2>Part one</h2><p>{ONE}</p></section><section><h2>Part two</h2><p>{TWO}</p></section></main><aside><p>Read more of this.</p></aside>", ["Part one", ONE, "Part two", TWO]),
]


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_pages_labelled_by_hand(at):
    page, want = PAGES[at]
    assert html.extract_all([page], *html.model())[0] == want


def test_comments_end_as_in_the_standard():
    seen = lambda page: [b.text for b in html.blocks(page)]
    assert seen("<p>a<!-->b<p>c") == ["ab", "c"] and seen("<p>a<!--->b<p>c") == ["ab", "c"] and seen("<p>a<!--x--!>b<p>c") == ["ab", "c"]
    assert seen("<p>a<!-- - -> -- > x -->b") == ["ab"] and seen("<p>a<!-- never") == ["a"]
    assert html._ancestor("div", " id='bodyContent'") == html._ancestor("div", " class='content body'") or set(html._ancestor("div", " id='bodyContent'")) == set(html._ancestor("div", " class='content body'"))
