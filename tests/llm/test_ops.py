"""Training-data operators against plain versions, on whole small tables and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html, licenses, lm, packing, pii, quality, queries, simhash, tokens, tokenstore, warc
from tidemark.llm.common import hot_join, new_path, table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls in every column, empty and blank texts, repeated rows, ties, a long text, odd characters.
LONG = "alpha beta gamma delta " * 30000 + " tail@mail.example.com"
AWKWARD = [
    (1, None, "en", "s", None), (2, "", None, None, 0), (None, "plain words of a text that has no id at all, but ten", "en", "s", 5), (3, " \n\t ", "en", "s", 3),
    (4, "same text here", "en", "s", 1), (4, "same text here", "en", "s", 1), (5, LONG, "de", None, len(LONG)), (6, "ünï çødé 日本 ☃ a\x1cb c d  e f", "fr", "s", 1),
    (7, "mail me at a.b@c.de or +1 (443) 555-5793 from 10.0.0.1 card 4111 1111 1111 1111", "en", "s", 1), (8, "Released under the MIT License.\nx", "en", "s", 1), (9, "<|endoftext|> it's  \n\n 3.5%", "en", "s", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(AWKWARD, DOCS).withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "fp": F.lit("y"), "spans": F.lit(0), "block": F.lit(2), "start": F.lit(1.5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def plain(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_large_ids_keep_their_digits_beside_nulls(spark):
    big = [2**62 + 1, None, 2**53 + 1, -(2**62) - 3, 7]
    rows = [(i, f"the text of number {k} with a@b.cd and one two three four five six seven eight nine ten {'z' * 1200}", "en", "s", 1) for k, i in enumerate(big)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    ids = lambda df: sorted((r[0] for r in df.collect()), key=str)
    want = sorted(big, key=str)
    none = spark.createDataFrame([], "item_id bigint, text string")
    word, byte = queries.tokenizer("word_bpe_49k.json"), queries.tokenizer("byte_bpe_50k.json")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    for got in (quality.op1(docs), pii.op3(docs), tokenstore.op4(docs, word), simhash.op5(docs), licenses.op6(docs), decontaminate.op7(docs, none), lm.op8(docs, queries.tokenizer(lm.PIECES)), warc.op2(pages), html.op9(pages)):
        assert ids(got) == want
    assert {r.doc_id for r in packing.op10(docs, byte).collect()} == set(big)
    same = warc.op2(pages.withColumn("html", F.repeat(F.lit("w"), 2000))).collect()
    assert sorted((r.page_id, r.refers_to) for r in same if r.page_id is not None) == [(-(2**62) - 3, 2**62 + 1), (7, 2**62 + 1), (2**53 + 1, 2**62 + 1), (2**62 + 1, None)]


# 1 quality


def base_rules(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def brute_mcd(x, lang, source, min_group=quality.MIN_GROUP):
    """Distances by the same definition in numpy, one group after another."""
    u, p = quality.UNIT, quality.DIMS
    n = Counter(zip(lang, source, strict=True))
    pooled = Counter()
    for (g, _), c in n.items():
        pooled[g] += c if c < min_group else 0
    key = [("s", a, b) if n[a, b] >= min_group else ("l", a) if pooled[a] >= min_group else ("*",) for a, b in zip(lang, source, strict=True)]
    out = np.zeros(len(x))
    for g in set(key):
        rows = np.array([i for i, k in enumerate(key) if k == g])
        v = x[rows] / u
        s = np.sort(x[rows], axis=0)
        at = lambda q: np.array([s[math.ceil(q * len(s)) - 1, j] for j in range(p)]) / u  # noqa: E731, B023
        floor = np.diag(np.square(quality.FLOOR))
        dist = lambda m, c: np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c + floor), v - m)  # noqa: E731, B023
        m, c = at(0.5), np.diag(np.square((at(0.75) - at(0.25)) / 1.349))
        for step in range(quality.STEPS):
            d = dist(m, c)
            b = np.floor(np.log2(np.clip(d, quality.LOWEST, quality.HIGHEST)) * quality.BINS_PER_OCTAVE)
            before = np.array([(b < y).sum() for y in b])
            core = v[before < math.ceil(len(v) * quality.CORE)]
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) * (quality.consistency(quality.CORE) if step == quality.STEPS - 1 else 1)
        inside = v[dist(m, c) <= quality.chi2_quantile(0.975, p)]
        if len(inside):
            m, c = inside.mean(axis=0), np.cov(inside.T, bias=True) * quality.consistency(0.975)
        out[rows] = dist(m, c)
    return out


def test_quality_matches_brute_force(spark, docs, plain):
    got = quality.op1(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = [base_rules(t) for t in plain.text]
    assert list(got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False, name=None)) == want
    assert list(got.base_failed) == [n < 10 or 100 * r > 20 * n for n, _, _, _, r in want]
    pr = quality.PRIOR_WORDS
    r = lambda v: math.floor(v * quality.UNIT + 0.5)
    x = np.array([[r(math.log((c + 5 * pr) / (n + pr))), r(math.log(1 + 10 * s / (n + pr))), r(k / (n + pr)), r(math.log((len(set(words(t))) + pr) / (n + pr)))] for (n, c, s, _, k), t in zip(want, plain.text, strict=True)], dtype=float)
    d = brute_mcd(x, list(plain.lang), list(plain.source))
    assert np.abs(got.distance - d).max() < 0.05 * (1 + np.abs(d).max()) / 10
    cut = quality.chi2_quantile(quality.CUTOFF, quality.DIMS)
    assert list(got.kept) == [not b and v <= cut for b, v in zip(got.base_failed, d, strict=True)]


def test_quality_keeps_labelled_good_documents(spark, sf, docs):
    m = quality.op1(docs).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    good = m.filter("quality = 1")
    assert good.filter("kept").count() == good.count()
    assert m.filter("quality = 0 AND kept").count() <= 0.15 * max(1, m.filter("quality = 0").count()) + 1


def test_quality_is_native(spark, docs):
    plan = quality.op1(docs)._jdf.queryExecution().executedPlan().toString() + quality.with_base(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_small_groups_are_pooled(spark):
    r = [(i, "one two three four five six seven eight nine ten " + str(i), "en" if i % 3 else "xx", f"s{i % 50}", 1) for i in range(200)]
    g = quality.groups(spark.createDataFrame(r, DOCS), 100)
    assert g.select("g").distinct().count() == 2 and g.agg(F.sum("n")).first()[0] == 200


# 2 warc


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "u", big), (2, None, big), (9, "ü", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "nobody"), (7, "u", "é" * 500), (8, "u", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    manifest = warc.write(warc.mark_revisits(pages), new_path(spark, "t"))
    for r in manifest.collect():  # on disk the dictionary's frame leads, and nothing is packed around the frames
        with open(r.path.removeprefix("file://"), "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.DICT_MAGIC
    got = {r.page_id: r for r in warc.read(spark, manifest).collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r.record_type == "revisit"} == {1, 2, 7}
    assert got[1].refers_to == 9 and got[2].refers_to == 9 and got[7].refers_to == 8 and got[9].refers_to is None
    for k, _, h in rows:
        data = (h or "").encode()
        assert got[k].payload_bytes == len(data) and got[k].payload_digest == hashlib.sha1(data).hexdigest()
        assert got[k].record_type == "revisit" or bytes(got[k].payload) == data
    assert got[2].url is None and got[9].url == "ü"
    assert warc.op2(pages.limit(0)).count() == 0


def test_many_empty_pages_and_many_copies(spark):
    """Pages under the bound never meet in a task, and revisits are the same whether digests are broadcast or joined."""
    pages = spark.range(60000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.repeat(F.lit("z"), 1200)).otherwise(F.repeat((F.col("id") % 9000).cast("string"), 400)).alias("html"))
    few, many = warc.mark_revisits(pages), warc.mark_revisits(pages, max_broadcast=0)
    light = lambda d: d.select("page_id", "digest", "refers_to")
    assert light(few).exceptAll(light(many)).isEmpty() and light(many).exceptAll(light(few)).isEmpty()
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    top = few.filter("page_id % 3 = 1").groupBy("refers_to").count().collect()
    assert {(r.refers_to, r["count"]) for r in top} == {(59998, 19999), (None, 1)}
    assert few.filter("page_id % 3 = 0 AND refers_to IS NOT NULL").isEmpty()


def test_revisits_are_held_against_their_response(spark):
    rows = [(9, 2000, "a", "response", None), (1, 2000, "a", "revisit", 9)]
    names = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    warc.verify_revisits(spark.createDataFrame(rows, names))
    for bad in ((1, 2000, "b", "revisit", 9), (1, 1999, "a", "revisit", 9), (1, 2000, "a", "revisit", 8)):
        with pytest.raises(ValueError, match="revisit"):
            warc.verify_revisits(spark.createDataFrame([*rows, bad], names))


def test_fields_and_digests_in_other_forms():
    import base64

    sha = hashlib.sha1(b"hello").digest()
    rec = warc.record(1, "u", b"hello", sha.hex(), None)
    assert warc.decode(rec.replace(sha.hex().encode(), base64.b32encode(sha)))[4] == sha.hex()
    assert warc.decode(rec.replace(b"WARC-Type", b"warc-type").replace(b"Content-Length", b"content-LENGTH"))[2] == b"hello"
    for bad in (rec.replace(b"WARC-Payload-Digest: sha1", b"X-Other: sha1"), rec.replace(b"WARC-Type: response", b"WARC-Type: nonsense"), rec.replace(b"sha1:", b"md5:"), rec.replace(sha.hex().encode(), b"abc")):
        with pytest.raises(ValueError):
            warc.decode(bad)


def test_equal_largest_ids_are_all_responses(spark):
    pages = spark.createDataFrame([(5, "u", "y" * 1500), (5, "u", "y" * 1500), (1, "u", "y" * 1500)], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.op2(pages).collect()) == [(1, "revisit"), (5, "response"), (5, "response")]


def test_archives_are_validated(tmp_path):
    import io

    rec = warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    s = io.BytesIO()
    w = warc.Writer(s, [b"hello world " * 40] * 30)
    w.write(rec)
    w.write(rec)
    data = s.getvalue()
    assert [r for _, r in warc.frames(io.BytesIO(data))] == [rec, rec]
    assert warc.decode(rec)[2] == b"hello"
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))
    for bad in (rec.replace(b"WARC/1.1", b"HTTP/1.1"), rec.replace(b"Content-Length: ", b"Content-Length: 1"), rec.replace(b"WARC-Type: response\r\n", b""), rec.replace(b"hello", b"jello"), rec[:-2]):
        with pytest.raises(ValueError):
            warc.decode(bad)
    import zstandard

    plain = zstandard.ZstdCompressor().compress(rec)
    assert [r for _, r in warc.frames(io.BytesIO(plain + plain))] == [rec, rec]  # without a dictionary


def _foreign(kind, name, block, **fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"Content-Length: {len(block)}", f"WARC-Date: {fields.pop('date', '2019-03-01T10:20:30Z')}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_from_elsewhere(spark, tmp_path):
    """Ids that aren't pages, all types of records, revisits with HTTP headers and without a length."""
    import base64

    import zstandard

    http, body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", b"<p>hello</p>" * 200
    sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    recs = [
        _foreign("warcinfo", "a0", b"software: x\r\n", Content_Type="application/warc-fields"), _foreign("request", "a1", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/"),
        _foreign("response", "a2", http + body, WARC_Target_URI="<http://a/>", WARC_Payload_Digest=sha, Content_Type="application/http; msgtype=response"), _foreign("metadata", "a3", b"x: 1\r\n", date="2019"),
        _foreign("revisit", "a4", http, WARC_Target_URI="http://b/", WARC_Payload_Digest=sha, WARC_Refers_To="<urn:uuid:a2>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        _foreign("revisit", "a5", http, WARC_Target_URI="http://a/", WARC_Refers_To="<urn:uuid:a2>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/server-not-modified"), _foreign("resource", "a6", b"plain", date="2019-03-01T10:20:30.123456Z"),
    ]
    d = warc.dictionary(recs * 20)
    to = zstandard.ZstdCompressor(dict_data=d)
    packed = zstandard.ZstdCompressor().compress(d.as_bytes())  # the dictionary's frame may itself be compressed
    (tmp_path / "x.warc.zst").write_bytes(warc.DICT_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + b"".join(to.compress(r) for r in recs))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.zst",)], "path string")
    records = warc.read(spark, manifest)
    got = {r.record_id: r for r in records.collect()}
    assert [got[f"urn:uuid:a{i}"].record_type for i in range(7)] == ["warcinfo", "request", "response", "metadata", "revisit", "revisit", "resource"]
    assert bytes(got["urn:uuid:a2"].payload) == body and got["urn:uuid:a2"].url == "http://a/" and all(r.page_id is None for r in got.values())
    assert got["urn:uuid:a4"].payload_bytes is None and got["urn:uuid:a4"].refers_to_id == "urn:uuid:a2" and got["urn:uuid:a4"].payload_digest == hashlib.sha1(body).hexdigest() and got["urn:uuid:a5"].payload_digest is None
    whole = {r.record_id: r for r in warc.with_lengths(records).collect()}
    assert len(whole) == 7 and {whole[f"urn:uuid:a{i}"].payload_bytes for i in (2, 4, 5)} == {len(body)} and whole["urn:uuid:a5"].payload_digest == hashlib.sha1(body).hexdigest()
    warc.verify_revisits(records)
    warc.verify_revisits(warc.with_lengths(records))
    for bad in (recs[0].replace(b"2019-03-01T10:20:30Z", b"1 March 2019"), recs[4].replace(b"WARC-Payload-Digest: sha1:", b"X: "), recs[2].replace(b"<p>", b"<q>"), recs[1].replace(b"Content-Length: 18", b"Content-Length: 17")):
        with pytest.raises(ValueError):
            warc.decode(bad)
    other = records.withColumn("payload_digest", F.when(F.col("record_id") == "urn:uuid:a4", F.lit("0" * 40)).otherwise(F.col("payload_digest")))
    with pytest.raises(ValueError, match="revisit"):
        warc.verify_revisits(other)


# 3 personal data


def base_brute(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0 or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_patterns_match_the_plain_expressions():
    rng = random.Random(4)
    texts = [t for _, t, *_ in AWKWARD if t and len(t) < 999] + ["a@b.c@d.e.f", "a@@b.c", "1.2.3.4.5.6.7.8.9", "300.1.1.1", "0001.2.3.4", "..@x.y", "x@y..z", "+1 2", "+1 (2)3-4.5 6789 01+44 20 7946 0958 x", "4111-1111-1111-1111 4111111111111112"]
    texts += ["".join(rng.choice("ab1234567890.@+-() \n%_é") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == base_brute(t), t


def test_messages_agree_with_enumeration():
    """On a graph with a cycle, small weights: loopy beliefs are near the exact marginals; on a chain they are exact."""
    rng = np.random.default_rng(0)
    pair = rng.normal(size=(3, 5, 5)) * 0.3
    w = np.zeros((pii.DIM, 5))
    feats = [[1], [2], [3], [4]]
    w[1:5] = rng.normal(size=(4, 5))
    for ij, kind, tol in ((np.array([[0, 1], [1, 2], [2, 3]]), np.array([0, 0, 0]), 1e-3), (np.array([[0, 1], [1, 2], [2, 3], [0, 3]]), np.array([0, 0, 0, 1]), 0.03)):
        arrays = (4, np.arange(4), np.array([f[0] for f in feats]), ij, kind, np.full(4, -1))
        got, _ = pii.beliefs(w, pair, arrays)
        total = np.zeros((4, 5))
        for y in np.ndindex(5, 5, 5, 5):
            p = math.exp(sum(w[f[0], k] for f, k in zip(feats, y, strict=True)) + sum(pair[t, y[i], y[j]] for (i, j), t in zip(ij, kind, strict=True)))
            for v in range(4):
                total[v, y[v]] += p
        assert np.abs(got - total / total.sum(axis=1, keepdims=True)).max() < tol


def test_held_out_accuracy_and_consistency():
    w, pair = pii.model()
    rng, hit, want_n, wrong = random.Random(77), 0, 0, 0
    for _ in range(200):
        t, found = pii.generate(rng)
        base, added = pii.find_spans([t], w, pair)[0]
        want = [(pii.KINDS[k - 1], s, e) for s, e, k in found]
        over = lambda g, x: g[0] == x[0] and g[1] < x[2] and x[1] < g[2]
        hit += sum(any(over(g, x) for g in base + added) for x in want)
        want_n += len(want)
        wrong += sum(not any(over(g, x) for x in want) for g in added)
    assert hit >= 0.97 * want_n and wrong <= 0.01 * want_n
    # the second mention has no plus sign; its twin in the same document gives it away
    t = "call +1 (443) 555-5793 now. later we rang 443-555-5793 and then 443-555-5793 again"
    assert [k for k, *_ in pii.find_spans([t], w, pair)[0][1]] == ["phone", "phone"]
    assert pii.redact(t, [("phone", 5, 22)]).startswith("call <PHONE> now")


def test_personal_data_rows(awkward, empty, docs, plain):
    got = {r.doc_id: r for r in pii.op3(docs).collect()}
    for i, t in zip(plain.doc_id, plain.text, strict=True):
        base = base_brute(t or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
    assert pii.op3(awkward).count() == len(AWKWARD) and pii.op3(empty).count() == 0


# 4 and 10 tokens


def _ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes()


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_memo_equals_the_library(name, drops, plain):
    e = tokens.Encoder(queries.tokenizer(name), drops)
    rng = random.Random(3)
    texts = [t or "" for _, t, *_ in AWKWARD if len(t or "") < 999] + list(plain.text[:60]) + ["a<|endoftext|>b c", "<|ENDOFTEXT|> x", "<|startoftext|>", "< | a <|b"]
    texts += ["".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "'s", ".", "%", "7", "\t", "　", "日", "ß", "İ", "ﬁ", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for t in texts:
        assert e.encode(t.encode()) == np.asarray(e.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_token_store(spark, docs, plain, awkward, empty):
    path = queries.tokenizer("word_bpe_49k.json")
    folder = new_path(spark, "store")
    tokenstore.write(docs.repartition(3), folder, path)
    got = tokenstore.read(spark, folder).orderBy("doc_id").collect()
    start = 0
    for r, i, t in zip(got, plain.doc_id, plain.text, strict=True):
        ids = _ids("word_bpe_49k.json", t, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += r.n_tokens
    r = spark.read.schema(tokenstore._RECIPE).parquet(f"{folder}/recipes")
    one = r.select(F.explode(F.arrays_zip("digests", "packs")).alias("c")).select("c.*")
    assert one.filter("packs IS NOT NULL").count() == one.select("digests").distinct().count()  # each chunk is stored once
    assert tokenstore.op4(awkward, path).agg(F.sum("n_tokens")).first()[0] == tokenstore.op4(awkward, path).agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    assert tokenstore.op4(awkward, path).count() == len(AWKWARD) and tokenstore.op4(empty, path).count() == 0


def test_a_broken_store_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    d = spark.createDataFrame([(i, f"word{i} " * 400, "en", "s", 1) for i in range(5)], DOCS)
    tokenstore.write(d, folder, queries.tokenizer("word_bpe_49k.json"))
    pack = next((tmp_path / "store/packs").glob("*.pack"))
    data = bytearray(pack.read_bytes())
    data[10] ^= 1
    pack.write_bytes(bytes(data))
    with pytest.raises(Exception, match="address"):
        tokenstore.read(spark, folder).collect()


def test_the_manifest_is_a_merkle_tree(spark, docs):
    """Its roots are those of a plain tree, and no field of a recipe can change without them."""
    folder = new_path(spark, "store")
    tokenstore.write(docs, folder, queries.tokenizer("word_bpe_49k.json"))
    recipes = spark.read.schema(tokenstore._RECIPE).parquet(f"{folder}/recipes")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def fold(nodes):
        while True:
            nodes = [sha("|".join(nodes[i : i + tokenstore.FANOUT])) for i in range(0, len(nodes), tokenstore.FANOUT)]
            if len(nodes) == 1:
                return nodes[0]

    parts = {}
    for r in recipes.orderBy("part", "seq").collect():
        parts.setdefault(r.part, []).append(sha(f"{r.part}|{r.seq}|{r.doc_id}|{r.local_start}|{r.n_tokens}|{bytes(r.root).hex().upper()}"))
    told = {r.part: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
    assert {k: r.root for k, r in told.items()} == {k: fold(v) for k, v in parts.items()}
    assert {r.store for r in told.values()} == {fold([told[k].root for k in sorted(told)])}
    same = tokenstore.manifest(recipes)
    for column in ("doc_id", "local_start", "n_tokens", "root"):
        other = recipes.withColumn(column, F.when(F.col("seq") == 1, F.lit(None)).otherwise(F.col(column)))
        assert not same.select("root").exceptAll(tokenstore.manifest(other).select("root")).isEmpty()


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40000, 9000), rng.integers(0, 40000, 500)
    cuts = lambda x: {x[s:e].tobytes() for s, e in zip([0, *tokenstore.cut_points(x)[:-1]], tokenstore.cut_points(x), strict=True)}
    assert len(cuts(a) & cuts(np.concatenate([b, a]))) >= 0.7 * len(cuts(a))
    e = tokenstore.cut_points(a)
    assert all(tokenstore.MIN_CHUNK <= y - x <= tokenstore.MAX_CHUNK for x, y in zip([0, *e[:-2]], e[:-1], strict=True))


def test_packing_loses_nothing(docs, plain, awkward, empty):
    path = queries.tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs, path).toPandas()
    text = dict(zip(plain.doc_id, plain.text, strict=True))
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        ids = _ids("byte_bpe_50k.json", text[i], 0)
        assert b"".join(map(bytes, g.ids)) == ids and list(g.start) == [0, *g.length.cumsum()[:-1]] and set(g.doc_tokens) == {len(ids) // 4}
        assert list(g.ids_crc32) == [zlib.crc32(bytes(x)) for x in g.ids]
    assert got.doc_id.nunique() == len(plain)
    pad = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = int(g.length.sum())
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and n <= 1024
        pad += 0 if n & (n - 1) == 0 else 1024 - n
    assert pad <= 0.001 * got.length.sum() + 1024
    assert packing.op10(awkward, path).select("doc_id").distinct().count() == len({r[0] for r in AWKWARD}) and packing.op10(empty, path).count() == 0


def test_vector_limits_hold():
    rng, lim = random.Random(1), packing.Limits(64, 4, 40)
    p, out, total = packing.Packer(lim, 50), [], {}
    for k in range(3000):
        n = min(int(rng.paretovariate(0.8) * 20), 5000)
        total[k] = n
        out += p.put(packing.Item(k, 0, n, rng.randint(0, n)))
    out += p.drain()
    assert all(sum(i.tokens for i in b) <= 64 and len(b) <= 4 and sum(i.loss for i in b) <= 40 for b in out)
    assert Counter({k: sum(i.tokens for b in out for i in b if i.key == k) for k in list(total)[:50]}) == Counter({k: total[k] for k in list(total)[:50]})
    for b in out:  # short ones are a power of two, or within the slack
        n = sum(i.tokens for i in b)
        assert n & (n - 1) == 0 or (64 - n) * packing.SLACK <= 64
    assert any(sum(i.tokens for i in b) < 64 and len(b) == 4 for b in out) and any(sum(i.loss for i in b) == 40 for b in out)


def test_the_choice_is_the_largest_dot_product():
    rng, lim = random.Random(2), packing.Limits(100, 8, 50)
    p = packing.Packer(lim, 1000)
    for k in range(400):
        n = rng.randint(1, 100)
        p._wait(packing.Item(k, 0, n, rng.randint(0, min(n, 50))))
    for _ in range(200):
        t, loss = rng.randint(0, 100), rng.randint(0, 50)
        dot = {i: it.tokens / 100 * t / 100 + it.loss / 50 * loss / 50 for i, it in enumerate(p.waiting) if it.tokens <= t and it.loss <= loss}
        k = p.best(t, loss)
        assert (k < 0 and not dot) or dot[k] == pytest.approx(max(dot.values()))
        if k >= 0 and len(p.waiting) > 50:
            p._take(k)
    # two items of as many tokens: the bin with little room for loss takes neither the longest nor the first
    q = packing.Packer(lim, 10)
    for k, (n, loss) in enumerate(((40, 0), (40, 30), (60, 45))):
        q._wait(packing.Item(k, 0, n, loss))
    assert q.best(50, 35) == 1 and q.best(100, 50) == 2 and q.best(60, 10) == 0


def test_packing_under_binding_limits(docs):
    got = packing.op10(docs, queries.tokenizer("byte_bpe_50k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("l"), F.count(F.lit(1)).alias("k")).collect()
    lim = packing.QUERY_LIMITS
    assert all(r.n <= lim.tokens and r.l <= lim.loss and r.k <= lim.segments for r in got)
    assert any(r.l == lim.loss for r in got) and any(r.n == lim.tokens for r in got)
    pad = sum(0 if r.n & (r.n - 1) == 0 else lim.tokens - r.n for r in got)
    assert pad <= 0.001 * sum(r.n for r in got) + 1024


# 5 simhash


def fingerprint_brute(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components_brute(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


def test_simhash_matches_brute_force(docs, plain):
    got = simhash.op5(docs).toPandas().sort_values("doc_id")
    fps = [fingerprint_brute(t) for t in plain.text]
    assert list(got.fingerprint) == [f"{f:016x}" for f in fps]
    assert list(got.component_id) == components_brute(list(plain.doc_id), fps)


def test_simhash_awkward(awkward, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in simhash.op5(awkward).collect())
    fps = [fingerprint_brute(t) for _, t, *_ in AWKWARD]
    comp = components_brute([r[0] for r in AWKWARD], fps)
    assert got == sorted((r[0] if r[0] is not None else -1, f"{f:016x}", c if c is not None else -1) for r, f, c in zip(AWKWARD, fps, comp, strict=True))
    assert simhash.op5(empty).count() == 0


def _clusters(seed=0, n=300):
    rng = np.random.default_rng(seed)
    fp = [int(x) for x in rng.integers(0, 2**63, n, dtype=np.uint64)]
    for x in list(fp[:60]):
        for _ in range(int(rng.integers(1, 20))):
            y = x
            for b in rng.integers(0, 64, int(rng.integers(1, 7))):
                y ^= 1 << int(b)
            fp.append(y)
    return sorted(set(fp))


@pytest.mark.parametrize("m", [5, 6, 7])
def test_trie_join_finds_every_link(m):
    fp = np.array(_clusters(), dtype=np.uint64)
    want = components_brute(list(range(len(fp))), [int(x) for x in fp])
    pairs = []
    for order, lead in simhash.orders(m, 4):
        p = simhash.permuted(fp, order)
        head = p >> np.uint64(64 - lead)
        at = np.lexsort((p, head))
        i, j = simhash.trie_links(p[at], np.cumsum(np.r_[0, head[at][1:] != head[at][:-1]]), lead, 4)
        pairs += list(zip(at[i], at[j], strict=True))
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in pairs)
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(fp))] == want


def test_big_subtrees_are_cut_and_lose_nothing(spark):
    fp = _clusters(3, 200)
    near = {(fp[0] ^ (1 << a) ^ (1 << b)) for a in range(64) for b in range(a)}
    fp = sorted(set(fp) | near)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {(r.a, r.b) for r in simhash.links(df, 4, max_node=64).collect()}
    at = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        i, j = find(at[a]), find(at[b])
        parent[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(fp))] == components_brute(list(range(len(fp))), fp)


def test_roots_of_long_paths(spark):
    path = [(i + 1, i) for i in range(40)] + [(200 + i, 100) for i in range(30)] + [(500, 499)]
    got = {r.node: r.root for r in simhash.roots(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[200 + i] == 100 for i in range(30)) and got[500] == 499


def test_roots_split_a_hot_root(spark):
    """Thousands of children of one root without a parent: no task of the join holds them."""
    edges = spark.range(1, 6000).select(F.col("id").alias("a"), F.when(F.col("id") <= 4000, F.lit(0)).otherwise(F.col("id") - 1).alias("b"))
    got = simhash.roots(edges)
    assert got.filter("root <> 0 AND node <= 4000").isEmpty() and got.count() == 5999


def test_hot_join_is_a_join(spark):
    left = spark.range(5000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 300)).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 5").withColumn("w", F.col("k") * 2)
    for how in ("inner", "left"):  # key 5, which right lacks, is not hot
        a = hot_join(left, right, "k", "n", 5000, how).select("k", "v", "w")
        b = left.join(right.drop("n"), "k", how).select("k", "v", "w")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# 6 licences


def test_licences(spark, docs, awkward, empty):
    rows = [(1, "Some words.\nReleased under the MIT License.\nMore."), (2, "The license plate of the car was new."), (3, "intro Licensed under CC BY-NC 4.0. outro"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."), (7, "the apache helicopter and the public domain of math")]
    got = {r.doc_id: r for r in licenses.op6(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].families for i in range(1, 8)] == ["mit", "", "cc-by-nc", "", "", "apache,gpl", ""]
    assert licenses.op6(empty).count() == 0 and licenses.op6(awkward).filter("families = 'mit'").count() == 1
    lic = docs.select("doc_id", F.col("text").rlike("(Released under the MIT License|Licensed under the Apache License|GNU General Public License, version 3|Licensed under CC BY-NC|All rights reserved)").alias("has"))
    bad = licenses.op6(docs).join(lic, "doc_id").filter((F.col("families") != "") != F.col("has"))
    assert bad.count() == 0


def licence_verdict(paragraph):
    """(family, probability, confirmed) by the model, in plain numpy."""
    m = licenses.model()
    weights = dict(m["weights"])
    s = np.array(m["bias"]) + sum((np.array(weights[g]) for g in licenses.anchored(licenses.ngrams(paragraph)) if g in weights), np.zeros(len(licenses.FAMILIES)))
    p = np.exp((s - s.max()) / m["temperature"])
    p /= p.sum()
    family = licenses.FAMILIES[int(p.argmax())] if p.max() >= m["threshold"] else "unknown"
    if re.search(licenses._DENIED, "".join(c.lower() if c.isascii() else c for c in paragraph)):
        family = "unknown"
    grams, match = licenses.ngrams(paragraph), 0.0
    for t in map(licenses.ngrams, licenses.TEMPLATES.get(family, [])):
        both = len(grams & t)
        if family != "proprietary" or len(t) >= 30 or both >= 0.25 * len(grams):
            match = max(match, both / len(t))
        if both >= 12:
            match = max(match, both / len(grams))
    return family, float(p.max()), match >= licenses.CONFIRM


def licence_row(text):
    got = [licence_verdict(p) for p in licenses.paragraphs(text) if re.search(licenses._ANCHORED, p)]
    ok = [v for v in got if v[2] and v[0] != "unknown"]
    return ",".join(sorted({v[0] for v in ok})), len(got), len(ok), sum(v[0] != "unknown" and not v[2] for v in got)


#: Notices as projects write them, wrapped and commented; the model's own generator makes nothing of the kind.
NOTICES = [
    ("/*\n * Copyright 2014 Some Authors\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\nint x;", "apache"),
    ("# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser\n# General Public License as published by the Free Software\n# Foundation; either version 2.1 of the License, or (at your option)\n# any later version.", "lgpl"),
    ("// This program is free software; you can redistribute it and/or modify it\n// under the terms of the GNU General Public License as published by the\n// Free Software Foundation; either version 2 of the License, or (at your\n// option) any later version.", "gpl"),
    ("Foo 1.0\n\nPermission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute, sublicense,\nand/or sell copies of the Software", "mit"),
    ("-- Redistribution and use in source and binary forms, with or without\n-- modification, are permitted provided that the following conditions\n-- are met:", "bsd"),
    ("   This Source Code Form is subject to the terms of the Mozilla Public\n   License, v. 2.0. If a copy of the MPL was not distributed with this\n   file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "isc"),
    ("we put it online, released under the mit license, last year", "mit"),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Er kam mit dem Zug, MIT DER BAHN, und die Lizenz war weg.", ""),
    ("The licence was granted by the council, and the rights of the public were kept.", ""),
    ("A copyright lawyer spoke about the commons and the gnu in the zoo.", ""),
    ("The hunting\nlicense of the\nman was old.", ""),
]


#: Sentences that no template and no generator made, by family; those of "" grant nothing.
HELD_OUT = [
    ("# Copyright (C) 2021 Someone\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as\n# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option) any later version.", "agpl"),
    ("The web service is licensed under the AGPL v3, its client library isn't part of it.", "agpl"),
    ("All material on this site is licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"), ("This book is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
    ("Licensed under CC BY-ND 4.0 by the artist.", "cc-by-nd"), ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Licensed under CC BY 4.0.", "cc-by"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0", "epl"), ("# SPDX-License-Identifier: EPL-2.0", "epl"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.", "zlib"),
    ("//  Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 or any later version.", "gpl"), ("Licensed under the GNU Lesser General Public License, version 2.1.", "lgpl"),
    ("Copyright 2020 Example Corp. All rights reserved.", "proprietary"),
    ("All rights reserved by the kingdom were lost in the war.", ""), ("This is not licensed under the MIT License.", ""), ("The code was never released under the GPL v2 or later.", ""), ("An eclipse gave the village's trade a boost.", ""),
]


def test_held_out_sentences_by_family():
    confusion = Counter((want, licence_row(text)[0]) for text, want in HELD_OUT)
    assert all(a == b for a, b in confusion), {k: n for k, n in confusion.items() if k[0] != k[1]}


def test_licences_of_real_notices():
    assert [licence_row(t)[0] for t, _ in NOTICES] == [f for _, f in NOTICES]


def test_licence_scan_matches_brute_force(spark, docs, plain):
    long = "word " * 20000 + "under the MIT license " + "other " * 20000
    rows = [(-1 - i, t) for i, (t, _) in enumerate(NOTICES + HELD_OUT)] + [(-100, long), (-101, "License\r\n\r\n\r\nAll rights reserved.\n \t\n# SPDX-License-Identifier: MIT"), (-102, "\n\n")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    text = dict(zip(plain.doc_id, plain.text, strict=True)) | dict(rows)
    got = {r.doc_id: r for r in licenses.op6(both).collect()}
    assert {i: (r.families, r.n_candidates, r.n_licences, r.n_unconfirmed) for i, r in got.items()} == {i: licence_row(t) for i, t in text.items()}
    cut = {(r.doc_id, r.paragraph_no): r.paragraph for r in licenses.scan(both).filter("paragraph IS NOT NULL").collect()}
    assert cut == {(i, k): p for i, t in text.items() for k, p in enumerate(licenses.paragraphs(t)) if re.search(licenses._ANCHORED, p)}


def test_licence_scores_equal_the_model(spark):
    rng = random.Random(9)
    texts = sorted({t for t, _ in licenses._variants(rng, 6)} | {t for t, _ in licenses._variants(rng, 6, licenses.CALIBRATION)})
    got = {r.key: r for r in licenses.classify(spark.createDataFrame([(t, t) for t in texts], "key string, paragraph string")).collect()}
    for t in texts:
        family, p, confirmed = licence_verdict(t)
        assert got[t].probability == pytest.approx(p, abs=1e-9) and (got[t].family, got[t].confirmed) == (family, confirmed)


# 7 decontamination


def test_decontamination_offsets(spark, awkward, empty):
    item = "One two, three FOUR five six seven eight nine ten eleven."
    text = "é start: one TWO three four five... six seven eight nine ten eleven end"
    d = spark.createDataFrame([(1, text), (2, None), (3, "tiny item here"), (4, "one two three four five six seven eight nine")], "doc_id bigint, text string")
    b = spark.createDataFrame([(10, item), (10, item), (2, "Tiny ITEM"), (3, None), (4, "...")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find(d, b).collect()}
    (s, e), = got[1]["__spans"]
    assert text[s:e] == "one TWO three four five... six seven eight nine ten eleven" and got[1]["__n_hit"] == 11 and got[1]["__items"] == ["10"]
    assert got[3]["__n_hit"] == 2 and got[4]["__n_hit"] == 0 and got[2]["__n_words"] == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.op7(awkward, none).filter("contaminated").count() == 0 and decontaminate.op7(awkward, b).count() == len(AWKWARD) and decontaminate.op7(empty, b).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, sf):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.ORACLES[name]).df()
    key = lambda df: sorted(tuple("-" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)


# 8 language model


def test_lattice_equals_enumeration():
    voc = lm.vocabulary(queries.tokenizer(lm.PIECES))
    s, ids = voc.first_scores(), {p: i for i, p in enumerate(voc.pieces)}

    def arcs(t, a, b):
        x = t[a:b]
        if x in ids:
            return s[ids[x]]
        return sum(s[voc.bytes_at + c] for c in x.encode()) if b - a == 1 else None

    def every(t, at=0):
        if at == len(t):
            yield 0.0, []
            return
        for b in range(at + 1, len(t) + 1):
            if (v := arcs(t, at, b)) is not None:
                for rest, cut in every(t, b):
                    yield v + rest, [t[at:b], *cut]

    ws = [b"the", b"trees", b"\xe6\x97\xa5x", b"a", "☃é".encode(), b"in"]
    lat = lm.Lattice(ws, voc)
    arc = lat.arc_scores(s, voc)
    got, exp = lat.marginal(arc), lat.expected(arc, np.ones(len(ws)), voc) / lm.UNIT
    want = np.zeros(voc.n)
    for w, g in zip(ws, got, strict=True):
        seg = list(every(lm.MARK + w.decode()))
        total = math.log(math.fsum(math.exp(v) for v, _ in seg))
        assert g == pytest.approx(total, abs=1e-9)
        for v, cut in seg:
            for p in cut:
                if p in ids:
                    want[ids[p]] += math.exp(v - total)
    assert np.abs(exp[: voc.n] - want).max() < 2 / lm.UNIT


def plain_forward(word, score):
    """(values, arcs into each place) of one word by the definition; score: piece or byte -> log score."""
    t = lm.MARK + word.decode("utf-8", "replace")
    value, into = [0.0], [[]]
    for at in range(1, len(t) + 1):
        arcs = [(k, t[at - k : at], score[t[at - k : at]]) for k in range(1, at + 1) if t[at - k : at] in score]
        if not any(k == 1 for k, _, _ in arcs):
            arcs.append((1, t[at - 1].encode(), sum(score[x] for x in t[at - 1].encode())))
        value.append(math.log(math.fsum(math.exp(value[at - k] + s) for k, _, s in arcs)))
        into.append(arcs)
    return value, into


def plain_expected(word, score, weight, out):
    value, into = plain_forward(word, score)
    share = [0.0] * len(value)
    share[-1] = 1.0
    for at in range(len(value) - 1, 0, -1):
        for k, piece, s in into[at]:
            p = share[at] * math.exp(value[at - k] + s - value[at])
            share[at - k] += p
            for x in [piece] if isinstance(piece, str) else piece:
                out[x] += p * weight


def named_scores(voc, s):
    return {p: s[i] for i, p in enumerate(voc.pieces)} | {b: s[voc.bytes_at + b] for b in range(256)}


def test_scores_match_brute_force(spark, docs, plain, awkward, empty):
    path = queries.tokenizer(lm.PIECES)
    got = lm.score(docs, path, block_bytes=100_000).toPandas().set_index("doc_id")
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    train = [i for i in range(len(plain)) if zlib.crc32(str(plain.doc_id[i]).encode()) % 5 != 1]
    c = Counter(w for i in train for w in low(plain.text[i]))
    n, v = sum(c.values()) + len(train), len(c) + 1
    voc = lm.vocabulary(path)
    first, gain = named_scores(voc, voc.first_scores()), Counter()
    for w, k in c.items():
        plain_expected(w.encode(), first, k, gain)
    total = {x: gain[x] + lm.SMOOTH for x in first}
    z = math.fsum(total.values()) + lm.SMOOTH + len(train)
    learnt = {x: math.log(y / z) for x, y in total.items()}
    of_word = {}
    p = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    for i, t in zip(plain.doc_id, plain.text, strict=True):
        w, r = low(t), got.loc[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.n_tokens == len(w) + 1 and r.train_tokens == n
        assert r.n_known == sum(x in c for x in w) + 1
        assert r.base_score == pytest.approx(sum(p(c[x]) for x in w) + p(len(train)), abs=1e-6)
        if i % 10 == 0:
            for x in w:
                if x not in of_word:
                    of_word[x] = plain_forward(x.encode(), learnt)[0][-1]
            want = (math.fsum(of_word[x] for x in w) + math.log((len(train) + lm.SMOOTH) / z)) / math.log(10)
            assert r.score == pytest.approx(want, rel=1e-4)
    # scores don't depend on blocks, on the order of rows or on where the rows come from
    key = lambda d: sorted((r.doc_id, r.base_score, r.score) for r in d.select("doc_id", "base_score", "score").collect())
    again = lm.score(spark.createDataFrame(docs.orderBy(F.xxhash64("doc_id")).toPandas()[["doc_id", "text"]]).repartition(3), path, block_bytes=50_000)
    assert key(again) == [(i, got.loc[i].base_score, got.loc[i].score) for i in sorted(got.index)]
    assert lm.op8(awkward, path).count() == len(AWKWARD) and lm.op8(empty, path).count() == 0
    assert lm.op8(awkward, path).schema["doc_id"].dataType == awkward.schema["doc_id"].dataType


def test_long_words_equal_lattices(spark, monkeypatch):
    path = queries.tokenizer(lm.PIECES)
    voc = lm.vocabulary(path)
    s = voc.first_scores()
    ws = [b"internationalisation" * 30, "日本x☃the".encode() * 40, b"a", b"\xff\xfe" * 20]
    lat = lm.Lattice(ws, voc)
    arc = lat.arc_scores(s, voc)
    total = Counter()
    for w, p in zip(ws, lat.marginal(arc), strict=True):
        one = lm.LongWord(w, voc)
        assert one.marginal(s.tolist()) == pytest.approx(p, rel=1e-9)
        total.update(one.expected(s.tolist(), 3.0))
    want = lat.expected(arc, np.full(len(ws), 3.0), voc)
    assert all(abs(total[i] - want[i]) <= 200 for i in range(len(want)))
    monkeypatch.setattr(lm, "CHARS", 100)
    assert np.allclose(lm.marginals_of([b"x" * 90, b"the", b"y" * 50, b"z" * 5000], s, voc)[:3], lm.Lattice([b"x" * 90, b"the", b"y" * 50], voc).marginal(lm.Lattice([b"x" * 90, b"the", b"y" * 50], voc).arc_scores(s, voc)))
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    rows = [(1, "some plain words"), (2, text), (2, text), (3, text + " and more")]
    got = {r.doc_id: r for r in lm.op8(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect()}
    assert got[2].n_tokens == 2 and got[2].score < -1000 and abs(got[3].score - got[2].score) < 100


# 9 pages


def test_main_text_of_the_given_pages(spark, sf):
    import html as entities

    pages = table(spark, sf, "pages")
    for r in html.op9(pages).join(pages.select("page_id", "html"), "page_id").collect():
        a = r.html[r.html.index("<article>") + 9 :].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:h1|p)>", a)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_held_out_pages():
    w, tr = html.model()
    rng, right, n = random.Random(123), 0, 0
    for _ in range(200):
        page, main = html.generate(rng)
        got = set(html.extract_all([page], w, tr)[0])
        seen = {b.text for b in html.blocks(page)}
        right += len(got & main) + len(seen - got - main)
        n += len(seen)
    assert right >= 0.99 * n


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(50):
        e, tr = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        best = max(np.ndindex(*[2] * 6), key=lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(tr[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert html.viterbi(e.tolist(), tr.tolist()) == list(best)


def test_awkward_pages(spark):
    deep = "<div class='x'>" * 20000 + "text" + "</div>" * 20000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp b &lt;c&gt; &#233;<p>"), (4, "u", "plain words only"), (None, "u", "<article><p>Some words here, and more of them.</p>"), (5, "u", deep), (6, "u", "<article><p>one<!-- never closed"), (7, "u", "<article><p>a < b and c</p><script>x</p>"), (5, "u", "<")]
    got = html.op9(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)))
    assert got.count() == len(rows) and got.filter("page_id = 1").first().text == "" and got.filter("page_id IS NULL").first().text.startswith("Some words")
    assert [b.text for b in html.blocks("<p>a  \n b<br>c</p>d<!-- x --><style>y</style><ul><li>e</ul>")] == ["a b c", "d", "e"]
    assert html.op9(got.select("page_id", "url", F.col("text").alias("html")).limit(0)).count() == 0


# pipeline


def test_pipeline_matches_brute_force(spark, sf, docs, plain):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = {r.doc_id for r in quality.op1(docs).filter("kept").collect()}
    left = plain[plain.doc_id.isin(kept)].reset_index(drop=True)
    comp = components_brute(list(left.doc_id), [fingerprint_brute(t) for t in left.text])
    left = left[[c == i for c, i in zip(comp, left.doc_id, strict=True)]]
    dirty = {r.doc_id for r in decontaminate.op7(docs, table(spark, sf, "benchmark")).filter("contaminated").collect()}
    left = left[~left.doc_id.isin(dirty)]
    w, pair = pii.model()
    text = {i: pii.redact(t, sum(pii.find_spans([t], w, pair)[0], [])) for i, t in zip(left.doc_id, left.text, strict=True)}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got.doc_id) == set(text)
    for i, g in got.groupby("doc_id"):
        assert b"".join(map(bytes, g.sort_values("start").ids)) == _ids("byte_bpe_50k.json", text[i], 0)
    assert got.groupby("sequence_id").agg({"length": "sum"}).length.max() <= 1024 and got.groupby("sequence_id").size().max() <= packing.QUERY_LIMITS.segments


def test_pipeline_stages_on_awkward_rows(spark, sf, awkward, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= 0


def test_pipeline_stages_with_the_operators_own_names(spark, sf, awkward):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["__text", "__q", "__n_hit", "__base", "__added", "__redacted", "__words", "__bytes", "__items", "c0", "c1", "h1", "h2", "g", "n", "word"]
    docs = awkward.withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert all(r[c] == c for r in out.select(*names).collect() for c in names), name
        if name in ("benchmark_leaks", "personal_data"):
            assert out.count() == len(AWKWARD)
    assert corpus_pipeline.packed(spark, docs, sf).select("doc_id").distinct().count() == len({r[0] for r in AWKWARD})


def test_a_benchmark_that_is_too_large_is_refused(docs, monkeypatch, spark, sf):
    monkeypatch.setattr(decontaminate, "MAX_TOTAL_BYTES", 1000)
    with pytest.raises(ValueError, match="each of its parts"):
        decontaminate.find(docs, table(spark, sf, "benchmark"))


def test_near_duplicates_keep_one_row_of_each_component(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = [" ".join(f"{w}{i}{k}" for k in range(40)) for i, w in enumerate(("oak", "elm", "fir", "ash", "yew"))]
    rows = [
        (None, text[0], "en", "s", 1), (None, text[0], "en", "s", 1), (None, text[1], "en", "s", 1),  # without ids: two texts
        (7, text[2], "en", "s", 1), (7, text[3], "en", "s", 1), (7, text[3], "en", "s", 1),  # one id, two texts
        (None, text[4], "en", "s", 1), (9, text[4], "en", "s", 1), (8, text[4], None, "s", 1), (8, text[4], "s", None, 1),  # a copy without an id, one row of two with the smallest
    ]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), sf).select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4])], key=str)


def test_equal_tokens_of_a_long_document_get_one_label():
    """A base span gives away forty later mentions, near and far, in whatever batch the document stands."""
    w, pair = pii.model()
    t = "+14435555793 " + " ".join(f"und so fort 4435555793 {'mehr ' * (k % 3)}" for k in range(40))
    (_, alone), (_, other) = pii.find_spans([t], w, pair)[0], pii.find_spans(["tel 1234567 x 1234567 ", t], w, pair)[1]
    assert [t[a:b] for k, a, b in alone if k == "phone"] == ["4435555793"] * 40 and other == alone
    table_ = " ".join(f"{k % 17} 443-555-57{k % 40 + 10}" for k in range(4000))
    inside = {i for _, a, b in pii.find_spans([table_], w, pair)[0][1] for i in range(a, b)}
    shown = Counter(table_[a:b] for a, b in pii.tokens(table_) if "-" in table_[a:b] and a in inside)
    assert all(n == 100 for n in shown.values())
    chain, hubs = pii.edges(table_, pii.tokens(table_))
    assert len(chain) == 7999 and len(hubs) == 57


def test_batches_and_line_ends_change_no_spans(monkeypatch):
    w, pair = pii.model()
    rng = random.Random(8)
    texts = [pii.generate(rng)[0] for _ in range(60)] + ["", "x" * 5000]
    want = pii.find_spans(texts, w, pair)
    monkeypatch.setattr(pii, "BATCH_CHARS", 300)
    parts = list(pii._parts(texts))
    assert len(parts) > 10 and [t for p in parts for t in p] == texts
    assert [x for p in parts for x in pii.find_spans(p, w, pair)] == want
    # a number that goes on in the next line is one chain, a token is looked at whole
    assert pii.edges("a 12 \n 34 x 56", pii.tokens("a 12 \n 34 x 56"))[0] == [(0, 1)]
    long = "7" * 300
    f, g = (pii.features(t, pii.tokens(t)) for t in (long + "a@b", long + "a-b"))
    assert f != g


def test_messages_that_do_not_settle_leave_base_spans(monkeypatch):
    monkeypatch.setattr(pii, "DAMP", ((0, 0.0),))
    texts = ["12 34 12 34 call 443-555-5793 12 mail a.b@c.de", "call (443) 555-5793", "no number"]
    want = pii.find_spans(texts, *pii.model())
    monkeypatch.setattr(pii, "MAX_ROUNDS", 8)
    monkeypatch.setattr(pii, "TOLERANCE", 0.0)
    w, pair = pii.model()
    unsettled = set()
    node = pii.find_spans(texts, w, pair, unsettled=unsettled)
    assert unsettled <= {0, 1} and all(node[k] == (want[k][0], []) for k in unsettled) and node[2] == ([], [])
    g = pii.Graph()
    toks = pii.tokens(texts[0])
    g.add(texts[0], toks, [-1] * len(toks))
    n, _, _, ij, kind, _ = g.arrays()
    restless = set()
    pii._messages(np.random.default_rng(0).normal(size=(n, pii.N_LABELS)), ij[:, 0], ij[:, 1], pair[kind], np.zeros(n, np.int64), -1.0, restless)
    assert restless == {0}


def test_the_word_before_is_whole_however_far_it_stands():
    assert pii._word_before("phone" + " " * 500 + "443", 505) == "phone" and pii._word_before("x" * 300 + " 443", 301) == "x" * 300 and pii._word_before("443", 0) == ""
    w, pair = pii.model()
    near, far = ("call phone" + " " * k + "4435555793" for k in (1, 200))
    assert [s[0] for s in pii.find_spans([near], w, pair)[0][1]] == [s[0] for s in pii.find_spans([far], w, pair)[0][1]]


def test_unclosed_elements_lose_no_text():
    seen = lambda page: [b.text for b in html.blocks(page)]
    for tag in ("svg", "noscript", "iframe", "template", "head"):
        assert seen(f"<p>a</p><{tag} x=1><p>b</p><{tag}>c<p>d") == ["a", "b", "c", "d"], tag
        assert seen(f"<p>a</p><{tag} x=1>gone</{tag}><p>b</p><{tag}>c") == ["a", "b", "c"], tag
    for tag in ("script", "style", "textarea", "title"):
        assert seen(f"<p>a</p><{tag}><p>b</p>") == ["a"], tag
    assert seen("<p>a&nbsp;&nbsp;b\u00a0 c\u2003d&nbsp;</p>") == ["a b c d"]
    assert len(seen("<p>x</p>" + "<svg>" * 50000 + "<p>y")) == 2


def test_stray_quotes_and_formulas_lose_no_text():
    seen = lambda page: [b.text for b in html.blocks(page)]
    assert seen("<p>a <a href=x title=Bob's>b</a> c</p><p>d</p><p>it's e</p>") == ["a b c", "d", "it's e"]
    assert seen("<p class=x\">a</p><p>b</p>") == ["a", "b"]
    assert seen("<p title='x>a</p><p>b</p>") == ["a", "b"]
    assert seen("<p title=\"1 > 0\" lang='a>b'>a</p><p title=\"x>b</p>c \" d") == ["a", "b", 'c " d']
    assert seen("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p><object data=y>in words</object></p>") == ["so x=2 holds", "in words"]
    assert seen("<p>a</p><p " + "x=\"1\" " * 3000) == ["a"]


def test_segments_have_one_memo_and_the_librarys_ids():
    """Words are remembered once, by whichever way a text was cut; ids are those of the library's own call."""
    import random

    import public_tokenizers

    from tidemark.llm.tokens import Encoder

    rng = random.Random(3)
    texts = [" ", "\n", "a ", " a b", "a\n\nb", "a \nb", " \na", "a\tb", "Abc, Abc abc. abc", "a  b", "É, é", "\n!x", "x\x1cy z"]
    texts += ["".join(rng.choice("aB ,\n\té.1-") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    for name, drops_space in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = Encoder(public_tokenizers.path(name), drops_space)
        for x in texts:
            assert e.encode(x.encode()) == e.whole(x), x
        e.pieces.clear()
        e.encode(b" unheardof unheardof, words")  # a text's first word without a space goes by its piece
        assert set(e.pieces) <= {","}
