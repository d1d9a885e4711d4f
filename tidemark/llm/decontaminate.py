"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised word by word: A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII
characters. A window is WINDOW consecutive words of an item; an item with fewer words, but not none, is one
window. All windows go into one automaton, each document is scanned once, and every hit is mapped back to
code points of the original text. The automaton reads words as numbers of the windows' vocabulary, two or three characters each, so a window
has two or three nodes a word; what it takes in a worker is counted beforehand (NODE_BYTES, PATTERN_BYTES) and bounded.

Defined results: null or wordless texts have no words and no hits; items without words have no window; repeated
benchmark rows count once per item_id; a null item_id counts as one item, rendered as an empty string; an empty
benchmark contaminates nothing; repeated document rows are each returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, stored, unused

WINDOW = 10
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    """The text with A-Z lower-cased and each ASCII separator turned into a space; byte offsets stay as they are."""
    return text.translate(_FOLD)


def windows(text: bytes | None, size: int) -> list[bytes]:
    words = fold(text or b"").split()
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def pattern_rows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(pattern, items): each distinct window with the items that have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, w) for i, t in zip(b["item"], b["text"], strict=True) for w in set(windows(t, size))]
            yield pd.DataFrame(rows, columns=["item", "pattern"])

    src = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInPandas(run, "item string, pattern binary").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


#: Bytes of a worker's memory that a node and a window with its items take, as measured, and the most that all may take:
#: test sets are far below it, and anything above is refused, not cut.
NODE_BYTES, PATTERN_BYTES = 50, 600
MAX_TOTAL_BYTES = 256 << 20
#: Digits of word numbers: a number's first character and its others are told apart, and a word outside the vocabulary is a space.
_HEADS, _TAILS = [chr(c) for c in range(0x21, 0x61)], [chr(c) for c in range(0xC0, 0x100)]


def width(n_words: int) -> int:
    """Characters of a word number."""
    n = 1
    while 64**n < n_words:
        n += 1
    return n


class Matcher:
    """The automaton over word numbers, and the numbers."""

    def __init__(self, patterns: list[tuple[bytes, list[str]]]):
        import ahocorasick

        words = sorted({w for p, _ in patterns for w in p.split()})
        n = width(len(words))
        self.code = {}
        for i, w in enumerate(words):
            digits = []
            for _ in range(n - 1):
                i, d = divmod(i, 64)
                digits.append(_TAILS[d])
            self.code[w] = _HEADS[i] + "".join(digits)
        self.automaton = ahocorasick.Automaton()
        for p, items in patterns:
            of = p.split()
            self.automaton.add_word("".join([self.code[w] for w in of]), (len(of), items))
        if patterns:
            self.automaton.make_automaton()


#: The matcher that this worker built last, by the call it belongs to; workers live on between tasks.
_BUILT: dict[str, Matcher] = {}


def _matcher(call: str, patterns) -> Matcher:
    if call not in _BUILT:
        _BUILT.clear()
        _BUILT[call] = Matcher(patterns.value)
    return _BUILT[call]


def scan(text: bytes, matcher: Matcher) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, hit spans as merged [first word, last word], items) of one text."""
    words = fold(text).split()
    if not words or not len(matcher.automaton):
        return len(words), [], set()
    get = matcher.code.get
    read = [get(w, " ") for w in words]
    hits = list(matcher.automaton.iter("".join(read)))
    if not hits:
        return len(words), [], set()
    ends, at = {}, -1
    for i, c in enumerate(read):
        at += len(c)
        ends[at] = i
    spans: list[tuple[int, int]] = []
    for a, b in sorted({(ends[end] - n + 1, ends[end]) for end, (n, _) in hits}):
        if spans and a <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return len(words), spans, {x for _, (_, of) in hits for x in of}


def to_original(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code-point offsets of the original text, end exclusive."""
    import re

    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", fold(text))]
    return [(len(text[: at[a][0]].decode("utf-8", "replace")), len(text[: at[b][1]].decode("utf-8", "replace"))) for a, b in spans]


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry's columns (the id by default) with n_words, n_hit, items (sorted), spans (original code points, end exclusive).

    The benchmark's distinct windows are bounded test sets: what their automaton takes is worked out first and refused over
    MAX_TOTAL_BYTES; each worker builds it once.
    """
    spark = docs.sparkSession
    patterns = stored(pattern_rows(benchmark, window, item_col, item_text), "patterns")
    size = patterns.agg(F.coalesce(F.sum(F.size(F.split(F.col("pattern").cast("string"), " "))), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("items")).first()
    total = size.words * width(size.words) * NODE_BYTES + size.n * PATTERN_BYTES + 100 * size["items"]
    if total > MAX_TOTAL_BYTES:
        raise ValueError(f"the automaton of the benchmark's windows takes up to {total} bytes, more than {MAX_TOTAL_BYTES}: call once for each of its parts")
    sent, call = spark.sparkContext.broadcast([(bytes(r.pattern), list(r["items"])) for r in patterns.toLocalIterator()]), uuid.uuid4().hex
    keep = carry or [id_col]
    source = unused(keep, "__text")

    def run():
        matcher = _matcher(call, sent)

        def make(texts: list) -> list:
            out = []
            for t in texts:
                n, spans, items = scan(t or b"", matcher)
                out.append((n, sum(y - x + 1 for x, y in spans), sorted(items), [list(s) for s in to_original(t, spans)] if spans else []))
            return list(zip(*out, strict=True)) if out else [[]] * 4

        return make

    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias(source))
    return appended(src, source, run, "__n_words bigint, __n_hit bigint, __items array<string>, __spans array<array<bigint>>")


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


#: DuckDB, the plain way: number the words, build every item window, look each document window up by equality.
SQL = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) ks WHERE len(w) >= k)),
hit AS (SELECT p.r, p.i, p.k, win.item_id FROM pos p JOIN win ON p.k = win.k AND p.s = win.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
