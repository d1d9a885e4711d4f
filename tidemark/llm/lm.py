"""Language-model scores: the marginal probability of a text over all its subword segmentations.

Tokens are words at ASCII white space, A-Z lower-cased, and one end a text. The pieces and their order of merit come
from an existing public vocabulary; each piece starts with the score of its rank (a Zipf law), and one expectation step
over the training words, every segmentation weighted by those scores, gives the unigram probabilities. A word's
probability is the sum over all segmentations of its characters (with the word-start mark), by a forward recursion in log
space; bytes stand in for characters without a piece. Pieces never cross a word start, so a text's log-probability is the
sum of its words' and its end's.

Spark counts each word of the whole training part once; lattices are run once per distinct word, never per occurrence.
Words meet their texts block-wise: neighbouring rows of a file are a block of about BLOCK_BYTES, each block's distinct words
fetch count and score in one join, and a block's texts are scored beside its own dictionary, which a task reads first. No
word, however frequent, has more rows in that join than there are blocks and splits of files, and a task holds one block's
dictionary, however many rows, equal rows included, a block has. Rows that don't come from Parquet files are stored first.

Words of over LONG characters are taken alone, a character at a time, in memory in step with their length; lattices of
shorter ones hold CHARS characters at most. Expected counts are added up as whole numbers (units of 1 / UNIT), so
scores don't depend on the order of tasks.

Defined results: a null or empty text is its end alone; null ids are hashed as an empty text; repeated rows are scored
and counted each; without training texts all counts are zero and the vocabulary's own ranks give the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
#: Added to every piece's expected count.
SMOOTH = 0.5
ZIPF_SHIFT = 2.7
MARK = "▁"
#: Characters that a task runs through lattices at once, and those of a word that is taken alone.
CHARS, LONG = 1 << 15, 1 << 11
#: Expected counts are whole numbers of these.
UNIT = 1 << 16
_P = np.uint64(0x100000001B3)
_NEG = -1e30


class Vocabulary:
    """Pieces of a sentencepiece model as sorted hash tables by length, with log scores; the last 256 + 1 are bytes and end."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = pieces  # in the file's order of merit
        self.place = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces)
        self.bytes_at, self.end_at = self.n, self.n + 256
        by_len: dict[int, list[tuple[int, int]]] = {}
        heads: dict[int, set[int]] = {}
        for i, p in enumerate(pieces):
            codes = np.frombuffer(p.encode("utf-32-le"), dtype="<u4")
            h = self.hash(codes)
            by_len.setdefault(len(codes), []).append((h[-1], i))
            for k in range(1, len(codes)):
                heads.setdefault(k, set()).add(h[k - 1])
        self.longest = max(by_len)
        self.table = {}
        for k in range(1, self.longest + 1):
            items = sorted(by_len.get(k, []))
            self.table[k] = (np.array([h for h, _ in items], dtype=np.uint64), np.array([i for _, i in items], dtype=np.int64), np.array(sorted(heads.get(k, ())), dtype=np.uint64))

    @staticmethod
    def hash(codes: np.ndarray) -> list[int]:
        """Hashes of all prefixes."""
        h, out = 0, []
        for c in codes.tolist():
            h = ((h + c + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 31
            out.append(h)
        return out

    def first_scores(self) -> np.ndarray:
        """Natural logs: the ranks' Zipf law over pieces; bytes and the end share the last rank's score."""
        p = 1 / (np.arange(self.n) + ZIPF_SHIFT)
        p = np.r_[p, np.full(257, p[-1])]
        return np.log(p / p.sum())


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the table, -1 where absent."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


class Lattice:
    """All segmentations of many words at once: flat characters, and arcs (start, length, piece or bytes)."""

    def __init__(self, words: list[bytes], voc: Vocabulary):
        text = [MARK + w.decode("utf-8", "replace") for w in words]
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in text]
        self.len = np.array([len(c) for c in codes])
        self.first = np.r_[0, np.cumsum(self.len)]
        flat = np.concatenate(codes).astype(np.uint64)
        n = len(flat)
        left = np.repeat(self.first[1:], self.len) - np.arange(n)  # characters to the word's end
        starts, lengths, pieces = [], [], []
        at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        has_one = np.zeros(n, bool)
        with np.errstate(over="ignore"):
            for k in range(1, voc.longest + 1):
                keep = left[at] >= k
                at, h = at[keep], h[keep]
                h = (h + flat[at + k - 1] + np.uint64(1)) * _P
                h ^= h >> np.uint64(31)
                hashes, ids, heads = voc.table[k]
                found = _find(hashes, h)
                ok = found >= 0
                starts.append(at[ok])
                lengths.append(np.full(int(ok.sum()), k))
                pieces.append(ids[found[ok]])
                if k == 1:
                    has_one[at[ok]] = True
                more = _find(heads, h) >= 0
                at, h = at[more], h[more]
                if not len(at):
                    break
        lone = np.flatnonzero(~has_one)
        starts.append(lone)
        lengths.append(np.ones(len(lone), dtype=np.int64))
        pieces.append(np.full(len(lone), -1))
        self.lone_bytes = {int(i): chr(int(flat[i])).encode() for i in lone}
        s, k, p = np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)
        place = s - np.repeat(self.first[:-1], self.len)[s]
        order = np.argsort(place + k, kind="stable")  # by where an arc ends in its word
        self.start, self.k, self.piece = s[order], k[order], p[order]
        self.end_place = (place + k)[order]
        self.start_place = place[order]
        self.word = np.repeat(np.arange(len(words)), self.len)[self.start]

    def arc_scores(self, scores: np.ndarray, voc: Vocabulary) -> np.ndarray:
        out = np.where(self.piece >= 0, scores[self.piece], 0.0)
        for i in np.flatnonzero(self.piece < 0):
            out[i] = sum(scores[voc.bytes_at + b] for b in self.lone_bytes[int(self.start[i])])
        return out

    def _sweep(self, arc: np.ndarray, by: np.ndarray, src: np.ndarray, dst: np.ndarray, order: np.ndarray, value: np.ndarray) -> None:
        """Log-adds value[src] + arc into value[dst], arcs in order, one place of all words at a time."""
        cuts = np.flatnonzero(np.diff(by[order])) + 1
        for sel in np.split(order, cuts):
            to = dst[sel]
            x = value[src[sel]] + arc[sel]
            nodes, inv = np.unique(to, return_inverse=True)
            top = np.full(len(nodes), _NEG)
            np.maximum.at(top, inv, x)
            value[nodes] = top + np.log(np.bincount(inv, np.exp(x - top[inv]), len(nodes)))

    def forward(self, arc: np.ndarray) -> np.ndarray:
        """Node values; node first[w] + w + place is before a word's character at place."""
        value = np.full(len(self.first) - 1 + int(self.first[-1]), _NEG)
        value[self.first[:-1] + np.arange(len(self.len))] = 0.0
        self._sweep(arc, self.end_place, self.start + self.word, self.start + self.word + self.k, np.arange(len(arc)), value)
        return value

    def backward(self, arc: np.ndarray) -> np.ndarray:
        value = np.full(len(self.first) - 1 + int(self.first[-1]), _NEG)
        value[self.first[1:] + np.arange(len(self.len))] = 0.0
        order = np.argsort(-self.start_place, kind="stable")
        self._sweep(arc, self.start_place, self.start + self.word + self.k, self.start + self.word, order, value)
        return value

    def marginal(self, arc: np.ndarray) -> np.ndarray:
        """Log-probability of each word."""
        return self.forward(arc)[self.first[1:] + np.arange(len(self.len))]

    def expected(self, arc: np.ndarray, weight: np.ndarray, voc: Vocabulary) -> np.ndarray:
        """Expected piece counts, each word weighted, in whole units."""
        f, b = self.forward(arc), self.backward(arc)
        total = f[self.first[1:] + np.arange(len(self.len))]
        node = self.start + self.word
        p = np.rint(np.exp(f[node] + arc + b[node + self.k] - total[self.word]) * weight[self.word] * UNIT).astype(np.int64)
        out = np.zeros(voc.n + 257, np.int64)
        np.add.at(out, self.piece[self.piece >= 0], p[self.piece >= 0])
        for i in np.flatnonzero(self.piece < 0):
            for x in self.lone_bytes[int(self.start[i])]:
                out[voc.bytes_at + x] += p[i]
        return out


class LongWord:
    """The same for one word of any length: two numbers a character, no arcs kept."""

    def __init__(self, word: bytes, voc: Vocabulary):
        self.text, self.voc = MARK + word.decode("utf-8", "replace"), voc

    def arcs(self, at: int, scores: list[float]) -> list[tuple[int, int, float]]:
        """(length, piece, score) of the arcs that end at a place; piece -1: the character's bytes."""
        out = [(k, i, scores[i]) for k in range(1, min(at, self.voc.longest) + 1) if (i := self.voc.place.get(self.text[at - k : at], -1)) >= 0]
        if not any(k == 1 for k, _, _ in out):
            out.append((1, -1, sum(scores[self.voc.bytes_at + x] for x in self.text[at - 1].encode())))
        return out

    def forward(self, scores: list[float]) -> np.ndarray:
        value = np.zeros(len(self.text) + 1)
        for at in range(1, len(value)):
            x = [value[at - k] + s for k, _, s in self.arcs(at, scores)]
            top = max(x)
            value[at] = top + math.log(sum(math.exp(v - top) for v in x))
        return value

    def marginal(self, scores: list[float]) -> float:
        return float(self.forward(scores)[-1])

    def expected(self, scores: list[float], weight: float) -> dict[int, int]:
        """Expected counts by piece, in whole units: a word's end has weight 1, which its arcs hand down."""
        value, out = self.forward(scores), {}
        share = np.zeros(len(value))
        share[-1] = 1.0
        for at in range(len(value) - 1, 0, -1):
            for k, i, s in self.arcs(at, scores):
                p = share[at] * math.exp(value[at - k] + s - value[at])
                share[at - k] += p
                for j in [i] if i >= 0 else [self.voc.bytes_at + x for x in self.text[at - 1].encode()]:
                    out[j] = out.get(j, 0) + round(p * weight * UNIT)
        return out


def cut_words(words: list[bytes]) -> Iterator[tuple[list[int], bool]]:
    """Places of the words that a lattice takes at once, or of one long word (True)."""
    held, size = [], 0
    for i, w in enumerate(words):
        if len(w) > LONG:
            yield [i], True
            continue
        if held and size + len(w) + 1 > CHARS:
            yield held, False
            held, size = [], 0
        held.append(i)
        size += len(w) + 1
    if held:
        yield held, False


def marginals_of(words: list[bytes], scores: np.ndarray, voc: Vocabulary) -> np.ndarray:
    out, plain = np.empty(len(words)), None
    for at, long in cut_words(words):
        if long:
            plain = scores.tolist() if plain is None else plain
            out[at[0]] = LongWord(words[at[0]], voc).marginal(plain)
        else:
            lat = Lattice([words[i] for i in at], voc)
            out[at] = lat.marginal(lat.arc_scores(scores, voc))
    return out


def expected_of(words: list[bytes], weight: np.ndarray, scores: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Expected piece counts of weighted words, in whole units."""
    total, plain = np.zeros(voc.n + 257, np.int64), None
    for at, long in cut_words(words):
        if long:
            plain = scores.tolist() if plain is None else plain
            for i, n in LongWord(words[at[0]], voc).expected(plain, float(weight[at[0]])).items():
                total[i] += n
        else:
            lat = Lattice([words[i] for i in at], voc)
            total += lat.expected(lat.arc_scores(scores, voc), weight[at], voc)
    return total


_VOC: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOC:
        _VOC[path] = Vocabulary(path)
    return _VOC[path]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """doc_id (as text), text (bytes), held_out, block: neighbouring rows of a file, about block_bytes of text.

    A row's file and place in it are the same in every scan, so both scans deal the same blocks.
    """
    id_text = F.col(f"`{id_col}`").cast("string")
    src = docs.select(id_text.alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        placed = docs.select(id_text.alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *place)
    except AnalysisException:
        placed = stored(src, "documents").select("doc_id", "text", *place)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("binary"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows = max(1, size.rows * block_bytes // max(1, size.bytes))
    held_out = F.crc32(F.coalesce("doc_id", F.lit("")).cast("binary")) % 5 == 1
    return placed.select("doc_id", "text", held_out.alias("held_out"), F.xxhash64("file", F.floor(F.col("row") / rows)).alias("block"))


def _dictionary(blocked: DataFrame) -> DataFrame:
    """(block, word, n): each block's distinct words, with their number in its training texts. A block's rows come one after
    another, so a task holds one block's words; a block in two splits of a file has two rows of a word, to be added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        train, other, at = Counter(), set(), None

        def flush() -> Iterator[pd.DataFrame]:
            words = [*train, *(other - train.keys())]
            for i in range(0, len(words), 100_000):
                part = words[i : i + 100_000]
                yield pd.DataFrame({"block": np.int64(at), "word": part, "n": [train.get(w, 0) for w in part]})
            train.clear()
            other.clear()

        for b in batches:
            for text, out, block in zip(b["text"], b["held_out"], b["block"].tolist(), strict=True):
                if block != at:
                    yield from flush()
                    at = block
                (other if out else train).update(words_of(text))
        yield from flush()

    return blocked.select("text", "held_out", "block").mapInPandas(run, "block bigint, word binary, n bigint")


def fit(counts: DataFrame, n_end: int, path: str) -> np.ndarray:
    """Natural-log scores of all pieces, bytes and the end: one expectation step over counts (word, c).

    Partial sums are as large as the vocabulary in each task and are added up by piece; the result is the vocabulary's size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(path)
        scores, total = voc.first_scores(), np.zeros(voc.n + 257, np.int64)
        for b in batches:
            total += expected_of(list(b["word"]), b["c"].to_numpy(dtype=float), scores, voc)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"piece": at, "n": total[at]})

    voc = vocabulary(path)
    total = np.full(voc.n + 257, SMOOTH)
    for r in counts.filter("c > 0").mapInPandas(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r.piece] += r.n / UNIT
    total[voc.end_at] += n_end
    return np.log(total / total.sum()) if n_end else voc.first_scores()


def score(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), for every row of docs."""
    spark = docs.sparkSession
    blocked = _blocked(docs, id_col, text_col, block_bytes)
    pairs = stored(_dictionary(blocked), "pairs")
    counts = stored(pairs.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    ends = blocked.filter(~F.col("held_out")).count()
    t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, kinds = t.n + ends, t.v + (ends > 0)
    scores = fit(counts, ends, path)
    sent = spark.sparkContext.broadcast(scores)
    end_at = len(scores) - 1

    def marginals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(path)
        for b in batches:
            yield b.assign(p=marginals_of(list(b["word"]), sent.value, voc))

    scored = counts.mapInPandas(marginals, "word binary, c bigint, p double")
    known = pairs.select("block", "word").join(scored.hint("merge"), "word")
    floor = total + 0.5 * (kinds + 1)
    base = lambda c: math.log10((c + 0.5) / floor)
    # a block's dictionary (what 0) comes before its texts
    words = known.select("block", F.lit(0).alias("what"), F.col("word").alias("data"), F.col("c").cast("double").alias("c"), "p", F.lit(None).cast("string").alias("doc_id"))
    texts = blocked.select("block", F.when(F.col("held_out"), 2).otherwise(1).alias("what"), F.col("text").alias("data"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("p"), "doc_id")
    dealt = words.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("what") > 0)
    schema = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p_end, ln10 = float(sent.value[end_at]), math.log(10)
        end, at = base(ends), None
        table: dict[bytes, tuple[bool, float, float]] = {}
        bases: dict[float, float] = {}
        for b in batches:
            rows = []
            for block, what, data, c, p, doc_id in zip(b["block"].tolist(), b["what"].tolist(), b["data"], b["c"].tolist(), b["p"].tolist(), b["doc_id"], strict=True):
                if block != at:
                    table.clear()
                    at = block
                if what == 0:
                    if (v := bases.get(c)) is None:
                        if len(bases) > 100_000:
                            bases.clear()
                        v = bases[c] = base(c)
                    table[data] = (c > 0, v, p)
                    continue
                got = [table[w] for w in words_of(data)]
                k, v, q = zip(*got, strict=True) if got else ((), (), ())
                rows.append((doc_id, what == 2, len(got) + 1, sum(k) + (ends > 0), total, math.fsum(v) + end, (math.fsum(q) + p_end) / ln10))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    out = dealt.mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op8(docs: DataFrame, path: str) -> DataFrame:
    return score(docs, path)
