"""Cross-tokenizer alignment: which tokens of vocabulary B cover the bytes of which tokens of vocabulary A.

A space and the text are encoded by A (byte-level BPE); the text by B (sentencepiece BPE with byte fallback, which puts the
space there itself). Special tokens' names inside a text are plain text. Each token covers a range of bytes.

The byte ranges of B's tokens are a static interval index: two ascending arrays, of starts and of ends. Each A token is a
stabbing query, bisected in both: the B tokens that overlap it are those from the first that ends behind its start to the
last that starts before its end. A gap between two A tokens that no B token spans (the last overlap of the one lies before the first of the
other) is a group boundary. A link is an A token and a B token whose ranges end together.

Corpus counts: each task writes blocks of neighbouring texts, about BLOCK_BYTES each, with the block's distinct linked id
pairs and how often each holds. Pairs are summed over blocks, the highest count of each B id is a table of at most B's vocabulary,
and both go back to a block's pairs, once each, and from there to its texts. A pair has at most one row a block, whatever its frequency.

Both vocabularies keep white-space segments apart (no piece of B goes on behind a space; checked when the file is read), so
a worker remembers the ids of a bounded number of segments; texts with rarer white space are encoded whole.

Defined results: null and empty texts, and texts whose ids don't give back their bytes, have no tokens: zeros and an empty
digest; rows without an id, and repeated ones, are aligned and counted each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import _RARE, _SEGMENT, Encoder

#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Segments that a worker remembers in either of two halves; one that is met again stays.
MEMO = 200_000
_HEAD = "\n"  # encoded before a segment, so that B adds no space of its own to it


class Vocabulary:
    """Ids of both tokenizers, as little-endian unsigned 32-bit numbers, and each id's bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a, False)
        self.a.tok.encode_special_tokens = True
        back = {v: k for k, v in self.a.alphabet.items()}
        names = self.a.tok.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(back[ord(c)] for c in name) if all(ord(c) in back for c in name) else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        own = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any("▁" in p.lstrip("▁") for p in own):
            raise ValueError("a piece goes on behind a space, so segments don't stand alone")
        #: white space that pieces hold; texts with any of it are encoded whole
        self.joined = [c for c in "\t\n\v\f\r" if any(c in p for p in own)]
        self.head = self.b.encode(_HEAD)
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.before: dict[bytes, tuple[bytes, bytes]] = {}

    def _whole_b(self, text: str) -> bytes:
        ids = self.b.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _segment(self, segment: bytes) -> tuple[bytes, bytes]:
        if (found := self.before.get(segment)) is None:
            ids = self.b.encode(_HEAD + segment.decode())
            if ids[: len(self.head)] != self.head:
                raise ValueError("a segment is joined to what stands before it")
            ids = ids[len(self.head) :]
            # a segment that B doesn't give back is marked by an id that no vocabulary has
            same = b"".join([self.bytes_b[i] for i in ids]) == segment
            found = self.a._segment(segment), struct.pack(f"<{len(ids)}I", *ids) if same else b"\xff" * 4
        self.memo[segment] = found
        return found

    def _apart(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of a text encoded whole; none where the bytes differ."""
        a, b = self.a.whole(" " + text), self._whole_b(text)
        a, b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
        want = b" " + text.encode()
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != want or b"".join([self.bytes_b[i] for i in b.tolist()]) != want:
            return a[:0], b[:0]
        return a, b

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = text.decode()
        if _RARE.search(plain) or any(c in plain for c in self.joined):
            return self._apart(plain)
        if len(self.memo) > MEMO:
            self.before, self.memo = self.memo, {}
        get, make = self.memo.get, self._segment
        found = [get(s) or make(s) for s in _SEGMENT.findall(b" " + text)]
        a = np.frombuffer(b"".join([x[0] for x in found]), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join([x[1] for x in found]), "<u4").astype(np.int64)
        if len(b) and int(b.max()) >= len(self.bytes_b):
            return self._apart(plain)
        return a, b


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path_a: str, path_b: str) -> Vocabulary:
    """The worker's vocabularies for these files; workers live on between tasks."""
    if (path_a, path_b) not in _VOCABULARIES:
        _VOCABULARIES[path_a, path_b] = Vocabulary(path_a, path_b)
    return _VOCABULARIES[path_a, path_b]


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each A token the first and the last B token that it overlaps; sizes in bytes, all over zero, with equal sums."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    first = np.searchsorted(end_b, end_a - size_a, "right")
    last = np.searchsorted(end_b - size_b, end_a, "left") - 1
    return first, last


def groups(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A tokens that end a group, B tokens that end one, the B token that ends together with each A token or -1)."""
    if not len(size_a):
        return (np.zeros(0, np.int64),) * 3
    first, last = overlaps(size_a, size_b)
    apart = np.r_[last[:-1] < first[1:], True]
    together = np.where(np.cumsum(size_b)[last] == np.cumsum(size_a), last, -1)
    return np.flatnonzero(apart), last[apart], together


class Writer:
    """The text form of groups, a1,a2|b1;a3|b2,b3, by one look-up a token."""

    def __init__(self, n_ids: int):
        self.n = n_ids
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(n_ids)]

    def text(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> str:
        code_a, code_b = a.copy(), b.copy()
        code_a[end_a] += self.n
        code_b[end_b] += 2 * self.n
        of_a = np.searchsorted(end_a, np.arange(len(a)), "left")
        of_b = np.searchsorted(end_b, np.arange(len(b)), "left")
        order = np.argsort(np.r_[2 * of_a, 2 * of_b + 1], kind="stable")
        return "".join(map(self.names.__getitem__, np.r_[code_a, code_b][order].tolist()))[:-1]


BLOCK = (
    "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "links binary, pairs array<bigint>, times array<bigint>"
)


def _blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """One row per block: its documents' figures, their links as places in the block's list of distinct pairs, and that list with counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        v = vocabulary(path_a, path_b)
        writer = Writer(max(len(v.bytes_a), len(v.bytes_b)))
        types = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]
        names = [x.split()[0] for x in BLOCK.split(", ")]
        base = TaskContext.get().partitionId() << 32
        rows, links, size, n_blocks = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal rows, links, size, n_blocks
            pairs, places, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            packed = zstandard.ZstdCompressor(level=1).compress(places.astype("<u4").tobytes())
            values = [base + n_blocks, *(list(c) for c in zip(*rows, strict=True)), packed, pairs, times]
            out = pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(values, types, strict=True)], names=names)
            rows, links, size, n_blocks = [], [], 0, n_blocks + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                if rows and size + len(text) > block_bytes:
                    yield block()
                a, b = v.encode(text)
                end_a, end_b, together = groups(v.size_a[a], v.size_b[b])
                ends = np.flatnonzero(together >= 0)
                digest = hashlib.sha256(writer.text(a, b, end_a, end_b).encode()).hexdigest() if len(a) else ""
                rows.append((doc_id, len(a), len(b), len(end_a), len(ends), digest))
                links.append(a[ends] << 32 | b[together[ends]])
                size += len(text) + 64
        if rows:
            yield block()

    src = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("binary").alias("text"))
    return src.mapInArrow(each, BLOCK)


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their pairs' corpus counts -> a row per document."""
    import zstandard

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            told = row.column("told").to_pylist()[0] or []
            count, best = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64)
            for x in told:
                count[x["place"]], best[x["place"]] = x["n"], x["best"]
            places = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("links")[0].as_py()), "<u4")
            flat = {n: row.column(n).combine_chunks().flatten() if hasattr(row.column(n), "combine_chunks") else row.column(n).flatten() for n in names}
            ends = np.r_[0, np.cumsum(flat["n_links"].to_numpy())]
            sums = [np.r_[0, np.cumsum(x[places])] for x in (best, count)]
            new = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
            cols = [*(flat[n] for n in names[:-1]), *new, flat["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per linked id pair: a, b, n, best).

    n is how many links of the corpus hold the pair; best tells whether that is the highest of its B id, ties included.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = stored(_blocks(src, path_a, path_b, block_bytes), "aligned")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    summed = stored(listed.groupBy("pair").agg(F.sum("times").alias("n")).select("pair", b, "n"), "pairs")
    top = summed.groupBy("b").agg(F.max("n").alias("top"))  # a row an id of B's vocabulary
    counted = summed.join(F.broadcast(top), "b").select("pair", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    back = listed.drop("times").join(counted.drop("b"), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "n", F.col("best").cast("int").alias("best"))).alias("told"))
    result = blocks.drop("pairs", "times").join(back, "block", "left").mapInArrow(_scored, RESULT)
    return result, counted.select(F.shiftright("pair", 32).alias("a"), "b", "n", "best")


def op13(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return align(docs, path_a, path_b)[0]
