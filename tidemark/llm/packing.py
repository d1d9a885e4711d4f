"""Vector bin packing of token sequences for training, by the dot-product heuristic.

Every item is a vector: tokens, segments (1) and loss-bearing tokens. A bin is closed under three limits at once.
Bins are filled one after another: among the waiting items that fit, the one whose vector has the largest dot
product with the bin's free capacity, each dimension relative to its limit, goes in; every waiting item is scored.
Items longer than a bin are first cut at its limits; when nothing waiting fits a gap, the item that can give most to it
is cut. A bin that a limit closes more than a SLACK-th short is cut back to a power of two, which needs no padding,
and what is over waits again.

Each task packs the items of its own partition, a bounded pool of remainders at a time, so there is no shuffle
and no group larger than the pool; an item that waits holds its own ids and nothing else of its document; sequence ids are partition number << 33 | number in the partition.

Defined results: a null or empty text is the end id alone; repeated rows are packed like any others; an empty table
gives no rows. The op10 query takes a document's first line for its prompt, whose tokens bear no loss (as many leading ids
as the line alone has; a text without a line end has no prompt), and packs under QUERY_LIMITS.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

BYTE_BPE = "byte_bpe_50k.json"
#: Remainders that wait in a task before bins are filled.
POOL = 4096


#: A bin that is short by a SLACK-th of its tokens at most is padded, not cut back.
SLACK = 32


@dataclass(frozen=True)
class Limits:
    """Of one sequence. At the defaults tokens bind first; segments and loss-bearing tokens bound instruction data."""

    tokens: int = 1024
    segments: int = 512
    loss: int = 1024


#: Of the op10 query: each of the three closes sequences there.
QUERY_LIMITS = Limits(1024, 8, 1016)


@dataclass(frozen=True, slots=True)
class Item:
    """A piece of a document: key tells the document, start its place there, ids are its own, four bytes each."""

    key: tuple[int | None, int]
    start: int
    tokens: int
    loss: int
    ids: bytes | memoryview = b""

    def kept(self) -> Item:
        """The same, without a view into the document's ids."""
        return Item(self.key, self.start, self.tokens, self.loss, bytes(self.ids))


class Packer:
    """One task's bins. put() takes items and returns closed bins; drain() closes all."""

    def __init__(self, limits: Limits, pool: int = POOL):
        self.limits, self.pool = limits, pool
        self.waiting: list[Item] = []
        self.vectors = np.zeros((2, pool + 64))  # tokens, loss of the waiting items

    def _wait(self, it: Item) -> None:
        n = len(self.waiting)
        if n == self.vectors.shape[1]:
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)], axis=1)
        self.vectors[:, n] = it.tokens, it.loss
        self.waiting.append(it.kept())

    def _take(self, k: int) -> Item:
        it, last = self.waiting[k], self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k] = last
            self.vectors[:, k] = last.tokens, last.loss
        return it

    @staticmethod
    def cut(it: Item, tokens: int) -> tuple[Item, Item]:
        """Loss-bearing tokens come last in an item: the head takes those that the tail has no room for."""
        rest = it.tokens - tokens
        loss = min(it.loss, rest)
        ids = memoryview(it.ids)
        return Item(it.key, it.start, tokens, it.loss - loss, ids[: 4 * tokens]), Item(it.key, it.start + tokens, rest, loss, ids[4 * tokens :])

    def put(self, it: Item) -> list[list[Item]]:
        lim, out = self.limits, []
        while it.tokens > lim.tokens or it.loss > lim.loss:
            head, it = self.cut(it, min(lim.tokens, it.tokens - it.loss + lim.loss))
            if head.tokens == lim.tokens:
                out.append([head])
            else:
                self._wait(head)
        if it.tokens:
            self._wait(it)
        while len(self.waiting) > self.pool:
            out.append(self._fill())
        return out

    def best(self, free_t: int, free_l: int) -> int:
        """The waiting item that fits with the largest dot product with the free capacity; -1 where none fits. One segment each, so segments tell none apart."""
        t, loss = self.vectors[:, : len(self.waiting)]
        score = t * (free_t / self.limits.tokens**2) + loss * (free_l / self.limits.loss**2)
        score[(t > free_t) | (loss > free_l)] = -1
        k = int(score.argmax())
        return k if score[k] >= 0 else -1

    def _fill(self) -> list[Item]:
        lim = self.limits
        free_t, free_s, free_l = lim.tokens, lim.segments, lim.loss
        bin_: list[Item] = []
        while free_t and free_s and self.waiting:
            k = self.best(free_t, free_l)
            if k >= 0:
                piece = self._take(k)
            else:  # nothing fits: the item that can gives as much as fits
                t, loss = self.vectors[:, : len(self.waiting)]
                room = np.minimum(t - loss + free_l, free_t)
                k = int(room.argmax())
                if room[k] <= 0:
                    break
                piece, rest = self.cut(self._take(k), int(room[k]))
                self._wait(rest)
            bin_.append(piece)
            free_t, free_s, free_l = free_t - piece.tokens, free_s - 1, free_l - piece.loss
        if free_t * SLACK > lim.tokens:
            self._cut_back(bin_, lim.tokens - free_t)
        return bin_

    def _cut_back(self, bin_: list[Item], total: int) -> None:
        """What is over the largest power of two waits again."""
        over = total - (1 << total.bit_length() - 1)
        while over:
            last = bin_.pop()
            if last.tokens > over:
                head, last = self.cut(last, last.tokens - over)
                bin_.append(head)
            self._wait(last)
            over -= last.tokens

    def drain(self) -> list[list[Item]]:
        out = []
        while self.waiting:
            out.append(self._fill())
        return out


def _pieces(batches: Iterator[pa.RecordBatch], limits: Limits, pool: int, path: str, end: int, ids_out: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc = encoder(path, False)
    end_id = end.to_bytes(4, "little")
    base = TaskContext.get().partitionId() << 33
    packer, seq = Packer(limits, pool), 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * ids_out
    rows: list[tuple] = []

    def emit(bins: list[list[Item]]) -> None:
        nonlocal seq
        for b in bins:
            at = 0
            for it in b:
                doc_id, total = it.key
                rows.append((doc_id, it.start, it.tokens, zlib.crc32(it.ids), total, base + seq, at, it.loss, *([bytes(it.ids)] if ids_out else [])))
                at += it.tokens
            seq += 1

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)
        rows.clear()
        return out

    for b in batches:
        for doc_id, text, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ids = enc.encode(text or b"") + end_id
            n = len(ids) // 4
            free = min(n, len(enc.encode(prompt)) // 4) if prompt else 0
            emit(packer.put(Item((doc_id, n), 0, n, n - free, ids)))
            if len(rows) >= 8192:
                yield batch()
    emit(packer.drain())
    if rows:
        yield batch()


def pack(docs: DataFrame, path: str, *, limits: Limits | None = None, end: int = 0, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text", prompt: Column | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and its ids (little-endian u32).

    prompt is a leading part of the text whose tokens bear no loss (instruction data); without it all do.
    """
    limits = limits or Limits()
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint" + ", ids binary" * with_ids
    prompt = F.lit(None) if prompt is None else prompt
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), prompt.cast("binary").alias("prompt"))
    return src.mapInArrow(lambda it: _pieces(it, limits, pool, path, end, with_ids), schema)


def first_line(text_col: str = "text") -> Column:
    """The line before a text's first line end; null where there is none."""
    text = F.col(f"`{text_col}`")
    return F.when(F.instr(text, "\n") > 0, F.substring_index(text, "\n", 1))


def op10(docs: DataFrame, path: str) -> DataFrame:
    packed = pack(docs, path, limits=QUERY_LIMITS, prompt=first_line(), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
