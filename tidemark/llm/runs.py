"""Periodic runs of words: heavy/light lag counting, then island scans at the lags that can hold a run.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_WORDS, MIN_PERIODS * q) words, which no
neighbouring word extends. At lag q it shows as need(q) = max(MIN_WORDS, MIN_PERIODS * q) - q matches in a row, so a lag
with fewer matches in the whole text holds none. Matches of every lag are counted exactly:

* words that are frequent in their text (heavy, more than about the square root of n log n occurrences) by the
  autocorrelation of their indicators: one FFT a word, power spectra added up, one inverse FFT, rounded to whole numbers;
* all others (light) by the differences of their pairs of positions, over all texts of a chunk at once.

Lags are scanned from the shortest up. Before each scan the matches that shorter runs with a period dividing q explain are
taken off: such a run of length L has L - q pairs at lag q, and none of them lies in a run of smallest period q (two runs
that share q + 1 words and whose periods divide q are one run, by Fine and Wilf), so the rest is what a new run can have. A scan looks at
anchors only: need(q) matches in a row hold GRAM matches from some multiple of need(q) - GRAM + 1 on. Anchors are compared
by a rolling hash of GRAM words, then grown to islands by comparing the words themselves.

Each task works on its own rows, CHUNK_WORDS words of neighbouring texts or one longer text at a time: no shuffle, no state.

Defined results: a null, empty or wordless text has no runs, null figures and the digests of empty strings; a null doc_id
makes no planted period; repeated rows are each returned; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_PERIODS = 24, 3
#: Words that an anchor compares; at most MIN_WORDS - MIN_WORDS // MIN_PERIODS, the fewest matches in a row of any run.
GRAM = 8
#: Words of texts that are counted together.
CHUNK_WORDS = 1 << 17
#: Position differences that are gathered before they are counted.
FLUSH = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def need(q):
    """Matches in a row that the shortest run of period q has."""
    return np.maximum(MIN_WORDS, MIN_PERIODS * q) - q


def heavy_floor(n: int) -> int:
    """Occurrences over which an FFT of the text is cheaper than the word's pairs."""
    return max(64, int((n * max(1.0, np.log2(max(n, 2)))) ** 0.5))


def _fft_lags(ids: np.ndarray, heavy: np.ndarray, lags: int) -> np.ndarray:
    """Matches of the heavy words at lags 0..lags: sums of whole numbers far below 2 ** 53, so rounding is exact."""
    size = 1 << int(len(ids) + lags).bit_length()
    power = np.zeros(size // 2 + 1)
    for w in heavy:
        f = np.fft.rfft((ids == w).astype(np.float64), size)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (words as numbers from 0) the matches at lags 0..n // MIN_PERIODS; lag 0 isn't counted."""
    if not texts:
        return []
    lags = [len(t) // MIN_PERIODS for t in texts]
    base = np.r_[0, np.cumsum([x + 1 for x in lags])]
    counts = np.zeros(base[-1], np.int64)
    keys, first, light = [], 0, []
    for t, (ids, most) in enumerate(zip(texts, lags, strict=True)):
        times = np.bincount(ids, minlength=1)
        heavy = np.flatnonzero(times > heavy_floor(len(ids)))
        if len(heavy) and most:
            counts[base[t] : base[t + 1]] += _fft_lags(ids, heavy, most)
            counts[base[t]] = 0
        pairable = (times > 1) & (times <= heavy_floor(len(ids)))
        at = np.flatnonzero(pairable[ids]) if len(ids) else np.zeros(0, np.int64)
        light.append((np.full(len(at), t), at))
        keys.append(ids[at] + first)
        first += len(times)
    key, of, at = np.concatenate(keys), np.concatenate([x[0] for x in light]), np.concatenate([x[1] for x in light])
    order = np.argsort(key, kind="stable")  # a word's positions stay ascending
    key, of, at = key[order], of[order], at[order]
    most = np.asarray(lags)[of] if len(of) else of
    held, waiting, step = [], 0, 1
    alive = np.arange(len(key) - 1)
    while len(alive):
        alive = alive[: np.searchsorted(alive, len(key) - step)]
        d = at[alive + step] - at[alive]
        ok = (key[alive + step] == key[alive]) & (d <= most[alive])  # differences only grow with the step
        alive, d = alive[ok], d[ok]
        held.append(base[of[alive]] + d)
        waiting += len(alive)
        step += 1
        if waiting >= FLUSH:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, waiting = [], 0
    if waiting:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    return [counts[base[t] : base[t + 1]] for t in range(len(texts))]


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each position on."""
    n = len(ids) - GRAM + 1
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x100000001B3) + x[k : k + n]
    return out


def _same_until(ids: np.ndarray, at: int, q: int) -> int:
    """First position from at on whose word differs from the one q later (or that has none)."""
    end, step = len(ids) - q, 64
    while at < end:
        to = min(end, at + step)
        differ = ids[at:to] != ids[at + q : to + q]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = to, step * 4
    return end


def _same_since(ids: np.ndarray, at: int, q: int) -> int:
    """First position of the matches in a row that end before at."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        differ = (ids[low:at] != ids[low + q : at + q])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = low, step * 4
    return 0


def scan(ids: np.ndarray, q: int, grams: np.ndarray) -> Iterator[Run]:
    """The stretches with period q (smallest or not) that are long enough and that no neighbour extends."""
    least = int(need(q))
    anchors = np.arange(0, len(grams) - q, least - GRAM + 1)
    done = -1
    for j in anchors[grams[anchors] == grams[anchors + q]]:
        if j < done or ids[j] != ids[j + q]:
            continue
        start, end = _same_since(ids, int(j), q), _same_until(ids, int(j), q)
        done = end
        if end - start >= least:
            yield start, end - start + q, q


def find_runs(ids: np.ndarray, counts: np.ndarray) -> list[Run]:
    """All runs of a text, by start, then period."""
    q = np.arange(len(counts))
    able = np.flatnonzero(counts >= need(q))
    able = able[able > 0]
    runs: dict[tuple[int, int], int] = {}
    lengths: dict[int, list[int]] = {}  # of the runs of each period
    grams = _grams(ids) if len(able) else None
    for lag in able.tolist():
        told = sum(max(0, length - lag) for p, of in lengths.items() if lag % p == 0 for length in of)
        if counts[lag] - told >= need(lag):
            for start, length, p in scan(ids, lag, grams):
                if (start, length) not in runs:
                    runs[start, length] = p
                    lengths.setdefault(p, []).append(length)
    return sorted((s, n, p) for (s, n), p in runs.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's text: of one id in ten the words from a on repeat those of a period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


SCHEMA = "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, n_kept bigint, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: its runs' number and digest, its strongest run, and the text without repetition (with_text: itself, as collapsed).

    plant applies the query's planted periods first.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["runs", "collapsed"] * with_text
    types = [pa.int64()] * 8 + [pa.string()] * 2 + [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.binary()] * with_text

    def rows(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        texts = []
        for _, words in held:
            number: dict[bytes, int] = {}
            texts.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
        out = []
        for (doc_id, words), ids, counts in zip(held, texts, lag_counts(texts), strict=True):
            runs = find_runs(ids, counts)
            best = strongest(runs)
            kept = collapsed(words, runs)
            text = b" ".join(kept)
            told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            more = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text] if with_text else []
            out.append((doc_id, len(words), len(runs), *figures, len(kept), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), *more))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if plant:
                    words = planted(words, doc_id)
                if held and n + len(words) > CHUNK_WORDS:
                    yield rows(held)
                    held, n = [], 0
                held.append((doc_id, words))
                n += len(words) + 1
        if held:
            yield rows(held)

    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    more = ", runs array<struct<start bigint, length bigint, period bigint>>, collapsed binary" * with_text
    return src.mapInArrow(each, SCHEMA + more)


def op12(docs: DataFrame) -> DataFrame:
    return detect(docs, plant=True)
