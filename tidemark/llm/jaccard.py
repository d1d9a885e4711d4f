"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole, and its connected components.

A text's set: A-Z lower-cased, words split at ASCII white space, distinct SHINGLE-word shingles (fewer words: the whole
sequence as one), each as a 64-bit hash. Two sets link when their Jaccard similarity is at least NUM / DEN. Equal sets are
found by digest first and are one node from there on.

Partition: sets x and y that link differ in at most (x + y)(DEN - NUM) / (DEN + NUM) shingles. Sizes are cut into bands of ratio
BAND; a pair belongs to the band of its larger set, and H is the most it can differ there. The band cuts the universe of
shingles by hash into segments with thresholds v of sum H + 1: by the pigeonhole a linked pair differs in fewer than v shingles in
at least one segment. A segment of v = 1 is indexed by its subset of the set, one of v = 2 by the subset and its one-deletion
neighbourhood, so subsets that differ by one shingle meet. With E units more, segments that match have E + 1 units at
least. So every set leaves out the E segments of v = 1 with the fewest shingles (ties: the first), by which unrelated sets would meet: of E + 1
segments that match, the fullest comes after E others in either set, so both index it. E and the number of segments of v = 2
are chosen by cost for each band from the number and sizes of its sets: one-deletion rows cost more, and chance meetings grow with the square of the sets.

Candidates: index rows go to buckets of keys, packed. Keys with one node fall out; up to SMALL nodes make their pairs; of more,
each node is paired with the key's smallest one, and of up to MIDDLE all that still lie in several components. Pairs pass by size and by a bound on the difference (parities of a number of places
in step with the set's size differ in no more places than the sets do), and are then verified on the whole sets, the likeliest first. Nodes of larger keys that still lie in several components are told apart by
a second index, of prefixes: linked sets share one of their rarest shingles (as many as they can differ in and one, by
frequency among these nodes), and what either has left behind that one bounds their overlap, so far copies, whose own shingles are the rarest, meet few. Its keys are taken in
rounds: as long as a key's nodes lie in several components, leaders (one a slot of a hash, LEADERS times as many slots each round) meet
its nodes of other components and leave. So every pair that shares a key of each index is verified, or its nodes are known to be connected, and
neither a large group of near copies nor a frequent subset makes all its pairs.

Skew: within a task a digest is indexed once and a key sends at most SMALL + 1 nodes to its bucket, what is over goes to
random ones. Joins of candidates are sort-merge joins, whose large partitions adaptive execution splits.

Defined results: null and wordless texts have an empty set, size 0, and are components of their own; a null doc_id is
linked too but names no component (of null ids only: null); repeated rows are each returned; an empty table gives no rows;
other columns aren't read. Hashes are 64 bits wide (chance of an equal hash of two shingles in a pair of 20,000-word texts
about 1e-10); digests are checked against a second one and drawn anew if two sets share one.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, hot_join, stored
from .simhash import roots

SHINGLE = 4
NUM, DEN = 85, 100
#: Ratio of a band's largest to its smallest size.
BAND = 1.3
#: What the verification of a pair costs, in index rows.
PAIR_COST = 20
#: Units beyond those that the pigeonhole needs: up to so many, or one for so many needed ones; what one costs, in index rows.
MAX_EXTRA, EXTRA_SHARES, EXTRA_COST = 8, (32, 16, 8, 4), 0.1
#: Chance that two shingles of unrelated sets are the same where they are in the same segment.
SAME = 0.001
#: Nodes of a key up to which all its pairs are taken.
SMALL = 6
#: Nodes of a key up to which all pairs across components are taken after that.
MIDDLE = 64
#: Bits of a set's parity sketch at least, and per shingle in which linked sets of its size can differ.
SKETCH, SKETCH_SHARE = 512, 4
#: Index rows that a task gathers before it packs them; about those of a bucket.
CHUNK_ROWS = 1 << 21
#: Bits of the filter of documents whose sets are fetched; a full filter only lets more through.
FILTER_BITS = 1 << 26
#: Leaders of a key in the first round; as many times more in each that follows.
LEADERS = 16
#: Pairs of a node that are verified at first, then, then all that are left and not yet connected; a few pairs are verified at once.
WAVES, FEW = (1, 8), 10_000
_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _K + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out))


def digest(of: np.ndarray, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(of.tobytes(), seed)


def sketch(of: np.ndarray, apart: int) -> np.ndarray:
    """Parity of the set's number of shingles at each of a power of two of places, as 64-bit numbers; apart is the most that a linked set differs.

    Halves of a sketch, one over the other, are the sketch of half as many places.
    """
    size = max(SKETCH, 1 << (SKETCH_SHARE * apart - 1).bit_length()) if apart else SKETCH
    odd = np.bincount((of & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@dataclass(frozen=True)
class Rule:
    """Sets link when their similarity is at least num / den."""

    num: int = NUM
    den: int = DEN

    def most_apart(self, sizes: int) -> int:
        """Shingles in which two linked sets with that many in all can differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def largest(self, size: int) -> int:
        return size * self.den // self.num


def edges(most: int, ratio: float = BAND) -> list[int]:
    """First sizes of the bands, up to one behind the size most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return out


@dataclass(frozen=True)
class Band:
    """units: H + 1 + extra; double: segments of threshold 2, of two units each; the others have one unit and threshold 1."""

    units: int
    double: int = 0
    extra: int = 0

    @property
    def segments(self) -> int:
        return self.units - self.double


def cost(n_sets: int, mean: float, band: Band) -> float:
    """Index rows, and pairs of unrelated sets in their measure, of n_sets sets of mean shingles.

    A unit has a Poisson number of a set's shingles. Unrelated sets meet in a segment of threshold 1 where both have the same few
    shingles or none and index it, as extra others or more have no more than it; in one of threshold 2 where both have one shingle at most.
    """
    per, single = mean / band.units, band.units - 2 * band.double
    chance, upto = band.double * (math.exp(-2 * per) * (1 + 2 * per)) ** 2, 0.0
    for n in range(3):
        share = math.exp(-per) * per**n / math.factorial(n)
        upto += share
        chance += single * (share * at_least(max(0, single - 1) * upto, band.extra)) ** 2 * SAME**n
    return n_sets * (max(0, single - band.extra) + EXTRA_COST * band.extra + band.double * (1 + 2 * per)) + PAIR_COST * n_sets * n_sets / 2 * chance


def at_least(mean: float, k: int) -> float:
    """Chance that a Poisson number is k at least; of more than MAX_EXTRA, as a normal one."""
    if k <= MAX_EXTRA:
        return 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
    return math.erfc((k - 0.5 - mean) / math.sqrt(2 * mean)) / 2 if mean else 0.0


def allocate(n_sets: int, mean: float, apart: int) -> Band:
    """The cheapest allocation for sets that differ in at most apart shingles where they link."""
    extra = {*range(MAX_EXTRA + 1), *((apart + 1) // x for x in EXTRA_SHARES)}
    able = [Band(u, d, e) for e in extra for u in [apart + 1 + e] for d in {0, u // 4, u // 2}]
    return min(able, key=lambda b: (cost(n_sets, mean, b), b.extra, b.double))


def keys(of: np.ndarray, number: int, band: Band) -> np.ndarray:
    """The index keys of a set in a band. of is ascending, so its segments are ranges."""
    unit = ((of >> np.uint64(32)) * np.uint64(band.units)) >> np.uint64(32)
    double = np.uint64(2 * band.double)
    seg = np.where(unit < double, unit >> np.uint64(1), unit - np.uint64(band.double)).astype(np.int64)
    at = np.searchsorted(seg, np.arange(band.segments + 1))
    value = _mix(of + _K)
    total = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
    name = _mix(np.arange(band.segments, dtype=np.uint64) + np.uint64(number << 32) + _M2)
    exact = _mix(total[at[1:]] - total[at[:-1]] + name)
    if band.extra:
        fewest = np.argsort((at[1:] - at[:-1])[band.double :], kind="stable")[: band.extra]
        exact = np.delete(exact, band.double + fewest)
    near = seg[: at[band.double]]
    if not len(near):
        return exact
    without = total[at[near + 1]] - total[at[near]] - value[: len(near)] + name[near]
    return np.r_[exact, _mix(without)]


class Join:
    """One run over a table: its nodes, its index, and what is verified so far."""

    def __init__(self, docs: DataFrame, rule: Rule | None = None, shingle: int = SHINGLE, force: bool | None = None):
        """force: all segments at threshold 2 (True) or 1 (False) instead of the cheaper, for tests."""
        self.rule, self.shingle, self.force = rule or Rule(), shingle, force
        self.spark = docs.sparkSession
        self.src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        self.comp: DataFrame | None = None
        self.n_linked = 0
        self.sets: list[DataFrame] = []
        self.seed = 0
        while True:
            self.rows = stored(self._digests(), "sets")
            agg = [F.min("h2").alias("lo"), F.max("h2").alias("hi"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"), F.max("n").alias("n")]
            self.nodes = stored(self.rows.filter("n > 0").groupBy("node").agg(*agg), "nodes")
            if self.nodes.filter("lo <> hi").isEmpty():
                break
            self.seed += 2

    def _digests(self) -> DataFrame:
        """doc_id, n, node (first digest), h2 (second), and the sketch where the task meets the digest first."""
        seed, shingle, rule = self.seed, self.shingle, self.rule

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                n, node, second, parity = [], [], [], []
                for text in b.column(1):
                    s = shingle_set(text.as_py(), shingle)
                    d = digest(s, seed)
                    n.append(len(s))
                    node.append(d)
                    second.append(digest(s, seed + 1))
                    parity.append(None if d in seen or not len(s) else sketch(s, rule.most_apart(2 * len(s))))
                    seen.add(d)
                signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, second)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *signed, pa.array(parity, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "h2", "sketch"])

        return self.src.mapInArrow(each, "doc_id bigint, n bigint, node bigint, h2 bigint, sketch array<bigint>")

    def plan(self) -> tuple[list[int], dict[int, Band], int]:
        """(first sizes of the bands, the bands in which different sets can link, index rows in all)."""
        rule = self.rule
        most = self.nodes.agg(F.max("n")).first()[0] or 0
        first = edges(rule.largest(most) + 1)
        starts = F.array(*[F.lit(x) for x in first])
        band = F.size(F.filter(starts, lambda x: x <= F.col("s"))) - 1
        sizes = self.nodes.groupBy(F.col("n").alias("s")).count()  # a row a size
        low, high = band, F.size(F.filter(starts, lambda x: x <= F.floor(F.col("s") * rule.den / rule.num))) - 1
        told = sizes.select("s", "count", F.explode(F.sequence(low, high)).alias("band")).groupBy("band").agg(F.sum("count").alias("n"), F.sum(F.col("s") * F.col("count")).alias("words"))
        bands, rows = {}, 0
        for r in told.collect():  # a row a band
            apart = rule.most_apart(2 * (first[r.band + 1] - 1))
            if apart:  # else only equal sets link
                b = allocate(r.n, r.words / r.n, apart)
                if self.force is not None:
                    b = Band(apart + 1, (apart + 1) // 2 if self.force else 0)
                bands[r.band] = b
                rows += r.n * max(0, b.segments - b.extra) + int(r.words * 2 * b.double / b.units)
        return first, bands, rows

    def candidates(self) -> DataFrame:
        """(key, a, b): pairs a > b to verify (key null), and the nodes a of keys with more than SMALL of them (b null)."""
        first, bands, total = self.plan()
        rule, seed, shingle = self.rule, self.seed, self.shingle
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n_buckets = max(4 * parts, -(-total // CHUNK_ROWS))

        def pack(held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
            key = np.concatenate([k for k, _ in held])
            node = np.repeat(np.array([d for _, d in held], dtype=np.uint64), [len(k) for k, _ in held])
            bucket = ((key >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
            key = key.astype(np.uint32)  # a bucket's keys are told apart by 32 bits more
            order = np.lexsort((node, key, bucket))
            key, node, bucket = key[order], node[order], bucket[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])]
            key, node, bucket = key[new], node[new], bucket[new]
            place = np.arange(len(key)) - np.maximum.accumulate(np.where(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])], np.arange(len(key)), 0))
            over = place > SMALL  # the key is a large one whatever else there is
            away = bucket.copy()
            away[over] = np.random.default_rng(len(key)).integers(0, n_buckets, int(over.sum()))
            kept = ~over
            cut = np.flatnonzero(np.r_[True, bucket[kept][1:] != bucket[kept][:-1]]) if kept.any() else []
            ends = [*cut[1:], int(kept.sum())]
            ks, ns = key[kept], node[kept]
            told = [(int(bucket[kept][i]), False, ks[i:j].tobytes(), ns[i:j].tobytes()) for i, j in zip(cut, ends, strict=True)]
            far, kf, nf = away[over], named(bucket[over], key[over]), node[over]
            for x in np.unique(far):
                told.append((int(x), True, kf[far == x].tobytes(), nf[far == x].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*told, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "large", "keys", "nodes"])

        def named(bucket: np.ndarray | int, key: np.ndarray) -> np.ndarray:
            return np.uint64(bucket) << np.uint64(32) | key.astype(np.uint64)

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            held, n = [], 0
            for b in batches:
                for text in b.column(1):
                    s = shingle_set(text.as_py(), shingle)
                    d = digest(s, seed)
                    if not len(s) or d in seen:
                        continue
                    seen.add(d)
                    for k in range(bisect.bisect_right(first, len(s)) - 1, bisect.bisect_right(first, rule.largest(len(s)))):
                        if k in bands:
                            held.append((keys(s, k, bands[k]), d))
                            n += len(held[-1][0])
                    if n >= CHUNK_ROWS:
                        yield from pack(held)
                        held, n = [], 0
            if n:
                yield from pack(held)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Packets come sorted by bucket, so a bucket is whole when the next one begins."""
            open_, held = None, []
            for b in batches:
                for bucket, large, k, n in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                    n = np.frombuffer(n, np.uint64)
                    if large:
                        yield rows([(np.frombuffer(k, np.int64), n.view(np.int64), None)])
                        continue
                    k = named(bucket, np.frombuffer(k, np.uint32))
                    if bucket != open_ and held:
                        yield rows(matched(*map(np.concatenate, zip(*held, strict=True))))
                        held = []
                    open_ = bucket
                    held.append((k, n))
            if held:
                yield rows(matched(*map(np.concatenate, zip(*held, strict=True))))

        def rows(of: list[tuple]) -> pa.RecordBatch:
            cols = [[], [], []]
            for part in of:
                n = len(part[1])
                for c, x in zip(cols, part, strict=True):
                    c.append(pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) if c else pa.array([], pa.int64()) for c in cols], names=["key", "a", "b"])

        packed = self.src.mapInArrow(index, "bucket bigint, large boolean, keys binary, nodes binary")
        return stored(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key bigint, a bigint, b bigint"), "candidates")

    def fetch(self, need: DataFrame) -> DataFrame:
        """(node, hashes) of the nodes in need.node, which are distinct."""
        seed, shingle, bits = self.seed, self.shingle, FILTER_BITS
        place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        ids = self.nodes.join(need, "node").select(F.col("first_id").alias("doc_id"))
        maps = ids.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        whole = np.zeros(bits // 8, np.uint8)
        for r in maps.collect():  # at most bits / 8 bytes in all; of numbers over zero, buckets count from 1
            part = np.frombuffer(r.bits, np.uint8)
            low = (r["at"] - 1) * len(part)
            whole[low : low + len(part)] = part[: len(whole) - low]
        shared = self.spark.sparkContext.broadcast(whole.tobytes())

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, seen = np.frombuffer(shared.value, np.uint8), set()
            for b in batches:
                p = b.column(0).to_numpy(zero_copy_only=False)
                able = (there[p // 8] >> (p % 8).astype(np.uint8)) & 1
                node, hashes = [], []
                for i in np.flatnonzero(able):
                    s = shingle_set(b.column(1)[int(i)].as_py(), shingle)
                    d = digest(s, seed)
                    if len(s) and d not in seen:
                        seen.add(d)
                        node.append(d)
                        hashes.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])

        found = self.src.select(place.alias("p"), "text").mapInArrow(each, "node bigint, hashes array<bigint>")
        return stored(found.join(need, "node", "left_semi").dropDuplicates(["node"]), "hashes")

    def link(self, pairs: DataFrame, most: int) -> None:
        """Joins the components of verified pairs, of which there are that many at most."""
        new = stored(gathered(self.apart(pairs, self.comp, named=True).distinct(), most), "verified")
        if new.isEmpty():
            return
        more = roots(new)
        if self.comp is not None:  # roots of before that have one of their own now, and nodes that had no links
            moved = self.comp.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            more = moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(more)
        self.n_linked += 2 * most
        self.comp = stored(gathered(more, self.n_linked), "components")

    def apart(self, pairs: DataFrame, comp: DataFrame | None, named: bool = False) -> DataFrame:
        """The pairs (a, b, ...) that no links connect yet; named: as their components' roots, the larger first."""
        if comp is None:
            both = pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
        else:
            of = lambda x: comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
            both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
        both = both.filter("ra <> rb")
        return both.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")) if named else both.select(*pairs.columns)

    def able(self, pairs: DataFrame) -> DataFrame:
        """(a, b, d): the distinct pairs whose sizes and sketches allow a link; d is the least number of shingles they differ in."""
        high, low = F.greatest("a", "b").alias("h"), F.least("a", "b").alias("l")  # a pair may come either way round; the node stays before its leader
        once = pairs.groupBy(high, low).agg(F.min("a").alias("a"))
        pairs = stored(once.select("a", F.when(F.col("a") == F.col("h"), F.col("l")).otherwise(F.col("h")).alias("b")), "pairs")
        n_pairs = pairs.count()
        ends = gathered(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n_pairs)
        light = stored(gathered(self.rows.filter("sketch is not null").select("node", "n", "sketch").join(ends, "node", "left_semi").dropDuplicates(["node"]), 2 * n_pairs), "sketches")
        of = lambda x: light.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        r = self.rule
        fits = F.least("na", "nb") * r.den >= F.greatest("na", "nb") * r.num
        xor = lambda x, y: x.bitwiseXOR(y)
        both = pairs.join(of("a"), "a").join(of("b"), "b").filter(fits)
        for x, y in (("sa", "sb"), ("sb", "sa")):  # sizes that can link have as many places, or twice as many
            k = F.size(y)
            both = both.withColumn(x, F.when(F.size(x) > k, F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), xor)).otherwise(F.col(x)))
        differ = F.aggregate(F.zip_with("sa", "sb", xor), F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x))
        both = both.withColumn("d", differ)
        return stored(gathered(both.filter(F.col("d") * (r.den + r.num) <= (F.col("na") + F.col("nb")) * (r.den - r.num)).select("a", "b", "d"), n_pairs), "able")

    def whole_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, hashes) of all sets fetched so far, those of nodes.node (distinct) among them."""
        need = nodes
        for have in self.sets:
            need = need.join(have.select("node"), "node", "left_anti")
        need = stored(need, "need")
        if not need.isEmpty():
            self.sets.append(self.fetch(need))
        sets = self.sets[0]
        for x in self.sets[1:]:
            sets = sets.unionByName(x)
        return sets

    def prefixes(self, nodes: DataFrame) -> DataFrame:
        """(key, node, n, place): of each node, of size n, the rarest shingles by place from 1, as many as a set that links can lack and one more; those that one node has alone are left out.

        In any one order of the shingles, two sets of overlap o share one of the first |x| - o + 1 and |y| - o + 1; o is at least
        num / den of either size.
        """
        sets = self.whole_sets(nodes).join(nodes, "node", "left_semi")
        flat = stored(sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("key")), "shingles")
        times = flat.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        r = self.rule
        most = F.col("n") - F.ceil(F.col("n") * r.num / r.den) + 1
        ranked = flat.join(times, "key").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("times", "key")))
        return stored(ranked.filter((F.col("place") <= most) & (F.col("times") > 1)).select("key", "node", "n", "place"), "prefixes")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets."""
        sets = self.whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        of = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"s{x}"))
        shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
        both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
        return both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("s")).filter(F.col("i") * self.rule.den >= (F.col("s") - F.col("i")) * self.rule.num).select("a", "b")

    def settle(self, pairs: DataFrame) -> None:
        """Verifies pairs, the likeliest of each a first, until all are verified or connected."""
        left = self.able(pairs)
        n = left.count()
        for take in (*WAVES, None):
            if not n:
                return
            left = stored(gathered(self.apart(left, self.comp).withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))), n), "left")
            n = left.count()
            if not n:
                return
            if take is None or n <= FEW:
                return self.link(self.verified(left), n)
            self.link(self.verified(left.filter(F.col("place") <= take)), n)
            left = left.filter(F.col("place") > take).drop("place")

    def run(self) -> DataFrame | None:
        """(node, root) of all nodes with links."""
        found = self.candidates()
        large = found.filter("b is null").select("key", F.col("a").alias("node"))
        star = large.groupBy("key").agg(F.min("node").alias("b"))
        stars = large.join(star, "key").filter("node <> b").select(F.col("node").alias("a"), "b")
        self.settle(found.filter("b is not null").select("a", "b").unionByName(stars))
        n = large.count()
        large = self.mixed(large, n)
        if large.isEmpty():
            return self.comp
        times = stored(gathered(large.groupBy("key").agg(F.count(F.lit(1)).alias("n")), n), "times")
        middle = large.join(times.filter(F.col("n") <= MIDDLE), "key", "left_semi").join(self.nodes.select("node", F.col("n").alias("size")), "node")
        x, y = middle.alias("x"), middle.alias("y")
        fits = F.least("x.size", "y.size") * self.rule.den >= F.greatest("x.size", "y.size") * self.rule.num
        across = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
        self.settle(x.join(y, across & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        large = self.mixed(large.join(times.filter(F.col("n") > MIDDLE), "key", "left_semi").drop("root"), n)
        if large.isEmpty():
            return self.comp
        large, step = self.prefixes(large.select("node").distinct()), 1
        n_rows = large.count()
        while True:
            named = self.mixed(large, n_rows)
            if named.isEmpty():
                return self.comp
            slot = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(LEADERS**step))
            lead = named.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "root", "n", "place")).alias("x"))
            lead = stored(gathered(lead.select("key", F.col("x.node").alias("b"), F.col("x.root").alias("rb"), F.col("x.n").alias("nb"), F.col("x.place").alias("pb")), n_rows), "leaders")
            # at the first shingle that two sets share, what is left of either bounds their overlap
            r, n, m = self.rule, F.col("n.n"), F.col("l.nb")
            enough = (F.least(n - F.col("n.place"), m - F.col("l.pb")) + 1) * (r.den + r.num) >= (n + m) * r.num
            fits = (F.least(n, m) * r.den >= F.greatest(n, m) * r.num) & enough
            met = named.alias("n").join(lead.alias("l"), (F.col("n.key") == F.col("l.key")) & (F.col("n.root") != F.col("l.rb")) & fits)
            self.settle(met.select(F.col("n.node").alias("a"), F.col("l.b").alias("b")))
            large = named.drop("root").join(lead.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")
            step += 1

    def mixed(self, rows: DataFrame, n: int) -> DataFrame:
        """rows (key, node, ...), n at most, with each node's root, of the keys whose nodes lie in several components."""
        comp = self.comp
        named = rows.withColumn("root", F.col("node")) if comp is None else rows.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = stored(gathered(named, n), "named")
        several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        return stored(gathered(named.join(gathered(several, n), "key", "left_semi"), n), "mixed")


def matched(key: np.ndarray, node: np.ndarray) -> list[tuple]:
    """Of a bucket's index rows the parts (key, a, b): pairs of small keys, nodes of large ones."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node = key[new], node[new].view(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    out, pairs = [], []
    for g in range(2, SMALL + 1):
        at = first[size == g]
        for i in range(g - 1):
            for j in range(i + 1, g):
                pairs.append(np.c_[node[at + i], node[at + j]])
    if pairs and sum(map(len, pairs)):
        both = np.concatenate(pairs)
        both = np.unique(np.c_[both.max(axis=1), both.min(axis=1)], axis=0)
        out.append((None, both[:, 0], both[:, 1]))
    large = np.repeat(size > SMALL, size)
    if large.any():
        out.append((key[large].view(np.int64), node[large], None))
    return out


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rule: Rule | None = None, shingle: int = SHINGLE, force: bool | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    join = Join(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), rule, shingle, force)
    comp = join.run()
    nodes = join.nodes.select("node", "first_id", "n_docs")
    named = nodes.withColumn("root", F.col("node")) if comp is None else nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "named")
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    classes = stored(hot_join(named, best, "root", "n_nodes", named.count()).select("node", "component_id", "n_docs"), "classes")
    rows = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "node")
    linked = hot_join(rows.filter("n_shingles > 0"), classes, "node", "n_docs", join.rows.count()).drop("node")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op11(docs: DataFrame) -> DataFrame:
    return components(docs)
