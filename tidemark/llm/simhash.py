"""SimHash near-duplicates: fingerprints, a binary trie self-join under a Hamming budget, connected components.

Fingerprints: A-Z lower-cased, words split at ASCII white space, SHINGLE-word shingles with repeats, XXH64 (seed 42)
of each; a bit is 1 if set in over half the hashes. Equal fingerprints are collapsed first, whatever their number.

Join: two fingerprints that differ in at most BUDGET bits agree on all but BUDGET of the m blocks that 64 bits are cut
into (m = BLOCKS), so they share the leading bits of at least one of C(m, BUDGET) bit orders, each of which has
m - BUDGET blocks in front. For each order a binary trie holds the fingerprints; node pairs of one trie that agree on the leading blocks are
traversed together, bit by bit, differing bits are added up, and a pair of nodes is dropped when the sum is over the
budget. Spark spreads the tries by (order, leading blocks). Subtrees over MAX_NODE are cut into pairs of their own sub-nodes, within the budget, before
they reach a task, and again until none is over it. A task returns links that span its components, never all pairs of a group.

Components: parents are pulled to the smallest neighbour and jumped until nothing changes, each round a few
map-side combined aggregations whose result is written to the shared folder.

Defined results: null and wordless texts have fingerprint zero, linked like any other; a null doc_id is linked too
but names no component (a component of null ids only has a null component_id); repeated rows are each returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, gathered, hot_join, stored, unused

SHINGLE = 4
BUDGET = 4
#: Fingerprints of one trie subtree that a task takes at once; larger subtrees are cut.
MAX_NODE = 4096
#: Blocks that 64 bits are cut into: BUDGET + 2 give 15 orders with 21 leading bits, which keep a billion fingerprints at
#: a few hundred a subtree. The number doesn't depend on the input, so rows grow in step with it.
BLOCKS = 6
#: Node pairs that a task expands at once; more wait on a stack.
FRONTIER = 1 << 18
#: Big subtrees whose list is broadcast; a longer list is joined by a shuffle.
MAX_BROADCAST = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((h(b" ".join(words[i : i + shingle]), 42) for i in range(n)), dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * int(total[b]) > n)


def with_fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: list[str] | None = None, name: str = "fp") -> DataFrame:
    """carry's columns (the id by default) and the fingerprint as a signed long."""

    keep = carry or [id_col]
    source = unused([*keep, name], "__bytes")

    def run():
        return lambda texts: [np.fromiter((fingerprint(t or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)]

    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias(source))
    return appended(src, source, run, f"{name} bigint")


def orders(m: int, budget: int) -> list[tuple[list[int], int]]:
    """(bit positions from the first looked at to the last, leading bits that must agree) of every trie."""
    edges = [64 * i // m for i in range(m + 1)]
    cut = [list(range(edges[i], edges[i + 1])) for i in range(m)]
    out = []
    for lead in itertools.combinations(range(m), m - budget):
        head = [b for i in lead for b in cut[i]]
        out.append((head + [b for i in range(m) if i not in lead for b in cut[i]], len(head)))
    return out


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """fp's bits rearranged so that the order's first bit is the highest."""
    out = np.zeros_like(fp)
    at = 0
    while at < 64:  # runs of neighbouring bits move together
        run = 1
        while at + run < 64 and order[at + run] == order[at] + run:
            run += 1
        low = 63 - (order[at] + run - 1)
        part = (fp >> np.uint64(low)) & np.uint64((1 << run) - 1)
        out |= part << np.uint64(64 - at - run)
        at += run
    return out


def trie_links(keys: np.ndarray, groups: np.ndarray, lead: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link all keys of a group within the budget, as far as components need them.

    keys: uint64 in trie order, ascending within each group (equal leading bits); groups: ascending group numbers.
    A node is a range of neighbouring keys that agree on the first bits. Node pairs (a, b) carry the bits they differ in;
    both split at the next bit, and a child pair over the budget is pruned. Pairs of single keys are settled at once.
    """
    n = len(keys)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    parent = np.arange(n)

    def root(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while True:
            up = parent[r]
            if (up == r).all():
                return r
            r = up

    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def link(i: np.ndarray, j: np.ndarray) -> None:
        """Keeps only pairs that join two components."""
        while len(i):
            a, b = root(i), root(j)
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            _, at = np.unique(hi, return_index=True)  # one link a component and round
            parent[hi[at]] = lo[at]
            left.append(i[at])
            right.append(j[at])

    ones: dict[int, np.ndarray] = {}

    def halves(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        c = ones[depth]
        return hi - (c[hi] - c[lo])

    many = last - first > 1
    stack = [(lead, first[many], last[many], first[many], last[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            for at in range(0, len(alo), FRONTIER):
                s = slice(at, at + FRONTIER)
                stack.append((depth, alo[s], ahi[s], blo[s], bhi[s], err[s]))
            continue
        same = alo == blo
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if (settled := single & ~same).any():
            i, j = alo[settled], blo[settled]
            close = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            link(i[close], j[close])
        near = ~single & (err + (64 - depth) <= budget)  # whatever follows stays within the budget
        for lo, hi, lo2, hi2 in zip(alo[near], ahi[near], blo[near], bhi[near], strict=True):
            of = np.r_[lo:hi, lo2:hi2]
            link(np.full(len(of) - 1, of[0]), of[1:])
        go = ~single & ~near
        if not go.any():
            continue
        alo, ahi, blo, bhi, err, same = alo[go], ahi[go], blo[go], bhi[go], err[go], same[go]
        am, bm = halves(alo, ahi, depth), halves(blo, bhi, depth)
        kids = (
            (alo, am, blo, bm, err, np.ones(len(alo), bool)),
            (am, ahi, bm, bhi, err, np.ones(len(alo), bool)),
            (alo, am, bm, bhi, err + 1, np.ones(len(alo), bool)),
            (am, ahi, blo, bm, err + 1, ~same),
        )
        parts = []
        for x0, x1, y0, y1, e, ok in kids:
            ok = ok & (x1 > x0) & (y1 > y0) & (e <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok].astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate([p[k] for p in parts]) for k in range(5))))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


#: Bits of one cut of a big subtree.
CUT_BITS = 8


def _cut_big(rows: DataFrame, big: DataFrame, leads: list[int], budget: int, level: int) -> DataFrame:
    """rows with each fingerprint of a big cell in every pair of its sub-nodes (next CUT_BITS bits), within the budget, that has its own.

    A cell is a pair of nodes that agree or differ (side 0: one node with itself; sides 1 and 2) with the bits they differ in.
    """
    lead = F.element_at(F.array(*[F.lit(x + CUT_BITS * level) for x in leads]), F.col("t") + 1)
    rest = rows.join(big, ["t", "head", "cell"], "left_anti")
    node = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("p"), lead), F.lit(64 - CUT_BITS)).cast("int")
    cells = rows.join(big, ["t", "head", "cell"], "left_semi").withColumn("node", node)
    there = stored(cells.select("t", "head", "cell", "err", "side", "node").distinct(), "nodes")  # at most 2 ** CUT_BITS a cell and side
    x, y = there.alias("x"), there.alias("y")
    differ = F.bit_count(F.col("x.node").bitwiseXOR(F.col("y.node"))) + F.col("x.err")
    twins = (F.col("x.side") == 0) & (F.col("y.side") == 0) & (F.col("x.node") <= F.col("y.node"))
    across = (F.col("x.side") == 1) & (F.col("y.side") == 2)
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.head") == F.col("y.head")) & (F.col("x.cell") == F.col("y.cell")) & (twins | across) & (differ <= budget)
    name = F.xxhash64("x.cell", "x.node", "y.node").alias("to")
    both = x.join(y, on).select("x.t", "x.head", "x.cell", F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.side").alias("sa"), F.col("y.side").alias("sb"), differ.cast("int").alias("e"), name)
    one = F.struct(F.col("sa").alias("from"), F.col("a").alias("node"), F.when((F.col("sa") == 0) & (F.col("a") == F.col("b")), 0).otherwise(1).alias("as"))
    two = F.struct(F.col("sb").alias("from"), F.col("b").alias("node"), F.lit(2).alias("as"))
    ends = F.when((F.col("sa") == 0) & (F.col("a") == F.col("b")), F.array(one)).otherwise(F.array(one, two))
    goes = both.select("t", "head", "cell", "e", "to", F.explode(ends).alias("end")).select("t", "head", "cell", "e", "to", F.col("end.from").alias("side"), F.col("end.node").alias("node"), F.col("end.as").alias("as"))
    cut = cells.drop("err").join(goes, ["t", "head", "cell", "side", "node"]).select("t", "head", F.col("to").alias("cell"), F.col("e").alias("err"), F.col("as").alias("side"), "p", "fp")
    return rest.unionByName(cut)


def links(fps: DataFrame, budget: int = BUDGET, max_node: int = MAX_NODE, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) with a > b: links between the distinct fingerprints in fps.fp that span the components of all pairs within the budget."""
    plan = orders(blocks, budget)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for t, (order, lead) in enumerate(plan):
                p = permuted(fp, order)
                yield pd.DataFrame({"t": np.int32(t), "head": (p >> np.uint64(64 - lead)).view(np.int64), "p": p.view(np.int64), "fp": b["fp"]})

    leads = [x[1] for x in plan]
    dealt = stored(fps.select("fp").mapInPandas(deal, "t int, head bigint, p bigint, fp bigint"), "tries").select("t", "head", F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("err"), F.lit(0).alias("side"), "p", "fp")
    for level in range((64 - max(leads)) // CUT_BITS):
        big = stored(dealt.groupBy("t", "head", "cell").count().filter(F.col("count") > max_node).select("t", "head", "cell"), "big")
        if not (n_big := big.count()):
            break
        dealt = stored(_cut_big(dealt, F.broadcast(big) if n_big <= MAX_BROADCAST else big, leads, budget, level), "cells")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come sorted by subtree, so a subtree is finished when the next one begins."""
        open_, held = None, []
        for b in batches:
            if not len(b):
                continue
            key = b[["t", "head", "cell"]].to_numpy()
            last = tuple(key[-1])
            at = int(np.argmax((key == key[-1]).all(axis=1)))  # sorted: the open subtree is the tail
            if at or last != open_:
                held.append(b.iloc[:at])
                yield from solve(pd.concat(held, ignore_index=True))
                open_, held = last, []
            held.append(b.iloc[at:])
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    def solve(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for t, of in b.groupby("t", sort=False):
            keys = of["p"].to_numpy().view(np.uint64)
            head, cell = of["head"].to_numpy(), of["cell"].to_numpy()
            change = np.r_[False, (head[1:] != head[:-1]) | (cell[1:] != cell[:-1])]
            group = np.cumsum(change)
            at = np.lexsort((keys, group))
            i, j = trie_links(keys[at], group[at], leads[int(t)], budget)
            x, y = of["fp"].to_numpy()[at][i], of["fp"].to_numpy()[at][j]
            yield pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return dealt.drop("err", "side").repartition("t", "head", "cell").sortWithinPartitions("t", "head", "cell").mapInPandas(join, "a bigint, b bigint").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a > b) reaches."""
    e = stored(edges.select("a", "b"), "links")
    count = F.count(F.lit(1)).alias("n")
    while True:
        n = e.count()
        up = gathered(e.groupBy("a").agg(F.min("b").alias("m"), count), n)
        wide = hot_join(e, up, "a", "n", n).filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        flat = stored(gathered(gathered(up.select("a", F.col("m").alias("b")).unionByName(wide), n).distinct(), n), "links")
        n = flat.count()
        # every b is there with its count, whether it has a smaller neighbour or not: a root may have any number of children
        above = gathered(flat.groupBy("b").agg(count).join(flat.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), "b", "left"), n)
        jumped = gathered(hot_join(flat, above, "b", "n", n), n)
        e = stored(gathered(jumped.select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")).distinct(), n), "links")
        state = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("a"), F.max("moved").alias("moved")).first()
        e = gathered(e.select("a", "b").distinct(), n)
        if not state.moved and state.n == state.a:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(fingerprints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """fingerprints (doc_id, fp) -> one row per distinct fp: fp, root (smallest fp reachable), component_id (smallest doc_id reachable), n_docs."""
    fps = stored(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")), "fps")
    n = fps.count()
    found = roots(links(fps, budget, blocks=budget + 2))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_fps"))
    return hot_join(named, best, "root", "n_fps", n).select("fp", "root", "component_id", "n_docs")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    docs = stored(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle=shingle), "fingerprints")
    classes = stored(components(docs, budget), "classes")
    return hot_join(docs, classes.drop("root"), "fp", "n_docs", docs.count())


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
