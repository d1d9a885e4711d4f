"""Content-addressed store of token ids: chunks cut by a rolling hash, stored once, with recipes and Merkle manifests.

A document's ids are cut where a rolling hash over the last CUT_WINDOW ids meets a mask (MIN_CHUNK to MAX_CHUNK ids, about
AVG_CHUNK), so equal passages give equal chunks wherever they stand. A chunk's address is the BLAKE2b digest of its ids;
it is stored once, by the first document (in doc_id order) that has it, in the pack of that document's partition. Packs
follow doc_id order, so a document's own chunks lie one after another, and only passages that an earlier document owns
are fetched elsewhere, by ranged reads. A recipe lists the document's chunks; its Merkle root is checked against the chunks
that come back. A document's place, id, start, length and root are a leaf of its partition's Merkle tree, the partitions'
roots are the leaves of the store's; the manifest holds them, and reading checks them.

Layout of a store folder: encoded/ (compressed ids and cuts, in input order), owners/ (who stores which chunk), recipes/ (Parquet, in
ascending doc_id order), packs/*.pack (little-endian unsigned ids, 16 bits where the vocabulary allows it; a Zstandard frame a chunk), manifest/.
Only packs that the committed recipes name belong to the store; a lost task's pack is never read.

Shuffles: the ids once, by ranges of doc_id; digests (16 bytes a chunk) twice. Hot chunks meet as partial minima.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows with equal doc_ids are separate
documents, ordered by content; an empty table is an empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import appended, filesystem, hot_join, new_path, stored, whole
from .tokens import encoder

CUT_WINDOW, MIN_CHUNK, AVG_CHUNK, MAX_CHUNK = 16, 128, 512, 2048
#: Ids that are cut at once.
CUT_BATCH = 1 << 17
#: Children of a node in the manifest's tree.
FANOUT = 256
#: A pack is closed after so many bytes.
PACK_BYTES = 64 << 20
#: Bytes of other packs' chunks that a reading task remembers.
CACHE_BYTES = 32 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_RECIPE = "part int, seq bigint, doc_id bigint, local_start bigint, n_tokens bigint, root binary, packs array<string>, offsets array<bigint>, sizes array<bigint>, digests array<binary>"


def rolling(ids: np.ndarray, window: int = CUT_WINDOW) -> np.ndarray:
    """Polynomial hash modulo 2^64 of each window (a power of two) of ids, of ids[i - window + 1 .. i] at i, by doubling; shorter ones at the start."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MULT
    h ^= h >> np.uint64(29)
    weight, have = np.uint64(0x100000001B3), 1
    with np.errstate(over="ignore"):
        while have < window:
            h[have:] = h[have:] + h[:-have] * weight
            weight, have = weight * weight, 2 * have
    return h


def cut_all(texts: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each text. Texts are hashed in a row: no chunk is as short as the window, so what stands before a text doesn't tell."""
    h = rolling(np.concatenate(texts)) if texts else np.zeros(0, np.uint64)
    marks = np.flatnonzero((h >> np.uint64(40)) % np.uint64(AVG_CHUNK - MIN_CHUNK) == 0) + 1
    out, first = [], 0
    for ids in texts:
        n = len(ids)
        of = (marks[np.searchsorted(marks, first + MIN_CHUNK) : np.searchsorted(marks, first + n, "right")] - first).tolist()
        ends, at, k = [], 0, 0
        while at < n:
            while k < len(of) and of[k] < at + MIN_CHUNK:
                k += 1
            at = min(of[k] if k < len(of) else n, at + MAX_CHUNK, n)
            ends.append(at)
        out.append(ends)
        first += n
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    return cut_all([ids])[0]


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; an odd last node moves up as it is."""
    level = [address(b"\x00" + x) for x in leaves] or [address(b"")]
    while len(level) > 1:
        level = [address(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encode(docs: DataFrame, path: str, *, end: int = 1, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = True, wide: bool = False) -> DataFrame:
    """doc_id, tie (content hash), n_tokens, ids (16 or 32 bits each, a Zstandard frame), cuts (chunk ends, in ids), digests."""
    kind = "<u4" if wide else "<u2"

    def run():
        import zstandard

        enc, squeeze, tail = encoder(path, drops_space), zstandard.ZstdCompressor(level=3), end.to_bytes(4, "little")

        def put(held: list[tuple[bytes, np.ndarray]]) -> Iterator[tuple]:
            for (t, ids), cuts in zip(held, cut_all([ids for _, ids in held]), strict=True):
                data, start, digests = ids.astype(kind), 0, []
                if not wide and not np.array_equal(data, ids):
                    raise ValueError("ids over 65535 need wide=True")
                raw = data.tobytes()
                for c in cuts:
                    digests.append(address(raw[start * data.itemsize : c * data.itemsize]))
                    start = c
                yield int.from_bytes(address(t)[:8], "little", signed=True), len(ids), squeeze.compress(raw), cuts, digests

        def make(texts: list) -> list:
            rows, held, size = [], [], 0
            for t in texts:
                held.append((t or b"", np.frombuffer(enc.encode(t or b"") + tail, dtype="<u4")))
                size += len(held[-1][1])
                if size >= CUT_BATCH:
                    rows += put(held)
                    held, size = [], 0
            rows += put(held)
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return make

    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return appended(src, "text", run, "tie bigint, n_tokens bigint, ids binary, cuts array<int>, digests array<binary>")


def _owners(encoded: DataFrame) -> DataFrame:
    """(doc_id, tie, owned): the chunks that each document stores, as places in its recipe; documents without any are left out."""
    chunk = encoded.select("doc_id", "tie", F.posexplode("digests").alias("at", "digest"))
    first = chunk.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie", "at")).alias("o"))
    return first.groupBy("o.doc_id", "o.tie").agg(F.collect_list("o.at").alias("owned"))


def write(docs: DataFrame, folder: str, path: str, *, end: int = 1, wide: bool = False, **columns: str) -> DataFrame:
    """Stores docs' ids in folder; returns the recipes, which are in ascending doc_id order."""
    spark = docs.sparkSession
    width = 4 if wide else 2
    encode(docs, path, end=end, wide=wide, **columns).write.parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    _owners(encoded.select("doc_id", "tie", "digests")).write.parquet(f"{folder}/owners")
    owned = spark.read.parquet(f"{folder}/owners")
    # a document and the list of what it owns meet in one range shuffle, the list first
    none = lambda c: F.lit(None).cast(encoded.schema[c].dataType).alias(c)
    lists = owned.select("doc_id", "tie", F.lit(0).alias("what"), "owned", *[none(c) for c in ("n_tokens", "ids", "cuts", "digests")])
    texts = encoded.select("doc_id", "tie", F.lit(1).alias("what"), F.lit(None).cast("array<int>").alias("owned"), "n_tokens", "ids", "cuts", "digests")
    dealt = lists.unionByName(texts).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "what")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # keeps all digits beside nulls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        unsqueeze, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        fs, base = filesystem(f"{folder}/packs")
        fs.create_dir(base, recursive=True)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        sink, name, size = None, None, 0
        mine: tuple = (None, None, frozenset())
        for b in batches:
            out = []
            for doc_id, tie, what, own, n, ids, cuts, digests in b.itertuples(index=False):
                doc_id = None if doc_id is None else int(doc_id)
                if what == 0:
                    mine = (doc_id, tie, frozenset(int(x) for x in own))
                    continue
                owned = mine[2] if mine[:2] == (doc_id, tie) else frozenset()
                mine = (None, None, frozenset())  # of equal documents, the first stores
                ids = unsqueeze.decompress(ids)
                packs, offsets, sizes, at = [], [], [], 0
                for k, c in enumerate(cuts):
                    data = ids[at * width : int(c) * width]
                    at = int(c)
                    if k not in owned:
                        packs.append(None)
                        offsets.append(-1)
                        sizes.append(-1)
                        continue
                    data = squeeze.compress(data)
                    sizes.append(len(data))
                    if sink is None or size >= PACK_BYTES:
                        if sink is not None:
                            sink.close()
                        name, size = f"{part:06d}-{uuid.uuid4().hex}.pack", 0
                        sink = fs.open_output_stream(f"{base}/{name}")
                    sink.write(data)
                    packs.append(name)
                    offsets.append(size)
                    size += len(data)
                leaves = [bytes(d) for d in digests]
                out.append((part, seq, doc_id, start, int(n), merkle(leaves), packs, offsets, sizes, leaves))
                seq += 1
                start += int(n)
            made = pd.DataFrame(out, columns=[c.split()[0] for c in _RECIPE.split(", ")]).astype({"part": "int32"})
            yield made.assign(doc_id=whole([r[2] for r in out]))
        if sink is not None:
            sink.close()

    dealt.mapInPandas(run, _RECIPE).write.parquet(f"{folder}/recipes")
    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    manifest(recipes).write.parquet(f"{folder}/manifest")
    return recipes


def _folded(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, digest): the root of each tree over nodes (by, at, digest), at from 0 to most; a level at a time, FANOUT children a node."""
    while True:
        children = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        nodes = nodes.groupBy(*by, F.floor(F.col("at") / FANOUT).alias("up")).agg(F.sha2(F.array_join(children, "|"), 256).alias("digest")).withColumnRenamed("up", "at")
        most //= FANOUT
        if not most:
            return nodes.drop("at")


def manifest(recipes: DataFrame) -> DataFrame:
    """A row per partition: documents, ids, ids in all partitions before it, its Merkle root, and the root over all partitions.

    A leaf holds a document's place, id, start, length and own root. A level of a tree is one grouped SHA-256 of at most
    FANOUT children, so no partition is collected.
    """
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    leaf = F.sha2(F.concat_ws("|", *[field(c) for c in ("part", "seq", "doc_id", "local_start", "n_tokens")], F.hex("root")), 256)
    most = recipes.agg(F.max("seq").alias("seq"), F.max("part").alias("part")).first()
    roots = stored(_folded(recipes.select("part", F.col("seq").alias("at"), leaf.alias("digest")), ["part"], most.seq or 0).withColumnRenamed("digest", "root"), "roots")
    parts = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).join(roots, "part")
    top = _folded(roots.select(F.lit(0).alias("of"), F.col("part").alias("at"), F.col("root").alias("digest")), ["of"], most.part or 0)
    store = top.first()  # one digest
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumns({"before": before, "store": F.lit(store.digest if store else None).cast("string")})


def _located(recipes: DataFrame) -> DataFrame:
    """(part, seq, at, pack, offset, size) of the chunks that another document stores."""
    one = recipes.select("part", "seq", F.posexplode(F.arrays_zip("digests", "packs", "offsets", "sizes")).alias("at", "c")).select("part", "seq", "at", "c.digests", "c.packs", "c.offsets", "c.sizes")
    away = one.filter("packs IS NULL").select("part", "seq", "at", F.col("digests").alias("digest"))
    wanted = stored(away.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "wanted")
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    here = one.filter("packs IS NOT NULL").select(F.col("digests").alias("digest"), F.col("packs").alias("pack"), F.col("offsets").alias("offset"), F.col("sizes").alias("size"))
    return hot_join(away, stored(here.join(wanted, "digest"), "index"), "digest", "n", total).drop("digest")


def read(spark: SparkSession, folder: str, *, wide: bool = False, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids (little-endian u32) of every document, rebuilt from packs and verified.

    Raises ValueError where a chunk doesn't have its address, a document its root, or a partition its manifest's root.
    """
    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    told = spark.read.parquet(f"{folder}/manifest")
    now = stored(manifest(recipes), "manifest")
    if not told.exceptAll(now).isEmpty() or not now.exceptAll(told).isEmpty():
        raise ValueError(f"the recipes in {folder} don't have their manifest's roots")
    away = _located(recipes)
    lists = away.groupBy("part", "seq").agg(F.sort_array(F.collect_list(F.struct("at", "pack", "offset", "size"))).alias("away"))
    none = lambda c: F.lit(None).cast(recipes.schema[c].dataType).alias(c)
    names = [f.name for f in recipes.schema.fields if f.name not in ("part", "seq")]
    first = lists.select("part", "seq", F.lit(0).alias("what"), "away", *[none(c) for c in names])
    then = recipes.select("part", "seq", F.lit(1).alias("what"), F.lit(None).cast(lists.schema["away"].dataType).alias("away"), *names)
    dealt = first.unionByName(then).repartitionByRange("part", "seq").sortWithinPartitions("part", "seq", "what").withColumn("doc_id", F.col("doc_id").cast("string"))
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unsqueeze = zstandard.ZstdDecompressor()
        fs, base = filesystem(f"{folder}/packs")
        files: OrderedDict = OrderedDict()
        cache: OrderedDict[tuple[str, int, int], bytes] = OrderedDict()
        held = 0
        away_of: dict[int, tuple[str, int, int]] = {}

        def fetch(pack: str, offset: int, size: int) -> bytes:
            f = files.get(pack)
            if f is None:
                if len(files) >= 16:
                    files.popitem(last=False)[1].close()
                f = files[pack] = fs.open_input_file(f"{base}/{pack}")
            else:
                files.move_to_end(pack)
            try:
                return unsqueeze.decompress(f.read_at(size, offset))
            except zstandard.ZstdError as e:
                raise ValueError(f"the chunk at {offset} of {pack} can't be decoded, so it doesn't have its address: {e}") from None

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.what == 0:
                    away_of = {int(x["at"]): (x["pack"], int(x["offset"]), int(x["size"])) for x in r.away}
                    continue
                parts = []
                for k, (pack, offset, size, digest) in enumerate(zip(r.packs, r.offsets, r.sizes, r.digests, strict=True)):
                    if pack is not None:
                        data = fetch(pack, int(offset), int(size))
                    elif (data := cache.get(away_of[k])) is None:
                        data = cache[away_of[k]] = fetch(*away_of[k])
                        held += len(data)
                        while held > CACHE_BYTES:
                            held -= len(cache.popitem(last=False)[1])
                    if address(data) != bytes(digest):
                        raise ValueError(f"chunk {k} of document {r.doc_id} doesn't have its address")
                    parts.append(data)
                away_of = {}
                if merkle([address(p) for p in parts]) != bytes(r.root):
                    raise ValueError(f"document {r.doc_id} doesn't have its root")
                ids = np.frombuffer(b"".join(parts), dtype=kind).astype("<u4").tobytes()
                if len(ids) != 4 * r.n_tokens:
                    raise ValueError(f"document {r.doc_id} doesn't have its length")
                row = (r.part, None if r.doc_id is None else int(r.doc_id), int(r.local_start), int(r.n_tokens), zlib.crc32(ids))
                out.append((*row, ids) if with_ids else row)
            names = ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
            yield pd.DataFrame(out, columns=names).astype({"part": "int32"}).assign(doc_id=whole([r[1] for r in out]))

    schema = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    docs = dealt.mapInPandas(run, schema)
    docs = docs.join(F.broadcast(told.select("part", "before")), "part")  # a row per partition of the store
    return docs.withColumn("start", F.col("before") + F.col("local_start")).drop("part", "before", "local_start")


def op4(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write(docs, folder, path)
    return read(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
