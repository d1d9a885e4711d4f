"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing: pages go to one archive per task. Of records with equal payloads of at least MIN_REVISIT bytes, the one with the
largest id is a response and the others revisit it without a payload. Each task trains the archive's dictionary on its
first SAMPLE_BYTES of payload (a documented bound), puts it into a skippable frame and writes a frame per record. A
task's file has a name of its own; only files that a finished task reported are in the manifest, so a task that is lost
and run again leaves nothing to be read twice.

Reading: archives are read one after another in a task, frame by frame; the reader loads the dictionary from the leading
frame, decodes a record per frame, and validates version line, mandatory headers, Content-Length against the block,
WARC-Date and the SHA-1 payload digest (hex or base 32; names of fields in any case). Archives from elsewhere are read alike:
record ids are any URIs and come as text beside the page number, which only this writer's ids have; records of all types are rows;
a revisit may hold HTTP headers, and its length, where the record doesn't tell it, is that of the response it refers to (with_lengths). A revisit's
digest and length are held against that response. A bad archive raises ValueError naming the file and the offset.

Defined results: a null html is an empty payload; a null id is written without an id and read back as null; null urls
are read back as null; repeated rows are each written, and if they share the largest id each is a response; an empty
table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, hot_join, new_path, stored, whole

MIN_REVISIT = 1000
#: Magic number of the skippable frame with the dictionary, fixed by the format.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Payload bytes that a dictionary is trained on, and its size.
SAMPLE_BYTES, DICT_BYTES = 4 << 20, 32 << 10
LEVEL = 3
#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 512 << 20
#: Repeated digests (about 100 bytes each) that are broadcast.
MAX_BROADCAST = 500_000
#: Types of records, fixed by the format.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: Dates of records, fixed by the format.
_DATE = re.compile(r"[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?Z)?)?)?")
#: What this writer's record ids begin with.
PAGE = "urn:x-page:"
_MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
MANIFEST = "path string, records bigint, first_id bigint, last_id bigint, bytes bigint"


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, refers_to (null for responses).

    Up to max_broadcast repeated digests are broadcast and no payload moves; more are joined by one shuffle of the payloads
    of at least min_bytes.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    # only payloads that occur more than once matter; they are found on digests alone
    there = src.filter(F.col("payload_bytes") >= min_bytes)
    same = there.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = stored(same, "repeats")
    n = same.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    none = F.lit(None).cast("bigint")
    if not n.digests:
        return src.withColumn("refers_to", none)
    if n.digests <= max_broadcast:  # the payloads stay where they are
        same = same.select(F.col("digest").alias("of"), "refers_to")
        out = src.join(F.broadcast(same), (F.col("digest") == F.col("of")) & (F.col("payload_bytes") >= min_bytes), "left").drop("of")
    else:  # payloads under min_bytes never meet; a digest that isn't in same has one row
        out = hot_join(there, same, "digest", "n", n.rows, "left").unionByName(src.filter(F.col("payload_bytes") < min_bytes).withColumn("refers_to", none))
    return out.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), none).otherwise(F.col("refers_to")))


def dictionary(samples: list[bytes], size: int = DICT_BYTES):
    """A dictionary trained on samples; where they are too few or too alike to train on, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the digest and length of the payload it stands for, but no block."""
    name = f"{PAGE}{'' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.encode("unicode_escape").decode("ascii"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        block = b""
        head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """An archive being written: the dictionary's frame first, then a frame per record."""

    def __init__(self, stream, samples: list[bytes]):
        import zstandard

        d = dictionary(samples)
        data = d.as_bytes()
        stream.write(struct.pack("<II", DICT_MAGIC, len(data)) + data)
        self.stream, self.bytes = stream, 8 + len(data)
        self.to = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True, write_content_size=True)

    def write(self, rec: bytes) -> None:
        frame = self.to.compress(rec)
        self.stream.write(frame)
        self.bytes += len(frame)


def write(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of mark_revisits() rows in folder; returns the manifest of those written, itself stored there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        held: list[tuple] = []
        size, out, sink, w, n, first, last = 0, [], None, None, 0, None, None

        def rows() -> Iterator[tuple]:
            for b in batches:
                for p, u, y, d, r in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True):
                    yield None if p is None else int(p), u, y, d, None if r is None else int(r)

        def begin() -> None:
            nonlocal sink, w, n, first, last
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            sink, n, first, last = fs.open_output_stream(path, compression=None), 0, None, None
            w = Writer(sink, [h[2][:131072] for h in held if h[2]])
            out.append([f"{folder}/{path.rsplit('/', 1)[1]}"])

        def put(r: tuple) -> None:
            nonlocal n, first, last
            w.write(record(*r))
            n += 1
            if r[0] is not None:
                first, last = r[0] if first is None else min(first, r[0]), r[0] if last is None else max(last, r[0])

        def end() -> None:
            nonlocal sink, w
            sink.close()
            out[-1] += [n, first, last, w.bytes]
            sink = w = None

        for r in rows():
            size += len(r[2])
            if w is None:
                held.append(r)
                if size < SAMPLE_BYTES:
                    continue
                begin()
                for h in held:
                    put(h)
                held = []
            else:
                put(r)
            if size >= archive_bytes:
                end()
                size = 0
        if held:
            begin()
            for h in held:
                put(h)
        if w is not None:
            end()
        if out:
            path, n, first, last, size = zip(*out, strict=True)
            yield pd.DataFrame({"path": path, "records": n, "first_id": whole(first), "last_id": whole(last), "bytes": size})

    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  # ids keep all their digits beside nulls
    rows = pages.select(text("page_id"), "url", "payload", "digest", text("refers_to"))
    manifest = rows.mapInPandas(run, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame of an archive; at most one frame and one read buffer are in memory."""
    import zstandard

    head = stream.read(8)
    d, buf, at = None, head, 0
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        n = struct.unpack("<I", head[4:])[0]
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("the dictionary frame is cut short")
        if data[:4] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        d, buf, at = zstandard.ZstdCompressionDict(data, dict_type=kind), b"", 8 + n
    z = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    while True:
        if not buf:
            buf = stream.read(1 << 20)
            if not buf:
                return
        o, parts, used = z.decompressobj(), [], 0
        while not o.eof:
            if not buf:
                buf = stream.read(1 << 20)
                if not buf:
                    raise ValueError(f"the frame at {at} is cut short")
            try:
                parts.append(o.decompress(buf))
            except zstandard.ZstdError as e:
                raise ValueError(f"the frame at {at} can't be decoded: {e}") from None
            used += len(buf) - len(o.unused_data)
            buf = o.unused_data
        yield at, b"".join(parts)
        at += used


class Fields(dict):
    """Header fields by name, in any case; one that is missing is a ValueError."""

    def __getitem__(self, name: str) -> str:
        if (v := self.get(name.lower())) is None:
            raise ValueError(f"no {name}")
        return v

    def __contains__(self, name: str) -> bool:
        return super().__contains__(name.lower())


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Validated headers and block of one record."""
    head, sep, block = rec.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k or k != k.strip():
            raise ValueError(f"bad header line {line!r}")
        fields[k.lower()] = v.strip()
    if missing := [k for k in _MANDATORY if k.lower() not in fields]:
        raise ValueError(f"no {missing[0]}")
    if fields["warc-type"] not in TYPES:
        raise ValueError(f"no such record type: {fields['warc-type']}")
    fields = Fields(fields)
    if not (fields["Content-Length"].isascii() and fields["Content-Length"].isdigit()) or int(fields["Content-Length"]) + 4 != len(block) or block[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {fields['Content-Length']}, the block has {len(block) - 4} bytes")
    return fields, block[:-4]


def _page(uri: str | None) -> int | None:
    """The page number of this writer's ids; other records have none."""
    if uri is None or not uri.startswith(PAGE):
        return None
    tail = uri[len(PAGE) :]
    if tail and not re.fullmatch("-?[0-9]+", tail):
        raise ValueError(f"{uri} names no page")
    return int(tail) if tail else None


def sha1_hex(labelled: str) -> str:
    """The digest of a sha1: field as lower-case hex; it may stand there as hex or, as is common, in base 32."""
    kind, _, value = labelled.partition(":")
    if kind.lower() != "sha1":
        raise ValueError(f"no SHA-1 digest: {labelled}")
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    if re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    raise ValueError(f"no SHA-1 digest: {labelled}")


def decode(rec: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, digest, record_type, refers_to, record_id, refers_to_id, date) of one record, all checked but a revisit's claims.

    payload_bytes of a revisit is null where the record doesn't tell it.
    """
    f, block = parse(rec)
    if not _DATE.fullmatch(f["WARC-Date"]):
        raise ValueError(f"WARC-Date is {f['WARC-Date']}")
    url = f["WARC-Target-URI"].strip("<>").encode("ascii").decode("unicode_escape") if "WARC-Target-URI" in f else None
    name = lambda k: f[k].strip("<>") if k in f else None
    own, kind = name("WARC-Record-ID"), f["WARC-Type"]
    if kind == "revisit":
        size = f["X-Payload-Length"] if "X-Payload-Length" in f else None
        if size is not None and not re.fullmatch("[0-9]+", size):
            raise ValueError(f"X-Payload-Length is {size}")
        by_digest = "WARC-Payload-Digest" in f or "identical-payload-digest" in f["WARC-Profile"]
        digest = sha1_hex(f["WARC-Payload-Digest"]) if by_digest else None
        ref = name("WARC-Refers-To")
        return _page(own), url, None, None if size is None else int(size), digest, kind, _page(ref), own, ref, f["WARC-Date"]
    payload = block
    if kind == "response" and f.get("content-type", "application/http").startswith("application/http"):
        _, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("no HTTP header")
    digest = hashlib.sha1(payload).hexdigest()
    if own.startswith(PAGE) and "WARC-Payload-Digest" not in f or "WARC-Payload-Digest" in f and digest != sha1_hex(f["WARC-Payload-Digest"]):
        raise ValueError("the payload doesn't have its digest")
    return _page(own), url, payload, len(payload), digest, kind, None, own, None, f["WARC-Date"]


def _ids(records: DataFrame) -> tuple[str, str]:
    return ("record_id", "refers_to_id") if "record_id" in records.columns else ("page_id", "refers_to")


def verify_revisits(records: DataFrame) -> None:
    """Raises ValueError where a revisit's digest and length aren't those of a response with the id it refers to.

    Payloads aren't needed. A response that any number of others revisit counts once before anything is shuffled. A length or
    digest that a revisit doesn't tell isn't held against anything, nor is one that refers to no record.
    """
    own, ref = _ids(records)
    claims = records.filter((F.col("record_type") == "revisit") & F.col(ref).isNotNull()).select(F.col(ref).alias("id"), "payload_digest", "payload_bytes").distinct()
    has = records.filter("record_type = 'response'").select(F.col(own).alias("of"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).distinct()
    same = (F.col("id") == F.col("of")) & F.coalesce(F.col("payload_digest") == F.col("d"), F.lit(True)) & F.coalesce(F.col("payload_bytes") == F.col("n"), F.lit(True))
    if wrong := claims.join(has.hint("merge"), same, "left_anti").take(1):
        raise ValueError(f"a revisit of {wrong[0].id} has another payload than that response")


def with_lengths(records: DataFrame) -> DataFrame:
    """records with the length and digest that a revisit doesn't tell itself taken from the response it refers to."""
    own, ref = _ids(records)
    size = records.filter("record_type = 'response'").groupBy(F.col(own).alias("_id")).agg(F.max("payload_bytes").alias("_n"), F.max("payload_digest").alias("_d"))
    wanted = (F.col("record_type") == "revisit") & (F.col("payload_bytes").isNull() | F.col("payload_digest").isNull()) & F.col(ref).isNotNull()
    asked = records.filter(wanted).groupBy(F.col(ref).alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
    known = stored(asked.join(size, "_id", "left"), "lengths")
    total = known.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first().n
    filled = hot_join(records.filter(wanted).withColumn("_id", F.col(ref)), known, "_id", "_rows", total, "left")
    filled = filled.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_n"), "payload_digest": F.coalesce("payload_digest", "_d")}).select(*records.columns)
    return filled.unionByName(records.filter(~F.coalesce(wanted, F.lit(False))))


def read(spark: SparkSession, manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives. The manifest has a row per archive; each archive is read by one task.

    verify_revisits() holds the revisits among them against their responses.
    """
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "date"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: whole(c) if n in ("page_id", "refers_to", "payload_bytes") else c for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                fs, at = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as s:
                    for offset, rec in frames(s):
                        try:
                            r = decode(rec)
                        except ValueError as e:
                            raise ValueError(f"{path} at {offset}: {e}") from None
                        rows.append(r if payloads else (*r[:2], None, *r[3:]))
                        size += len(rec) if payloads else 200
                        if size > 4 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInPandas(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, refers_to_id string, date string")


def op2(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    manifest = write(mark_revisits(pages), new_path(spark, "warc"))
    records = stored(read(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    verify_revisits(records)
    return records


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
r AS (SELECT s, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM d LEFT JOIN r ON d.s = r.s AND d.n >= 1000
"""
