"""WARC archives, compressed record by record with a dictionary of their own.

A dictionary is built from a bounded sample of records (about SAMPLE) and embedded in every archive as its first frame, a
skippable one (magic 0x184D2A5D, as the WARC-Zstandard specification has it), so that each archive can be read alone.
Every record is a frame of its own, so that a reader may begin at any record.

Of records with equal payloads the one with the smallest page_id is a response, the others are revisits that refer to it
and hold no payload; payloads under ``least_bytes`` are always responses.  Digests that hold many records are joined
by broadcast (at most HEAVY of them), the rest by an equi-join.

Tasks write archives under names of their own to the shared folder and return those names; only names of tasks that
Spark committed are in the manifest, so attempts that were lost or repeated leave no record behind.

Defined cases: a null html is an empty payload; a null url writes no target header; a null page_id never is the smallest
one, so its record is a revisit if its payload has an owner, else a response; rows that repeat a page_id and its payload are
of one type; equal page_ids with different payloads are separate records; no row gives no archive and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, new_path, slices, stored, table, texts_of

#: Records the dictionary is built from (twice as many at most) and the largest of them, in bytes; bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 400, 32 << 10, 64 << 10
#: Compressed bytes after which a task begins its next archive; digests joined by broadcast at most.
ARCHIVE_BYTES, HEAVY = 32 << 20, 1000
LEVEL, MAGIC = 3, 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of a column's SHA-1: four times ten hexadecimal digits are eight of base 32."""
    part = lambda k: F.lpad(F.conv(F.substring(F.sha1(payload), 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to); html is null in revisits."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1 and owner is not null"), "warc-owners")
    heavy = F.col("n") * HEAVY > pages.count()  # fewer than HEAVY digests can be
    many = groups.where(heavy).select("payload_digest", F.col("owner").alias("owner_many"))
    few = groups.where(~heavy).select(F.col("payload_digest").alias("key"), F.col("owner").alias("owner_few"))
    out = rows.join(F.broadcast(many), "payload_digest", "left")
    # records of heavy digests know their owner now: they travel without a copied html and under keys of their own
    known, own = F.col("owner_many").isNotNull(), F.col("page_id").eqNullSafe(F.col("owner_many"))
    out = out.withColumn("html", F.when(~known | own, F.col("html"))).withColumn("key", F.when(known, F.xxhash64("page_id", "url").cast("string")).otherwise(F.col("payload_digest")))
    owner = F.coalesce("owner_many", "owner_few")
    refers = F.when((F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(owner), owner)
    out = out.join(few, "key", "left").withColumn("refers_to", refers)
    return out.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to",
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:x-page:{page_id}>"


def quoted(url: str) -> str:
    """Spaces and control characters would end a header line; they are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id, url, html: bytes, payload_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC record around an HTTP response; a revisit has the headers of the full payload alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block += html if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [] if url is None else [f"WARC-Target-URI: {quoted(url)}"]
    head += [] if refers_to is None else [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parsed(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload or None); raises where a digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    h = headers(head)
    size = int(h["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    number = lambda x: int(x[12:-1]) if x and x.startswith("<urn:x-page:") else None
    digest, full = h["warc-payload-digest"].removeprefix("sha1:"), int(headers(http)["content-length"])
    if h["warc-type"] == "response" and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {h['warc-record-id']} does not have its digest")
    return number(h["warc-record-id"]), h.get("warc-target-uri"), full, digest, h["warc-type"], number(h.get("warc-refers-to")), payload if h["warc-type"] == "response" else None


def dictionary(pages: DataFrame) -> bytes:
    """Trained on about SAMPLE records of at most SAMPLE_BYTES, a share of the pages chosen by hash; empty where there are too few to train on."""
    share = max(1, pages.count() // SAMPLE)
    chosen = F.pmod(F.xxhash64("page_id", "html"), F.lit(share)) == 0
    rows = pages.select("page_id", "url", "html").where(F.octet_length("html").between(1, SAMPLE_BYTES) & chosen).limit(2 * SAMPLE).collect()
    texts = {r["html"].encode(): r for r in rows}
    samples = [record(r["page_id"], r["url"], x, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), None) for x, r in texts.items()]
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def write_archives(typed: DataFrame, path: str, known: bytes) -> DataFrame:
    """Write ``typed`` below ``path``; the manifest (name, records, bytes) of the committed archives, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(known) if known else None)
        out = None

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["name", "records", "bytes"])

        for whole in batches:
            for part in slices(whole, "html"):
                rows = part.drop_columns(["html", "record_type"]).to_pylist()
                for r, html in zip(rows, texts_of(part.column("html")), strict=True):
                    if out is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)  # by default its name would choose one
                        if known:
                            size += out.write(struct.pack("<II", MAGIC, len(known)) + known)
                    size += out.write(zstd.compress(record(r["page_id"], r["url"], html, r["payload_bytes"], r["payload_digest"], r["refers_to"])))
                    n += 1
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    return stored(typed.mapInArrow(run, "name string, records long, bytes long"), "warc-manifest")


def frames(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, its dictionary taken from its leading skippable frame; one record is held at a time."""
    held, known = stream.read(8), None
    if len(held) == 8 and struct.unpack("<II", held)[0] == MAGIC:
        known = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", held)[1]))
        held = b""
    zstd, frame, got = zstandard.ZstdDecompressor(dict_data=known), None, []
    while held := held or stream.read(size):
        frame = frame or zstd.decompressobj()
        got.append(frame.decompress(held))
        held = b""
        if frame.eof:
            yield b"".join(got)
            held, frame, got = frame.unused_data, None, []
    if frame is not None:
        raise ValueError("an archive ends within a record")


def read_archives(manifest: DataFrame, path: str, *, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in ``manifest`` (RECORD, and payload on request)."""
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if " long" in x else pa.binary() if " binary" in x else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in frames(stream):
                        rows.append(parsed(raw)[: len(names)])
                        held += 500 + (len(raw) if with_payload else 0)
                        if held >= SLICE_BYTES:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    n = max(1, min(4096, manifest.count()))
    return manifest.select("name").repartition(n, "name").mapInArrow(run, schema)


def archived(pages: DataFrame, path: str | None = None, *, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write ``pages`` as archives; (manifest, folder)."""
    path = path or new_path(pages.sparkSession, "warc")
    typed = with_types(pages, least_bytes=least_bytes)
    return write_archives(typed, path, dictionary(pages)), path


def query(spark, sf_dir: str) -> DataFrame:
    manifest, path = archived(table(spark, sf_dir, "pages"))
    return read_archives(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), owned AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS owner FROM payloads
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(32), lambda k:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[10 * (k // 8) + 1 : 10 * (k // 8) + 10])::BIGINT >> (35 - 5 * (k % 8))) & 31)]), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
"""
