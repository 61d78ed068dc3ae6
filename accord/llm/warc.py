"""WARC archives with revisit records for repeated payloads.

Headers (an id, a digest, a length) are shuffled by payload digest; among equal payloads of at least `least` bytes, the
record with the largest id stays a response and the others become revisits that refer to it. Payloads move once, by id, to
be written into gzip-per-record archives with fresh headers; a revisit record carries none. The records of archives that
hold revisits already are resolved the same way: a revisit belongs to the response of its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accord.llm.common import lean, new_path, partitions, pieces, released, table, written
from accord.llm.packed_ids import opened

#: Payloads below so many bytes are always stored in full.
LEAST = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def digest_text(sha1: bytes) -> str:
    """`sha1:` and base 32, as WARC headers name digests."""
    return "sha1:" + base64.b32encode(sha1).decode()


def record(kind: str, page_id: int | None, url: str | None, sha1: bytes, length: int, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with one record. Line breaks in a URL, which would break the header, are percent-encoded; a null URL has no header."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: {digest_text(sha1)}", f"WARC-Payload-Length: {length}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, payload) of every record of an archive with one gzip member a record."""
    held, unpacker, parts = b"", None, []
    while True:
        if not held:
            held = stream.read(chunk)
            if not held:
                break
        if unpacker is None:
            unpacker, parts = zlib.decompressobj(31), []
        parts.append(unpacker.decompress(held))
        if unpacker.eof:
            held, unpacker = unpacker.unused_data, None
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            yield headers, rest[: int(headers["content-length"])]
        else:
            held = b""
    if unpacker is not None:
        raise ValueError("an archive that breaks off")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def as_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, sha1 (hex), bytes, stored of pages (page_id, url, html) or of records that read_archives() gave.

    A page's payload is its html in UTF-8, empty if null. An earlier revisit record has no payload, only its header's digest
    and length, and isn't stored.
    """
    page, url = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    if "record_type" in pages.columns:
        return pages.select(page, url, "payload", F.col("payload_digest").alias("sha1"), F.col("payload_bytes").alias("bytes"), (F.col("record_type") == "response").alias("stored"))
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(page, url, payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"), F.lit(True).alias("stored"))


def resolved(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, sha1, refers_to (the largest page_id that stores the same payload) of the records that revisit another.

    Only headers (page_id, sha1, bytes, stored) are shuffled, by digest. A record with a null page_id can't be referred to
    and doesn't revisit. Digests are pre-aggregated before they meet, and the originals come back by a join that adaptive
    execution splits where one digest has many records.
    """
    known = heads.filter(F.col("page_id").isNotNull() & ((F.col("bytes") >= least) | ~F.col("stored"))).select("page_id", "sha1", "bytes", "stored")
    originals = known.groupBy("sha1", "bytes").agg(F.max(F.when(F.col("stored"), F.col("page_id"))).alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return known.join(originals, ["sha1", "bytes"]).filter("page_id <> refers_to or not stored").select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write every page or record as a response or a revisit with fresh headers; the files written, and their records.

    Takes pages or records as as_records() does. Earlier revisit records are joined to the response of their digest; one
    without any is an error, as its payload is nowhere. Records that repeat a page_id and a payload are all kept, of one
    type. A null url is an absent header. Other columns play no part.
    """
    lean(pages.sparkSession)
    rows = as_records(pages)
    dealt = rows.join(resolved(rows, least), ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "bytes", "stored", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        name, stream, n = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for piece in pieces(batch):
                for page_id, url, payload, sha1, length, stored, refers_to in zip(*(c.to_pylist() for c in piece.columns)):
                    if stream is None:
                        fs, path = opened(name)
                        fs.create_dir(path.rsplit("/", 1)[0])
                        stream = fs.open_output_stream(path, compression=None)
                    if refers_to is None and not stored:
                        raise ValueError(f"record {page_id} revisits a payload that no response has")
                    kind = "response" if refers_to is None else "revisit"
                    stream.write(record(kind, page_id, url, bytes.fromhex(sha1), length, payload if kind == "response" else b"", refers_to))
                    n += 1
        if stream is not None:
            stream.close()
            yield pa.record_batch({"file": pa.array([name]), "n_records": pa.array([n], pa.int64())})

    return written(dealt.mapInArrow(released(run), "file string, n_records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every record of the files in column `file`.

    Length and digest are those of the full payload; a response whose payload doesn't have the digest of its header is an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = opened(name)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, payload in records(stream):
                        sha1 = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                        response = head["warc-type"] == "response"
                        if response and hashlib.sha1(payload).digest() != sha1:
                            raise ValueError(f"a payload in {name} doesn't match its digest")
                        rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), int(head["warc-payload-length"]), sha1.hex(), head["warc-type"], _page(head.get("warc-refers-to")), payload if response else None))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield _read(rows)
                            rows, held = [], 0
                if rows:
                    yield _read(rows)

    return files.select("file").repartition(max(1, partitions(files.sparkSession)), "file").mapInArrow(released(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _read(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of `pages`, read back from the archives.

    A null html is an empty payload, a null url an empty one. Payloads are written whole. Of equal payloads the largest page_id
    responds; rows that repeat it with the same payload all respond. An empty table gives no archive and an empty table; other
    columns play no part.
    """
    files = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(files).drop("payload", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), q AS (
  SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d, n) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
