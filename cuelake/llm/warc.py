"""WARC archives: one gzip member per record, written from pages and read back in sequence.

Of records with equal payloads of at least MIN_SHARED bytes the one with the largest page_id is a response, the others
revisit it; smaller payloads are all responses. Where several rows share that largest page_id, all of them are responses.
Payloads are compared by SHA-1 and length. Pages are joined with the shared payloads' table by digest, an equi-join whose
large keys Spark can split; revisits carry no payload.

An archive is a row (archive, content) of a table in the shared folder, about ARCHIVE_BYTES long; export() writes files.
The reader inflates one member at a time, in blocks of BLOCK bytes, frames the payload by Content-Length, and checks the
digest of every response. Null html is an empty payload; null urls are written as "about:blank"; null page_ids are kept and never
referred to; repeated rows are repeated records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import common

MIN_SHARED, ARCHIVE_BYTES, BLOCK = 1000, 8 << 20, 1 << 16
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: int | None) -> bytes:
    """One gzip member. A revisit tells the length of the payload that it stands for in a field of its own."""
    target = "".join(c for c in url or "about:blank" if c not in "\r\n")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{target}:{digest}')}>", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {n}"]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + pack.flush()


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, payload) of each record; ValueError where framing or a digest is wrong."""
    at = 0
    while at < len(content):
        inflate, head, body, fields, need = zlib.decompressobj(31), b"", [], None, 0
        have = 0
        while not inflate.eof:
            block = content[at : at + BLOCK]
            if not block:
                raise ValueError("the archive ends within a record")
            got = inflate.decompress(block)
            at += len(block) - len(inflate.unused_data)
            if fields is None:
                head += got
                stop = head.find(b"\r\n\r\n")
                if stop < 0:
                    continue
                first, *rest = head[:stop].decode().split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError("a record doesn't begin with its version")
                fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in rest)
                need = int(fields["Content-Length"])
                got = head[stop + 4 :]
            body.append(got)
            have += len(got)
        whole = b"".join(body)
        if fields is None or have != need + 4 or whole[need:] != b"\r\n\r\n":
            raise ValueError("a record's length isn't what it says")
        payload = whole[:need]
        if fields["WARC-Type"] == "response" and f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
            raise ValueError("a payload doesn't have its digest")
        yield fields, payload


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content binary): archives, kept in the shared folder."""
    raw = F.coalesce(pages["html"], F.lit(""))
    keyed = pages.select("page_id", "url", raw.alias("html"), F.sha1(raw.cast("binary")).alias("digest"), F.octet_length(raw).cast("long").alias("n"))
    shared = keyed.filter(F.col("n") >= MIN_SHARED).groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("times")).filter("times > 1 and kept is not null")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept"))
    told = keyed.join(shared.select("digest", "n", "kept"), ["digest", "n"], "left").select("page_id", "url", F.when(refers.isNull(), F.col("html")).otherwise("").alias("html"), "digest", "n", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                for page, url, html, digest, n, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, common.BATCH_ROWS).columns), strict=True):
                    parts.append(record(page, url, html.encode("utf-8", "surrogatepass"), digest, n, refers_to))
                    size += len(parts[-1])
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    return common.kept_table(told.mapInArrow(run, "content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url): a row for each record."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, payload in read_records(content.as_py()):
                    answers = f["WARC-Type"] == "response"
                    rows.append((number(f["X-Page-Id"]), len(payload) if answers else int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], number(f.get("X-Refers-To-Page")), f["WARC-Target-URI"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return archives.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def export(archives: DataFrame, folder: str) -> list[str]:
    """The archives as .warc.gz files in a folder of this machine."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    for i, row in enumerate(archives.toLocalIterator()):
        names.append(str(Path(folder, f"{i:06d}.warc.gz")))
        Path(names[-1]).write_bytes(row["content"])
    return names


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(common.load(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""
