"""WARC archives: writer with revisit records, splittable reader of gzip members.

Each record is a gzip member of its own. A reading task gets a byte range, looks for the gzip magic in
it, takes a candidate for a member only if it inflates to a WARC header, and owns the records whose
members start inside its range; a member may end beyond it. So any range can be read by any task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import new_folder, open_store, partitions, read, store_file
from tablemill.llm.queries import query
from tablemill.session import stage

#: Payloads of fewer bytes are always stored.
LEAST = 100
#: Bytes of an archive that one reading task owns.
SPLIT = 8 << 20
#: Bytes fetched at once while a member is inflated.
PIECE = 64 << 10
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*head, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member: a response with the payload, or a revisit of the record `refers_to`."""
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", _DATE),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%")))
    if key is not None:
        head.append(("X-Key", str(key)))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("X-Refers-To-Key", str(refers_to)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(head, http if revisit else http + payload)


def first_holders(pages: DataFrame) -> DataFrame:
    """page_id, digest, holder: pages with a payload that a smaller page_id has too, once each.

    Only digests are exchanged; the smallest page of a digest is found with a partial aggregation.
    Pages without an id are stored as they are: nothing refers to them or from them.
    """
    slim = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= LEAST)).select(
        "page_id", F.sha2("html", 256).alias("digest")
    )
    slim = stage(slim)
    held = slim.groupBy("digest").agg(F.min("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    later = slim.join(held.where("n > 1").drop("n"), "digest").where("page_id > holder")
    return later.dropDuplicates(["page_id", "digest"])


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """path, bytes, records of the archives written into `folder`, a shared one.

    `pages` has page_id, url and html; null html is empty. Of repeated rows of a page with equal
    payloads the first (by url) is the response and the others revisit it. A retried task writes
    a file of another name; only the files in the returned table count.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    copies = Window.partitionBy("page_id", "digest").orderBy("url")
    rows = rows.withColumn("copy", F.row_number().over(copies))
    rows = rows.join(first_holders(pages), ["page_id", "digest"], "left")
    again = (F.col("copy") > 1) & F.col("page_id").isNotNull() & (F.octet_length("html") >= LEAST)
    rows = rows.select("page_id", "url", "html", "digest", F.coalesce("holder", F.when(again, F.col("page_id"))).alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for key, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or store_file(folder, name)
                member = record(key, url, html.encode(), digest, refers)
                out.write(member)
                size, n = size + len(member), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return stage(rows.mapInArrow(put, "path string, bytes long, records long"))


class _Source:
    """Bytes of a file by position; the last piece fetched is kept."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def piece(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(n, SPLIT + PIECE), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]


def _inflate(source: _Source, at: int) -> tuple[bytes, int] | None:
    """A member's content and its end, or None if no WARC record starts here."""
    unpack, got, head = zlib.decompressobj(31), [], b""
    while at < source.size and not unpack.eof:
        data = source.piece(at, min(PIECE, source.size - at))
        try:
            got.append(unpack.decompress(data))
        except zlib.error:
            return None
        if len(head) < 7:
            head = b"".join(got)[:7]
            if not b"WARC/1.".startswith(head):
                return None
        at += len(data)
    if not unpack.eof or len(head) < 7:
        return None
    return b"".join(got), at - len(unpack.unused_data)


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r\n", re.M)


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a record; None if the header isn't whole or its length isn't right."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.decode("latin-1").lower(): v.decode() for k, v in _FIELD.findall(raw[: end + 2])}
    length = fields.get("content-length", "")
    if not length.isdigit() or raw[end + 4 + int(length) :] != b"\r\n\r\n":
        return None
    return fields, raw[end + 4 : end + 4 + int(length)]


def records_in(uri: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Position, fields and block of the records whose members start in a byte range."""
    source = _Source(uri)
    at, sure = start, False
    while at < min(end, source.size):
        if not sure:
            window = source.piece(at, min(PIECE, source.size - at))
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += found
            if at >= end:
                return
        got = _inflate(source, at)
        whole = parse(got[0]) if got else None
        if whole is None:
            at, sure = at + 1, False
            continue
        yield at, *whole
        at, sure = got[1], True


def read_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per record of the archives in `files` (path, bytes): where it stands and what it holds.

    payload_bytes and payload_digest are computed from the payload of a response, which must agree
    with its header, and are the header's for a revisit.
    """
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("start"))
    ranges = ranges.repartition(partitions(files.sparkSession), "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                rows = []
                for at, fields, block in records_in(path, start, start + split):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].partition(":")[2]
                    if fields["warc-type"] == "response":
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}, record at {at}: the payload doesn't match its digest")
                    else:
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    key, refers = fields.get("x-key"), fields.get("x-refers-to-key")
                    rows.append(
                        {
                            "path": path, "offset": at, "page_id": key and int(key), "url": fields.get("warc-target-uri"),
                            "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": digest,
                            "refers_to": refers and int(refers),
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return ranges.mapInArrow(
        scan,
        "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long",
    )


_RECORD = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ]
)


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


@query("op9_warc", _SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back by byte ranges."""
    files = write_warc(read(spark, sf_dir, "pages").select("page_id", "url", "html"), new_folder(spark, "warc"))
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
