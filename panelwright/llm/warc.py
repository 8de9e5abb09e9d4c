"""WARC archives: one gzip member per record, duplicates as revisits, a verifying sequential reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path
from .files import new_file, open_stream, ship_package

#: A new archive is begun when one holds this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
_READ_BYTES = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
# The length of the full payload, which a revisit record does not carry itself.
_LENGTH = "X-Payload-Length"
_ID = re.compile(r"<urn:x-page:(-?[0-9]+)>")
#: Deals of a digest: a digest with a third of all rows meets its first page in so many tasks.
SALTS = 32


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Page id, URL, payload and the page that a revisit refers to (null: a response).

    Only digests that occur more than once are looked up, each dealt to ``SALTS``
    tasks, so no digest gathers its rows in one. Rows with the smallest id of
    their payload are responses, and so are rows whose payload has no known id.
    """
    table = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = table.select("page_id", F.sha2("payload", 256).alias("_digest"), F.length("payload").alias("_bytes"))
    firsts = (
        keyed.where(F.col("_bytes") >= least_bytes).groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null")
        .select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    looked = table.select(
        "*", F.sha2("payload", 256).alias("_digest"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("_salt"),
    ).join(firsts, ["_digest", "_salt"], "left")
    return looked.select(
        "page_id", "url", "payload",
        F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")), F.col("_first")).alias("refers_to"),
    )


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    revisit = refers_to is not None
    block = (_HTTP % len(payload)) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'unknown' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"{_LENGTH}: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(referred: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write the rows of ``with_references`` into .warc.gz files; returns their URIs, a few per task."""
    ship_package(referred.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(i) for i in range(4)]))
        row, number, uris = next(rows, None), 0, []
        while row is not None:
            with new_file(folder, f"{TaskContext.get().partitionId():05d}-{number:05d}.warc.gz") as (out, uri):
                written = 0
                while row is not None and written < archive_bytes:
                    member = gzip.compress(record(*[v.as_py() for v in row]), compresslevel=6, mtime=0)
                    written += out.write(member)
                    row = next(rows, None)
            number += 1
            uris.append(uri)
        yield pa.RecordBatch.from_pydict({"uri": pa.array(uris, pa.string())})

    return [r["uri"] for r in referred.select("page_id", "url", "payload", "refers_to").mapInArrow(work, "uri string").collect()]


def read_members(stream, uri: str = "") -> Iterator[bytearray]:
    """The contents of gzip members one after the other, inflated as the bytes arrive."""
    inflate, member, begun, waiting = zlib.decompressobj(wbits=31), bytearray(), False, b""
    while True:
        chunk = waiting or stream.read(_READ_BYTES)
        if not chunk:
            if begun:
                raise ValueError(f"{uri}: the last member is cut short")
            return
        begun = True
        member += inflate.decompress(chunk)
        waiting = inflate.unused_data
        if inflate.eof:
            yield member
            inflate, member, begun = zlib.decompressobj(wbits=31), bytearray(), False


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block, framed by Content-Length and checked against its digest."""
    head, found, rest = bytes(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: wrong content length")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"{fields.get('warc-record-id')}: wrong block digest")
    return fields, block


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if sha1_base32(payload) != digest or len(payload) != int(fields[_LENGTH.lower()]):
            raise ValueError(f"{fields['warc-record-id']}: wrong payload digest")
    page, refers = _ID.fullmatch(fields["warc-record-id"]), _ID.fullmatch(fields.get("warc-refers-to", ""))
    return (
        int(page[1]) if page else None, fields["warc-target-uri"], kind, int(refers[1]) if refers else None,
        int(fields[_LENGTH.lower()]), digest, payload,
    )


def read_archives(spark: SparkSession, uris: list[str], payloads: bool = True) -> DataFrame:
    """One row per record of the archives, each read from start to end by one task.

    A broken member, frame or digest fails the job: nothing is passed over.
    ``payload`` is null for revisits, and for all rows without ``payloads``.
    """
    files = spark.createDataFrame([(u,) for u in uris], "uri string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_stream(uri) as stream:
                    for member in read_members(stream, uri):
                        row = _row(*parse_record(member))
                        held += len(member)
                        rows.append(row if payloads else (*row[:-1], None))
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary"
    )
    return files.repartition(max(1, len(uris))).mapInArrow(work, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write one record per page in the shared folder and read the archives back.

    Null html is an empty payload, and empty payloads are equal to each other.
    Repeated rows are written each. An empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    uris = write_archives(with_references(pages, least_bytes), new_path(spark, "warc"))
    return read_archives(spark, uris, payloads)
