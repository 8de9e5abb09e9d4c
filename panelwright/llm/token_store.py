"""Token ids in files: every document compressed on its own with one shared dictionary.

A file is: magic, 8 bytes of the dictionary's hash, one zstandard frame per
document, the index (frame offsets, one more than documents; document ids; a
byte per document that is 1 where the id is known) and a footer (place of the
index, number of documents, magic). Integers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path, stage
from .files import new_file, open_random, ship_package
from .tokens import encoder

MAGIC = b"TOKZSTD1"
_HEADER = "<8s8s"
_FOOTER = "<QQ8s"
_HEADER_BYTES, _FOOTER_BYTES = struct.calcsize(_HEADER), struct.calcsize(_FOOTER)
#: The dictionary is trained on a piece each of at most this many documents; a piece has at most this many characters.
SAMPLE_DOCUMENTS = 1000
SAMPLE_CHARACTERS = 4000
#: Documents of one file, as nearly as a range of ids allows.
FILE_DOCUMENTS = 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
END_ID = 0


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> bytes:
    """A dictionary from the serialized ids of a bounded sample: a piece of each of the first
    ``SAMPLE_DOCUMENTS`` documents in the order of a hash of their ids.

    A piece begins at a hashed place of the whole text, so the ends of long texts teach
    as much as their beginnings. The dictionary has an eighth of the sample's bytes up to
    ``DICTIONARY_BYTES``. Where the sample is too small or too alike to train on, the
    sample itself is the dictionary. Only a table without any text has none.
    """
    # Ids first: texts of a top-k would be gathered from every task.
    chosen = stage(
        docs.where("text is not null and doc_id is not null").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS), "sample",
    )
    spare = F.greatest(F.length("text") - SAMPLE_CHARACTERS + 1, F.lit(1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(SAMPLE_CHARACTERS)), spare).cast("int")
    piece = F.substring(F.col("text"), place + 1, F.lit(SAMPLE_CHARACTERS)).alias("text")
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(piece).alias("text"))
    sample = rows.orderBy("doc_id").collect()  # at most SAMPLE_DOCUMENTS rows
    encode = encoder(vocabulary).encode
    end = np.array([end_id], dtype="<u4").tobytes()
    samples = [encode(row["text"]) + end for row in sample if row["text"]]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes() if size >= 512 else _own(samples)
    except zstandard.ZstdError:
        return _own(samples)


def _own(samples: list[bytes]) -> bytes:
    """The sample as a dictionary without tables; eight bytes are the least that is one."""
    data = b"".join(samples)[-DICTIONARY_BYTES:]
    return data.rjust(8, b"\0") if data else b""


def dictionary_hash(dictionary: bytes) -> bytes:
    return xxhash.xxh64_digest(dictionary)


def _shared(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_store(
    docs: DataFrame, vocabulary: str, folder: str, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = END_ID,
) -> tuple[list[dict], bytes]:
    """Encode all documents in ascending id order into files of ``folder``.

    Texts are dealt by range of id, those of one id by a hash of the text, and sorted within the task, then encoded,
    compressed and written in one pass; a file is one range, and their number grows with
    the documents. Returns the manifest (one entry per file, in order, with the ids of all
    documents before it) and the dictionary. Null ids come first, equal ids in the order of
    the hashes of their texts, null texts (which count as empty) before others. An empty table gives no file.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    dictionary = train_dictionary(table, vocabulary, end_id)
    mark = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc_nulls_first()]
    parts = max(1, -(-table.count() // FILE_DOCUMENTS))
    placed = table.withColumn("mark", mark).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("mark")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end = encoder(vocabulary).encode_all, np.array([end_id], dtype="<u4").tobytes()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary)).compress
        offsets, ids, tokens, at, shard = [], [], 0, _HEADER_BYTES, TaskContext.get().partitionId()
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        with new_file(folder, f"{shard:05d}.tok") as (out, uri):
            out.write(struct.pack(_HEADER, MAGIC, dictionary_hash(dictionary)))
            while batch is not None:
                for doc_id, found in zip(batch.column(0).to_pylist(), encode_all(batch.column(1))):
                    data = found + end
                    frame = compress(data)
                    out.write(frame)
                    offsets.append(at)
                    ids.append(doc_id)
                    tokens += len(data) // 4
                    at += len(frame)
                batch = next(batches, None)
            offsets.append(at)
            out.write(np.array(offsets, dtype="<u8").tobytes())
            out.write(np.array([i or 0 for i in ids], dtype="<i8").tobytes())
            out.write(bytes(i is not None for i in ids))
            out.write(struct.pack(_FOOTER, at, len(ids), MAGIC))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "documents": [len(ids)], "tokens": [tokens]})

    rows = placed.mapInArrow(work, "shard long, uri string, documents long, tokens long").collect()  # one per file
    manifest, start = [], 0
    for row in sorted(rows, key=lambda r: r["shard"]):
        manifest.append({"uri": row["uri"], "start": start, "documents": row["documents"]})
        start += row["tokens"]
    return manifest, dictionary


class StoreFile:
    """One file of a store; any document is reached through the offset index."""

    def __init__(self, uri: str, dictionary: bytes):
        self._file = open_random(uri)
        magic, mark = struct.unpack(_HEADER, self._file.read_at(_HEADER_BYTES, 0))
        if magic != MAGIC or mark != dictionary_hash(dictionary):
            raise ValueError(f"{uri} was written with another dictionary or format")
        size = self._file.size()
        index, self.documents, magic = struct.unpack(_FOOTER, self._file.read_at(_FOOTER_BYTES, size - _FOOTER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{uri} is cut short")
        raw = self._file.read_at(size - _FOOTER_BYTES - index, index)
        n = self.documents
        self.offsets = np.frombuffer(raw, "<u8", n + 1)
        self._ids = np.frombuffer(raw, "<i8", n, 8 * (n + 1))
        self._known = np.frombuffer(raw, "u1", n, 8 * (2 * n + 1))
        self._decompress = zstandard.ZstdDecompressor(dict_data=_shared(dictionary)).decompress

    def doc_id(self, i: int) -> int | None:
        return int(self._ids[i]) if self._known[i] else None

    def ids(self, i: int) -> bytes:
        """The ids of document ``i`` alone."""
        start, end = int(self.offsets[i]), int(self.offsets[i + 1])
        return self._decompress(self._file.read_at(end - start, start))

    def scan(self, bytes_at_once: int = 4 << 20) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, read in large blocks."""
        i = 0
        while i < self.documents:
            base = int(self.offsets[i])
            j = max(i + 1, int(np.searchsorted(self.offsets, base + bytes_at_once, "right")) - 1)
            block = self._file.read_at(int(self.offsets[j]) - base, base)
            for k in range(i, j):
                yield self.doc_id(k), self._decompress(block[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base])
            i = j

    def close(self) -> None:
        self._file.close()


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_store(spark: SparkSession, manifest: list[dict], dictionary: bytes) -> DataFrame:
    """One row per document: its id, the number of ids before it, its length, its ids. One task per file."""
    files = spark.createDataFrame([(m["uri"], m["start"]) for m in manifest], "uri string, start long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, rows, held = StoreFile(uri, dictionary), [], 0
                for doc_id, ids in store.scan():
                    rows.append((doc_id, start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    held += len(ids)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                store.close()
                if rows:
                    yield _batch(rows)

    return files.repartition(max(1, len(manifest))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)


def round_trip(docs: DataFrame, vocabulary: str, **columns) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    spark = docs.sparkSession
    return read_store(spark, *write_store(docs, vocabulary, new_path(spark, "token-store"), **columns))
