"""Token counts by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path, stage
from .files import ship_package
from .secrets import vocabulary
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Additive totals in a folder: one written delta per batch, and snapshots that hold several.

    A batch is written aside and renamed into ``batches/<id>`` when it is whole; a
    batch that is there already is not computed again, so a repeated commit changes
    nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, place: str) -> list[str]:
        path = self._path(f"{self._folder}/{place}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def _publish(self, df: DataFrame, place: str) -> None:
        aside = f"{self._folder}/aside/{uuid.uuid4().hex}"
        df.write.parquet(aside)
        target = self._path(f"{self._folder}/{place}")
        self._files.mkdirs(target.getParent())
        if not self._files.rename(self._path(aside), target):
            raise OSError(f"{place} could not be committed")

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest snapshot and the batches in it, which its name's companion lists."""
        newest = max(self._names("snapshots"), default=None)
        if newest is None:
            return None, set()
        listed = self._spark.read.schema("batch string").parquet(f"{self._folder}/included/{newest}")
        return newest, {r["batch"] for r in listed.collect()}

    def batches(self) -> list[str]:
        return sorted(self._snapshot()[1] | set(self._names("batches")))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add signed rows (the keys, documents, tokens); False if the batch was there already.

        Rows are added up before they are written. A null source or language is a
        key like any other; null counts are 0. An empty batch is a batch.
        """
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"no name for a batch: {batch!r}")
        if batch in self.batches():
            return False
        summed = deltas.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
            *[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in SUMS]
        )
        self._publish(summed, f"batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """One row per key with documents or tokens left."""
        newest, included = self._snapshot()
        places = [f"{self._folder}/batches/{b}" for b in self._names("batches") if b not in included]
        if newest is not None:
            places.append(f"{self._folder}/snapshots/{newest}")
        read = self._spark.read.schema(_SCHEMA)
        rows = read.parquet(*places) if places else self._spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(s).cast("long").alias(s) for s in SUMS]).where("documents != 0 or tokens != 0")

    def compact(self) -> None:
        """Fold all batches into a snapshot, so that totals read one file set however many batches there were."""
        names, number = self.batches(), len(self._names("snapshots"))
        totals = self.totals()
        self._publish(self._spark.createDataFrame([(n,) for n in names], "batch string"), f"included/{number:08d}")
        self._publish(totals, f"snapshots/{number:08d}")


def signed(events: DataFrame) -> DataFrame:
    """Events as signed rows.

    ``events`` has op (insert, delete, revise), source, lang, tokenizer, tokens and,
    for a revise, old_tokenizer and old_tokens. A revise takes back the old count
    and adds the new one.
    """
    sign = F.when(F.col("op") == "delete", -1).otherwise(1)
    now = events.select("source", "lang", "tokenizer", sign.cast("long").alias("documents"), (sign * F.col("tokens")).alias("tokens"))
    back = events.where("op = 'revise'").select(
        "source", "lang", F.col("old_tokenizer").alias("tokenizer"), F.lit(-1).cast("long").alias("documents"),
        (-F.col("old_tokens")).alias("tokens"),
    )
    return now.union(back)


def count_documents(docs: DataFrame, first_vocabulary: str, second_ranks: str | None = None, second_for=None) -> DataFrame:
    """Per document: doc_id, source, lang, a hash of its text, its ids by the first vocabulary and, where
    ``second_for`` (a condition) holds, by the second one. Null texts have no tokens."""
    ship_package(docs.sparkSession)
    twice = F.coalesce(second_for, F.lit(False)) if second_for is not None else F.lit(False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(first_vocabulary).encode
        for batch in batches:
            marks, first, second = [], [], []
            for text, both in zip(batch.column(3), batch.column(4).to_pylist()):
                text = text.as_py() or ""
                marks.append(xxhash.xxh3_128_digest(text.encode()))
                first.append(len(encode(text)) // 4)
                second.append(len(vocabulary(second_ranks).encode_ordinary(text)) if both else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(marks, pa.binary()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64())],
                names=["doc_id", "source", "lang", "text_key", "first", "second"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), "text", twice.alias("twice"),
    ).mapInArrow(work, "doc_id long, source string, lang string, text_key binary, first long, second long")


def keep_counts(docs: DataFrame, first_vocabulary: str, first_name: str, second_ranks: str, second_name: str, native: str = "en") -> Rollup:
    """Three batches over a whole table: all documents are inserted; of equal texts all but the one with the
    smallest id are deleted; those left in another language than ``native`` are revised to the second tokenizer.
    The second batch is sent twice, as after a lost acknowledgement, and counts once."""
    spark = docs.sparkSession
    counted = stage(count_documents(docs, first_vocabulary, second_ranks, F.col("lang") != native), "counts")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    plain = counted.select("source", "lang", F.lit(first_name).alias("tokenizer"), F.col("first").alias("tokens"))
    rollup.commit("1-insert", signed(plain.withColumn("op", F.lit("insert")).withColumns(
        {"old_tokenizer": F.lit(None).cast("string"), "old_tokens": F.lit(None).cast("long")}
    )))
    # What is left of each text; to delete the others is to take all back and add what is left.
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "source", "lang", "first", "second")
    left = stage(counted.groupBy("text_key").agg(F.min(row).alias("r")).select("r.*"), "left")
    gone = plain.select("source", "lang", "tokenizer", F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens")).union(
        left.select("source", "lang", F.lit(first_name), F.lit(1).cast("long"), "first")
    )
    for _ in range(2):
        rollup.commit("2-delete", gone)
    rollup.commit("3-revise", signed(left.where("second is not null").select(
        F.lit("revise").alias("op"), "source", "lang", F.lit(second_name).alias("tokenizer"), F.col("second").alias("tokens"),
        F.lit(first_name).alias("old_tokenizer"), F.col("first").alias("old_tokens"),
    )))
    rollup.compact()
    return rollup
