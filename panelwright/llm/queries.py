"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate, host_rules, lattice, minhash, packing, pii, pivots, quality, secrets, sql, token_counts, token_store, warc,
    whitening,
)
from .tokens import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.scan(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return secrets.digest(found, ("assign", "access", "hex"))


@query("op2_warc", sql.WARC)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    read = warc.round_trip(table(spark, folder, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_token_store")
def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written to compressed files and read back from them."""
    stored = token_store.round_trip(table(spark, folder, "documents"), tokenizer_path())
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_lattice_links", sql.VECTORS)
def op4_lattice_links(spark: SparkSession, folder: str) -> DataFrame:
    """Near-equal embeddings of a label."""
    return lattice.near_vectors(table(spark, folder, "embeddings"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of all documents after an insert, a delete and a revise batch."""
    return token_counts.keep_counts(
        table(spark, folder, "documents"), tokenizer_path(), "byte_bpe_50k", tokenizer_path("byte_bpe_multi_50k.tiktoken"),
        "byte_bpe_multi_50k",
    ).totals()


@query("op6_near_duplicates", sql.DUPLICATES)
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-copies among all documents; the query's contract is a similarity of 0.85, for which 24 bands do."""
    return minhash.near_duplicates(table(spark, folder, "documents"), threshold=85, bands=24)


@query("op7_decontamination", sql.CONTAMINATION)
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weights of all documents and which of them are kept."""
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return secrets.digest(pii.find_personal_data(table(spark, folder, "documents")), pii.BASE_KINDS)


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op11_host_rules", sql.HOST_RULES)
def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts of all documents and the verdicts of their hosts."""
    found = host_rules.judged(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings whitened by the first components of the distinct ones."""
    return whitening.whitened(table(spark, folder, "embeddings"))


@query("op13_vector_codes", sql.VECTOR_CODES)
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings as codes of 16 parts."""
    return pivots.compressed(table(spark, folder, "embeddings"))
