"""The corpus pipeline: raw documents in, packed training sequences out.

Each stage gets the documents that the one before it kept, as written to Parquet,
and the folder of the other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import decontaminate, minhash, packing, pii, quality
from panelwright.llm.tokens import tokenizer_path
from panelwright.session import stage


#: Bytes of pieces of text that a worker of the last stage remembers. Executors carry four stages' heap by then.
PIECES_BYTES = 64 << 20


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_selected(docs, _table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return pii.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), remembered_bytes=PIECES_BYTES).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", good_documents), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark),
    ("personal_data", without_personal_data), ("packing", packed),
]

#: No SQL: the tokenizer, the sketches and the trained models have none. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written and read again as the next one's documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
