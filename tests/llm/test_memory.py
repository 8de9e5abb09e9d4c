"""What tasks and workers hold at once is bounded by bytes."""

import itertools
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import graph, memory, minhash, packing, quality, tokens
from panelwright.llm.files import BATCH_BYTES, ship_package, small_batches

from .test_edges import table

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_remembered_words_are_bounded_by_bytes():
    """Long words are not kept by their number, and forgetting changes no shingle."""
    minhash.word_hashes().clear()
    words = [f"{i}" * 5 + "x" * 50_000 for i in range(1000)]
    whole = minhash.shingles(" ".join(words))
    assert sum(map(len, minhash.word_hashes())) <= 16 << 20
    assert set(minhash.shingles(" ".join(words[:500]))) < set(whole) and len(whole) == 996


def test_batches_are_small_while_texts_are_read(spark, monkeypatch):
    before, seen = spark.conf.get(BOUND), {}

    def noted(df, label="staged", real=minhash.stage):
        seen[label] = spark.conf.get(BOUND)
        return real(df, label)

    monkeypatch.setattr(minhash, "stage", noted)
    text = " ".join(f"w{i}" for i in range(50))
    assert minhash.near_duplicates(table(spark, [(1, text), (2, text + " x")])).count() == 2
    assert seen["sketches"] == seen["sets"] == str(BATCH_BYTES) and seen["pairs"] == spark.conf.get(BOUND) == before


def test_batches_are_small_while_documents_are_scored(spark, monkeypatch):
    before, seen = spark.conf.get(BOUND), {}

    def noted(df, label="staged", real=quality.stage):
        seen[label] = spark.conf.get(BOUND)
        return real(df, label)

    monkeypatch.setattr(quality, "stage", noted)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.keep_selected(table(spark, [(1, "one text"), (2, None)]), labels).count() == 2
    assert seen["scores"] == str(BATCH_BYTES) and spark.conf.get(BOUND) == before


def test_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 1000) as text")
    with small_batches(spark, 1 << 20):
        rows = [r.rows for r in docs.mapInArrow(sizes, "rows long").collect()]
    assert sum(rows) == 3000 and max(rows) <= 1100
    with pytest.raises(ZeroDivisionError), small_batches(spark, 1):
        1 / 0
    assert spark.conf.get(BOUND) != "1"


def test_star_step_keeps_what_is_connected(spark):
    """Two components, also with repeated links, each a star around its smallest node in the end; a step adds no rows."""
    links = [(b, a) for a, b in itertools.combinations(range(3, 12), 2)] + [(30 + i, 29 + i) for i in range(9)]
    edges = spark.createDataFrame(links, "a long, b long")
    step = graph.star_step(edges).collect()
    assert len(step) == len(set(step)) <= len(links) and all(r.a > r.b for r in step)
    found = {r.node: r.component for r in graph.connected_components(edges.union(edges)).collect()}
    assert found == {i: 3 for i in range(3, 12)} | {i: 29 for i in range(29, 39)}


def test_remembered_pieces_are_bounded_by_bytes():
    """Both tables of an encoder stay below the bound, and what is forgotten is encoded alike again."""
    words = [f"{i}" * 8 for i in range(3000)]
    texts = [" ".join(words), " ".join(reversed(words)), "\n".join(words)]
    small, large = tokens.Encoder(tokens.tokenizer_path(), 80_000), tokens.Encoder(tokens.tokenizer_path())
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    kept = [*small._first.items(), *small._after_space.items()]
    assert 0 < sum(len(piece) + len(ids) + tokens.ENTRY_BYTES for piece, ids in kept) <= 80_000


def test_worker_holds_tables_of_one_operator_only(spark):
    """A worker that packed forgets its pieces when another operator's turn comes, and the reverse."""
    docs = table(spark, [(i, f"some words of text {i}") for i in range(20)]).repartition(1)
    vocabulary = tokens.tokenizer_path()

    def held(owner):
        def work(batches):
            yield from batches
            yield pa.RecordBatch.from_arrays([pa.array([f"{tokens.encoder.cache_info().currsize} {minhash.word_hashes.cache_info().currsize}"])], ["held"])

        rows = docs.limit(0).selectExpr("cast(doc_id as string) as held").mapInArrow(memory.with_tables_of(owner, work), "held string")
        return {r.held for r in rows.collect()}

    ship_package(spark)
    assert packing.pack(docs, vocabulary).count() == 20
    assert held("minhash") <= {"0 0", "0 1"}
    with small_batches(spark):
        assert minhash.sketches(docs.select("doc_id", "text")).count() == 20
    assert held("tokens") <= {"0 0", "1 0"}


def test_forgetting_frees_the_encoder():
    gone = weakref.ref(tokens.encoder(tokens.tokenizer_path(), 1 << 20))
    minhash.word_hashes.cache_clear()
    minhash.shingles("some words")
    memory.keep_only("minhash")
    assert gone() is None and len(minhash.word_hashes()) == 2
    memory.keep_only("tokens")
    assert not minhash.word_hashes()


def test_pipeline_packs_with_fewer_remembered_pieces(spark):
    """The bound of the last stage changes no piece."""
    docs = table(spark, [(1, "one text"), (2, None), (3, "one more text " * 700)])
    plain = packing.pack(docs, tokens.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))
    found = corpus_pipeline.packed(spark, docs, "")
    assert found.schema == plain.schema and sorted(found.collect()) == sorted(plain.collect())
    assert corpus_pipeline.PIECES_BYTES < tokens.REMEMBERED_BYTES
