"""The registered queries over whole tables against SQL, brute force and held-out labels."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelwright.llm import packing, pii, quality, queries, secrets
from panelwright.llm.tokens import tokenizer_path
from tools.check_oracles import compare, connect

from . import brute
from .test_edges import by_id, check_pieces

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    assert compare(connect(small), QUERIES[name](spark, small), ORACLES[name]) is None


@pytest.mark.parametrize("name, find, kinds, base", [
    ("op1_secret_scan", brute.secrets, secrets.KINDS, ("assign", "access", "hex")),
    ("op9_personal_data", brute.personal, pii.KINDS, pii.BASE_KINDS),
])
def test_spans(spark, small, documents, name, find, kinds, base):
    got = by_id(QUERIES[name](spark, small).collect())
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(got) == len(texts)
    for row in got:
        want = find(texts[row.doc_id])
        assert row.base_sha256 == brute.sha(brute.joined(want, kinds))
        assert [row[f"n_{k}"] for k in base] == [sum(x[0] == k for x in want) for k in base]
        listed = {tuple(s.split(":")) for s in row.spans.split(",") if s}
        assert {(k, str(s), str(e)) for k, s, e in want} <= listed


def test_token_store(spark, small, documents):
    start = 0
    got = {r.doc_id: r for r in QUERIES["op3_token_store"](spark, small).collect()}
    for r in documents.orderBy("doc_id").collect():
        numbers = brute.ids(r.text) + [0]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(numbers), brute.crc(numbers))
        start += len(numbers)


def test_packing(spark, small, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert check_pieces(packing.pack(documents, tokenizer_path()).collect(), texts, 1024) < 1.05


def test_token_counts(spark, small, documents):
    import tiktoken  # noqa: F401

    second, first, seen = secrets.vocabulary(tokenizer_path("byte_bpe_multi_50k.tiktoken")), {}, set()
    for r in documents.orderBy("doc_id").collect():
        if (r.text or "") in seen:
            continue
        seen.add(r.text or "")
        native = r.lang == "en" or r.lang is None
        n = len(brute.ids(r.text)) if native else len(second.encode_ordinary(r.text or ""))
        key = (r.source, r.lang, "byte_bpe_50k" if native else "byte_bpe_multi_50k")
        old = first.get(key, (0, 0))
        first[key] = (old[0] + 1, old[1] + n)
    assert {tuple(r[:3]): tuple(r[3:]) for r in QUERIES["op5_token_counts"](spark, small).collect()} == first


def test_quality_tells_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    shown = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    got = {r.doc_id: r.selected for r in quality.classify(docs, labels.where(shown)).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where(~shown).collect()]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05


def test_pipeline(spark, small, documents):
    """Every stage against brute force on the documents that the stage before left."""
    docs = documents
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, function in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = function(spark, docs, small)
        after = out.collect()
        if name != "packing":
            assert out.columns == documents.columns
            left = {r.doc_id: r for r in after}
            assert len(left) == len(after)
        if name == "quality":
            judged = {r.doc_id: r.selected for r in quality.classify(docs, labels).collect()}
            assert set(left) == {i for i, s in judged.items() if s}
        elif name == "near_duplicates":
            want = brute.near_duplicates([(i, r.text) for i, r in before.items()], 80)
            assert set(left) == {i for i, (_, c) in want.items() if c == i}
        elif name == "decontamination":
            told = brute.contamination([r.text for r in before.values()], bench)
            assert set(left) == {i for i, t in zip(before, told) if not t[4]}
        elif name == "personal_data":
            assert set(left) == set(before)
            for i, r in left.items():
                assert not brute.personal(r.text) and r.n_chars == len(r.text)
                if r.text != before[i].text:
                    assert "[" in r.text
        else:
            assert check_pieces(after, {i: r.text for i, r in before.items()}, 1024) < 1.05
        docs = spark.createDataFrame(after, out.schema)
    whole = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in after} and all(r.n == r.t for r in whole)
