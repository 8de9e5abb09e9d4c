"""Very many spans in one text, hot ids and dictionaries of small tables, windows that are joined."""

import random
import time

import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, pii, token_store
from panelwright.llm.tokens import tokenizer_path

from . import brute
from .test_edges import table


def test_personal_data_is_found_in_time_for_its_matches(spark):
    r = random.Random(3)
    text = " ".join(f"user{r.randrange(10**6)}@host{i}.example.com, 10.{i % 250}.7.{i % 99}" for i in range(20000))
    docs = table(spark, [(0, text), (1, "plain"), (2, "a.b@c.de" * 3), (3, None)])
    counted = docs.select(F.size(pii.candidates(F.col("text"))).alias("n"))
    counted.collect()
    start = time.perf_counter()
    assert max(r.n for r in counted.collect()) >= 40000
    assert time.perf_counter() - start < 20
    got = {x.doc_id: x.spans for x in pii.find_personal_data(docs).collect()}
    masked = {x.doc_id: x.text for x in pii.mask_documents(docs).collect()}
    want = brute.personal(text)
    assert len(want) == 40000
    assert {(s.kind, s.start, s.end) for s in got[0]} >= set(want)
    at, out = 0, []
    for s in sorted(got[0], key=lambda s: s.start):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    assert masked[0] == "".join(out) + text[at:]
    assert masked[1] == "plain" and masked[3] is None and got[3] == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 50])
def test_running_places(spark, n):
    r = random.Random(n)
    values = [r.randrange(9) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(
        pii._before(F.col("v"), lambda a, b: a + b).alias("sums"), pii._before(F.col("v"), lambda a, b: F.greatest(a, b)).alias("most")
    ).first()
    assert row.sums == [sum(values[:i]) for i in range(n)] and row.most == [max([0, *values[:i]]) for i in range(n)]


def test_store_of_a_hot_id_and_of_small_tables(spark, tmp_path):
    for rows in ([(7, f"text {i}") for i in range(40)] + [(None, f"none {i}") for i in range(40)] + [(1, ""), (9, None)], [(1, "one")]):
        docs = table(spark, rows)
        dictionary = token_store.train_dictionary(docs.select("doc_id", "text"), tokenizer_path())
        assert dictionary
        got = token_store.round_trip(docs, tokenizer_path()).collect()
        assert sorted(r.n_tokens for r in got) == sorted(len(brute.ids(t)) + 1 for _, t in rows)
        assert sorted(r.start for r in got)[0] == 0
    assert token_store.round_trip(table(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 28, 0])
def test_joined_windows(spark, broadcast_bytes):
    r = random.Random(8)
    items = [(f"i{k}", " ".join(r.choice("abcdefg") * 3 for _ in range(14))) for k in range(30)]
    docs = table(spark, [(k, "so " + t + " end " + items[0][1]) for k, (_, t) in enumerate(items[:9])] + [(50, "clean words"), (51, None)])
    windows = decontaminate.benchmark_windows(
        spark.createDataFrame(items, "item_id string, text string"), broadcast_windows=3, broadcast_bytes=broadcast_bytes)
    assert not windows.small and windows.broadcast == (broadcast_bytes > 0)
    found = decontaminate.find_hits(docs, windows)
    verified = decontaminate._verified(found, windows).select("key").distinct().count()
    assert verified == 9
