"""Importance resampling against a plain recomputation of counts, ratios, keys and the cut."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import quality

MASK = 2**64 - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def form(word):
    core = word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    text = core.decode()
    if not text:
        case = "none"
    elif len(text) > 1 and text.isupper():
        case = "upper"
    elif text[0].isupper():
        case = "title"
    else:
        case = "lower" if text.isalpha() else "mixed"
    return xxhash.xxh32_intdigest(case.encode() + word[len(core):][:8])


def grams(text):
    out, before, form_before = [], 0, 0
    for word in (text or "").encode().split():
        own = xxhash.xxh32_intdigest(word)
        now = 1 if own == before else form(word)
        out += [
            mix(own) % quality.WORD_BUCKETS, quality.WORD_BUCKETS + mix(own ^ (before << 32)) % quality.PAIR_BUCKETS,
            quality.WORD_BUCKETS + quality.PAIR_BUCKETS + mix(now ^ (form_before << 32)) % quality.FORM_BUCKETS,
        ]
        before, form_before = own, now
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_classify_against_plain(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    docs = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 5").withColumn("text", F.lit(None).cast("string")))
    sample = {r.doc_id: (r.good, r.teaches) for r in quality.labelled_sample(labels).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    raw, target = Counter(), Counter()
    for i, text in rows:
        found = grams(text)
        raw.update(found)
        if sample.get(i) == (True, True):
            target.update(found)
    sections = np.cumsum([0, quality.WORD_BUCKETS, quality.PAIR_BUCKETS, quality.FORM_BUCKETS])
    totals = [(sum(c for b, c in target.items() if lo <= b < hi), sum(c for b, c in raw.items() if lo <= b < hi))
              for lo, hi in zip(sections, sections[1:])]

    def weight(text):
        out = 0.0
        for b in grams(text):
            t, r = totals[int(np.searchsorted(sections, b, side="right")) - 1]
            out += math.log((target[b] + quality.PRIOR) / (raw[b] * (t / r) + quality.PRIOR))
        return out

    got = {}
    for r in quality.classify(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    keys = []
    for i, text in rows:
        w = weight(text)
        mark = xxhash.xxh64_intdigest(f"{quality.SEED}:{i}:".encode() + (text or "").encode())
        key = w + quality.TEMPERATURE * -math.log(-math.log(((mark >> 11) + 0.5) / 2**53))
        match = [r for r in got[i] if math.isclose(r.log_weight, w, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.gumbel_key, key, rel_tol=1e-9, abs_tol=1e-9)]
        assert match and match[0].n_words == len((text or "").split())
        keys.append((-key, i, xxhash.xxh64_intdigest((text or "").encode()) >> 1, w, match[0].selected))
    held = {i: w for (_, i, _, w, _) in sorted(keys, key=lambda k: -k[3]) if i in sample and not sample[i][1]}
    cut = quality.best_cut(np.array(list(held.values())), np.array([sample[i][0] for i in held]))
    k = sum(w >= cut for *_, w, _ in keys)
    keys.sort()
    assert [s for *_, s in keys] == [n < k for n in range(len(keys))] and 0 < k < len(keys)
