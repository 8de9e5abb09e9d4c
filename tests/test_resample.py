"""Splits, folds, row numbers and permutations against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from panelwright.operators import order, resample


def drawn(row_id, purpose, seed=27182):
    return int(hashlib.md5(f"{seed}:{purpose}:{row_id}".encode()).hexdigest()[:12], 16)


def ids(spark, n, parts):
    return spark.range(0, n * 3, 3, parts).withColumnRenamed("id", "k").withColumn("y", F.col("k") % 5)


@pytest.mark.parametrize("n", [1, 10, 115, 1000])
def test_exact_split(spark, n):
    expected = {k for k in sorted(range(0, 3 * n, 3), key=lambda k: (drawn(k, "split"), k))[: round(n * 0.7)]}
    for parts in (1, 4, 16):
        out = resample.exact_split(ids(spark, n, parts), "k")
        assert {r.k for r in out.where("is_train").collect()} == expected
        assert out.where("is_train is null").count() == 0


@pytest.mark.parametrize("n,folds", [(7, 10), (115, 10), (1000, 3)])
def test_folds_are_balanced(spark, n, folds):
    out = resample.assign_folds(ids(spark, n, 4), "k", folds).collect()
    sizes = [sum(r.fold == k for r in out) for k in range(folds)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    ranked = sorted((r.k for r in out), key=lambda k: (drawn(k, "fold"), k))
    fold_of = {r.k: r.fold for r in out}
    assert [fold_of[k] for k in ranked] == sorted(fold_of.values())


def test_permutations_keep_the_values(spark):
    df = ids(spark, 500, 4)
    out = resample.permute_columns(df, "k", ["y"], ["a", "b"], 1).collect()
    for d in ("a", "b"):
        got = {r.k: r.y for r in out if r.draw == d}
        base = sorted(range(0, 1500, 3), key=lambda k: (drawn(k, "base", 1), k))
        target = sorted(range(0, 1500, 3), key=lambda k: (drawn(k, d, 1), k))
        assert got == {t: b % 5 for t, b in zip(target, base)}
    assert {r.k: r.y for r in out if r.draw == "a"} != {r.k: r.y for r in out if r.draw == "b"}


def test_label_permutation(spark):
    df = ids(spark, 300, 4)
    out = df.withColumn("y", resample.permuted_labels(df, "k", "y", ["p", "q"])["p"])
    assert sorted(r.y for r in out.collect()) == sorted(r.y for r in df.collect())
    ranked = sorted(range(0, 900, 3), key=lambda k: (drawn(k, "p"), k))
    assert {r.k: r.y for r in out.collect()} == dict(zip(ranked, sorted(k % 5 for k in ranked)))
    assert out.where(F.col("y") != F.col("k") % 5).count() > 100
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 5])
def test_row_ids(spark, parts):
    df = spark.range(0, 2000, 1, parts).select((F.col("id") * 7919 % 2003).alias("a"), (F.col("id") % 3).alias("b"))
    # A third of the rows share the leading key.
    df = df.withColumn("b", F.when(F.col("a") % 3 == 0, 0).otherwise(F.col("b")))
    out = order.add_row_id(df, ["b", "a"]).collect()
    expected = sorted((r.b, r.a) for r in df.collect())
    assert [(r.b, r.a) for r in sorted(out, key=lambda r: r.id)] == expected
    assert sorted(r.id for r in out) == list(range(1, 2001))


def test_hot_level_is_indexed(spark):
    from panelwright.operators.columns import index_levels

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("s"))
    levels = sorted({r.s for r in df.distinct().collect()} - {None})
    out = index_levels(df, "s", "i")
    assert {(r.s, r.i) for r in out.distinct().collect()} == {(None, None), *[(s, i) for i, s in enumerate(levels)]}
    assert out.count() == 3000
