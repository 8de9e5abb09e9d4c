"""Registered queries against their SQL, their plans and hot keys."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwright.operators import correlation, rollup
from panelwright.plans import fixture, reports
from tools.check_oracles import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 80


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, small, name):
    assert compare(connect(small), QUERIES[name](spark, small), ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 150


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cutoff_year_reaches_the_scan(spark, small):
    text = plan(fixture.panel(spark, small, before_year=1998))
    assert "LessThan(o_orderdate" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "o_orderkey" not in schema


@pytest.mark.parametrize("name", [
    "entity_rollup", "by_region", "corr_grid", "weighted_tally", "scatter_pairs", "csv_roundtrip", "row_id", "exact_split",
])
def test_no_window_over_the_whole_table(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ("corr_grid",):
        assert not re.search(r"Exchange SinglePartition.*\n.*Window", text)


def test_roll_up_is_one_aggregation(spark, small):
    panel = fixture.panel(spark, small).cache()
    text = plan(fixture.entity_from(panel))
    assert text.count("Exchange hashpartitioning(entity_id") == 1
    panel.unpersist()


def test_hot_entity_rolls_up_whole(spark):
    """A third of the panel belongs to one entity."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("e"), (F.col("id") % 50).alias("year"),
        F.col("id").alias("tie"), F.when(F.col("id") != 9, F.col("id") % 11).alias("x"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"),
    )
    got = {r.e: r for r in rollup.roll_up(df, ["e"], "year", {"s": "x"}, ["v"], ["tie"]).collect()}
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.e, []).append(r)
    assert len(got) == len(groups)
    for e, members in groups.items():
        first = min(members, key=lambda r: (r.year, r.tie))
        known = all(m.x is not None for m in members)
        assert got[e].v == first.v and got[e].s == (sum(m.x for m in members) if known else None)
    assert len(groups[0]) > n / 3 and got[0].s is None


def test_correlations_with_a_hot_value(spark):
    """A third of the rows share one value, some are missing."""
    rng = np.random.default_rng(4)
    n = 3000
    data = rng.normal(size=(n, 3))
    data[::3, 1] = 7.0
    rows = [
        (float(a), float(b) if i % 10 else None, float(c) if i % 7 else None, int(i % 4)) for i, (a, b, c) in enumerate(data)
    ]
    df = spark.createDataFrame(rows, "t double, x double, z double, g int")
    out = correlation.correlate(
        df, ["t"], ["x", "z"], {"all": F.lit(True), "some": F.col("g") < 2}, [correlation.PAIRWISE, correlation.LISTWISE]
    )
    table = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=float)
    for r in out.collect():
        column = {"x": 1, "z": 2}[r.term]
        keep = ~np.isnan(table[:, column])
        if r.na_mode == "listwise":
            keep &= ~np.isnan(table[:, 1:3]).any(axis=1)
        if r.population == "some":
            keep &= table[:, 3] < 2
        assert r.r == pytest.approx(np.corrcoef(table[keep, 0], table[keep, column])[0, 1], abs=1e-9)


def test_reports_with_a_hot_label(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("k"),
        (F.col("id") % 5).alias("t"),
    )
    got = {(r.report, r.level): r.n for r in reports.breakdown(df, "k", {"actions": "t"}).collect()}
    rows = df.collect()
    assert got["entities", "hot"] == 3000
    for level in {r.k for r in rows}:
        mine = [r.t for r in rows if r.k == level and r.t > 0]
        assert got.get(("actions", level)) == (sum(mine) if mine else None)
