"""One small table per missing-value rule, with literal expected rows."""

import math

import pytest

from pyspark.sql import functions as F

from panelwright.functions import nulls, recode as rc
from panelwright.functions.stats import correlation
from panelwright.operators import columns, joins, order, reshape, rollup
from panelwright.plans import codes, reports


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_strict_sum_and_tally(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None), ("c", None), ("c", None)], "k string, x double"
    )
    out = df.groupBy("k").agg(nulls.strict_sum("x").alias("s"), nulls.tally_sum("x").alias("t"))
    assert rows(out, "k") == [("a", 3.0, 3.0), ("b", None, 1.0), ("c", None, 0.0)]


def test_strict_extremes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("b", 5)], "k string, x int")
    out = df.groupBy("k").agg(nulls.strict_min("x").alias("lo"), nulls.strict_max("x").alias("hi"))
    assert rows(out, "k") == [("a", 1, 2), ("b", None, None)]


def test_flags_keep_unknown(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 2, 2), (3, 2, 1), (4, None, 1), (5, 2, None), (6, 0, None)], "i int, t int, u int")
    out = df.withColumns(rollup.action_flags("t", "u")).select("i", "action_flag", "unanimous_flag")
    assert rows(out, "i") == [(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None), (5, 1, None), (6, 0, None)]


def test_bands_send_unknown_to_default(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 0.0, 115.0, 116.0, 1113.9, 1114.0, 11236.0])], "i int, x double")
    out = df.select("i", rc.bands("x", codes.SEVERITY_LADDER, codes.SEVERITY_LOWEST).alias("b"))
    low, mid, high, top = (
        "Fewer than 116 deaths", "Between 116 and 1,114 deaths", "Between 1,114 and 11,236 deaths",
        "Greater than 11,236 deaths",
    )
    assert [r[1] for r in rows(out, "i")] == [low, low, low, mid, mid, high, top]


def test_duration_boundary_is_long(spark):
    df = spark.createDataFrame([(0, 10), (1, 11), (2, None)], "i int, x int")
    out = df.select("i", rc.below("x", codes.DURATION_LIMIT, codes.DURATION_SHORT, codes.DURATION_LONG).alias("d"))
    assert [r[1] for r in rows(out, "i")] == [codes.DURATION_SHORT, codes.DURATION_LONG, codes.DURATION_LONG]


def test_level_ladder_sends_zero_and_unknown_to_one(spark):
    df = spark.createDataFrame([(0, None), (1, 0.0), (2, 1.0), (3, 2.0), (4, 9.5), (5, 10.0), (6, 40.0)], "i int, x double")
    out = df.select("i", rc.bands("x", codes.LEVEL_LADDER, codes.LEVEL_LOWEST).alias("l"))
    assert [r[1].split()[0] for r in rows(out, "i")] == ["One", "One", "One", "Two", "Nine", "Ten", "Ten"]


def test_recode_without_default(spark):
    df = spark.createDataFrame([(0, 1), (1, 4), (2, 9), (3, None)], "i int, x int")
    assert [r[1] for r in rows(df.select("i", rc.recode("x", codes.TYPE_LABELS).alias("l")), "i")] == [
        "Extrasystemic", "Internationalized Internal", None, None
    ]


def test_cut_is_right_closed(spark):
    values = [-5.0, 100.0, 100.5, 1000.0, 5000.0, 5001.0, None, float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    out = df.select("i", rc.cut("x", codes.SEVERITY_BREAKS, codes.SEVERITY_BINS).alias("b"))
    a, b, c, d = codes.SEVERITY_BINS
    assert [r[1] for r in rows(out, "i")] == [a, a, b, b, c, d, None, None]


def test_cut_with_finite_ends(spark):
    df = spark.createDataFrame(list(enumerate([0.0, 0.1, 1.0, 2.0, 2.1])), "i int, x double")
    out = df.select("i", rc.cut("x", [0, 1, 2], ["a", "b"]).alias("b"))
    assert [r[1] for r in rows(out, "i")] == [None, "a", "a", "b", None]


def test_filters_drop_unknown(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    assert df.where(F.col("x") > 0).count() == 1 and df.where(~(F.col("x") > 0)).count() == 1


def test_count_by_condition_keeps_unknown_group(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (2,)], "x int")
    assert rows(reports.count_by(df, F.col("x") > 0, "c"), "c") == [(None, 1), (False, 1), (True, 2)]


def test_first_row_ties_and_unknown_years(spark):
    df = spark.createDataFrame(
        [("a", 2, 1, "late"), ("a", 1, 2, "second"), ("a", 1, 1, "first"), ("a", None, 0, "none"),
         ("b", None, 1, "lost"), ("c", None, 1, "no"), ("c", 7, 1, "yes")], "k string, year int, tie int, v string"
    )
    out = df.groupBy("k").agg(rollup.first_values(["v"], "year", ["tie"]).alias("f")).select("k", "f.v")
    assert rows(out, "k") == [("a", "first"), ("b", None), ("c", "yes")]


def test_span_rule(spark):
    data = [("a", 5), ("b", 5), ("b", 6), ("c", 1), ("c", 9), ("d", 3), ("d", None)]
    out = rollup.roll_up(spark.createDataFrame(data, "k string, year int"), ["k"], "year", {})
    assert rows(out, "k") == [("a", 5, 5, 1), ("b", 5, 6, 1), ("c", 1, 9, 8), ("d", None, None, None)]


def test_correlation_degenerate_input(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0, None, 1.0), (2.0, None, 3.0, 5.0, 2.0), (None, 1.0, 3.0, None, 3.0), (4.0, 9.0, 3.0, None, 4.5)],
        "a double, b double, c double, d double, e double",
    )
    r = df.agg(
        correlation("a", "b").alias("two"), correlation("a", "c").alias("constant"), correlation("a", "d").alias("single"),
        correlation("b", "d").alias("none"), correlation("a", "e").alias("ae"),
    ).first()
    assert r["two"] == 1.0 and r["constant"] is None and r["single"] is None and r["none"] is None
    assert 0.9 < r["ae"] <= 1.0


def test_sorting_puts_unknown_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 5)], "k int, x int")
    assert [r.k for r in order.sorted_nulls_last(df, "x", ["k"]).collect()] == [3, 2, 4, 1]
    assert [r.k for r in order.sorted_nulls_last(df, "x", ["k"], descending=False).collect()] == [2, 4, 3, 1]
    assert [r.k for r in order.top_k(df, "x", 2, ["k"]).collect()] == [3, 2]


def test_division_and_replacement(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 4.0), (2, None, 2.0)], "i int, a double, b double")
    out = df.select("i", nulls.divide("a", "b").alias("q"), nulls.replace_where("b", F.col("a") == 1, F.lit(9.0)).alias("r"))
    assert rows(out, "i") == [(0, None, 9.0), (1, 0.25, 9.0), (2, None, 2.0)]


def test_levels_without_rows_stay(spark):
    df = spark.createDataFrame([("x", "b", 3)], "report string, level string, n long")
    out = reports.with_levels(df, ["a", "b"], ["x", "y"])
    assert rows(out, "report", "ord") == [("x", "a", 1, 0), ("x", "b", 2, 3), ("y", "a", 1, 0), ("y", "b", 2, 0)]


def test_tally_rows_pass_their_own_filter(spark):
    df = spark.createDataFrame([("a", 3, 0), ("a", 0, 0), ("b", 0, 0), (None, 2, 2)], "k string, t int, u int")
    out = reports.breakdown(df, "k", {"actions": "t", "unanimous": "u"})
    assert rows(out, "report", "level") == [
        ("actions", None, 2), ("actions", "a", 3), ("entities", None, 1), ("entities", "a", 2), ("entities", "b", 1),
        ("unanimous", None, 2),
    ]


def test_fill_and_overwrite_by_key(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, v string")
    out = df.select("k", rc.fill_by_key("v", "k", {1: "one", 2: "two"}).alias("f"), rc.overwrite_by_key("v", "k", {2: "two"}).alias("o"))
    assert rows(out, "k") == [(1, "one", None), (2, "x", "two"), (3, None, None)]
    fixes = spark.createDataFrame([(2, "fixed"), (3, None)], "k int, w string")
    assert rows(joins.overwrite_from(df, fixes, ["k"], {"v": "w"}), "k") == [(1, None), (2, "fixed"), (3, None)]
    assert rows(joins.overwrite_from(df, fixes, ["k"], {"v": "w"}, only_missing=True), "k") == [(1, None), (2, "x"), (3, None)]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, "z", "b")], "k int, l string, v string")
    b = spark.createDataFrame([(1, None, 10), (2, "y", 20)], "k int, l string, w int")
    assert rows(joins.left_join_null_safe(a, b, ["k", "l"]), "k") == [(1, None, "a", 10), (2, "z", "b", None)]
    c = spark.createDataFrame([(None, 5), ("q", 6)], "name string, x int")
    d = spark.createDataFrame([(None, 7), ("r", 8)], "name string, y int")
    assert rows(joins.full_join_all([c, d], "name"), "name") == [(None, 5, 7), ("q", 6, None), ("r", None, 8)]


def test_reshape(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, x double")
    b = spark.createDataFrame([("m", 2)], "y string, k int")
    assert rows(reshape.stack_tables(a, b), "k") == [(1, 2.0, None), (2, None, "m")]
    n = spark.createDataFrame([(1, ["p", "q"], [1, 2]), (2, [], [])], "k int, a array<string>, b array<int>")
    assert rows(reshape.unnest_parallel(n, ["k"], ["a", "b"]), "a") == [(1, "p", 1), (1, "q", 2)]
    w = spark.createDataFrame([("a", False, 2), ("a", True, 3), ("b", True, 1), ("b", None, 9)], "k string, c boolean, n int")
    wide = reshape.widen(w, ["k"], "c", [False, True], F.sum("n"))
    assert wide.columns == ["k", "false", "true"] and rows(wide, "k") == [("a", 2, 3), ("b", None, 1)]


def test_column_tools(spark):
    df = spark.createDataFrame([(0.0, "A", 0), (2.0, "B", 1)], "x double, s string, i int")
    from pyspark.sql import types as T

    out = columns.map_types(df, T.DoubleType, nulls.zero_to_null)
    assert rows(out, "s") == [(None, "A", 0), (2.0, "B", 1)]
    assert columns.drop_positions(df, [0, 1]).columns == ["i"]
    hot = columns.one_hot(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, c string"), "c", ["a", "b"])
    assert rows(hot, "k") == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]


def test_ambivalent_and_top(spark):
    df = spark.createDataFrame(
        [(1, None, "N", 3, 0, 10, 20, 5.0, 1), (2, "kept", "N", 1, 0, 10, 20, None, 2), (3, "c", "M", 1, 1, 5, 9, 7.0, 3),
         (4, "d", "M", 0, 0, 5, 9, 9.0, 4)],
        "id int, name string, location string, t int, u int, start_year int, end_year int, sev double, code int",
    )
    kind = rc.recode("code", codes.TYPE_LABELS)
    out = reports.ambivalent(df, "t", "u", "name", "location", kind, {"N": "filled"}, {"filled": 1946})
    assert rows(out.select("id", "name", "start", "end", "kind"), "id") == [
        (1, "filled", 1946, 19, "Extrasystemic"), (2, "kept", 11, 19, "Interstate")
    ]
    top = reports.top_entities(df, "sev", "id", kind, "name", k=3, name_fills={1: "one"}, start_fixes={4: 1}, end_fixes={3: 2})
    assert [tuple(r) for r in top.select("id", "name", "start", "end").collect()] == [
        (4, "d", 1, 8), (3, "c", 6, 2), (1, "one", 11, 19)
    ]


def test_log_grid_ends():
    from panelwright.functions.grids import log_grid

    g = log_grid(-2, 10, 200)
    assert len(g) == 200 and math.isclose(g[0], 0.01) and math.isclose(g[-1], 1e10)


def test_nan_is_missing_in_correlations(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1.0, 2.0, 1.0), (2.0, 1.0, 5.0), (3.0, 4.0, 2.0), (4.0, 3.0, nan), (9.0, nan, 1.0)], "y double, a double, b double"
    )
    from panelwright.operators import correlation

    got = {(r.na_mode, r.term): r.r for r in correlation.correlate(
        df, ["y"], ["a", "b"], modes=[correlation.PAIRWISE, correlation.LISTWISE]).collect()}
    assert got["pairwise", "a"] == pytest.approx(0.6)
    whole = {(r.term_i, r.term_j): r.r for r in correlation.correlation_matrix(df, ["y", "a", "b"]).collect()}
    assert got["listwise", "a"] == pytest.approx(whole["y", "a"])


def test_incomplete_rows_take_no_part_in_clusters(spark):
    from panelwright.operators import cluster

    rows = [(i, float(i % 7) + 10 * (i % 2), float(i % 5)) for i in range(200)]
    full = spark.createDataFrame(rows, "id long, x double, y double").repartition(4)
    holed = spark.createDataFrame(rows + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, x double, y double").repartition(4)
    a = cluster.cluster_grid(full, "id", ["x", "y"], [2], starts=3)[2]
    b = cluster.cluster_grid(holed, "id", ["x", "y"], [2], starts=3)[2]
    assert a.converged and b.converged and a.within == pytest.approx(b.within)


def test_one_hot_vector_has_all_levels(spark):
    df = spark.createDataFrame([(i, None if i == 5 else f"v{i % 1500:04d}") for i in range(1600)], "k int, c string")
    got = {r.k: r.v for r in columns.one_hot_vector(df, "c", "v").collect()}
    assert got[5].numNonzeros() == 0 and got[7].size == 1500
    assert got[7].indices.tolist() == [7]


def test_missing_values_are_refused_by_moments(spark):
    from panelwright.operators.moments import moments

    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1.0, 2.0), (2.0, bad)], "a double, b double")
        with pytest.raises(ValueError, match="b"):
            moments(df, ["a", "b"])
