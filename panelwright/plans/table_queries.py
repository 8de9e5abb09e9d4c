"""Registered queries: roll-up, recoding, aggregation, joins, order, reshape."""

from __future__ import annotations

import math

from pyspark.sql import functions as F, types as T

from ..functions import nulls, recode as rc
from ..functions.grids import grid_column, log_grid
from ..functions.hashing import draw
from ..operators import columns, evaluate, joins, order, reshape, rollup
from ..operators.importance import p_values
from ..session import new_path, stage
from ..sources.csv import drop_index, read_csv, with_index, write_csv
from ..sources.tables import read_table
from . import codes, reports
from .fixture import KEYS, SEGMENT_CODES, TOTALS, cents, entity, features, model_data, panel, with_labels
from .registry import MODEL_VIEWS, query, sql_draw

WEIGHTS = {reports.ACTIONS: "total_actions", reports.UNANIMOUS: "total_unanimous"}


# Panel and roll-up -----------------------------------------------------------

@query("panel", "SELECT * FROM panel")
def q_panel(spark, folder):
    return panel(spark, folder)


@query("filter_year", "SELECT * FROM panel WHERE year < 1998")
def q_filter_year(spark, folder):
    return panel(spark, folder, before_year=1998)


@query("select_prefix", "SELECT entity_id, location, year, n_actions, measure_cents FROM panel")
def q_select_prefix(spark, folder):
    return columns.select_columns(
        panel(spark, folder), [*KEYS, "year"], prefixes=["n_", "measure"], drop=["n_unanimous"]
    )


@query("drop_positions", "SELECT entity_id, year, measure_cents, n_unanimous FROM panel")
def q_drop_positions(spark, folder):
    table = panel(spark, folder).select(*KEYS, "year", "measure_cents", "n_actions", "n_unanimous")
    return columns.drop_positions(table, [1, 4])


@query("entity_span", """
SELECT entity_id, location, min(year) AS start_year, max(year) AS end_year FROM panel GROUP BY entity_id, location""")
def q_entity_span(spark, folder):
    p = panel(spark, folder)
    return p.groupBy(*KEYS).agg(
        nulls.strict_min("year").alias("start_year"), nulls.strict_max("year").alias("end_year")
    )


@query("entity_duration", """
SELECT entity_id, location, start_year, end_year, end_year - start_year AS duration, active_years FROM entity""")
def q_entity_duration(spark, folder):
    rolled = rollup.roll_up(panel(spark, folder), KEYS, "year", {})
    return rolled.withColumn("duration", F.col("end_year") - F.col("start_year"))


@query("strict_sum", """
SELECT entity_id, location, CASE WHEN count(measure_cents) = count(*) THEN CAST(sum(measure_cents) AS BIGINT) END AS strict,
       CAST(coalesce(sum(measure_cents), 0) AS BIGINT) AS tally
FROM panel GROUP BY entity_id, location""")
def q_strict_sum(spark, folder):
    return panel(spark, folder).groupBy(*KEYS).agg(
        nulls.strict_sum("measure_cents").alias("strict"), nulls.tally_sum("measure_cents").alias("tally")
    )


@query("first_row_attrs", "SELECT * FROM firsts")
def q_first_row_attrs(spark, folder):
    first = rollup.first_values(["segment", "region_code", "wealth"], "year").alias("a")
    known = F.count("year") > 0
    return panel(spark, folder).groupBy(*KEYS).agg(first, known.alias("k")).where("k").select(*KEYS, "a.*")


@query("entity_left_join", """
SELECT s.entity_id, s.location, s.start_year, s.end_year, f.segment, f.region_code, f.wealth
FROM sums s LEFT JOIN firsts f ON s.entity_id IS NOT DISTINCT FROM f.entity_id
  AND s.location IS NOT DISTINCT FROM f.location""")
def q_entity_left_join(spark, folder):
    return joins.left_join_null_safe(q_entity_span(spark, folder), q_first_row_attrs(spark, folder), KEYS)


@query("entity_rollup", "SELECT * FROM entity")
def q_entity_rollup(spark, folder):
    return entity(spark, folder)


@query("dummy_flags", """
SELECT entity_id, location,
       CASE WHEN total_measure IS NULL THEN NULL WHEN total_measure > 246060552 THEN 1 ELSE 0 END AS large_flag,
       CASE WHEN total_actions > 0 THEN 1 ELSE 0 END AS action_flag,
       CASE WHEN total_unanimous = total_actions AND total_unanimous > 0 THEN 1 ELSE 0 END AS unanimous_flag,
       CASE WHEN total_measure > 246060552 AND total_actions > 1 THEN 1
            WHEN NOT (total_measure > 246060552 AND total_actions > 1) THEN 0 END AS both_flag
FROM entity""")
def q_dummy_flags(spark, folder):
    large = F.col("total_measure") > 246060552
    rolled = rollup.roll_up(panel(spark, folder), KEYS, "year", TOTALS)
    flagged = rolled.withColumns(rollup.action_flags("total_actions", "total_unanimous"))
    return flagged.select(
        *KEYS, nulls.if_known(large, 1, 0).alias("large_flag"), "action_flag", "unanimous_flag",
        nulls.if_known(large & (F.col("total_actions") > 1), 1, 0).alias("both_flag"),
    )


# Sources and column mapping --------------------------------------------------

@query("csv_roundtrip", "SELECT * FROM entity")
def q_csv_roundtrip(spark, folder):
    table = entity(spark, folder)
    path = new_path(spark, "csv")
    write_csv(table, path, index_order=KEYS)
    return drop_index(read_csv(spark, path, with_index(table.schema)))


@query("map_by_type", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
       nullif(l_quantity, 0) AS l_quantity, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
       lower(l_returnflag) AS l_returnflag, lower(l_linestatus) AS l_linestatus
FROM lineitem""", views="")
def q_map_by_type(spark, folder):
    lines = read_table(spark, folder, "lineitem").drop("l_shipdate")
    blanked = columns.map_types(lines, T.DoubleType, nulls.zero_to_null, keep=["l_extendedprice"])
    return columns.map_types(blanked, T.StringType, F.lower)


@query("index_levels", """
SELECT entity_id,
       CASE WHEN location IS NOT NULL THEN dense_rank() OVER (ORDER BY location) - 1 END AS location_index,
       CASE WHEN segment IS NOT NULL THEN dense_rank() OVER (ORDER BY segment NULLS LAST) - 1 END AS segment_index
FROM entity""")
def q_index_levels(spark, folder):
    table = entity(spark, folder).select("entity_id", "location", "segment")
    table = columns.index_levels(table, "location", "location_index")
    return columns.index_levels(table, "segment", "segment_index").drop("location", "segment")


@query("levels_by_appearance", """
SELECT entity_id,
       CASE WHEN location IS NOT NULL THEN dense_rank() OVER (ORDER BY first_location NULLS LAST) - 1 END AS location_index,
       CASE WHEN segment IS NOT NULL THEN dense_rank() OVER (ORDER BY first_segment NULLS LAST) - 1 END AS segment_index
FROM (SELECT entity_id, location, segment, min(entity_id) OVER (PARTITION BY location) AS first_location,
             CASE WHEN segment IS NOT NULL THEN min(entity_id) OVER (PARTITION BY segment) END AS first_segment FROM entity) t""")
def q_levels_by_appearance(spark, folder):
    """Levels coded in the order in which the entities bring them up."""
    table = entity(spark, folder).select("entity_id", "location", "segment")
    table = columns.index_by_appearance(table, "location", "location_index", ["entity_id"])
    return columns.index_by_appearance(table, "segment", "segment_index", ["entity_id"]).drop("location", "segment")


@query("one_hot", """
SELECT entity_id, wealth,
       CASE WHEN segment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS "segment_AUTOMOBILE",
       CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS "segment_BUILDING",
       CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS "segment_FURNITURE",
       CASE WHEN segment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS "segment_HOUSEHOLD",
       CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS "segment_MACHINERY"
FROM entity""")
def q_one_hot(spark, folder):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return columns.one_hot(entity(spark, folder).select("entity_id", "wealth", "segment"), "segment", segments)


@query("listwise_complete", """
SELECT * FROM entity WHERE total_measure IS NOT NULL AND segment IS NOT NULL AND wealth IS NOT NULL""")
def q_listwise_complete(spark, folder):
    return columns.complete_rows(entity(spark, folder), ["total_measure", "segment", "wealth"])


@query("model_data", "SELECT *, row_number() OVER (ORDER BY entity_id) AS id FROM model_data", views=MODEL_VIEWS)
def q_model_data(spark, folder):
    return order.add_row_id(model_data(spark, folder), ["entity_id"])


@query("row_id", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders",
       views="")
def q_row_id(spark, folder):
    table = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return order.add_row_id(table, ["o_custkey", "o_orderkey"])


# Recoding --------------------------------------------------------------------

TYPE_SQL = """CASE segment WHEN 'AUTOMOBILE' THEN 'Extrasystemic' WHEN 'BUILDING' THEN 'Interstate'
  WHEN 'FURNITURE' THEN 'Internal' WHEN 'HOUSEHOLD' THEN 'Internationalized Internal' END"""
REGION_SQL = """CASE region_code + 1 WHEN 1 THEN 'Europe' WHEN 2 THEN 'Middle East' WHEN 3 THEN 'Asia'
  WHEN 4 THEN 'Africa' WHEN 5 THEN 'Americas' END"""
ISSUE_SQL = """CASE total_unanimous + 1 WHEN 1 THEN 'Dispute over Territory' WHEN 2 THEN 'Dispute over Government'
  WHEN 3 THEN 'Dispute over both' END"""
DURATION_SQL = """CASE WHEN active_years < 6 THEN 'Less than 11 Conflict Years' ELSE 'Greater than 11 Conflict Years' END"""
SEVERITY_SQL = """CASE WHEN total_measure >= 305250041 THEN 'Greater than 11,236 deaths'
  WHEN total_measure >= 246060552 THEN 'Between 1,114 and 11,236 deaths'
  WHEN total_measure >= 184935981 THEN 'Between 116 and 1,114 deaths' ELSE 'Fewer than 116 deaths' END"""
WEALTH_SQL = """CASE WHEN wealth >= 7347.7 THEN '$5,342 - $27,674 GDP per capita'
  WHEN wealth >= 4381.9 THEN '$2,116 - $5,342 GDP per capita'
  WHEN wealth >= 1743.6 THEN '$1,228 - $2,116 GDP per capita' ELSE '$511 - $1,228 GDP per capita' END"""
LEVEL_SQL = """CASE WHEN total_actions >= 10 THEN 'Ten Alliances' WHEN total_actions >= 9 THEN 'Nine Alliances'
  WHEN total_actions >= 8 THEN 'Eight Alliances' WHEN total_actions >= 7 THEN 'Seven Alliances'
  WHEN total_actions >= 6 THEN 'Six Alliances' WHEN total_actions >= 5 THEN 'Five Alliances'
  WHEN total_actions >= 4 THEN 'Four Alliances' WHEN total_actions >= 3 THEN 'Three Alliances'
  WHEN total_actions >= 2 THEN 'Two Alliances' ELSE 'One Alliance' END"""


def type_label():
    return rc.recode(rc.recode("segment", SEGMENT_CODES), codes.TYPE_LABELS)


def region_label():
    return rc.recode(F.col("region_code") + 1, codes.REGION_LABELS)


def issue_label():
    return rc.recode(F.col("total_unanimous") + 1, codes.ISSUE_LABELS)


def _with_thresholds(ladder, thresholds):
    """The labels of a ladder at thresholds that suit the tables at hand."""
    return [(t, label) for t, (_, label) in zip(thresholds, ladder)]


def duration_label():
    return rc.below("active_years", 6, codes.DURATION_SHORT, codes.DURATION_LONG)


def severity_label():
    ladder = _with_thresholds(codes.SEVERITY_LADDER, [305250041, 246060552, 184935981])
    return rc.bands("total_measure", ladder, codes.SEVERITY_LOWEST)


def wealth_label():
    return rc.bands("wealth", _with_thresholds(codes.WEALTH_LADDER, [7347.7, 4381.9, 1743.6]), codes.WEALTH_LOWEST)


def level_label():
    return rc.bands("total_actions", codes.LEVEL_LADDER, codes.LEVEL_LOWEST)


@query("recode_labels", f"SELECT entity_id, {TYPE_SQL} AS kind, {REGION_SQL} AS region, {ISSUE_SQL} AS issue FROM entity")
def q_recode_labels(spark, folder):
    return entity(spark, folder).select(
        "entity_id", type_label().alias("kind"), region_label().alias("region"), issue_label().alias("issue")
    )


@query("threshold_bands", f"""
SELECT entity_id, {DURATION_SQL} AS duration, {SEVERITY_SQL} AS severity, {WEALTH_SQL} AS wealth_band,
       {LEVEL_SQL} AS level FROM entity""")
def q_threshold_bands(spark, folder):
    return entity(spark, folder).select(
        "entity_id", duration_label().alias("duration"), severity_label().alias("severity"),
        wealth_label().alias("wealth_band"), level_label().alias("level"),
    )


CUT_BREAKS = [-math.inf, 184935981, 246060552, 305250041, math.inf]
CUT_SQL = """CASE WHEN total_measure <= 184935981 THEN 'less than 100' WHEN total_measure <= 246060552 THEN '100-1000'
  WHEN total_measure <= 305250041 THEN '1000-5000' WHEN total_measure IS NOT NULL THEN 'greater than 5000' END"""


@query("cut_bins", f"SELECT entity_id, {CUT_SQL} AS category FROM entity")
def q_cut_bins(spark, folder):
    return entity(spark, folder).select(
        "entity_id", rc.cut("total_measure", CUT_BREAKS, codes.SEVERITY_BINS).alias("category")
    )


@query("cut_bins_count", f"""
SELECT {CUT_SQL} AS category, CASE action_flag WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS flag, count(*) AS n
FROM entity GROUP BY 1, 2""")
def q_cut_bins_count(spark, folder):
    return reports.severity_by_flag(
        entity(spark, folder), "total_measure", "action_flag", CUT_BREAKS, codes.SEVERITY_BINS
    )


@query("null_fill_by_key", """
SELECT entity_id, location, CASE WHEN location = 'NATION_3' AND segment IS NULL THEN 'Third nation'
  WHEN location = 'NATION_7' AND segment IS NULL THEN 'Seventh nation' ELSE segment END AS segment,
  segment IS NULL AS was_missing
FROM entity""")
def q_null_fill_by_key(spark, folder):
    fills = {"NATION_3": "Third nation", "NATION_7": "Seventh nation"}
    return entity(spark, folder).select(
        "entity_id", "location", rc.fill_by_key("segment", "location", fills).alias("segment"),
        F.col("segment").isNull().alias("was_missing"),
    )


@query("overwrite_by_key", """
+corrections AS (
  SELECT n.n_name AS location, CASE WHEN r.r_regionkey = 1 THEN 1990 END AS new_start,
         CASE WHEN r.r_regionkey = 2 THEN r.r_name END AS new_segment
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT e.entity_id, e.location, coalesce(c.new_start, e.start_year + 1) AS start,
       CASE WHEN e.location = 'NATION_5' THEN 2002 ELSE e.end_year - 1 END AS "end",
       coalesce(c.new_segment, e.segment) AS segment
FROM entity e LEFT JOIN corrections c ON e.location = c.location""")
def q_overwrite_by_key(spark, folder):
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    corrections = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("location"),
        F.when(F.col("r_regionkey") == 1, F.lit(1990).cast("long")).alias("new_start"),
        F.when(F.col("r_regionkey") == 2, F.col("r_name")).alias("new_segment"),
    )
    table = entity(spark, folder).select(
        *KEYS, (F.col("start_year") + 1).alias("start"), (F.col("end_year") - 1).alias("end"), "segment"
    )
    table = table.withColumn("end", rc.overwrite_by_key("end", "location", {"NATION_5": 2002}))
    return joins.overwrite_from(table, corrections, ["location"], {"start": "new_start", "segment": "new_segment"})


@query("ambivalent_report", f"""
+chosen AS (
  SELECT *, CASE WHEN location = 'NATION_3' AND segment IS NULL THEN 'Third nation'
                 WHEN location = 'NATION_7' AND segment IS NULL THEN 'Seventh nation' ELSE segment END AS name
  FROM entity WHERE total_actions > 0 AND NOT (total_unanimous > 0))
SELECT entity_id, name, total_actions, CASE WHEN name = 'FURNITURE' THEN 1996 ELSE start_year + 1 END AS start,
       end_year - 1 AS "end", location, total_measure, {TYPE_SQL} AS kind
FROM chosen""")
def q_ambivalent_report(spark, folder):
    table = entity(spark, folder).withColumn("name", F.col("segment"))
    out = reports.ambivalent(
        table, "total_actions", "total_unanimous", "name", "location", type_label(),
        {"NATION_3": "Third nation", "NATION_7": "Seventh nation"}, {"FURNITURE": 1996},
    )
    return out.select("entity_id", "name", "total_actions", "start", "end", "location", "total_measure", "kind")


# Counts and tallies ----------------------------------------------------------

@query("headline_totals", """
SELECT count(*) AS n, CAST(sum(total_actions) AS BIGINT) AS sum_actions, CAST(sum(total_unanimous) AS BIGINT) AS sum_unanimous,
       CASE WHEN count(total_measure) = count(*) THEN CAST(sum(total_measure) AS BIGINT) END AS sum_measure FROM entity""")
def q_headline_totals(spark, folder):
    return reports.headline_totals(
        entity(spark, folder),
        {"sum_actions": "total_actions", "sum_unanimous": "total_unanimous", "sum_measure": "total_measure"},
    )


@query("pivot_counts", """
SELECT count(CASE WHEN NOT total_actions > 0 THEN 1 END) AS no_action, count(CASE WHEN total_actions > 0 THEN 1 END) AS action,
       count(CASE WHEN NOT total_unanimous > 0 THEN 1 END) AS no_unanimous,
       count(CASE WHEN total_unanimous > 0 THEN 1 END) AS unanimous FROM entity""")
def q_pivot_counts(spark, folder):
    return reports.split_counts(entity(spark, folder), "total_actions", "total_unanimous")


@query("pivot_wider", f"""
SELECT {REGION_SQL} AS region, sum(CASE WHEN action_flag = 0 THEN total_actions END)::BIGINT AS "no",
       sum(CASE WHEN action_flag = 1 THEN total_actions END)::BIGINT AS "yes" FROM entity GROUP BY 1""")
def q_pivot_wider(spark, folder):
    table = entity(spark, folder).withColumn("region", region_label())
    wide = reshape.widen(table, ["region"], "action_flag", [0, 1], F.sum("total_actions"))
    return wide.withColumnsRenamed({"0": "no", "1": "yes"})


@query("count_by_predicate", "SELECT wealth > 5000 AS above, count(*) AS n FROM entity GROUP BY 1")
def q_count_by_predicate(spark, folder):
    return reports.count_by(entity(spark, folder), F.col("wealth") > 5000, "above")


@query("count_by_band", f"SELECT {SEVERITY_SQL} AS level, count(*) AS n FROM entity GROUP BY 1")
def q_count_by_band(spark, folder):
    return reports.count_by(entity(spark, folder), severity_label())


@query("count_by_wealth", f"SELECT {WEALTH_SQL} AS level, count(*) AS n FROM entity GROUP BY 1")
def q_count_by_wealth(spark, folder):
    return reports.count_by(entity(spark, folder), wealth_label())


@query("count_by_level", f"SELECT {LEVEL_SQL} AS level, count(*) AS n FROM entity GROUP BY 1")
def q_count_by_level(spark, folder):
    return reports.count_by(entity(spark, folder), level_label())


@query("weighted_tally", """
SELECT segment, CAST(coalesce(sum(total_measure), 0) AS BIGINT) AS n FROM entity GROUP BY segment""")
def q_weighted_tally(spark, folder):
    return entity(spark, folder).groupBy("segment").agg(nulls.tally_sum("total_measure").alias("n"))


def _tally_sql(label: str) -> str:
    return f"""
SELECT 'actions' AS report, {label} AS level, CAST(sum(total_actions) AS BIGINT) AS n
FROM entity WHERE total_actions > 0 GROUP BY 2
UNION ALL SELECT 'unanimous', {label}, CAST(sum(total_unanimous) AS BIGINT)
FROM entity WHERE total_unanimous > 0 GROUP BY 2"""


def _breakdown_sql(label: str) -> str:
    return f"SELECT 'entities' AS report, {label} AS level, count(*) AS n FROM entity GROUP BY 2 UNION ALL" + _tally_sql(label)


def _levels_sql(label: str, levels: list[str]) -> str:
    rows = ", ".join(f"('{kind}', '{level}', {i + 1})" for kind in WEIGHTS for i, level in enumerate(levels))
    return f"""+tally AS ({_tally_sql(label)})
SELECT g.report, g.level, CAST(g.ord AS BIGINT) AS ord, coalesce(t.n, 0) AS n
FROM (VALUES {rows}) g(report, level, ord) LEFT JOIN tally t ON g.report = t.report AND g.level = t.level"""


SEVERITY_ORDER = [codes.SEVERITY_LOWEST, *[label for _, label in reversed(codes.SEVERITY_LADDER)]]
WEALTH_ORDER = [codes.WEALTH_LOWEST, *[label for _, label in reversed(codes.WEALTH_LADDER)]]
LEVEL_ORDER = [codes.LEVEL_LOWEST, *[label for _, label in reversed(codes.LEVEL_LADDER)]]


def _ordered_tally(spark, folder, label, levels):
    return reports.with_levels(reports.tally_by(entity(spark, folder), label, WEIGHTS), levels, list(WEIGHTS))


@query("tally_by_duration", _levels_sql(DURATION_SQL, codes.DURATION_ORDER))
def q_tally_by_duration(spark, folder):
    return _ordered_tally(spark, folder, duration_label(), codes.DURATION_ORDER)


@query("tally_by_severity", _levels_sql(SEVERITY_SQL, SEVERITY_ORDER))
def q_tally_by_severity(spark, folder):
    return _ordered_tally(spark, folder, severity_label(), SEVERITY_ORDER)


@query("tally_by_wealth", _levels_sql(WEALTH_SQL, WEALTH_ORDER))
def q_tally_by_wealth(spark, folder):
    return _ordered_tally(spark, folder, wealth_label(), WEALTH_ORDER)


@query("levels_report", _levels_sql(LEVEL_SQL, LEVEL_ORDER))
def q_levels_report(spark, folder):
    return _ordered_tally(spark, folder, level_label(), LEVEL_ORDER)


@query("by_type", _breakdown_sql(TYPE_SQL))
def q_by_type(spark, folder):
    return reports.breakdown(entity(spark, folder), type_label(), WEIGHTS)


@query("by_issue", _breakdown_sql(ISSUE_SQL))
def q_by_issue(spark, folder):
    return reports.breakdown(entity(spark, folder), issue_label(), WEIGHTS)


@query("issue_report", _levels_sql(ISSUE_SQL, codes.ISSUE_ORDER))
def q_issue_report(spark, folder):
    return _ordered_tally(spark, folder, issue_label(), codes.ISSUE_ORDER)


@query("by_region", _breakdown_sql(REGION_SQL))
def q_by_region(spark, folder):
    return reports.breakdown(entity(spark, folder), region_label(), WEIGHTS)


SCATTER_WIDTH = {"avg_qty": 1.0, "avg_disc_pct": 0.5, "avg_tax_pct": 0.5, "returned_share": 0.0625, "open_share": 0.0625}


@query("scatter_pairs", "+points AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS report, '{c}' AS covariate, CAST(floor({c} / {w}) AS BIGINT) AS bin, {weight} AS weight "
    f"FROM features WHERE {weight} > 0" for c, w in SCATTER_WIDTH.items() for r, weight in WEIGHTS.items()
) + ") SELECT report, covariate, bin, weight, count(*) AS n FROM points GROUP BY 1, 2, 3, 4", views=MODEL_VIEWS)
def q_scatter_pairs(spark, folder):
    return reports.scatter(features(spark, folder), list(SCATTER_WIDTH), WEIGHTS, SCATTER_WIDTH)


@query("scatter_points", """
SELECT entity_id, wealth, total_actions FROM entity WHERE total_actions > 0""")
def q_scatter_points(spark, folder):
    return entity(spark, folder).where(F.col("total_actions") > 0).select("entity_id", "wealth", "total_actions")


@query("top15_report", f"""
+top AS (SELECT * FROM entity ORDER BY total_measure DESC NULLS LAST, entity_id LIMIT 15)
SELECT entity_id, CASE WHEN entity_id = 143 AND segment IS NULL THEN 'Kept name'
                       WHEN entity_id = 13 AND segment IS NULL THEN 'Other name' ELSE segment END AS name,
       location, CASE WHEN entity_id = 13 THEN 1994 ELSE start_year + 1 END AS start,
       CASE WHEN entity_id = 143 THEN 2002 ELSE end_year - 1 END AS "end", total_actions, total_unanimous,
       total_measure, {TYPE_SQL} AS kind FROM top""")
def q_top15_report(spark, folder):
    table = entity(spark, folder).withColumn("name", F.col("segment"))
    out = reports.top_entities(
        table, "total_measure", "entity_id", type_label(), "name",
        name_fills={143: "Kept name", 13: "Other name"}, start_fixes={13: 1994}, end_fixes={143: 2002},
    )
    return out.select("entity_id", "name", "location", "start", "end", "total_actions", "total_unanimous",
                      "total_measure", "kind")


# Joins, order, reshape -------------------------------------------------------

@query("full_join_reduce", """
+a AS (SELECT segment AS name, count(*) AS n_acted FROM entity WHERE total_actions > 4 GROUP BY 1),
b AS (SELECT segment AS name, count(*) AS n_unanimous FROM entity WHERE unanimous_flag = 1 AND segment <> 'BUILDING' GROUP BY 1),
c AS (SELECT location AS name, count(*) AS n_located FROM entity GROUP BY 1),
ab AS (SELECT coalesce(a.name, b.name) AS name, n_acted, n_unanimous FROM a FULL JOIN b ON a.name IS NOT DISTINCT FROM b.name)
SELECT coalesce(ab.name, c.name) AS name, n_acted, n_unanimous, n_located
FROM ab FULL JOIN c ON ab.name IS NOT DISTINCT FROM c.name""")
def q_full_join_reduce(spark, folder):
    table = entity(spark, folder)
    counted = lambda df, key, n: df.groupBy(F.col(key).alias("name")).agg(F.count(F.lit(1)).alias(n))
    return joins.full_join_all([
        counted(table.where("total_actions > 4"), "segment", "n_acted"),
        counted(table.where("unanimous_flag = 1 and segment <> 'BUILDING'"), "segment", "n_unanimous"),
        counted(table, "location", "n_located"),
    ], "name")


@query("cross_grid", """
SELECT n_name AS location, g.g AS mtry FROM nation, (VALUES (1), (2), (3), (4), (5), (6)) g(g)""", views="")
def q_cross_grid(spark, folder):
    nation = read_table(spark, folder, "nation").select(F.col("n_name").alias("location"))
    return reshape.cross_grid(nation, grid_column([3, 1, 2, 2, 6, 5, 4]), "mtry")


@query("log_grid", """
+m AS (SELECT var_pop(total_measure / 1e8) AS v, covar_pop(n_lines, total_measure / 1e8) AS c, var_pop(n_lines) AS x
       FROM features WHERE total_measure IS NOT NULL)
SELECT i AS grid_index, round(-2 + 12 * i / 199.0, 9) AS log_penalty,
       round(c / sqrt(v * x) / (1 + pow(10, -2 + 12 * i / 199.0)), 9) AS shrunk
FROM m, range(200) g(i)""", views=MODEL_VIEWS)
def q_log_grid(spark, folder):
    """Shrinkage of one scaled predictor along a log-spaced penalty grid."""
    table = features(spark, folder).where("total_measure is not null")
    y, x = F.col("total_measure") / F.lit(1e8), F.col("n_lines").cast("double")
    r = (F.covar_pop(x, y) / F.sqrt(F.var_pop(y) * F.var_pop(x))).alias("r")
    grid = F.posexplode(F.array(*[F.lit(g) for g in log_grid(*codes.RIDGE_GRID)])).alias("i", "penalty")
    return table.agg(r).select("r", grid).select(
        F.col("i").cast("long").alias("grid_index"),
        F.round(F.log10("penalty"), 9).alias("log_penalty"),
        F.round(F.col("r") / (1 + F.col("penalty")), 9).alias("shrunk"),
    )


@query("union_by_name", """
SELECT entity_id, total_actions AS amount, segment, CAST(NULL AS BIGINT) AS total_unanimous FROM entity WHERE action_flag = 1
UNION ALL SELECT entity_id, total_measure, NULL, total_unanimous FROM entity WHERE unanimous_flag = 1""")
def q_union_by_name(spark, folder):
    table = entity(spark, folder)
    a = table.where("action_flag = 1").select("entity_id", F.col("total_actions").alias("amount"), "segment")
    b = table.where("unanimous_flag = 1").select(F.col("total_measure").alias("amount"), "total_unanimous", "entity_id")
    return reshape.stack_tables(a, b)


@query("unpivot_measures", " UNION ALL ".join(
    f"SELECT entity_id, location, '{c}' AS name, {c} AS value FROM entity"
    for c in ["start_year", "end_year", "total_measure", "total_actions"]))
def q_unpivot_measures(spark, folder):
    table = entity(spark, folder).select(*KEYS, "start_year", "end_year", "total_measure", "total_actions")
    return reshape.lengthen(table, KEYS)


@query("nest_unnest", """
SELECT entity_id, 'test_error' AS metric, total_actions AS a, total_unanimous AS b FROM entity
UNION ALL SELECT entity_id, 'train_error', start_year, end_year FROM entity""")
def q_nest_unnest(spark, folder):
    nested = entity(spark, folder).select(
        "entity_id",
        F.array(F.lit("test_error"), F.lit("train_error")).alias("metric"),
        F.array("total_actions", "start_year").alias("a"),
        F.array("total_unanimous", "end_year").alias("b"),
    )
    return reshape.unnest_parallel(nested, ["entity_id"], ["metric", "a", "b"])


@query("nest_rows", """
SELECT entity_id, location, row_number() OVER (PARTITION BY entity_id, location ORDER BY year) AS position,
       year, measure_cents, n_actions FROM panel""")
def q_nest_rows(spark, folder):
    table = panel(spark, folder).select(*KEYS, "year", "measure_cents", "n_actions")
    return reshape.unnest_rows(reshape.nest_rows(table, KEYS, ["year"]), KEYS, position="position")


@query("model_labels", """
SELECT entity_id, CASE WHEN action_flag = 0 THEN 'No' ELSE 'Yes' END AS action_label,
       CASE WHEN unanimous_flag = 0 THEN 'No' ELSE 'Yes' END AS unanimous_label,
       CAST(1 - action_flag AS BIGINT) AS action_level, CAST(1 - unanimous_flag AS BIGINT) AS unanimous_level
FROM model_data""", views=MODEL_VIEWS)
def q_model_labels(spark, folder):
    labelled = with_labels(model_data(spark, folder).drop("action_label"))
    return labelled.select("entity_id", "action_label", "unanimous_label", "action_level", "unanimous_level")


@query("signif_stars", f"""
+d AS (SELECT entity_id, region_code, CAST(round(wealth * 100) AS BIGINT) - 450000 AS w FROM entity WHERE wealth IS NOT NULL),
obs AS (SELECT region_code, abs(sum(w)) AS s FROM d GROUP BY 1),
flips AS (SELECT region_code, b, abs(sum(CASE WHEN {sql_draw('entity_id', "('flip' || CAST(b AS VARCHAR))")} % 2 = 0 THEN w ELSE -w END)) AS s
          FROM d, range(99) g(b) GROUP BY 1, 2),
p AS (SELECT o.region_code, (1 + count(CASE WHEN f.s >= o.s THEN 1 END)) / 100.0 AS p_value
      FROM obs o JOIN flips f ON o.region_code = f.region_code GROUP BY 1)
SELECT region_code, round(p_value, 6) AS p_value, CASE WHEN p_value <= 0.001 THEN '***' WHEN p_value <= 0.01 THEN '**'
  WHEN p_value <= 0.05 THEN '*' WHEN p_value <= 0.1 THEN '.' ELSE ' ' END AS signif FROM p""")
def q_signif_stars(spark, folder):
    out = sign_flip_test(spark, folder, "region_code")
    return out.select("region_code", F.round("p_value", 6).alias("p_value"), rc.stars("p_value").alias("signif"))


def sign_flip_test(spark, folder, key, flips=99):
    """Does the mean balance of a group differ from 4,500? Sign-flip test.

    The flips of a row are laid side by side within the task and combined before
    the shuffle, which carries one row per group and flip from each task.
    """
    table = entity(spark, folder).where(F.col("wealth").isNotNull() & F.col(key).isNotNull())
    table = stage(table.select("entity_id", key, (cents("wealth") - 450000).alias("w")), "balance")
    flipped = table.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(flips - 1))))
    even = draw("entity_id", F.concat(F.lit("flip"), F.col("b").cast("string"))) % 2 == 0
    signed = F.when(even, F.col("w")).otherwise(-F.col("w"))
    null = flipped.groupBy(key, "b").agg(F.abs(F.sum(signed)).alias("s"))
    return p_values(table.groupBy(key).agg(F.abs(F.sum("w")).alias("s")), null, key, "s")


@query("leaderboard_rank", """
+g AS (SELECT 'qty_above_' || CAST(t AS VARCHAR) AS method, 'misclass' AS metric,
              avg(CASE WHEN (CASE WHEN avg_qty > t THEN 1 ELSE 0 END) <> action_flag THEN 1.0 ELSE 0.0 END) AS err
       FROM features, (VALUES (20), (24), (26), (30)) v(t) GROUP BY t
       UNION ALL SELECT 'constant_share', 'mse', avg((action_flag - 0.5) * (action_flag - 0.5)) FROM features)
SELECT row_number() OVER (ORDER BY err, method) AS "rank", method, metric, round(err, 9) AS test_error,
       row_number() OVER (PARTITION BY metric ORDER BY err, method) AS rank_in_metric FROM g""", views=MODEL_VIEWS)
def q_leaderboard_rank(spark, folder):
    table = features(spark, folder)
    rules = {t: evaluate.error("action_flag", evaluate.above("avg_qty", t), evaluate.MISCLASS) for t in (20, 24, 26, 30)}
    flat = evaluate.error("action_flag", F.lit(0.5), evaluate.MSE)
    wide = table.agg(*[e.alias(f"qty_above_{t}") for t, e in rules.items()], flat.alias("constant_share"))
    long = reshape.lengthen(wide, [], "method", "test_error")
    metric = F.when(F.col("method") == "constant_share", evaluate.MSE).otherwise(evaluate.MISCLASS)
    ranked = evaluate.leaderboard(long.withColumn("metric", metric), "test_error", "metric")
    return ranked.withColumn("test_error", F.round("test_error", 9))
