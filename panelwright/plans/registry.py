"""Named queries, each with the SQL that answers the same question, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views of plans.fixture as SQL.
VIEWS = """
WITH raw_years AS (
  SELECT o.o_custkey AS entity_id, n.n_name AS location,
         CAST(year(o.o_orderdate) AS BIGINT) AS year,
         CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(sum(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_actions,
         CAST(sum(CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT)
           AS n_unanimous,
         max(c.c_mktsegment) AS seg, max(n.n_regionkey) AS region_code, max(c.c_acctbal) AS acct
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY o.o_custkey, n.n_name, CAST(year(o.o_orderdate) AS BIGINT)),
panel AS (
  SELECT entity_id, location, year,
         CASE WHEN (entity_id * 31 + year) % 97 = 0 THEN NULL ELSE cents END AS measure_cents,
         n_actions, n_unanimous,
         CASE WHEN entity_id % 13 = 0 THEN NULL ELSE seg END AS segment,
         region_code,
         CASE WHEN entity_id % 11 = 0 THEN NULL ELSE acct END AS wealth
  FROM raw_years),
sums AS (
  SELECT entity_id, location, min(year) AS start_year, max(year) AS end_year,
         CASE WHEN count(measure_cents) = count(*) THEN CAST(sum(measure_cents) AS BIGINT) END AS total_measure,
         CAST(sum(n_actions) AS BIGINT) AS total_actions, CAST(sum(n_unanimous) AS BIGINT) AS total_unanimous
  FROM panel GROUP BY entity_id, location),
firsts AS (
  SELECT entity_id, location, segment, region_code, wealth FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, location ORDER BY year) AS rn FROM panel) t WHERE rn = 1),
entity AS (
  SELECT s.entity_id, s.location, s.start_year, s.end_year,
         CASE WHEN s.end_year - s.start_year = 0 THEN 1 ELSE s.end_year - s.start_year END AS active_years,
         s.total_measure, s.total_actions, s.total_unanimous,
         CASE WHEN s.total_actions > 0 THEN 1 ELSE 0 END AS action_flag,
         CASE WHEN s.total_unanimous = s.total_actions AND s.total_unanimous > 0 THEN 1 ELSE 0 END AS unanimous_flag,
         f.segment, f.region_code, f.wealth
  FROM sums s LEFT JOIN firsts f ON s.entity_id = f.entity_id AND s.location = f.location)
"""

MODEL_VIEWS = VIEWS + """,
lines AS (
  SELECT o.o_custkey AS entity_id, count(*) AS n_lines,
         CAST(sum(CAST(l.l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS avg_qty,
         CAST(sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS avg_disc_pct,
         CAST(sum(CAST(round(l.l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS avg_tax_pct,
         CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS returned_share,
         CAST(sum(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS open_share,
         count(DISTINCT l.l_suppkey) AS n_suppliers
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
features AS (
  SELECT e.*, l.n_lines, l.avg_qty, l.avg_disc_pct, l.avg_tax_pct, l.returned_share, l.open_share, l.n_suppliers,
         CASE e.segment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                        WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS segment_code
  FROM entity e JOIN lines l ON e.entity_id = l.entity_id),
model_data AS (
  SELECT *, CASE WHEN action_flag = 0 THEN 'No' ELSE 'Yes' END AS action_label
  FROM features WHERE total_measure IS NOT NULL AND segment IS NOT NULL AND wealth IS NOT NULL)
"""


def sql_draw(row_id: str, purpose: str, seed: int = 27182) -> str:
    """The SQL form of ``functions.hashing.draw``; ``purpose`` is an SQL expression."""
    return f"CAST('0x' || substr(md5('{seed}:' || {purpose} || ':' || CAST({row_id} AS VARCHAR)), 1, 12) AS BIGINT)"


def query(name: str, sql: str | None = None, views: str = VIEWS, recursive: bool = False):
    """Register a query; ``sql`` continues the given views, with ``+`` in front if it adds views of its own."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            rest, text = sql.lstrip(), views
            if rest.startswith("+"):  # more views follow
                rest, text = rest[1:], text.rstrip() + ","
            if recursive:
                text = text.replace("WITH", "WITH RECURSIVE", 1)
            ORACLES[name] = f"{text}\n{rest}".strip()
        return function

    return add
