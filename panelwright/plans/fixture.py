"""The order tables seen as a panel: customer x year, customer, modelling table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.recode import level_index, recode
from ..operators.columns import complete_rows
from ..operators.rollup import action_flags, roll_up
from ..sources.tables import read_table

KEYS = ["entity_id", "location"]
FIRST = ["segment", "region_code", "wealth"]
TOTALS = {"total_measure": "measure_cents", "total_actions": "n_actions", "total_unanimous": "n_unanimous"}

# The segment codes.
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}

# The order of outcome levels: the positive one first.
POSITIVE_FIRST = ["Yes", "No"]

PREDICTORS = [
    "active_years", "total_measure", "segment_code", "region_code", "wealth", "n_lines",
    "avg_qty", "avg_disc_pct", "avg_tax_pct", "returned_share", "open_share", "n_suppliers",
]


def cents(value) -> Column:
    """Money as whole cents, so that sums are exact in any order.

    ``rint`` works on doubles; ``round`` would build a decimal per value.
    """
    return F.rint(F.col(value) * 100).cast("long")


def panel(spark: SparkSession, folder: str, before_year: int | None = None) -> DataFrame:
    """One row per customer and year.

    Orders are aggregated before they meet the customers, so a customer with a
    large share of all orders enters the join with one row per year. A cut-off
    year becomes a date bound that reaches the Parquet scan. Whether customers
    and nations are broadcast is left to Spark's size check.
    """
    orders = read_table(spark, folder, "orders")
    if before_year is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(f"{before_year}-01-01").cast("timestamp_ntz"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    finished = F.col("o_orderstatus") == "F"
    yearly = orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(
        F.sum(cents("o_totalprice")).alias("cents"),
        F.sum(F.when(urgent, 1).otherwise(0)).alias("n_actions"),
        F.sum(F.when(urgent & finished, 1).otherwise(0)).alias("n_unanimous"),
    )
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    joined = yearly.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    entity_id, year = F.col("o_custkey"), F.col("year")
    return joined.select(
        entity_id.alias("entity_id"),
        F.col("n_name").alias("location"),
        year,
        F.when((entity_id * 31 + year) % 97 != 0, F.col("cents")).alias("measure_cents"),
        "n_actions",
        "n_unanimous",
        F.when(entity_id % 13 != 0, F.col("c_mktsegment")).alias("segment"),
        F.col("n_regionkey").alias("region_code"),
        F.when(entity_id % 11 != 0, F.col("c_acctbal")).alias("wealth"),
    )


def entity_from(panel_df: DataFrame) -> DataFrame:
    rolled = roll_up(panel_df, KEYS, "year", TOTALS, FIRST)
    flagged = rolled.withColumns(action_flags("total_actions", "total_unanimous"))
    span = ["start_year", "end_year", "active_years"]
    return flagged.select(*KEYS, *span, *TOTALS, "action_flag", "unanimous_flag", *FIRST)


def entity(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer: the roll-up of the panel."""
    return entity_from(panel(spark, folder))


def line_features(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer statistics of order lines.

    Only the key of an order is needed, so lines meet orders first and are then
    combined per customer and supplier on the map side, which also makes the
    distinct supplier count a plain count. An order with very many lines is
    split over tasks by the adaptive skew join.
    """
    one_if = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    lines = read_table(spark, folder, "lineitem")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    per_supplier = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(cents("l_discount")).alias("disc"),
        F.sum(cents("l_tax")).alias("tax"),
        one_if(F.col("l_returnflag") == "R").alias("returned"),
        one_if(F.col("l_linestatus") == "O").alias("open"),
    )
    sums = ["n", "qty", "disc", "tax", "returned", "open"]
    per_customer = per_supplier.groupBy("o_custkey").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("l_suppkey").alias("n_suppliers")
    )
    share = lambda c: F.col(c).cast("double") / F.col("n")
    return per_customer.select(
        F.col("o_custkey").alias("entity_id"),
        F.col("n").alias("n_lines"),
        share("qty").alias("avg_qty"),
        share("disc").alias("avg_disc_pct"),
        share("tax").alias("avg_tax_pct"),
        share("returned").alias("returned_share"),
        share("open").alias("open_share"),
        "n_suppliers",
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with their line statistics; missing values still in place."""
    joined = entity(spark, folder).join(line_features(spark, folder), "entity_id")
    return joined.withColumn("segment_code", recode("segment", SEGMENT_CODES))


def with_labels(df: DataFrame) -> DataFrame:
    """Both outcomes as labels and as codes with the positive level first."""
    flags = {"action": "action_flag", "unanimous": "unanimous_flag"}
    labels = {
        f"{name}_label": F.when(F.col(flag) == 0, "No").when(F.col(flag) != 0, "Yes") for name, flag in flags.items()
    }
    return df.withColumns(labels).withColumns(
        {f"{name}_level": level_index(f"{name}_label", POSITIVE_FIRST) for name in flags}
    )


def model_data(spark: SparkSession, folder: str) -> DataFrame:
    """Complete rows with a Yes/No outcome."""
    complete = complete_rows(features(spark, folder), ["total_measure", "segment", "wealth"])
    label = F.when(F.col("action_flag") == 0, "No").when(F.col("action_flag") != 0, "Yes")
    return complete.withColumn("action_label", label)
