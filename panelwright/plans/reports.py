"""Report tables over an entity table. Column names are arguments throughout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import as_column, replace_where, strict_sum, tally_sum
from ..functions.recode import cut, fill_by_key, overwrite_by_key, recode
from ..operators.order import top_k

ENTITIES, ACTIONS, UNANIMOUS = "entities", "actions", "unanimous"


def headline_totals(df: DataFrame, totals: Mapping[str, str]) -> DataFrame:
    """Rows and strict totals over the whole table."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[strict_sum(c).alias(out) for out, c in totals.items()])


def count_by(df: DataFrame, label: Column | str, name: str = "level") -> DataFrame:
    """Rows per label; an unknown label is a group of its own."""
    return df.groupBy(as_column(label).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def _reports_by(df: DataFrame, label, weights: Mapping[str, str], name: str, entities: bool) -> DataFrame:
    aggregates, cells = [], []

    def add(report: str, total: Column, rows: Column) -> None:
        i = len(cells)
        aggregates.extend([total.alias(f"n{i}"), rows.alias(f"k{i}")])
        cells.append(F.struct(F.lit(report).alias("report"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k")))

    if entities:
        add(ENTITIES, F.count(F.lit(1)), F.count(F.lit(1)))
    for report, weight in weights.items():
        passing = F.when(F.col(weight) > 0, F.col(weight))
        add(report, tally_sum(passing), F.count(passing))
    wide = df.groupBy(as_column(label).alias(name)).agg(*aggregates)
    return wide.select(name, F.inline(F.array(*cells))).where("k > 0").select("report", name, "n")


def tally_by(df: DataFrame, label: Column | str, weights: Mapping[str, str], name: str = "level") -> DataFrame:
    """Sum of each weight per label, over the rows where that weight is positive.

    All tallies come from one aggregation. A label appears in a report only if
    some of its rows pass that report's filter. Result: ``report, level, n``.
    """
    return _reports_by(df, label, weights, name, entities=False)


def breakdown(df: DataFrame, label: Column | str, weights: Mapping[str, str], name: str = "level") -> DataFrame:
    """Entities per label and every tally per label, in one aggregation."""
    return _reports_by(df, label, weights, name, entities=True)


def with_levels(report: DataFrame, levels: Sequence[str], kinds: Sequence[str], name: str = "level") -> DataFrame:
    """Add the display order, and levels without rows with 0.

    Levels and report kinds are literals of a few entries each; they are laid
    out first and the counts joined to them.
    """
    grid = [(kind, level, i + 1) for kind in kinds for i, level in enumerate(levels)]
    ordered = report.sparkSession.createDataFrame(grid, f"report string, {name} string, ord long")
    return ordered.join(report, ["report", name], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def split_counts(df: DataFrame, total: str, unanimous: str) -> DataFrame:
    """Entities without and with action, and without and with unanimous action."""
    return df.agg(*_aggregates(total, "no_action", "action"), *_aggregates(unanimous, "no_unanimous", "unanimous"))


def _aggregates(column: str, no: str, yes: str) -> list[Column]:
    test = F.col(column) > 0
    return [F.count(F.when(~test, 1)).alias(no), F.count(F.when(test, 1)).alias(yes)]


def ambivalent(
    df: DataFrame, total: str, unanimous: str, name: str, location: str, kind: Column,
    name_fills: Mapping[str, str], start_fixes: Mapping, start: str = "start_year", end: str = "end_year",
) -> DataFrame:
    """Entities acted on but never unanimously.

    Missing names are filled per location and the period is narrowed by a year
    on either side, with corrected starts for some names.
    """
    chosen = df.where(F.col(total) > 0).where(~(F.col(unanimous) > 0))
    named = chosen.withColumn("kind", kind).withColumn(name, fill_by_key(name, location, name_fills))
    begin = F.col(start) + 1
    for known, value in start_fixes.items():
        begin = replace_where(begin, F.col(name) == known, F.lit(value))
    return named.withColumns({"start": begin, "end": F.col(end) - 1})


def top_entities(
    df: DataFrame, severity: str, key: str, kind: Column, name: str, k: int = 15,
    name_fills: Mapping | None = None, start_fixes: Mapping | None = None, end_fixes: Mapping | None = None,
    start: str = "start_year", end: str = "end_year", tie: Sequence[str] = (),
) -> DataFrame:
    """The k most severe entities, with names and periods corrected by key."""
    top = top_k(df, severity, k, list(tie) or [key])
    begin, finish = F.col(start) + 1, F.col(end) - 1
    if start_fixes:
        begin = overwrite_by_key(begin, key, start_fixes)
    if end_fixes:
        finish = overwrite_by_key(finish, key, end_fixes)
    named = fill_by_key(name, key, name_fills) if name_fills else F.col(name)
    return top.withColumns({"kind": kind, name: named, "start": begin, "end": finish})


def severity_by_flag(
    df: DataFrame, severity: str, flag: str, breaks: Sequence[float], labels: Sequence[str]
) -> DataFrame:
    """Entities per severity bin and Yes/No flag."""
    counted = df.groupBy(
        cut(severity, breaks, labels).alias("category"), recode(flag, {0: "No", 1: "Yes"}).alias("flag")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_last("category"), F.asc_nulls_last("flag"))


def scatter(df: DataFrame, covariates: Sequence[str], weights: Mapping[str, str], width: Mapping[str, float]) -> DataFrame:
    """Point counts of (covariate, weight) pairs where the weight is positive.

    A plot of all rows does not scale, so each covariate is binned at the given
    width; the rows are unpivoted and counted in one aggregation.
    """
    reports = F.array(*[F.struct(F.lit(r).alias("report"), F.col(w).alias("weight")) for r, w in weights.items()])
    points = F.array(*[
        F.struct(F.lit(c).alias("covariate"), F.floor(F.col(c) / F.lit(width[c])).cast("long").alias("bin"))
        for c in covariates
    ])
    long = df.select(points.alias("points"), F.inline(reports)).where("weight > 0")
    long = long.select("report", "weight", F.inline("points"))
    return long.groupBy("report", "covariate", "bin", "weight").agg(F.count(F.lit(1)).alias("n"))
