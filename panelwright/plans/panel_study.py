"""The complete study of a panel: entity table, reports, correlations, modelling table.

Columns are named by their role, so the study runs on any panel. Thresholds and
labels default to the fixed values in ``codes``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import if_known
from ..functions.recode import bands, below, recode
from ..operators import cluster, correlation
from ..operators.columns import complete_rows, is_complete, select_columns
from ..operators.order import add_row_id
from ..operators.rollup import action_flags, roll_up
from ..session import stage
from . import codes, reports

WEIGHTS = {reports.ACTIONS: "total_actions", reports.UNANIMOUS: "total_unanimous"}


@dataclass(frozen=True)
class Roles:
    """Panel column of each role.

    ``first_prefixes`` chooses further attributes of the first row by name;
    ``dropped`` are left out of them. Rows of one entity and time are put in order
    by ``ties``, then by the attributes themselves, so only equal rows are tied.
    """

    keys: tuple[str, str] = ("entity_id", "location")
    time: str = "year"
    severity: str = "severity"
    actions: str = "actions"
    unanimous: str = "unanimous"
    kind: str = "kind"
    issue: str = "issue"
    region: str = "region"
    name: str = "name"
    wealth: str = "wealth"
    allies: str = "allies"
    first: tuple[str, ...] = ()
    first_prefixes: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()


@dataclass
class Corrections:
    """Names and periods corrected by key or location."""

    names_by_location: Mapping[str, str] = field(default_factory=dict)
    starts_by_name: Mapping[str, int] = field(default_factory=dict)
    names_by_key: Mapping[int, str] = field(default_factory=dict)
    starts_by_key: Mapping[int, int] = field(default_factory=dict)
    ends_by_key: Mapping[int, int] = field(default_factory=dict)


def panel_table(source: DataFrame, names: Sequence[str], prefixes: Sequence[str], time: str, before: int) -> DataFrame:
    """Projection and cut-off year; both reach the scan of the source."""
    return select_columns(source, names, prefixes).where(F.col(time) < before)


def entity_table(panel: DataFrame, roles: Roles) -> DataFrame:
    """One row per entity, from one aggregation of the panel."""
    named = [roles.kind, roles.issue, roles.region, roles.name, roles.wealth, roles.allies, *roles.first]
    first = select_columns(panel, [c for c in named if c in panel.columns], roles.first_prefixes, roles.dropped).columns
    totals = {"severity_total": roles.severity, "total_actions": roles.actions, "total_unanimous": roles.unanimous}
    rolled = roll_up(panel, roles.keys, roles.time, totals, first, [*roles.ties, *[c for c in first if c not in roles.ties]])
    return rolled.withColumns(action_flags("total_actions", "total_unanimous"))


def report_tables(entity: DataFrame, roles: Roles, fixes: Corrections | None = None) -> dict[str, DataFrame]:
    """Every report as a lazy table. Stage the entity table before calling."""
    fixes = fixes or Corrections()
    key, location = roles.keys
    kind = recode(roles.kind, codes.TYPE_LABELS)
    labels = {
        "duration": (below("active_years", codes.DURATION_LIMIT, codes.DURATION_SHORT, codes.DURATION_LONG), codes.DURATION_ORDER),
        "severity": _ladder("severity_total", codes.SEVERITY_LADDER, codes.SEVERITY_LOWEST),
        "wealth": _ladder(roles.wealth, codes.WEALTH_LADDER, codes.WEALTH_LOWEST),
        "allies": _ladder(roles.allies, codes.LEVEL_LADDER, codes.LEVEL_LOWEST),
    }
    out = {
        "totals": reports.headline_totals(entity, {"sum_actions": "total_actions", "sum_unanimous": "total_unanimous"}),
        "split": reports.split_counts(entity, "total_actions", "total_unanimous"),
        "ambivalent": reports.ambivalent(
            entity, "total_actions", "total_unanimous", roles.name, location, kind,
            fixes.names_by_location, fixes.starts_by_name,
        ),
        "by_type": reports.breakdown(entity, kind, WEIGHTS),
        "by_issue": reports.breakdown(entity, recode(roles.issue, codes.ISSUE_LABELS), WEIGHTS),
        "by_region": reports.breakdown(entity, recode(roles.region, codes.REGION_LABELS), WEIGHTS),
        "entities_by_wealth": reports.count_by(entity, labels["wealth"][0]),
        "entities_by_allies": reports.count_by(entity, labels["allies"][0]),
        "severity_by_flag": reports.severity_by_flag(
            entity, "severity_total", "action_flag", codes.SEVERITY_BREAKS, codes.SEVERITY_BINS
        ),
        "top": reports.top_entities(
            entity, "severity_total", key, kind, roles.name, 15, fixes.names_by_key, fixes.starts_by_key,
            fixes.ends_by_key, tie=roles.keys,
        ),
    }
    for name, (label, levels) in labels.items():
        out[f"actions_by_{name}"] = reports.with_levels(reports.tally_by(entity, label, WEIGHTS), levels, list(WEIGHTS))
    return out


def _ladder(column: str, ladder: Sequence[tuple[float, str]], lowest: str):
    return bands(column, ladder, lowest), [lowest, *[label for _, label in reversed(ladder)]]


def scatter_points(entity: DataFrame, covariate: str, weight: str) -> DataFrame:
    """The points of one scatter plot: (covariate, weight) where the weight is positive."""
    return entity.where(F.col(weight) > 0).select(covariate, weight)


def correlation_lists(
    entity: DataFrame, terms: Sequence[str], few_actions: float, severity_limits: Sequence[float]
) -> DataFrame:
    """Correlations of all terms with both flags: the whole table and the
    populations without outliers, pairwise and listwise, in one scan."""
    populations = {"all": F.lit(True), f"actions < {few_actions:g}": F.col("total_actions") < few_actions}
    populations |= {f"severity < {limit:g}": F.col("severity_total") < limit for limit in severity_limits}
    return correlation.correlate(
        entity, ["action_flag", "unanimous_flag"], terms, populations, [correlation.PAIRWISE, correlation.LISTWISE]
    )


def model_table(entity: DataFrame, roles: Roles, columns: Sequence[str]) -> DataFrame:
    """Complete rows of the chosen columns with Yes/No outcomes and a row id."""
    chosen = list(dict.fromkeys([*roles.keys, *columns, "action_flag", "unanimous_flag"]))
    table = complete_rows(entity.select(chosen))
    label = lambda flag: if_known(F.col(flag) == 0, F.lit("No"), F.lit("Yes"))
    table = table.withColumns({"action": label("action_flag"), "unanimous_action": label("unanimous_flag")})
    return add_row_id(table, roles.keys)


def clusters(entity: DataFrame, row_id: str, columns: Sequence[str], counts: Sequence[int] = range(2, 7), starts: int = 20):
    """(within-cluster sums per count, function labelling the rows for a count)."""
    table = stage(entity.where(is_complete(columns)).select(row_id, *columns), "cluster")
    best = cluster.cluster_grid(table, row_id, columns, counts, starts)
    elbow = entity.sparkSession.createDataFrame([(k, c.within) for k, c in best.items()], "nclust int, within_ss double")
    return elbow, lambda k: cluster.assign(table, columns, best[k].centres).drop("distance2")
