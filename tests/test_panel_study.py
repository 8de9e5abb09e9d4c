"""The whole study on a small panel written out by hand."""

import pytest

from panelwright.plans import panel_study as ps

# id, place, year, severity, actions, unanimous, kind, issue, region, name, wealth, allies, soc_a, soc_b
ROWS = [
    (1, "A", 1950, 50.0, 0, 0, 3, 1, 1, "First", 1000.0, 1.0, 0.1, 1.0),
    (1, "A", 1951, 70.0, 2, 1, 4, 2, 2, "Later", 9000.0, 9.0, 0.9, 2.0),
    (2, "B", 1960, None, 1, 1, 2, 2, 3, None, 2116.0, None, 0.2, 3.0),
    (3, "C", 1946, 2000.0, 0, 0, 1, 3, 4, "Third", None, 10.0, None, 4.0),
    (3, "C", 1957, 10000.0, 0, 0, 1, 3, 4, "Third", 1.0, 2.0, 0.4, 5.0),
    (4, "A", 1970, 116.0, 3, 0, None, None, 5, None, 6000.0, 3.0, 0.5, 6.0),
    (4, "A", 1999, 9e9, 9, 9, 1, 1, 1, "cut off", 1.0, 1.0, 0.0, 0.0),
]
SCHEMA = (
    "entity_id long, location string, year int, severity double, actions int, unanimous int, kind int, issue int, "
    "region int, name string, wealth double, allies double, soc_a double, soc_b double"
)
ROLES = ps.Roles(first_prefixes=("soc_",), dropped=("soc_b",))


@pytest.fixture(scope="module")
def entity(spark):
    source = spark.createDataFrame(ROWS, SCHEMA)
    names = [c for c in source.columns if not c.startswith("soc_")]
    return ps.entity_table(ps.panel_table(source, names, ["soc_"], "year", 1992), ROLES).cache()


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_entities(entity):
    assert "soc_b" not in entity.columns and "soc_a" in entity.columns
    got = {r.entity_id: r for r in entity.collect()}
    assert (got[1].start_year, got[1].end_year, got[1].active_years, got[1].severity_total) == (1950, 1951, 1, 120.0)
    assert (got[1].kind, got[1].name, got[1].soc_a) == (3, "First", 0.1)
    assert got[2].severity_total is None and (got[2].action_flag, got[2].unanimous_flag) == (1, 1)
    assert got[3].active_years == 11 and got[4].active_years == 1 and got[4].total_actions == 3


def test_reports(entity):
    fixes = ps.Corrections({"A": "Named"}, {"Named": 1946}, {2: "Second"}, {3: 1800}, {4: 1900})
    tables = ps.report_tables(entity, ROLES, fixes)
    assert [tuple(r) for r in tables["totals"].collect()] == [(4, 6, 2)]
    assert [tuple(r) for r in tables["split"].collect()] == [(1, 3, 2, 2)]
    assert pairs(tables["ambivalent"], "entity_id", "name", "start", "end") == [(4, "Named", 1946, 1969)]
    assert pairs(tables["by_type"].where("level is not null"), "report", "level", "n") == [
        ("actions", "Internal", 2), ("actions", "Interstate", 1), ("entities", "Extrasystemic", 1),
        ("entities", "Internal", 1), ("entities", "Interstate", 1), ("unanimous", "Internal", 1), ("unanimous", "Interstate", 1),
    ]
    assert pairs(tables["by_type"].where("level is null"), "report", "n") == [("actions", 3), ("entities", 1)]
    assert pairs(tables["actions_by_severity"].where("report = 'actions'"), "ord", "n") == [(1, 1), (2, 5), (3, 0), (4, 0)]
    assert pairs(tables["actions_by_duration"].where("report = 'actions'"), "ord", "n") == [(1, 6), (2, 0)]
    assert pairs(tables["actions_by_allies"].where("report = 'actions' and n > 0"), "ord", "n") == [(1, 3), (3, 3)]
    assert pairs(tables["entities_by_wealth"], "n") == [(1,), (1,), (2,)]
    assert pairs(tables["severity_by_flag"].where("category is not null"), "category", "flag", "n") == [
        ("100-1000", "Yes", 2), ("greater than 5000", "No", 1)
    ]
    assert [(r.entity_id, r["name"], r.start, r.end) for r in tables["top"].collect()] == [
        (3, "Third", 1800, 1956), (1, "First", 1951, 1950), (4, None, 1971, 1900), (2, "Second", 1961, 1959)
    ]


def test_points_lists_and_model_table(entity):
    assert pairs(ps.scatter_points(entity, "soc_a", "total_actions"), "soc_a", "total_actions") == [(0.1, 2), (0.2, 1), (0.5, 3)]
    lists = ps.correlation_lists(entity, ["active_years", "severity_total", "soc_a"], 158, [1461050, 1200000])
    assert lists.count() == 4 * 2 * 2 * 3
    table = ps.model_table(entity, ROLES, ["severity_total", "soc_a", "active_years"])
    assert pairs(table, "id", "entity_id", "action", "unanimous_action") == [(1, 1, "Yes", "No"), (2, 4, "Yes", "No")]


def test_clusters(entity):
    elbow, label = ps.clusters(entity, "entity_id", ["severity_total", "active_years"], range(2, 4), 4)
    within = {r.nclust: r.within_ss for r in elbow.collect()}
    assert within[2] == pytest.approx(8.0) and within[3] == pytest.approx(0.0)
    assert label(2).count() == 3
