"""Whole texts are not shuffled to meet the few keys of rows that go."""

import pytest

from panelwright.llm import decontaminate, groups, minhash

from .test_edges import prose, table

SMALL = "spark.sql.autoBroadcastJoinThreshold"
ROWS = [(i, prose(i % 7, 40) + (" end" if i > 9 else "")) for i in range(14)] + [(20, None), (21, None), (None, prose(3, 40))]


@pytest.fixture
def nothing_small(spark):
    """Spark's own size check broadcasts no table, as on large ones."""
    before = spark.conf.get(SMALL)
    spark.conf.set(SMALL, "-1")
    yield
    spark.conf.set(SMALL, before)


def moves(df):
    return "hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in df.collect())


@pytest.mark.parametrize("limit", [groups.KEYS_BYTES, 0])
def test_near_duplicates_go(spark, nothing_small, monkeypatch, limit):
    monkeypatch.setattr(groups, "KEYS_BYTES", limit)
    left = minhash.drop_near_duplicates(table(spark, ROWS))
    assert moves(left) == (limit == 0)
    assert ids(left) == [-1, 0, 1, 2, 3, 4, 5, 6, 20, 21]


@pytest.mark.parametrize("limit", [groups.KEYS_BYTES, 0])
def test_contaminated_rows_go(spark, nothing_small, monkeypatch, limit):
    monkeypatch.setattr(groups, "KEYS_BYTES", limit)
    items = spark.createDataFrame([(0, prose(3, 40)), (1, prose(5, 12))], "item_id long, text string")
    left = decontaminate.remove_contaminated(table(spark, ROWS), items)
    assert moves(left) == (limit == 0)
    assert ids(left) == [0, 1, 2, 4, 6, 7, 8, 9, 11, 13, 20, 21]
