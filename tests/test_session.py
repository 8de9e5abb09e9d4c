"""Staged tables: where they lie, and that nothing uses a machine's own temporary folder."""

import pathlib

import panelwright
from panelwright import session


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = session.stage(spark.range(5), "five")
    folder = session.shared_folder(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert base.removeprefix("file:").lstrip("/") in folder
    assert all(f.startswith(folder.replace("file:/", "file:///")) for f in df.inputFiles()) and df.count() == 5
    session.drop_path(spark, df.inputFiles()[0].rsplit("/", 1)[0])


def test_no_machine_local_temporary_folder():
    root = pathlib.Path(panelwright.__file__).parent
    assert not [p for p in root.rglob("*.py") if "tempfile" in p.read_text()]
