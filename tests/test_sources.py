from panelwright.session import new_path, stage
from panelwright.sources.csv import drop_index, read_csv, with_index, write_csv


def test_csv_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(',x,s\n1,NA,a\n2,,NA\n3,2.5,""\n4,NaN,d\n')
    df = read_csv(spark, str(path))
    assert df.columns == ["_c0", "x", "s"]
    got = [(r.x, r.s) for r in df.orderBy("_c0").collect()]
    assert [g[0] for g in got] == [None, None, 2.5, None]
    assert got[0][1] == "a" and got[1][1] is None and got[3][1] == "d"
    assert drop_index(df).columns == ["x", "s"]


def test_csv_roundtrip_with_index(spark):
    df = spark.createDataFrame([(3, 'say "hi", ok', 0.1), (1, None, None), (2, "NAx", -1e-17)], "k int, s string, x double")
    path = new_path(spark, "csv")
    write_csv(df, path, index_order=["k"])
    back = read_csv(spark, path, with_index(df.schema))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 1, None, None), (2, 2, "NAx", -1e-17), (3, 3, 'say "hi", ok', 0.1)]


def test_staged_table_is_read_from_files(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as g")
    staged = stage(df)
    assert staged.inputFiles() and sorted(staged.collect()) == sorted(df.collect())
    assert staged.schema == df.schema or [f.name for f in staged.schema] == df.columns


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    from panelwright.sources.csv import read_csv, write_csv

    path = tmp_path / "quoted.csv"
    path.write_text('name,n\n"the ""Front"" party",1\n"two\nlines",2\nNA,3\n')
    got = {r.n: r.name for r in read_csv(spark, str(path), line_breaks=True).collect()}
    assert got == {1: 'the "Front" party', 2: "two\nlines", 3: None}
    out = str(tmp_path / "again")
    rows = [('a "b", c', 1), ("back\\slash", 2), (None, 3)]
    write_csv(spark.createDataFrame(rows, "name string, n int"), out)
    assert sorted((r.n, r.name) for r in read_csv(spark, out).collect()) == sorted((n, v) for v, n in rows)
    raw = "".join(p.read_text() for p in (tmp_path / "again").glob("part-*"))
    assert '"a ""b"", c"' in raw


def test_levels_in_order_of_appearance(spark, tmp_path):
    """The order in the file counts, however the file is cut."""
    from panelwright.operators.columns import index_by_appearance
    from panelwright.sources.csv import PLACE, read_csv

    levels = ["pear", "fig", "apple", "fig", "NA", "plum", "pear", "date"] * 40
    (tmp_path / "f.csv").write_text("name,n\n" + "".join(f"{v},{i}\n" for i, v in enumerate(levels)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = read_csv(spark, str(tmp_path / "f.csv"), place=True)
        assert df.rdd.getNumPartitions() > 4
        got = {r.n: r.code for r in index_by_appearance(df.repartition(5, "n"), "name", "code", PLACE).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    order = ["pear", "fig", "apple", "plum", "date"]
    assert got == {i: None if v == "NA" else order.index(v) for i, v in enumerate(levels)}
