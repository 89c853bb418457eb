import pandas as pd
import pytest

from tablekit.operators.chart import (ChartError, chart_aggregate, chart_output_metadata, chart_row_cap,
                                      chart_select_fields, used_fields)
from tablekit.sources.io import (ExportTooLargeError, UnsupportedDataFrameError, export_table, jdbc_options,
                                 table_from_native)


def test_fields_and_verify(spark):
    spec = {"layer": [{"encoding": {"x": {"field": "date\\.time"}, "y": {"field": "COUNT(*)"}}},
                      {"layer": [{"encoding": {"color": {"field": "Percentage of y"}, "size": {"value": 3}}}]}]}
    assert used_fields(spec) == {"date.time", "COUNT(*)", "Percentage of y"}
    df = spark.createDataFrame([(1, 2, 3)], "`date.time` bigint, y bigint, z bigint")
    assert chart_select_fields(df, spec).columns == ["date.time"]
    with pytest.raises(ChartError):
        chart_select_fields(df, {"encoding": {"x": {"field": "nope"}}})


def test_row_cap_and_metadata(spark):
    df = spark.range(6000).selectExpr("id AS x", "id * 2 AS y")
    capped, exceeded = chart_row_cap(df)
    assert exceeded and capped.count() == 5000
    _, small = chart_row_cap(df.limit(10))
    assert not small
    meta = chart_output_metadata(df.limit(40))
    assert meta["filteredDataframeSize"] == 40 and meta["rowLimit"] == 5000
    assert meta["columns"][0]["name"] == "x" and len(meta["columns"][0]["distinctValues"]) == 30


def test_percentage(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    got = {r["k"]: r["Percentage of COUNT(*)"] for r in chart_aggregate(df, ["k"], "Percentage of COUNT(*)").collect()}
    assert got == {"a": 50.0, "b": 25.0, "c": 25.0}


def test_native_tables(spark):
    pdf = pd.DataFrame({"a": [1, 2]})
    assert table_from_native(pdf, spark).count() == 2
    with pytest.raises(UnsupportedDataFrameError):
        table_from_native([1, 2, 3])


def test_jdbc_options():
    o = jdbc_options("jdbc:postgresql://db/x", query="SELECT * FROM t", partition_column="id", lower_bound=0,
                     upper_bound=1000, num_partitions=8)
    assert o["dbtable"] == "(SELECT * FROM t) tk_q" and o["numPartitions"] == "8" and "query" not in o
    assert jdbc_options("jdbc:x", table="t")["dbtable"] == "t"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x")


def test_export_refuses_large(spark, tmp_path):
    df = spark.range(1000)
    with pytest.raises(ExportTooLargeError):
        export_table(df, None, str(tmp_path / "out"), max_bytes=100)
    path = export_table(df, {"filters": [{"column": "id", "operator": "less-than", "comparativeValues": [10]}]},
                        str(tmp_path / "ok"))
    assert spark.read.option("header", True).csv(path).count() == 10


def test_wall_clock_results_do_not_depend_on_session_zone(spark):
    import datetime as dt
    from tablekit.operators.chart import time_unit
    from tablekit.operators.profile import Profile
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1),), (dt.datetime(2024, 1, 31, 23),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        results = []
        for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            months = sorted(r[0] for r in df.select(time_unit(df, "t", "yearmonth")).collect())
            starts = [r["bin_start"] for r in Profile(df).histograms().orderBy("bin").collect()]
            results.append((months, starts))
        assert results[0] == results[1] == results[2]
        assert results[0][0] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)]
        assert results[0][1][0] == (dt.datetime(2024, 1, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_documents_are_json_serialisable(spark):
    import datetime as dt
    import json
    from tablekit.plans.browse import describe_table
    df = spark.createDataFrame(
        [(1, 2.5, "a", True, dt.datetime(2024, 1, 1), [1, 2], bytearray(b"\x00x"), None),
         (2, float("nan"), None, False, None, None, None, 2 ** 60)],
        "i bigint, f double, s string, b boolean, t timestamp_ntz, a array<int>, bin binary, big bigint")
    doc = describe_table(df, '{"pageSize": 5}')
    text = json.dumps(doc, allow_nan=True)
    assert '"row_count": 2' in text and doc["rows"][0]["bin"] == repr(b"\x00x")
    assert doc["rows"][0]["big"] is None or isinstance(doc["rows"][0]["big"], str)   # 2^60 column became text
    meta = chart_output_metadata(df.select("i", "s", "t"))
    assert json.loads(json.dumps(meta))["filteredDataframeSize"] == 2


def test_fields_of_every_composition(spark):
    spec = {"hconcat": [{"facet": {"field": "f", "type": "nominal"}, "spec": {"encoding": {"x": {"field": "a"}}}},
                        {"vconcat": [{"encoding": {"row": {"field": "r\\\\\\.x"}, "y": {"field": {"repeat": "row"}}}}]}]}
    assert used_fields(spec) == {"f", "a", "r\\.x"}
    assert used_fields({"repeat": {"row": ["p", "q"]}, "spec": {"encoding": {"y": {"field": {"repeat": "row"}}}}}) == {"p", "q"}


def test_time_parts_and_zero_totals(spark):
    import datetime as dt
    from tablekit.operators.chart import time_unit
    df = spark.createDataFrame([(dt.datetime(2023, 12, 31, 5),), (dt.datetime(2024, 1, 1, 5),)], "t timestamp_ntz")
    part = lambda unit: [r[0] for r in df.select(time_unit(df, "t", unit)).collect()]
    assert part("month") == [12, 1] and part("day") == [0, 1] and part("hours") == [5, 5] and part("quarter") == [4, 1]
    with pytest.raises(ChartError):
        time_unit(df, "t", "week")
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    assert {r[1] for r in chart_aggregate(zero, ["k"], "Percentage of v").collect()} == {None}


def test_update_rules(spark):
    from tablekit.operators.edit import edit_update
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k int, `a.b` double, c string")
    new = spark.createDataFrame([(1, float("nan"), "z"), (2, 9.0, None)], "k int, `a.b` double, c string")
    assert sorted(map(tuple, edit_update(df, new, ["k"]).collect())) == [(1, 1.0, "z"), (2, 9.0, "y")]
    with pytest.raises(ValueError):
        edit_update(df, new.unionByName(new), ["k"])


def test_csv_size_is_what_is_written(spark, tmp_path):
    import glob
    from tablekit.functions.csv import csv_size
    from tablekit.sources.io import csv_export
    df = spark.createDataFrame([(1, " a ", [1, 2], bytearray(b"\x00'")), (2, 'q"\n,', None, None), (3, "", [], None)],
                               'i int, `odd,"name` string, l array<int>, b binary').coalesce(1)
    files = glob.glob(csv_export(df, str(tmp_path / "x")) + "/part-*")
    assert len(files) == 1 and csv_size(df) == len(open(files[0], "rb").read())


def test_wide_export_of_any_size(spark, monkeypatch):
    # its limit follows its rows: 1,000 bytes stand for the 1 GB that a larger table passes
    from tablekit.acceptance.io_q import export_wide
    monkeypatch.setattr(export_table, "__defaults__", (1000,))
    keys = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("(o_orderkey + 598) % 3 = 0").count()
    assert export_wide(spark, "/root/testdata/sf0.001").count() == keys > 0


def test_wide_export_is_packed_and_whole(spark, tmp_path, monkeypatch):
    import gzip
    from tablekit.acceptance import io_q
    monkeypatch.setattr(io_q, "scratch_path", lambda spark, kind: str(tmp_path / kind))
    got = sorted(map(tuple, io_q.export_wide(spark, "/root/testdata/sf0.001").collect()))
    keys = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
                  .filter("(o_orderkey + 598) % 3 = 0").select("o_orderkey").collect())
    assert got == [(k, k + 599) for k in keys]
    files = sorted((tmp_path / "export").glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()).decode() for f in files]
    # every column of every row is in the files, in order over them, in a fraction of the bytes
    header = ",".join(["o_orderkey", *(f"c{k}" for k in range(1, 600)), "rest"])
    assert {t.split("\n", 1)[0] for t in texts} == {header}
    assert [line for t in texts for line in t.splitlines()[1:]] == [
        ",".join(map(str, [*range(k, k + 600), 0])) for k in reversed(keys)]
    assert sum(f.stat().st_size for f in files) * 10 < sum(map(len, texts))


def test_packed_export_has_the_same_bytes(spark, tmp_path):
    import gzip
    from tablekit.sources.io import read_csv_export
    schema = 's string, l string, t timestamp_ntz, n bigint'
    df = spark.createDataFrame([(" a ", 'q"\n,', None, 1), ("", None, None, 2), (None, "\u00e9\r", None, None)], schema).coalesce(1)
    view = {"sortBy": [{"id": "n", "type": "asc"}]}
    plain = export_table(df, view, str(tmp_path / "plain"))
    packed = export_table(df, view, str(tmp_path / "packed"), compression="gzip")
    assert not list((tmp_path / "plain").glob("*.gz"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "plain").glob("part-*")))
    assert raw == b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "packed").glob("part-*.csv.gz")))
    assert sorted(map(str, read_csv_export(spark, packed, schema).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ExportTooLargeError):      # the limit is on the bytes unpacked
        export_table(df, view, str(tmp_path / "out"), max_bytes=len(raw) - 1, compression="gzip")
