import json

from tablekit.plans.browse import (HeldPreview, browse_table, data_preview_json, describe_table)
from tablekit.functions.spec import Condition, View


def browse_df(spark):
    return spark.createDataFrame([(1, 4, 7, 10), (2, 5, 8, 11), (3, 6, 9, 12), (4, 7, 10, 13)],
                                 "col1 bigint, col2 bigint, col3 bigint, col4 bigint")


def test_browse_filter_sort_page(spark):
    spec = json.dumps({"filters": [{"column": "col2", "operator": "greater-than", "comparativeValues": ["4"]}],
                       "sortBy": [{"id": "col1", "type": "desc"}], "pageSize": 2, "pageIndex": 0})
    res = browse_table(browse_df(spark), spec)
    assert res.total == 3 and res.held == 3
    assert res.page == [{"col1": 4, "col2": 7, "col3": 10, "col4": 13}, {"col1": 3, "col2": 6, "col3": 9, "col4": 12}]
    last = browse_table(browse_df(spark), json.dumps({"pageSize": 3, "pageIndex": 9}))
    assert [r["col1"] for r in last.page] == [4]


def test_browse_empty(spark):
    empty = spark.createDataFrame([], "col1 double, col2 double")
    res = browse_table(empty, None)
    assert res.page == [] and res.total == 0


def test_describe_document(spark):
    doc = describe_table(browse_df(spark), '{"pageSize": 2}')
    assert doc["column_count"] == 4 and doc["row_count"] == 4 and len(doc["rows"]) == 2
    assert doc["columns"][0]["name"] == "col1" and doc["columns"][0]["stats"]["unique_count"] == 4
    assert doc["type"] == "dataframe"


def test_held_preview(spark):
    import datetime as dt
    df = spark.range(25_000).withColumnRenamed("id", "col1")
    with HeldPreview(df, most=10_000) as held:
        f = Condition("col1", "greater-than", ("100",))
        g = Condition("col1", "less-than", ("1e9",))
        held.show(View((f, g), (("col1", False),)))
        assert held.held == 10_000 and held.total == 24_899
        first = held.head
        held.show(View((g, f), (("col1", False),)))     # the same set: nothing is computed
        assert held.head is first
        page = held.rows(2, 5)
        assert [r["col1"] for r in page] == [24989, 24988, 24987, 24986, 24985]
        assert [r["row_index"] for r in page] == [10, 11, 12, 13, 14]
        assert [r["col1"] for r in held.rows(10**6, 5)][-1] == 24999 - 9999
        res = browse_table(df, {"pageSize": 3, "pageIndex": 1, "sortBy": [{"id": "col1", "type": "desc"}],
                                "filters": [{"column": "col1", "operator": "greater-than", "comparativeValues": ["100"]},
                                            {"column": "col1", "operator": "less-than", "comparativeValues": ["1e9"]}]},
                           preview=held)
        assert res.source == "data_preview" and [r["col1"] for r in res.page] == [24996, 24995, 24994]
        assert held.head is first
        assert held.column_stats()[0]["stats"]["unique_count"] == 24_899
        # another source or another day asks for other rows
        held.show(View((f, g), (("col1", False),)), source=df.filter("col1 < 500"))
        assert held.total == 399 and held.head is not first
    assert held.head is None
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5),), (dt.datetime(2024, 1, 2, 5),)], "t timestamp_ntz")
    today = View((Condition("t", "is-relative-today", ("today",)),))
    with HeldPreview(days) as held:
        assert "2024-01-01" in held.show(today, dt.date(2024, 1, 1)).rows(0, 5)[0]["t"]
        assert "2024-01-02" in held.show(today, dt.date(2024, 1, 2)).rows(0, 5)[0]["t"]


def test_wide_tables_sort_and_describe_all_columns(spark):
    df = spark.range(5).selectExpr("id AS c0", *[f"id * {k % 2 * 2 - 1} AS c{k}" for k in range(1, 601)])
    shown = browse_table(df, {"sortBy": [{"id": "c600", "type": "asc"}], "pageSize": 2})
    assert len(shown.page[0]) == 500 and [r["c0"] for r in shown.page] == [4, 3]
    assert len(shown.selected.columns) == 601


def test_preview_json_cut(spark):
    df = spark.range(5000).withColumnRenamed("id", "col1")
    full = json.loads(data_preview_json(df, "[]", "[]", mode="head", most=100))
    assert len(full) == 100 and full[0] == {"col1": 0, "row_index": 0}
    cut = json.loads(data_preview_json(df, "[]", '[["col1", false]]', mode="head", most=100, max_bytes=300))
    assert len(cut) < 100 and cut[0]["col1"] == 4999
    assert sum(len(json.dumps(r, separators=(",", ":"))) for r in cut) <= 300


def test_big_numbers_past_64_bits(spark, tmp_path):
    from tablekit.acceptance.browse_q import browse_table_big
    spark.range(8_999_990, 9_000_001).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    page = browse_table_big(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r["big"] for r in page] == [str(k * 9007199254740) for k in range(9_000_000, 8_999_990, -1)]
