"""Page indexes, their store, paged views; every type on every paged path."""

import pytest
from pyspark.sql import functions as F

from tablekit.operators import shape
from tablekit.operators.shape import PageIndex, paginate, sample_n, sort_for_files, with_row_index
from tablekit.plans.browse import HeldPreview, PagedView, PageStore, browse_page, browse_table, data_preview_json

SF = "/root/testdata/sf0.01"
SPEC = {"sortBy": [{"id": "l_quantity", "type": "desc"}, {"id": "l_shipdate", "type": "asc"}], "pageSize": 40}


def jobs(spark, name, fn):
    """A function's result and the number of jobs it ran."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = fn()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(name))


def test_second_page_is_one_job_over_one_range(spark, monkeypatch):
    monkeypatch.setattr(shape, "RANGE_ROWS", 6000)
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    view = PagedView(li, SPEC)
    assert len(view.index.counts) >= 10 and view.total == sum(view.index.counts) == li.count()
    assert max(view.index.counts) < 2 * 6000
    first = view.rows(0)
    second, n = jobs(spark, "second", lambda: view.rows(700))
    assert n == 1
    with monkeypatch.context() as m:
        m.setattr(shape, "RANGE_ROWS", 200_000)
        assert first == browse_table(li, SPEC).page
        assert second == browse_table(li, SPEC | {"pageIndex": 700}).page == PagedView(li, SPEC).rows(700)
    plan = view.frame(700)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 1 and "l_quantity" in plan.split("Filter", 1)[1]


def test_pages_of_an_index_give_every_row_once(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"),
                                  F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 11).alias("f")).repartition(4).cache()
    for keys in ([("k", True)], [("s", False), ("k", True)], [("f", False), ("s", True)], []):
        index = PageIndex(df, keys, ranges=13)
        assert len(index.counts) > 8
        got = [r.id for p in range(10) for r in index.page(p, 500).collect()]
        assert sorted(got) == list(range(5000))
        for p in (0, 3, 9, 50):
            some = lambda page: [(r["at"], r.id) for r in page.collect()]
            assert some(index.page(p, 500, "at")) == some(paginate(df, p, 500, keys, total=5000, index_col="at"))
        numbered = {r.at: r.id for r in index.row_index("at").collect()}
        assert [numbered[i] for i in range(5000)] == got


def test_index_of_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "a int")
    assert PageIndex(empty, [("a", True)]).page(3, 10).collect() == [] and PageIndex(empty).total == 0
    assert with_row_index(empty, [("a", True)]).collect() == []
    one = spark.createDataFrame([(None,)], "a int")
    assert PageIndex(one, [("a", False)], ranges=5).page(0, 10, "at").collect() == [(None, 0)]


def test_stored_index_is_reused_until_a_file_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shape, "RANGE_ROWS", 500)
    path = str(tmp_path / "in")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.filter("o_orderkey % 4 = 0").repartition(2).write.parquet(path)
    spec = {"sortBy": [{"id": "o_orderdate", "type": "desc"}, {"id": "o_totalprice", "type": "asc"}]}
    store = PageStore(spark, str(tmp_path / "pages"))
    read = lambda: spark.read.parquet(path)
    made = []
    real = shape._bounds
    monkeypatch.setattr(shape, "_bounds", lambda *a: made.append(1) or real(*a))
    one = PagedView(read(), spec, store=store)
    again = PagedView(read(), spec, store=store)
    assert len(made) == 1 and one.index.parts == again.index.parts and len(one.index.counts) > 3
    assert one.rows(50) == again.rows(50)
    orders.filter("o_orderkey % 4 = 1").repartition(2).write.mode("append").parquet(path)
    other = PagedView(read(), spec, store=store)
    assert len(made) == 2 and other.total == orders.filter("o_orderkey % 4 < 2").count()
    assert PagedView(read(), {"sortBy": [{"id": "o_orderdate", "type": "asc"}]}, store=store).total == other.total and len(made) == 3


def every_type(spark, n=60):
    df = spark.range(n).selectExpr(
        "id", "CAST(id % 7 AS TINYINT) AS t", "CAST(id AS DECIMAL(38, 10)) AS d", "CAST(id AS FLOAT) / 3 AS f", "id % 2 = 0 AS b",
        "CAST(CAST(id AS STRING) AS BINARY) AS bin", "DATE_ADD(DATE'2020-01-01', CAST(id AS INT)) AS day",
        "TIMESTAMP'2020-01-01' + MAKE_DT_INTERVAL(0, 0, 0, id) AS ts", "TIMESTAMP_NTZ'2020-01-01 00:00:00' AS ntz",
        "MAKE_DT_INTERVAL(0, 0, id) AS dti", "MAKE_YM_INTERVAL(0, CAST(id AS INT)) AS ymi", "MAKE_INTERVAL(0, 0, 0, CAST(id AS INT)) AS cal",
        "ARRAY(id, NULL) AS arr", "MAP('k', id) AS m", "STRUCT(id AS x, 'y' AS y) AS st", "PARSE_JSON(CONCAT('{\"a\": ', id, '}')) AS v",
        "ARRAY(PARSE_JSON('[1]')) AS va", "STRUCT(PARSE_JSON('1') AS v) AS vs", "MAP('k', PARSE_JSON('{}')) AS vm", "NULL AS nothing",
        "CONCAT('s', id) AS s")
    return df.repartition(3)


def test_every_type_can_be_paged_and_sampled(spark):
    df = every_type(spark)
    # Python has no value for these two: they take part, but are not fetched
    fetched = lambda page: page.drop("ymi", "cal").collect()
    rows = fetched(paginate(df, 2, 10, [("t", False), ("s", True)], index_col="at"))
    assert len(rows) == 10 and [r["at"] for r in rows] == list(range(20, 30))
    assert with_row_index(df, [("t", True)], ranges=4).select("id", "row_index").distinct().count() == 60
    assert PageIndex(df, [("t", True)], ranges=4).page(1, 7).count() == 7
    page = browse_page(df, {"sortBy": [{"id": "t", "type": "asc"}], "pageSize": 5}).collect()
    assert len(page) == 5
    assert len(browse_table(df, {"sortBy": [{"id": "t", "type": "asc"}], "pageSize": 5}).page) == 5
    with HeldPreview(df, most=20) as held:
        held.show({"sortBy": [{"id": "t", "type": "asc"}]})
        assert len(held.rows(0, 50)) == 20
    assert len(fetched(sample_n(df, 9, seed=3))) == 9
    assert data_preview_json(df, "[]", '[["t", true]]', 15, "sampled").count('"id"') >= 15


def test_sample_is_the_same_for_any_layout(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    want = sorted(map(str, sample_n(li, 50, seed=5).collect()))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        assert sorted(map(str, sample_n(spark.read.parquet(f"{SF}/lineitem.parquet"), 50, seed=5).collect())) == want
    finally:
        spark.conf.set(key, before)
    assert sorted(map(str, sample_n(li.repartition(7), 50, seed=5).collect())) == want
    assert sorted(map(str, sample_n(li, 50, seed=6).collect())) != want


def test_copies_of_a_row_are_sampled_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(shape, "COPIES_AT_ONCE", 100)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    got = [r.v for r in sample_n(df.repartition(5), 3000, seed=1).collect()]
    assert len(got) == 3000 and 900 < got.count(-1) < 1100 and len(set(got)) == 3001 - got.count(-1)
    assert sorted(got) == sorted(r.v for r in sample_n(df, 3000, seed=1).collect())
    assert sample_n(df, 1).count() == 1 and sample_n(df, 29_999).count() == 29_999 and sample_n(df, 10 ** 6).count() == 30_000
    plan = sample_n(df, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan      # no task holds all copies


def test_a_hot_sort_value_spreads_over_files(spark, tmp_path):
    from tablekit.functions.spec import View
    from tablekit.sources.io import export_table
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id") % 1000).alias("k"), "id").repartition(6)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        sizes = sort_for_files(df, [("k", False)]).groupBy(F.spark_partition_id()).count().collect()
        path = export_table(df, View(order=(("k", False),)), str(tmp_path / "out"))
    finally:
        spark.conf.unset(key)
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1.3 * 15_000
    files = sorted((tmp_path / "out").glob("part-*"))
    got = [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert len(files) == 4 and len(got) == 60_000 and got == sorted(got, reverse=True) and path
    assert sort_for_files(df, []) is df


def test_distinct_values_keeps_a_bounded_set_per_task(spark):
    from tablekit.operators.profile import distinct_values, smallest_per_task
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("n"), F.concat(F.lit("é"), F.col("id")).alias("s"),
                                    (F.col("id") % 2 == 0).alias("b"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(-F.col("id") / 7).alias("f")).repartition(6)
    few = smallest_per_task(df, ["n", "s", "f"], 10)
    assert few.count() <= 60
    got = {}
    for r in distinct_values(df, ["n", "s", "b", "f"], 10).collect():
        got.setdefault(r.column_name, {})[r["rank"]] = r.value
    assert [int(v) for _, v in sorted(got["n"].items())] == list(range(10))
    assert [v for _, v in sorted(got["s"].items())] == sorted((f"é{i}" for i in range(50_000)))[:10]
    assert [v for _, v in sorted(got["b"].items())] == ["false", "true"]
    assert [float(v) for _, v in sorted(got["f"].items())] == sorted(-i / 7 for i in range(1, 50_000, 2))[:10]
    plan = distinct_values(df, ["n", "s"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("MapInArrow") if "MapInArrow" in plan else False


def test_distinct_values_of_every_type(spark):
    from tablekit.operators.profile import distinct_values
    df = every_type(spark, 9)
    names = [n for n, t in df.dtypes if not any(x in t for x in ("variant", "void", "interval year", "map")) and t != "interval"]
    got = {}
    for r in distinct_values(df.unionByName(df), names, 4).collect():
        got.setdefault(r.column_name, []).append((r["rank"], r.value))
    assert {n: len(v) for n, v in got.items()} == {n: 2 if n == "b" else 1 if n == "ntz" else 4 for n in names}
    assert sorted(got["dti"])[0][1].startswith("INTERVAL") and sorted(got["d"])[1][1] == "1.0000000000"


@pytest.mark.parametrize("ranges", [1, 2, 3, 7, 64, 500])
def test_range_numbers_follow_the_order(spark, ranges):
    df = spark.range(2000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 50).alias("a"), (F.col("id") * 31 % 17).cast("string").alias("b"), "id")
    index = PageIndex(df, [("a", False), ("b", True)], ranges=ranges)
    rows = index.numbered().collect()
    at = {r.id: r[shape.RANGE] for r in rows}
    order = [r.id for p in range(4) for r in paginate(df, p, 500, [("a", False), ("b", True)], total=2000).collect()]
    numbers = [at[i] for i in order]
    assert numbers == sorted(numbers) and sum(index.counts) == 2000


@pytest.mark.parametrize("mode", ["head", "sampled"])
def test_preview_follows_its_files(spark, tmp_path, mode):
    from tablekit.operators.profile import analyze_columns
    from tablekit.plans.browse import FollowedPreview
    path = str(tmp_path / "in")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.filter("o_orderkey % 4 = 0").repartition(2).write.parquet(path)
    spec = {"sortBy": [{"id": "o_orderdate", "type": "desc"}, {"id": "o_totalprice", "type": "asc"}]}
    with FollowedPreview(spark, path, spec, most=300, mode=mode) as preview:
        assert len(preview.refresh().read) == 2 and preview.refresh().read == []
        orders.filter("o_orderkey % 4 = 1").coalesce(1).write.mode("append").parquet(path)
        preview.refresh()
        assert len(preview.read) == 1      # the added file only
        with FollowedPreview(spark, path, spec, most=300, mode=mode) as anew:
            anew.refresh()
            assert len(anew.read) == 3 and preview.total == anew.total == orders.filter("o_orderkey % 4 < 2").count()
            assert preview.frame().collect() == anew.frame().collect() and preview.held == 300
            assert preview.rows(7, 40) == anew.rows(7, 40) and len(preview.rows(99, 40)) == 20
        stats = {r.column_name: r for r in preview.column_stats().collect()}
        exact = {r.column_name: r for r in analyze_columns(spark.read.parquet(path)).collect()}
        assert all((stats[c].nan_count, stats[c].min, stats[c].max) == (e.nan_count, e.min, e.max) for c, e in exact.items())
        # a file goes: everything is read again
        next((tmp_path / "in").glob("*.parquet")).unlink()
        assert len(preview.refresh().read) == 2 and preview.total == spark.read.parquet(path).count()


def test_preview_of_no_files(spark, tmp_path):
    from tablekit.plans.browse import FollowedPreview
    (tmp_path / "in").mkdir()
    with FollowedPreview(spark, str(tmp_path / "in"), {"sortBy": []}) as preview:
        assert preview.refresh().total == 0 and preview.frame().collect() == [] and preview.column_stats().count() == 0
        spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert preview.refresh().total == 5 and preview.frame().count() == 5


def test_large_pages_are_not_limits(spark, monkeypatch):
    # a limit reads the whole page in one task
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("s"), "id").repartition(3).cache()
    keys = [("k", False), ("s", True)]
    whole = [r.id for r in paginate(df, 0, 6000, keys, total=6000).collect()]
    monkeypatch.setattr(shape, "RANGE_ROWS", 900)
    for p in (1, 7):
        page, start = paginate(df, p, 2500, keys, total=6000), 2500 * min(p, 2)
        assert "Limit" not in page._jdf.queryExecution().optimizedPlan().toString()
        assert [r.id for r in page.collect()] == whole[start:start + 2500]
    assert [r.id for r in shape.first_rows(df, keys, 1500).collect()] == whole[:1500]
