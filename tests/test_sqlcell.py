import os

import pytest

from tablekit.plans.sqlcell import (READ_OR_WRITE, ALWAYS_WRITE, CACHE_DISABLED, SqlCellError, SqlWorkspace,
                                    cache_key, cached_sql, compile_template, is_single_select, run_template,
                                    spark_sql_cell, sql_on_tables)


def test_compile_template_forms():
    sql, args = compile_template("SELECT {{ cols | sqlsafe }} FROM {{ t | identifier }} WHERE a = {{ x }} "
                                 "AND b IN {{ ys | inclause }}", {"cols": "a, b", "t": "db.my`tab", "x": 5,
                                                                  "ys": [1, 2]})
    assert sql == "SELECT a, b FROM IDENTIFIER(:t) WHERE a = :x AND b IN (SELECT explode(:ys))"
    assert args == {"t": "`db`.`my``tab`", "x": 5, "ys": [1, 2]}
    with pytest.raises(SqlCellError):
        compile_template("SELECT {{ missing }}", {})


def test_values_stay_data(spark):
    evil = "x' OR '1'='1"
    df = run_template(spark, "SELECT * FROM VALUES ('a'), ('x') AS t(v) WHERE v = {{ v }}", {"v": evil})
    assert df.count() == 0


def test_in_list_50k(spark):
    keys = list(range(0, 100_000, 2))
    df = run_template(spark, "SELECT count(*) AS n FROM range(100000) WHERE id IN {{ keys | inclause }}",
                      {"keys": keys})
    assert df.first()["n"] == 50_000


def test_single_select():
    assert is_single_select("-- c\nSELECT 1;")
    assert is_single_select("WITH a AS (SELECT 1) SELECT * FROM a")
    assert is_single_select("SELECT ';' AS semi")
    assert not is_single_select("SELECT 1; SELECT 2")
    assert not is_single_select("CREATE TABLE t (a int)")
    assert not is_single_select("  ")


def test_only_queries_count_as_queries(spark):
    assert is_single_select("FROM range(3) SELECT id") and is_single_select("VALUES (1), (2)")
    assert is_single_select("SELECT * FROM t WHERE a = {{ x }} AND b IN {{ ys | inclause }}")
    for text in ("SELECT '--'; DELETE FROM t", "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a",
                 "FROM t INSERT INTO u SELECT * INSERT INTO v SELECT *", "DROP TABLE t", "INSERT INTO t VALUES (1)"):
        assert not is_single_select(text)


def test_views_of_the_user_stay(spark):
    from tablekit.plans.sqlcell import sql_on_tables
    spark.range(3).createOrReplaceTempView("tk_mine")
    try:
        assert sql_on_tables(spark, "SELECT count(*) AS n FROM tk_mine", {"tk_mine": spark.range(9)}).first().n == 9
        assert spark.table("tk_mine").count() == 3
        ws = SqlWorkspace(spark)
        ws.register_table("tk_mine", spark.range(5))
        ws.cell("tk_cell", "SELECT * FROM tk_mine")
        ws.drop()
        assert spark.table("tk_mine").count() == 3 and not spark.catalog.tableExists("tk_cell")
    finally:
        spark.catalog.dropTempView("tk_mine")


def test_cache_sees_changed_inputs(spark, tmp_path):
    root, path = str(tmp_path / "cache"), str(tmp_path / "t")
    q = "SELECT count(*) AS n, max(id) AS m FROM t"
    run = lambda df: cached_sql(spark, q, root=root, tables={"t": df})
    spark.range(10).write.parquet(path)
    assert run(spark.read.parquet(path)).df.first().n == 10
    assert run(spark.read.parquet(path)).status == "read_from_cache"
    spark.range(20).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    out = run(spark.read.parquet(path))
    assert out.status == "written_to_cache" and out.df.first().n == 20
    assert run(spark.range(99)).df.first().n == 99
    big = cached_sql(spark, "SELECT 9007199254740993L AS x", root=root)
    assert big.df.dtypes == [("x", "bigint")] and big.df.first().x == 2**53 + 1     # one type in every mode
    assert cached_sql(spark, "SELECT NULL AS x", root=root).status == "not_cached"
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        cached_sql(spark, "SELECT 1 / (id - id) AS x FROM range(3)", root=root)


def test_cache_modes(spark, tmp_path):
    root = str(tmp_path / "cache")
    q = "SELECT id FROM range(10) WHERE id < {{ n }}"
    first = cached_sql(spark, q, {"n": 5}, READ_OR_WRITE, root=root)
    assert first.status == "written_to_cache" and first.df.count() == 5
    assert os.path.exists(os.path.join(first.path, "_SUCCESS"))
    hit = cached_sql(spark, q, {"n": 5}, READ_OR_WRITE, root=root)
    assert hit.status == "read_from_cache" and hit.path == first.path
    other = cached_sql(spark, q, {"n": 6}, READ_OR_WRITE, root=root)
    assert other.status == "written_to_cache" and other.path != first.path and other.df.count() == 6
    again = cached_sql(spark, q, {"n": 5}, ALWAYS_WRITE, root=root)
    assert again.status == "written_to_cache"
    assert cached_sql(spark, q, {"n": 5}, CACHE_DISABLED, root=root).status == "not_cached"
    assert cached_sql(spark, "SHOW TABLES", {}, READ_OR_WRITE, root=root).status == "cache_not_supported"
    tiny = cached_sql(spark, q, {"n": 7}, READ_OR_WRITE, root=root, max_bytes=1)
    assert tiny.status == "not_cached" and tiny.df.count() == 7
    # a separator keeps query and parameters apart
    assert cache_key("a", {"b": 1}) != cache_key("a{", {"b": 1})


def test_chained_diamond_and_preview(spark):
    ws = SqlWorkspace(spark)
    ws.register_table("tk_t", spark.range(500))
    ws.cell("tk_c", "SELECT id FROM tk_t WHERE id % 2 = 0", return_type="query_preview")
    ws.cell("tk_b", "SELECT id FROM tk_c WHERE id < 300", return_type="query_preview")
    q = ws.cell("tk_q", "WITH x AS (SELECT * FROM tk_b) SELECT count(*) AS n FROM x JOIN tk_c USING (id)",
                return_type="query_preview")
    assert q.full.first()["n"] == 150
    big = ws.previews["tk_c"]
    assert big.full.count() == 250 and big.preview.count() == 100     # chaining uses the full result
    with pytest.raises(SqlCellError):
        ws.cell("bad", "SELECT 1; SELECT 2", return_type="query_preview")
    assert ws.cell(None, "  -- only a comment  ") is None
    ws.drop()


def test_spark_sql_cell(spark):
    df = spark_sql_cell(spark, "SELECT {n} AS v", {"n": 3}, keep="now", view="tk_v")
    assert spark.sql("SELECT v FROM tk_v").first()["v"] == 3 and df.is_cached
    spark.catalog.dropTempView("tk_v")
    with pytest.raises(NameError):
        spark_sql_cell(spark, "SELECT {nope}", {})
    with pytest.raises(RuntimeError):
        spark_sql_cell(None, "SELECT 1")


def test_cache_defaults_to_the_shared_folder(spark):
    from tablekit.session import shared_root
    out = cached_sql(spark, "SELECT 42 AS answer", {}, READ_OR_WRITE)
    assert out.status in ("written_to_cache", "read_from_cache")
    assert out.path.startswith(shared_root(spark).rstrip("/")) and out.df.first()["answer"] == 42


def test_braces_that_are_not_places(spark):
    src = spark.range(3)
    one = lambda text, **names: spark_sql_cell(spark, text, names).collect()
    assert one("SELECT get_json_object('{\"a\": 1}', '$.a') AS x")[0].x == "1"
    assert one("SELECT count(*) AS n FROM {src} WHERE CAST(id + 100 AS STRING) RLIKE '^[0-9]{3}$'", src=src)[0].n == 3
    assert one("SELECT '}{ {} { x} {1,2} {{' AS s")[0].s == "}{ {} { x} {1,2} {{"
    assert one("SELECT '{ \"k\": {\"m\": [1]} }' AS s, max({src.id}) AS m FROM {src}", src=src)[0] == ('{ "k": {"m": [1]} }', 2)
    assert one("SELECT id FROM {src} WHERE id = {n}", src=src, n=2)[0].id == 2
    with pytest.raises(NameError, match="nowhere"):
        spark_sql_cell(spark, "SELECT '{\"a\": 1}' FROM {nowhere}", {})


def test_list_ranges():
    import datetime as dt

    from tablekit.plans.sqlcell import list_ranges
    assert list_ranges([5, 1, 2, 900, 901]) == [(1, 1), (2, 2), (5, 5), (900, 900), (901, 901)]
    some = [*range(100), *range(5000, 5100), 10 ** 12]
    found = list_ranges(some, 3)
    assert found == [(0, 99), (5000, 5099), (10 ** 12, 10 ** 12)]
    words = [f"w{k:03d}" for k in range(100)] + ["é", "\U0001f600", "￿"]
    assert all(any(a.encode() <= w.encode() <= b.encode() for a, b in list_ranges(words)) for w in words)
    assert list_ranges([dt.date(2020, 1, 1), dt.date(2020, 1, 2)], 1) == [(dt.date(2020, 1, 1), dt.date(2020, 1, 2))]
    for odd in ([], [None, 1], [1, "1"], [True, False], [float("nan"), 1.0], [dt.date(2020, 1, 1), dt.datetime(2020, 1, 1)]):
        assert list_ranges(odd) == []


def test_list_ranges_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CONCAT('k', id) AS s", "IF(id % 3 = 0, NULL, id) AS n").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    pushed = lambda df: df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("]")[0]
    df = run_template(spark, "SELECT id FROM t WHERE id IN {{ xs | inclause }}", {"xs": list(range(0, 200, 3)) + [990]}, {"t": t})
    assert "GreaterThanOrEqual(id," in pushed(df) and sorted(r.id for r in df.collect()) == [*range(0, 200, 3), 990]
    # the same truth value everywhere: nulls, NOT, OR, expressions, texts
    for where in ("n IN {}", "NOT n IN {}", "NOT (n IN {})", "(n IN {}) IS NULL", "n + 1 IN {}", "id > 900 OR n IN {} AND id < 50",
                  "CASE WHEN n IN {} THEN true ELSE n IS NULL END"):
        xs, text = [4, 7, 8, 500, 501], f"SELECT id FROM t WHERE {where.format('{{ xs | inclause }}')}"
        got = run_template(spark, text, {"xs": xs}, {"t": t})
        sql, args = compile_template(text, {"xs": xs})
        assert sorted(got.collect()) == sorted(sql_on_tables(spark, sql, {"t": t}, args).collect()), where
    words = run_template(spark, "SELECT id FROM t WHERE t.s IN {{ xs | inclause }}", {"xs": ["k1", "k10", "nothing"]}, {"t": t})
    assert "(s,k1)" in pushed(words) and sorted(r.id for r in words.collect()) == [1, 10]


def test_cache_misses_when_one_of_many_files_changes(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(1001):
        (folder / f"f{k}.txt").write_text("7")
    run = lambda: cached_sql(spark, "SELECT CAST(sum(CAST(value AS INT)) AS BIGINT) AS n FROM t",
                             tables={"t": spark.read.text(str(folder))}, root=str(tmp_path / "cache"))
    first, again = run(), run()
    assert (first.status, again.status) == ("written_to_cache", "read_from_cache") and again.df.first().n == 7007
    stamp = os.stat(folder)
    with open(folder / "f500.txt", "r+") as f:
        f.write("9")
    os.utime(folder / "f500.txt", (5, 5))
    os.utime(folder, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    changed = run()
    assert changed.status == "written_to_cache" and changed.df.first().n == 7009


def test_a_stored_result_does_not_disturb_its_readers(spark, tmp_path):
    from tablekit.sources.io import drop_older_results, read_result, store_result
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        read_result(spark, "k", root)
    store_result(spark.range(5), "k", root)
    reader = read_result(spark, "k", root)
    store_result(spark.range(9), "k", root)
    assert reader.count() == 5 and read_result(spark, "k", root).count() == 9
    (tmp_path / "k" / "lost").mkdir()      # a write that never ended
    assert read_result(spark, "k", root).count() == 9 and drop_older_results(spark, "k", root) == 1
    assert read_result(spark, "k", root).count() == 9
