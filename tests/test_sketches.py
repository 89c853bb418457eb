"""Mergeable profiles, the profile store, file states."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablekit.operators.profile import Profile, analyze_columns
from tablekit.operators.sketches import (DISTINCT_ERROR, FREQUENT_ERROR, RANK_ERROR, SKETCHES, column_sketches, estimates,
                                         merge_sketches)
from tablekit.sources.files import digest_of, file_states, inputs_digest, inputs_of
from tablekit.sources.profile_store import ProfileStore

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {r.column_name: r for r in df.collect()}


def near(exact, approx, rows):
    """The approximate profile next to the exact one, within the stated bounds."""
    for name, e in exact.items():
        a = approx[name]
        assert (a.dtype, a.nan_count, a.min, a.max) == (e.dtype, e.nan_count, e.min, e.max), name
        assert abs(a.unique_count - e.unique_count) <= DISTINCT_ERROR * e.unique_count, name
        if e.histogram:
            assert [(h.bin_start, h.bin_end) for h in a.histogram] == [(h.bin_start, h.bin_end) for h in e.histogram]
            assert sum(h["count"] for h in a.histogram) == sum(h["count"] for h in e.histogram)
            assert all(abs(x["count"] - y["count"]) <= 2 * RANK_ERROR * rows + 1 for x, y in zip(a.histogram, e.histogram)), name
        else:
            assert not a.histogram, name
        assert (a.categories is None) == (e.categories is None)
        if e.categories and e.unique_count < 500:
            assert a.categories == e.categories and a.unique_count == e.unique_count, name


@pytest.mark.parametrize("table", ["lineitem", "events", "documents", "customer"])
def test_halves_merge_to_the_whole(spark, table):
    df = spark.read.parquet(f"{SF}/{table}.parquet")
    half = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(2)) == 0
    merged = merge_sketches(column_sketches(df.filter(half)).unionByName(column_sketches(df.filter(~half))))
    one, other = rows_of(estimates(merged)), rows_of(analyze_columns(df, approx=True))
    # distinct counts read registers only: the same however the parts were merged
    for name, r in one.items():
        o = other[name]
        assert (r.unique_count, r.nan_count, r.min, r.max) == (o.unique_count, o.nan_count, o.min, o.max)
    exact = rows_of(analyze_columns(df))
    near(exact, one, df.count())
    near(exact, other, df.count())


def test_many_parts_and_file_groups(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    sketched = column_sketches(df, by=F.pmod("o_orderkey", F.lit(7)))
    assert sketched.count() == 7 * len(df.columns) and sketched.schema.simpleString() == spark.createDataFrame([], SKETCHES).schema.simpleString()
    near(rows_of(analyze_columns(df)), rows_of(estimates(merge_sketches(sketched))), df.count())


def test_every_type_and_missing_cells(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.5, Decimal("12345678901234567890123456.789"), dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 5), True, b"\x01", [1], {"a": 1},
             dt.timedelta(days=2), "x" * 100, 2 ** 62),
            (2, nan, Decimal("-12345678901234567890123456.788"), None, None, False, None, [1], None, dt.timedelta(seconds=-3), "x" * 100, 2 ** 62 + 1),
            (None, inf, None, dt.date(1900, 5, 5), dt.datetime(1900, 1, 1), None, b"\x01", None, {"a": 1}, None, "", -2 ** 62),
            (2, -0.0, Decimal("0.001"), dt.date(2020, 1, 1), dt.datetime(9999, 1, 1), True, b"", [2], {}, dt.timedelta(0), None, None)]
    schema = ("a int, b double, c decimal(38,3), d date, e timestamp_ntz, f boolean, g binary, h array<int>, "
                                     "i map<string,int>, j interval day to second, k string, `l m.n` bigint")
    df = spark.createDataFrame(rows, schema)
    parts = column_sketches(spark.createDataFrame(rows[:1], schema)).unionByName(column_sketches(spark.createDataFrame(rows[1:], schema)))
    got = rows_of(estimates(merge_sketches(parts)))
    exact = {r.column_name: r for r in Profile(df).table().collect()}
    for name, e in exact.items():
        a = got[name]
        assert (a.unique_count, a.nan_count, a.min, a.max, a.histogram) == (e.unique_count, e.nan_count, e.min, e.max, e.histogram), name
        if name != "k":
            assert a.categories == e.categories, name
    assert got["k"].categories[0].name in ("", "x" * 64)


def test_empty_table_and_no_columns(spark):
    empty = spark.createDataFrame([], "a int, b string, c double")
    got = rows_of(analyze_columns(empty, approx=True))
    assert all((r.unique_count, r.nan_count, r.min, r.max, r.histogram) == (0, 0, None, None, None) for r in got.values())
    assert estimates(merge_sketches(column_sketches(empty, []))).count() == 0
    both = merge_sketches(column_sketches(empty).unionByName(column_sketches(spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double"))))
    assert rows_of(estimates(both))["b"].categories[0].name == "x"


def test_frequent_values_beyond_the_sketch(spark):
    df = spark.range(200_000).selectExpr("IF(id % 4 = 0, 'often', IF(id % 10 = 1, 'second', CONCAT('v', id))) AS s")
    r = rows_of(analyze_columns(df, approx=True))["s"]
    truth = {x.s: x["count"] for x in df.groupBy("s").count().collect()}
    assert [c.name for c in r.categories[:2]] == ["often", "second"]
    assert all(0 <= c["count"] - truth[c.name] <= FREQUENT_ERROR * 200_000 for c in r.categories[:2])
    assert abs(r.unique_count - len(truth)) <= DISTINCT_ERROR * len(truth)


def test_no_growing_shuffle(spark):
    """Only sketches are exchanged: one row a column chunk and task."""
    plan = column_sketches(spark.read.parquet(f"{SF}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.replace("hashpartitioning(__tk_part", "") and "Window" not in plan


def test_store_follows_its_files(spark, tmp_path):
    source, root = str(tmp_path / "in put [1]"), str(tmp_path / "store")
    df = spark.read.parquet(f"{SF}/orders.parquet")
    for k in range(4):
        df.filter(f"o_orderkey % 8 = {k}").coalesce(1).write.mode("append").parquet(source)
    store = ProfileStore(spark, source, root, group_bytes=1)
    first = store.refresh()
    assert (first.read, first.kept) == (4, 0) and first.groups > 1
    assert store.refresh() == type(first)(0, 4, first.groups)
    near(rows_of(analyze_columns(df.filter("o_orderkey % 8 < 4"))), rows_of(store.profile()), 7500)
    # a file is added: only it is read
    df.filter("o_orderkey % 8 = 4").coalesce(1).write.mode("append").parquet(source)
    assert (added := store.refresh()).read == 1 and added.kept == 4
    near(rows_of(analyze_columns(df.filter("o_orderkey % 8 < 5"))), rows_of(store.profile()), 9400)
    # one is replaced in place, one goes: their groups are made anew, the others stay
    import pathlib
    import shutil
    files = sorted(pathlib.Path(source).glob("*.parquet"))
    odd = files[2].rename(files[2].with_name("a b+c%20 é.parquet"))     # gone and added in one
    assert store.refresh().read >= 1 and odd in pathlib.Path(source).iterdir()
    near(rows_of(analyze_columns(df.filter("o_orderkey % 8 < 5"))), rows_of(store.profile()), 9400)
    spark.read.parquet(str(files[0]).replace("[", "\\[").replace("]", "\\]")).limit(3).coalesce(1).write.parquet(str(tmp_path / "other"))
    shutil.copy(next((tmp_path / "other").glob("*.parquet")), files[0])
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    files[1].unlink()
    last = store.refresh()
    assert last.read < 4 and last.read + last.kept == 4
    now = spark.read.parquet(source.replace("[", "\\[").replace("]", "\\]"))
    near(rows_of(analyze_columns(now)), rows_of(store.profile()), 9400)


def test_empty_store(spark, tmp_path):
    (tmp_path / "none").mkdir()
    store = ProfileStore(spark, str(tmp_path / "none"), str(tmp_path / "store"))
    assert store.refresh().groups == 0 and store.profile().count() == 0


def test_digest_sees_one_of_1001_files(spark, tmp_path):
    """Replaced in place, same length, another time; folders do not change."""
    import os
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(1001):
        (folder / f"part {k}.txt").write_text(f"{k:06d}")
    df = spark.read.text(str(folder))
    before = inputs_digest(df)
    assert inputs_of(df).count() == 1001 and inputs_digest(spark.read.text(str(folder))) == before
    one = folder / "part 500.txt"
    stamp = os.stat(folder)
    with open(one, "r+") as f:
        f.write("999999")
    os.utime(one, (1, 1))
    os.utime(folder, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert inputs_digest(spark.read.text(str(folder))) != before
    # files of the folder that the table does not read play no part
    some = [str(folder / f"part {k}.txt") for k in range(10)]
    few = inputs_digest(spark.read.text(some))
    (folder / "part 700.txt").write_text("changed")
    assert inputs_digest(spark.read.text(some)) == few and inputs_digest(spark.range(3)) == "none"


def test_digest_does_not_depend_on_partitions(spark):
    states = file_states(spark, [SF])
    assert states.count() > 10 and digest_of(states.repartition(1)) == digest_of(states.repartition(9))
    assert math.isfinite(int(digest_of(states), 16))


def test_sketches_are_made_once(spark):
    from tablekit.operators.profile import analyze_columns
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(300).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS v", "CAST(id AS STRING) AS s").mapInArrow(counted, "id long, v double, s string")
    rows = {r.column_name: r for r in analyze_columns(df, approx=True).collect()}
    assert seen.value == 300 and (rows["id"].min, rows["id"].max) == ("0", "299") and rows["v"].histogram[-1].bin_end == 6.0
