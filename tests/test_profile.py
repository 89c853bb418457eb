import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.operators.profile import (Profile, analyze_columns_records, distinct_values_dict,
                                        estimate_csv_size, hist_edges)


def hist_counts(p, name):
    return [r["count"] for r in p.histograms().filter(F.col("column_name") == name).orderBy("bin").collect()]


def cats(p, name):
    return [(r["name"], r["count"]) for r in p.categories().filter(F.col("column_name") == name)
            .orderBy("position").collect()]


def test_categories_rules(spark):
    df = spark.createDataFrame([("a", "a", True), ("a", None, False), ("b", "b", True), ("c", "c", True)],
                               "cat1 string, cat2 string, cat5 boolean")
    p = Profile(df)
    assert cats(p, "cat1") == [("a", 2), ("b", 1), ("c", 1)]                  # 3 values fit
    assert cats(p, "cat2") == [("a", 1), ("2 others", 2), ("Missing", 1)]     # missing takes a slot
    assert cats(p, "cat5") == [("True", 3), ("False", 1)]                      # booleans are categories


def test_many_categories_and_all_null(spark):
    df = spark.createDataFrame([(str(i % 7), None) for i in range(50)], "c string, n string")
    p = Profile(df)
    got = cats(p, "c")
    assert got[0] == ("0", 8) and got[1][0] in ("1",) and got[2] == ("5 others", 50 - 8 - 7)
    assert cats(p, "n") == [("Missing", 50)]
    u = {r["column_name"]: r["unique_count"] for r in p.unique_counts().collect()}
    assert u == {"c": 7, "n": 0}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_histogram_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.normal(size=500) * 10 ** seed, [np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    p = Profile(df)
    finite = vals[np.isfinite(vals)]
    expected, edges = np.histogram(finite, bins=10)
    assert hist_counts(p, "x") == expected.tolist()
    got_edges = [r["bin_start"] for r in p.histograms().orderBy("bin").collect()]
    assert got_edges == edges[:-1].tolist()
    mm = p.min_max().first()
    assert mm["min"] == "-inf" and mm["max"] == "inf"          # infinities count for min/max
    assert p.null_counts().first()["nan_count"] == 2            # NaN and null


def test_single_value_and_integers(spark):
    df = spark.createDataFrame([(7,), (7,), (None,)], "v bigint")
    p = Profile(df)
    counts = hist_counts(p, "v")
    assert counts == np.histogram(np.array([7, 7]), bins=10)[0].tolist() and counts[5] == 2
    assert hist_edges(None, None) is None
    ints = spark.createDataFrame([(i,) for i in range(1, 101)], "v int")
    assert hist_counts(Profile(ints), "v") == np.histogram(np.arange(1, 101), bins=10)[0].tolist()


def test_temporal_histogram_and_minmax(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2020, 1, d),) for d in range(1, 11)] + [(None,)], "t timestamp_ntz")
    p = Profile(df)
    assert sum(hist_counts(p, "t")) == 10
    mm = p.min_max().first()
    assert mm["min"] == "2020-01-01 00:00:00" and mm["max"] == "2020-01-10 00:00:00"


def test_unique_counts_and_complex(spark):
    df = spark.createDataFrame([(1.0, [1, 2], {"a": "b"}), (-0.0, [1, 2], {"a": "b"}), (0.0, None, None),
                                (float("nan"), [3], {"c": "d"})],
                               "f double, arr array<int>, m map<string,string>")
    u = {r["column_name"]: r["unique_count"] for r in Profile(df).unique_counts().collect()}
    assert u["f"] == 2                     # -0.0 == 0.0, NaN is missing
    assert u["arr"] == 4 and u["m"] == 4   # unhashable cells: row count


def test_analyze_records_and_budget(spark):
    df = spark.createDataFrame([(i, float(i), str(i % 3)) for i in range(20)], "a bigint, b double, c string")
    recs = analyze_columns_records(df)
    assert [r["name"] for r in recs] == ["a", "b", "c"]
    assert recs[0]["stats"]["unique_count"] == 20 and len(recs[0]["stats"]["histogram"]) == 10
    assert recs[2]["stats"]["categories"][0] == {"name": "0", "count": 7}
    # only the named columns get stats, the others are listed
    some = analyze_columns_records(df, ["b"])
    assert some[0]["stats"] is None and some[1]["stats"] is not None and some[2]["stats"] is None


def test_long_texts_group_by_digest(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",)] * 3 + [(long + "b",)] * 2 + [("short",)] * 4 + [(None,)], "t string")
    p = Profile(df)
    assert cats(p, "t") == [("short", 4), ("2 others", 5), ("Missing", 1)]
    assert cats(Profile(df.filter("t <> 'short'")), "t") == [(long + "a", 3), (long + "b", 2)]
    key = Profile(df).summary()
    assert key["uniq"] == {0: 3}


def test_computed_input_is_stored_once_and_removed(spark):
    import os
    base = spark.range(100).selectExpr("id", "id % 7 AS k")
    joined = base.join(base.selectExpr("id AS j", "k * 2 AS m"), base["id"] == F.col("j")).withColumn("id2", F.col("id"))
    p = Profile(joined)
    assert {r["column_name"]: r["unique_count"] for r in p.unique_counts().collect()}["k"] == 7
    folder = p.stored
    assert folder and os.path.isdir(folder.removeprefix("file:"))
    p.close()
    assert not os.path.exists(folder.removeprefix("file:"))
    assert Profile(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_custkey > 5")).df is not None


def test_categories_need_no_ranges(spark):
    p = Profile(spark.range(10).selectExpr("id", "cast(id % 2 as string) AS s"))
    p.categories().collect()
    assert not any(k.startswith("min") for k in p.stats)


def test_distinct_values_skip_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2), (-0.0, 3), (0.0, None), (None, 4)], "x double, y int")
    assert distinct_values_dict(df, ["x", "y"]) == {"x": ["0.0", "2.0"], "y": ["1", "2", "3", "4"]}


def test_distinct_values(spark):
    df = spark.createDataFrame([(v, s, {"k": "v"}) for v, s in [(4, "b"), (2, "a"), (42, "c"), (77, "a"),
                                                                 (2, None), (4, "b"), (None, "c")]],
                               "col1 bigint, col2 string, m map<string,string>")
    dv = distinct_values_dict(df, ["col1", "col2", "m"])
    assert dv == {"col1": ["2", "4", "42", "77"], "col2": ["a", "b", "c"], "m": []}
    assert distinct_values_dict(df, ["col1"], limit=2) == {"col1": ["2", "4"]}
    with pytest.raises(KeyError):
        distinct_values_dict(df, ["nope"])


def test_csv_size_estimate_within_ten_percent(spark):
    df = spark.range(100_000).select(F.col("id").alias("col1"), (F.col("id") + 1).alias("col2"),
                                     (F.col("id") * 3).alias("col3"))
    exact = estimate_csv_size(df, exact=True)
    pandas_bytes = len(df.limit(100_000).toPandas().to_csv(index=False, lineterminator="\n").encode())
    assert exact == pandas_bytes
    est = estimate_csv_size(df, seed=1)
    assert abs(est - exact) / exact < 0.10
    assert estimate_csv_size(df.limit(0)) == 0 and estimate_csv_size(df.limit(0), exact=True) == 0


def test_approx_distinct_mode(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    exact = {r["column_name"]: r["unique_count"] for r in Profile(df).unique_counts().collect()}
    approx = {r["column_name"]: r["unique_count"] for r in Profile(df, approx_distinct=True).unique_counts().collect()}
    assert exact == {"k": 5000, "s": 3}
    assert approx["s"] == 3 and abs(approx["k"] - 5000) / 5000 < 0.1


def test_decimal_and_zoned_timestamp_histograms(spark):
    import datetime as dt
    from decimal import Decimal
    vals = [Decimal("1.25"), Decimal("2.50"), Decimal("9.75"), Decimal("4.00"), None]
    df = spark.createDataFrame([(v, dt.datetime(2024, 1, 1 + i)) for i, v in enumerate(vals)],
                               "dec decimal(10,2), ts timestamp")
    p = Profile(df)
    assert hist_counts(p, "dec") == np.histogram([1.25, 2.5, 9.75, 4.0], bins=10)[0].tolist()
    assert sum(hist_counts(p, "ts")) == 5 and hist_counts(p, "ts")[0] == 1 and hist_counts(p, "ts")[-1] == 1
    u = {r["column_name"]: r["unique_count"] for r in p.unique_counts().collect()}
    assert u == {"dec": 4, "ts": 5}
