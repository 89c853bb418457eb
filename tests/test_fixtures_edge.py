"""Edge fixtures of the reference tests: empty tables, very wide tables, all-null columns."""

from pyspark.sql import functions as F

from tablekit.functions.spec import Condition
from tablekit.operators.profile import Profile, analyze_columns_records, estimate_csv_size
from tablekit.operators.shape import prepare_columns, sample_n
from tablekit.plans.browse import apply_browse_spec, browse_table


def test_no_rows(spark):
    df = spark.createDataFrame([], "col1 double, col2 double")
    recs = analyze_columns_records(df)
    assert [r["stats"]["unique_count"] for r in recs] == [0, 0]
    assert all(r["stats"]["min"] is None and r["stats"]["histogram"] is None for r in recs)
    assert browse_table(df, None).page == []
    assert sample_n(df, 10).count() == 0 and estimate_csv_size(df) == 0


def test_many_columns(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"col{i}") for i in range(10_000)])
    assert len(prepare_columns(wide).columns) == 500
    spec = {"filters": [{"column": "col9999", "operator": "is-equal", "comparativeValues": [1]}]}
    assert apply_browse_spec(wide, spec).count() == 0          # a filter beyond column 500 still applies
    spec["filters"][0]["comparativeValues"] = [9999]
    out = apply_browse_spec(wide, spec)
    assert out.count() == 1 and len(out.columns) == 10_000      # only a shown page is cut


def test_all_null_text_column(spark):
    df = spark.createDataFrame([(None,), (None,), (None,)], "col1 string")
    p = Profile(df)
    assert [tuple(r) for r in p.unique_counts().collect()] == [("col1", 0)]
    assert [(r["name"], r["count"]) for r in p.categories().collect()] == [("Missing", 3)]
    assert p.null_counts().first()["nan_count"] == 3


def test_nat_and_temporal_minmax(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 12),), (None,)], "t timestamp_ntz")
    mm = Profile(df).min_max().first()
    assert mm["min"] == mm["max"] == "2020-01-01 12:00:00"
