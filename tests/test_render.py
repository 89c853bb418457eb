import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablekit.functions.render import binary_repr
from tablekit.operators.records import (json_safe_records, large_number_columns, large_numbers_to_string,
                                        select_input_values, table_summary, to_records)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=8))
def test_binary_repr_equals_python(spark_session_holder, blobs):
    spark = spark_session_holder
    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    got = [r[0] for r in df.select(binary_repr(F.col("b"))).collect()]
    assert got == [repr(bytes(b[:249])) for b in blobs]


def test_json_safe_non_serializable(spark):
    df = spark.createDataFrame([([1, 2, 3], dt.datetime(2023, 1, 1, 12), bytearray(b"hello"), "x" * 1500, True, 5)],
                               "list array<int>, datetime timestamp_ntz, binary binary, string string, "
                               "boolean boolean, integer int")
    r = to_records(df, 10)[0]
    assert r == {"list": "[1, 2, 3]", "datetime": "2023-01-01 12:00:00", "binary": "b'hello'",
                 "string": "x" * 1000, "boolean": True, "integer": 5}


def test_large_numbers_threshold(spark):
    safe = spark.createDataFrame([(2 ** 53,)], "col1 bigint")
    assert large_number_columns(safe) == []
    above = spark.createDataFrame([(2 ** 53 + 1, 1), (42, 2), (2 ** 53 + 100, 3)], "large_col bigint, safe_col bigint")
    out = large_numbers_to_string(above)
    assert dict(out.dtypes) == {"large_col": "string", "safe_col": "bigint"}
    assert out.first()["large_col"] == str(2 ** 53 + 1)
    neg = spark.createDataFrame([(-(2 ** 63),)], "v bigint")        # no abs() overflow
    assert large_number_columns(neg) == ["v"]
    inf = spark.createDataFrame([(float("inf"),), (float("nan"),)], "v double")
    assert large_number_columns(inf) == ["v"]


def test_select_input_and_summary(spark):
    small = spark.createDataFrame([(i, "v") for i in range(5)], "a bigint, b string")
    assert select_input_values(small).first()["values"] == ["0", "1", "2", "3", "4"]
    big = spark.range(1001)
    assert select_input_values(big).first()["values"] is None
    long_text = spark.createDataFrame([("x" * 6000,), ("y" * 5000,)], "s string")
    assert select_input_values(long_text).first()["values"] is None
    nested = spark.createDataFrame([([1],)], "a array<int>")
    assert select_input_values(nested).first()["values"] is None
    s = table_summary(small).orderBy("position").collect()
    assert [(r.column_name, r.column_type, r.row_count, r.column_count) for r in s] == \
        [("a", "bigint", 5, 2), ("b", "string", 5, 2)]


def test_json_safe_decimal_and_map(spark):
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(10,2)) AS d, map('k', 1) AS m, named_struct('a', 1) AS s")
    r = json_safe_records(df).first()
    assert r["d"] == "1.50" and r["m"] == "{k -> 1}" and r["s"] == "{1}"
