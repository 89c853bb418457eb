"""Acceptance queries: accepted table kinds and round trips through the
shared folder (CSV, JSON, parquet, export, temp views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.sqlcell import temp_views
from ..sources.io import (csv_export, export_table, json_export, json_import, read_csv_export, read_result,
                          scratch_path, store_result, table_from_native)
from . import query, table

ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@query("table_from_native", "SELECT * FROM customer")
def table_from_native_q(spark, d):
    import pyspark.pandas as ps
    psdf = ps.read_parquet(f"{d}/customer.parquet")       # pandas-on-Spark: distributed, no collect
    return table_from_native(psdf).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("csv_export", "SELECT * FROM orders")
def csv_export_q(spark, d):
    path = csv_export(table(spark, d, "orders"), scratch_path(spark, "csv"))
    return read_csv_export(spark, path, ORDERS_SCHEMA)


@query("export_table",
       "SELECT * FROM orders WHERE lower(o_orderpriority) IN ('1-urgent') AND o_totalprice > 150000")
def export_table_q(spark, d):
    spec = {"filters": [{"column": "o_orderpriority", "operator": "is-one-of", "comparativeValues": ["1-URGENT"]},
                        {"column": "o_totalprice", "operator": "greater-than", "comparativeValues": [150000]}],
            "sortBy": [{"id": "o_totalprice", "type": "desc"}]}
    path = export_table(table(spark, d, "orders"), spec, scratch_path(spark, "export"))
    return read_csv_export(spark, path, ORDERS_SCHEMA)


DOCS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


@query("csv_export_text", "SELECT * FROM documents")
def csv_export_text(spark, d):
    path = csv_export(table(spark, d, "documents"), scratch_path(spark, "csv"))
    return read_csv_export(spark, path, DOCS_SCHEMA)


@query("csv_export_events", "SELECT event_id, ts, user_id, event_type, value, props, ' ' || event_type || ' ' AS blanks, "
       "if(user_id % 3 = 0, '', if(user_id % 3 = 1, NULL, 'a \"b\", c')) AS odd FROM events")
def csv_export_events(spark, d):
    ev = table(spark, d, "events").select(*[c.split()[0] for c in EVENTS_SCHEMA.split(", ")], F.expr("concat(' ', event_type, ' ')").alias("blanks"),
                                          F.expr("if(user_id % 3 = 0, '', if(user_id % 3 = 1, NULL, 'a \"b\", c'))").alias("odd"))
    path = csv_export(ev, scratch_path(spark, "csv"))
    return read_csv_export(spark, path, EVENTS_SCHEMA + ", blanks string, odd string")


@query("csv_export_nested", "SELECT o_orderkey, '[' || o_orderkey || ', ' || o_custkey || ']' AS ids, '{' || o_custkey || ', ' || o_orderstatus || '}' AS pair, "
       "'b' || chr(39) || o_orderstatus || chr(39) AS bytes FROM orders")
def csv_export_nested(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderkey", "o_custkey").alias("ids"),
                                         F.struct("o_custkey", "o_orderstatus").alias("pair"), F.col("o_orderstatus").cast("binary").alias("bytes"))
    path = csv_export(o, scratch_path(spark, "csv"))
    return read_csv_export(spark, path, "o_orderkey bigint, ids string, pair string, bytes string")


@query("json_roundtrip_events", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def json_roundtrip_events(spark, d):
    ev = table(spark, d, "events").select(*[c.split()[0] for c in EVENTS_SCHEMA.split(", ")])
    return json_import(spark, json_export(ev, scratch_path(spark, "json")), EVENTS_SCHEMA)


WIDE = 600
#: The longest text of a bigint, and the sign behind it.
CELL_BYTES = 21


@query("export_wide", f"SELECT o_orderkey, o_orderkey + {WIDE - 1} AS last FROM orders WHERE (o_orderkey + {WIDE - 2}) % 3 = 0")
def export_wide(spark, d):
    # conditions and order on columns past the 500th; all columns are written
    o = table(spark, d, "orders").select("o_orderkey", *[(F.col("o_orderkey") + k).alias(f"c{k}") for k in range(1, WIDE)],
                                         ((F.col("o_orderkey") + WIDE - 2) % 3).alias("rest"))
    spec = {"filters": [{"column": "rest", "operator": "is-equal", "comparativeValues": [0]}],
            "sortBy": [{"id": f"c{WIDE - 1}", "type": "desc"}]}
    # the export grows with the table: its limit is what its rows can take at most
    most = (o.count() + 1) * CELL_BYTES * len(o.columns)
    # and its files are packed: as plain text they are many times as large as the table
    path = export_table(o, spec, scratch_path(spark, "export"), max_bytes=most, compression="gzip")
    names = [f"c{k}" for k in range(1, WIDE)]
    back = read_csv_export(spark, path, ", ".join(f"{c} bigint" for c in ["o_orderkey", *names, "rest"]))
    return back.select("o_orderkey", F.col(names[-1]).alias("last"))


@query("result_cache_parquet", "SELECT * FROM lineitem WHERE l_returnflag = 'R'")
def result_cache_parquet_q(spark, d):
    li = table(spark, d, "lineitem")
    key = scratch_path(spark, "key").rsplit("/", 1)[-1]
    store_result(li.filter("l_returnflag = 'R'"), key)
    return read_result(spark, key)


@query("json_result_roundtrip", "SELECT * FROM orders")
def json_result_roundtrip_q(spark, d):
    path = json_export(table(spark, d, "orders"), scratch_path(spark, "json"))
    return json_import(spark, path, ORDERS_SCHEMA)


@query("temp_view", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def temp_view_q(spark, d):
    with temp_views(spark, {"tk_nation": table(spark, d, "nation"), "tk_region": table(spark, d, "region")}):
        df = spark.sql("SELECT n_name, r_name FROM tk_nation JOIN tk_region ON n_regionkey = r_regionkey")
    return df
