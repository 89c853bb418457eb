"""Acceptance queries: JSON-safe cells, binary text, large numbers, sanitizing,
durations, flattened cells, select-input lists and table summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.render import binary_repr
from ..operators.records import (durations_to_seconds, flatten_cells, json_safe_records,
                                 large_numbers_to_string, sanitize_for_chart, sanitize_for_parquet,
                                 select_input_values, table_summary)
from . import query, table


@query("json_safe_records",
       "SELECT doc_id, substr(text, 1, 1000) AS text, lang, source, n_chars FROM documents")
def json_safe_records_q(spark, d):
    return json_safe_records(table(spark, d, "documents"))


@query("json_safe_records_nested",
       "SELECT o_orderkey, '[' || o_custkey || ', ' || o_orderkey || ']' AS ids, '{' || o_custkey || ', ' || o_orderstatus || '}' AS pair, "
       "'{' || o_orderstatus || ' -> ' || o_custkey || '}' AS by_status FROM orders")
def json_safe_records_nested(spark, d):
    return json_safe_records(table(spark, d, "orders").select(
        "o_orderkey", F.array("o_custkey", "o_orderkey").alias("ids"), F.struct("o_custkey", "o_orderstatus").alias("pair"),
        F.create_map("o_orderstatus", "o_custkey").alias("by_status")))


@query("json_safe_records_temporal",
       "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, "
       "CAST(o_totalprice AS DECIMAL(12, 2)) IS NOT NULL AS has_price, "
       "CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price_dec FROM orders")
def json_safe_records_temporal(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").isNotNull().alias("has_price"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price_dec"))
    return json_safe_records(o)


# Python bytes text of the first 249 UTF-8 bytes, written in DuckDB list functions.
_BYTES = ("list_transform(range(0, CAST(strlen(h) / 2 AS BIGINT)), "
          "lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER))")
_BIN_SQL = (
    "SELECT doc_id, 'b' || q || array_to_string(list_transform(codes, lambda x: CASE WHEN x = 92 THEN '\\\\' "
    "WHEN x = qc THEN '\\' || q WHEN x = 9 THEN '\\t' WHEN x = 10 THEN '\\n' WHEN x = 13 THEN '\\r' "
    "WHEN x BETWEEN 32 AND 126 THEN chr(x) ELSE '\\x' || lower(lpad(printf('%X', x), 2, '0')) END), '') || q "
    "AS text_bytes FROM (SELECT doc_id, codes, CASE WHEN list_contains(codes, 39) AND NOT list_contains(codes, 34) "
    "THEN '\"' ELSE '''' END AS q, CASE WHEN list_contains(codes, 39) AND NOT list_contains(codes, 34) "
    f"THEN 34 ELSE 39 END AS qc FROM (SELECT doc_id, {_BYTES} AS codes FROM (SELECT doc_id, "
    "substr(hex(encode(text)), 1, 498) AS h FROM documents)))")


@query("binary_repr", _BIN_SQL)
def binary_repr_q(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", binary_repr(F.col("text").cast("binary")).alias("text_bytes"))


BIG = 10 ** 12


@query("large_numbers_to_string",
       f"SELECT CAST(o_orderkey * {BIG} AS VARCHAR) AS big_key, o_custkey * 1000 AS mid_key, o_totalprice "
       "FROM orders")
def large_numbers_to_string_q(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") * BIG).alias("big_key"),
                                         (F.col("o_custkey") * 1000).alias("mid_key"), "o_totalprice")
    return large_numbers_to_string(o)


@query("sanitize_for_parquet",
       f'SELECT CAST(o_orderkey * {BIG} AS VARCHAR) AS o_orderkey, o_orderkey AS "o_orderkey.1", o_orderstatus '
       "FROM orders")
def sanitize_for_parquet_q(spark, d):
    o = table(spark, d, "orders")
    dup = o.select((F.col("o_orderkey") * BIG).alias("o_orderkey"), F.col("o_orderkey"), "o_orderstatus")
    return sanitize_for_parquet(dup)


@query("duration_to_seconds",
       "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0 AS since_start "
       "FROM events")
def duration_to_seconds_q(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.expr("ts - TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("since_start"))
    return durations_to_seconds(ev)


@query("sanitize_for_chart",
       "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0 AS ts, "
       'event_id AS "event_id.1", event_type FROM events')
def sanitize_for_chart_q(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.expr("ts - TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("ts"), F.col("event_id"),
        "event_type")
    return sanitize_for_chart(ev)


@query("flatten_cells",
       "SELECT n_nationkey AS row_id, 0 AS position, n_name AS value FROM nation UNION ALL "
       "SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation")
def flatten_cells_q(spark, d):
    return flatten_cells(table(spark, d, "nation"), key="n_nationkey")


@query("select_input_values",
       "SELECT list_sort(list(CAST(r_name AS VARCHAR))) AS values FROM region")
def select_input_values_q(spark, d):
    # element order is the table's; sorted here only to compare as a set
    return select_input_values(table(spark, d, "region").select("r_name", "r_regionkey")) \
        .select(F.array_sort("values").alias("values"))


@query("select_input_values_too_many",
       "SELECT CASE WHEN count(*) <= 1000 AND sum(length(c_name)) <= 10000 THEN list_sort(list(c_name)) END "
       "AS values FROM customer")
def select_input_values_too_many(spark, d):
    # from sf0.01 on, customer has more than 1,000 rows: no list
    return select_input_values(table(spark, d, "customer").select("c_name")) \
        .select(F.array_sort("values").alias("values"))


@query("table_summary",
       "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), "
       "(2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), "
       "(5, 'o_orderpriority', 'string')) AS t(position, column_name, column_type), "
       "(SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders)")
def table_summary_q(spark, d):
    return table_summary(table(spark, d, "orders"))
