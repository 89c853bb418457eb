"""Acceptance queries: chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spec import Condition
from ..operators.chart import (COUNT_FIELD, chart_aggregate, chart_filtered_dataset, chart_output_metadata,
                               chart_row_cap, chart_select_fields, time_unit)
from . import query, table

LAYERED_SPEC = {
    "layer": [
        {"mark": "line", "encoding": {"x": {"field": "o_orderdate", "timeUnit": "yearmonth"},
                                      "y": {"field": COUNT_FIELD, "aggregate": "count"}}},
        {"layer": [{"mark": "point", "encoding": {"x": {"field": "o_orderdate"},
                                                  "y": {"field": "o_totalprice"},
                                                  "color": {"field": "Percentage of o_totalprice"}}}]},
    ]
}


@query("chart_select_fields", "SELECT o_totalprice, o_orderdate FROM orders")
def chart_select_fields_q(spark, d):
    return chart_select_fields(table(spark, d, "orders"), LAYERED_SPEC)


EVENT_SPEC = {"mark": "bar", "encoding": {"x": {"field": "since\\.start"}, "y": {"field": "value"},
                                          "color": {"field": "event_type"}}}


@query("chart_filtered_dataset",
       "SELECT event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0 "
       "AS \"since.start\" FROM events WHERE lower(event_type) IN ('click', 'purchase') AND value > 10")
def chart_filtered_dataset_q(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", "event_type", "value", F.expr("ts - TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("since.start"))
    filters = [Condition("event_type", "is-one-of", ("CLICK", "purchase")), Condition("value", "greater-than", ("10",))]
    return chart_filtered_dataset(ev, EVENT_SPEC, filters)


@query("chart_row_cap",
       "SELECT * FROM (SELECT l_orderkey, count(*) AS \"COUNT(*)\" FROM lineitem GROUP BY l_orderkey "
       "ORDER BY l_orderkey LIMIT 5000), (SELECT count(DISTINCT l_orderkey) > 5000 AS row_limit_exceeded "
       "FROM lineitem)")
def chart_row_cap_q(spark, d):
    agg = chart_aggregate(table(spark, d, "lineitem"), ["l_orderkey"]).orderBy("l_orderkey")
    capped, exceeded = chart_row_cap(agg)
    return capped.withColumn("row_limit_exceeded", F.lit(exceeded))


@query("chart_output_metadata",
       "SELECT column_name, CASE column_name WHEN 'o_orderstatus' THEN 'string' WHEN 'o_custkey' THEN 'bigint' "
       "ELSE 'timestamp_ntz' END AS native_type, (SELECT count(*) FROM orders) AS size, 5000 AS row_limit, "
       "string_agg(value, '|' ORDER BY rank) AS distinct_values FROM ("
       "SELECT 'o_orderstatus' AS column_name, rk AS rank, v AS value FROM (SELECT v, row_number() OVER "
       "(ORDER BY v) AS rk FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)) WHERE rk <= 30 UNION ALL "
       "SELECT 'o_orderdate', rk, CAST(v AS VARCHAR) FROM (SELECT v, row_number() OVER (ORDER BY v) AS rk FROM "
       "(SELECT DISTINCT o_orderdate AS v FROM orders)) WHERE rk <= 30 UNION ALL "
       "SELECT 'o_custkey', rk, CAST(v AS VARCHAR) FROM (SELECT v, row_number() OVER (ORDER BY v) AS rk FROM "
       "(SELECT DISTINCT o_custkey AS v FROM orders)) WHERE rk <= 30) GROUP BY column_name")
def chart_output_metadata_q(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderdate", "o_custkey")
    meta = chart_output_metadata(o)
    return spark.createDataFrame([(c["name"], c["nativeType"], meta["filteredDataframeSize"], meta["rowLimit"],
                                   "|".join(c["distinctValues"])) for c in meta["columns"]],
                                 "column_name string, native_type string, size long, row_limit int, distinct_values string")


@query("chart_time_part",
       "SELECT month(o_orderdate)::INTEGER AS month, dayofweek(o_orderdate)::INTEGER AS weekday, count(*) AS \"COUNT(*)\" FROM orders GROUP BY 1, 2")
def chart_time_part_q(spark, d):
    o = table(spark, d, "orders")
    return chart_aggregate(o, [time_unit(o, "o_orderdate", "month").alias("month"), time_unit(o, "o_orderdate", "day").alias("weekday")])


@query("chart_percentage_of_zero",
       "SELECT o_orderpriority, NULL::DOUBLE AS \"Percentage of zero\" FROM orders GROUP BY 1")
def chart_percentage_of_zero(spark, d):
    o = table(spark, d, "orders").withColumn("zero", F.lit(0))
    return chart_aggregate(o, ["o_orderpriority"], "Percentage of zero")


@query("chart_count",
       "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS \"COUNT(*)\" FROM events GROUP BY 1, 2")
def chart_count_q(spark, d):
    ev = table(spark, d, "events")
    return chart_aggregate(ev, ["event_type", time_unit(ev, "ts", "yearmonthdate").alias("day")])


@query("chart_percentage",
       "SELECT o_orderpriority, count(*) * 100.0 / (SELECT count(*) FROM orders) AS \"Percentage of COUNT(*)\" "
       "FROM orders GROUP BY o_orderpriority")
def chart_percentage_q(spark, d):
    return chart_aggregate(table(spark, d, "orders"), ["o_orderpriority"], "Percentage of COUNT(*)")


@query("chart_percentage_of_field",
       "SELECT o_orderstatus, sum(o_custkey) * 100.0 / (SELECT sum(o_custkey) FROM orders) "
       "AS \"Percentage of o_custkey\" FROM orders GROUP BY o_orderstatus")
def chart_percentage_of_field_q(spark, d):
    return chart_aggregate(table(spark, d, "orders"), ["o_orderstatus"], "Percentage of o_custkey")


@query("chart_time_unit",
       "SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus, count(*) AS \"COUNT(*)\" FROM orders "
       "GROUP BY 1, 2")
def chart_time_unit_q(spark, d):
    o = table(spark, d, "orders")
    return chart_aggregate(o, [time_unit(o, "o_orderdate", "yearmonth").alias("month"), "o_orderstatus"])
