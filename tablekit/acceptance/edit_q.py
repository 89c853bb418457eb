"""Acceptance queries: edits on result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.edit import (edit_append, edit_assign, edit_drop, edit_drop_duplicates, edit_dropna,
                              edit_fillna, edit_replace, edit_update)
from . import query, table


def _orders_nullable(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"),
                    F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_totalprice")


ORDERS_NULLABLE = ("SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS prio, "
                   "nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders")


@query("edit_assign",
       "SELECT o_orderkey, o_totalprice > 200000 AS big, o_custkey, o_orderstatus, 'x' AS tag FROM orders")
def edit_assign_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = edit_assign(o, "big", F.col("o_totalprice") > 200000, loc=1)
    o = edit_assign(o, "tag", "x")
    return o.drop("o_totalprice")


@query("edit_drop", "SELECT o_orderkey, o_orderstatus FROM orders")
def edit_drop_q(spark, d):
    return edit_drop(table(spark, d, "orders"), ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("edit_update",
       f"SELECT o.o_orderkey, o.o_custkey, coalesce(u.prio, o.prio) AS prio, o.status, o.o_totalprice "
       f"FROM ({ORDERS_NULLABLE}) o LEFT JOIN (SELECT c_custkey AS o_custkey, "
       "nullif(c_mktsegment, 'MACHINERY') AS prio FROM customer) u USING (o_custkey)")
def edit_update_q(spark, d):
    # customers' segment (when known) overwrites the order priority, matched by customer key
    upd = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                             F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("prio"))
    return edit_update(_orders_nullable(spark, d), upd, ["o_custkey"])


@query("edit_update_nan",
       "SELECT e.event_id, e.event_type, if(u.event_id IS NULL OR isnan(u.v), e.value, u.v) AS \"a.value\" FROM events e LEFT JOIN "
       "(SELECT event_id, if(event_type = 'view', 'NaN'::DOUBLE, value * 2) AS v FROM events WHERE user_id % 2 = 0) u USING (event_id)")
def edit_update_nan(spark, d):
    # a dotted name; NaN in the update leaves the cell as it is
    ev = table(spark, d, "events")
    own = ev.select("event_id", "event_type", F.col("value").alias("a.value"))
    new = ev.filter("user_id % 2 = 0").select("event_id", F.expr("if(event_type = 'view', double('NaN'), value * 2)").alias("a.value"))
    return edit_update(own, new, ["event_id"])


@query("edit_append",
       "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL BY NAME "
       "SELECT c_custkey AS o_custkey, CAST(NULL AS BIGINT) AS o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus "
       "FROM customer")
def edit_append_q(spark, d):
    narrow = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return edit_append(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), narrow)


@query("edit_fillna",
       f"SELECT o_orderkey, o_custkey, coalesce(prio, 'unknown') AS prio, coalesce(status, 'unknown') AS status, "
       f"o_totalprice FROM ({ORDERS_NULLABLE})")
def edit_fillna_q(spark, d):
    return edit_fillna(_orders_nullable(spark, d), "unknown")


@query("edit_fillna_nan",
       "SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE v END AS v FROM (SELECT event_id, "
       "CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE WHEN event_type = 'click' THEN NULL ELSE value END AS v "
       "FROM events)")
def edit_fillna_nan_q(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "view", F.lit(float("nan")))
        .when(F.col("event_type") == "click", F.lit(None).cast("double")).otherwise(F.col("value")).alias("v"))
    return edit_fillna(ev, 0.0)


@query("edit_replace",
       "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' "
       "ELSE o_orderstatus END AS o_orderstatus FROM orders")
def edit_replace_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return edit_replace(o, {"F": "finished", "O": "open"}, subset=["o_orderstatus"])


@query("edit_dropna", f"SELECT * FROM ({ORDERS_NULLABLE}) WHERE prio IS NOT NULL AND status IS NOT NULL")
def edit_dropna_q(spark, d):
    return edit_dropna(_orders_nullable(spark, d))


@query("edit_drop_duplicates",
       "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def edit_drop_duplicates_q(spark, d):
    return edit_drop_duplicates(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("edit_drop_duplicates_keep_first",
       "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders QUALIFY row_number() OVER "
       "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ASC) = 1")
def edit_drop_duplicates_keep_first_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return edit_drop_duplicates(o, ["o_custkey"], keep_first_by=[("o_orderdate", False), ("o_orderkey", True)])
