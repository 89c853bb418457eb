"""Acceptance queries: SQL cells (parameters, lists, dynamic names, chaining,
previews, cache, ``%%sparksql``) and the relational categories users reach
through SQL text. Cross joins are deliberately not registered (all-pairs output)."""

from __future__ import annotations

import datetime as dt

from ..plans.sqlcell import (SqlWorkspace, cached_sql, run_template, spark_sql_cell, sql_on_tables)
from . import query, table


def _tables(spark, d, *names):
    return {n: table(spark, d, n) for n in names}


@query("sql_on_tables",
       "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS custkeys FROM orders "
       "GROUP BY o_orderstatus")
def sql_on_tables_q(spark, d):
    return sql_on_tables(spark, "SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS custkeys "
                                "FROM orders GROUP BY o_orderstatus", _tables(spark, d, "orders"))


@query("sql_bind_params",
       "SELECT o.o_orderkey, o.o_orderdate, c.c_mktsegment FROM orders o JOIN customer c "
       "ON o.o_custkey = c.c_custkey WHERE o.o_orderdate >= TIMESTAMP '1997-01-01' "
       "AND c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 100000.5")
def sql_bind_params_q(spark, d):
    return run_template(
        spark,
        "SELECT o.o_orderkey, o.o_orderdate, c.c_mktsegment FROM orders o JOIN customer c "
        "ON o.o_custkey = c.c_custkey WHERE o.o_orderdate >= {{ start }} AND c.c_mktsegment = {{ segment }} "
        "AND o.o_totalprice > {{ min_price }}",
        {"start": "1997-01-01", "segment": "BUILDING", "min_price": 100000.5},
        _tables(spark, d, "orders", "customer"))


# Fixed rule for the IN-list: every 7th key from 0 to 20,000 (a parameter list, not a data cut).
IN_KEYS = list(range(0, 20000, 7))


@query("sql_in_list",
       f"SELECT * FROM customer WHERE c_custkey IN ({', '.join(map(str, IN_KEYS))})")
def sql_in_list_q(spark, d):
    return run_template(spark, "SELECT * FROM customer WHERE c_custkey IN {{ keys | inclause }}",
                        {"keys": IN_KEYS}, _tables(spark, d, "customer"))


@query("sql_in_list_ranges",
       "SELECT o_orderkey, o_orderstatus FROM orders o WHERE o.o_custkey IN (3, 4, 5, 700, 701, 1400, -2) "
       "AND (o_orderpriority IN ('1-URGENT', '5-LOW')) UNION ALL "
       "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate IN (DATE '1996-01-02', DATE '1998-02-03')")
def sql_in_list_ranges(spark, d):
    return run_template(spark, "SELECT o_orderkey, o_orderstatus FROM orders o WHERE o.o_custkey IN {{ keys | inclause }} "
                               "AND (o_orderpriority IN {{ prios | inclause }}) UNION ALL "
                               "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate IN {{ days | inclause }}",
                        {"keys": [3, 4, 5, 700, 701, 1400, -2], "prios": ["1-URGENT", "5-LOW"],
                         "days": [dt.date(1996, 1, 2), dt.date(1998, 2, 3)]}, _tables(spark, d, "orders"))


@query("spark_sql_cell_braces",
       "SELECT event_type, CAST(json_extract_string('{\"a\": [1, {\"b\": 2}]}', '$.a[1].b') AS VARCHAR) AS b, count(*) AS n "
       "FROM events WHERE user_id > 10 AND regexp_matches(CAST(user_id AS VARCHAR), '^[0-9]{2,3}$') GROUP BY event_type")
def spark_sql_cell_braces(spark, d):
    # a JSON literal and a quantifier next to real places
    return spark_sql_cell(spark, "SELECT event_type, get_json_object('{\"a\": [1, {\"b\": 2}]}', '$.a[1].b') AS b, count(*) AS n "
                                 "FROM {src} WHERE user_id > {least} AND CAST(user_id AS STRING) RLIKE '^[0-9]{2,3}$' GROUP BY event_type",
                          {"src": table(spark, d, "events"), "least": 10})


@query("sql_dynamic_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sql_dynamic_table_q(spark, d):
    return run_template(spark, "SELECT n_regionkey, count(*) AS n FROM {{ t | identifier }} GROUP BY n_regionkey",
                        {"t": "nation"}, _tables(spark, d, "nation"))


@query("sql_dynamic_columns", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def sql_dynamic_columns_q(spark, d):
    return run_template(spark, "SELECT {{ cols | sqlsafe }} FROM customer WHERE c_acctbal > {{ floor }}",
                        {"cols": "c_custkey, c_mktsegment", "floor": 0}, _tables(spark, d, "customer"))


CHAIN_SQL = (
    "WITH tk_base AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), "
    "tk_spend AS (SELECT o_custkey, CAST(sum(o_custkey) AS BIGINT) AS weight, count(*) AS n FROM tk_base "
    "GROUP BY o_custkey), "
    "tk_recent AS (SELECT o_custkey, max(o_orderdate) AS last_order FROM tk_base GROUP BY o_custkey) "
    "SELECT s.o_custkey, s.n, r.last_order, c.c_mktsegment FROM tk_spend s JOIN tk_recent r USING (o_custkey) "
    "JOIN customer c ON c.c_custkey = s.o_custkey WHERE s.n >= 2")


def _chain(spark, d):
    ws = SqlWorkspace(spark)
    for n in ("orders", "customer"):
        ws.register_table(n, table(spark, d, n))
    ws.cell("tk_base", "SELECT * FROM orders WHERE o_orderstatus = {{ status }}", {"status": "F"},
            return_type="query_preview")
    ws.cell("tk_spend", "SELECT o_custkey, sum(o_custkey) AS weight, count(*) AS n FROM tk_base "
                        "GROUP BY o_custkey", return_type="query_preview")
    ws.cell("tk_recent", "SELECT o_custkey, max(o_orderdate) AS last_order FROM tk_base GROUP BY o_custkey",
            return_type="query_preview")
    # diamond: both branches read tk_base; the final cell keeps its own WITH clause
    final = ws.cell("tk_final", "WITH big AS (SELECT * FROM tk_spend WHERE n >= {{ min_n }}) "
                                "SELECT big.o_custkey, big.n, r.last_order, c.c_mktsegment FROM big "
                                "JOIN tk_recent r USING (o_custkey) JOIN customer c ON c.c_custkey = big.o_custkey",
                    {"min_n": 2}, return_type="query_preview")
    ws.drop()
    return final


@query("sql_chained", CHAIN_SQL)
def sql_chained_q(spark, d):
    return _chain(spark, d).full


@query("sql_query_preview",
       "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sql_query_preview_q(spark, d):
    ws = SqlWorkspace(spark)
    ws.register_table("orders", table(spark, d, "orders"))
    qp = ws.cell("tk_open", "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey",
                 return_type="query_preview")
    ws.drop()
    return qp.preview


@query("sql_cell",
       "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_acctbal >= 1000 GROUP BY c_mktsegment")
def sql_cell_q(spark, d):
    ws = SqlWorkspace(spark)
    ws.register_table("customer", table(spark, d, "customer"))
    df = ws.cell(None, "-- customers per segment\nSELECT c_mktsegment, count(*) AS customers FROM customer "
                       "WHERE c_acctbal >= {{ bal }} GROUP BY c_mktsegment;", {"bal": 1000})
    ws.drop()
    return df


@query("sql_result_cache",
       "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' "
       "GROUP BY o_orderpriority")
def sql_result_cache_q(spark, d):
    q = ("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate < {{ before }} "
         "GROUP BY o_orderpriority")
    tabs = _tables(spark, d, "orders")
    # first call writes (or reads an earlier complete entry), second call reads
    cached_sql(spark, q, {"before": "1998-01-01"}, tables=tabs)
    return cached_sql(spark, q, {"before": "1998-01-01"}, tables=tabs).df


@query("sql_result_cache_changed",
       "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey % 2 = 1 GROUP BY o_orderstatus")
def sql_result_cache_changed(spark, d):
    # the same text over another input under the same name is computed anew
    q = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
    o = table(spark, d, "orders")
    cached_sql(spark, q, tables={"orders": o.filter("o_custkey % 2 = 0")})
    return cached_sql(spark, q, tables={"orders": o.filter("o_custkey % 2 = 1")}).df


@query("spark_sql_cell",
       "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def spark_sql_cell_q(spark, d):
    df = spark_sql_cell(spark, "SELECT l_returnflag, count(*) AS n FROM {src} WHERE l_quantity > {qty} "
                               "GROUP BY l_returnflag", {"src": table(spark, d, "lineitem"), "qty": 10},
                        view="tk_flags")
    spark.catalog.dropTempView("tk_flags")
    return df


# --- relational categories passed through as SQL ----------------------------------------

def _sql(spark, d, q, *names):
    return sql_on_tables(spark, q, _tables(spark, d, *names))


JOIN_COLS = "c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_orderstatus"


@query("sql_join_inner", f"SELECT {JOIN_COLS} FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def sql_join_inner(spark, d):
    return _sql(spark, d, f"SELECT {JOIN_COLS} FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
                "customer", "orders")


@query("sql_join_left", f"SELECT {JOIN_COLS} FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def sql_join_left(spark, d):
    return _sql(spark, d, f"SELECT {JOIN_COLS} FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
                "customer", "orders")


@query("sql_join_right",
       f"SELECT {JOIN_COLS} FROM (SELECT * FROM customer WHERE c_acctbal > 0) c RIGHT JOIN orders o "
       "ON c.c_custkey = o.o_custkey")
def sql_join_right(spark, d):
    return _sql(spark, d, f"SELECT {JOIN_COLS} FROM (SELECT * FROM customer WHERE c_acctbal > 0) c "
                          "RIGHT JOIN orders o ON c.c_custkey = o.o_custkey", "customer", "orders")


@query("sql_join_full",
       f"SELECT {JOIN_COLS} FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN "
       "(SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey")
def sql_join_full(spark, d):
    return _sql(spark, d, f"SELECT {JOIN_COLS} FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN "
                          "(SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey",
                "customer", "orders")


GROUP_SQL = ("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, "
             "round(sum(l_extendedprice), 2) AS sum_base_price, count(*) AS count_order, "
             "CAST(round(min(l_discount * 100)) AS BIGINT) AS min_disc_pct FROM lineitem "
             "WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")


@query("sql_group_by", GROUP_SQL)
def sql_group_by(spark, d):
    # an explicit round before the cast: engines differ on double -> bigint casts
    return _sql(spark, d, GROUP_SQL, "lineitem")


CTE_SQL = ("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
           "SELECT s.c_mktsegment, count(*) AS customers, CAST(sum(s.n) AS BIGINT) AS orders_total FROM "
           "(SELECT c.c_mktsegment, big.n FROM customer c JOIN big ON big.o_custkey = c.c_custkey "
           "WHERE big.n > (SELECT avg(n) FROM big)) s GROUP BY s.c_mktsegment")


@query("sql_cte_subquery", CTE_SQL)
def sql_cte_subquery(spark, d):
    return _sql(spark, d, CTE_SQL, "customer", "orders")


@query("sql_scalar_text",
       "SELECT c_custkey, concat(c_name, ' (', c_mktsegment, ')') AS label, CAST(floor(c_acctbal) AS BIGINT) AS bal, "
       "'100%' AS pct FROM customer")
def sql_scalar_text(spark, d):
    return _sql(spark, d, "SELECT c_custkey, concat(c_name, ' (', c_mktsegment, ')') AS label, "
                          "CAST(floor(c_acctbal) AS BIGINT) AS bal, '100%' AS pct FROM customer", "customer")


@query("sql_order_limit",
       "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 "
       "ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sql_order_limit(spark, d):
    return _sql(spark, d, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 "
                          "ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")


@query("sql_struct_array",
       "SELECT c_custkey, CAST(to_json({'seg': c_mktsegment, 'nation': c_nationkey}) AS VARCHAR) AS s, "
       "CAST(to_json([c_custkey, c_nationkey]) AS VARCHAR) AS a, CAST(x AS INTEGER) AS x "
       "FROM customer, unnest(generate_series(0, c_nationkey)) AS u(x)")
def sql_struct_array(spark, d):
    return _sql(spark, d, "SELECT c_custkey, to_json(named_struct('seg', c_mktsegment, 'nation', c_nationkey)) AS s, "
                          "to_json(array(c_custkey, c_nationkey)) AS a, x "
                          "FROM customer LATERAL VIEW explode(sequence(0, c_nationkey)) t AS x", "customer")


@query("sql_nested_as_text",
       "SELECT n_nationkey, CAST(to_json({'name': n_name, 'region': {'id': n_regionkey}}) AS VARCHAR) AS nested, "
       "CAST(to_json([[n_nationkey], [n_regionkey, n_nationkey]]) AS VARCHAR) AS arrays FROM nation")
def sql_nested_as_text(spark, d):
    return _sql(spark, d, "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', "
                          "named_struct('id', n_regionkey))) AS nested, "
                          "to_json(array(array(n_nationkey), array(n_regionkey, n_nationkey))) AS arrays FROM nation",
                "nation")
