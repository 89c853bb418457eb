"""Acceptance queries: names, sorting, paging, counting, sampling, limits.

Ordered results carry a ``row_index`` column so the order itself is checked
(the comparison of result sets ignores row order).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shape import (add_index_after_limit, add_limit, paginate, prepare_columns,
                               sample_n, size, sort_multi, with_row_index, PageIndex)
from ..plans.browse import page_of_preview, preview_head
from . import query, table

ORDERS_KEYS = [("o_orderdate", False), ("o_orderkey", True)]
ORDERS_ORDER_SQL = "o_orderdate DESC NULLS LAST, o_orderkey ASC NULLS LAST"


def _page_sql(start: int, size: int) -> str:
    return (f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {ORDERS_ORDER_SQL}) - 1 AS BIGINT) "
            f"AS row_index FROM orders) WHERE row_index >= {start} AND row_index < {start + size}")


@query("prepare_columns",
       'SELECT o_orderkey, o_orderkey AS "o_orderkey.1", o_custkey, o_custkey AS "o_custkey.1", '
       'o_orderstatus FROM orders')
def prepare_columns_q(spark, d):
    o = table(spark, d, "orders")
    dup = o.select("o_orderkey", F.col("o_orderkey").alias("o_orderkey"), "o_custkey",
                   F.col("o_custkey").alias("o_custkey"), "o_orderstatus")
    return prepare_columns(dup, max_columns=500)


@query("prepare_columns_cut", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def prepare_columns_cut(spark, d):
    return prepare_columns(table(spark, d, "lineitem"), max_columns=3)


@query("sort_multi", "SELECT *, CAST(row_number() OVER (ORDER BY o_orderpriority ASC NULLS LAST, "
       "o_totalprice DESC NULLS LAST, o_orderkey ASC) - 1 AS BIGINT) AS row_index FROM orders")
def sort_multi_q(spark, d):
    o = table(spark, d, "orders")
    keys = [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True), ("nope", True)]
    # the unknown sort column is ignored; the index proves the order
    return with_row_index(sort_multi(o, keys), keys, "row_index")


@query("paginate", _page_sql(0, 10))
def paginate_first(spark, d):
    return paginate(table(spark, d, "orders"), 0, 10, ORDERS_KEYS, index_col="row_index")


@query("paginate_page7", _page_sql(70, 10))
def paginate_page7(spark, d):
    return paginate(table(spark, d, "orders"), 7, 10, ORDERS_KEYS, index_col="row_index")


@query("paginate_past_end",
       f"SELECT * FROM ({_page_sql(0, 10**9)}) "
       "WHERE row_index >= (SELECT (CAST(ceil(count(*) / 10.0) AS BIGINT) - 1) * 10 FROM orders)")
def paginate_past_end(spark, d):
    return paginate(table(spark, d, "orders"), 10**6, 10, ORDERS_KEYS, index_col="row_index")


def _clamped_page_sql(page: int, size: int) -> str:
    """Page ``page`` clamped to the last page, as SQL (independent of scale)."""
    start = (f"(SELECT least({page}, CAST(ceil(count(*) / {float(size)}) AS BIGINT) - 1) * {size} "
             "FROM orders)")
    return (f"SELECT * FROM ({_page_sql(0, 10**12)}) WHERE row_index >= {start} "
            f"AND row_index < {start} + {size}")


@query("paginate_deep", _clamped_page_sql(280, 25))
def paginate_deep(spark, d):
    # the page's key range is found first, whatever the page number
    return paginate(table(spark, d, "orders"), 280, 25, ORDERS_KEYS, index_col="row_index",
                    direct_rows=0)


@query("row_index", "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, "
       "o_orderkey ASC) - 1 AS BIGINT) AS row_index FROM orders")
def row_index_q(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return with_row_index(o, [("o_totalprice", False), ("o_orderkey", True)], "row_index")


@query("row_index_after_limit",
       f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {ORDERS_ORDER_SQL}) - 1 AS BIGINT) "
       "AS row_index FROM orders) WHERE row_index < 1000")
def row_index_after_limit(spark, d):
    return add_index_after_limit(table(spark, d, "orders"), 1000, ORDERS_KEYS)


@query("size", "SELECT count(*) AS row_count FROM lineitem")
def size_q(spark, d):
    return spark.createDataFrame([(size(table(spark, d, "lineitem")),)], "row_count long")


def _by_price(spark, d):
    # many rows share a sort value; the id decides last
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 1000).cast("int").alias("cents"), "o_orderstatus")
    return o, [("cents", False), ("o_orderkey", True)]


BY_PRICE = ("(SELECT o_orderkey, CAST(trunc(o_totalprice % 1000) AS INTEGER) AS cents, o_orderstatus, "
            "CAST(row_number() OVER (ORDER BY trunc(o_totalprice % 1000) DESC, o_orderkey) - 1 AS BIGINT) AS row_index FROM orders)")


@query("page_index_pages", " UNION ALL ".join(
    f"SELECT * FROM {BY_PRICE} WHERE row_index >= {size} * least({k}, (SELECT (count(*) - 1) // {size} FROM orders)) "
    f"AND row_index < {size} * least({k}, (SELECT (count(*) - 1) // {size} FROM orders)) + {size}"
    for k, size in ((0, 20), (7, 33), (40, 25), (10 ** 6, 500))))
def page_index_pages(spark, d):
    # pages of one index: the first, some inside, one past the end
    index = PageIndex(*_by_price(spark, d), ranges=16)
    out = None
    for k, size in ((0, 20), (7, 33), (40, 25), (10 ** 6, 500)):
        page = index.page(k, size, "row_index")
        out = page if out is None else out.unionByName(page)
    return out


@query("page_index_rows", f"SELECT * FROM {BY_PRICE}")
def page_index_rows(spark, d):
    return PageIndex(*_by_price(spark, d), ranges=100).row_index()


@query("sample_n", "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42') LIMIT 500")
def sample_n_q(spark, d):
    return sample_n(table(spark, d, "orders"), 500, seed=42, key_columns=["o_orderkey"])


CONTENT_SQL = "|| ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-') "
                         for c in ("user_id", "event_type"))


@query("sample_n_by_content",
       f"SELECT user_id, event_type FROM (SELECT *, md5(d || '|' || (row_number() OVER (PARTITION BY d) - 1) || '|11') AS u FROM "
       f"(SELECT user_id % 50 AS user_id, nullif(event_type, 'error') AS event_type FROM events) e, LATERAL (SELECT md5({CONTENT_SQL}) AS d)) "
       "ORDER BY u, d LIMIT 400")
def sample_n_by_content(spark, d):
    # few different rows with many copies; the copies are sampled one by one
    ev = table(spark, d, "events").select((F.col("user_id") % 50).alias("user_id"), F.expr("nullif(event_type, 'error')").alias("event_type"))
    return sample_n(ev.repartition(3), 400, seed=11)


@query("sample_n_multi_key",
       "SELECT * FROM lineitem ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|' || "
       "CAST(l_linenumber AS VARCHAR) || '|7') LIMIT 1000")
def sample_n_multi_key(spark, d):
    return sample_n(table(spark, d, "lineitem"), 1000, seed=7, key_columns=["l_orderkey", "l_linenumber"])


@query("paginate_ties", "SELECT l_linestatus, l_orderkey, l_linenumber FROM lineitem")
def paginate_ties(spark, d):
    # one tied sort key: all pages together give every row once; the rows are dealt into partitions of bounded size
    li = table(spark, d, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber")
    total = size(li)
    li = li.repartition(max(7, total // 500_000), "l_orderkey", "l_linenumber")
    step = total // 5 + 1
    pages = [paginate(li, k, step, [("l_linestatus", True)], total=total) for k in range(5)]
    return functools.reduce(DataFrame.unionByName, pages)


@query("sample_n_null_key",
       "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders "
       "ORDER BY md5(coalesce(nullif(o_orderpriority, '5-LOW'), chr(0)) || '|' || o_orderkey || '|3') LIMIT 300")
def sample_n_null_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"))
    return sample_n(o, 300, seed=3, key_columns=["prio", "o_orderkey"])


@query("add_limit", "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def add_limit_q(spark, d):
    q = spark.sql("SELECT * FROM {o} WHERE o_orderstatus = 'F' ORDER BY o_orderkey",
                  o=table(spark, d, "orders"))
    return add_limit(q, 100)


@query("add_limit_inner_smaller",
       "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def add_limit_inner(spark, d):
    q = spark.sql("SELECT * FROM {o} WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20",
                  o=table(spark, d, "orders"))
    return add_limit(q, 100)


@query("page_of_preview",
       f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {ORDERS_ORDER_SQL}) - 1 AS BIGINT) AS row_index FROM orders) "
       "WHERE row_index < 10000 AND row_index >= (SELECT CAST(ceil(least(count(*), 10000) / 25.0) AS BIGINT) * 25 - 25 FROM orders)")
def page_of_preview_q(spark, d):
    head = preview_head(sort_multi(table(spark, d, "orders"), ORDERS_KEYS), ORDERS_KEYS, "head", 10_000)
    return page_of_preview(head, 10**6, 25)
