"""Acceptance queries: browse and preview pipelines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.spec import read_view
from ..plans.browse import (HeldPreview, apply_browse_spec, browse_page, browse_table, data_preview_json, preview_head,
                            preview_total_size, selected_rows)
from . import query, table

# Flagship browse spec: a numeric and a text filter, two sort keys plus a
# unique tie-break, page 0.
LINEITEM_SPEC = {
    "filters": [{"column": "l_quantity", "operator": "greater-than-or-equal", "comparativeValues": ["10"]},
                {"column": "l_returnflag", "operator": "text-contains", "comparativeValues": ["r"]}],
    "conditionalFilters": [{"column": "l_discount", "operator": "less-than", "comparativeValues": [0.05]}],
    "sortBy": [{"id": "l_shipdate", "type": "desc"}, {"id": "l_extendedprice", "type": "asc"},
               {"id": "l_orderkey", "type": "asc"}, {"id": "l_linenumber", "type": "asc"},
               {"id": "gone", "type": "asc"}],
    "pageIndex": 0, "pageSize": 10,
}
LINEITEM_WHERE = ("l_quantity >= 10 AND contains(lower(l_returnflag), 'r') AND l_discount < 0.05")
LINEITEM_ORDER = ("l_shipdate DESC NULLS LAST, l_extendedprice ASC NULLS LAST, "
                  "l_orderkey ASC NULLS LAST, l_linenumber ASC NULLS LAST")
LINEITEM_JSON_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                      "l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate")


def _browse_sql(start: int, size: int) -> str:
    return (f"SELECT {LINEITEM_JSON_COLS}, row_index FROM (SELECT *, CAST(row_number() OVER "
            f"(ORDER BY {LINEITEM_ORDER}) - 1 AS BIGINT) AS row_index FROM lineitem WHERE {LINEITEM_WHERE}) "
            f"WHERE row_index >= {start} AND row_index < {start + size}")


def browse_lineitem(spark, d, page_index: int = 0):
    li = table(spark, d, "lineitem")
    spec = read_view({**LINEITEM_SPEC, "pageIndex": page_index}, li.columns)
    return browse_page(li, spec)


LINEITEM_JSON_SCHEMA = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                        "l_shipdate string, row_count long, preview_row_count long")


@query("browse_table", _browse_sql(0, 10).replace("row_index FROM (SELECT *,", f"(SELECT count(*) FROM lineitem WHERE {LINEITEM_WHERE}) "
       f"AS row_count, (SELECT count(*) FROM lineitem WHERE {LINEITEM_WHERE}) AS preview_row_count FROM (SELECT *,"))
def browse_table_q(spark, d):
    shown = browse_table(table(spark, d, "lineitem"), LINEITEM_SPEC)
    return spark.createDataFrame([{**r, "row_count": shown.total, "preview_row_count": shown.held} for r in shown.page], LINEITEM_JSON_SCHEMA)


@query("browse_table_big", "SELECT CAST(big AS VARCHAR) AS big, o_custkey, row_index FROM (SELECT o_orderkey * 9007199254740 AS big, o_custkey, "
       "CAST(row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS BIGINT) AS row_index FROM orders) WHERE row_index < 10")
def browse_table_big(spark, d):
    # numbers past 2^53 on the page become text; keys past 1,024,000 make numbers past 2^63
    o = table(spark, d, "orders").select((F.col("o_orderkey").cast("decimal(20,0)") * F.lit(9007199254740)).alias("big"), "o_custkey")
    return browse_page(o, {"sortBy": [{"id": "big", "type": "desc"}]})


@query("browse_table_page3", _browse_sql(30, 10))
def browse_table_page3(spark, d):
    return browse_lineitem(spark, d, 3)


@query("apply_browse_spec", f"SELECT * FROM lineitem WHERE {LINEITEM_WHERE}")
def apply_browse_spec_q(spark, d):
    li = table(spark, d, "lineitem")
    return apply_browse_spec(li, LINEITEM_SPEC)


@query("data_preview_head",
       f"SELECT {LINEITEM_JSON_COLS}, row_index FROM (SELECT *, CAST(row_number() OVER "
       f"(ORDER BY {LINEITEM_ORDER}) - 1 AS BIGINT) AS row_index FROM lineitem WHERE {LINEITEM_WHERE}) "
       "WHERE row_index < 10000")
def data_preview_head_q(spark, d):
    with HeldPreview(table(spark, d, "lineitem"), most=10_000) as held:
        held.show(LINEITEM_SPEC)
        rows = held.data.toArrow()          # the bounded edge: 10,000 rows
        return spark.createDataFrame(rows, held.data.schema)


@query("data_preview_sampled",
       "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' "
       "ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42') LIMIT 1000)")
def data_preview_sampled_q(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice")
    head = preview_head(o, [("o_totalprice", False)], "sampled", 1000, seed=42, sample_keys=["o_orderkey"])
    return head.drop("row_index")


@query("data_preview_json",
       "SELECT row_index, json FROM (SELECT *, sum(strlen(json)) OVER (ORDER BY row_index "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_bytes FROM (SELECT row_index, "
       "to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'row_index': row_index})::VARCHAR AS json FROM ("
       "SELECT doc_id, text, lang, CAST(row_number() OVER (ORDER BY lang DESC, doc_id) - 1 AS BIGINT) AS row_index FROM ("
       "SELECT doc_id, text, lang FROM documents WHERE lang IN ('en', 'de') ORDER BY md5(doc_id || '|42') LIMIT 400)))) "
       "WHERE running_bytes <= 10485760")
def data_preview_json_q(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    text = data_preview_json(docs, '[{"column": "lang", "operator": "is-one-of", "comparativeValues": ["EN", "de"]}]',
                             '[["lang", false], ["doc_id", true]]', 400, "sampled", sample_keys=["doc_id"], most_chars=None)
    records = json.loads(text)
    line = lambda r: json.dumps(r, ensure_ascii=False, separators=(",", ":"))
    return spark.createDataFrame([(r["row_index"], line(r)) for r in records], "row_index long, json string")


@query("preview_total_size",
       f"SELECT count(*) AS row_count, least(count(*), 10000) AS preview_row_count FROM lineitem "
       f"WHERE {LINEITEM_WHERE}")
def preview_total_size_q(spark, d):
    li = table(spark, d, "lineitem")
    return preview_total_size(selected_rows(li, LINEITEM_SPEC))
