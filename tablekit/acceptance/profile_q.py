"""Acceptance queries for column profiles.

The oracle SQL is generated per column from the known table layouts and says,
in plain SQL, what each statistic means (histogram edges ``k * step + lo``,
categories with an ``others`` and a ``Missing`` slot, NaN counted as missing).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import (Profile, analyze_columns, color_scale_min_max, distinct_values,
                                 estimate_csv_size_df)
from ..operators.sketches import column_sketches, estimates, merge_sketches
from . import query, table

# Column layouts of the given tables (kind: int, dbl, ts, str).
LINEITEM = [("l_orderkey", "int", "bigint"), ("l_partkey", "int", "bigint"), ("l_suppkey", "int", "bigint"),
            ("l_linenumber", "int", "int"), ("l_quantity", "dbl", "double"),
            ("l_extendedprice", "dbl", "double"), ("l_discount", "dbl", "double"), ("l_tax", "dbl", "double"),
            ("l_returnflag", "str", "string"), ("l_linestatus", "str", "string"),
            ("l_shipdate", "ts", "timestamp_ntz")]
EVENTS = [("event_id", "int", "bigint"), ("ts", "ts", "timestamp_ntz"), ("user_id", "int", "bigint"),
          ("event_type", "str", "string"), ("value", "dbl", "double"), ("props", "str", "string")]
CUSTOMER = [("c_custkey", "int", "bigint"), ("c_name", "str", "string"), ("c_nationkey", "int", "int"),
            ("c_acctbal", "dbl", "double"), ("c_mktsegment", "str", "string")]

# events with missing cells: 'error' types are null, 'view' values are NaN, 'click' values null
EVENTS_MISSING_SQL = ("SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, "
                      "CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE WHEN event_type = 'click' THEN NULL "
                      "ELSE value END AS value, props FROM events")


def events_missing(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", "ts", "user_id", F.expr("nullif(event_type, 'error')").alias("event_type"),
                     F.when(F.col("event_type") == "view", F.lit(float("nan")))
                      .when(F.col("event_type") == "click", F.lit(None).cast("double"))
                      .otherwise(F.col("value")).alias("value"), "props")


def _src(t: str) -> str:
    """A table name, the events-with-missing projection, or a parenthesised query."""
    return f"({EVENTS_MISSING_SQL})" if t == "events_missing" else t


def _missing_sql(c: str, kind: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if kind == "dbl" else f"{c} IS NULL"


def _present(c: str, kind: str) -> str:
    return f"NOT {_missing_sql(c, kind)}"


def unique_sql(t: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) FILTER (WHERE {_present(c, k)}) AS unique_count "
        f"FROM {_src(t)}" for c, k, _ in cols)


def null_sql(t: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_missing_sql(c, k)}) AS nan_count FROM {_src(t)}"
        for c, k, _ in cols)


def _minmax_expr(c: str, k: str, fn: str) -> str:
    if k == "str":
        return "CAST(max(NULL) AS VARCHAR)"
    filt = f" FILTER (WHERE NOT isnan({c}))" if k == "dbl" else ""
    return f"CAST({fn}({c}){filt} AS VARCHAR)"


def minmax_sql(t: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_minmax_expr(c, k, 'min')} AS min, {_minmax_expr(c, k, 'max')} AS max "
        f"FROM {_src(t)}" for c, k, _ in cols)


def _axis(c: str, k: str) -> str:
    return f"CAST(epoch_us({c}) AS DOUBLE)" if k == "ts" else f"CAST({c} AS DOUBLE)"


def _hist_one(t: str, c: str, k: str) -> str:
    x = _axis(c, k)
    finite = f"{x} IS NOT NULL AND isfinite({x})" if k == "dbl" else f"{x} IS NOT NULL"
    edges = " + ".join(f"CAST(x >= {i} * step + lo AS INTEGER)" for i in range(1, 10))
    return (
        f"SELECT * FROM (WITH v AS (SELECT {x} AS x FROM {_src(t)} WHERE {finite}), "
        "r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, "
        "CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v), "
        "e AS (SELECT lo, hi, (hi - lo) / 10 AS step FROM r WHERE lo IS NOT NULL), "
        f"b AS (SELECT {edges} AS bin, count(*) AS cnt FROM v, e GROUP BY 1) "
        f"SELECT '{c}' AS column_name, CAST(g.bin AS INTEGER) AS bin, g.bin * step + lo AS bin_start, "
        "CASE WHEN g.bin = 9 THEN hi ELSE (g.bin + 1) * step + lo END AS bin_end, "
        "CAST(coalesce(b.cnt, 0) AS BIGINT) AS count "
        "FROM e, (SELECT range AS bin FROM range(10)) g LEFT JOIN b ON b.bin = g.bin)")


def hist_sql(t: str, cols) -> str:
    return " UNION ALL ".join(_hist_one(t, c, k) for c, k, _ in cols if k != "str")


def _cat_one(t: str, c: str) -> str:
    return (
        f"SELECT * FROM (WITH c AS (SELECT v, count(*) AS cnt FROM (SELECT CAST({c} AS VARCHAR) AS v "
        f"FROM {_src(t)}) WHERE v IS NOT NULL GROUP BY v), "
        "r AS (SELECT v, cnt, row_number() OVER (ORDER BY cnt DESC, v ASC) AS rk FROM c), "
        f"q0 AS (SELECT (SELECT count(*) FROM c) AS uniq, (SELECT coalesce(sum(cnt), 0) FROM c) AS nn, "
        f"(SELECT count(*) FROM {_src(t)} WHERE {c} IS NULL) AS nan), "
        "q1 AS (SELECT *, 3 - CAST(nan > 0 AS INTEGER) AS slots FROM q0), "
        "q AS (SELECT *, CASE WHEN uniq > slots THEN slots - 1 ELSE slots END AS shown FROM q1) "
        f"SELECT '{c}' AS column_name, CAST(rk AS INTEGER) AS position, v AS name, cnt AS count "
        "FROM r, q WHERE rk <= shown "
        f"UNION ALL SELECT '{c}', CAST(shown + 1 AS INTEGER), CAST(uniq - shown AS VARCHAR) || ' others', "
        "CAST(nn - (SELECT coalesce(sum(cnt), 0) FROM r, q WHERE rk <= shown) AS BIGINT) FROM q WHERE uniq > slots "
        f"UNION ALL SELECT '{c}', CAST(least(uniq, slots) + 1 AS INTEGER), 'Missing', nan FROM q WHERE nan > 0)")


def cat_sql(t: str, cols) -> str:
    return " UNION ALL ".join(_cat_one(t, c) for c, k, _ in cols if k == "str")


def _analyze_sql(t: str, cols) -> str:
    hist = hist_sql(t, cols)
    cats = cat_sql(t, cols)
    parts = []
    for i, (c, k, dtype) in enumerate(cols):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{dtype}' AS dtype, "
            f"(SELECT count(DISTINCT {c}) FILTER (WHERE {_present(c, k)}) FROM {_src(t)}) AS unique_count, "
            f"(SELECT count(*) FILTER (WHERE {_missing_sql(c, k)}) FROM {_src(t)}) AS nan_count, "
            f"(SELECT {_minmax_expr(c, k, 'min')} FROM {_src(t)}) AS min, "
            f"(SELECT {_minmax_expr(c, k, 'max')} FROM {_src(t)}) AS max")
    base = " UNION ALL ".join(parts)
    return (
        f"SELECT b.*, h.histogram_counts, ct.categories_text FROM ({base}) b "
        f"LEFT JOIN (SELECT column_name, string_agg(CAST(count AS VARCHAR), ',' ORDER BY bin) AS histogram_counts "
        f"FROM ({hist}) GROUP BY column_name) h USING (column_name) "
        f"LEFT JOIN (SELECT column_name, string_agg(name || ':' || CAST(count AS VARCHAR), '|' ORDER BY position) "
        f"AS categories_text FROM ({cats}) GROUP BY column_name) ct USING (column_name)")


def flat_profile(tab):
    """Profile table with arrays rendered as text, for comparison."""
    return tab.select(
        "position", "column_name", "dtype", "unique_count", "nan_count", "min", "max",
        F.array_join(F.transform("histogram", lambda x: x["count"].cast("string")), ",").alias("histogram_counts"),
        F.array_join(F.transform("categories", lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))),
                     "|").alias("categories_text"))


@query("profile_unique_count", unique_sql("lineitem", LINEITEM))
def profile_unique_count(spark, d):
    return Profile(table(spark, d, "lineitem")).unique_counts()


@query("profile_unique_count_missing", unique_sql("events_missing", EVENTS))
def profile_unique_count_missing(spark, d):
    return Profile(events_missing(spark, d)).unique_counts()


@query("profile_null_count", null_sql("events_missing", EVENTS))
def profile_null_count(spark, d):
    return Profile(events_missing(spark, d)).null_counts()


@query("profile_min_max", minmax_sql("events_missing", EVENTS) + " UNION ALL " + minmax_sql("lineitem", LINEITEM))
def profile_min_max(spark, d):
    return Profile(events_missing(spark, d)).min_max().unionByName(
        Profile(table(spark, d, "lineitem")).min_max())


@query("profile_histogram", hist_sql("lineitem", LINEITEM))
def profile_histogram(spark, d):
    return Profile(table(spark, d, "lineitem")).histograms()


@query("profile_histogram_missing", hist_sql("events_missing", EVENTS))
def profile_histogram_missing(spark, d):
    return Profile(events_missing(spark, d)).histograms()


@query("profile_categories", cat_sql("events_missing", EVENTS) + " UNION ALL " + cat_sql("customer", CUSTOMER)
       + " UNION ALL " + cat_sql("lineitem", LINEITEM))
def profile_categories(spark, d):
    return (Profile(events_missing(spark, d)).categories()
            .unionByName(Profile(table(spark, d, "customer")).categories())
            .unionByName(Profile(table(spark, d, "lineitem")).categories()))


def _rows_sql(t: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count FROM {_src(t)}" for c, _, _ in cols)


def _exact_sql(t: str, cols) -> str:
    return (f"SELECT column_name, row_count, nan_count, min, max FROM ({_rows_sql(t, cols)}) JOIN ({null_sql(t, cols)}) "
            f"USING (column_name) JOIN ({minmax_sql(t, cols)}) USING (column_name)")


@query("profile_sketches_merged", _exact_sql("events_missing", EVENTS) + " UNION ALL " + _exact_sql("lineitem", LINEITEM))
def profile_sketches_merged(spark, d):
    # the exact parts of sketches that were made for seven parts and merged
    out = []
    for df, key in ((events_missing(spark, d), "event_id"), (table(spark, d, "lineitem"), "l_orderkey")):
        merged = merge_sketches(column_sketches(df, by=F.pmod(F.col(key), F.lit(7))))
        out.append(merged.select("column_name", F.col("rows").alias("row_count"), F.col("missing").alias("nan_count"),
                                 F.col("low.text").alias("min"), F.col("high.text").alias("max")))
    return out[0].unionByName(out[1])


@query("profile_sketch_categories", " UNION ALL ".join([
    cat_sql("events_missing", [("event_type", "str", "string")]), cat_sql("customer", [("c_mktsegment", "str", "string")]),
    cat_sql("lineitem", [("l_returnflag", "str", "string"), ("l_linestatus", "str", "string")])]))
def profile_sketch_categories(spark, d):
    # frequent values of merged sketches are exact while a column has few
    out = None
    for df, names in ((events_missing(spark, d), ["event_type"]), (table(spark, d, "customer"), ["c_mktsegment"]),
                      (table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])):
        merged = merge_sketches(column_sketches(df, names, F.pmod(F.xxhash64(*df.columns), F.lit(3))))
        part = estimates(merged).select("column_name", F.posexplode("categories").alias("at", "c")).select(
            "column_name", (F.col("at") + 1).alias("position"), "c.name", "c.count")
        out = part if out is None else out.unionByName(part)
    return out


@query("profile_sketch_histogram_edges", " UNION ALL ".join([
    "SELECT column_name, bin, bin_start, bin_end FROM (" + hist_sql(t, c) + ")" for t, c in (("events_missing", EVENTS), ("lineitem", LINEITEM))]))
def profile_sketch_histogram_edges(spark, d):
    out = None
    for df in (events_missing(spark, d), table(spark, d, "lineitem")):
        part = analyze_columns(df, approx=True).select("column_name", F.posexplode("histogram").alias("bin", "h")).select(
            "column_name", "bin", "h.bin_start", "h.bin_end")
        out = part if out is None else out.unionByName(part)
    return out


@query("analyze_columns", _analyze_sql("customer", CUSTOMER))
def analyze_columns_q(spark, d):
    return flat_profile(analyze_columns(table(spark, d, "customer")))


@query("analyze_columns_missing", _analyze_sql("events_missing", EVENTS))
def analyze_columns_missing(spark, d):
    return flat_profile(analyze_columns(events_missing(spark, d)))


@query("analyze_color_scale",
       "SELECT 'o_totalprice' AS column_name, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders "
       "UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE) FROM orders")
def analyze_color_scale_q(spark, d):
    # colour-scale picks: a text column is ignored, numeric ones get min/max
    return color_scale_min_max(table(spark, d, "orders"), ["o_totalprice", "o_custkey", "o_orderpriority"])


def _distinct_sql(t: str, c: str, n: int) -> str:
    return (f"SELECT '{c}' AS column_name, CAST(rk AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value FROM "
            f"(SELECT v, row_number() OVER (ORDER BY v) AS rk FROM (SELECT DISTINCT {c} AS v FROM {t} "
            f"WHERE {c} IS NOT NULL)) WHERE rk <= {n}")


@query("distinct_values", " UNION ALL ".join([_distinct_sql("orders", "o_orderpriority", 30),
                                              _distinct_sql("orders", "o_totalprice", 30),
                                              _distinct_sql("part", "p_size", 30)]))
def distinct_values_q(spark, d):
    o = distinct_values(table(spark, d, "orders"), ["o_orderpriority", "o_totalprice"], 30)
    p = distinct_values(table(spark, d, "part"), ["p_size"], 30)
    return o.unionByName(p)


@query("estimate_csv_size",
       "SELECT count(*) AS row_count, CAST(sum(strlen(concat_ws(',', CAST(o_orderkey AS VARCHAR), "
       "CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), "
       "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), o_orderpriority)) + 1) "
       "+ strlen('o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority') + 1 AS BIGINT) "
       "AS csv_bytes FROM orders")
def estimate_csv_size_q(spark, d):
    return estimate_csv_size_df(table(spark, d, "orders"))


# describe / preview stats: the profile of the *processed* table (after the spec's filters)
DESCRIBE_SPEC = {"filters": [{"column": "c_mktsegment", "operator": "is-not-one-of",
                              "comparativeValues": ["household"]},
                             {"column": "c_acctbal", "operator": "greater-than", "comparativeValues": ["0"]}],
                 "sortBy": [{"id": "c_acctbal", "type": "desc"}], "pageSize": 5}
DESCRIBE_SRC = "(SELECT * FROM customer WHERE lower(c_mktsegment) NOT IN ('household') AND c_acctbal > 0)"


def stats_table(spark, columns, extra=(), extra_schema=""):
    """Column-stat records (as the describe document holds them) as a table."""
    rows = [(i, c["name"], c["dtype"], s["unique_count"], s["nan_count"], s["min"], s["max"],
             ",".join(str(h["count"]) for h in (s["histogram"] or [])) or None,
             "|".join(f"{x['name']}:{x['count']}" for x in (s["categories"] or [])) or None, *extra)
            for i, c in enumerate(columns) for s in [c["stats"]]]
    return spark.createDataFrame(rows, "position int, column_name string, dtype string, unique_count long, "
                                       "nan_count long, min string, max string, histogram_counts string, "
                                       "categories_text string" + extra_schema)


@query("describe_table",
       f"SELECT p.*, (SELECT count(*) FROM {DESCRIBE_SRC}) AS row_count, 5 AS column_count "
       f"FROM ({_analyze_sql(DESCRIBE_SRC, CUSTOMER)}) p")
def describe_table_q(spark, d):
    from ..plans.browse import describe_table
    doc = describe_table(table(spark, d, "customer"), DESCRIBE_SPEC)
    return stats_table(spark, doc["columns"], (doc["row_count"], doc["column_count"]),
                       ", row_count long, column_count int")


PREVIEW_SRC = ("(SELECT * FROM (SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, "
               "CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE WHEN event_type = 'click' THEN NULL "
               "ELSE value END AS value, props FROM events) WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')")


@query("preview_column_stats", _analyze_sql(PREVIEW_SRC, EVENTS))
def preview_column_stats_q(spark, d):
    from ..plans.browse import HeldPreview
    with HeldPreview(events_missing(spark, d), most=10_000) as held:
        held.show({"filters": [{"column": "ts", "operator": "is-after", "comparativeValues": ["2024-01-10"]}],
                   "sortBy": [{"id": "event_id", "type": "asc"}]})
        # stats of all selected rows behind the preview, computed once
        stats = held.column_stats()
        assert held.column_stats() is stats
    return stats_table(spark, stats)


DOCUMENTS = [("doc_id", "int", "bigint"), ("text", "str", "string"), ("lang", "str", "string"), ("source", "str", "string"),
             ("n_chars", "int", "bigint")]


@query("profile_documents", _analyze_sql("documents", DOCUMENTS))
def profile_documents(spark, d):
    return flat_profile(analyze_columns(table(spark, d, "documents")))


JOIN_SQL = ("(SELECT l_orderkey, l_quantity, l_returnflag, o_custkey, o_orderpriority, o_orderdate "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
JOINED = [("l_orderkey", "int", "bigint"), ("l_quantity", "dbl", "double"), ("l_returnflag", "str", "string"),
          ("o_custkey", "int", "bigint"), ("o_orderpriority", "str", "string"), ("o_orderdate", "ts", "timestamp_ntz")]


@query("profile_join", _analyze_sql(JOIN_SQL, JOINED))
def profile_join(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return flat_profile(analyze_columns(joined.select(*[c for c, _, _ in JOINED])))


@query("distinct_values_nan",
       _distinct_sql(f"({EVENTS_MISSING_SQL})", "event_type", 20) + " UNION ALL "
       + _distinct_sql(f"(SELECT value FROM ({EVENTS_MISSING_SQL}) WHERE NOT isnan(value))", "value", 20))
def distinct_values_nan(spark, d):
    return distinct_values(events_missing(spark, d), ["event_type", "value"], 20)
