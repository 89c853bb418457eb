"""Acceptance queries for the filter algebra (one key per operator).

Null and NaN rules are exercised through projected columns (``nullif`` and a
NaN ``CASE``) built the same way on both sides, because the given tables have
no nulls in the checked columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.predicates import utc_today
from ..functions.spec import Condition
from ..operators.filtering import apply_filters, filter_by_spec
from . import query, table


def _f(col, op, *vals):
    return Condition(col, op, tuple(vals))


def _lineitem(spark, d):
    return table(spark, d, "lineitem")


def _lineitem_nulls(spark, d):
    """lineitem with a nullable quantity: 30 becomes null."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.expr("nullif(l_quantity, 30.0)").alias("q"))


LI_NULLS = "SELECT l_orderkey, l_linenumber, nullif(l_quantity, 30.0) AS q FROM lineitem"


def _events_nan(spark, d):
    """events with null event types ('error' -> null) and NaN values ('view' -> NaN)."""
    ev = table(spark, d, "events")
    return ev.select("event_id", F.expr("nullif(event_type, 'error')").alias("etype"),
                     F.when(F.col("event_type") == "view", F.lit(float("nan")))
                      .otherwise(F.col("value")).alias("v"))


EV_NAN = ("SELECT event_id, nullif(event_type, 'error') AS etype, "
          "CASE WHEN event_type = 'view' THEN 'NaN'::DOUBLE ELSE value END AS v FROM events")


@query("filter_is_equal", "SELECT * FROM lineitem WHERE l_quantity = 25")
def filter_is_equal(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_quantity", "is-equal", "25")])


@query("filter_is_one_of_int_fraction", "SELECT * FROM lineitem WHERE l_linenumber IN (2, 2.5, 4)")
def filter_is_one_of_int_fraction(spark, d):
    # integer column against a fractional value: only the whole ones can match
    return apply_filters(_lineitem(spark, d), [_f("l_linenumber", "is-one-of", "2", "2.5", 4.0)])


@query("filter_is_equal_int_fraction", "SELECT * FROM lineitem WHERE l_linenumber IS NULL OR l_linenumber <> 2.5")
def filter_is_equal_int_fraction(spark, d):
    # no integer equals 2.5, so the negative form keeps every row
    return apply_filters(_lineitem(spark, d), [_f("l_linenumber", "is-not-equal", "2.5")])


# order keys moved past 2^53, where a double cannot tell neighbours apart
BIG_SQL = "SELECT o_orderkey + 9007199254740992 AS big, o_custkey FROM orders"


def _big(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderkey") + F.lit(2 ** 53)).alias("big"), "o_custkey")


@query("filter_is_equal_big", f"SELECT * FROM ({BIG_SQL}) WHERE big = 9007199254740993 OR big % 2 = 1 AND big <= 9007199254740997")
def filter_is_equal_big(spark, d):
    one = apply_filters(_big(spark, d), [_f("big", "is-equal", "9007199254740993")])
    return one.unionByName(apply_filters(_big(spark, d), [_f("big", "is-one-of", "9007199254740995", 9007199254740997)]))


@query("filter_between_big", f"SELECT * FROM ({BIG_SQL}) WHERE big > 9007199254740995 AND big <= 9007199254741093")
def filter_between_big(spark, d):
    return apply_filters(_big(spark, d), [_f("big", "greater-than", "9007199254740995"), _f("big", "between", "0", "9007199254741093")])


@query("filter_decimal", "SELECT o_orderkey, o_totalprice::DECIMAL(20, 4) AS price FROM orders WHERE o_totalprice::DECIMAL(20, 4) >= 1000.00005")
def filter_decimal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,4)").alias("price"))
    return apply_filters(o, [_f("price", "greater-than-or-equal", "1000.00005"), _f("price", "less-than", "inf"),
                             _f("price", "is-not-equal", "1e60")])


@query("filter_infinite", f"SELECT * FROM ({EV_NAN}) WHERE v IS NOT NULL AND NOT isnan(v) AND event_id IS NOT NULL")
def filter_infinite(spark, d):
    return apply_filters(_events_nan(spark, d), [_f("v", "less-than", "inf"), _f("v", "greater-than", "-Infinity"),
                                                 _f("event_id", "less-than", "inf"), _f("event_id", "outside-of", "inf", "nan")])


@query("filter_is_not_equal_text",
       "SELECT p_partkey, p_brand, substr(p_brand, 7) AS digits FROM part WHERE try_cast(substr(p_brand, 7) AS DOUBLE) IS NULL "
       "OR try_cast(substr(p_brand, 7) AS DOUBLE) <> 1")
def filter_is_not_equal_text(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.expr("substr(p_brand, 7)").alias("digits"))
    return apply_filters(part, [_f("digits", "is-not-equal", "1")])


@query("filter_date_column", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE >= DATE '1996-01-02' "
       "AND o_orderdate::DATE <= DATE '1997-06-30'")
def filter_date_column(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return apply_filters(o, [_f("day", "is-after", "1996-01-02"), _f("day", "is-before", "1997-06-30T00:00:00Z")])


@query("filter_zoned", "SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts >= TIMESTAMP '2024-01-10 22:30:00' AND ts < TIMESTAMP '2024-01-12'")
def filter_zoned(spark, d):
    # a zoned column holds instants: the UTC bound is the same whatever the session zone
    zoned = F.timestamp_micros(F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))
    ev = table(spark, d, "events").select("event_id", zoned.alias("ts"))
    kept = apply_filters(ev, [_f("ts", "is-after", "2024-01-11T00:30:00+02:00"), _f("ts", "is-before", "2024-01-11T23:59:59.999999Z")])
    return kept.select("event_id", F.unix_micros("ts").alias("us"))


@query("filter_is_not_equal", f"SELECT * FROM ({LI_NULLS}) WHERE q IS NULL OR q <> 25")
def filter_is_not_equal(spark, d):
    return apply_filters(_lineitem_nulls(spark, d), [_f("q", "is-not-equal", 25)])


@query("filter_greater_than", "SELECT * FROM lineitem WHERE l_quantity > 25")
def filter_greater_than(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_quantity", "greater-than", "25")])


@query("filter_greater_than_int", "SELECT * FROM lineitem WHERE l_linenumber > 2.5")
def filter_greater_than_int(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_linenumber", "greater-than", "2.5")])


@query("filter_greater_than_nan", f"SELECT * FROM ({EV_NAN}) WHERE v > 50 AND NOT isnan(v)")
def filter_greater_than_nan(spark, d):
    return apply_filters(_events_nan(spark, d), [_f("v", "greater-than", "50")])


@query("filter_greater_than_or_equal", "SELECT * FROM lineitem WHERE l_quantity >= 25")
def filter_greater_than_or_equal(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_quantity", "greater-than-or-equal", 25)])


@query("filter_less_than", "SELECT * FROM lineitem WHERE l_quantity < 25")
def filter_less_than(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_quantity", "less-than", "25")])


@query("filter_less_than_or_equal", "SELECT * FROM lineitem WHERE l_quantity <= 25")
def filter_less_than_or_equal(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_quantity", "less-than-or-equal", "25")])


@query("filter_outside_of",
       f"SELECT * FROM ({LI_NULLS}) WHERE q IS NULL OR q < 10 OR q > 30")
def filter_outside_of(spark, d):
    return apply_filters(_lineitem_nulls(spark, d), [_f("q", "outside-of", "10", "30")])


@query("filter_between", "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 30")
def filter_between(spark, d):
    return apply_filters(_lineitem(spark, d), [_f("l_quantity", "between", "10", "30")])


@query("filter_between_dates",
       "SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30 12:00:00'")
def filter_between_dates(spark, d):
    return apply_filters(table(spark, d, "orders"),
                         [_f("o_orderdate", "between", "1996-01-01", "1996-06-30T12:00:00")])


@query("filter_text_contains",
       "SELECT * FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'bolt')")
def filter_text_contains(spark, d):
    return apply_filters(table(spark, d, "part"), [_f("p_name", "text-contains", "RED", "Bolt")])


@query("filter_text_contains_literal", "SELECT * FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part) WHERE contains(lower(name), 'l_r')")
def filter_text_contains_literal(spark, d):
    # '_' is a literal character, not a LIKE wildcard
    part = table(spark, d, "part").select("p_partkey", F.expr("replace(p_name, ' ', '_')").alias("name"))
    return apply_filters(part, [_f("name", "text-contains", "L_r")])


@query("filter_text_not_contains",
       "SELECT * FROM (SELECT p_partkey, nullif(p_name, 'small ring') AS name FROM part) "
       "WHERE name IS NULL OR NOT (contains(lower(name), 'red') OR contains(lower(name), 'gear'))")
def filter_text_not_contains(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("nullif(p_name, 'small ring')").alias("name"))
    return apply_filters(p, [_f("name", "text-does-not-contain", "red", "GEAR")])


@query("filter_is_one_of",
       "SELECT * FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
def filter_is_one_of(spark, d):
    return apply_filters(table(spark, d, "orders"),
                         [_f("o_orderpriority", "is-one-of", "1-urgent", "2-HIGH")])


@query("filter_is_one_of_numeric", "SELECT * FROM orders WHERE o_custkey IN (1, 2, 7)")
def filter_is_one_of_numeric(spark, d):
    return apply_filters(table(spark, d, "orders"),
                         [_f("o_custkey", "is-one-of", "1", "2.0", 7, "3.5")])


@query("filter_is_not_one_of",
       "SELECT * FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders) "
       "WHERE prio IS NULL OR lower(prio) NOT IN ('1-urgent', '2-high')")
def filter_is_not_one_of(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("prio"))
    return apply_filters(o, [_f("prio", "is-not-one-of", "1-URGENT", "2-high")])


@query("filter_is_null", f"SELECT * FROM ({EV_NAN}) WHERE v IS NULL OR isnan(v)")
def filter_is_null(spark, d):
    return apply_filters(_events_nan(spark, d), [_f("v", "is-null")])


@query("filter_is_null_text", f"SELECT * FROM ({EV_NAN}) WHERE etype IS NULL")
def filter_is_null_text(spark, d):
    return apply_filters(_events_nan(spark, d), [_f("etype", "is-null")])


@query("filter_is_not_null", f"SELECT * FROM ({EV_NAN}) WHERE v IS NOT NULL AND NOT isnan(v)")
def filter_is_not_null(spark, d):
    return apply_filters(_events_nan(spark, d), [_f("v", "is-not-null")])


@query("filter_is_after", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'")
def filter_is_after(spark, d):
    return apply_filters(table(spark, d, "events"), [_f("ts", "is-after", "2024-01-02")])


@query("filter_is_before", "SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-02 12:30:00'")
def filter_is_before(spark, d):
    # an offset is converted to UTC first
    return apply_filters(table(spark, d, "events"), [_f("ts", "is-before", "2024-01-02T14:30:00+02:00")])


@query("filter_is_on", "SELECT * FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'")
def filter_is_on(spark, d):
    return apply_filters(table(spark, d, "events"), [_f("ts", "is-on", "2024-01-02T08:00:00")])


# The relative words and the literal day each means when today is 2024-01-31.
RELATIVE_CASES = [
    ("today", "CAST(ts AS DATE) = DATE '2024-01-31'"),
    ("yesterday", "CAST(ts AS DATE) = DATE '2024-01-30'"),
    ("week-ago", "ts >= TIMESTAMP '2024-01-24 00:00:00'"),
    ("month-ago", "ts >= TIMESTAMP '2023-12-31 00:00:00'"),
    ("quarter-ago", "ts >= TIMESTAMP '2023-10-31 00:00:00'"),
    ("half-year-ago", "ts >= TIMESTAMP '2023-07-31 00:00:00'"),
    ("year-ago", "ts >= TIMESTAMP '2023-01-31 00:00:00'"),
]
TODAY = dt.date(2024, 1, 31)


@query("filter_relative_today", " UNION ALL ".join(
    f"SELECT '{w}' AS word, event_id, ts FROM events WHERE {cond}" for w, cond in RELATIVE_CASES))
def filter_relative_today(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    out = None
    for word, _ in RELATIVE_CASES:
        part = apply_filters(ev, [_f("ts", "is-relative-today", word)], today=TODAY)
        part = part.select(F.lit(word).alias("word"), "event_id", "ts")
        out = part if out is None else out.unionByName(part)
    return out


# rows of the last 900 days, made from the ids: no date is injected on either side
NOW_SQL = ("SELECT event_id, (now() AT TIME ZONE 'UTC')::DATE - CAST(event_id % 900 AS INTEGER) * INTERVAL 1 DAY "
           "+ CAST(event_id % 86400 AS INTEGER) * INTERVAL 1 SECOND AS ts FROM events")
TODAY_SQL = "(now() AT TIME ZONE 'UTC')::DATE"
NOW_CASES = [("today", f"ts >= {TODAY_SQL} AND ts < {TODAY_SQL} + INTERVAL 1 DAY"),
             ("yesterday", f"ts >= {TODAY_SQL} - INTERVAL 1 DAY AND ts < {TODAY_SQL}"),
             ("week-ago", f"ts >= {TODAY_SQL} - INTERVAL 7 DAY"), ("month-ago", f"ts >= {TODAY_SQL} - INTERVAL 1 MONTH"),
             ("year-ago", f"ts >= {TODAY_SQL} - INTERVAL 12 MONTH")]


@query("filter_relative_now", " UNION ALL ".join(
    f"SELECT '{w}' AS word, '{kind}' AS kind, event_id FROM ({NOW_SQL}) WHERE {cond}"
    for kind in ("wall", "zoned", "text") for w, cond in NOW_CASES))
def filter_relative_now(spark, d):
    # the same days for wall-clock, zoned and text columns
    ev = table(spark, d, "events").select("event_id")
    start = F.unix_date(utc_today()).cast("bigint") * 86400
    ev = ev.select("event_id", (start - (F.col("event_id") % 900) * 86400 + F.col("event_id") % 86400).alias("s"))
    wall = F.timestamp_add("SECOND", F.col("s"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    ev = ev.select("event_id", wall.alias("wall"), F.timestamp_seconds("s").alias("zoned"), wall.cast("string").alias("text"))
    out = None
    for kind in ("wall", "zoned", "text"):
        for word, _ in NOW_CASES:
            part = apply_filters(ev, [_f(kind, "is-relative-today", word)]).select(
                F.lit(word).alias("word"), F.lit(kind).alias("kind"), "event_id")
            out = part if out is None else out.unionByName(part)
    return out


@query("filter_conjunction",
       "SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 30 "
       "AND lower(l_returnflag) IN ('r', 'a') AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' "
       "AND l_linenumber < 4")
def filter_conjunction(spark, d):
    return apply_filters(_lineitem(spark, d), [
        _f("l_quantity", "between", 10, 30),
        _f("l_returnflag", "is-one-of", "R", "a"),
        _f("l_shipdate", "is-after", "1996-01-01"),
        _f("l_linenumber", "less-than", "3.5"),
    ])


@query("filter_lenient", "SELECT * FROM lineitem WHERE l_quantity > 40")
def filter_lenient(spark, d):
    # unknown column, missing values and an unparseable number are dropped
    return apply_filters(_lineitem(spark, d), [
        _f("no_such_column", "is-equal", 1),
        _f("l_quantity", "greater-than"),
        _f("l_tax", "less-than", "not a number"),
        _f("l_quantity", "greater-than", "40"),
    ])


SPEC = ('[{"column": "c_mktsegment", "operator": "is-one-of", "comparativeValues": ["building", "MACHINERY"]},'
        ' {"type": "contains", "id": "c_name", "value": "1"},'
        ' {"column": "c_acctbal", "operator": "outside-of", "comparativeValues": ["0", "5000"]}]')


@query("filter_by_spec",
       "SELECT * FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') "
       "AND contains(lower(c_name), '1') AND (c_acctbal < 0 OR c_acctbal > 5000)")
def filter_by_spec_q(spark, d):
    return filter_by_spec(table(spark, d, "customer"), SPEC)
