"""Mergeable column profiles: one row of sketches per column and file group.

A row holds what adds up exactly (rows, missing cells, typed minimum and maximum)
and three sketches that merge without the data: distinct values (HyperLogLog),
the distribution of numbers and instants (KLL quantiles) and the frequent values
of all other columns. Profiles of parts are merged instead of computed again:

    merged = merge_sketches(column_sketches(january).unionByName(column_sketches(february)))
    estimates(merged)

Row and missing counts, minimum, maximum and histogram edges of the estimates are exact.
Distinct counts are off by at most ``DISTINCT_ERROR`` (three standard errors;
the same whichever way the parts were merged), histogram counts by
``RANK_ERROR`` of the non-missing rows per edge (99 times in 100). Frequent values are exact while
a column has at most ``TRACKED`` distinct values; beyond, counts may exceed the
truth by at most ``FREQUENT_ERROR`` of the rows. Texts of more than 64 characters take
part by their beginning and digest, as in the exact profile, and are shown by
their beginning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_duration, is_fractional, is_numeric, is_temporal, literal_rows, missing, qcol
from .profile import (MAX_CATEGORIES, STATS_CHUNK, TEXT_KEY, Profile, _hist_value, _parse_extreme, _plans, _value_text,
                      category_entries, hist_edges, stat_text, text_key)

#: Sketch sizes: HyperLogLog registers (2 to this power), KLL's k, frequent values.
REGISTERS, RANKS, TRACKED = 12, 400, 512
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0105
#: The frequent values' map has the next power of two above TRACKED / 0.75.
FREQUENT_ERROR = 3.5 / (1 << (TRACKED * 4 // 3 - 1).bit_length())

EXTREME = "struct<l:bigint,d:double,t:timestamp_ntz,n:decimal(38,0),text:string>"
SKETCHES = (f"part string, position int, column_name string, dtype string, rows bigint, missing bigint, low {EXTREME}, "
            f"high {EXTREME}, lo double, hi double, different binary, ranks binary, "
            "frequent struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>")


def _extreme(c: Column, dtype) -> Column:
    """A cell as a struct whose order is the column's, with its exact text; null
    where the cell is missing."""
    none = F.lit(None)
    slots = {"l": none.cast("bigint"), "d": none.cast("double"), "t": none.cast("timestamp_ntz"), "n": none.cast("decimal(38,0)")}
    if isinstance(dtype, T.DecimalType):
        # the unscaled number: every digit, one type for all scales
        slots["n"] = F.regexp_replace(c.cast("string"), "[.]", "").cast("decimal(38,0)")
    elif is_fractional(dtype):
        slots["d"] = c.cast("double")
    elif is_temporal(dtype):
        slots["t"] = c.cast("timestamp_ntz")
    elif is_duration(dtype):
        slots["l"] = _hist_value(c, dtype).cast("bigint")
    else:
        slots["l"] = c.cast("bigint")
    return F.when(~missing(c, dtype), F.struct(*(v.alias(k) for k, v in slots.items()), c.cast("string").alias("text")))


def _counted(c: Column, dtype) -> Column:
    """A cell as the distinct values are counted: numbers and instants by value,
    others by their text's key; missing cells are null."""
    if is_numeric(dtype) and not is_fractional(dtype) and not isinstance(dtype, T.DecimalType):
        return c.cast("bigint")
    if isinstance(dtype, T.MapType):
        return text_key(c.cast("string"))
    return text_key(_value_text(c, dtype))


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None, by: Column | None = None) -> DataFrame:
    """One row of sketches (``SKETCHES``) per column, and per value of ``by`` (the
    file group, as text) if that is given. Columns are taken ``STATS_CHUNK`` at a
    time; a sketch has a bound of its own, so nothing that grows is shuffled."""
    parts, plans = [], _plans(df, columns)
    for start in range(0, len(plans), STATS_CHUNK):
        aggs, entries = [F.count(F.lit(1)).alias("rows")], []
        for p in plans[start:start + STATS_CHUNK]:
            c, k = qcol(p.name), p.pos
            axis = _hist_value(c, p.dtype) if p.ranged else F.lit(None).cast("double")
            value = _counted(c, p.dtype)
            text = F.lit(None).cast("string") if p.ranged else value
            extreme = _extreme(c, p.dtype) if p.ranged else F.lit(None).cast(EXTREME)
            names = {"missing": F.count_if(missing(c, p.dtype)), "low": F.min(extreme), "high": F.max(extreme),
                     "lo": F.min(axis), "hi": F.max(axis), "different": F.hll_sketch_agg(value, F.lit(REGISTERS)),
                     "ranks": F.kll_sketch_agg_double(axis, F.lit(RANKS)),
                     "frequent": F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED))}
            aggs += [a.alias(f"{n}{k}") for n, a in names.items()]
            entries.append(F.struct(F.lit(k).alias("position"), F.lit(p.name).alias("column_name"),
                                    F.lit(p.dtype.simpleString()).alias("dtype"), F.col("rows"),
                                    *(F.col(f"{n}{k}").alias(n) for n in names)))
        if by is None:
            made = df.agg(*aggs).withColumn("__tk_part", F.lit(""))
        else:
            made = df.select("*", by.cast("string").alias("__tk_part")).groupBy("__tk_part").agg(*aggs)
        parts.append(made.select(F.col("__tk_part").alias("part"), F.inline(F.array(*entries))))
    if not parts:
        return df.sparkSession.createDataFrame([], SKETCHES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of all parts as one part: one row per column."""
    return (sketches.groupBy("position", "column_name", "dtype").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.hll_union_agg("different").alias("different"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"))
        .select(F.lit("").alias("part"), "*"))


def estimates(merged: DataFrame) -> DataFrame:
    """The profile table (``Profile.TABLE_SCHEMA``) read off merged sketches. What
    comes back is bounded by the number of columns. The sketches are asked twice,
    for their edges and for their counts, and held in between: made once."""
    if merged.is_cached:
        return _estimates(merged)
    merged.persist()
    try:
        return _estimates(merged)
    finally:
        merged.unpersist()


def _estimates(merged: DataFrame) -> DataFrame:
    spark = merged.sparkSession
    ranges = {r["position"]: hist_edges(r["lo"], r["hi"]) for r in merged.select("position", "lo", "hi").collect()}
    # counts below the inner edges: ranks include the point itself, so the float just below is asked for
    below = F.lit(None).cast("array<double>")
    for k, edges in ranges.items():
        if edges:
            cut = F.array(*(F.lit(math.nextafter(e, -math.inf)) for e in edges[1:-1]))
            below = F.when(F.col("position") == k, F.kll_sketch_get_rank_double("ranks", cut)).otherwise(below)
    rows = merged.select(
        "position", "column_name", "dtype", "rows", "missing", F.col("low.text").alias("low"), F.col("high.text").alias("high"),
        # a sketch united with itself is read by its registers alone, however they came about
        F.hll_sketch_estimate(F.hll_union("different", "different")).alias("unique"),
        F.kll_sketch_get_n_double("ranks").alias("n"), below.alias("below"),
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(TRACKED)).alias("frequent"))
    out = []
    for r in rows.orderBy("position").collect():
        edges, hist = ranges[r["position"]], None
        if edges:
            below = [0, *(round(x * r["n"]) for x in r["below"]), r["n"]]
            hist = [(a, b, max(0, high - low)) for a, b, low, high in zip(edges, edges[1:], below, below[1:])]
        ranged = r["low"] is not None or r["dtype"] in RANGED or r["dtype"].startswith(("decimal", "interval"))
        present = r["rows"] - r["missing"]
        whole, cats = min(r["unique"], present), None
        if not ranged:
            # missing cells are counted as an item, too
            top = sorted(((-f["count"], f["item"], f["count"]) for f in r["frequent"] if f["item"] is not None), key=lambda f: f[:2])
            if r["unique"] * (1 + DISTINCT_ERROR) < TRACKED:
                whole = len(top)      # all distinct values are there
            cats = category_entries([(0, v[:TEXT_KEY], n) for _, v, n in top[:MAX_CATEGORIES]], max(whole, len(top)), present, r["missing"])
        if r["dtype"].startswith(("array", "map", "struct")):
            whole = r["rows"]         # as in the exact profile
        low, high = (stat_text(_parse_extreme(r[k], T.StructType.fromDDL(f"c {r['dtype']}")[0].dataType)) if r[k] is not None else None
                     for k in ("low", "high"))
        out.append((r["position"], r["column_name"], r["dtype"], whole, r["missing"], low, high, hist, cats))
    return literal_rows(spark, out, Profile.TABLE_SCHEMA)


RANGED = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
