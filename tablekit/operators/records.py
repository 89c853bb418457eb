"""Table-level rendering: JSON-safe rows, large numbers, sanitizing, summaries."""

from __future__ import annotations

from typing import Any, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import (BINARY_PREFIX_BYTES, LARGE_NUMBER, MAX_STRING_LENGTH, duration_seconds, is_large, is_large_candidate, json_safe)
from ..functions.types import is_complex, is_duration, literal_rows, qcol
from .shape import prepare_columns

# Select-input limits.
SELECT_INPUT_MAX_ELEMENTS = 1000
SELECT_INPUT_MAX_CHARS = 10_000


def large_number_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns holding any |x| > 2^53: one aggregate pass over
    all candidate columns together (partial aggregation, one-row result)."""
    cands = [f for f in df.schema.fields if is_large_candidate(f.dataType)]
    if not cands:
        return []
    row = df.agg(*[F.max(F.when(is_large(qcol(f.name), f.dataType), 1).otherwise(0)).alias(f"c{i}")
                   for i, f in enumerate(cands)]).first()
    return [f.name for i, f in enumerate(cands) if row[f"c{i}"] == 1]


def large_numbers_to_string(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with any value past 2^53 become text; the others stay typed."""
    big = set(large_number_columns(df) if columns is None else columns)
    if not big:
        return df
    return df.select(*[qcol(c).cast("string").alias(c) if c in big else qcol(c) for c in df.columns])


def json_safe_records(df: DataFrame, text_columns: Sequence[str] = (), most_chars: int | None = MAX_STRING_LENGTH,
                      most_bytes: int | None = BINARY_PREFIX_BYTES) -> DataFrame:
    """Projection that makes every cell JSON-safe (see ``functions.render.json_safe``).
    Shown cells are cut to ``most_chars`` characters and ``most_bytes`` bytes
    (None: whole)."""
    text = set(text_columns)
    return df.select(*[json_safe(qcol(f.name), f.dataType, f.name in text, most_chars, most_bytes).alias(f.name)
                       for f in df.schema.fields])


def to_records(df: DataFrame, limit: int, check_large: bool = True) -> list[dict[str, Any]]:
    """Bounded edge of the library: at most ``limit`` JSON-safe rows as dicts.

    One job: the rows are collected once and the 2^53 rule is decided on those
    same (at most ``limit``) rows on the driver, so a sorted page, which is a
    top-n over the whole table, is not computed twice."""
    rows = [r.asDict(recursive=True) for r in json_safe_records(df.limit(limit)).collect()]
    if check_large and rows:
        cands = [f.name for f in df.schema.fields if is_large_candidate(f.dataType)]
        big = [c for c in cands if any(_is_large_value(r[c]) for r in rows)]
        for r in rows:
            for c in big:
                if r[c] is not None:
                    r[c] = _number_text(r[c])
    return rows


def _is_large_value(v: Any) -> bool:
    if v is None or isinstance(v, str):
        return False
    try:
        return v > LARGE_NUMBER or v < -LARGE_NUMBER        # infinities count, NaN does not
    except TypeError:
        return False


def _number_text(v: Any) -> str:
    """Spark's text of a number (what ``cast(x as string)`` gives)."""
    if isinstance(v, float):
        if v != v:
            return "NaN"
        if v in (float("inf"), float("-inf")):
            return "Infinity" if v > 0 else "-Infinity"
    return str(v)


def sanitize_for_parquet(df: DataFrame) -> DataFrame:
    """Unique text names, then large-number columns as text. Nulls stay null."""
    return large_numbers_to_string(prepare_columns(df, None))


def durations_to_seconds(df: DataFrame) -> DataFrame:
    return df.select(*[duration_seconds(qcol(f.name)).alias(f.name) if is_duration(f.dataType)
                       else qcol(f.name) for f in df.schema.fields])


def sanitize_for_chart(df: DataFrame) -> DataFrame:
    """Unique names and durations as seconds (UUIDs are already text in Spark)."""
    return durations_to_seconds(prepare_columns(df, None))


def flatten_cells(df: DataFrame, key: str | None = None) -> DataFrame:
    """All cells row by row as text: (row_id, position, value). ``row_id`` is
    the ``key`` column when given, else a unique increasing id; rows are never
    numbered through a global window."""
    cols = [c for c in df.columns if c != key] if key else df.columns
    cells = F.array(*[qcol(c).cast("string") for c in cols])
    rid = qcol(key).alias("row_id") if key else F.monotonically_increasing_id().alias("row_id")
    return (df.select(rid, cells.alias("__cells"))
              .select("row_id", F.posexplode("__cells").alias("position", "value")))


def select_input_values(df: DataFrame, most_rows: int = SELECT_INPUT_MAX_ELEMENTS,
                        most_chars: int = SELECT_INPUT_MAX_CHARS) -> DataFrame:
    """First column as a list of texts when it has at most ``most_rows`` rows and
    ``most_chars`` characters, else null; struct/array/map cells give null.

    At most ``most_rows + 1`` cells are read, each as far as the limit needs:
    the limit is the feature.
    """
    first = df.schema.fields[0]
    if is_complex(first.dataType):
        return df.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("values"))
    text = F.substring(qcol(first.name).cast("string"), 1, most_chars + 1)
    head = df.select(text.alias("v")).limit(most_rows + 1)
    agg = head.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.coalesce(F.length("v"), F.lit(0))).alias("chars"),
                   F.collect_list(F.coalesce(F.col("v"), F.lit("None"))).alias("vals"))
    ok = (F.col("n") <= most_rows) & (F.coalesce(F.col("chars"), F.lit(0)) <= most_chars)
    return agg.select(F.when(ok, F.col("vals")).alias("values"))


def table_summary(df: DataFrame, max_columns: int = 500) -> DataFrame:
    """Shape, names (first 500) and native types as one small table: one row per
    column plus the row count from a single ``count`` aggregate (no data moved)."""
    spark = df.sparkSession
    fields = df.schema.fields
    meta = literal_rows(spark, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields[:max_columns])],
                        "position int, column_name string, column_type string")
    # scalar subquery: evaluated once, inlined as a literal (no join)
    row_count = df.agg(F.count(F.lit(1))).scalar()
    return meta.select("*", row_count.alias("row_count"),
                       F.lit(len(fields)).cast("long").alias("column_count"))
