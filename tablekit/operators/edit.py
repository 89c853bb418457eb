"""Edits on a result table. Each edit is a new lazy DataFrame, so an edited
result stays chainable (nothing can go stale)."""

from __future__ import annotations

import functools
import operator
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spec import SortKey
from ..functions.types import missing, qcol
from .shape import sort_columns


def edit_assign(df: DataFrame, name: str, value: Column | Any, loc: int | None = None) -> DataFrame:
    """Set or insert a column; ``loc`` places a new column at that position."""
    col = value if isinstance(value, Column) else F.lit(value)
    if name in df.columns or loc is None:
        return df.withColumn(name, col)
    cols = [qcol(c) for c in df.columns]
    cols.insert(loc, col.alias(name))
    return df.select(*cols)


def edit_drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def edit_update(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Overwrite cells from ``other`` where it has a value (neither null nor
    NaN), matching rows on the ``on`` keys; other columns and unmatched rows are
    unchanged. A key that stands twice in ``other`` raises ``ValueError`` (one
    aggregate over its keys). Spark picks the join from the real sizes.
    """
    twice = other.groupBy(*map(qcol, on)).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the key {twice[0].asDict()} stands more than once in the update")
    fields = {f.name: f.dataType for f in other.schema.fields}
    shared = [c for c in other.columns if c in df.columns and c not in on]
    new = {c: f"__new_{k}" for k, c in enumerate(shared)}
    keys = [f"__key_{k}" for k in range(len(on))]
    right = other.select(*[qcol(c).alias(k) for c, k in zip(on, keys)],
                         *[F.when(~missing(qcol(c), fields[c]), qcol(c)).alias(n) for c, n in new.items()])
    match = functools.reduce(operator.and_, [qcol(c) == F.col(k) for c, k in zip(on, keys)])
    return df.join(right, match, "left").select(
        *[F.coalesce(F.col(new[c]), qcol(c)).alias(c) if c in new else qcol(c) for c in df.columns])


def edit_append(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``other`` after ``df``; columns matched by name, missing ones null."""
    return df.unionByName(other, allowMissingColumns=True)


def edit_fillna(df: DataFrame, value: Any, subset: Sequence[str] | None = None) -> DataFrame:
    """Replace nulls (and NaN in float columns)."""
    return df.na.fill(value, subset=list(subset) if subset else None)


def edit_replace(df: DataFrame, to_replace: Any, value: Any = None,
                 subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.replace(to_replace, value, subset=list(subset) if subset else None)


def edit_dropna(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) cell."""
    return df.na.drop(how=how, subset=list(subset) if subset else None)


def edit_drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                         keep_first_by: Sequence[SortKey] | None = None) -> DataFrame:
    """Drop duplicate rows. With ``subset``, one row per subset key is kept:
    the first by ``keep_first_by`` (which should end in a unique key).

    Keep-first is ``row_number() <= 1`` over the subset keys. Spark plans that
    filter with a per-task partial ``WindowGroupLimit`` before the shuffle, so
    each task forwards one candidate per key and a key holding a third of the
    table is never sorted whole in one task.
    """
    if not subset:
        return df.dropDuplicates()
    if not keep_first_by:
        return df.dropDuplicates(list(subset))
    w = Window.partitionBy(*[qcol(c) for c in subset]).orderBy(*sort_columns(keep_first_by, df.columns))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= 1).drop("__rn")
