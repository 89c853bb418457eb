"""Column profiles: unique and missing counts, min/max, histograms, categories.

Plan shape (whatever the number of rows):

* **pass 1** (numeric and temporal columns): one aggregate per chunk of six
  columns, unioned into one job: missing counts, typed min/max (NaN excluded,
  infinities kept) and the finite histogram range. Partial aggregation per
  task; O(columns) values come back, because pass 2 needs the bounds as
  literals.
* **pass 2**: per chunk of six columns, one scan, an explode into typed slots
  and one ``groupBy`` (map-side partial aggregation first, so a hot value is
  combined before the shuffle). Value text and histogram bins are derived
  from the distinct values only. From those counts: distinct, missing and
  non-missing counts and bin sums (one row per column), and the top values of
  category columns through ``row_number() <= 3``, which Spark plans with a
  partial per-task group limit before its shuffle, so no task ever holds all
  distinct values of a column.

Chunks keep the generated code of every stage small: one expression over
hundreds of columns would outgrow what the JVM compiles. Everything that comes
back is bounded by the schema width, not by the data size.
"""

from __future__ import annotations

import functools
import math
import uuid
from dataclasses import dataclass
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.csv import csv_header_bytes, csv_line_bytes, csv_size
from ..functions.render import duration_seconds
from ..functions.types import (literal_rows, is_complex, is_duration, is_fractional, is_numeric,
                               is_numeric_or_temporal, is_temporal, missing, qcol)
from ..session import shared_path

# Profile parameters.
HIST_BINS = 10
MAX_CATEGORIES = 3
MISSING_NAME = "Missing"
DISTINCT_LIMIT = 100
STATS_CHUNK = 6                        # columns per pass-1 aggregate branch
# Longer texts group by their first characters and a digest of the whole.
TEXT_KEY = 64


@dataclass
class ColumnPlan:
    pos: int
    name: str
    dtype: Any

    @property
    def ranged(self) -> bool:        # min/max and histogram
        return is_numeric_or_temporal(self.dtype)


def _hist_value(c: Column, dtype) -> Column:
    """Value on the histogram axis as double: numbers as is (infinities and NaN
    dropped), instants as epoch microseconds, durations as microseconds."""
    if is_fractional(dtype):
        return F.when(~F.isnan(c) & (c != float("inf")) & (c != float("-inf")), c.cast("double"))
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double") * 86_400_000_000.0
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        # wall-clock micros since 1970-01-01 (zoned instants in the session zone)
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                c.cast("timestamp_ntz")).cast("double")
    if is_duration(dtype):
        return duration_seconds(c) * 1_000_000.0
    return F.lit(None).cast("double")


def _value_text(c: Column, dtype) -> Column:
    """Text used to group equal values. Exact for every type: -0.0 joins 0.0,
    NaN is missing, booleans read True/False, binaries group on their hex."""
    if is_fractional(dtype):
        return F.when(F.isnan(c), None).when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def _ranged_extreme(fn, c: Column, dtype) -> Column:
    return fn(F.when(~F.isnan(c), c)) if is_fractional(dtype) else fn(c)


def stat_text(value: Any) -> str | None:
    """min/max as text (the reference reports them as strings)."""
    if value is None:
        return None
    if isinstance(value, float):
        return repr(value) if not math.isinf(value) else ("inf" if value > 0 else "-inf")
    return str(value)


def _plans(df: DataFrame, columns: Sequence[str] | None) -> list[ColumnPlan]:
    wanted = None if columns is None else set(columns)
    return [ColumnPlan(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)
            if wanted is None or f.name in wanted]


# --- pass 1 -----------------------------------------------------------------------

def _parse_extreme(text: str | None, dtype) -> Any:
    """Typed value back from Spark's exact text of a min/max."""
    if text is None:
        return None
    if isinstance(dtype, T.DecimalType):
        from decimal import Decimal
        return Decimal(text)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(text)
    if is_fractional(dtype):
        return float(text)
    if isinstance(dtype, T.DateType):
        import datetime as _dt
        return _dt.date.fromisoformat(text)
    if is_temporal(dtype):
        import datetime as _dt
        return _dt.datetime.fromisoformat(text)
    return text


def scalar_stats(df: DataFrame, plans: Sequence[ColumnPlan], approx_distinct: bool = False) -> dict[str, Any]:
    """Pass 1: per column the missing count, min, max (NaN excluded,
    infinities kept) and the finite histogram range, plus the row count.

    One aggregate per chunk of ``STATS_CHUNK`` columns, unioned into one job:
    each branch reads only its columns and its generated code stays small
    however wide the table is (one huge aggregate would outgrow what the JVM
    compiles and run interpreted). Min/max travel as Spark's exact text and are parsed back by type.
    Returns a dict keyed ``"{kind}{pos}"``.
    """
    if not plans:
        return {"rows": df.count()}
    parts = []
    for start in range(0, len(plans), STATS_CHUNK):
        aggs, entries = [F.count(F.lit(1)).alias("rows")], []
        for p in plans[start:start + STATS_CHUNK]:
            c = qcol(p.name)
            if p.ranged:
                hv = _hist_value(c, p.dtype)
                aggs += [_ranged_extreme(F.min, c, p.dtype).cast("string").alias(f"mn{p.pos}"),
                         _ranged_extreme(F.max, c, p.dtype).cast("string").alias(f"mx{p.pos}"),
                         F.min(hv).alias(f"lo{p.pos}"), F.max(hv).alias(f"hi{p.pos}")]
                if approx_distinct:
                    aggs.append(F.approx_count_distinct(F.when(~missing(c, p.dtype), c)).alias(f"adc{p.pos}"))
            aggs.append(F.count_if(missing(c, p.dtype)).alias(f"nan{p.pos}"))
            col = (lambda k, t: F.col(f"{k}{p.pos}") if p.ranged else F.lit(None).cast(t))
            adc = F.col(f"adc{p.pos}") if (p.ranged and approx_distinct) else F.lit(None).cast("long")
            entries.append(F.struct(F.lit(p.pos).alias("pos"), F.col("rows"), F.col(f"nan{p.pos}").alias("nan"),
                                    col("mn", "string").alias("mn"), col("mx", "string").alias("mx"),
                                    col("lo", "double").alias("lo"), col("hi", "double").alias("hi"),
                                    adc.alias("adc")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*entries))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    by_pos = {p.pos: p for p in plans}
    stats: dict[str, Any] = {}
    for r in out.collect():
        p = by_pos[r.pos]
        stats["rows"] = r.rows
        stats[f"nan{r.pos}"] = r.nan
        if p.ranged:
            stats[f"min{r.pos}"] = _parse_extreme(r.mn, p.dtype)
            stats[f"max{r.pos}"] = _parse_extreme(r.mx, p.dtype)
            stats[f"lo{r.pos}"], stats[f"hi{r.pos}"] = r.lo, r.hi
            if r.adc is not None:
                stats[f"adc{r.pos}"] = r.adc
    return stats


def hist_edges(lo: float | None, hi: float | None, bins: int = HIST_BINS) -> list[float] | None:
    """Equal-width edges over [lo, hi] computed as ``k * step + lo`` (the same
    float arithmetic as ``numpy.linspace``); a single value gets [v-0.5, v+0.5].
    None when there is no finite value or the edges collapse in float precision."""
    if lo is None or hi is None:
        return None
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    edges = [k * step + lo for k in range(bins)] + [hi]
    if any(a >= b for a, b in zip(edges, edges[1:])):
        return None
    return edges


# --- pass 2 -----------------------------------------------------------------------

SLOTS = "pos int, l bigint, t timestamp_ntz, d double, s string"


def _slots(c: Column, dtype) -> tuple[Column, Column, Column, Column]:
    """A cell in one typed slot (l: integers, t: wall-clock instants, d: floats
    and durations, s: text of everything else), so values group on their own
    type without being turned into text first. NaN and nulls stay null."""
    none_l, none_t = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint"), none_t, none_d, none_s
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return none_l, c.cast("timestamp_ntz"), none_d, none_s
    if is_fractional(dtype):
        return none_l, none_t, F.when(~F.isnan(c), c.cast("double")), none_s
    if is_duration(dtype):
        return none_l, none_t, duration_seconds(c) * 1_000_000.0, none_s
    return none_l, none_t, none_d, text_key(c.cast("string") if isinstance(dtype, T.MapType) else _value_text(c, dtype))


def text_key(text: Column) -> Column:
    """A text as grouping key: itself up to ``TEXT_KEY`` characters, else its
    beginning, NUL and the md5 of the whole, so no long text is shuffled."""
    return F.when(F.length(text) <= TEXT_KEY, text).otherwise(
        F.concat(F.substring(text, 1, TEXT_KEY), F.lit("\x00"), F.md5(text)))


def grouped_values(df: DataFrame, plans: Sequence[ColumnPlan]) -> DataFrame:
    """(pos, l, t, d, s, cnt): every distinct cell value per column with its count,
    missing cells included as the all-null group. Columns are taken in chunks
    of ``STATS_CHUNK``: each chunk is one scan of its columns, one explode into
    typed slots and one ``groupBy`` whose map-side partial aggregation combines
    a hot value inside each task before the shuffle."""
    parts = []
    for start in range(0, len(plans), STATS_CHUNK):
        entries = []
        for p in plans[start:start + STATS_CHUNK]:
            l, t, d, sx = _slots(qcol(p.name), p.dtype)
            entries.append(F.struct(F.lit(p.pos).alias("pos"), l.alias("l"), t.alias("t"), d.alias("d"),
                                    sx.alias("s")))
        exploded = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        parts.append(exploded.groupBy("pos", "l", "t", "d", "s").agg(F.count(F.lit(1)).alias("cnt")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _edges_table(plans: Sequence[ColumnPlan], stats: dict[str, Any]) -> Column:
    """Histogram edges of every column, indexed by position + 1 (null where a
    column has no histogram): a literal bounded by the schema width."""
    width = max(p.pos for p in plans) + 1
    by_pos = {p.pos: hist_edges(stats.get(f"lo{p.pos}"), stats.get(f"hi{p.pos}")) if p.ranged else None
              for p in plans}
    cells = []
    for pos in range(width):
        e = by_pos.get(pos)
        cells.append(F.array(*[F.lit(float(x)) for x in e]) if e else F.lit(None).cast("array<double>"))
    return F.array(*cells)


def _bin_by_pos(axis: Column, e: Column) -> Column:
    """Histogram bin of ``axis`` given its column's edges ``e`` (an array column,
    so one expression serves every column): bin k holds e[k] <= v < e[k+1], the
    last bin closed. An estimate ``int((v - lo) * n / (hi - lo))`` is corrected by
    one step against the exact edges, as ``numpy.histogram`` does; flat
    arithmetic that stays inside generated code."""
    lo, hi = F.element_at(e, 1), F.element_at(e, HIST_BINS + 1)
    i0 = F.least(((axis - lo) * (F.lit(float(HIST_BINS)) / (hi - lo))).cast("int"), F.lit(HIST_BINS - 1))
    down = F.when(axis < F.element_at(e, i0 + 1), 1).otherwise(0)
    up = F.when((axis >= F.element_at(e, i0 + 2)) & (i0 != HIST_BINS - 1), 1).otherwise(0)
    return F.when(e.isNotNull() & axis.isNotNull(), i0 - down + up)


def pass2(df: DataFrame, plans: Sequence[ColumnPlan], stats: dict[str, Any]) -> DataFrame:
    """Pass 2 as one job, returning rows (kind, pos, v, cnt, uniq, nn, miss, rows,
    hist) bounded by the schema width:

    * ``kind='u'``, one per column: distinct non-missing values, their total,
      the missing count, the row count and the ten histogram bin sums;
    * ``kind='t'``: the three most common values of each column, ties by value,
      via ``row_number() <= 3`` per column, which Spark plans with a partial
      group limit in every task before its shuffle.

    Value text and histogram bins are computed after grouping, on distinct
    values only. Category and numeric columns are grouped in separate chunks;
    the category groups feed both consumers unfiltered, so Spark reuses that
    exchange, and the window never sorts numeric values.
    """
    def values(g: DataFrame) -> DataFrame:
        v = F.coalesce(F.col("l").cast("string"), F.col("t").cast("string"),
                       F.when(F.col("d") == 0, F.lit("0.0")).otherwise(F.col("d").cast("string")), F.col("s"))
        axis = F.coalesce(F.col("l").cast("double"),
                          F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                           F.col("t")).cast("double"),
                          F.when(~F.col("d").isin(float("inf"), float("-inf")), F.col("d")),
                          F.col("s").try_cast("double"))      # decimals travel as exact text
        b = _bin_by_pos(axis, F.element_at(_edges_table(plans, stats), F.col("pos") + 1))
        return g.select("pos", v.alias("v"), b.alias("b"), "cnt")

    # category and numeric columns are grouped in separate chunks, so the top
    # values window only ever sees category values
    cat = [p for p in plans if not p.ranged]
    rng = [p for p in plans if p.ranged]
    cat_vals = values(grouped_values(df, cat)) if cat else None
    rng_vals = values(grouped_values(df, rng)) if rng else None
    vals = cat_vals if rng_vals is None else (rng_vals if cat_vals is None else cat_vals.unionByName(rng_vals))
    present = F.col("v").isNotNull()
    hist = F.array(*[F.sum(F.when(present & (F.col("b") == k), F.col("cnt")).otherwise(0))
                     for k in range(HIST_BINS)])
    u = vals.groupBy("pos").agg(
        F.count_if(present).cast("long").alias("uniq"),
        F.coalesce(F.sum(F.when(present, F.col("cnt"))), F.lit(0)).cast("long").alias("nn"),
        F.coalesce(F.sum(F.when(~present, F.col("cnt"))), F.lit(0)).cast("long").alias("miss"),
        F.sum("cnt").cast("long").alias("rows"), hist.cast("array<bigint>").alias("hist")).select(
        F.lit("u").alias("kind"), "pos", F.lit(None).cast("string").alias("v"), F.lit(None).cast("long").alias("cnt"),
        "uniq", "nn", "miss", "rows", "hist")
    if cat_vals is None:
        return u
    w = Window.partitionBy("pos").orderBy(present.desc(), F.col("cnt").desc(), F.col("v").asc())
    t = (cat_vals.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= MAX_CATEGORIES)
         .select(F.lit("t").alias("kind"), "pos", "v", F.col("cnt").cast("long").alias("cnt"),
                 F.lit(None).cast("long").alias("uniq"), F.lit(None).cast("long").alias("nn"),
                 F.lit(None).cast("long").alias("miss"), F.lit(None).cast("long").alias("rows"),
                 F.lit(None).cast("array<bigint>").alias("hist")))
    return u.unionByName(t)


def category_entries(top: list[tuple[int, str, int]], uniq: int, non_null: int, nan: int) -> list[tuple[str, int]]:
    """Category list from the ranked top values: what does not fit is summed up
    as ``"<n> others"``; missing cells stand last."""
    tail = [(MISSING_NAME, nan)] if nan else []
    room = MAX_CATEGORIES - len(tail)
    named = [(value, count) for _, value, count in top][:room if uniq <= room else room - 1]
    if left := uniq - len(named):
        tail.insert(0, (f"{left} others", non_null - sum(count for _, count in named)))
    return named + tail


def is_plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is stored rows with filters and projections at most, so that
    reading it once per group of columns costs no more than its columns."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        if children.size() and node.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        todo += [children.apply(k) for k in range(children.size())]
    return True


# --- public entry points --------------------------------------------------------------

class Profile:
    """Profile of a table. Pass 1 (numeric and temporal columns) and pass 2 (one
    job of chunked typed group-bys) each run on the first statistic that needs
    them, only for the columns that statistic needs, and their results are kept
    per column. Both return only per-column values, bounded by
    the schema width."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None, approx_distinct: bool = False):
        """``approx_distinct=True``: numeric and temporal columns take their
        distinct count from HyperLogLog++ in pass 1 (about 5 % relative error)
        and skip the value grouping of pass 2, the one shuffle that grows with
        the number of distinct values; category columns stay exact."""
        self.source = df
        self.stored: str | None = None
        self._df: DataFrame | None = df if is_plain_scan(df) else None
        self.plans = _plans(df, columns)
        self.approx = approx_distinct
        self.stats: dict[str, Any] = {}
        self._summary = None

    @property
    def df(self) -> DataFrame:
        """The table to read: computed input is written once to the shared folder
        as parquet, where each pass reads just its columns."""
        if self._df is None:
            names = [f"c{p.pos}" for p in _plans(self.source, None)]
            self.stored = shared_path(self.source.sparkSession, "tablekit-profile", uuid.uuid4().hex)
            plain = self.source.toDF(*names)
            empty = {n: F.col(n).cast("string") for n, t in plain.dtypes if t == "void"}
            (plain.withColumns(empty) if empty else plain).write.parquet(self.stored)
            self._df = self.source.sparkSession.read.parquet(self.stored).toDF(*self.source.columns)
        return self._df

    def _ranges(self) -> None:
        """Pass 1, where a statistic needs it: numeric and temporal columns."""
        self._pass1([p for p in self.plans if p.ranged])

    def _pass1(self, plans: Sequence[ColumnPlan]) -> None:
        todo = [p for p in plans if f"nan{p.pos}" not in self.stats]
        if todo:
            self.stats.update(scalar_stats(self.df, todo, self.approx))

    def _nan(self, p: ColumnPlan) -> int:
        key = f"nan{p.pos}"
        if key not in self.stats and self._summary and p.pos in self._summary["miss"]:
            self.stats[key] = self._summary["miss"][p.pos]
        if key not in self.stats:
            self._pass1([p])
        return int(self.stats[key])

    def close(self) -> None:
        """Forget the results and remove what was stored."""
        self._summary = None
        if self.stored:
            context = self.source.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(self.stored)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            self.stored = self._df = None

    def __enter__(self) -> "Profile":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    @property
    def rows(self) -> int:
        if "rows" not in self.stats:
            if self._summary and self._summary["rows"] is not None:
                self.stats["rows"] = self._summary["rows"]
            else:
                self.stats["rows"] = self.df.count()
        return self.stats["rows"]

    def null_counts(self) -> DataFrame:
        known = set(self._summary["miss"]) if self._summary else set()
        self._pass1([p for p in self.plans if p.pos not in known])   # one job for all that are missing
        rows = [(p.name, self._nan(p)) for p in self.plans]
        return literal_rows(self.df.sparkSession, rows, "column_name string, nan_count long")

    def min_max(self) -> DataFrame:
        self._ranges()
        rows = [(p.name, stat_text(self.stats.get(f"min{p.pos}")), stat_text(self.stats.get(f"max{p.pos}")))
                for p in self.plans]
        return literal_rows(self.df.sparkSession, rows, "column_name string, min string, max string")

    def summary(self, plans: Sequence[ColumnPlan] | None = None) -> dict[str, dict]:
        """Pass 2 for ``plans`` (default: all columns), one job, results kept
        per column: distinct counts, non-missing totals, histogram bin sums and
        top values. Columns already summarised are not recomputed."""
        if self._summary is None:
            self._summary = {"uniq": {}, "nn": {}, "hist": {}, "top": {}, "miss": {}, "rows": None}
        out = self._summary
        todo = [p for p in (self.plans if plans is None else plans) if p.pos not in out["uniq"]]
        self._pass1([p for p in todo if p.ranged])
        ranged_with_edges = {p.pos for p in todo if p.ranged and
                             hist_edges(self.stats.get(f"lo{p.pos}"), self.stats.get(f"hi{p.pos}")) is not None}
        if todo:
            tops: dict[int, list] = {}
            for r in pass2(self.df, todo, self.stats).collect():
                if r.kind == "u":
                    out["uniq"][r.pos], out["nn"][r.pos], out["miss"][r.pos] = r.uniq, r.nn, r.miss
                    out["rows"] = r.rows
                    if r.hist is not None and r.pos in ranged_with_edges:
                        out["hist"][r.pos] = dict(enumerate(r.hist))
                elif r.v is not None:
                    tops.setdefault(r.pos, []).append((-r.cnt, r.v, r.cnt))
            whole = self._whole_texts({pos: [v for _, v, _ in top] for pos, top in tops.items()})
            for pos, top in tops.items():
                out["top"][pos] = [(i + 1, whole.get((pos, v), v), c) for i, (_, v, c) in enumerate(sorted(top))]
        return out

    def _whole_texts(self, keys: dict[int, list[str]]) -> dict[tuple[int, str], str]:
        """The texts behind the keys of long winners (at most three a column): one
        scan that keeps the cells with one of these digests."""
        long = {pos: [v for v in vs if len(v) > TEXT_KEY] for pos, vs in keys.items()}
        by_pos, out = {p.pos: p for p in self.plans}, {}
        for pos, vs in long.items():
            if vs:
                p = by_pos[pos]
                text = _value_text(qcol(p.name), p.dtype) if not isinstance(p.dtype, T.MapType) else qcol(p.name).cast("string")
                cells = self.df.select(text.alias("text")).filter(F.length("text") > TEXT_KEY).withColumn("k", text_key(F.col("text")))
                for r in cells.filter(F.col("k").isin(vs)).groupBy("k").agg(F.any_value("text").alias("text")).collect():
                    out[pos, r["k"]] = r["text"]
        return out

    def _hist_only(self, plans: Sequence[ColumnPlan]) -> None:
        """Histogram bin counts without grouping values (one job; at most ten
        rows per column come back)."""
        if self._summary is None:
            self._summary = {"uniq": {}, "nn": {}, "hist": {}, "top": {}, "miss": {}, "rows": None}
        todo = []
        for p in plans:
            edges = hist_edges(self.stats.get(f"lo{p.pos}"), self.stats.get(f"hi{p.pos}"))
            if edges is not None and p.pos not in self._summary["hist"]:
                todo.append((p, edges))
        if not todo:
            return
        # chunks of STATS_CHUNK columns: one scan and one explode of cheap
        # (column, axis value) pairs; a single bin expression then serves every
        # column (its edges looked up by position), and a partial aggregation
        # leaves <= 10 rows per column per task. Generated code stays small
        # however many columns there are.
        edges_of = _edges_table([p for p, _ in todo], self.stats)
        parts = []
        for start in range(0, len(todo), STATS_CHUNK):
            pairs = [F.struct(F.lit(p.pos).alias("pos"), _hist_value(qcol(p.name), p.dtype).alias("x"))
                     for p, _ in todo[start:start + STATS_CHUNK]]
            x = self.df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
            b = _bin_by_pos(F.col("x"), F.element_at(edges_of, F.col("pos") + 1))
            parts.append(x.select("pos", b.alias("b")).filter(F.col("b").isNotNull())
                         .groupBy("pos", "b").agg(F.count(F.lit(1)).alias("cnt")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        for p, _ in todo:
            self._summary["hist"][p.pos] = {k: 0 for k in range(HIST_BINS)}
        for r in out.collect():
            self._summary["hist"][r.pos][r.b] = r.cnt

    def _exact_plans(self) -> list[ColumnPlan]:
        return [p for p in self.plans if not (self.approx and p.ranged)]

    def _unique_rows(self) -> list[tuple]:
        if self.approx:
            self._ranges()
        sm = self.summary(self._exact_plans())

        def uniq(p: ColumnPlan) -> int:
            if is_complex(p.dtype):
                return int(self.rows)
            if self.approx and p.ranged:
                return int(self.stats.get(f"adc{p.pos}", 0) or 0)
            return int(sm["uniq"].get(p.pos, 0))
        return [(p.name, uniq(p)) for p in self.plans]

    def unique_counts(self) -> DataFrame:
        return literal_rows(self.df.sparkSession, self._unique_rows(), "column_name string, unique_count long")

    def _hist_rows(self) -> list[tuple]:
        self._ranges()
        self._hist_only([p for p in self.plans if p.ranged])
        sm = self._summary
        rows = []
        for p in self.plans:
            edges = hist_edges(self.stats.get(f"lo{p.pos}"), self.stats.get(f"hi{p.pos}")) if p.ranged else None
            if edges is None:
                continue
            bins = sm["hist"].get(p.pos, {})
            rows += [(p.name, k, float(edges[k]), float(edges[k + 1]), int(bins.get(k, 0))) for k in range(HIST_BINS)]
        return rows

    def histograms(self) -> DataFrame:
        return literal_rows(self.df.sparkSession, self._hist_rows(),
                            "column_name string, bin int, bin_start double, bin_end double, count long")

    def _cat_rows(self) -> list[tuple]:
        cat_plans = [p for p in self.plans if not p.ranged]
        sm = self.summary(cat_plans)
        rows = []
        for p in cat_plans:
            nan = self._nan(p)
            uniq, nn = int(sm["uniq"].get(p.pos, 0)), int(sm["nn"].get(p.pos, 0) or 0)
            entries = category_entries(sm["top"].get(p.pos, []), uniq, nn, nan)
            rows += [(p.name, i + 1, name, cnt) for i, (name, cnt) in enumerate(entries)]
        return rows

    def categories(self) -> DataFrame:
        return literal_rows(self.df.sparkSession, self._cat_rows(),
                            "column_name string, position int, name string, count long")

    TABLE_SCHEMA = ("position int, column_name string, dtype string, unique_count long, nan_count long, "
                    "min string, max string, histogram array<struct<bin_start:double,bin_end:double,count:bigint>>, "
                    "categories array<struct<name:string,count:bigint>>")

    def records(self) -> list[tuple]:
        """One tuple per column (TABLE_SCHEMA order), built from the per-column
        values already collected by pass 1 and pass 2: no further job."""
        self._ranges()
        self.summary()          # one pass-2 job for every column (histograms included)
        uniq = dict(self._unique_rows())
        hist: dict[str, list] = {}
        for name, _, start, end, cnt in self._hist_rows():
            hist.setdefault(name, []).append((start, end, cnt))
        cats: dict[str, list] = {}
        for name, _, cat, cnt in self._cat_rows():
            cats.setdefault(name, []).append((cat, cnt))
        return [(p.pos, p.name, p.dtype.simpleString(), uniq.get(p.name), self._nan(p),
                 stat_text(self.stats.get(f"min{p.pos}")), stat_text(self.stats.get(f"max{p.pos}")),
                 hist.get(p.name), cats.get(p.name)) for p in self.plans]

    def table(self) -> DataFrame:
        """One row per column: position, name, type, unique and missing counts,
        min/max text, histogram and categories as arrays of structs."""
        return literal_rows(self.df.sparkSession, self.records(), self.TABLE_SCHEMA)


def analyze_columns(df: DataFrame, columns: Sequence[str] | None = None, approx_distinct: bool = False,
                    approx: bool = False) -> DataFrame:
    """Stats for every column, or for the named ones; the others are listed
    without stats. ``approx=True`` reads them off mergeable sketches
    (``operators.sketches``): one pass, no shuffle that grows with the data."""
    if approx:
        from .sketches import column_sketches, estimates, merge_sketches
        done = [tuple(r) for r in estimates(merge_sketches(column_sketches(df, columns))).collect()]
    else:
        with Profile(df, columns, approx_distinct) as profile:
            done = profile.records()
    by_pos = {r[0]: r for r in done}
    rows = [by_pos.get(i, (i, f.name, f.dataType.simpleString(), None, None, None, None, None, None))
            for i, f in enumerate(df.schema.fields)]
    return literal_rows(df.sparkSession, rows, Profile.TABLE_SCHEMA)


def analyze_columns_records(df: DataFrame, columns: Sequence[str] | None = None) -> list[dict]:
    """``analyze_columns`` as a list of dicts (one per column, bounded)."""
    stats = ("unique_count", "nan_count", "min", "max", "histogram", "categories")
    out = []
    for r in analyze_columns(df, columns).orderBy("position").collect():
        d = r.asDict(recursive=True)
        out.append({"name": d["column_name"], "dtype": d["dtype"],
                    "stats": None if d["unique_count"] is None else {k: d[k] for k in stats}})
    return out


def color_scale_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min/max of the picked numeric/temporal columns in one aggregate:
    (column_name, min, max) typed as double (instants as epoch seconds)."""
    fields = [f for f in df.schema.fields if f.name in set(columns) and is_numeric_or_temporal(f.dataType)]
    if not fields:
        return literal_rows(df.sparkSession, [], "column_name string, min double, max double")
    aggs = []
    for i, f in enumerate(fields):
        c = qcol(f.name)
        v = c.cast("double") if is_numeric(f.dataType) else _hist_value(c, f.dataType) / 1_000_000.0
        v = F.when(~F.isnan(v), v)
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    one = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"mn{i}").alias("min"),
                                 F.col(f"mx{i}").alias("max")) for i, f in enumerate(fields)])
    return one.select(F.inline(entries))


#: Types whose values sort in Arrow as they do in Spark.
ARROW_ORDERED = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
                 T.DayTimeIntervalType)


def smallest_per_task(df: DataFrame, names: Sequence[str], limit: int) -> DataFrame:
    """Per task and column the ``limit`` smallest distinct values that are not
    missing, side by side (columns with fewer are filled up with nulls): at most
    ``limit`` rows a task, however many distinct values there are."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        held, kinds, keep = [None] * len(names), None, max(limit, 0)

        def smallest(values):
            values = pc.drop_null(pc.unique(values))
            if pa.types.is_floating(values.type):
                values = values.filter(pc.invert(pc.is_nan(values)))
            return values.take(pc.sort_indices(values)[:keep])

        for batch in batches:
            kinds = batch.schema
            for k, cells in enumerate(batch.columns):
                known = held[k]
                if known is not None and len(known) == keep and keep:
                    if not pa.types.is_boolean(cells.type):
                        cells = cells.filter(pc.less(cells, known[-1]))     # nulls go too
                held[k] = smallest(cells if known is None else pa.concat_arrays([known, cells]))
        if kinds is not None:
            size = max(map(len, held))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([h, pa.nulls(size - len(h), h.type)]) for h in held], names=kinds.names)

    cells = df.select(*(F.when(c == 0, F.lit(0).cast(t)).otherwise(c).alias(f"c{k}") if is_fractional(t) else c.alias(f"c{k}")
                        for k, (c, t) in enumerate((qcol(n), df.schema[n].dataType) for n in names)))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in cells.schema])     # filled up with nulls
    return cells.mapInArrow(run, schema).toDF(*names)


def distinct_values(df: DataFrame, columns: Sequence[str], limit: int = DISTINCT_LIMIT) -> DataFrame:
    """(column_name, rank, value): the ``limit`` smallest distinct values per
    column that are not missing (null or NaN), in the column's own order, as
    text. All columns share one scan, in which every task keeps its ``limit``
    smallest values (``smallest_per_task``), so at most that many rows a task are
    shuffled; these are grouped once and ranked per column.
    Unknown column -> KeyError; map columns -> no rows; arrays and structs, which
    have no common order with others, take a plan of their own."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    for name in columns:
        if name not in fields:
            raise KeyError(name)
    names = [c for c in columns if not isinstance(fields[c], T.MapType)]
    bounded = list(dict.fromkeys(c for c in names if isinstance(fields[c], ARROW_ORDERED)))
    few = smallest_per_task(df, bounded, limit) if bounded else df
    pairs, parts = {True: [], False: []}, []
    none = F.lit(None)
    for pos, name in enumerate(names):
        c, dtype = qcol(name), fields[name]
        if is_complex(dtype):
            top = df.select(c.alias("x")).filter("x IS NOT NULL").distinct().orderBy("x").limit(limit)
            parts.append(top.select(F.lit(name).alias("column_name"),
                                    F.row_number().over(Window.orderBy("x")).alias("rank"),
                                    F.col("x").cast("string").alias("value")))
            continue
        if is_fractional(dtype):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        number = c.cast("decimal(38,10)") if isinstance(dtype, T.DecimalType) else none.cast("decimal(38,10)")
        entry = [F.lit(pos).alias("pos"),
                 (c.cast("bigint") if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else none.cast("bigint")).alias("l"),
                 (c.cast("double") if is_fractional(dtype) else none.cast("double")).alias("d"), number.alias("n"),
                 (c.cast("timestamp_ntz") if is_temporal(dtype) else none.cast("timestamp_ntz")).alias("t"),
                 (duration_seconds(c) if is_duration(dtype) else none.cast("double")).alias("i"),
                 F.when(~missing(c, dtype), c.cast("string")).alias("value")]
        pairs[name in bounded].append(F.struct(*entry))
    for source, cells in ((few, pairs[True]), (df, pairs[False])):
        if not cells:
            continue
        keys = ["pos", "l", "d", "n", "t", "i", "value"]
        groups = (source.select(F.explode(F.array(*cells)).alias("e")).select("e.*")
                  .filter("value IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("cells")))
        w = Window.partitionBy("pos").orderBy("l", "d", "n", "t", "i", "value")
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
        parts.append(groups.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
                     .select(name.alias("column_name"), "rank", "value"))
    if not parts:
        return literal_rows(df.sparkSession, [], "column_name string, rank int, value string")
    return functools.reduce(DataFrame.unionByName, parts)


def distinct_values_dict(df: DataFrame, columns: Sequence[str], limit: int = DISTINCT_LIMIT) -> dict:
    out: dict[str, list] = {c: [] for c in columns}
    for r in distinct_values(df, columns, limit).collect():
        out[r["column_name"]].append(r["value"])
    return out


# --- CSV size estimate ------------------------------------------------------------------

def estimate_csv_size(df: DataFrame, exact: bool = False, sample_rows: int = 500, seed: int = 0) -> int:
    """Bytes of the table written as CSV with a header.

    ``exact=True`` sums every line in one aggregate (same job shape as a count).
    Otherwise the mean line size of ``sample_rows`` rows, taken by hash from the
    whole table, is scaled by the row count; an empty table gives 0.
    """
    if exact:
        return csv_size(df)
    from .shape import sample_n
    rows = df.count()
    if rows == 0:
        return 0
    lines = df.select(csv_line_bytes(df).alias("bytes"))
    mean = sample_n(lines, min(sample_rows, rows), seed, total=rows).agg(F.avg("bytes")).first()[0]
    return round(mean * rows) + csv_header_bytes(df)


def estimate_csv_size_df(df: DataFrame) -> DataFrame:
    """Exact CSV byte size as a one-row table (lazy)."""
    header = csv_header_bytes(df)
    agg = df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(csv_line_bytes(df)).alias("b"))
    return agg.select("row_count", F.when(F.col("row_count") == 0, F.lit(0).cast("long"))
                      .otherwise(F.col("b") + F.lit(header)).cast("long").alias("csv_bytes"))
