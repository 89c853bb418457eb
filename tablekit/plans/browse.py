"""Browse, describe and preview: a view of a table -> one lazy plan -> bounded rows.

Conditions and order work on all columns; ``MAX_COLUMNS`` only bounds what a page
shows. Rows that conditions select are kept apart from their order: counts,
sizes and profiles read the selected rows and never sort.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spec import SortKey, View, read_conditions, read_view
from ..functions.types import qcol
from ..operators import profile as prof
from ..operators.filtering import apply_filters
from ..operators.records import json_safe_records, large_number_columns, to_records
from ..operators.shape import (MAX_COLUMNS, PREVIEW_ROWS, PageIndex, clamp_page, driver_type, first_columns, first_rows,
                               paginate, prepare_columns, sample_n, size, sort_multi)
from ..operators.sketches import SKETCHES, column_sketches, estimates, merge_sketches
from ..session import shared_path
from ..sources.files import entries, file_states, fs_path, inputs_identity, literal_path

INDEX_COLUMN = "row_index"
# Fixed value: the preview JSON is cut before the record that would pass 10 MB.
PREVIEW_JSON_MAX_BYTES = 10 * 1024 * 1024

Spec = View | str | dict | None


def selected_rows(df: DataFrame, spec: Spec, today: dt.date | None = None) -> DataFrame:
    """The rows that a view's conditions keep, with all columns, unsorted."""
    return apply_filters(prepare_columns(df, None), read_view(spec, df.columns).conditions, today)


def apply_browse_spec(df: DataFrame, spec: Spec, today: dt.date | None = None) -> DataFrame:
    """Filter and sort a table by one view, as a single lazy plan over all columns."""
    view = read_view(spec, df.columns)
    return sort_multi(selected_rows(df, view, today), view.order)


def browse_page(df: DataFrame, spec: Spec, total: int | None = None, today: dt.date | None = None,
                index_col: str = INDEX_COLUMN, max_columns: int | None = MAX_COLUMNS) -> DataFrame:
    """The requested page as a JSON-safe table with its global row index. The
    page is computed once, on the driver's bounded rows, where numbers past 2^53
    decide which columns become text."""
    view = read_view(spec, df.columns)
    rows = selected_rows(df, view, today)
    page = paginate(rows, view.page, view.rows_per_page, view.order, total=total, index_col=index_col)
    shown = page.select(*map(qcol, first_columns(rows, max_columns).columns), qcol(index_col))
    return json_safe_records(shown, large_number_columns(shown))


@dataclass
class Shown:
    """What a front end draws: a page, the sizes behind it, and the selected rows."""
    page: list[dict[str, Any]] = field(default_factory=list)
    total: int = 0
    held: int = 0
    source: str = "dataframe"
    selected: DataFrame | None = None


def browse_table(df: DataFrame, spec: Spec, today: dt.date | None = None, preview: "HeldPreview | None" = None,
                 max_columns: int | None = MAX_COLUMNS) -> Shown:
    """The page of a view with its counts; from a held preview's rows, if one is
    given. An empty selection needs no page job."""
    view = read_view(spec, df.columns)
    if preview is not None:
        preview.show(view, today)
        return Shown(preview.rows(view.page, view.rows_per_page), preview.total, preview.held, "data_preview",
                     preview.selected)
    rows = selected_rows(df, view, today)
    total = size(rows) if df.columns else 0
    if not total:
        return Shown(selected=rows)
    page = paginate(rows, view.page, view.rows_per_page, view.order, total=total)
    return Shown(to_records(first_columns(page, max_columns), view.rows_per_page), total, total, selected=rows)


def describe_table(df: DataFrame, spec: Spec, today: dt.date | None = None) -> dict[str, Any]:
    """A page, its counts and the profile of the selected rows in one document."""
    shown = browse_table(df, spec, today)
    return {"column_count": len(df.columns), "columns": prof.analyze_columns_records(shown.selected),
            "row_count": shown.total, "preview_row_count": shown.held, "rows": shown.page, "type": shown.source}


# --- pages of one view, by a stored index ------------------------------------------------

class PageStore:
    """Page indexes kept under the shared folder (or ``root``), one per state of
    the input files, selection and order: a table that has not changed is sampled
    and counted once, whoever browses it."""

    #: Settings that decide how files are split, and so the places of equal rows.
    SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum",
              "spark.sql.leafNodeDefaultParallelism", "spark.default.parallelism")

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root

    def _folder(self, rows: DataFrame, order: list) -> str:
        conf = self.spark.conf
        splits = [str(conf.get(k, None)) for k in self.SPLITS] + [str(self.spark.sparkContext.defaultParallelism)]
        key = hashlib.sha256("\n".join([inputs_identity(rows), json.dumps(order), *splits]).encode()).hexdigest()
        return f"{self.root.rstrip('/')}/{key}" if self.root else shared_path(self.spark, "tablekit-pages", key)

    def index(self, rows: DataFrame, keys: Iterable[SortKey] = ()) -> PageIndex:
        order = [(c, bool(asc)) for c, asc in keys]
        folder = self._folder(rows, order)
        if there := entries(self.spark, folder):
            found = sorted(self.spark.read.parquet(there[-1]).collect(), key=lambda r: r["range"])
            return PageIndex(rows, order, parts=([tuple(r["bound"]) for r in found[1:]], [r["rows"] for r in found]))
        index = PageIndex(rows, order)
        bounds, counts = index.parts
        kinds = ", ".join(f"k{i}: {driver_type(index.ranked.schema[c].dataType)}" for i, (c, _) in enumerate(index.order))
        made = [(k, n, bounds[k - 1] if k else None) for k, n in enumerate(counts)]
        (self.spark.createDataFrame(made, f"range int, rows bigint, bound struct<{kinds}>").coalesce(1)
         .write.parquet(f"{folder}/{uuid.uuid4().hex}"))
        return index


class PagedView:
    """The pages of one view: its rows are sampled and counted once (or that is
    read from ``store``); after that every page is one job over the ranges that
    hold it, and equals the page that ``browse_table`` shows."""

    def __init__(self, df: DataFrame, spec: Spec, today: dt.date | None = None, store: PageStore | None = None,
                 max_columns: int | None = MAX_COLUMNS):
        self.view = read_view(spec, df.columns)
        self.selected, self.max_columns = selected_rows(df, self.view, today), max_columns
        keys = list(self.view.order)
        self.index = store.index(self.selected, keys) if store else PageIndex(self.selected, keys)

    @property
    def total(self) -> int:
        return self.index.total

    def frame(self, page: int, rows_per_page: int | None = None, index_col: str = INDEX_COLUMN) -> DataFrame:
        """A page as a table, numbered over the whole view."""
        return self.index.page(page, rows_per_page or self.view.rows_per_page, index_col)

    def rows(self, page: int, rows_per_page: int | None = None) -> list[dict[str, Any]]:
        """A page's JSON-safe records."""
        size = rows_per_page or self.view.rows_per_page
        return to_records(first_columns(self.index.page(page, size), self.max_columns), size)

    def numbered(self, index_col: str = INDEX_COLUMN) -> DataFrame:
        """All rows of the view with their numbers, by the same ranges."""
        return self.index.row_index(index_col)


# --- data preview ------------------------------------------------------------------

def preview_head(rows: DataFrame, keys: Iterable[SortKey] = (), mode: str = "head", most: int = PREVIEW_ROWS,
                 seed: int = 42, sample_keys: list[str] | None = None, index_col: str = INDEX_COLUMN,
                 total: int | None = None) -> DataFrame:
    """At most ``most`` of the selected rows, numbered 0..n-1 in key order: the
    first ones, or (``mode="sampled"``) a reproducible hash sample."""
    keys = list(keys)
    if mode == "sampled":
        rows, total = sample_n(rows, most, seed, sample_keys or rows.columns, total), None
        total = most
    return first_rows(rows, keys, most, total, index_col)


class HeldPreview:
    """The first (or sampled) rows of a view, persisted until another source,
    other conditions, another order or another day ask for others. ``close``
    lets them go; the object is a context manager."""

    def __init__(self, source: DataFrame, most: int = PREVIEW_ROWS, mode: str = "head"):
        self.source, self.most, self.mode = source, most, mode
        self.total = self.held = 0
        self.selected: DataFrame | None = None
        self.head: DataFrame | None = None
        self._as_text: list[str] = []
        self._made_for: tuple | None = None
        self._profile: list[dict] | None = None

    def _asked(self, view: View, source: DataFrame, today: dt.date | None) -> tuple:
        # relative dates read the day the rows are asked for
        return source.semanticHash(), view.same_rows(), today or dt.date.today()

    def holds(self, view: View, source: DataFrame | None = None, today: dt.date | None = None) -> bool:
        return self._made_for == self._asked(view, source or self.source, today)

    def show(self, spec: Spec, today: dt.date | None = None, source: DataFrame | None = None) -> "HeldPreview":
        """Make sure that the rows of ``spec`` (of ``source``, if it has changed) are held."""
        source = source or self.source
        view = read_view(spec, source.columns)
        if not self.holds(view, source, today):
            self.close()
            self.source = source
            self.selected = selected_rows(source, view, today)
            self.total = size(self.selected)
            self.head = preview_head(self.selected, view.order, self.mode, self.most, total=self.total).persist(
                StorageLevel.MEMORY_AND_DISK)
            self.held = min(self.total, self.most)
            self._as_text = large_number_columns(self.head)
            self._made_for = self._asked(view, source, today)
        return self

    def close(self) -> None:
        if self.head is not None:
            self.head.unpersist()
        self.head = self.selected = self._made_for = self._profile = None

    def __enter__(self) -> "HeldPreview":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def data(self) -> DataFrame:
        """The held rows, JSON-safe."""
        return json_safe_records(self.head, self._as_text)

    def frame(self, page: int, rows_per_page: int) -> DataFrame:
        return page_of_preview(self.data, page, rows_per_page, self.held).orderBy(INDEX_COLUMN)

    def rows(self, page: int, rows_per_page: int) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.frame(page, rows_per_page).collect()]

    def column_stats(self) -> list[dict]:
        """Profile of all selected rows (not of the held ones), computed once."""
        if self._profile is None:
            self._profile = prof.analyze_columns_records(self.selected)
        return self._profile


class FollowedPreview:
    """A preview of the files at or below a path that follows them: when files
    were only added, ``refresh`` reads these alone and merges their rows, their
    number and their column sketches with what is held; when one was replaced or
    is gone, or the view has no sort order, it starts anew. The held rows are
    stored under the shared folder, so nothing is computed twice if an executor
    is lost."""

    def __init__(self, spark: SparkSession, path: str, spec: Spec = None, most: int = PREVIEW_ROWS, mode: str = "head",
                 file_format: str = "parquet", today: dt.date | None = None, seed: int = 42, sample_keys: list[str] | None = None):
        self.spark, self.path, self.spec, self.most, self.mode = spark, path, spec, most, mode
        self.file_format, self.today, self.seed, self.sample_keys = file_format, today, seed, sample_keys
        self.view, self.total, self.read = View(), 0, []
        self._head: DataFrame | None = None
        self._sketches: DataFrame | None = None
        self._known: DataFrame | None = None
        self._day: dt.date | None = None
        self._stored: list[str] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "tablekit-preview", uuid.uuid4().hex)
        df.write.parquet(path)
        self._stored.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def refresh(self) -> "FollowedPreview":
        """Make the held rows, total and sketches those of the files as they are now;
        ``read`` names the files that were read for it."""
        before = list(self._stored)
        now = self._keep(file_states(self.spark, [self.path]))
        old, day = self._known, self.today or dt.datetime.now(dt.timezone.utc).date()
        # relative dates hold for a day
        merge = (old is not None and self._head is not None and bool(self.view.order) and day == self._day
                 and old.join(now, now.columns, "left_anti").isEmpty())
        new = now.join(old, now.columns, "left_anti") if merge else now
        self.read = sorted(r["path"] for r in new.select("path").collect())
        if merge and not self.read:
            self._forget(self._stored[len(before):])
            return self
        self._take(merge)
        self._known, self._day = now, day
        self._forget(before)
        return self

    def _take(self, merge: bool) -> None:
        reader = self.spark.read.format(self.file_format).option("basePath", self.path)
        source = reader.load([literal_path(p) for p in self.read]) if self.read else None
        if source is None:      # no files: no rows
            self.total, self._head, self._sketches = 0, None, None
            return
        self.view = read_view(self.spec, source.columns)
        rows = selected_rows(source, self.view, self.today)
        sketches, total = column_sketches(rows), size(rows)
        few = self._few(rows, total)
        if merge:
            few = self._few(self._head.unionByName(few), min(self.total, self.most) + min(total, self.most))
            sketches, total = merge_sketches(self._sketches.unionByName(sketches)), self.total + total
        self._head, self._sketches, self.total = self._keep(few), self._keep(sketches), total

    def _few(self, rows: DataFrame, total: int) -> DataFrame:
        """The rows to hold, of these: the first in order, or a hash sample, which is
        the same whichever way its rows came together."""
        if self.mode == "sampled":
            return sample_n(rows, self.most, self.seed, self.sample_keys or rows.columns, total)
        return first_rows(rows, self.view.order, self.most, total)

    def _forget(self, paths: list[str]) -> None:
        for path in paths:
            fs, p = fs_path(self.spark, path)
            fs.delete(p, True)
            self._stored.remove(path)

    def close(self) -> None:
        """Remove what is stored."""
        self._forget(list(self._stored))
        self._head = self._sketches = self._known = None

    def __enter__(self) -> "FollowedPreview":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def held(self) -> int:
        return min(self.total, self.most)

    def frame(self, index_col: str = INDEX_COLUMN) -> DataFrame:
        """The held rows, numbered in the view's order."""
        if self._head is None:
            return self.spark.createDataFrame([], f"{index_col} long")
        return first_rows(self._head, self.view.order, self.most, self.held, index_col)

    def rows(self, page: int, rows_per_page: int) -> list[dict[str, Any]]:
        """A page of the held rows, JSON-safe."""
        frame = page_of_preview(self.frame(), page, rows_per_page, self.held)
        return to_records(frame.orderBy(INDEX_COLUMN), rows_per_page)

    def column_stats(self) -> DataFrame:
        """The profile table of all selected rows, read off the merged sketches."""
        empty = self.spark.createDataFrame([], SKETCHES)
        return estimates(merge_sketches(empty if self._sketches is None else self._sketches))


def page_of_preview(preview_rows: DataFrame, page_index: int, page_size: int, row_count: int | None = None,
                    index_col: str = INDEX_COLUMN) -> DataFrame:
    """Page over an indexed preview table, clamped to its last page (rows are
    counted where ``row_count`` is not given)."""
    page_index = clamp_page(size(preview_rows) if row_count is None else row_count, page_index, page_size)
    start = page_index * page_size
    idx = F.col(index_col)
    return preview_rows.filter((idx >= start) & (idx < start + page_size))


def preview_json_rows(preview_rows: DataFrame, max_bytes: int | None = PREVIEW_JSON_MAX_BYTES,
                      index_col: str = INDEX_COLUMN) -> DataFrame:
    """Preview rows as JSON texts, cut before the record that would push the
    running UTF-8 size past ``max_bytes`` (None: all). The running sum is a
    window over the bounded preview only."""
    js = preview_rows.select(index_col, F.to_json(F.struct(*map(qcol, preview_rows.columns))).alias("json"))
    w = Window.orderBy(index_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = js.withColumn("running_bytes", F.sum(F.octet_length("json")).over(w))
    return sized if max_bytes is None else sized.filter(F.col("running_bytes") <= max_bytes)


def data_preview_json(df: DataFrame, conditions: str | Iterable, order: str | Iterable, most: int = PREVIEW_ROWS,
                      mode: str = "sampled", max_bytes: int | None = PREVIEW_JSON_MAX_BYTES,
                      sample_keys: list[str] | None = None, most_chars: int | None = 1000) -> str:
    """The preview as one JSON array text (bounded edge: ``most`` rows,
    ``max_bytes`` bytes, ``most_chars`` characters a cell)."""
    keys = tuple((c, bool(asc)) for c, asc in (json.loads(order) if isinstance(order, str) else order))
    rows = selected_rows(df, View(tuple(read_conditions(conditions)), keys))
    head = preview_head(rows, keys, mode, most, sample_keys=sample_keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        safe = json_safe_records(head, large_number_columns(head), most_chars)
        texts = preview_json_rows(safe, max_bytes).orderBy(INDEX_COLUMN).select("json").collect()
    finally:
        head.unpersist()
    return "[" + ",".join(r["json"] for r in texts) + "]"


def preview_total_size(selected: DataFrame, preview_rows: int = PREVIEW_ROWS) -> DataFrame:
    """Rows after filters next to the preview's own row count, one aggregate."""
    n = F.count(F.lit(1))
    return selected.agg(n.alias("row_count"), F.least(n, F.lit(preview_rows)).alias("preview_row_count"))
