"""SQL cells over named tables: parameters, chaining, previews, caching.

Spark does all query work: text goes to ``spark.sql`` with *bound* parameters
(values never become SQL text), chained results are published as temp views
whose lazy plans Catalyst inlines, and previews are ``limit`` views of the full
lazy result. The only text handling here is replacing the four template
placeholder forms by parameter markers; statements are told apart by Spark's parser.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import json
import re
import uuid
from dataclasses import dataclass, field
from typing import Any, Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_path
from ..sources.files import entries, fs_path, inputs_identity

# Rows of a query preview, and the cache modes.
QUERY_PREVIEW_ROWS = 100
CACHE_DISABLED, READ_OR_WRITE, ALWAYS_WRITE = "cache_disabled", "read_or_write", "always_write"


class SqlCellError(ValueError):
    pass


# --- tables by name -----------------------------------------------------------------

class Views:
    """Temp views made under given names; ``drop`` gives every name back to the
    view that had it before (a user's own view is never lost)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.before: dict[str, DataFrame | None] = {}

    def put(self, name: str, df: DataFrame) -> None:
        if name not in self.before:
            temporary = [t for t in self.spark.catalog.listTables(pattern=name) if t.isTemporary and t.name == name.lower()]
            self.before[name] = self.spark.table(quote_identifier(name)) if temporary else None
        df.createOrReplaceTempView(name)

    def drop(self) -> None:
        for name, df in self.before.items():
            if df is None:
                self.spark.catalog.dropTempView(name)
            else:
                df.createOrReplaceTempView(name)
        self.before = {}


@contextlib.contextmanager
def temp_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[None]:
    """Publish tables under names for the duration of the block, then give the
    names back. DataFrames made inside keep working: ``spark.sql`` resolves
    views when the query is analysed."""
    views = Views(spark)
    try:
        for name, df in tables.items():
            views.put(name, df)
        yield
    finally:
        views.drop()


def sql_on_tables(spark: SparkSession, query: str, tables: Mapping[str, DataFrame] | None = None,
                  args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run SQL over in-scope tables referenced by plain name."""
    with temp_views(spark, tables or {}):
        return spark.sql(query, args=dict(args) if args else None)


# --- templates -> bound parameters -----------------------------------------------------

_COMMENTS = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)      # only to see whether a cell is empty
_PLACEHOLDER = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\|\s*([a-z_]+)\s*)?\}\}")


def quote_identifier(name: str) -> str:
    """Dotted name -> backquoted parts (backquotes doubled)."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in str(name).split("."))


#: Ranges that stand in for a list in the scan.
LIST_RANGES = 8
#: A plain column before ``IN``, where an expression begins: behind an opening
#: bracket or one of these words, so that nothing before it belongs to it.
_WITH_LIST = re.compile(r"(\(\s*|\b(?:WHERE|AND|OR|ON|HAVING|WHEN)\s+)((?:\w+|`[^`]+`)(?:\.(?:\w+|`[^`]+`))*)(\s+IN\s*"
                        r"\{\{\s*([A-Za-z_]\w*)\s*\|\s*inclause\s*\}\})", re.I)


def list_ranges(values: list, most: int = LIST_RANGES) -> list[tuple[Any, Any]]:
    """At most ``most`` ranges that cover a list: cut at its widest gaps (numbers,
    dates, times) or into equal parts (texts). None for lists without a common
    order in Spark and Python: empty or mixed ones, nulls, NaN, booleans."""
    kinds = {type(v) for v in values}
    if not values or not (kinds <= {int} or kinds <= {int, float} or len(kinds) == 1 and kinds <= {str, dt.date, dt.datetime}):
        return []
    if any(v != v for v in values) or kinds == {dt.datetime} and len({v.tzinfo is None for v in values}) > 1:
        return []
    found = sorted(set(values))
    if kinds == {str}:
        found.sort(key=lambda v: v.encode("utf-8", "surrogatepass"))
        cuts = [k * len(found) // most for k in range(1, most)] if len(found) > most else []
    else:
        gaps = sorted(range(1, len(found)), key=lambda k: found[k] - found[k - 1], reverse=True)
        cuts = sorted(gaps[:most - 1])
    return [(found[a], found[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(found)]) if b > a]


def _with_ranges(m: re.Match, params: Mapping[str, Any], args: dict[str, Any]) -> str:
    """``c IN list`` as ``(c IN list AND (c >= low AND c <= high OR ...))``: the same truth
    value for every cell, as the list has no null."""
    before, column, clause, name = m.groups()
    ranges = list_ranges(list(params[name])) if name in params else []
    if not ranges:
        return m[0]
    tests = []
    for k, (low, high) in enumerate(ranges):
        args[f"{name}__low{k}"], args[f"{name}__high{k}"] = low, high
        tests.append(f"{column} >= :{name}__low{k} AND {column} <= :{name}__high{k}")
    return f"{before}({column}{clause} AND ({' OR '.join(tests)}))"


def compile_template(template: str, params: Mapping[str, Any], list_filters: bool = False) -> tuple[str, dict[str, Any]]:
    """Replace the placeholder forms by Spark parameter markers:

    * ``{{ x }}`` -> ``:x`` (value bound, never spliced into the text);
    * ``{{ xs | inclause }}`` -> ``(SELECT explode(:xs))``: an IN-subquery over
      one array parameter, which Spark plans as a semi-join against a small
      local relation (any list length). With ``list_filters``, behind a plain column,
      the list's ranges (``list_ranges``) are added as bound comparisons, which
      the scan can use;
    * ``{{ t | identifier }}`` -> ``IDENTIFIER(:t)`` with the dotted name quoted;
    * ``{{ frag | sqlsafe }}`` -> the text itself (caller-chosen columns or
      fragments, inserted as written).
    """
    args: dict[str, Any] = {}
    if list_filters:
        template = _WITH_LIST.sub(lambda m: _with_ranges(m, params, args), template)

    def sub(m: re.Match) -> str:
        name, filt = m.group(1), m.group(2)
        if name not in params:
            raise SqlCellError(f"template variable {name!r} is not defined")
        value = params[name]
        if filt is None:
            args[name] = value
            return f":{name}"
        if filt == "inclause":
            args[name] = list(value)
            return f"(SELECT explode(:{name}))"
        if filt == "identifier":
            args[name] = quote_identifier(value)
            return f"IDENTIFIER(:{name})"
        if filt == "sqlsafe":
            return str(value)
        raise SqlCellError(f"unknown template filter {filt!r}")

    return _PLACEHOLDER.sub(sub, template), args


def run_template(spark: SparkSession, template: str, params: Mapping[str, Any] | None = None,
                 tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    plain, filtered = (compile_template(template, params or {}, list_filters=f) for f in (False, True))
    if filtered[0] != plain[0]:
        # a column that takes the list but no comparison with its ends goes without them
        with contextlib.suppress(AnalysisException):
            return sql_on_tables(spark, filtered[0], tables, filtered[1])
    return sql_on_tables(spark, plain[0], tables, plain[1])


# --- statement kind, by Spark's own parser ------------------------------------------------

def is_single_select(query: str, spark: SparkSession | None = None) -> bool:
    """Whether Spark parses ``query`` as one statement that only reads rows: no
    command and no other statement anywhere in its plan (an INSERT behind WITH
    or FROM included). Template placeholders count as values."""
    spark = spark or SparkSession.active()
    stand_in = {None: "NULL", "inclause": "(NULL)"}     # for a name or fragment: x
    text = _PLACEHOLDER.sub(lambda m: stand_in.get(m.group(2), "x"), query)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception:  # noqa: BLE001 - no statement, or several
        return False
    kind = spark.sparkContext._jvm.java.lang.Class.forName
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    others = [kind(logical + name) for name in ("Command", "ParsedStatement")]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(other.isInstance(node) for other in others):
            return False
        for nodes in (node.children(), node.innerChildren()):
            plans = [nodes.apply(k) for k in range(nodes.size())]
            todo += [x for x in plans if kind(logical + "LogicalPlan").isInstance(x)]
    return True


# --- result cache ----------------------------------------------------------------------

def cache_key(query: str, params: Mapping[str, Any] | None, inputs: str = "") -> str:
    """sha256 of the query, the sorted parameters and the inputs' identity."""
    text = "\x00".join([query, json.dumps(params or {}, sort_keys=True, default=str), inputs])
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@dataclass
class CacheOutcome:
    df: DataFrame
    status: str          # read_from_cache | written_to_cache | cache_not_supported | not_cached
    path: str | None = None


def cached_sql(spark: SparkSession, query: str, params: Mapping[str, Any] | None = None,
               mode: str = READ_OR_WRITE, tables: Mapping[str, DataFrame] | None = None,
               root: str | None = None, max_bytes: int | None = None) -> CacheOutcome:
    """Run a (templated) query through a parquet result cache.

    The key is the text, its parameters and the identity of the inputs, so a
    changed table is computed anew. ``read_or_write`` reads a complete earlier
    result or runs and stores; ``always_write`` runs and stores;
    ``cache_disabled`` just runs. The query runs once, and its columns have the
    same types in every mode. An entry is written to a folder of its own and
    counts once its marker is there, so readers of an older one go on.
    Statements that are no queries, and results that parquet cannot hold, are
    not cached; a failing query fails. ``max_bytes`` (off by default) drops
    larger entries. Entries live under the shared folder unless ``root`` is given.
    """
    params = dict(params or {})
    if mode != CACHE_DISABLED and not is_single_select(query, spark):
        return CacheOutcome(run_template(spark, query, params, tables), "cache_not_supported")
    df = run_template(spark, query, params, tables)
    if mode == CACHE_DISABLED:
        return CacheOutcome(df, "not_cached")
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema):
        return CacheOutcome(df, "not_cached")
    key = cache_key(query, params, inputs_identity(df))
    folder = f"{root.rstrip('/')}/{key}" if root else shared_path(spark, "tablekit-sql-cache", key)
    if mode == READ_OR_WRITE and (there := entries(spark, folder)):
        return CacheOutcome(spark.read.schema(df.schema).parquet(there[-1]), "read_from_cache", there[-1])
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = fs_path(spark, path)
    if max_bytes is not None and fs.getContentSummary(p).getLength() > max_bytes:
        fs.delete(p, True)
        return CacheOutcome(df, "not_cached")
    return CacheOutcome(spark.read.schema(df.schema).parquet(path), "written_to_cache", path)


# --- chained cells and previews ---------------------------------------------------------

@dataclass
class QueryPreview:
    """A chained cell result: the full lazy result (the chaining source) and
    its first ``rows`` rows."""
    name: str
    sql: str
    full: DataFrame
    rows: int = QUERY_PREVIEW_ROWS

    @property
    def preview(self) -> DataFrame:
        return self.full.limit(self.rows)


@dataclass
class SqlWorkspace:
    """Named results that later cells can reference by name.

    Each cell's full lazy result is published as a temp view under its name, so
    a later query that names it (directly, through another preview, in a
    diamond, or next to its own WITH clause) is resolved by Catalyst. A view
    already holds the analysed plan of its own references, so there is no
    ordering problem and no text is spliced.
    """
    spark: SparkSession
    previews: dict[str, QueryPreview] = field(default_factory=dict)

    def __post_init__(self):
        self.views = Views(self.spark)

    def register_table(self, name: str, df: DataFrame) -> None:
        self.views.put(name, df)

    def cell(self, name: str | None, template: str, params: Mapping[str, Any] | None = None,
             return_type: str = "dataframe", preview_rows: int = QUERY_PREVIEW_ROWS) -> DataFrame | QueryPreview | None:
        """Compile (template -> parameters), run and return a table, a query
        preview or nothing for an empty text. A preview must be a single query."""
        if not _COMMENTS.sub(" ", template).strip():
            return None
        if return_type == "query_preview" and not is_single_select(template, self.spark):
            raise SqlCellError("a query preview needs a single SELECT statement")
        sql, args = compile_template(template, params or {})
        df = self.spark.sql(sql, args=args or None)
        if name:
            self.views.put(name, df)
        if return_type == "query_preview":
            qp = QueryPreview(name or "", sql, df, preview_rows)
            if name:
                self.previews[name] = qp
            return qp
        return df

    def drop(self) -> None:
        """Give all names back (also those of plain cells)."""
        self.views.drop()


#: A place in a cell: a name in braces, maybe with attributes or indexes behind it.
_PLACE = re.compile(r"\{([A-Za-z_]\w*)((?:\.\w+|\[\w+\])*)\}")


def cell_places(text: str) -> tuple[str, set[str]]:
    """A cell for Spark's formatter, and the names it uses: every brace that is
    not around a name (JSON, regular expressions, lone ones) stays text."""
    out, at, used = [], 0, set()
    for m in _PLACE.finditer(text):
        out += [text[at:m.start()].replace("{", "{{").replace("}", "}}"), m[0]]
        used.add(m[1])
        at = m.end()
    return "".join(out) + text[at:].replace("{", "{{").replace("}", "}}"), used


def spark_sql_cell(spark: SparkSession | None, text: str, namespace: Mapping[str, Any] | None = None,
                   keep: str = "", view: str | None = None) -> DataFrame:
    """Run a cell whose ``{name}`` places are filled by Spark itself: tables,
    columns and quoted values, never spliced text; other braces are the query's
    own. ``keep``: "" (lazy), "lazy" (cached when first used) or "now" (cached at
    once); ``view`` also publishes the result."""
    if spark is None:
        raise RuntimeError("no active Spark session")
    namespace = dict(namespace or {})
    template, used = cell_places(text)
    if unknown := sorted(used - set(namespace)):
        raise NameError(f"the cell uses names that are not defined: {', '.join(unknown)}")
    df = spark.sql(template, **{name: namespace[name] for name in used}) if used else spark.sql(text)
    if keep:
        df = df.cache()
    if keep == "now":
        df.count()
    if view:
        df.createOrReplaceTempView(view)
    return df
