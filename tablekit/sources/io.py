"""Sources and sinks: accepted table kinds, JDBC queries, CSV / JSON / parquet
round trips and the size-checked export.

Every write is a distributed Spark write of part files into a folder; nothing
is streamed through the driver and nothing is coalesced into one task.
"""

from __future__ import annotations

import uuid
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.csv import CSV_OPTIONS, CSV_READ_OPTIONS, JSON_OPTIONS, csv_ready, csv_size
from ..functions.spec import View, read_view
from ..operators.shape import sort_for_files
from ..plans.browse import selected_rows
from ..session import shared_path
from .files import entries, fs_path

# Fixed value: exports estimated above 1 GB are refused.
EXPORT_MAX_BYTES = 1024 ** 3


class UnsupportedDataFrameError(TypeError):
    pass


class ExportTooLargeError(ValueError):
    pass


def is_supported(obj: Any) -> bool:
    try:
        _classify(obj)
        return True
    except UnsupportedDataFrameError:
        return False


def _classify(obj: Any) -> str:
    if isinstance(obj, DataFrame):
        return "spark"
    mod = type(obj).__module__
    if mod.startswith("pyspark.sql.connect") and type(obj).__name__ == "DataFrame":
        return "spark"
    if mod.startswith("pyspark.pandas") and hasattr(obj, "to_spark"):
        return "pandas_on_spark"
    if mod.startswith("pandas") and type(obj).__name__ == "DataFrame":
        return "pandas"
    raise UnsupportedDataFrameError(f"{type(obj).__name__} is not a supported table")


def table_from_native(obj: Any, spark: SparkSession | None = None) -> DataFrame:
    """Spark (classic or Connect) frames pass through; pandas-on-Spark frames
    become Spark frames without moving data; a local pandas frame is
    distributed with ``createDataFrame`` (it is already in driver memory).
    Anything else raises ``UnsupportedDataFrameError``."""
    kind = _classify(obj)
    if kind == "spark":
        return obj
    if kind == "pandas_on_spark":
        return obj.to_spark()
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session to distribute a pandas frame")
    return spark.createDataFrame(obj)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
               **options: Any) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


# --- JDBC ----------------------------------------------------------------------------

def jdbc_options(url: str, query: str | None = None, table: str | None = None,
                 properties: Mapping[str, str] | None = None, partition_column: str | None = None,
                 lower_bound: Any = None, upper_bound: Any = None, num_partitions: int | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for a JDBC query. Large reads name a numeric/date
    ``partition_column`` with bounds so ``num_partitions`` tasks read ranges in
    parallel (Spark requires ``dbtable`` for partitioned reads, so the query is
    wrapped as a derived table)."""
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    opts = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned reads need bounds and num_partitions")
        opts["dbtable"] = table if table else f"({query}) tk_q"
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    elif query is not None:
        opts["query"] = query
    else:
        opts["dbtable"] = table
    return opts


def jdbc_query_source(spark: SparkSession, url: str, query: str, **kw: Any) -> DataFrame:
    """Run a query on an external database through its JDBC driver and return
    it as a table (lazy; the database is read when an action runs)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query=query, **kw)).load()


# --- CSV / JSON / parquet ---------------------------------------------------------------

def csv_export(df: DataFrame, path: str, mode: str = "overwrite", *, compression: str | None = None) -> str:
    """Header + rows as CSV part files in ``path``, written by the executors in
    parallel, without loss: microseconds, blanks around texts, line breaks,
    quotes (doubled), empty texts apart from nulls; arrays, maps, structs and
    intervals as text, binaries as ``b'...'``. ``compression`` names a codec for
    the files (``gzip``: ``.csv.gz``, the same bytes once unpacked); None: plain."""
    codec = {} if compression is None else {"compression": compression}
    csv_ready(df).write.mode(mode).options(header="true", **CSV_OPTIONS, **codec).csv(path)
    return path


def read_csv_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(header="true", **CSV_READ_OPTIONS).schema(schema).csv(path)


def export_table(df: DataFrame, spec: View | str | dict | None, path: str,
                 max_bytes: int | None = EXPORT_MAX_BYTES, *, compression: str | None = None) -> str:
    """Filter and sort by a view (over all columns), refuse when the CSV's exact
    size (one aggregate over the unsorted rows; unpacked, if ``compression`` is
    given) exceeds ``max_bytes`` (None: no limit), then write the CSV folder
    (parents are created by the writer): in the view's order over the files, with
    equal sort values cut like any others."""
    view = read_view(spec, df.columns)
    rows = selected_rows(df, view)
    if max_bytes is not None and (size := csv_size(rows)) > max_bytes:
        raise ExportTooLargeError(f"the export has {size} bytes, more than {max_bytes}")
    return csv_export(sort_for_files(rows, view.order), path, compression=compression)


def json_export(df: DataFrame, path: str, index_col: str = "__tk_pos") -> str:
    """Newline JSON part files. A position column travels with the rows, so a
    reader can restore the order a distributed write does not keep."""
    df.withColumn(index_col, F.monotonically_increasing_id()).write.mode("overwrite").options(**JSON_OPTIONS).json(path)
    return path


def json_import(spark: SparkSession, path: str, schema: str, index_col: str = "__tk_pos") -> DataFrame:
    """Read an export back with its schema, in the original row order, with
    the position column dropped."""
    df = spark.read.options(**JSON_OPTIONS).schema(f"{schema}, {index_col} bigint").json(path)
    return df.orderBy(index_col).drop(index_col)


def _result_folder(spark: SparkSession, key: str, root: str | None) -> str:
    return f"{root.rstrip('/')}/{key}" if root else shared_path(spark, "tablekit-results", key)


def store_result(df: DataFrame, key: str, root: str | None = None) -> str:
    """Write a result as parquet to a folder of its own under ``<root>/<key>``
    (shared folder by default). It counts once its marker is there: readers of an
    older result go on, and a lost write leaves that one as it was."""
    path = f"{_result_folder(df.sparkSession, key, root)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_result(spark: SparkSession, key: str, root: str | None = None) -> DataFrame:
    """The newest complete result of ``key``."""
    there = entries(spark, folder := _result_folder(spark, key, root))
    if not there:
        raise FileNotFoundError(f"no complete result in {folder}")
    return spark.read.parquet(there[-1])


def drop_older_results(spark: SparkSession, key: str, root: str | None = None, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` complete results of ``key``, once nobody
    reads them any more; returns how many went."""
    old = entries(spark, _result_folder(spark, key, root))[:-keep or None]
    for path in old:
        fs, p = fs_path(spark, path)
        fs.delete(p, True)
    return len(old)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared root for one write."""
    return shared_path(spark, f"tablekit-{kind}", uuid.uuid4().hex)
