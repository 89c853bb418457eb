"""Helpers shared by the operators: clash-free column names, checkpoints in the
shared folder, and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.session import shared_root


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows that go to a Python worker at once: texts are long.
TEXT_ROWS = 2000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session sends at most ``TEXT_ROWS`` rows per Arrow batch,
    so that whole texts do not fill the workers (a session with less keeps it)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that a lost
    executor costs a re-read and later uses see the same rows."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def least_hashes(rows: DataFrame, most: int) -> list[int]:
    """The ``most`` smallest different values of the 64-bit hashes in column ``h``
    (fewer, if there are not so many). Only those under a bound that about twice
    as many are expected to pass are sorted; should fewer pass, it is raised."""
    hashes = saved(rows.select("h").distinct())
    n = hashes.count()
    share = 2 * most / n if n else 1
    while True:
        bound = -(1 << 63) + int(min(1, share) * ((1 << 64) - 1))
        least = [r["h"] for r in hashes.filter(F.col("h") <= bound).orderBy("h").limit(most).collect()]
        if len(least) == most or share >= 1:
            return least
        share *= 4


def slices(batches: Iterable, size_of, most: int) -> Iterator:
    """Consecutive slices of Arrow batches, each of at most ``most`` units by
    ``size_of(batch)`` (an array of sizes per row), or of a single row."""
    for batch in batches:
        start, total = 0, 0
        for i, size in enumerate(size_of(batch)):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def text_sizes(batch) -> list[int]:
    """Bytes of each value of the batch's ``text`` column (nulls are 0)."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
