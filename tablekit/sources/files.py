"""The files behind a table: their state as a DataFrame, and one digest of it.

Names, lengths and times come from Spark's own file listing (a ``binaryFile`` scan
that reads no content), so a table of a million files is listed and hashed in
tasks, and nothing depends on how many files there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "path string, length bigint, modified timestamp"
BUCKETS = 4096


def plain_path(uri: str) -> str:
    """A file's name as the listing writes it: without escapes, one form of ``file:``."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def read_path() -> Column:
    """The file that a row was read from, as the listing writes it."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(escaped), "^file:/+", "file:/")


def literal_path(path: str) -> str:
    """A path as Spark's readers take it literally, not as a glob."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def file_states(spark: SparkSession, places: Iterable[str], pattern: str | None = None) -> DataFrame:
    """path, length, modified of every file at or below ``places`` (hidden ones
    aside; with ``pattern``, those whose name matches this glob)."""
    places = [literal_path(p) for p in places]
    if not places:
        return spark.createDataFrame([], STATE)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return (reader.load(places).select("path", "length", F.col("modificationTime").alias("modified"))
            .withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).distinct())


def inputs_of(df: DataFrame) -> DataFrame:
    """path, length, modified of the files that ``df`` reads; none for in-memory rows."""
    spark = df.sparkSession
    files = sorted({plain_path(f) for f in df.inputFiles() if "/" in f})
    # whole folders are listed at once; only the files that are read count
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    own = spark.createDataFrame([(f,) for f in files], "path string")
    return file_states(spark, folders).join(own, "path", "left_semi")


def digest_of(states: DataFrame) -> str:
    """sha256 over the sorted (path, length, modified), by way of ``BUCKETS``
    digests of the files whose names hash alike; the same for any partitioning."""
    line = F.concat_ws("\t", "path", "length", F.unix_micros("modified"))
    parts = (states.select(F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("bucket"), line.alias("line"))
             .groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest")))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))),
                                                     lambda x: x["digest"]), "\n"), 256)).first()[0]


def inputs_digest(df: DataFrame) -> str:
    """Digest of the state of all files that ``df`` reads. Files are packed into
    few tasks whatever their size, as none of their bytes are read."""
    spark = df.sparkSession
    if not df.inputFiles():
        return "none"
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(1 << 60))
    try:
        return digest_of(inputs_of(df))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def inputs_identity(df: DataFrame) -> str:
    """What a result depends on besides its text: the analysed plan (in-memory
    rows by their content or instance) and the state of all files it reads."""
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    return "\n".join([plan, str(df.semanticHash()), inputs_digest(df)])


# --- folders that are written whole -------------------------------------------------------

def fs_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def entries(spark: SparkSession, folder: str) -> list[str]:
    """Complete entries below ``folder`` (their ``_SUCCESS`` marker is there), newest last."""
    fs, p = fs_path(spark, folder)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if fs.exists(marker):
            found.append((fs.getFileStatus(marker).getModificationTime(), f"{folder}/{status.getPath().getName()}"))
    return [path for _, path in sorted(found)]
