"""Stored column profiles that follow their files.

A store keeps sketches per column and file group, and the files of each group.
``refresh`` compares them with the files that are there now: added files are read
and form new groups; a group with a file that was replaced or is gone is sketched
anew from what is left of it; all others are kept. The profile is the merge of
the live groups' sketches.

Layout below the root: ``files/<id>`` (path, length, modified, part) is a complete
list once its marker is written, the newest one counts; ``sketches/<id>`` holds
the rows of the groups made by one refresh. Nothing is changed in place, so a lost
refresh leaves the last one as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketches import SKETCHES, column_sketches, estimates, merge_sketches
from .files import STATE, entries, file_states, literal_path, read_path

#: Bytes of a file group, about.
GROUP_BYTES = 32 << 30


@dataclass
class Refreshed:
    """What a refresh did: files read, files whose sketches were kept, live groups."""
    read: int
    kept: int
    groups: int


class ProfileStore:
    def __init__(self, spark: SparkSession, source: str, root: str, columns: list[str] | None = None,
                 file_format: str = "parquet", group_bytes: int = GROUP_BYTES):
        """Profiles of the files at or below ``source``, kept under ``root``."""
        self.spark, self.source, self.root = spark, source, root.rstrip("/")
        self.columns, self.file_format, self.group_bytes = columns, file_format, group_bytes

    def _files(self) -> DataFrame:
        newest = entries(self.spark, f"{self.root}/files")
        return self.spark.read.parquet(newest[-1]) if newest else self.spark.createDataFrame([], f"{STATE}, part string")

    def refresh(self) -> Refreshed:
        name = uuid.uuid4().hex
        now, old = file_states(self.spark, [self.source]).persist(), self._files()
        state = ["path", "length", "modified"]
        try:
            broken = old.join(now, state, "left_anti").select("part").distinct()
            kept = old.join(broken, "part", "left_anti").select(*state, "part")
            todo = now.join(kept, state, "left_anti").persist()
            try:
                n, size = todo.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
                if n or broken.head():
                    groups = max(1, -(-size // self.group_bytes))
                    group = lambda file: F.concat(F.lit(f"{name}-"), F.pmod(F.xxhash64(file), F.lit(groups)).cast("string"))
                    if n:
                        # the names go to Spark's reader, which lists them in any case
                        paths = [literal_path(r["path"]) for r in todo.select("path").collect()]
                        rows = self.spark.read.format(self.file_format).option("basePath", self.source).load(paths)
                        column_sketches(rows, self.columns, group(read_path())).write.parquet(f"{self.root}/sketches/{name}")
                    new = todo.withColumn("part", group(F.col("path")))
                    kept.unionByName(new).write.parquet(f"{self.root}/files/{name}")
            finally:
                todo.unpersist()
        finally:
            now.unpersist()
        live = self._files().agg(F.count("*"), F.count_distinct("part")).first()
        return Refreshed(n, live[0] - n, live[1])

    def sketches(self) -> DataFrame:
        """The live groups' rows."""
        made = entries(self.spark, f"{self.root}/sketches")
        if not made:
            return self.spark.createDataFrame([], SKETCHES)
        return self.spark.read.parquet(*made).join(self._files().select("part").distinct(), "part", "left_semi")

    def profile(self) -> DataFrame:
        """The profile table of all files as of the last refresh."""
        return estimates(merge_sketches(self.sketches()))
