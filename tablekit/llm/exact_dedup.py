"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's frequent-items sketch, of fixed size) proposes
the digests that may hold a large share of the rows. An exact count verifies
them; the winners, at most ``heavy`` rows, are broadcast, and their copies are
resolved inside each map task. All other digests are rarer than one row in
``heavy`` and take an ordinary shuffle.

Defined results: a null text counts as an empty text; a null ``doc_id`` is the
smallest; of equal texts the row with the largest ``doc_id`` stays, and of rows
that repeat both text and ``doc_id`` exactly one stays. An empty table gives an
empty result. Other columns of the input are never read by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, saved, text_of

#: Fixed bound of the broadcast side (rows), and the sketch's counters.
HEAVY, COUNTERS = 1024, 8192


def heavy_values(rows: DataFrame, column: str, heavy: int = HEAVY, counters: int = COUNTERS) -> list:
    """At most ``heavy`` values, among them each that holds more than one row
    in ``heavy`` (candidates: every value whose estimate reaches that)."""
    sketch = rows.agg(F.count("*").alias("n"),
                      F.expr(f"approx_top_k(`{column}`, {heavy}, {counters})").alias("top")).first()
    return [x["item"] for x in sketch["top"] or [] if x["count"] * heavy >= sketch["n"] and x["count"] > 1]


def duplicate_groups(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = saved(docs.select(docs["doc_id"], F.sha2(text_of(docs), 256).alias("text_sha256"),
                             F.monotonically_increasing_id().alias("row")))
    last = [F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size")]
    found = heavy_values(rows, "text_sha256", heavy)
    # verified: the exact size of each candidate's group; at most `heavy` rows
    winners = F.broadcast(rows.filter(F.col("text_sha256").isin(found)).groupBy("text_sha256").agg(*last))
    hot = rows.join(winners, "text_sha256")
    rest = rows.filter(~F.col("text_sha256").isin(found))
    rest = rest.join(rest.groupBy("text_sha256").agg(*last), "text_sha256")
    return hot.unionByName(rest).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("last.row") == F.col("row")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    digest, rank = fresh(docs, "digest"), fresh(docs, "rank")
    rows = docs.withColumn(digest, F.sha2(text_of(docs), 256))
    found = heavy_values(rows, digest, heavy)
    keep, at = fresh(docs, "keep_id"), fresh(docs, "at")
    winners = F.broadcast(rows.filter(F.col(digest).isin(found)).groupBy(F.col(digest).alias(at))
                          .agg(F.max("doc_id").alias(keep)))
    # copies of a heavy text go inside the map task; its keeper joins the rest
    left = rows.join(winners, rows[digest] == winners[at], "left").filter(
        F.col(at).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))).drop(at, keep)
    order = W.partitionBy(digest).orderBy(F.col("doc_id").desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(*docs.columns)
