"""Packing of tokenised documents into training windows by best-fit decreasing.

Every document is tokenised once, inside its map task. Overlong documents are
cut into full windows, each a sequence of its own; what remains of each document
(less than a window) is packed: documents are dealt at random into buckets of
about ``bucket_rows``, and in each bucket the remainders, longest first, go to
the open window with the least room that still fits. A segment tree indexed by
remaining capacity finds that window in log2(window) steps. Only piece lengths
and checksums are shuffled, never texts or ids.

Defined results: a null or empty text is the end token alone; a document with a
multiple of ``window`` ids has no remainder; equal documents are packed each on
its own; ``sequence_id`` is bucket * 2^32 + the window's number there. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, text_batches, text_of, text_sizes
from .units import ByteBpe, per_process

WINDOW, END, BUCKET_ROWS, SLICE_BYTES = 1024, 0, 4096, 1 << 20


def token_runs(docs: DataFrame, path: str, ranks: str | None, pattern: str | None,
               window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, doc_tokens, crcs: the checksum of each run of ``window`` ids (the
    last one may be shorter), the end token included."""
    import struct
    stop = struct.pack("<I", end)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        bpe = per_process(ByteBpe, path, ranks, pattern)
        step = 4 * window
        for part in slices(batches, text_sizes, SLICE_BYTES):
            sizes, crcs = [], []
            for ids in bpe.encode(part.column("text").to_pylist()):
                ids += stop
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i:i + step]) for i in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                ["doc_id", "doc_tokens", "crcs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(
        encode, f"doc_id {kind}, doc_tokens bigint, crcs array<bigint>")


class Capacity:
    """Open windows by the room they have left: a segment tree over 0..size
    whose nodes count windows; ``tightest(n)`` takes one with the least room >= n."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(room, window), taken out; None if no open window has ``need``."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            # up to the first right sibling that has a window, then down its left side
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths, window: int) -> tuple[list[tuple[int, int]], int]:
    """For lengths in falling order: (window number, offset) of each; windows used."""
    tree, placed, used = Capacity(window), [], 0
    for n in lengths:
        found = tree.tightest(n)
        if found is None:
            room, at = window, used
            used += 1
        else:
            room, at = found
        placed.append((at, window - room))
        if room > n:
            tree.put(room - n, at)
    return placed, used


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None,
         window: int = WINDOW, end: int = END, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    runs = saved(token_runs(docs, path, ranks, pattern, window, end)
                 .withColumn("row", F.monotonically_increasing_id()))
    buckets = max(1, -(-runs.count() // bucket_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fill(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.assign(rest=pdf.doc_tokens % window).sort_values(
            ["rest", "row"], ascending=[False, True], kind="stable")
        placed, used = best_fit(pdf.rest[pdf.rest > 0].tolist(), window)
        base = int(pdf.bucket.iloc[0]) << 32
        pieces = [len(c) for c in pdf.crcs]
        out = pdf[["doc_id", "doc_tokens"]].loc[pdf.index.repeat(pieces)].reset_index(drop=True)
        nth = np.concatenate([np.arange(n) for n in pieces])
        out["start"] = nth * window
        out["length"] = np.minimum(window, out.doc_tokens.to_numpy() - out.start.to_numpy())
        out["ids_crc32"] = np.concatenate([np.asarray(c, dtype=np.int64) for c in pdf.crcs])
        out["sequence_id"], out["offset"] = 0, 0
        short = (out.length < window).to_numpy()
        at = np.array(placed, dtype=np.int64).reshape(-1, 2)   # remainders stand in the same order
        out.loc[short, "sequence_id"], out.loc[short, "offset"] = base + at[:, 0], at[:, 1]
        out.loc[~short, "sequence_id"] = base + used + np.arange(int((~short).sum()))
        return pd.DataFrame(out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]])

    return (runs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(
                fill, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                      "sequence_id bigint, offset bigint"))
