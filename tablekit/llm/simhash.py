"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits are linked at ``MOST`` = 3 or fewer differing bits. Cut
into two halves of 32 bits, a linked pair differs in at most one bit of one of
them. In that half, 31 bits are compared through the codewords of the Hamming
code [31, 26] as anchors: every point lies within covering radius 1 of exactly
one anchor (its home), so of two points one bit apart the second lies within
radius 1 + 1 of the first one's home. Each fingerprint is therefore sent to its
home and to all anchors within distance 2 (at most 16 of 2^26 per half), and
homes are compared with all members of their anchor: no link is lost.

Only different fingerprints are sent, copies being grouped before. Per anchor
the task emits a spanning forest of the links it found, not all pairs;
components follow by star contraction.

Defined results: a null text counts as empty; texts without words have
fingerprint zero and are linked like any other; a null ``doc_id`` never becomes
a ``component_id`` unless all of the component's are null; rows that repeat a
``doc_id`` are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, text_batches, text_of
from .components import stars
from .exact_dedup import heavy_values

SHINGLE, MOST, SEED = 3, 3, 42


def simhash_of(text: Column, words: int = SHINGLE, seed: int = SEED) -> Column:
    """64-bit SimHash (signed long) of a text column without nulls."""
    def fingerprint(texts):
        import numpy as np
        import pandas as pd
        import xxhash
        digest = xxhash.xxh64_intdigest

        def one(text: str) -> int:
            split = text.encode().lower().split()   # bytes: A-Z only, ASCII white space
            if not split:
                return 0
            joined = b" ".join(split)
            at = np.cumsum([0] + [len(w) + 1 for w in split])
            size = min(words, len(split))
            spans = zip(at[:len(split) - size + 1].tolist(), (at[size:] - 1).tolist())
            ones, n = np.zeros(64, np.int64), len(split) - size + 1
            hashes = np.fromiter((digest(joined[i:j], seed) for i, j in spans), np.uint64, n)
            for k in range(0, n, 1 << 16):
                bits = np.unpackbits(hashes[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.uint32)
            return int(np.packbits(2 * ones > n).view(">i8")[0])

        return pd.Series([one(t) for t in texts], dtype="int64")

    return F.pandas_udf(fingerprint, "bigint")(text)


def anchored(points: DataFrame) -> DataFrame:
    """(anchor, home, point): each point (column ``point``, bigint) at its home
    anchor and at all anchors within distance 2, for both halves."""
    def cover(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        position = np.arange(1, 32, dtype=np.uint64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for half in (0, 1):
                x = (v >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
                syndrome = np.zeros(len(x), np.uint64)
                for p in position:   # bit p-1 stands at position p of the Hamming code
                    syndrome ^= p * ((x >> (p - np.uint64(1))) & np.uint64(1))
                flip = lambda s: np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))
                home = x ^ flip(syndrome)
                rows = [(home, v, True)]
                for p in position:   # two flipped bits p and p ^ syndrome lead to a codeword
                    q = p ^ syndrome
                    some = (syndrome > 0) & (q > p)
                    rows.append((x[some] ^ flip(np.full(int(some.sum()), p)) ^ flip(q[some]), v[some], False))
                key = np.concatenate([r[0] for r in rows]) | np.uint64(half << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)),
                     pa.array(np.concatenate([np.full(len(r[0]), r[2]) for r in rows])),
                     pa.array(np.concatenate([r[1] for r in rows]).view(np.int64))], ["anchor", "home", "point"])

    return points.select("point").mapInArrow(cover, "anchor bigint, home boolean, point bigint")


def links_per_anchor(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): for each anchor, a spanning forest of its links (points at ``most``
    or fewer differing bits, at least one of them at home there)."""
    def forest(home, points):
        """Links that join the trees found so far, home by home."""
        import numpy as np
        tree, out = np.arange(len(points)), []
        for h in np.flatnonzero(home):
            near = np.flatnonzero(np.bitwise_count(points ^ points[h]) <= most)
            roots, first = np.unique(tree[near], return_index=True)
            if len(roots) > 1:
                out += [(h, near[k]) for k, r in zip(first, roots) if r != tree[h]]
                tree[np.isin(tree, roots)] = tree[h]
        return out

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64)]
        last = False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                held = [np.concatenate([a, b]) for a, b in zip(held, (new[0], new[1], new[2].astype(np.int64).view(np.uint64)))]
            anchor, home, point = held
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            bounds = np.concatenate([[0], cuts, [len(anchor)] if last else []]).astype(np.int64)
            if len(bounds) < 2:
                continue
            homes = np.concatenate([[0], np.cumsum(home)])
            some = (np.diff(bounds) > 1) & (np.diff(homes[bounds]) > 0)
            found = []
            for i, j in zip(bounds[:-1][some], bounds[1:][some]):
                found += [(point[i + a], point[i + b]) for a, b in forest(home[i:j], point[i:j])]
            held = [x[bounds[-1]:] for x in held]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return (rows.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(compare, "a bigint, b bigint"))


def components_of(points: DataFrame) -> DataFrame:
    """``points``: distinct ``point`` with the least id ``first``. Returns point,
    root (one point of its component) and component_id (the least id there)."""
    edges = stars(links_per_anchor(anchored(points)))
    member = edges.select(F.col("a").alias("point"), F.col("b").alias("root"))
    member = saved(member.unionByName(member.select(F.col("root").alias("point"), "root").distinct()))
    least = points.join(member, "point").groupBy("root").agg(F.min("first").alias("least"))
    return points.join(member.join(least, "root"), "point", "left").select(
        "point", F.coalesce("root", "point").alias("root"), F.coalesce("least", "first").alias("component_id"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``."""
    rows = saved(text_batches(docs).select("doc_id", simhash_of(text_of(docs)).alias("point")))
    points = rows.groupBy("point").agg(F.min("doc_id").alias("first"))
    # rows of a frequent fingerprint meet its component inside their map task (at
    # most HEAVY points are broadcast), all others by a shuffle
    found, heavy = saved(components_of(points)), heavy_values(rows, "point")
    hot = rows.join(F.broadcast(found.filter(F.col("point").isin(heavy))), "point")
    rest = rows.filter(~F.col("point").isin(heavy)).join(found, "point")
    return hot.unionByName(rest).select(
        "doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component
    the row with the smallest ``doc_id`` (of rows that repeat it, the first)."""
    row = fresh(docs, "row")
    rows = text_batches(docs).withColumn(row, F.monotonically_increasing_id())
    # decided on (row, doc_id, point); the texts move once, with the rows that stay
    points = saved(rows.select(F.col(row).alias("row"), "doc_id", simhash_of(text_of(docs)).alias("point")))
    # per fingerprint first, so that a frequent one is one row (a null doc_id only if there is no other)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    points = saved(points.groupBy("point").agg(best.alias("best")))
    found = components_of(points.select("point", F.col("best.doc_id").alias("first")))
    kept = points.join(found, "point").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
