"""Repeated passages: the part that substring dedup (words) and suffix-array
dedup (bytes) share.

A window is ``length`` consecutive units of one document. Each window is
assigned to its anchor, the run of ``gram`` units in it with the least hash (the
leftmost of equals), so equal windows have equal anchors at equal places. The
windows of one anchor that stand in a row form a segment. Then

1. segments with equal content are one type. In each map slice, then by a window
   function over (anchor, content), all but the first occurrence of a type are
   known to be repeats, without their text;
2. only anchors with several types need their texts compared: the first
   occurrence of each type sends its text to the shard of its anchor, where the
   operator's own index (FM-index, suffix array) finds the windows that occur
   earlier;
3. both results meet the document again by its row number.

Anchors that hold a large share of all segments (Misra-Gries summary of fixed
size over all anchors) are split: each of their windows becomes a segment of its
own, anchored by its content, so no group grows with a hot passage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, slices, text_batches

SLICE_BYTES, SHARD_UNITS, HEAVY, COUNTERS = 2 << 20, 1 << 20, 1000, 8192
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Multipliers of the rolling hashes (odd constants of splitmix64 and xxHash64).
MIX1, MIX2, BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B185EBCA87


@dataclass(frozen=True)
class Rule:
    """``words``: units are words, else bytes. ``length`` units make a window,
    ``gram`` (a power of two) an anchor. ``within``: an earlier start in the same
    document counts as a repeat."""
    words: bool
    length: int
    gram: int
    within: bool


def mixed(x):
    import numpy as np
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX2)
    return x ^ x >> np.uint64(31)


class Spans:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values):
        import numpy as np
        n = len(values)
        self.inverse = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        power = np.full(n, BASE, np.uint64)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power, out=self.sums[1:])

    def of(self, start, end):
        import numpy as np
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(MIX2))


def word_bounds(data):
    """First byte and the byte behind the last of each word of a byte array."""
    import numpy as np
    blank = np.zeros(256, bool)
    blank[list(SPACE)] = True
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~blank[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def units(part, words: bool):
    """Of a batch's ``text`` (binary): the unit values in a row (64-bit), first
    unit of each row and, at last, the end; with words also their bytes' bounds."""
    import numpy as np
    import pyarrow as pa
    column = part.column("text")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    if not words:
        return raw, table[raw], offsets, None, None
    # a blank between documents keeps words apart
    data = np.full(len(raw) + len(part), 0x20, np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(len(part)), np.diff(offsets))] = raw
    begin, end = word_bounds(data)
    values = Spans(table[data]).of(begin, end)
    starts = np.searchsorted(begin, offsets + np.arange(len(part) + 1))
    return data, values, starts, begin, end


def anchors(values, rule: Rule):
    """For each start of ``length`` units: place and hash of its anchor. Hashes
    are compared by their upper 40 bits, the leftmost of equals wins."""
    import numpy as np
    places, hashes, total = [], [], len(values) - rule.length + 1
    for start in range(0, total, 1 << 22):   # the lower 24 bits hold the place
        stop = min(total, start + (1 << 22))
        part = values[start:stop + rule.length - 1]
        h, size, factor = part, 1, BASE
        while size < rule.gram:     # polynomial hash of twice as many units
            h = h[:len(h) - size] * np.uint64(factor) + h[size:]
            size, factor = 2 * size, factor * factor % (1 << 64)
        h = mixed(h)
        low = np.uint64((1 << 24) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, width = rule.length - rule.gram + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:stop - start], least[span - width:span - width + stop - start])
        place = (least & low).astype(np.int64)
        places.append(place + start)
        hashes.append(h[place])
    return np.concatenate(places), np.concatenate(hashes)


def segments(values, starts, rule: Rule, hot):
    """anchor, content hash, document number, first window, number of windows."""
    import numpy as np
    length, none = rule.length, np.zeros(0, np.int64)
    if len(values) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    place, anchor = anchors(values, rule)
    first = np.arange(len(place))
    doc = np.searchsorted(starts, first, side="right") - 1
    keep = first + length <= starts[doc + 1]
    first, doc, place, anchor = first[keep], doc[keep], place[keep], anchor[keep]
    same = place[1:] == place[:-1]
    new = np.ones(len(first), bool)
    new[1:] = ~(same & (first[1:] == first[:-1] + 1))
    if len(hot):
        new |= np.isin(anchor, hot)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first)))
    begin, owner, anchor = first[at], doc[at], anchor[at]
    content = Spans(values).of(begin, begin + count - 1 + length)
    if len(hot):
        split = np.isin(anchor, hot)
        anchor = np.where(split, mixed(content), anchor)
    return anchor, content, owner, begin - starts[owner], count


def _anchor_rows(base: DataFrame, rule: Rule, hot: list[int]) -> DataFrame:
    """One row per segment: anchor, content, doc, row, at (first window << 32 |
    windows), more (the same of its repeats in that document, if they are judged
    alike), done. Within a slice all but the first occurrence of a content are
    done; windows of one document in a row are then one row with an anchor of
    its own."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        hot_set = np.array(hot, np.int64).view(np.uint64)
        for part in slices(batches, lambda b: pc.binary_length(b.column("text")).to_pylist(), SLICE_BYTES):
            _, values, starts, _, _ = units(part, rule.words)
            anchor, content, owner, begin, count = segments(values, starts, rule, hot_set)
            doc = part.column("doc").to_numpy(zero_copy_only=False)
            row = part.column("row").to_numpy(zero_copy_only=False)
            d, r = doc[owner], row[owner]
            order = np.lexsort((begin, r, d, content, anchor))
            a, c, d, r, b, k = (x[order] for x in (anchor, content, d, r, begin, count))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            if rule.within:
                done = ~new
            else:
                lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
                done = d > d[lead] if len(a) else new
            x = ~done
            live = [a[x], c[x], d[x], r[x], b[x], k[x]]
            # a document's own repeats of a content share its fate: one row for all
            lead = np.ones(int(x.sum()), bool)
            if not rule.within:
                lead[1:] = functools.reduce(np.logical_or, [y[1:] != y[:-1] for y in live[:4]])
            more = (live[4] << 32 | live[5])[~lead]
            repeats = np.diff(np.append(np.flatnonzero(lead), len(lead))) - 1
            live = [y[lead] for y in live]
            order = np.lexsort((b[done], r[done]))
            d, r, b, k = (y[done][order] for y in (d, r, b, k))
            join = np.zeros(len(r), bool)
            join[1:] = (r[1:] == r[:-1]) & (b[1:] == b[:-1] + k[:-1])
            at = np.flatnonzero(~join)
            total = np.add.reduceat(k, at) if len(at) else k
            tag = mixed(r[at].astype(np.uint64) * np.uint64(BASE) + b[at].astype(np.uint64))
            out = [np.concatenate(p) for p in zip(live, (tag, tag, d[at], r[at], b[at], total))]
            ends = np.concatenate([[0], np.cumsum(repeats), np.full(len(at), len(more))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)), pa.array(out[2]), pa.array(out[3]),
                 pa.array(out[4] << 32 | out[5]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(more, pa.int64())),
                 pa.array(np.arange(len(out[0])) >= len(live[0]))],
                ["anchor", "content", "doc", "row", "at", "more", "done"])

    return base.mapInArrow(run, "anchor bigint, content bigint, doc bigint, row bigint, at bigint, more array<bigint>, done boolean")


def _hot_anchors(base: DataFrame, rule: Rule) -> list[int]:
    found = _anchor_rows(base, rule, []).filter("NOT done").agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(anchor, {HEAVY}, {COUNTERS})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] * 2 * HEAVY >= found["n"] and x["count"] >= 100]


def repeated(docs: DataFrame, rule: Rule, kernel: Callable) -> DataFrame:
    """doc_id, n_units, spans (start, end: maximal runs of units that repeat) and
    kept (binary: what is left; words joined by a space) of each row of ``docs``.

    ``kernel(pieces, docs, rows, firsts, counts, rule)`` gets one shard: the bytes
    of each segment, its document, row, first window and number of windows;
    it returns arrays (row, start, end) of the units that repeat.
    """
    lowest = -(1 << 63)
    base = text_batches(docs).select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(lowest).cast("bigint")).alias("doc"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    rows = _anchor_rows(base, rule, _hot_anchors(base, rule)).repartition("anchor")
    type_ = W.partitionBy("anchor", "content")
    if rule.within:
        gone = F.row_number().over(type_.orderBy("doc", "row", "at")) > 1
    else:
        gone = F.col("doc") > F.min("doc").over(type_)
    rows = rows.withColumn("gone", gone | F.col("done"))
    all_ = W.partitionBy("anchor")
    rows = rows.withColumn("several", F.min("content").over(all_) != F.max("content").over(all_))
    found = saved(rows.filter("gone OR several").groupBy("row").agg(
        F.flatten(F.collect_list(F.when(F.col("gone"), F.concat(F.array("at"), "more")))).alias("gone"),
        F.collect_list(F.when(~F.col("gone"), F.struct("anchor", F.concat(F.array("at"), "more").alias("at")))).alias("open")))
    units_ = f"(x.at[0] & 4294967295) + {rule.length}"
    total = found.select(F.expr(f"sum(aggregate(open, 0L, (s, x) -> s + size(x.at) * ({units_})))")).first()[0]
    shards = max(1, -(-(total or 0) // SHARD_UNITS))
    length, words = rule.length, rule.words

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for part in slices(batches, lambda b: [len(x) for x in b.column("text").to_pylist()], SLICE_BYTES):
            data, _, starts, begin, end = units(part, words)
            anchors, docs_, rows_, ats, pieces = [], [], [], [], []
            raw = data.tobytes()
            doc, row = part.column("doc").to_pylist(), part.column("row").to_pylist()
            for i, found_ in enumerate(part.column("open").to_pylist()):
                for anchor, at in ((x["anchor"], at) for x in found_ for at in x["at"]):
                    first = int(starts[i]) + (at >> 32)
                    last = first + (at & 0xFFFFFFFF) - 1 + length
                    anchors.append(anchor)
                    docs_.append(doc[i])
                    rows_.append(row[i])
                    ats.append(at)
                    pieces.append(raw[begin[first]:end[last - 1]] if words else raw[first:last])
            anchors = np.array(anchors, np.int64)
            shard = (mixed(anchors.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(docs_, pa.int64()), pa.array(rows_, pa.int64()), pa.array(ats, pa.int64()),
                 pa.array(pieces, pa.binary())], ["shard", "doc", "row", "at", "piece"])

    def compare(table):
        import numpy as np
        import pyarrow as pa
        at = table.column("at").to_numpy()
        row, start, end = kernel(table.column("piece").to_pylist(), table.column("doc").to_numpy(),
                                 table.column("row").to_numpy(), at >> 32, at & 0xFFFFFFFF, rule)
        return pa.table({"row": np.asarray(row, np.int64), "start": np.asarray(start, np.int64), "end": np.asarray(end, np.int64)})

    def finish(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for part in slices(batches, lambda b: [len(x) for x in b.column("text").to_pylist()], SLICE_BYTES):
            data, values, starts, begin, end = units(part, words)
            out, kept, spans = np.diff(starts), [], []
            raw = data.tobytes()
            for i, (gone_, more) in enumerate(zip(part.column("gone").to_pylist(), part.column("covers").to_pylist())):
                found_ = sorted([(x >> 32, (x >> 32) + (x & 0xFFFFFFFF) - 1 + length) for x in gone_ or []]
                                + [(x["start"], x["end"]) for x in more or []])
                merged = []
                for a, b in found_:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in merged])
                ends = [0, *(x for s in merged for x in s), int(out[i])]
                s = int(starts[i])
                keep = [(s + a, s + b) for a, b in zip(ends[::2], ends[1::2]) if b > a]
                if words:
                    kept.append(b" ".join(b" ".join(raw[begin[a]:end[b - 1]].split()) for a, b in keep))
                else:
                    kept.append(b"".join(raw[a:b] for a, b in keep))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(out, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["doc", "n_units", "spans", "kept"])

    covers = (base.join(found.filter(F.size("open") > 0), "row").select("doc", "text", "row", "open")
              .mapInArrow(cut, "shard bigint, doc bigint, row bigint, at bigint, piece binary")
              .groupBy("shard").applyInArrow(compare, "row bigint, start bigint, end bigint")
              .groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("covers")))
    return (base.join(found.select("row", "gone"), "row", "left").join(covers, "row", "left")
            .select("doc", "text", "gone", "covers")
            .mapInArrow(finish, "doc bigint, n_units bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
            .select(F.nullif("doc", F.lit(lowest).cast("bigint")).alias("doc_id"), "n_units", "spans", "kept"))
