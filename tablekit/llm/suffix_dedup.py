"""Suffix-array dedup of bytes: every byte covered by a string of ``length``
bytes that also starts earlier (in a document with a smaller ``doc_id``, or
before it in the same document) is removed.

Candidates and their shards come from ``repeats``. In a shard, the segments are
laid out in document order, each closed by a sign of its own, and an enhanced
suffix array (suffix order and common prefixes) is built. A stack scan of the
common prefixes yields the prefix intervals; those whose occurrences can be
extended to the left by different bytes are the maximal repeats, each with all
its occurrences. All but the earliest occurrence of a maximal repeat are removed
over its whole length.

Defined results: a null text counts as empty; a null ``doc_id`` is the smallest;
rows that repeat a ``doc_id`` are documents in the order of the input, the
earlier one first; texts of fewer than ``length`` bytes keep all. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .repeats import Rule, repeated
from .suffixes import common_prefixes, suffix_order

LENGTH, GRAM = 100, 32


def maximal_repeats(sa, lcp, left, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of ``sa`` whose suffixes share
    ``length`` >= ``least`` units and stand behind different units. ``left``: the
    unit in front of each text position. Stack scan, inner intervals first."""
    import numpy as np
    inside = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    for run, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
        before = left[sa[run - 1:stop]].tolist()
        depth = lcp[run:stop].tolist() + [0]
        stack: list[list] = []   # [length, first, unit in front or None if several]
        for k, d in enumerate(depth):
            first, front = k, before[k]
            while stack and stack[-1][0] > d:
                length, first, own = stack.pop()
                own = own if own == front else None
                if own is None:
                    yield length, run - 1 + first, run - 1 + k
                front = own
            if d < least:
                break
            if stack and stack[-1][0] == d:
                if stack[-1][2] != front:
                    stack[-1][2] = None
            else:
                stack.append([d, first, front])


def compare(pieces, docs, rows, firsts, counts, rule):
    """Kernel of a shard: (row, start, end) of the bytes that repeat."""
    import numpy as np
    order = np.lexsort((firsts, rows, docs))
    pieces = [pieces[i] for i in order]
    rows, firsts = rows[order], firsts[order]
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(starts[-1], np.int64)
    closing = starts[1:] - 1
    mask = np.ones(len(text), bool)
    mask[closing] = False
    text[mask] = np.frombuffer(b"".join(pieces), np.uint8)
    text[closing] = 256 + np.arange(len(pieces))
    left = np.concatenate([[-1], text[:-1]])   # in front of a segment: its neighbour's own sign
    sa, ranks = suffix_order(text, int(sizes.max(initial=1)))     # whole segments: repeats inside repeats count too
    lcp = common_prefixes(text, sa, ranks, rule.length)
    change = np.zeros(len(text) + 1, np.int64)
    for length, first, last in maximal_repeats(sa, lcp, left, rule.length):
        at = sa[first:last + 1]     # all different: no count is lost
        change[at] += 1
        change[at + length] -= 1
        earliest = at.min()
        change[earliest] -= 1
        change[earliest + length] += 1
    covered = np.diff(np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    piece = np.searchsorted(starts, begin, side="right") - 1
    offset = firsts[piece] - starts[piece]
    return rows[piece], begin + offset, end + offset


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_units (bytes), spans (start, end of removed bytes), kept (binary)."""
    return repeated(docs, Rule(words=False, length=length, gram=gram, within=True), compare)
