"""Substring dedup of words with a compressed FM-index per shard: every word
covered by a window of ``length`` words that also starts in a document with a
smaller ``doc_id`` is removed.

Candidates and their shards come from ``repeats``. In a shard, the different
segments are indexed once: the Burrows-Wheeler transform of their word numbers in
a wavelet matrix (packed bits with block counts). The documents' segments are
then streamed against it by backward search, all in step, which keeps for every
start the length of the match (at most ``length``) and its suffix interval;
where the length reaches the threshold, the least ``doc_id`` of the interval
tells whether the window stands in an earlier document.

Defined results: a null text has no words; a null ``doc_id`` is the smallest;
rows that repeat a ``doc_id`` are not earlier than each other; texts of fewer
than ``length`` words keep all. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Rule, repeated
from .suffixes import suffix_order

LENGTH, GRAM = 50, 8


class Bits:
    """A bit vector with rank: packed words and the count before each word."""

    def __init__(self, bits):
        import numpy as np
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, i):
        """Ones in front of each place ``i``."""
        import numpy as np
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Backward search over a sequence of numbers >= 1 that ends with one that no
    pattern has, for patterns of fewer than ``depth`` numbers or as many."""

    def __init__(self, values, depth: int):
        import numpy as np
        self.sa, self.ranks = suffix_order(values, depth)
        last = values[self.sa - 1]
        self.levels, self.zeros = [], []
        for bit in range(int(values.max(initial=1)).bit_length() - 1, -1, -1):
            ones = (last >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(int((~ones).sum()))
            last = np.concatenate([last[~ones], last[ones]])
        counts = np.bincount(values, minlength=int(values.max(initial=0)) + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def extend(self, lo, hi, symbol):
        """Suffix intervals of ``symbol`` in front of the patterns of [lo, hi)."""
        import numpy as np
        base = np.zeros_like(lo)
        for (bit, ones), zeros in zip(self.levels, self.zeros):
            up = (symbol >> bit & 1).astype(bool)
            base, lo, hi = (np.where(up, zeros + r, x - r) for x, r in ((x, ones.rank(x)) for x in (base, lo, hi)))
        start = self.first[symbol]
        return start + lo - base, start + hi - base

    def same_prefix(self, length: int):
        """For each place of the suffix order, whether its suffix begins with
        other ``length`` numbers than the one before."""
        import numpy as np
        n, at = len(self.sa), self.sa.copy()
        new = np.zeros(n, bool)
        left = length
        for d, rank in reversed(self.ranks):
            padded = np.append(rank, -1)
            while left >= d:
                r = padded[np.minimum(at, n)]
                new[1:] |= r[1:] != r[:-1]
                at, left = at + d, left - d
        if left:   # fewer than the shortest rank: that rank once more, ending there
            d, rank = self.ranks[0]
            r = np.append(rank, -1)[np.minimum(at - (d - left), n)]
            new[1:] |= r[1:] != r[:-1]
        new[:1] = True
        return new


def intervals(new):
    """Start and end of the interval of each place, from its first places."""
    import numpy as np
    at = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    return at[number], np.append(at[1:], len(new))[number]


def matches(index: FMIndex, queries, sizes, length: int):
    """Streams ``queries`` (numbers in a row; ``sizes``: of each query), all of
    them parts of the index: yields (query numbers, starts, lo) of the starts
    whose match is ``length`` long, lo being the first place of its interval."""
    import numpy as np
    order = np.argsort(-sizes, kind="stable")
    end = np.cumsum(sizes)[order]
    size = sizes[order]
    lo, hi = np.zeros(len(size), np.int64), np.full(len(size), len(index.sa), np.int64)
    matched = np.zeros(len(size), np.int64)
    short_lo, short_hi = intervals(index.same_prefix(length - 1))
    for step in range(1, int(size.max(initial=0)) + 1):
        n = int((size >= step).sum())
        lo[:n], hi[:n] = index.extend(lo[:n], hi[:n], queries[end[:n] - step])
        matched[:n] += 1
        full = np.flatnonzero(matched[:n] == length)
        if len(full):
            yield order[full], size[full] - step, lo[full]
            # forget the last word: the interval of the first length - 1 words
            lo[full], hi[full] = short_lo[lo[full]], short_hi[hi[full] - 1]
            matched[full] = length - 1


def compare(pieces, docs, rows, firsts, counts, rule):
    """Kernel of a shard: (row, start, end) of the words that repeat."""
    import numpy as np
    # words joined by one space: segments that differ in white space only are one
    split = [tuple(p.split()) for p in pieces]
    kinds: dict = {}
    kind = np.array([kinds.setdefault(s, len(kinds)) for s in split])
    number: dict = {}
    sequence = [2 + number.setdefault(w, len(number)) for s in kinds for w in s]
    sizes = np.array([len(s) for s in kinds])
    queries = np.array(sequence, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    values = np.ones(starts[-1], np.int64)      # 1 closes each segment
    mask = np.ones(len(values), bool)
    mask[starts[1:] - 1] = False
    values[mask] = queries
    # of one kind all segments here have one document number, or keep the least
    owner = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(owner, kind, docs)
    index = FMIndex(values, rule.length)
    position_owner = np.repeat(owner, sizes + 1)
    new = index.same_prefix(rule.length)
    least = np.minimum.reduceat(position_owner[index.sa], np.flatnonzero(new))[np.cumsum(new) - 1]
    early: list = [np.zeros((0, 3), np.int64)]
    for query, start, lo in matches(index, queries, sizes, rule.length):
        early.append(np.stack([query, start, least[lo]], axis=1))
    early_ = np.concatenate(early)
    early_ = early_[np.lexsort((early_[:, 1], early_[:, 0]))]
    bounds = np.searchsorted(early_[:, 0], np.arange(len(kinds) + 1))
    out = []
    for k, doc, row, first in zip(kind.tolist(), docs.tolist(), rows.tolist(), firsts.tolist()):
        part = early_[bounds[k]:bounds[k + 1]]
        at = part[part[:, 2] < doc, 1]
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            out += [(row, first + int(x[0]), first + int(x[-1]) + rule.length) for x in np.split(at, cut)]
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_units (words), spans (start, end of removed words), kept (binary,
    UTF-8: the words that stay, joined by one space)."""
    return repeated(docs, Rule(words=True, length=length, gram=gram, within=False), compare)
