"""Suffix order to a bounded depth, by prefix doubling in numpy."""

from __future__ import annotations


def suffix_order(values, depth: int):
    """(sa, ranks): positions sorted by their next ``depth`` or more values (the
    end counts as less than any value; ties in any order), and (d, rank by the
    next d values) for growing d. ``values``: non-negative integers."""
    import numpy as np
    n = len(values)
    bits = int(values.max(initial=0) + 1).bit_length()
    d = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([values.astype(np.int64) + 1, np.zeros(d, np.int64)])
    for k in range(d):
        key = key << bits | padded[k:k + n]
    ranks = []
    while True:
        order = np.argsort(key)
        at = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]).astype(np.int64)]))[:n]
        ranks.append((d, rank))
        if d >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order, ranks
        key = rank * (n + 1)
        key[:max(0, n - d)] += rank[d:] + 1
        d *= 2


def common_prefixes(values, sa, ranks, least: int = 0):
    """Length of the common prefix of each suffix with its predecessor in ``sa``
    (first: 0), exact up to the depth of the last ranks; a length below ``least``
    may be given as 0."""
    import numpy as np
    n = len(sa)
    out = np.zeros(n, np.int64)
    near = [rank for d, rank in ranks if d <= least][-1:]
    at = np.arange(1, n)
    if near:
        at = at[near[0][sa[1:]] == near[0][sa[:-1]]]
    a, b = sa[at - 1], sa[at]
    length = np.zeros(len(at), np.int64)

    def advance(rank, d: int):
        padded = np.append(rank, -1)
        same = (np.maximum(a, b) < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        for x in (a, b, length):
            x[same] += d
        return same.any()

    for d, rank in reversed(ranks):
        # of one depth more than once only where no deeper ranks were made
        while advance(rank, d) and d == ranks[0][0] == ranks[-1][0]:
            pass
    for _ in range(ranks[0][0] if ranks else 0):
        advance(values.astype(np.int64), 1)
    out[at] = length
    return out
