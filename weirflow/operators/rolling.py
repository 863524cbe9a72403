"""Moving medians whose cost does not grow with the frame: order statistics of ranges by bits of ranks.

All frames of a chunk are asked at once.  The chunk's values are replaced by their
ranks; for each bit of a rank, from the highest, a running count tells how many of a
frame's ranks have a 0 there, so each frame knows in which half its wanted value
is and where its ranks lie in that half.  Some 17 passes over arrays answer all
frames of 65,536 rows, whatever their width.
"""

from __future__ import annotations

import numpy as np


def order_statistics(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th least (from 0) of values[lo:hi] for each query; 0 <= k < hi - lo."""
    distinct, ranks = np.unique(values, return_inverse=True)
    lo, hi, k, found = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64), np.zeros(len(lo), np.int64)
    for bit in reversed(range(max(len(distinct) - 1, 0).bit_length())):
        ones = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        a, b = zeros[lo], zeros[hi]
        up = k >= b - a
        k = np.where(up, k - (b - a), k)
        lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
        found |= up.astype(np.int64) << bit
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return distinct[found] if len(distinct) else np.zeros(len(lo))


def moving_median(values: np.ndarray, there: np.ndarray, before: int, after: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(median of the values that are there from `before` rows back to `after` rows ahead, whether they are `least` or more)."""
    n = len(values)
    upto = np.concatenate([[0], np.cumsum(there)])
    at = np.arange(n)
    lo, hi = upto[np.maximum(at - before, 0)], upto[np.minimum(at + after + 1, n)]
    enough = hi - lo >= max(least, 1)
    own, lo, hi = values[there], lo[enough], hi[enough]
    count = hi - lo
    out = np.zeros(n)
    low = order_statistics(own, lo, hi, (count - 1) // 2)
    even = count % 2 == 0
    mid = low.copy()
    if even.any():
        mid[even] = 0.5 * low[even] + 0.5 * order_statistics(own, lo[even], hi[even], count[even] // 2)
    out[enough] = mid
    return out, enough
