"""Each row of one list with each of another, for many pairs of lists at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows of a piece, or one product more.
BATCH = 100_000


def of(n: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of lists of n[k] and m[k] rows: k, the place in the first and in the second, piece by piece; the first changes last."""
    each = n * m
    upto = np.cumsum(each)
    if not len(each):
        return
    parts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(BATCH, upto[-1], BATCH)), len(each)])
    for lo, hi in zip(parts[:-1], parts[1:], strict=True):
        k = np.repeat(np.arange(lo, hi), each[lo:hi])
        if len(k) == hi - lo == each[lo:hi].max(initial=0) * (hi - lo):  # lists of one row alone
            yield k, np.zeros(len(k), int), np.zeros(len(k), int)
            continue
        place, of_second = np.arange(len(k)) - (upto - each)[k] + (upto - each)[lo], m[k]
        yield k, place // of_second, place % of_second
