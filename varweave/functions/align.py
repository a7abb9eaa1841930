"""Alignment of two sequences with affine gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Match, mismatch, opening a gap, extending it.
MATCH, MISMATCH, OPEN, EXTEND = 2, -3, -5, -2


def align_score(a: str, b: str) -> int:
    """The best score of an alignment that ends in a match or mismatch.

    A gap may follow the sequences' starts at no opening cost on the side that is still empty. Row by row: the gap along
    the row is a running maximum of what opens it, less the extensions since. An empty text scores the gap of the other.
    """
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    m = len(y)
    ramp = np.arange(m + 1, dtype=np.int64) * EXTEND
    edge = ramp + OPEN - EXTEND
    pair, down, along = edge.copy(), np.zeros(m + 1, np.int64), edge.copy()
    pair[0] = along[0] = 0
    for i, ch in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32)):
        first = OPEN + i * EXTEND
        fresh = np.maximum(np.maximum(pair, down), along)[:-1] + np.where(y == ch, MATCH, MISMATCH)
        down = np.maximum(pair + OPEN, down + EXTEND)
        pair = np.r_[first, fresh]
        down[0] = first
        along = np.maximum.accumulate(np.r_[0, pair[:-1] + OPEN] - ramp) + ramp
    return int(pair[-1])


#: Cells of the score tables of the pairs that are scored at once.
CELLS = 1_000_000


def _scored_together(firsts: list[np.ndarray], seconds: list[np.ndarray]) -> np.ndarray:
    """``align_score`` of several pairs, row by row of all of them; shorter ones are padded and read off at their own ends."""
    n, m = np.array([len(x) for x in firsts]), np.array([len(y) for y in seconds])
    x = np.full((len(n), int(n.max())), 1, np.uint32)
    y = np.full((len(m), int(m.max())), 2, np.uint32)
    for i, (a, b) in enumerate(zip(firsts, seconds)):
        x[i, : len(a)], y[i, : len(b)] = a, b
    ramp = np.arange(y.shape[1] + 1, dtype=np.int64) * EXTEND
    pair = np.repeat((ramp + OPEN - EXTEND)[None], len(n), axis=0)
    pair[:, 0] = 0
    along, down = pair.copy(), np.zeros_like(pair)
    rows = np.arange(len(n))
    out = pair[rows, m]
    zero = np.zeros((len(n), 1), np.int64)
    for i in range(x.shape[1]):
        first = OPEN + i * EXTEND
        fresh = np.maximum(np.maximum(pair, down), along)[:, :-1] + np.where(y == x[:, i, None], MATCH, MISMATCH)
        down = np.maximum(pair + OPEN, down + EXTEND)
        pair = np.concatenate([zero + first, fresh], axis=1)
        down[:, 0] = first
        along = np.maximum.accumulate(np.concatenate([zero, pair[:, :-1] + OPEN], axis=1) - ramp, axis=1) + ramp
        ended = np.flatnonzero(n == i + 1)
        out[ended] = pair[ended, m[ended]]
    return out


def align_scores(firsts: list[str], seconds: list[str]) -> np.ndarray:
    """``align_score`` of many pairs, those of like length together."""
    a = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in firsts]
    b = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in seconds]
    out = np.empty(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
    at = 0
    while at < len(order):
        end = at + 1
        # A wider table only as long as its padding stays below the length of its shortest pair.
        while end < len(order) and (end - at + 1) * (len(b[order[end]]) + 1) <= CELLS and len(b[order[end]]) <= 2 * len(b[order[at]]) + 16:
            end += 1
        some = order[at:end]
        out[some] = _scored_together([a[i] for i in some], [b[i] for i in some])
        at = end
    return out


@F.pandas_udf(T.IntegerType())
def align(a: pd.Series, b: pd.Series) -> pd.Series:
    """``align_score`` of two text columns; null if either is null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([None] * len(a), dtype="Int32")
    if known.any():
        out[known] = align_scores(a[known].tolist(), b[known].tolist())
    return out
