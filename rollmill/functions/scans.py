"""Scans over token arrays in Arrow batches.

A fold that appends to an array copies it for every token; here a batch's arrays lie end to end, sums are cumulative sums of
the whole, and a recursion advances all arrays of the batch by one token at a time, so the work is in proportion to the
tokens. Null arrays give null, null elements count as 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIST = "array<double>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all elements, start of each array and the end of the last)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.nan_to_num(values, nan=0.0) if column.flatten().null_count else np.array(values, np.float64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray, like: pa.Array) -> pa.Array:
    mask = pa.array(~like.is_valid().to_numpy(zero_copy_only=False)) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values), mask=mask)


def _backwards(x: np.ndarray, factor: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """out[t] = x[t] + factor[t] * out[t + 1] within each array."""
    out = x.copy()
    ends, lengths = starts[1:], np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    ends, lengths = ends[order], lengths[order]
    for t in range(2, int(lengths[0]) + 1 if len(lengths) else 0):
        at = ends[: int(np.searchsorted(-lengths, -t, side="right"))] - t
        out[at] += factor[at] * out[at + 1]
    return out


def _next(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The following element within each array, 0 after the last."""
    out = np.append(x[1:], 0.0) if len(x) else x.copy()
    last = starts[1:][np.diff(starts) > 0] - 1
    out[last] = 0.0
    return out


def running_sum(array: Column) -> Column:
    @F.arrow_udf(LIST)
    def run(column: pa.Array) -> pa.Array:
        x, starts = _flat(column)
        sums = np.cumsum(x)
        before = np.concatenate([[0.0], sums])[starts[:-1]]
        return _lists(sums - np.repeat(before, np.diff(starts)), starts, column)

    return run(array)


def suffix_sum(array: Column) -> Column:
    @F.arrow_udf(LIST)
    def run(column: pa.Array) -> pa.Array:
        x, starts = _flat(column)
        return _lists(_backwards(x, np.ones_like(x), starts), starts, column)

    return run(array)


def discounted_suffix_sum(rewards: Column, mask: Column, gamma: float) -> Column:
    """g[t] = r[t] + gamma g[t + 1], without what comes after a step whose mask is 0."""

    @F.arrow_udf(LIST)
    def run(r: pa.Array, m: pa.Array) -> pa.Array:
        x, starts = _flat(r)
        kept, _ = _flat(m)
        return _lists(_backwards(x, gamma * _next(kept, starts), starts), starts, r)

    return run(rewards, mask)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates before whitening; the value after the last token is 0."""

    @F.arrow_udf(LIST)
    def run(r: pa.Array, v: pa.Array) -> pa.Array:
        x, starts = _flat(r)
        value, _ = _flat(v)
        delta = x + gamma * _next(value, starts) - value
        return _lists(_backwards(delta, np.full_like(delta, gamma * lam), starts), starts, r)

    return run(rewards, values)
