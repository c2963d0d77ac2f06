"""Columns over token arrays: padding, truncation, masks, positions and scans, as expressions within a row (scans in Arrow
batches).

Null arrays give null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions import scans

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(array: ColumnOrName) -> Column:
    """Sum of the elements, 0.0 for an empty array; null elements count as 0."""
    return F.aggregate(_col(array), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean(array: ColumnOrName, empty: float | None = None) -> Column:
    """Mean of the elements; ``empty`` for an empty array."""
    a = _col(array)
    return F.when(F.size(a) > 0, total(a) / F.size(a)).when(a.isNotNull(), F.lit(empty))


def repeat(value, times: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(times, F.lit(0)).cast("int"))


def pad(array: ColumnOrName, length: int | Column, value=0, left: bool = False) -> Column:
    """Padded to ``length``; longer arrays stay."""
    a = _col(array)
    fill = repeat(value, F.lit(length) - F.size(a) if isinstance(length, int) else length - F.size(a))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate(array: ColumnOrName, length: int, how: str = "right") -> Column:
    """At most ``length`` elements: the first ("right" is cut), the last ("left"), half from either end ("middle", the larger
    half from the end), or an error ("error")."""
    a = _col(array)
    long = F.size(a) > length
    if how == "right":
        return F.slice(a, 1, length)
    if how == "left":
        return F.when(long, F.slice(a, -length, length)).otherwise(a)
    if how == "middle":
        head = length // 2
        tail = length - head
        return F.when(long, F.concat(F.slice(a, 1, head), F.slice(a, -tail, tail)) if head else F.slice(a, -tail, tail)).otherwise(a)
    if how == "error":
        return F.when(long, F.raise_error(F.concat(F.lit("sequence of "), F.size(a).cast("string"), F.lit(f" elements, limit {length}")))).otherwise(a)
    raise ValueError(how)


def attention_mask(array: ColumnOrName, length: int, left: bool = False) -> Column:
    return pad(F.transform(_col(array), lambda _: F.lit(1)), length, 0, left)


def first_index(array: Column, test) -> Column:
    """0-based index of the first element that passes; null if none does."""
    at = F.array_position(F.transform(array, lambda x: F.coalesce(test(x), F.lit(False))), True)
    return F.when(at > 0, at - 1)


def response_mask(ids: ColumnOrName, end: int | list[int]) -> Column:
    """Ones up to the first end token, itself included; ones throughout if there is none."""
    a, ends = _col(ids), [end] if isinstance(end, int) else end
    at = first_index(a, lambda x: x.isin(*ends))
    return F.transform(a, lambda x, i: (at.isNull() | (i <= at)).cast("int"))


def last_columns(mask: ColumnOrName, n: int | Column) -> Column:
    a = _col(mask)
    width = F.least(F.lit(n) if isinstance(n, int) else n, F.size(a))
    return F.when(width > 0, F.slice(a, F.size(a) - width + 1, width)).otherwise(F.slice(a, 1, 0))


def remove_left_pad(ids: ColumnOrName, mask: ColumnOrName) -> Column:
    """The last sum(mask) ids."""
    n = F.aggregate(_col(mask), F.lit(0), lambda s, x: s + x)
    return last_columns(ids, n)


def strip_left(ids: ColumnOrName, pad_id: int) -> Column:
    """From the first id that isn't the pad; inner ones stay. Empty if all are."""
    a = _col(ids)
    at = first_index(a, lambda x: x != pad_id)
    return F.when(at.isNull(), F.slice(a, 1, 0)).otherwise(F.slice(a, (at + 1).cast("int"), F.size(a)))


def position_ids(mask: ColumnOrName) -> Column:
    """Running count of real tokens less 1, at least 0."""
    return F.transform(scans.running_sum(_col(mask)), lambda x: F.greatest(x.cast("int") - 1, F.lit(0)))


def suffix_sum(array: ColumnOrName) -> Column:
    return scans.suffix_sum(_col(array))


def discounted_suffix_sum(rewards: ColumnOrName, mask: ColumnOrName, gamma: float) -> Column:
    return scans.discounted_suffix_sum(_col(rewards), _col(mask), gamma)


def gae(rewards: ColumnOrName, values: ColumnOrName, gamma: float, lam: float) -> Column:
    return scans.gae(_col(rewards), _col(values), gamma, lam)


def log_sum_exp(logits: ColumnOrName) -> Column:
    """Shifted by the maximum, so that nothing overflows."""
    a = _col(logits)
    most = F.array_max(a)
    return most + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - most)))


def logprob_of(logits: ColumnOrName, label: Column) -> Column:
    return F.element_at(_col(logits), (label + 1).cast("int")) - log_sum_exp(logits)


def entropy_of(logits: ColumnOrName) -> Column:
    a = _col(logits)
    z = log_sum_exp(a)
    return z - F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x)


def top_k_softmax(logits: ColumnOrName, k: int) -> Column:
    """Softmax over the k largest logits (and those equal to the last of them), 0 elsewhere."""
    a = _col(logits)
    least = F.element_at(F.sort_array(a, False), F.least(F.lit(k), F.size(a)))
    kept = F.transform(a, lambda x: F.when(x >= least, F.exp(x - F.array_max(a))).otherwise(0.0))
    return F.transform(kept, lambda x: x / total(kept))


def scatter_last(length: Column, position: Column, value: Column) -> Column:
    """Zeros of ``length`` with ``value`` at ``position``; without a place in the array there is no value."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: F.when(i == position, value).otherwise(0.0))).otherwise(F.array().cast("array<double>"))


def prefix_length(length: Column, ratio: Column, least: int = 0) -> Column:
    """int(ratio * length), at least ``least`` and at most length - 1; 0 if the ratio or the length is 0."""
    n = F.least(F.greatest((ratio * length).cast("int"), F.lit(least)), length - 1)
    return F.when((ratio == 0) | (length == 0), 0).otherwise(n)


def ngrams(words: ColumnOrName, n: int) -> Column:
    w = _col(words)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n))).otherwise(F.array().cast("array<array<string>>"))
