"""Joins on record ids: reconciliation of twin columns, lookups by length, and merges that extend lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiway(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner joins from left to right; with one key all frames are shuffled alike, once each."""
    return reduce(lambda a, b: a.join(b, key), frames)


def reconciled(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inner join with shared columns once, from the left; ``column, n_conflicts``: rows in which twins differ)."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    both = left.join(right.withColumnsRenamed({c: f"_right_{c}" for c in shared}), key)
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(~F.col(c).eqNullSafe(F.col(f"_right_{c}"))).alias("n_conflicts")) for c in shared]
    conflicts = both.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*") if shared else None
    return both.drop(*(f"_right_{c}" for c in shared)), conflicts


def first_by_length(lists: Column, flags: Column, length: Column) -> Column:
    """The flag at the first element of ``lists`` that equals ``length``; null if none does."""
    at = F.array_position(lists, length)
    return F.when(at > 0, F.element_at(flags, at.cast("int")))


def extended(df: DataFrame, key: str, items: str, order: str, *scalars: str) -> DataFrame:
    """One row a key: scalars of its first row by ``order``, lists of all its rows in that order, one after the other. Rows
    with an empty key or list are left out."""
    rows = df.where((F.length(key) > 0) & (F.size(items) > 0))
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, items))), lambda x: x[items]))
    return rows.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in scalars), lists.alias(items))


def distinct_answers(df: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """One row per key and answer, the first by ``order``."""
    return df.groupBy(key, answer).agg(F.min(order).alias(order))


def matrix(df: DataFrame, key: str, step: str, value: str, steps: list[int]) -> DataFrame:
    """key by step; fixed steps, so that missing ones are null columns."""
    return df.groupBy(key).pivot(step, steps).agg(F.max(value))


def long_of(df: DataFrame, key: str, columns: dict[str, str], names: tuple[str, str] = ("method", "value")) -> DataFrame:
    """Rows (key, method, value) of columns."""
    return df.select(key, *(F.col(c).alias(n) for n, c in columns.items())).unpivot([key], list(columns), *names)
