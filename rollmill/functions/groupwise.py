"""Columns that compare a row with its group; each is one window, so a chain of them over one key sorts once."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

STD_EPSILON = 1e-6


def group_center(score: Column, *keys: str) -> Column:
    """``score`` minus its group's mean; a group of one keeps its score."""
    group = Window.partitionBy(*keys)
    return score - F.when(F.count(score).over(group) == 1, F.lit(0.0)).otherwise(F.avg(score).over(group))


def group_zscore(score: Column, *keys: str) -> Column:
    """Centred score over the sample deviation plus 1e-6; a group of one has deviation 1."""
    group = Window.partitionBy(*keys)
    deviation = F.when(F.count(score).over(group) == 1, F.lit(1.0)).otherwise(F.stddev_samp(score).over(group))
    return group_center(score, *keys) / (deviation + STD_EPSILON)


def group_leave_one_out(score: Column, *keys: str) -> Column:
    """``score`` minus the mean of the others of its group; a group of one keeps its score."""
    group = Window.partitionBy(*keys)
    n = F.count(score).over(group)
    return F.when(n == 1, score).otherwise((score - F.avg(score).over(group)) * n / F.greatest(n - 1, F.lit(1)))
