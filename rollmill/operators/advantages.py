"""Advantage estimators: outcome estimators give one number a response, token estimators an array.

Outcome estimators are windows over the prompt (``uid``); an estimator over all tokens joins one row of moments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.functions import groupwise, stats

#: The prefix id of rollouts without prefix.
SENTINEL = "0000-0000-0000-0000"


def grpo(df: DataFrame, score: str, uid: str, by_std: bool = True) -> DataFrame:
    return df.withColumn("advantage", (groupwise.group_zscore if by_std else groupwise.group_center)(F.col(score), uid))


def dr_grpo(df: DataFrame, score: str, uid: str) -> DataFrame:
    return grpo(df, score, uid, by_std=False)


def rloo(df: DataFrame, score: str, uid: str) -> DataFrame:
    return df.withColumn("advantage", groupwise.group_leave_one_out(F.col(score), uid))


def sppo(df: DataFrame, score: str, beta: float) -> DataFrame:
    """Score less the soft mean of all scores."""
    return df.crossJoin(F.broadcast(stats.softmean(df, score, beta))).withColumn("advantage", F.col(score) - F.col("softmean")).drop("softmean")


def prefixed(df: DataFrame, score: str, uid: str, prefix_uid: str, rollouts: int, kind: str) -> DataFrame:
    """Two-level estimators, ``advantage`` for ordinary tokens and ``prefix_advantage`` for tokens of the prefix.

    Kinds: "grpo" (z-score within uid and prefix), "dr_grpo" (centred; a single rollout keeps its score), "dr_grpo_v2"
    (centred throughout). The prefix gets the same less the mean of the uid's rollouts without prefix, by ``rollouts``. It is
    0 for rollouts without prefix and null where the uid has none of these.
    """
    value, own = F.col(score), Window.partitionBy(uid, prefix_uid)
    if kind == "grpo":
        advantage = groupwise.group_zscore(value, uid, prefix_uid)
    elif kind == "dr_grpo":
        advantage = groupwise.group_center(value, uid, prefix_uid)
    elif kind == "dr_grpo_v2":
        advantage = value - F.avg(value).over(own)
    else:
        raise ValueError(kind)
    plain = F.col(prefix_uid) == SENTINEL
    whole = Window.partitionBy(uid)
    base = F.avg(F.when(plain, value)).over(whole)
    if kind != "dr_grpo_v2":
        base = F.when(F.count(F.when(plain, value)).over(whole) == 1, F.lit(0.0)).otherwise(base)
    return df.withColumn("advantage", advantage).withColumn("_base", base).withColumn("prefix_advantage", F.when(plain, 0.0).otherwise((F.col("advantage") - F.col("_base")) / rollouts)).drop("_base")


def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """``returns`` and ``advantages``, these whitened over all masked tokens."""
    raw = df.withColumn("advantages", A.gae(rewards, values, gamma, lam)).withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    return stats.masked_whiten(raw, "advantages", mask)


def reinforce_plus_plus(df: DataFrame, rewards: str, mask: str, gamma: float = 1.0) -> DataFrame:
    """Discounted suffix sums, reset by the mask, whitened and masked; ``returns`` are the sums."""
    raw = df.withColumn("returns", A.discounted_suffix_sum(rewards, mask, gamma)).withColumn("advantages", F.col("returns"))
    return stats.masked_whiten(raw, "advantages", mask).withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m))


def reinforce_plus_plus_baseline(df: DataFrame, score: str, uid: str, mask: str) -> DataFrame:
    """Group-centred score on every token, whitened and masked."""
    raw = df.withColumn("_score", groupwise.group_center(F.col(score), uid)).withColumn("advantages", F.transform(mask, lambda m: F.col("_score") + m * 0.0))
    return stats.masked_whiten(raw, "advantages", mask).withColumn("advantages", F.zip_with("advantages", mask, lambda a, m: a * m)).drop("_score")


def remax(df: DataFrame, rewards: str, mask: str, baseline: Column) -> DataFrame:
    """Suffix sums of the masked rewards less the baseline on masked tokens."""
    sums = A.suffix_sum(F.zip_with(rewards, mask, lambda r, m: r * m))
    return df.withColumn("returns", sums).withColumn("advantages", F.zip_with("returns", mask, lambda r, m: r - baseline * m))


ESTIMATORS = {"grpo": grpo, "dr_grpo": dr_grpo, "rloo": rloo, "sppo": sppo, "gae": gae, "reinforce_plus_plus": reinforce_plus_plus, "reinforce_plus_plus_baseline": reinforce_plus_plus_baseline, "remax": remax, "prefix": prefixed}


def estimate(df: DataFrame, name: str, **arguments) -> DataFrame:
    if name not in ESTIMATORS:
        raise NotImplementedError(name)
    return ESTIMATORS[name](df, **arguments)
