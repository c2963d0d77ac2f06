"""Divergences, policy and value objectives and advantage reshapers, per token; aggregate them with ``stats.agg_loss``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(x, F.lit(high) if isinstance(high, (int, float)) else high), F.lit(low) if isinstance(low, (int, float)) else low)


def kl_penalty(log_prob: Column, reference: Column, kind: str) -> Column:
    d = log_prob - reference
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return clip(F.exp(-d) + d - 1, -10.0, 10.0)
    raise NotImplementedError(kind)


def policy_terms(log_prob: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Struct ``loss, clipped, clipped_low, kl`` of a token: the larger of plain and clipped loss, bounded by ``dual`` times
    the advantage where that is negative."""
    if dual <= 1:
        raise ValueError("the bound of dual clipping must be above 1")
    ratio = F.exp(log_prob - old)
    plain = -advantage * ratio
    clipped = -advantage * clip(ratio, 1 - low, 1 + high)
    larger = F.greatest(plain, clipped)
    bound = -advantage * dual
    negative = advantage < 0
    return F.struct(
        F.when(negative, F.least(bound, larger)).otherwise(larger).alias("loss"),
        (clipped > plain).cast("double").alias("clipped"),
        ((larger > bound) & negative).cast("double").alias("clipped_low"),
        (old - log_prob).alias("kl"),
        plain.alias("plain"),
    )


def policy_terms_prefix(log_prob: Column, old: Column, advantage: Column, prefix: Column, low: float, high: float, low_off: float, high_off: float, dual: float = 3.0, clip_prefix: bool = True) -> Column:
    """As ``policy_terms``; tokens of the prefix have clip fractions of their own, and without ``clip_prefix`` their plain loss."""
    on, off = policy_terms(log_prob, old, advantage, low, high, dual), policy_terms(log_prob, old, advantage, low_off, high_off, dual)
    loss = on["loss"] if clip_prefix else F.when(prefix > 0, on["plain"]).otherwise(on["loss"])
    share = (lambda x: x) if clip_prefix else (lambda _: F.lit(0.0))
    return F.struct(loss.alias("loss"), on["clipped"].alias("clipped"), on["clipped_low"].alias("clipped_low"), share(off["clipped"]).alias("clipped_prefix"), share(off["clipped_low"]).alias("clipped_low_prefix"), on["kl"].alias("kl"))


def value_terms(predicted: Column, returned: Column, old: Column, span: float) -> Column:
    """Struct ``loss, clipped``: half the larger squared error of the prediction and of it kept within ``span`` of the old value."""
    kept = clip(predicted, old - span, old + span)
    plain, clipped = (predicted - returned) * (predicted - returned), (kept - returned) * (kept - returned)
    return F.struct((0.5 * F.greatest(plain, clipped)).alias("loss"), (clipped > plain).cast("double").alias("clipped"))


def sppo_term(log_ratio_sum: Column, reward: Column, eta: float) -> Column:
    return F.pow(log_ratio_sum - eta * reward, F.lit(2.0))


#: Added to the probability in the denominator of the "luffy" reshaper.
LUFFY_SHIFT = 0.1


def reshape(advantage: Column, log_prob: Column, old: Column, prefix: Column, kind: str) -> Column:
    """Struct ``advantage, log_prob`` of a token; only tokens of the prefix change. Kinds: identity, importance_sampling (the
    old log-probability is added), luffy (also divided by p + 0.1), relu and silu of the advantage."""
    a, lp = advantage, log_prob
    if kind == "importance_sampling":
        lp = log_prob + old
    elif kind == "luffy":
        lp = log_prob + old - F.log(F.exp(log_prob) + LUFFY_SHIFT)
    elif kind == "relu":
        a = F.greatest(advantage, F.lit(0.0))
    elif kind == "silu":
        a = advantage / (1 + F.exp(-advantage))
    elif kind != "identity":
        raise NotImplementedError(kind)
    inside = prefix > 0
    return F.struct(F.when(inside, a).otherwise(advantage).alias("advantage"), F.when(inside, lp).otherwise(log_prob).alias("log_prob"))


def position_weight(place: Column, low: Column, high: Column, least: float = 1e-3) -> Column:
    """Inverse density of a prefix that ends uniformly between ``low`` and ``high``, before division by its mean."""
    density = F.when(place <= low, 2.0 / (low + high)).when(place <= high, 2.0 * (high - place) / (high * high - low * low)).otherwise(0.0)
    return 1.0 / F.greatest(density, F.lit(least))


def without_cut_tail(advantage: Column, prefix: Column, mask: Column, length: Column, width: int) -> Column:
    """0 on the own tokens of a response that fills the width, which was cut rather than ended."""
    return F.when((length == width) & (prefix == 0) & (mask == 1), 0.0).otherwise(advantage)
