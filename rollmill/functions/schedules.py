"""Values by training step, as columns over ``step``; and the state of KL controllers."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(step: Column, value: float, warmup: int = 0) -> Column:
    return value * F.least(F.lit(1.0), step / max(1, warmup)) if warmup else F.lit(float(value)) + step * 0.0


def _warm(step: Column, start: float, warmup: int, after: Column) -> Column:
    return F.when(step < warmup, step / warmup * start).otherwise(after) if warmup else after


def linear(step: Column, start: float, end: float, steps: int, warmup_ratio: float = 0.1) -> Column:
    """From 0 to ``start`` in the warm-up, then in ``steps`` further steps straight to ``end``, which it keeps."""
    warmup = int(steps * warmup_ratio)
    left = F.greatest(F.lit(0.0), 1.0 - (step - warmup) / steps)
    return _warm(step, start, warmup, end + left * (start - end))


def cosine(step: Column, start: float, end: float, steps: int, warmup_ratio: float = 0.0) -> Column:
    """As ``linear``, along half a cosine; up or down."""
    warmup = int(steps * warmup_ratio)
    part = F.least(F.lit(1.0), (step - warmup) / steps)
    return _warm(step, start, warmup, end + (start - end) * 0.5 * (1 + F.cos(pi * part)))


def delayed(step: Column, delay: int, before: float, schedule) -> Column:
    return F.when(step < delay, F.lit(float(before))).otherwise(schedule(step - delay))


def stepped(score: Column, threshold: float, left: float, right: float) -> Column:
    return F.when(score <= threshold, F.lit(float(left))).otherwise(F.lit(float(right)))


def sigmoid(score: Column, shift: float = 0.0, scale: float = 1.0, temperature: float = 1.0, bias: float = 0.0) -> Column:
    return scale / (1 + F.exp(-temperature * (score - shift))) + bias


def lr_constant(step: Column, warmup: int) -> Column:
    return F.least(F.lit(1.0), step / max(1.0, float(warmup)))


def lr_cosine(step: Column, warmup: int, steps: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    """Multiplier: up from ``least`` in the warm-up, then a cosine between 1 and ``least``."""
    part = (step - warmup) / max(1, steps - warmup)
    wave = F.cos(2.0 * pi * cycles * part) * ((1 - least) * 0.5) + (1 + least) * 0.5
    return F.when(step < warmup, least + (1.0 - least) * (step / max(1.0, float(warmup)))).otherwise(F.greatest(F.lit(float(least)), wave))


def lr_wsd(step: Column, warmup: int, steps: int, least: float = 0.0, cycles: float = 0.5, stable_ratio: float = 0.9) -> Column:
    """Multiplier: warm-up, plateau, cosine decay to ``least``, which it keeps after ``steps``."""
    rest = max(0, steps - warmup)
    stable = int(rest * stable_ratio)
    part = (step - warmup - stable) / max(1.0, float(rest - stable))
    falling = (1.0 - least) * F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(2.0 * pi * cycles * part))) + least
    return F.when(step < warmup, step / max(1.0, float(warmup))).when(step < warmup + stable, 1.0).when(step < steps, falling).otherwise(F.lit(float(least)))


def beta_uniform(uniform: Column, low: float, high: float) -> Column:
    """Beta(1, 1) between two bounds; other shapes need their quantile function."""
    return low + (high - low) * uniform


class FixedKl:
    def __init__(self, value: float):
        self.value = value

    def update(self, current: float, steps: int) -> float:
        return self.value


class AdaptiveKl:
    """Raises or lowers its value with the KL's relative distance from the target, by at most a fifth of steps / horizon."""

    def __init__(self, value: float, target: float, horizon: float):
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, steps: int) -> float:
        error = max(-0.2, min(0.2, current / self.target - 1))
        self.value *= 1 + error * steps / self.horizon
        return self.value
