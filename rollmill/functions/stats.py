"""Masked statistics and loss aggregation over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.session import cut_lineage

MEAN_EPSILON = WHITEN_EPSILON = 1e-8


def masked_sum(values: str, mask: str) -> Column:
    """Within a row."""
    return F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def masked_moments(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row over all tokens: ``total, count, mean`` (with 1e-8 added to the count) and ``variance`` (Bessel-corrected).
    Without two masked tokens there is no variance: null."""
    own = F.zip_with(values, mask, lambda x, m: F.struct((x * m).alias("x"), (x * x * m).alias("xx"), m.cast("double").alias("m")))
    part = F.aggregate(own, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("m")), lambda s, v: F.struct((s["x"] + v["x"]).alias("x"), (s["xx"] + v["xx"]).alias("xx"), (s["m"] + v["m"]).alias("m")))
    sums = df.select(part.alias("p")).agg(F.sum("p.x").alias("total"), F.sum("p.xx").alias("squares"), F.sum("p.m").alias("count"))
    mean = F.col("total") / (F.col("count") + MEAN_EPSILON)
    # sum of (x - mean)^2 over the mask, then divided by count and corrected
    spread = F.col("squares") - 2 * mean * F.col("total") + mean * mean * F.col("count")
    variance = F.when(F.col("count") > 1, spread / (F.col("count") + MEAN_EPSILON) * F.col("count") / (F.col("count") - 1))
    return sums.select("total", "count", mean.alias("mean"), variance.alias("variance"))


def masked_whiten(df: DataFrame, values: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """``df`` with ``values`` centred and scaled by all masked tokens; unmasked ones are scaled as well. The moments are one
    row, joined to every other."""
    moments = masked_moments(df, values, mask).select(F.col("mean").alias("_mean"), F.col("variance").alias("_variance"))
    back = F.lit(0.0) if shift_mean else F.col("_mean")
    white = F.transform(values, lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_variance") + WHITEN_EPSILON) + back)
    return df.crossJoin(F.broadcast(moments)).withColumn(values, white).drop("_mean", "_variance")


def agg_loss(df: DataFrame, losses: str, mask: str, mode: str, width: int | None = None) -> DataFrame:
    """One row ``loss``. Modes: token-mean, seq-mean-token-sum, seq-mean-token-mean, seq-mean-token-sum-norm (divided by the
    padded ``width``), dr_grpo (divided by ``width`` as the token limit)."""
    rows = df.select(masked_sum(losses, mask).alias("loss"), F.aggregate(mask, F.lit(0.0), lambda s, m: s + m).alias("tokens"))
    if mode == "token-mean":
        return rows.agg((F.sum("loss") / (F.sum("tokens") + MEAN_EPSILON)).alias("loss"))
    if mode == "seq-mean-token-sum":
        return rows.agg(F.avg("loss").alias("loss"))
    if mode == "seq-mean-token-mean":
        return rows.agg(F.avg(F.when(F.col("tokens") > 0, F.col("loss") / F.col("tokens")).otherwise(F.lit(float("nan")))).alias("loss"))
    if width is None or width <= 0:
        raise ValueError("this mode needs the padded width")
    if mode in ("seq-mean-token-sum-norm", "dr_grpo"):
        return rows.agg((F.sum("loss") / width).alias("loss"))
    raise ValueError(mode)


def softmean(df: DataFrame, value: str, beta: float) -> DataFrame:
    """One row: log(mean(exp(beta x))) / beta, shifted by the largest beta x; the mean for beta 0."""
    if beta == 0:
        return df.agg(F.avg(value).alias("softmean"))
    scaled = F.col(value) * beta
    most = df.agg(F.max(scaled).alias("_most"))
    return df.crossJoin(F.broadcast(most)).agg(((F.log(F.avg(F.exp(scaled - F.col("_most")))) + F.max("_most")) / beta).alias("softmean"))


def spread_percentiles(df: DataFrame, value: str, shares: list[float], *keys: str) -> DataFrame:
    """``*keys, _q``: exact percentiles with linear interpolation (nulls and NaN left out), however large a group is.

    Values are counted first, then placed by ranges of (keys, value), each sorted in a task of its own; the ranges' sums give
    the ranks before each range. Only the rows at the wanted ranks are gathered. A group without values has no row.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    counts = own.groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    ranged = cut_lineage(counts.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()))
    # a row for each group and range
    whole, earlier = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*names, "_part").agg(F.sum("_n").alias("_in"))
    sums = sums.select(*names, "_part", F.sum("_in").over(whole).alias("_all"), F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*names, "_part").orderBy("_v")
    running = ranged.withColumn("_through", F.sum("_n").over(within))
    renamed = sums.select(*(F.col(n).alias(f"{n}s") for n in names), F.col("_part").alias("_parts"), "_all", "_before")
    same = F.col("_part") == F.col("_parts")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}s"))
    placed = running.join(renamed, same).withColumn("_end", F.col("_before") + F.col("_through"))
    holds = lambda rank: (rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end"))
    columns, wanted = [], F.lit(False)
    for share in shares:
        at = (F.col("_all") - 1) * F.lit(float(share))
        low, high = F.floor(at), F.ceil(at)
        wanted = wanted | holds(low) | holds(high)
        lower, upper, place = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v"))), F.max(at)
        columns.append(F.when(lower == upper, lower).otherwise((F.ceil(place) - place) * lower + (place - F.floor(place)) * upper))
    found = placed.where(wanted).groupBy(*names).agg(F.array(*columns).alias("_q"))
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "_q")


def iqr_fence(df: DataFrame, value: str, *keys: str, factor: float = 1.5) -> DataFrame:
    """Rows within ``factor`` quartile distances of the quartiles of their group (all rows without ``keys``). Quartiles are
    found by ranges (``spread_percentiles``), then joined back, so a group of any size stays spread. Null keys and null
    values are left out."""
    at = spread_percentiles(df, value, [0.25, 0.75], *keys)
    low, high = F.col("_q")[0], F.col("_q")[1]
    joined = df.join(at, list(keys)) if keys else df.crossJoin(F.broadcast(at))
    return joined.where(F.col(value).between(low - factor * (high - low), high + factor * (high - low))).drop("_q")


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin`` of each row: right-closed intervals between the distinct quantiles, the first one closed on both sides."""
    edges = spread_percentiles(df, value, [i / bins for i in range(bins + 1)]).select(F.array_distinct("_q").alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(below - 1, F.lit(0))).drop("_edges")


def width_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin, n`` over equal widths from the least to the largest value; the last bin holds the largest."""
    span = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)).otherwise(0)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def explained_variance(returns: Column, values: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def best_of_k(values: Column, k: int) -> Column:
    """Expected maximum of k draws with replacement from an array, in closed form over its sorted values."""
    ordered, n = F.array_sort(values), F.size(values)
    weights = F.transform(ordered, lambda v, i: v * (F.pow((i + 1) / n, F.lit(float(k))) - F.pow(i / n, F.lit(float(k)))))
    return F.when(n > 0, A.total(weights))


def worst_of_k(values: Column, k: int) -> Column:
    """Expected minimum of k draws with replacement."""
    return -best_of_k(F.transform(values, lambda v: -v), k)


def share_within(group: str, value: Column) -> Column:
    return value / F.sum(value).over(Window.partitionBy(group))
