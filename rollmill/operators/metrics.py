"""Metrics of batches, runs and validations, in long rows ``(…, name, value)`` where names vary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.functions.text import with_value


def reduce_metrics(df: DataFrame, name: str = "name", value: str = "value", *keys: str) -> DataFrame:
    """Per name the maximum if it contains "max", else the minimum if it contains "min", else the mean; NaN without values."""
    how = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return df.groupBy(*keys, name).agg(F.coalesce(how, F.lit(float("nan"))).alias(value))


def response_info(df: DataFrame, mask: str, response_length: Column) -> DataFrame:
    """``prompt_length, response_length`` of a mask whose last part is the response."""
    return df.withColumn("response_length", A.total(A.last_columns(mask, response_length)).cast("int")).withColumn("prompt_length", (A.total(mask) - F.col("response_length")).cast("int"))


def summary(column: str, label: str) -> list[Column]:
    return [how(column).alias(f"{label}/{name}") for name, how in (("mean", F.avg), ("max", F.max), ("min", F.min))]


def token_summary(df: DataFrame, column: str, mask: str, label: str) -> DataFrame:
    """mean, max and min over the masked tokens of all rows: rows are reduced first, so no token is shuffled."""
    kept = F.filter(F.zip_with(column, mask, lambda x, m: F.when(m > 0, x)), lambda x: x.isNotNull())
    rows = df.select(kept.alias("x")).where(F.size("x") > 0).select(A.total("x").alias("s"), F.size("x").alias("n"), F.array_max("x").alias("high"), F.array_min("x").alias("low"))
    return rows.agg((F.sum("s") / F.sum("n")).alias(f"{label}/mean"), F.max("high").alias(f"{label}/max"), F.min("low").alias(f"{label}/min"))


def timing(lengths: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """``name, value``: seconds and milliseconds per token of each stage. Generation counts response tokens, others all."""
    tokens = lengths.agg(F.sum("response_length").alias("response"), F.sum(F.col("prompt_length") + F.col("response_length")).alias("all"))
    stages = ("ref", "values", "adv", "update_critic", "update_actor")
    rows = [F.struct(F.lit(f"timing_s/{k}").alias("name"), F.lit(float(v)).alias("value")) for k, v in seconds.items()]
    rows += [F.struct(F.lit(f"timing_per_token_ms/{k}").alias("name"), (F.lit(v * 1000.0) / F.col("response" if k == "gen" else "all")).alias("value")) for k, v in seconds.items() if k == "gen" or k in stages]
    return tokens.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def throughput(lengths: DataFrame, seconds: float, n_gpus: int) -> DataFrame:
    total = F.sum(F.col("prompt_length") + F.col("response_length"))
    return lengths.agg(total.alias("total_num_tokens"), F.lit(float(seconds)).alias("time_per_step"), (total / (seconds * n_gpus)).alias("throughput"))


def majority(df: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Value of the first row with the most frequent vote; of votes as frequent the one seen first."""
    votes = df.groupBy(*keys, vote).agg(F.count("*").alias("_n"), F.min(order).alias("_first"), F.min_by(value, order).alias("_value"))
    return votes.groupBy(*keys).agg(F.max_by("_value", F.struct("_n", (-F.col("_first")).alias("late"))).alias("majority"))


def sample_sizes(n: Column) -> Column:
    """2, 4, ... below n, and n."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    return F.when(n > 1, F.concat(F.filter(powers, lambda p: p < n), F.array(n))).otherwise(F.array().cast("array<int>"))


def validation(df: DataFrame, source: str, prompt: str, value: str, order: str, vote: str | None = None) -> DataFrame:
    """``source, name, value``: per source the means over its prompts of mean@n, std@n (population) and, for k = 2, 4, ..., n,
    the mean and std of best@k and worst@k of k draws with replacement, in closed form. With ``vote`` also those of maj@k,
    the first value of the draws' most frequent vote, by ``bootstrap``'s samples; a prompt's rows are then whole within a task."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    rows = df.groupBy(source, prompt).agg(values.alias("v"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").cast("int").alias("n"))
    named = lambda label, k, v, of="": F.struct(F.concat(F.lit(label), k.cast("string"), F.lit(of)).alias("name"), v.alias("value"))

    def power(i, k):
        return F.pow(i / F.col("n"), k.cast("double"))

    def best(values_, k, of=lambda v: v):
        ordered = F.array_sort(values_)
        return F.aggregate(F.transform(ordered, lambda v, i: of(v) * (power(i + 1, k) - power(i, k))), F.lit(0.0), lambda s, x: s + x)

    def spread(values_, k):
        return with_value(best(values_, k), lambda mean: F.sqrt(best(values_, k, lambda v: (v - mean) * (v - mean))))

    sizes = sample_sizes(F.col("n"))
    own = F.concat(
        F.array(named("mean@", F.col("n"), F.col("mean"))),
        F.filter(F.array(named("std@", F.col("n"), F.col("std"))), lambda _: F.col("n") > 1),
        F.transform(sizes, lambda k: named("best@", k, best(F.col("v"), k), "/mean")),
        F.transform(sizes, lambda k: named("best@", k, spread(F.col("v"), k), "/std")),
        F.transform(sizes, lambda k: named("worst@", k, -best(F.transform("v", lambda v: -v), k), "/mean")),
        F.transform(sizes, lambda k: named("worst@", k, spread(F.transform("v", lambda v: -v), k), "/std")),
    )
    each = rows.select(source, F.explode(own).alias("m")).select(source, "m.name", "m.value")
    if vote:
        each = each.unionByName(_majorities(df, source, prompt, value, order, vote))
    return each.groupBy(source, "name").agg(F.avg("value").alias("value"))


def _majorities(df: DataFrame, source: str, prompt: str, value: str, order: str, vote: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``source, name, value``: mean and std of maj@k of each prompt; null votes are a vote of their own."""

    def first_of_most(codes: np.ndarray, values: np.ndarray) -> float:
        n, first = np.bincount(codes), {}
        for place, code in enumerate(codes.tolist()):
            first.setdefault(code, place)
        return values[first[max(first, key=lambda code: n[code])]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        codes, values = pd.factorize(pdf[vote], use_na_sentinel=False)[0], pdf[value].to_numpy(float)
        rows, size = [], len(pdf)
        for k in [*(2**i for i in range(1, 31) if 2**i < size), size] if size > 1 else []:
            np.random.seed(seed)
            drawn = (np.random.choice(size, size=k, replace=True) for _ in range(resamples))
            found = [first_of_most(codes[d], values[d]) for d in drawn]
            rows += [(pdf[source].iloc[0], f"maj@{k}/mean", float(np.mean(found))), (pdf[source].iloc[0], f"maj@{k}/std", float(np.std(found)))]
        return pd.DataFrame(rows, columns=[source, "name", "value"])

    return df.groupBy(source, prompt).applyInPandas(run, f"{source} {df.schema[source].dataType.simpleString()}, name string, value double")


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, subset: int, functions: dict[str, Callable], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """``keys, name, mean, std`` of functions of samples drawn with replacement, by numpy's legacy generator. Groups are whole
    within a task; for the maximum and minimum ``validation`` needs no sampling and no group in one place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values(order)[value].to_numpy()
        np.random.seed(seed)
        drawn = [data[np.random.choice(len(data), size=subset, replace=True)] for _ in range(resamples)]
        rows = []
        for name, function in functions.items():
            own = [function(d) for d in drawn]
            rows.append([*pdf[keys].iloc[0], name, float(np.mean(own)), float(np.std(own))])
        return pd.DataFrame(rows, columns=[*keys, "name", "mean", "std"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", name string, mean double, std double"
    return df.groupBy(*keys).applyInPandas(run, schema)


def core_or_aux(df: DataFrame, source: str = "source", variable: str = "variable", name: str = "name") -> DataFrame:
    """``section``: val-core for mean, maj and best of the largest sample of a source's core variable (acc if it has one, else
    reward), val-aux otherwise."""
    size = F.regexp_extract(name, r"@(\d+)", 1).cast("int")
    has_acc = F.max((F.col(variable) == "acc").cast("int")).over(Window.partitionBy(source)) == 1
    core = F.when(has_acc, F.lit("acc")).otherwise(F.lit("reward"))
    largest = F.max(size).over(Window.partitionBy(source, variable))
    chosen = (F.col(variable) == core) & F.col(name).rlike("^(mean|maj|best)") & (size == largest)
    return df.withColumn("section", F.when(chosen, "val-core").otherwise("val-aux"))


def dense_flops(lengths: DataFrame, length: str, seconds: float, *, hidden: int, vocabulary: int, layers: int, kv_heads: int, heads: int, intermediate: int) -> DataFrame:
    """Teraflops a second of training a dense decoder: six times its parameters a token, and attention by squared lengths."""
    head = hidden // heads
    parameters = (hidden * intermediate * 3 + hidden * head * (2 * heads + 2 * kv_heads)) * layers + 2 * vocabulary * hidden
    tokens, squares = F.sum(length).cast("double"), F.sum((F.col(length) * F.col(length)).cast("double"))
    return lengths.agg(((6.0 * parameters * tokens + 12.0 * head * heads * layers * squares) / seconds / 1e12).alias("tflops"))


def passes(df: DataFrame, keys: list[str], reward: str) -> DataFrame:
    """avg, pass (any reward counts by its share of rows) and maj: 1 above half, half on a tie."""
    return df.groupBy(*keys).agg(F.avg(reward).alias("avg"), F.avg((F.col(reward) > 0).cast("double")).alias("pass"), F.avg(F.when(F.col(reward) > 0.5, 1.0).when(F.col(reward) == 0.5, 0.5).otherwise(0.0)).alias("maj"))


def unbalance(df: DataFrame, chunk: str, length: str) -> DataFrame:
    """Least, largest and mean total of the chunks."""
    return df.groupBy(chunk).agg(F.sum(length).alias("s")).agg(F.min("s").alias("least"), F.max("s").alias("largest"), F.avg("s").alias("mean"))


def joined(frames: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, how), frames)


def over_batches(function: Callable[[pd.DataFrame], pd.DataFrame]):
    """A function of pandas frames as one of Arrow batches, for ``mapInPandas``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return run


