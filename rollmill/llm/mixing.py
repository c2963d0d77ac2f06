"""Problem 7: mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are tokens of a public tokenizer. A source whose budget exceeds its tokens is taken whole as often as it fits (complete
epochs, up to ``max_repeats``); what is left of the budget is filled with documents in the order of exponential keys
``-ln(u) / weight``, which draws them without replacement with probabilities by weight. ``u`` is a hash of mix, document and
seed, so the choice doesn't depend on partitions.

The prefix sums over a source are taken in two steps, however large it is: tokens are added up by intervals of keys, these
sums are accumulated (at most ``INTERVALS`` rows a source), and only the interval in which the budget ends is sorted by row.
The intervals are even shares of a source: their bounds follow from how the source's weights are distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.llm import bpe
from rollmill.session import cut_lineage

INTERVALS, WEIGHT_STEPS = 4096, 40
#: Characters a token of text that the tokenizer knows well; less lowers a document's weight, to ``LEAST_WEIGHT`` at least.
GOOD_CHARS, LEAST_WEIGHT = 4.0, 0.1


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, weight``; one row per id and source, documents without tokens left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.vocabulary(path).count
        for batch in batches:
            texts = batch.column(2).to_pylist()
            tokens = [count(t) for t in texts]
            weights = [min(1.0, max(LEAST_WEIGHT, len(t) / n / GOOD_CHARS)) if n else 0.0 for t, n in zip(texts, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(weights)], ["doc_id", "source", "n_tokens", "weight"])

    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    counted = own.mapInArrow(run, "doc_id long, source string, n_tokens long, weight double").where("n_tokens > 0")
    return counted.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.max("weight").alias("weight"))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: ``target_share, target_tokens, available, epochs, rest``.

    Rows of one mix and source are one: shares are added, the larger limits hold. Null shares and limits are 0.
    """
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).first().total
    available = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    wanted = (
        targets.where("mix_name IS NOT NULL AND source IS NOT NULL")
        .groupBy("mix_name", "source")
        .agg(*(F.greatest(F.coalesce(how(name), F.lit(0)), F.lit(0)).alias(name) for how, name in ((F.sum, "target_share"), (F.max, "max_repeats"), (F.max, "total_ratio"))))
    )
    per_source = wanted.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    tokens = F.floor(F.col("target_share") * F.col("total_ratio") * F.lit(total) + 1e-6)
    epochs = F.when(F.col("available") > 0, F.least(F.expr("target_tokens div available"), F.col("max_repeats"))).otherwise(0)
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("target_tokens") - F.col("epochs") * F.col("available")).otherwise(0)
    return per_source.withColumn("target_tokens", tokens).withColumn("epochs", epochs.cast("int")).withColumn("rest", rest)


def weight_shares(sizes: DataFrame) -> DataFrame:
    """``source, weights``: how many of a source's documents have a weight in each of ``WEIGHT_STEPS`` steps, as shares."""
    step = F.least(F.greatest(F.ceil(F.col("weight") * WEIGHT_STEPS), F.lit(1)), F.lit(WEIGHT_STEPS))
    counts = sizes.groupBy("source", ((step - 0.5) / WEIGHT_STEPS).alias("w")).agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("w", "n"))).alias("steps")).select(
        "source", F.transform("steps", lambda x: F.struct(x["w"].alias("w"), (x["n"] / F.col("all")).alias("share"))).alias("weights")
    )


def interval_of(sample_key: Column, weights: Column) -> Column:
    """The number of a key's interval: the share of the source's keys expected below it, in ``INTERVALS`` steps. It never
    falls as the key rises."""
    below = F.aggregate(weights, F.lit(0.0), lambda total, x: total + x["share"] * (1 - F.exp(-x["w"] * sample_key)))
    return F.least(F.floor(below * INTERVALS), F.lit(INTERVALS - 1)).cast("int")


def chosen(sizes: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, repeats`` of the documents in each mix."""
    u = (F.pmod(F.xxhash64("mix_name", "doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    wanted = plan.select("mix_name", "source", "epochs", "rest").join(weight_shares(sizes), "source", "left")
    keyed = sizes.join(wanted, "source").where("epochs > 0 OR rest > 0").withColumn("sample_key", -F.log(u) / F.col("weight"))
    keyed = keyed.withColumn("interval", interval_of(F.col("sample_key"), F.col("weights"))).drop("weights")
    group = Window.partitionBy("mix_name", "source")
    sums = keyed.where("rest > 0").groupBy("mix_name", "source", "interval", "rest").agg(F.sum("n_tokens").alias("n"))
    ending = (
        sums.withColumn("through", F.sum("n").over(group.orderBy("interval")))
        .where("through > rest")
        .groupBy("mix_name", "source")
        .agg(F.min(F.struct("interval", (F.col("through") - F.col("n")).alias("before"))).alias("at"))
        .select("mix_name", "source", F.col("at.interval").alias("last"), F.col("at.before").alias("before"))
    )
    placed = keyed.join(ending, ["mix_name", "source"], "left")
    inside = placed.where((F.col("rest") > 0) & (F.col("interval") == F.col("last"))).withColumn("through", F.col("before") + F.sum("n_tokens").over(group.orderBy("sample_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    drawn_inside = inside.select("mix_name", "source", "doc_id", "n_tokens", (F.col("epochs") + (F.col("through") <= F.col("rest")).cast("int")).alias("repeats"))
    earlier = (F.col("rest") > 0) & (F.col("last").isNull() | (F.col("interval") < F.col("last")))
    outside = placed.where((F.col("rest") <= 0) | F.col("last").isNull() | (F.col("interval") != F.col("last"))).select("mix_name", "source", "doc_id", "n_tokens", (F.col("epochs") + earlier.cast("int")).alias("repeats"))
    return outside.unionByName(drawn_inside).where("repeats > 0")


def mixed(docs: DataFrame, targets: DataFrame, path: str = bpe.DEFAULT_VOCABULARY, seed: int = 11) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, repeats``: the documents of each mix and how often each occurs.

    No source exceeds its budget or a document its ``max_repeats``; what is missing is under one document, unless the source
    runs out. Null sources, documents without tokens and sources without target are in no mix.
    """
    sizes = cut_lineage(sized(docs, path=path))
    return chosen(sizes, cut_lineage(budgets(sizes, targets)), seed)


def shares(docs: DataFrame, targets: DataFrame, path: str = bpe.DEFAULT_VOCABULARY, seed: int = 11) -> DataFrame:
    """Per mix and source: the target and actual share of the mix's tokens, with the documents and tokens chosen. A named source
    without documents has a row of zeros."""
    sizes = cut_lineage(sized(docs, path=path))
    plan = cut_lineage(budgets(sizes, targets))
    got = chosen(sizes, plan, seed).groupBy("mix_name", "source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    filled = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["n_docs", "tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return filled.select("mix_name", "source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "target_tokens", "tokens", "n_docs", "most_repeats", "max_repeats")
