"""Problem 8: pages made of keywords, links or tags instead of sentences.

Bagged decision trees on content and link features are trained from weak labels. The labels come from votes on signals that
aren't features: few or many different function words, anchors, prices at the ends of lines, figures, compressibility. Pages
on which the votes don't agree, or that have none, are left unlabelled. The trees' predictions for all pages are then
smoothed with the spam rate of the page's host, and a page is spam by its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm import pagefeatures
from rollmill.session import written

#: Labelled rows that the trees are trained on, at most about.
LABELLED_ROWS = 20_000
TREES, DEPTH = 16, 5
#: Weight of the host's rate in a page's score, pages that the overall rate counts for in a host's rate, and least score.
HOST_WEIGHT, PRIOR_PAGES, LEAST_SCORE = 0.1, 10.0, 0.5


def votes(text: str, n_words: int) -> int:
    """The weak label by the signals: 1 for spam, 0 for clean, -1 if the votes differ or there are none."""
    variety, anchors, figures, priced = pagefeatures.page_signals(text)
    spam = anchors > 0.5 or priced > 0.5 and variety < 0.5 or variety <= 0.3 and n_words >= 20 and figures < 0.12 and pagefeatures.compressed(text) < 0.65
    clean = anchors < 0.2 and priced < 0.05 and (variety >= 0.8 or figures > 0.12)
    return -1 if spam == clean else int(spam)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "site") -> DataFrame:
    """``key, host, n_words, label, features``; pages with null or blank text have no words and no label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pages = [pagefeatures.page_features(t) if t else (0, [0.0] * len(pagefeatures.NAMES)) for t in texts]
            labels = [votes(t, n) if n else -1 for t, (n, _) in zip(texts, pages)]
            columns = [pa.array([n for n, _ in pages], pa.int32()), pa.array(labels, pa.int32()), pa.array([f for _, f in pages], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "host", "n_words", "label", "features"])

    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return own.mapInArrow(run, "key long, host string, n_words int, label int, features array<double>")


def scored(pages: DataFrame, labelled_rows: int = LABELLED_ROWS, seed: int = 7) -> DataFrame:
    """``pages`` with ``probability`` by the trees and ``score`` smoothed by host.

    If the labelled rows are of one class or none, nothing can be learned and the labels stand for the probabilities, 0 for
    pages without one.
    """
    labelled = pages.where("label >= 0").withColumn("label", F.col("label").cast("double"))
    n = {row.label: row.n for row in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        guessed = pages.withColumn("probability", F.greatest("label", F.lit(0)).cast("double"))
    else:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.functions import array_to_vector, vector_to_array

        # half of the rows of either class, by hash
        rate = F.when(F.col("label") == 1.0, F.lit(labelled_rows / 2 / n[1.0])).otherwise(F.lit(labelled_rows / 2 / n[0.0]))
        drawn = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < rate * (1 << 30)
        sample = labelled.where(drawn).select("label", array_to_vector("features").alias("vector"))
        # all features at every split and a bootstrap sample for each tree: bagging
        trees = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True, seed=seed)
        model = trees.fit(sample)
        guessed = model.transform(pages.withColumn("vector", array_to_vector("features"))).withColumn("probability", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "prediction")
    guessed = guessed.withColumn("probability", F.when(F.col("n_words") > 0, F.col("probability")).otherwise(0.0))
    hosts = guessed.where("n_words > 0 AND host IS NOT NULL").groupBy("host").agg(F.sum("probability").alias("spam"), F.count("*").alias("pages"))
    overall = guessed.where("n_words > 0").agg(F.coalesce(F.avg("probability"), F.lit(0.0)).alias("rate")).first().rate
    rates = hosts.select("host", ((F.col("spam") + overall * PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).alias("host_rate"))
    smoothed = (1 - HOST_WEIGHT) * F.col("probability") + HOST_WEIGHT * F.coalesce("host_rate", F.lit(overall))
    return guessed.join(rates, "host", "left").withColumn("score", smoothed)


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "site") -> DataFrame:
    """``key`` of the spam pages, once each. Null keys, null, empty and blank texts are none; a null host has the overall rate."""
    pages = written(features(docs, key, text, host))
    return scored(pages).where(F.col("score") >= LEAST_SCORE).select(F.col("key").alias(key)).distinct()


def host_rates(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "site") -> DataFrame:
    """Per host (null is one): pages with words, spam pages, and their share. Rows count as stored."""
    pages = scored(written(features(docs, key, text, host))).where("n_words > 0")
    spam = F.col("score") >= LEAST_SCORE
    return pages.groupBy(F.col("host").alias(host)).agg(F.count("*").alias("n_pages"), F.count_if(spam).alias("n_spam")).withColumn("spam_share", F.col("n_spam") / F.col("n_pages"))
