"""Comparison of texts by TF-IDF, with joins over terms instead of matrices, and trends of plotted series."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TERM = r"[a-z0-9]{2,}"


def tfidf_cosine(left: DataFrame, right: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, cosine`` of the aligned texts of two tables, with document frequencies over all texts of both; keys without a
    common term have no row. Frequencies are shuffled by term, weights by key; no term or document meets all others."""
    tokens = None
    for side, df in enumerate((left, right)):
        own = df.select(key, F.lit(side).alias("side"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
        tokens = own if tokens is None else tokens.unionByName(own)
    counts = tokens.groupBy(key, "side", "term").agg(F.count("*").alias("tf"))
    n = counts.select(key, "side").distinct().agg(F.count("*").alias("n"))
    known = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(known, "term").select(key, "side", "term", (F.col("tf") * F.col("idf")).alias("v"))
    by_term = weights.groupBy(key, "term").agg(F.sum(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    sums = by_term.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return sums.where("ab IS NOT NULL").select(key, (F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb"))).alias("cosine"))


def pair_cosine(a: str | None, b: str | None) -> float:
    """Cosine of word and word-pair weights fitted on the two texts alone; 0 if either has no words."""
    counts = []
    for text in (a, b):
        words = re.findall(r"\w\w+", (text or "").lower())
        counts.append(Counter(words) + Counter(map(" ".join, zip(words, words[1:]))))
    weights = [{w: n * (1.0 if w in counts[0] and w in counts[1] else math.log(3 / 2) + 1) for w, n in own.items()} for own in counts]
    norms = [math.sqrt(sum(v * v for v in own.values())) for own in weights]
    return sum(v * weights[1].get(w, 0.0) for w, v in weights[0].items()) / (norms[0] * norms[1]) if all(norms) else 0.0


def tfidf_pair(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def cosine(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([pair_cosine(x, y) for x, y in zip(left, right)])

    return cosine(a, b)


def lowess(points: DataFrame, x: str, y: str, *keys: str, share: float = 2 / 3, rounds: int = 3) -> DataFrame:
    """``*keys, x, y, trend``: locally weighted linear regression of each series (all points without ``keys``). At each point
    a line is fitted to the nearest ``share`` of the points with tricube weights; ``rounds`` times the points are weighted
    again by their residuals (bisquare). Where the nearest points have one x or no weight, the trend is their weighted mean.

    A series is what a plot shows: points already aggregated by x. It is fitted in one task; null and NaN points are left out.
    """

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y], kind="stable").reset_index(drop=True)
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        n = len(a)
        k = min(n, max(2, int(share * n + 1e-10)))
        robust, trend = np.ones(n), np.zeros(n)
        for again in range(rounds + 1):
            for i in range(n):
                far = np.abs(a - a[i])
                reach = np.partition(far, k - 1)[k - 1]
                w = robust * (np.clip(1 - (far / reach) ** 3, 0, None) ** 3 if reach > 0 else (far == 0).astype(float))
                total = w.sum()
                if total <= 0:
                    trend[i] = b[i]
                    continue
                middle = (w * a).sum() / total
                spread = (w * (a - middle) ** 2).sum()
                mean = (w * b).sum() / total
                flat = spread <= 1e-12 * total * max(1.0, float(np.ptp(a)) ** 2)
                trend[i] = mean if flat else mean + (a[i] - middle) * (w * (a - middle) * b).sum() / spread
            if again < rounds:
                off = np.abs(b - trend)
                typical = 6 * np.median(off)
                if typical <= 0:
                    break
                robust = np.clip(1 - (off / typical) ** 2, 0, None) ** 2
        return pdf.assign(trend=trend)

    own = points.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL AND NOT isnan(`{x}`) AND NOT isnan(`{y}`)")
    schema = StructType([*own.schema.fields, StructField("trend", DoubleType())])
    return own.groupBy(*keys).applyInPandas(fitted, schema)
