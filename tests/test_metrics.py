"""Validation metrics against their definitions."""

from itertools import product

import numpy as np
import pytest

from rollmill.operators import metrics as M
from rollmill.plans import catalog


def majority_of(votes, values):
    seen = {}
    for vote, value in zip(votes, values):
        seen.setdefault(vote, []).append(value)
    return seen[max(seen, key=lambda vote: len(seen[vote]))][0]


def test_validation_has_std_and_maj(spark):
    values, votes = [0.1, 0.9, 0.5], ["a", "b", "b"]
    rows = spark.createDataFrame([("s", "p", v, w, i) for i, (v, w) in enumerate(zip(values, votes))], "source string, prompt string, v double, vote string, pos int")
    got = {r.name: r.value for r in M.validation(rows, "source", "prompt", "v", "pos", "vote").collect()}
    for k in (2, 3):
        for label, of in (("best", max), ("worst", min)):
            every = [of(d) for d in product(values, repeat=k)]
            assert got[f"{label}@{k}/mean"] == pytest.approx(np.mean(every)) and got[f"{label}@{k}/std"] == pytest.approx(np.std(every))
        np.random.seed(42)
        drawn = [np.random.choice(3, size=k, replace=True) for _ in range(1000)]
        found = [majority_of([votes[i] for i in d], [values[i] for i in d]) for d in drawn]
        assert got[f"maj@{k}/mean"] == pytest.approx(np.mean(found)) and got[f"maj@{k}/std"] == pytest.approx(np.std(found))
    assert len(got) == 14


def test_bootstrap_query_draws_1000_samples(spark, tmp_path):
    spark.createDataFrame([(i, "a", float(i * i)) for i in range(9)], "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.name: (r["mean"], r["std"]) for r in catalog.queries()["bootstrap_metric"](spark, str(tmp_path)).collect()}
    np.random.seed(42)
    drawn = [np.random.choice(9, size=4, replace=True) ** 2 for _ in range(1000)]
    most = [max(d) for d in drawn]
    assert got["max"] == pytest.approx((np.mean(most), np.std(most)))


def test_lowess_ignores_an_outlier_and_follows_a_line(spark):
    from rollmill.operators.analysis import lowess

    points = [("a", float(i), 2.0 * i + 1 + (500.0 if i == 10 else 0.0)) for i in range(30)] + [("b", 1.0, 5.0), ("b", None, 1.0), ("c", 2.0, 3.0), ("c", 2.0, 5.0)]
    table = spark.createDataFrame(points, "g string, x double, y double")
    got = lowess(table, "x", "y", "g", rounds=4).collect()
    assert all(abs(r.trend - (2 * r.x + 1)) < 1e-6 for r in got if r.g == "a" and r.x != 10)
    assert {(r.g, r.trend) for r in got if r.g != "a"} == {("b", 5.0), ("c", 4.0)}
    assert lowess(table.where("false"), "x", "y", "g").count() == 0


def test_spread_percentiles_equal_the_exact_ones(spark):
    from pyspark.sql import functions as F

    from rollmill.functions import stats

    rows = [(None if i % 11 == 0 else f"g{i % 3}", float(i * 37 % 101) if i % 7 else (None if i % 2 else float("nan"))) for i in range(800)] + [("one", 4.0), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    want = table.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("_q"))
    plain = lambda df: sorted((str(r.g), [round(x, 9) for x in r._q]) for r in df.collect())
    assert plain(stats.spread_percentiles(table, "v", shares, "g")) == plain(want)
    assert stats.spread_percentiles(table, "v", [0.5]).first()._q == [want.sparkSession.table(table_name(table)).selectExpr("percentile(v, 0.5)").first()[0]]
    assert stats.spread_percentiles(table.where("false"), "v", [0.5], "g").count() == 0


def table_name(table):
    table.where("v IS NOT NULL AND NOT isnan(v)").createOrReplaceTempView("spread_values")
    return "spread_values"
