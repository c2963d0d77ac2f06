import datetime as dt
import math
import random

import numpy as np
import pytest

from rollmill.llm import percentiles as P

SCHEMA = "g string, x double, xs array<double>, at timestamp, grp int, n int, metric string, base long"
DAY = dt.datetime(2025, 3, 1)


def rank(values, percent):
    values = sorted(values)
    return values[-(-percent * len(values) // 100) - 1]


def test_order_of_keys():
    numbers = [-math.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.5, 1e300, math.inf]
    keys = P.ordered(np.array(numbers))
    assert (np.diff(keys.astype(object)) > 0).all() and P.unordered(keys).tolist() == numbers
    assert P.ordered(np.array([-0.0]))[0] == P.ordered(np.array([0.0]))[0]


@pytest.mark.parametrize("few", [0, 500_000])
def test_exact(spark, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    random.seed(4)
    rows, own = [], {}
    for i in range(900):
        g = random.choice(["a", "a", "a", "b", None])
        x = random.choice([None, math.nan, math.inf, -math.inf, -1.0, random.lognormvariate(0, 3), 0.25, 0.25])
        xs = random.choice([None, [], [None, math.nan, 1.0], [random.random() for _ in range(9)], [-0.0, 0.0]])
        rows.append((g, x, xs, DAY + dt.timedelta(hours=i), 1, 1, "m", 1))
        for m, values in (("x", [x]), ("xs", xs or [])):
            own.setdefault((g, m), []).extend(v for v in values if v is not None and not math.isnan(v))
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.g, r.metric, r.percent): (r.value, r.n_values, r.error_bound) for r in P.percentiles(table, "g", ["x", "xs"], "at").collect()}
    assert got == {(g, m, p): (rank(v, p), len(v), 0.0) for (g, m), v in own.items() if v for p in P.PERCENTS}


def test_partials_of_days_combine(spark):
    random.seed(6)
    rows = [("a", random.expovariate(1), None, DAY + dt.timedelta(hours=i), 1, 1, "m", 1) for i in range(500)]
    table = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in P.bounds_from_partials(P.partial_counts(table, "g", ["x"], "at")).collect()}
    halves = P.partial_counts(table.where("at < '2025-03-05'"), "g", ["x"], "at").unionByName(P.partial_counts(table.where("at >= '2025-03-05'"), "g", ["x"], "at"))
    assert whole == {tuple(r) for r in P.bounds_from_partials(halves).collect()}
    values = [r[1] for r in rows]
    for _, _, percent, n, low, high in whole:
        assert n == 500 and low <= rank(values, percent) <= high and high - low <= 2**-12 * abs(high)
    days: dict = {}
    for r in rows:
        days.setdefault(r[3].date(), []).append(r[1])
    daily = P.daily_bounds(P.partial_counts(table, "g", ["x"], "at")).collect()
    assert len(daily) == 7 * len(days)
    for r in daily:
        assert r.n_values == len(days[r.day]) and r.low <= rank(days[r.day], r.percent) <= r.high <= r.low * (1 + 2**-12) ** 2


def test_one_value_and_empty(spark):
    one = spark.createDataFrame([("a", 2.5, None, DAY, 1, 1, "m", 1), ("b", None, [], None, 1, 1, "m", 1)], SCHEMA)
    assert {(r.g, r.percent, r.value) for r in P.percentiles(one, "g", ["x", "xs"], "at").collect()} == {("a", p, 2.5) for p in P.PERCENTS}
    assert P.percentiles(spark.createDataFrame([], SCHEMA), "g", ["x"], "at").count() == 0
