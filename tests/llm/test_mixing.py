from pyspark.sql import functions as F
import pytest

from rollmill.llm import mixing

DOCS = "doc_id long, text string, source string, n_tokens string, weight int, epochs int"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, total_ratio double, doc_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 1) for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], TARGETS)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "one two three four five " * (1 + i % 7), "big") for i in range(300)] + [(1000 + i, "a b c d e f g h i j", "small") for i in range(10)]
    rows += [(1, "one two three four five " * 2, "big"), (5000, None, "big"), (5001, "", "small"), (5002, "no source", None), (None, "x", "big")]
    return docs(spark, rows)


def by_hand(sizes, share, ratio, most, keys):
    """Complete epochs, then documents in the order of their keys while they fit."""
    total = sum(n for _, n in sizes.values())
    own = {i: n for i, (s, n) in sizes.items() if s == keys[0]}
    budget = int(share * ratio * total + 1e-6)
    epochs = min(most, budget // sum(own.values()))
    rest = budget - epochs * sum(own.values()) if epochs < most else 0
    return epochs, rest, own


def test_shares_and_limits(spark, corpus):
    wanted = targets(spark, [("m", "big", 0.5, 1, 0.4), ("m", "small", 0.5, 4, 0.4), ("m", "none", 0.1, 2, 0.4), ("n", "big", 1.0, 3, 2.5)])
    sizes = {r.doc_id: (r.source, r.n_tokens) for r in mixing.sized(corpus).collect()}
    rows = mixing.mixed(corpus, wanted).collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    for mix, source, share, ratio, most in (("m", "big", 0.5, 0.4, 1), ("m", "small", 0.5, 0.4, 4), ("n", "big", 1.0, 2.5, 3)):
        epochs, rest, own = by_hand(sizes, share, ratio, most, [source])
        got = {r.doc_id: r.repeats for r in rows if r.mix_name == mix and r.source == source}
        assert max(got.values()) <= most and (epochs == 0 or set(got) == set(own))
        extra = sum(own[i] for i, k in got.items() if k > epochs)
        assert extra <= rest and (rest == 0 or extra == rest or any(extra + own[i] > rest for i in own if got.get(i, 0) <= epochs))
    report = {(r.mix_name, r.source): r for r in mixing.shares(corpus, wanted).collect()}
    assert report["m", "none"].tokens == 0 and report["m", "none"].actual_share == 0
    assert abs(sum(r.actual_share for k, r in report.items() if k[0] == "m") - 1) < 1e-9


def test_draws_follow_prefix_of_keys(spark, corpus, monkeypatch):
    wanted = targets(spark, [("m", "big", 0.3, 1, 1.0)])
    fine = {(r.doc_id, r.repeats) for r in mixing.mixed(corpus, wanted).collect()}
    monkeypatch.setattr(mixing, "INTERVALS", 3)
    assert {(r.doc_id, r.repeats) for r in mixing.mixed(corpus.repartition(7), wanted).collect()} == fine


def test_weights_change_probabilities(spark):
    rows = [(i, "plain words of a text that the tokenizer knows well" if i % 2 else "qzxv jqkw zxqj " * 3, "s") for i in range(600)]
    got = [r.doc_id for r in mixing.mixed(docs(spark, rows), targets(spark, [("m", "s", 0.3, 1, 1.0)])).collect()]
    good = sum(i % 2 for i in got)
    assert good > 1.3 * (len(got) - good)


def test_defective_targets_and_empty_tables(spark, corpus):
    odd = targets(spark, [(None, "big", 1.0, 1, 1.0), ("m", None, 1.0, 1, 1.0), ("m", "big", None, 1, 1.0), ("m", "small", 0.5, None, 1.0), ("k", "big", -1.0, 2, 1.0)])
    assert mixing.mixed(corpus, odd).count() == 0
    assert mixing.mixed(docs(spark, []), targets(spark, [("m", "big", 1.0, 1, 1.0)])).count() == 0
    assert mixing.mixed(corpus, targets(spark, [])).count() == 0


def test_intervals_are_even_for_any_weights(spark):
    """Of weights all at the floor, or mixed, no interval in which a budget may end holds over a hundredth of the source."""
    for weight in ("0.1D", "CASE WHEN id % 3 = 0 THEN 0.1D WHEN id % 3 = 1 THEN 0.33D ELSE 1.0D END"):
        sizes = spark.range(40_000).selectExpr("id AS doc_id", "'s' AS source", "1L AS n_tokens", f"{weight} AS weight")
        keyed = sizes.crossJoin(mixing.weight_shares(sizes).select("weights")).selectExpr("*", "-ln((pmod(xxhash64(doc_id), 1048576) + 0.5) / 1048576) / weight AS sample_key")
        most = keyed.select(mixing.interval_of(F.col("sample_key"), F.col("weights")).alias("i")).groupBy("i").count().agg(F.max("count")).first()[0]
        assert most <= 400
