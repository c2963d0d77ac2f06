"""Literal and hand-derived values of array, statistics, schedule and text functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.functions import objectives as O
from rollmill.functions import schedules as S
from rollmill.functions import stats
from rollmill.functions import text as T
from rollmill.functions import text_udf as U
from rollmill.operators import advantages as V
from rollmill.operators import balance as B
from rollmill.operators import dispatch as D
from rollmill.operators import metrics as M


def value(spark, make, **columns):
    names = list(columns)
    frame = spark.createDataFrame([tuple(columns.values())], names) if names else spark.range(1)
    return frame.select(make().alias("v")).first().v


def test_gae(spark):
    assert value(spark, lambda: A.gae("r", "v", 1.0, 0.95), r=[1.0, 0.0, 2.0], v=[0.5] * 3) == pytest.approx([2.35375, 1.425, 1.5])


@pytest.mark.parametrize("ids, end, want", [([20, 10, 34, 1, 0, 0, 0], 1, [1, 1, 1, 1, 0, 0, 0]), ([78, 0, 76, 2, 1, 0, 0], [1, 2], [1, 1, 1, 1, 0, 0, 0]), ([23, 98, 1, 0, 0, 0, 0], 1, [1, 1, 1, 0, 0, 0, 0]), ([3, 3], 1, [1, 1])])
def test_response_mask(spark, ids, end, want):
    assert value(spark, lambda: A.response_mask("a", end), a=ids) == want


def test_scans_and_shapes(spark):
    assert value(spark, lambda: A.suffix_sum("a"), a=[1.0, 2.0, 3.0]) == [6.0, 5.0, 3.0]
    assert value(spark, lambda: A.discounted_suffix_sum("r", "m", 0.5), r=[1.0, 1.0, 4.0], m=[1, 1, 0]) == [1.5, 1.0, 4.0]
    assert value(spark, lambda: A.position_ids("m"), m=[0, 0, 1, 1, 0, 1]) == [0, 0, 0, 1, 1, 2]
    assert value(spark, lambda: A.truncate("a", 3, "middle"), a=[1, 2, 3, 4, 5]) == [1, 4, 5]
    assert value(spark, lambda: A.truncate("a", 3, "left"), a=[1, 2, 3, 4, 5]) == [3, 4, 5]
    with pytest.raises(Exception, match="limit 3"):
        value(spark, lambda: A.truncate("a", 3, "error"), a=[1, 2, 3, 4, 5])
    assert value(spark, lambda: A.pad("a", 4, left=True), a=[1, 2]) == [0, 0, 1, 2]
    assert value(spark, lambda: A.strip_left("a", 0), a=[0, 0, 3, 0, 4]) == [3, 0, 4]
    assert value(spark, lambda: A.prefix_length(F.size("a"), F.lit(0.99), 2), a=[1, 2, 3]) == 2


def test_logits(spark):
    logits = [1.0, 2.0, 1000.0]
    assert value(spark, lambda: A.log_sum_exp("a"), a=logits) == pytest.approx(1000.0)
    p = [math.exp(x) / sum(map(math.exp, [0.1, 0.7, 0.2])) for x in [0.1, 0.7, 0.2]]
    assert value(spark, lambda: A.entropy_of("a"), a=[0.1, 0.7, 0.2]) == pytest.approx(-sum(x * math.log(x) for x in p))


def test_group_advantages(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 5.0)], "uid string, score double")
    got = lambda df: sorted(round(r.advantage, 5) for r in df.collect())
    assert got(V.grpo(rows, "score", "uid")) == [round(-1 / (math.sqrt(2) + 1e-6), 5), round(1 / (math.sqrt(2) + 1e-6), 5), round(5 / (1 + 1e-6), 5)]
    assert got(V.rloo(rows, "score", "uid")) == [-2.0, 2.0, 5.0] and got(V.dr_grpo(rows, "score", "uid")) == [-1.0, 1.0, 5.0]
    with pytest.raises(NotImplementedError):
        V.estimate(rows, "other")


def test_prefix_without_plain_rollouts(spark):
    rows = spark.createDataFrame([("g", "p", 1.0), ("g", "p", 2.0)], "uid string, prefix_uid string, score double")
    assert [r.prefix_advantage for r in V.prefixed(rows, "score", "uid", "prefix_uid", 4, "dr_grpo_v2").collect()] == [None, None]


def test_moments_need_two_tokens(spark):
    one = spark.createDataFrame([([1.0, 2.0], [1, 0])], "x array<double>, m array<int>")
    assert stats.masked_moments(one, "x", "m").first().variance is None


def test_schedules(spark):
    steps = spark.range(5).orderBy("id")
    at = lambda c: [r.v for r in steps.select(c.alias("v")).collect()]
    assert at(S.lr_constant(F.col("id"), 2) * 1e-3) == pytest.approx([0, 0.0005, 0.001, 0.001, 0.001])
    assert at(S.lr_cosine(F.col("id"), 2, 5, 0.1) * 1e-3) == pytest.approx([0.0001, 0.00055, 0.001, 0.000775, 0.000325])
    assert S.AdaptiveKl(0.1, 0.1, 100).update(0.2, 10) == pytest.approx(0.102)


def test_policy_clips(spark):
    got = value(spark, lambda: O.policy_terms(F.col("lp"), F.col("old"), F.col("a")), lp=math.log(2.0), old=0.0, a=1.0)
    assert (got.loss, got.clipped) == (-1.2, 1.0)
    got = value(spark, lambda: O.policy_terms(F.col("lp"), F.col("old"), F.col("a")), lp=math.log(9.0), old=0.0, a=-1.0)
    assert (got.loss, got.clipped_low) == (3.0, 1.0)


def test_numbers(spark):
    text = lambda s, make: value(spark, lambda: make(F.col("t")), t=s)
    assert text("x #### 1,234", T.number_strict) == "1234" and text("no marker 7", T.number_strict) is None
    assert text("a 3 then 4.", T.number_flexible) == "4." and text("Answer: 3\nAnswer: 4", T.minerva_answer) == "4" and text("none", T.minerva_answer) == "[INVALID]"
    assert text("<think>a</think> b", T.after_think) == "b" and text("no block", T.after_think) == ""
    assert text("a b a b", lambda c: T.ngram_penalty(c, 2, -1.0)) == pytest.approx(-(1 - 2 / 3))
    assert value(spark, lambda: T.overlong_penalty(F.col("n"), 120, 20, 1.0), n=120) == -1.0
    assert text("x = 1,000 dollars", T.normal_answer) == "1000" and text("\\frac12", T.normal_answer) == "\\frac{1}{2}"
    assert text("<think>\nx\n</think>\n<answer>\ny\n</answer>", T.tag_count) == 1.0


def test_boxes_and_latex():
    assert U.boxed("so \\boxed{\\frac{1}{2}}") == "\\boxed{\\frac{1}{2}}" and U.unboxed(U.boxed("\\boxed{\\frac{1}{2}}.")) == "\\frac{1}{2}"
    assert U.boxed("\\boxed{1} then \\boxed{2}") == "\\boxed{2}" and U.boxed("none") is None and U.boxed("\\boxed{1") is None and U.boxed("\\boxed 5$ is") == "\\boxed 5"
    for given, want in (("\\dfrac12", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("x=7", "7"), ("\\sqrt3", "\\sqrt{3}"), ("10\\text{ cm}", "10"), ("", ""), ("\\left(1, 2\\right)", "(1,2)"), ("90^\\circ", "90")):
        assert U.plain_latex(given) == want, given
    assert U.same_answer("0.5", "\\frac{1}{2}") and U.same_answer("50\\%", "0.5") and U.same_answer("(1, 0.5)", "(1,1/2)") and not U.same_answer("2", "3")


def test_repeated_share_by_brute_force():
    random.seed(3)
    for _ in range(60):
        s = "".join(random.choice("ab") for _ in range(random.randint(2, 12)))
        n = len(s)
        order = sorted(s[i:] for i in range(n))
        lcp = sum(next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(order, order[1:]))
        assert U.repeated_share(s) == pytest.approx(2 * lcp / (n * (n + 1)))
    assert U.repeated_share("") == U.repeated_share("a") == 0.0


def test_reduce_and_majority(spark):
    rows = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_r", 5.0), ("max_r", 8.0), ("min_e", 0.1), ("min_e", 0.05), ("max_min", 1.0), ("max_min", 2.0)], "name string, value double")
    assert {r.name: r.value for r in M.reduce_metrics(rows).collect()} == {"loss": 2.0, "max_r": 8.0, "min_e": 0.05, "max_min": 2.0}
    votes = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2), (2, "C", 0.4, 0), (2, "D", 0.3, 1)], "k int, pred string, val double, pos int")
    assert {r.k: r.majority for r in M.majority(votes, ["k"], "pred", "val", "pos").collect()} == {1: 0.9, 2: 0.4}


def test_best_of_two(spark):
    assert value(spark, lambda: stats.best_of_k(F.col("v"), 2), v=[0.1, 0.5, 0.9]) == pytest.approx(0.6777777)


def test_validation(spark):
    rows = spark.createDataFrame([("s1", "p1", 0.8, 0), ("s1", "p1", 0.9, 1), ("s2", "p2", 0.7, 2)], "source string, prompt string, v double, pos int")
    got = {(r.source, r.name): r.value for r in M.validation(rows, "source", "prompt", "v", "pos").collect()}
    assert got["s1", "mean@2"] == pytest.approx(0.85) and got["s2", "mean@1"] == pytest.approx(0.7) and ("s2", "std@1") not in got


def test_timing(spark):
    rows = spark.createDataFrame([(3, 3), (3, 3)], "prompt_length int, response_length int")
    got = {r.name: r.value for r in M.timing(rows, {"gen": 0.5, "ref": 0.3, "values": 0.2}).collect()}
    assert got["timing_per_token_ms/gen"] == pytest.approx(500 / 6) and got["timing_per_token_ms/ref"] == pytest.approx(300 / 12) and got["timing_s/values"] == 0.2
    fast = spark.createDataFrame([(300, 300)], "prompt_length int, response_length int")
    assert M.throughput(fast, 2.0, 1).first().throughput == 300 and M.throughput(fast, 2.0, 2).first().throughput == 150


@pytest.mark.parametrize("equal", [False, True])
def test_balance(equal):
    random.seed(1)
    lengths = [random.randint(1, 90) for _ in range(24)]
    sets = B.largest_differencing(lengths, 4, equal)
    assert sorted(i for s in sets for i in s) == list(range(24)) and all(sets) and all(s == sorted(s) for s in sets)
    sums = [sum(lengths[i] for i in s) for s in sets]
    assert max(sums) - min(sums) <= max(lengths) and (not equal or {len(s) for s in sets} == {6})
    assert sorted(i for s in B.least_loaded(lengths, 4) for i in s) == list(range(24))
    assert len(B.micro_batches(lengths, 300)) == -(-sum(lengths) // 300)
    with pytest.raises(ValueError):
        B.largest_differencing([1], 2)


def test_dispatch_and_time_limit(spark):
    with pytest.raises(NotImplementedError):
        D.dispatched(spark.range(1), lambda d: d, "nowhere")
    with pytest.raises(ValueError):
        D.register_mode("all_to_all", lambda *x: None)
    assert D.limited(5)(lambda: 3)() == 3
    import time

    with pytest.raises(TimeoutError):
        D.limited(0.05)(lambda: time.sleep(2))()
    with pytest.raises(ValueError):
        B.admitted({"a": 9}, {"n": 8})
