"""Each named reward by its survey entry."""

import pytest
from pyspark.sql import functions as F

from rollmill.operators import rewards as R

CASES = [
    # response, truth, boxed, answer tag, ORZ tag, after think, verified
    ("so \\boxed{\\frac{1}{2}}", "1/2", 1, 0, 0, 0, 1),
    ("<think>a</think> <answer>1/2</answer>", "\\frac{1}{2}", 0, 1, 1, 0, 1),
    ("<answer> \\boxed{7} </answer>", "7", 1, 0, 1, 0, 1),
    ("<think>\\boxed{3}</think> it is \\boxed{4}", "4", 1, 0, 0, 1, 1),
    ("<think>\\boxed{4}</think> done", "4", 1, 0, 0, 0, 1),
    ("it is 1,200", "1200", 0, 0, 0, 0, 1),
    ("so $x$ is $12$", "12", 0, 0, 0, 0, 1),
    ("nothing", "5", 0, 0, 0, 0, 0),
    ("\\boxed{5}", None, 0, 0, 0, 0, 0),
]
COLUMNS = {"dr_grpo_boxed": 2, "openr1": 2, "math_batch": 2, "dr_grpo_answer_tag": 3, "dr_grpo_answer_tag_orz": 4, "openr1_after_think": 5, "luffy": 6, "math_verify": 6}


def test_rewards_by_name(spark):
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, r string, t string")
    found = rows.select("i", *(R.scorer(name)(F.col("r"), F.col("t")).alias(name) for name in COLUMNS), *(R.openr1_step(F.col("r"), F.col("t"), s, 5).alias(f"step{s}") for s in (4, 5)))
    for got in found.collect():
        assert {n: got[n] for n in COLUMNS} == {n: CASES[got.i][k] for n, k in COLUMNS.items()}, CASES[got.i]
        assert (got.step4, got.step5) == (CASES[got.i][2], CASES[got.i][5])
