"""Reward functions by name or from a file, and how they run: whole batches, with a time limit, as a score joined later."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import text, text_udf
from rollmill.operators.dispatch import limited

#: Native scorers: functions of (response, truth) columns.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "gsm8k": lambda response, truth: text.graded(text.number_strict(response), truth),
    "minerva": lambda response, truth: text.dapo_score(response, truth)["score"],
    "boxed": lambda response, truth: F.when(text.simple_boxed(response) == truth, 1.0).otherwise(0.0),
    "boxed_any": lambda response, truth: F.when(text_udf.answers_equal(text_udf.boxed_answer(response), truth), 1.0).otherwise(0.0),
    "math_batch": lambda response, truth: text_udf.rewarded(text_udf.boxed_reward, response, truth),
    "dr_grpo_boxed": lambda response, truth: text_udf.rewarded(text_udf.boxed_reward, response, truth),
    "dr_grpo_answer_tag": lambda response, truth: text_udf.rewarded(text_udf.answer_tag_reward, response, truth),
    "dr_grpo_answer_tag_orz": lambda response, truth: text_udf.rewarded(partial(text_udf.answer_tag_reward, opening="<answer>"), response, truth),
    "openr1": lambda response, truth: text_udf.rewarded(text_udf.boxed_reward, response, truth),
    "openr1_after_think": lambda response, truth: text_udf.rewarded(text_udf.after_think_boxed_reward, response, truth),
    "luffy": lambda response, truth: text_udf.rewarded(text_udf.verified_reward, response, truth),
    "math_verify": lambda response, truth: text_udf.rewarded(text_udf.verified_reward, response, truth),
}


def openr1_step(response: Column, truth: Column, step: int, after: int) -> Column:
    """``openr1`` before step ``after``, ``openr1_after_think`` from there on."""
    return text_udf.rewarded(partial(text_udf.step_reward, step=step, after=after), response, truth)


def scorer(name: str) -> Callable[[Column, Column], Column]:
    if name not in SCORERS:
        raise NotImplementedError(name)
    return SCORERS[name]


def from_file(path: str, name: str, **bound) -> Callable:
    """The function ``name`` of a Python file, with named arguments bound."""
    spec = importlib.util.spec_from_file_location("reward_function", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return partial(getattr(module, name), **bound) if bound else getattr(module, name)


def by_row(function: Callable[[str, str], float], response: Column, truth: Column, seconds: float | None = None, failed: float = 0.0) -> Column:
    """A Python function of one response and truth; an error or a call over ``seconds`` scores ``failed``. Tasks run beside
    each other, so it needs no pool of its own."""

    @F.pandas_udf("double")
    def run(responses: pd.Series, truths: pd.Series) -> pd.Series:
        call = limited(seconds)(function) if seconds else function
        out = []
        for r, t in zip(responses, truths):
            try:
                out.append(float(call(r, t)))
            except Exception:
                out.append(failed)
        return pd.Series(out, dtype="float64")

    return run(response, truth)


def by_batch(function: Callable[[list, list], list], response: Column, truth: Column) -> Column:
    """A Python function of lists."""

    @F.pandas_udf("double")
    def run(responses: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series(function(responses.tolist(), truths.tolist()), dtype="float64")

    return run(response, truth)


def with_rewards(df: DataFrame, name: str, response: str, truth: str, column: str = "score") -> DataFrame:
    """``df`` with its score; a column of that name that is there already stays."""
    return df if column in df.columns else df.withColumn(column, scorer(name)(F.col(response), F.col(truth)))
