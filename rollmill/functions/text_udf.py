"""Text functions that need a loop over characters, in Arrow batches."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def boxed(text: str | None) -> str | None:
    """The last \\boxed{…} or \\fbox{…} with balanced braces, wrapper included; "\\boxed x" goes up to the next "$"."""
    if text is None:
        return None
    start = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if start < 0:
        return None
    if text.startswith("\\boxed ", start):
        return text[start:].split("$", 1)[0]
    depth = 0
    for place in re.finditer(r"[{}]", text[start:]):
        depth += 1 if place.group() == "{" else -1
        if depth <= 0:
            return text[start : start + place.end()] if depth == 0 else None
    return None


def unboxed(box: str | None) -> str | None:
    if box is None:
        return None
    if box.startswith("\\boxed "):
        return box[7:]
    inside = re.fullmatch(r"\\(?:boxed|fbox)\{(.*)\}", box, re.DOTALL)
    return inside[1] if inside else None


#: What simple LaTeX normalisation replaces first, in order; fixed values.
_PLAIN = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]


def plain_latex(text: str | None) -> str | None:
    """A LaTeX answer in one form: one kind of fraction, no units, degrees, percent signs or blanks, leading zeros, braces
    after sqrt and frac, the right side of "x = …", a/b as a fraction."""
    if text is None:
        return None
    for before, after in _PLAIN:
        text = text.replace(before, after)
    text = text.split("\\text{ ", 1)[0].replace("\\%", "")
    text = re.sub(r"(^|[ {])\.", r"\g<1>0.", text)
    left, sign, right = text.partition("=")
    if sign and "=" not in right and len(left) <= 2:
        text = right
    text = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text).replace(" ", "")
    text = re.sub(r"\\frac([^{\\])(\{|[^{\\])", lambda m: f"\\frac{{{m[1]}}}{m[2] if m[2] == '{' else '{' + m[2] + '}'}", text)
    if text == "0.5":
        return "\\frac{1}{2}"
    ratio = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", text)
    return f"\\frac{{{ratio[1]}}}{{{ratio[2]}}}" if ratio else text


def value_of(text: str) -> Fraction | None:
    """Number of a plain decimal, percentage or simple fraction."""
    text = re.sub(r"\\frac\{(-?\d+)\}\{(-?\d+)\}", r"\1/\2", text.replace(",", "").strip("$ "))
    text = text.removesuffix("\\%").removesuffix("%")
    if not re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)(?:/-?\d+)?", text):
        return None
    top, _, bottom = text.partition("/")
    return None if bottom and not int(bottom) else Fraction(top) / int(bottom or 1)


def same_answer(answer: str | None, truth: str | None, relative: float = 1e-4, percent: bool = True) -> bool:
    """Tiers: equal plain LaTeX, equal numbers (with ``percent`` also times or over 100), then pairs and tuples element by element. Symbolic
    algebra isn't attempted."""
    if answer is None or truth is None:
        return answer is truth
    a, b = plain_latex(answer), plain_latex(truth)
    if a == b:
        return True
    if a[:1] in "([" and b[:1] in "([" and a[-1:] in ")]" and b[-1:] in ")]" and (a[0], a[-1]) == (b[0], b[-1]):
        x, y = a[1:-1].split(","), b[1:-1].split(",")
        return len(x) == len(y) and all(same_answer(p, q, relative, percent) for p, q in zip(x, y))
    p, q = value_of(a), value_of(b)
    if p is None or q is None:
        return False
    return any(abs(p - r) <= Fraction(relative) * max(abs(p), abs(r)) for r in ((q, q / 100, q * 100) if percent else (q,)))


def boxed_reward(response: str, truth: str) -> bool:
    """The last box against the truth."""
    answer = unboxed(boxed(response))
    return answer is not None and same_answer(answer, truth)


def answer_tag_reward(response: str, truth: str, opening: str = "</think> <answer>") -> bool:
    """What the last answer tag holds, or its box. ``opening`` must occur: the strict form wants the tag right after the
    think block, the ORZ form ("<answer>") anywhere."""
    if opening not in response or "</answer>" not in response:
        return False
    answer = response.split("<answer>")[-1].replace("</answer>", "")
    return boxed_reward(answer, truth) if "\\boxed" in answer else same_answer(answer.strip(), truth)


def after_think_boxed_reward(response: str, truth: str) -> bool:
    """The box after the first closed think block."""
    found = re.search(r"<think>.*?</think>(.*)", response, re.DOTALL)
    return found is not None and boxed_reward(found[1].strip(), truth)


def step_reward(response: str, truth: str, step: int, after: int) -> bool:
    """From step ``after`` on only what follows the think block counts."""
    return (after_think_boxed_reward if step >= after else boxed_reward)(response, truth)


def verified_reward(response: str, truth: str) -> bool:
    """The last box, else the number after the first "#### ", else the last formula, else the last number."""
    answer = unboxed(boxed(response))
    if answer is None and (marked := re.search(r"#### (-?[0-9.,]+)", response)):
        answer = marked[1].replace(",", "")
    if answer is None:
        formulas = re.findall(r"\$\$(.+?)\$\$|\$(.+?)\$|\\\((.+?)\\\)|\\\[(.+?)\\\]", response, re.DOTALL)
        answer = next(x for x in formulas[-1] if x).strip() if formulas else next(iter(re.findall(r"-?\d[\d,]*(?:\.\d+)?(?:/\d+)?%?", response)[-1:]), None)
    return answer is not None and same_answer(answer, truth, percent=False)


def repeated_share(text: str | None) -> float:
    """2 sum(LCP) / (n (n + 1)) over the sorted suffixes: the share of substrings that occurred before. Their number is all
    substrings less the distinct ones, which a suffix automaton counts in one pass."""
    n = len(text or "")
    if n <= 1:
        return 0.0
    longest, link, follow = [0], [-1], [{}]
    last, distinct = 0, 0
    for char in text:
        state = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        follow.append({})
        at = last
        while at >= 0 and char not in follow[at]:
            follow[at][char] = state
            at = link[at]
        if at >= 0:
            to = follow[at][char]
            if longest[at] + 1 == longest[to]:
                link[state] = to
            else:
                twin = len(longest)
                longest.append(longest[at] + 1)
                link.append(link[to])
                follow.append(dict(follow[to]))
                while at >= 0 and follow[at].get(char) == to:
                    follow[at][char] = twin
                    at = link[at]
                link[to] = link[state] = twin
        distinct += longest[state] - longest[link[state]]
        last = state
    everything = n * (n + 1) // 2
    return (everything - distinct) / everything


def _of_texts(function, kind: str, texts: Column) -> Column:
    # made when asked for: a UDF needs a session
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([function(v) for v in values], dtype=object if kind == "string" else None)

    return run(texts)


def last_boxed(texts: Column) -> Column:
    return _of_texts(boxed, "string", texts)


def boxed_answer(texts: Column) -> Column:
    return _of_texts(lambda t: unboxed(boxed(t)), "string", texts)


def latex_form(texts: Column) -> Column:
    return _of_texts(plain_latex, "string", texts)


def repeatness(texts: Column) -> Column:
    return _of_texts(repeated_share, "double", texts)


def rewarded(function, responses: Column, truths: Column) -> Column:
    """1 where ``function`` of response and truth holds, else 0; a null truth is never met, a null response has no score."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else float(t is not None and function(r, t)) for r, t in zip(left, right)], dtype="float64")

    return run(responses, truths)


def answers_equal(answers: Column, truths: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([same_answer(a, b) for a, b in zip(left, right)])

    return run(answers, truths)
