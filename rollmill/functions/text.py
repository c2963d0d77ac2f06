"""Answer extraction and text scores as native expressions. A score of a null text is null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9.,]+)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def count_of(text: Column, piece: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def number_strict(text: Column) -> Column:
    """After the first "#### ", without commas and dollar signs; null if there is none."""
    return F.translate(_found(text, f"#### {NUMBER}"), ",$", "")


def number_flexible(text: Column) -> Column:
    """The last number that is more than a point; if all are points, the first of them."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    good = F.filter(found, lambda x: (x != "") & (x != "."))
    return F.when(F.size(good) > 0, F.element_at(good, -1)).otherwise(F.try_element_at(found, F.lit(1)))


def graded(answer: Column, truth: Column, right: float = 1.0, wrong: float = 0.0) -> Column:
    """``right`` if equal, ``wrong`` if another answer was found, 0 without answer."""
    return F.when(answer.isNull(), 0.0).when(answer == truth, right).otherwise(wrong)


def minerva_answer(text: Column) -> Column:
    """What follows the last "Answer:" of a line, else [INVALID]."""
    return F.coalesce(last_match(text, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))


#: Replacements and removals of answer normalisation, in the order in which they apply. Fixed values.
MINERVA_REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
MINERVA_REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]


def normal_answer(answer: Column) -> Column:
    """What follows the last "=", without units and spacing, unwrapped, with braces after frac and sqrt, without thousands
    separators in a whole number."""
    out = F.element_at(F.split(answer, "="), -1)
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), [*MINERVA_REPLACED, *((x, "") for x in MINERVA_REMOVED)], out)
    for pattern, by in (
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        (r"\\text\{(.*?)\}", "$1"),
        (r"\\textbf\{(.*?)\}", "$1"),
        (r"\\overline\{(.*?)\}", "$1"),
        (r"\\boxed\{(.*)\}", "$1"),
        (r"frac([^{])(.)", r"frac{$1}{$2}"),
        (r"sqrt([^{])", r"sqrt{$1}"),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = F.replace(out, F.lit("$"), F.lit(""))
    return F.trim(F.when(F.replace(out, F.lit(","), F.lit("")).rlike("^[0-9]+$"), F.replace(out, F.lit(","), F.lit(""))).otherwise(out))


def dapo_score(text: Column, truth: Column) -> Column:
    """Struct ``score`` (1 or -1), ``acc``, ``pred``, from the last 300 characters."""
    pred = normal_answer(minerva_answer(F.right(text, F.lit(300))))
    return F.struct(F.when(pred == truth, 1.0).otherwise(-1.0).alias("score"), F.coalesce(pred == truth, F.lit(False)).alias("acc"), pred.alias("pred"))


def simple_boxed(text: Column) -> Column:
    """The last box whose content has no braces; nested ones need ``text_udf.last_boxed``."""
    return last_match(text, r"\\(?:boxed|fbox)\{([^{}]*)\}")


def after_think(text: Column) -> Column:
    """What follows the first closed think block, trimmed; empty without one."""
    return F.trim(F.regexp_extract(text, r"(?s)<think>.*?</think>(.*)", 1), F.lit(" \t\n\r"))


def assistant_span(text: Column, start: str, end: str) -> Column:
    """The last text between two markers; empty without them."""
    return F.coalesce(last_match(text, rf"(?s)\Q{start}\E(.*?)\Q{end}\E"), F.lit(""))


def think_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>"), 1.0).otherwise(0.0)


def think_boxed_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


#: Tags that each give a quarter if they occur exactly once; fixed values.
THINK_TAGS = ["<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>"]


def tag_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(count_of(text, tag) == 1, 0.25).otherwise(0.0) for tag in THINK_TAGS])


#: Marks of steps and of reflection; fixed values.
STEP_MARKS = r"(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
REFLECTION_MARKS = [r"wait,", r"recheck[,\s]", r"retry", r"alternatively,", r"however,"]


def reasoning_steps(text: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(STEP_MARKS)) / 3)


def reflection_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in REFLECTION_MARKS])


def with_value(value: Column, make) -> Column:
    """``make(value)`` with the value computed once; inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), make), 1)


def ngram_penalty(text: Column, n: int, most: float) -> Column:
    """(1 - distinct share of the word n-grams, lower-cased) times ``most``; 0 for fewer than n words."""

    def grams(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))

    def share(found: Column) -> Column:
        return (1 - F.size(F.array_distinct(found)) / F.size(found)) * most

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return with_value(words, lambda w: F.when(F.size(w) < n, 0.0).otherwise(with_value(grams(w), share)))


def code_block(text: Column, language: str = "python") -> Column:
    """The last fenced block; empty without one."""
    return F.coalesce(last_match(text, rf"(?s)```{language}\n(.*?)```"), F.lit(""))


def code_format(text: Column, language: str = "python") -> Column:
    return F.when(text.rlike(rf"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?```{language}.*?```.*?\n</answer>$"), 1.0).otherwise(0.0)


def cosine_reward(length: Column, correct: Column, longest: int, right=(0.5, 1.0), wrong=(-1.0, -0.5)) -> Column:
    """From the high to the low bound along half a cosine of the length; for wrong answers from the low to the high bound."""
    wave = 1.0 + F.cos(length / longest * 3.141592653589793)
    at = lambda low, high: F.lit(low) + 0.5 * (high - low) * wave
    return F.when(correct, at(*right)).otherwise(at(wrong[1], wrong[0]))


def length_reward(length: Column, correct: Column, least: Column, most: Column) -> Column:
    """1/2 less the place between the shortest and longest of the batch; at most 0 for wrong answers; 0 if all are alike."""
    share = 0.5 - (length - least) / F.nullif(most - least, F.lit(0))
    return F.when(most == least, 0.0).otherwise(F.when(correct, share).otherwise(F.least(F.lit(0.0), share)))


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (longest - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def three_level(has_format: Column, correct: Column, bad: float = -1.0, wrong: float = 0.0, right: float = 1.0) -> Column:
    return F.when(~has_format, bad).when(correct, right).otherwise(wrong)


def same_number(a: Column, b: Column, relative: float = 1e-4) -> Column:
    """Equal as numbers, also as a percentage either way; null-safe false if either is none."""
    x, y = (F.expr("1").cast("double") * F.regexp_replace(c, "[,$%]", "").try_cast("double") for c in (a, b))
    near = lambda p, q: F.abs(p - q) <= relative * F.greatest(F.abs(p), F.abs(q))
    return F.coalesce(near(x, y) | near(x, y / 100) | near(x, y * 100), F.lit(False))


def lines_equal(output: Column, expected: Column) -> Column:
    """Equal after trimming, as a whole or line by line."""
    trimmed = lambda c: F.array_join(F.transform(F.split(F.trim(c), "\n"), lambda l: F.trim(l)), "\n")
    return (F.trim(output) == F.trim(expected)) | (trimmed(output) == trimmed(expected))


def sandbox_code(api_ok: Column, compile_status: Column, run_status: Column, exit_code: Column, output: Column, expected: Column) -> Column:
    """1 right, 0 wrong, -1 service or other error, -2 runtime error, -3 time limit, -4 compile error."""
    return (
        F.when(~F.coalesce(api_ok, F.lit(False)), -1)
        .when(compile_status == "Error", -4)
        .when((compile_status == "TimeLimitExceeded") | (run_status == "TimeLimitExceeded"), -3)
        .when((run_status == "Error") | (exit_code != 0), -2)
        .when(run_status == "Finished", lines_equal(output, expected).cast("int"))
        .otherwise(-1)
    )


def pass_rate(results: Column, most: int | None = None) -> Column:
    """Share of 1 among the results (the first ``most``); 0 without any."""
    own = F.slice(results, 1, most) if most else results
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda r: r == 1)) / F.size(own)).otherwise(0.0)


def log_values(line: Column) -> Column:
    """Map of a line "k:v - k:v"."""
    return F.transform_values(F.str_to_map(line, F.lit(" - "), F.lit(":")), lambda _, v: F.trim(v).try_cast("double"))
