"""Building, filtering and sampling of prompt/response tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions import arrays as A

#: The record of a prompt with its graded answer.
RL_SCHEMA = (
    "data_source string, prompt array<struct<role:string,content:string>>, ability string, reward_model struct<style:string,ground_truth:string>, "
    "extra_info struct<split:string,index:bigint,answer:string,question:string>"
)


def n_words(text: Column) -> Column:
    """Blank-separated words; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_text(messages: str | Column, generation_prompt: bool = False) -> Column:
    """Messages in the im_start/im_end form, one after the other; null contents are empty."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    text = F.array_join(parts, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation_prompt else text


def filter_overlong(df: DataFrame, messages: str, limit: int, count=n_words) -> DataFrame:
    """Rows whose prompt text has at most ``limit`` tokens by ``count``."""
    return df.where(count(chat_text(messages, True)) <= limit)


def filter_has_items(df: DataFrame, items: str) -> DataFrame:
    return df.where(F.size(items) > 0)


def filter_no_long_item(df: DataFrame, lengths: str, limit: int) -> DataFrame:
    """Without rows of which any item is longer."""
    return df.where(~F.exists(lengths, lambda n: F.coalesce(n > limit, F.lit(False))))


def keep_short_items(df: DataFrame, items: str, lengths: str, flags: str, limit: int) -> DataFrame:
    """Parallel lists without items of ``limit`` or more, with their count and mean flag, -1 for none left."""
    kept = F.filter(F.arrays_zip(F.col(items).alias("i"), F.col(lengths).alias("n"), F.col(flags).alias("f")), lambda x: x["n"] < limit)
    out = df.withColumn("_kept", kept)
    new_flags = F.transform("_kept", lambda x: x["f"])
    return (
        out.withColumn(items, F.transform("_kept", lambda x: x["i"]))
        .withColumn(lengths, F.transform("_kept", lambda x: x["n"]))
        .withColumn(flags, new_flags)
        .withColumn("num_demo", F.size("_kept"))
        .withColumn("avg_correctness", F.when(F.size("_kept") == 0, -1.0).otherwise(A.mean(new_flags)))
        .drop("_kept")
    )


def keep_correct(items: str, flags: str) -> Column:
    return F.transform(F.filter(F.arrays_zip(F.col(items).alias("i"), F.col(flags).alias("f")), lambda x: x["f"] > 0), lambda x: x["i"])


def first_correct(df: DataFrame, items: str, flags: str) -> DataFrame:
    """The first correct item alone, the list before as ``old_<items>``; rows with none are dropped."""
    correct = keep_correct(items, flags)
    return df.withColumn(f"old_{items}", F.col(items)).withColumn(items, F.slice(correct, 1, 1)).where(F.size(items) > 0)


def rl_record(source: str, question: Column, answer: Column, truth: Column, ability: str, split: Column, index: Column, suffix: str = "") -> list[Column]:
    """The columns of RL_SCHEMA."""
    return [
        F.lit(source).alias("data_source"),
        F.array(message("user", F.concat(question, F.lit(suffix)))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(split.alias("split"), index.cast("bigint").alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info"),
    ]


def tool_record(source: str, question: Column, answer: Column, truth: Column, tool: str, system: str) -> list[Column]:
    """As ``rl_record``, with a system message and the arguments that a tool gets."""
    base = rl_record(source, question, answer, truth, "math", F.lit("train"), F.lit(0))
    tools = F.create_map(F.lit(tool), F.struct(F.struct(truth.alias("ground_truth")).alias("create_kwargs")))
    base[1] = F.array(message("system", F.lit(system)), message("user", question)).alias("prompt")
    base[4] = F.struct(answer.alias("answer"), question.alias("question"), F.lit(True).alias("need_tools_kwargs"), tools.alias("tools_kwargs")).alias("extra_info")
    return base


def clean_choice_text(text: Column) -> Column:
    """Stripped; a title mark becomes a full stop, other bracketed marks go, double blanks become one."""
    return F.replace(F.regexp_replace(F.replace(F.trim(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def rewritten_prompt(system: str | None, user: Column, suffix: str) -> Column:
    last = message("user", F.concat(user, F.lit(suffix)))
    return F.array(message("system", F.lit(system)), last) if system is not None else F.array(last)


def segments(content: Column) -> Column:
    """Typed pieces of a content with <image> and <video> marks, empty texts included."""
    parts = F.split(content, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), p.alias("text")))


def chosen_item(items: str, *identity: Column) -> Column:
    """One item by hash of the identity; null for an empty list."""
    n = F.size(items)
    return F.when(n > 0, F.element_at(items, (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *identity)), 1, 8), 16, 10).cast("bigint"), F.greatest(n, F.lit(1))) + 1).cast("int")))


def order_key(seed: int, *identity: str) -> Column:
    """A random-like order that any engine can give again."""
    return F.md5(F.concat_ws("|", *identity, F.lit(str(seed))))


def head(df: DataFrame, k: int, seed: int, *identity: str) -> DataFrame:
    """``k`` rows of a random-like order."""
    return df.orderBy(order_key(seed, *identity), *identity).limit(k)


def stratified(df: DataFrame, level: str, k: int, seed: int, *identity: str, strict: bool = False) -> DataFrame:
    """``k`` rows of each level in a random-like order; short levels give what they have, or an error if ``strict``.

    A level of any size is first cut to its ``k`` least in each of 64 parts, so none is sorted as a whole.
    """
    keyed = df.withColumn("_key", order_key(seed, *identity))
    part = F.pmod(F.xxhash64(*identity), F.lit(64))
    first = F.row_number().over(Window.partitionBy(level, part).orderBy("_key", *identity))
    best = keyed.withColumn("_place", first).where(F.col("_place") <= k)
    last = F.row_number().over(Window.partitionBy(level).orderBy("_key", *identity))
    out = best.withColumn("_place", last).where(F.col("_place") <= k)
    if strict:
        n = F.count("*").over(Window.partitionBy(level))
        out = out.withColumn("_place", F.when(n >= k, F.col("_place")).otherwise(F.raise_error(F.lit(f"a level has under {k} rows"))))
        out = out.where("_place >= 0")
    return out.drop("_key", "_place")


def split_by_share(df: DataFrame, share: float, seed: int, *identity: str) -> DataFrame:
    """``part`` "train" or "test" by hash of the identity; repeated rows stay together."""
    draw = F.conv(F.substring(order_key(seed, *identity), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("part", F.when(draw < share, "train").otherwise("test"))


def suffixed_rows(df: DataFrame, keys: list[str], groups: list[dict[str, str]]) -> DataFrame:
    """Groups of numbered columns as rows: ``groups[i]`` maps a column of the i-th group to its common name."""
    rows = F.array(*(F.struct(F.lit(i).alias("prefix_no"), *(F.col(c).alias(n) for c, n in g.items())) for i, g in enumerate(groups)))
    return df.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
