"""Problems 2 and 3: defective prompt/response pairs, and texts cut off before their end.

One pass over the texts gives each a small code (no shuffle of text). Whether a missing end mark tells of a cut depends on
the source: where most texts of a source have none, it tells nothing. That baseline is a count per source, joined back by
source to the few rows in question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm import answers, shape
from rollmill.session import cut_lineage

#: A source whose texts lack an end mark more often than this has no use of end marks.
USUAL_SHARE = 0.5
FLAGS = "origin string, record_key string, text_no int, source string, state int, defect string"


def defect_of(question: str | None, answer: str | None, state: int) -> str | None:
    """The defect that the pair itself shows; a cut is left to ``state``."""
    if state == shape.BLANK or answers.is_empty(answer):
        return "empty"
    if answers.is_refusal(answer):
        return "refusal"
    if question and question.strip():
        if answers.is_copy(question, answer):
            return "copy"
        if answers.is_other_language(question, answer):
            return "other_language"
    return None


def _texts(values: pa.Array) -> list[str | None]:
    return values.to_pylist()


def _conversation_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(key, source, number, question, answer) of each user message and the message after it."""
    keys, sources, chats = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
    ends = chats.offsets.to_pylist()
    roles, contents = (_texts(chats.values.field(i)) for i in (0, 1))
    alive = chats.values.is_valid().to_pylist()
    for key, source, start, end in zip(keys, sources, ends, ends[1:]):
        number = 0
        for i in range(start, end):
            if alive[i] and roles[i] == "user":
                answered = i + 1 < end and alive[i + 1] and roles[i + 1] != "user"
                yield key, source, number, contents[i], contents[i + 1] if answered else None
                number += 1


def _list_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(key, source, position, question, text) of each element of a list of texts."""
    keys, sources, questions, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
    ends = lists.offsets.to_pylist()
    texts = _texts(lists.values)
    for key, source, question, start, end in zip(keys, sources, questions, ends, ends[1:]):
        for i in range(start, end):
            yield key, source, i - start, question, texts[i]


def _flagged(df: DataFrame, origin: str, rows: Callable[[pa.RecordBatch], Iterator[tuple]], cut_only: bool = False) -> DataFrame:
    """FLAGS of each text. ``cut_only``: the pair's own defects matter only where the text looks cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for key, source, number, question, text in rows(batch):
                state = shape.state_of(text)
                defect = None if cut_only and state == shape.FINISHED else defect_of(question, text, state)
                for column, value in zip(out, (key, number, source, state, defect)):
                    column.append(value)
            keys, numbers, sources, states, defects = out
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            columns = ([origin] * len(keys), keys, numbers, sources, states, defects)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["origin", "record_key", "text_no", "source", "state", "defect"])

    return df.mapInArrow(run, FLAGS)


def chat_flags(chats: DataFrame) -> DataFrame:
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return _flagged(chats.where("messages IS NOT NULL AND chat_id IS NOT NULL").select(F.col("chat_id").cast("string").alias("key"), "data_source", plain.alias("messages")), "chats", _conversation_rows)


def generation_flags(generations: DataFrame, cut_only: bool = False) -> DataFrame:
    question = F.expr("try_element_at(prompt, -1).content")
    return _flagged(generations.where("responses IS NOT NULL AND uid IS NOT NULL").select(F.col("uid").cast("string").alias("key"), "data_source", question.alias("question"), "responses"), "generations", _list_rows, cut_only)


def demo_flags(demos: DataFrame, cut_only: bool = True) -> DataFrame:
    question = F.coalesce("problem", "extra_info.question", F.expr("try_element_at(prompt, -1).content"))
    return _flagged(demos.where("demos IS NOT NULL AND uid IS NOT NULL").select(F.col("uid").cast("string").alias("key"), "data_source", question.alias("question"), "demos"), "demos", _list_rows, cut_only)


def with_cuts(flags: DataFrame) -> DataFrame:
    """``flags`` with ``truncated``: cut by its own structure, or without an end mark in a source whose texts have one.

    The baseline is counted per origin and source over all texts that are neither blank nor defective otherwise; a null
    source is a source of its own. It is pre-aggregated before its shuffle; of the texts only codes are moved.
    """
    plain = "defect IS NULL AND state <> 3"
    baseline = flags.where(plain).groupBy("origin", "source").agg(F.avg((F.col("state") == shape.UNENDED).cast("double")).alias("unended"))
    told = F.coalesce("unended", F.lit(0.0)) <= USUAL_SHARE
    cut = (F.col("state") == shape.CUT) | (F.col("state") == shape.UNENDED) & told
    return flags.join(
        baseline.withColumnsRenamed({"origin": "own_origin", "source": "own_source"}),
        (F.col("origin") == F.col("own_origin")) & F.col("source").eqNullSafe(F.col("own_source")),
        "left",
    ).withColumn("truncated", F.col("defect").isNull() & (F.col("state") != shape.BLANK) & cut)


def defective_pairs(chats: DataFrame, generations: DataFrame) -> DataFrame:
    """``origin, record_key, pair_no, defect`` of each defective pair; repeated rows give one row.

    Pairs are the user messages of ``chats`` with the message after them (none: an empty answer) and the last message of
    ``prompt`` with each of ``responses``. A pair has one defect, the first that applies of empty, refusal, copy,
    other_language, truncated. Null keys, null and empty lists have no pairs; a null or blank question can't be copied and
    has no language.
    """
    flags = cut_lineage(chat_flags(chats).unionByName(generation_flags(generations)))
    defect = F.when(F.col("truncated"), F.lit("truncated")).otherwise(F.col("defect"))
    found = with_cuts(flags).select("origin", "record_key", F.col("text_no").alias("pair_no"), defect.alias("defect"))
    return found.where("defect IS NOT NULL").distinct()


def _texts_flags(generations: DataFrame, demos: DataFrame) -> DataFrame:
    """FLAGS of generations and demos in which another language is no defect: it doesn't exclude a cut."""
    flags = generation_flags(generations, cut_only=True).unionByName(demo_flags(demos))
    return flags.withColumn("defect", F.nullif("defect", F.lit("other_language")))


def cut_texts(generations: DataFrame, demos: DataFrame) -> DataFrame:
    """``origin, record_key, text_no`` of each text that breaks off before its end; repeated rows give one row.

    Empty texts, refusals and copies of the question are none; a text in another language can be cut. Null keys and null lists
    have no texts.
    """
    flags = cut_lineage(_texts_flags(generations, demos))
    return with_cuts(flags).where("truncated").select("origin", "record_key", "text_no").distinct()


def cut_rates(generations: DataFrame, demos: DataFrame, export: DataFrame) -> DataFrame:
    """Per table and ``data_source``: texts, cut texts, their share, and texts shorter than the length recorded.

    ``generations`` and ``demos`` count each (uid, position) once. ``forward_export`` counts its rows, repeats of
    (uid, response_id, global_step) once, by whether the demo they point to is cut or is shorter than ``demo_len`` less the
    end token; rows that point to no demo count as not cut. Null sources are a group of their own.
    """
    flags = cut_lineage(_texts_flags(generations, demos))
    one = ["origin", "record_key", "text_no"]
    cuts = with_cuts(flags).groupBy(*one).agg(F.max("truncated").alias("cut"), F.max("source").alias("data_source"))
    lengths = (
        demos.where("uid IS NOT NULL")
        .select(F.col("uid").cast("string").alias("record_key"), F.posexplode("demos").alias("text_no", "text"), "demos_len")
        .groupBy("record_key", "text_no")
        .agg(F.max(F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))).alias("n_now"), F.max(F.get("demos_len", F.col("text_no"))).alias("n_then"))
    )
    known = cuts.join(lengths.withColumn("origin", F.lit("demos")), one, "left")
    own = known.select("origin", "data_source", "cut", F.coalesce(F.col("n_now") < F.col("n_then"), F.lit(False)).alias("shorter"), F.lit(1).alias("rows"))
    steps = (
        export.where("uid IS NOT NULL")
        .groupBy(F.col("uid").cast("string").alias("record_key"), F.expr("try_cast(response_id AS int)").alias("text_no"), "global_step")
        .agg(F.max("data_source").alias("data_source"), F.max("demo_len").alias("demo_len"))
        .groupBy("record_key", "text_no", "data_source", "demo_len")
        .agg(F.count("*").cast("int").alias("rows"))
    )
    exported = steps.join(known.where("origin = 'demos'").drop("data_source", "origin"), ["record_key", "text_no"], "left").select(
        F.lit("forward_export").alias("origin"), "data_source", F.coalesce("cut", F.lit(False)).alias("cut"), F.coalesce(F.col("n_now") < F.col("demo_len") - 1, F.lit(False)).alias("shorter"), "rows"
    )
    n = lambda flag: F.sum(F.when(F.col(flag), F.col("rows")).otherwise(0))
    return (
        own.unionByName(exported)
        .groupBy("origin", "data_source")
        .agg(F.sum("rows").alias("n_texts"), n("cut").alias("n_cut"), n("shorter").alias("n_shorter_than_recorded"))
        .withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
    )
