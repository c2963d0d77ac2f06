"""Step loops over streams: one micro-batch is one global step; state is kept by checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions.schedules import AdaptiveKl


def file_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the parquet files at ``path``, a folder or one file."""
    schema = spark.read.parquet(path).schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    folder, _, name = path.rpartition("/")
    return source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)


def run_steps(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, timeout: int = 600) -> None:
    """Calls ``step(batch, step_no)`` for every micro-batch that isn't in the checkpoint yet, then ends."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took over {timeout} s")


def written_steps(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """What ``transform`` makes of each step, in ``target`` by step. A step that is run again replaces its own output."""

    def step(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/step={number}")

    run_steps(stream, step, checkpoint)
    return stream.sparkSession.read.parquet(target)


def kl_steps(stream: DataFrame, kl: Callable[[DataFrame], float], control: AdaptiveKl, checkpoint: str) -> list[tuple[int, float, float]]:
    """(step, KL, coefficient after it) of each micro-batch; the coefficient is carried from step to step by the driver."""
    out: list[tuple[int, float, float]] = []

    def step(batch: DataFrame, number: int) -> None:
        current = kl(batch)
        out.append((number, current, control.update(current, 1)))

    run_steps(stream, step, checkpoint)
    return out


def is_due(step: int, every: int, last: int | None = None) -> bool:
    """Whether to validate or save at this step: every k steps and on the last."""
    return every > 0 and step % every == 0 or step == last


def latest_step(steps: DataFrame, path: str = "path") -> DataFrame:
    """The largest step among checkpoint folders."""
    return steps.agg(F.max(F.nullif(F.regexp_extract(path, r"global_step_(\d+)", 1), F.lit("")).cast("long")).alias("latest"))


def retained(steps: DataFrame, keep: int, step: str = "step") -> DataFrame:
    """The ``keep`` last steps."""
    return steps.select(step).distinct().orderBy(F.desc(step)).limit(keep)


#: States of a request and the events that lead from one to the next.
PENDING, RUNNING, TOOL_CALLING, COMPLETED, FAILED = "PENDING", "RUNNING", "TOOL_CALLING", "COMPLETED", "FAILED"


def next_state(state: str, event: str, turns: int, most_turns: int) -> str:
    if state in (COMPLETED, FAILED):
        return state
    if event == "error":
        return FAILED
    if turns >= most_turns:
        return COMPLETED
    if state == PENDING:
        return RUNNING
    if state == RUNNING:
        return TOOL_CALLING if event == "click" else COMPLETED if event == "purchase" else RUNNING
    return RUNNING  # a tool has answered


def request_states(events: DataFrame, key: str, kind: str, order: str, most_turns: int = 20) -> DataFrame:
    """``key, state, turns`` after all events of a batch, folded in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind])
    final = lambda s: s.isin(COMPLETED, FAILED)

    def step(state, event):
        s, n = state["state"], state["turns"] + 1
        new = (
            F.when(final(s), s)
            .when(event == "error", FAILED)
            .when(n >= most_turns, COMPLETED)
            .when(s == PENDING, RUNNING)
            .when((s == RUNNING) & (event == "click"), TOOL_CALLING)
            .when((s == RUNNING) & (event == "purchase"), COMPLETED)
            .otherwise(RUNNING)
        )
        return F.struct(new.alias("state"), F.when(final(s), state["turns"]).otherwise(n).alias("turns"))

    folded = F.aggregate(rows, F.struct(F.lit(PENDING).alias("state"), F.lit(0).alias("turns")), step)
    return events.groupBy(key).agg(folded.alias("x")).select(key, "x.*")


def request_state_stream(stream: DataFrame, key: str, kind: str, order: str, most_turns: int = 20) -> DataFrame:
    """``key, state, turns`` of each request with events in a micro-batch, its state kept from batch to batch."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, turns = state.get if state.exists else (PENDING, 0)
        events = pd.concat(list(frames)).sort_values(order)
        for event in events[kind]:
            if now not in (COMPLETED, FAILED):
                turns += 1
                now = next_state(now, event, turns, most_turns)
        state.update((now, turns))
        yield pd.DataFrame({key: [name[0]], "state": [now], "turns": [turns]})

    out = f"{key} {stream.schema[key].dataType.simpleString()}, state string, turns int"
    return stream.groupBy(key).applyInPandasWithState(run, out, "state string, turns int", "update", "NoTimeout")
