"""Writing of record tables, prefix logs, rollouts, samples and metrics; cached aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions import arrays as A

SENTINEL = "0000-0000-0000-0000"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def convert_to_json(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").json(target)


def prefix_log(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with a prefix: the sum of rewards and the first advantage; written as CSV by step if there is a path."""
    log = df.where(F.col("prefix_uid") != SENTINEL).select(
        "step", "uid", "prefix_uid", "prefix_ratio", "prefix_correct", A.total("token_level_rewards").alias("reward"), F.get("advantages", F.lit(0)).alias("advantages")
    )
    if path:
        log.write.mode("overwrite").partitionBy("step").option("header", True).csv(path)
    return log


def rollouts(df: DataFrame, path: str, *extras: str) -> None:
    """input, output, score and extras as JSON lines by step."""
    df.select("step", "input", "output", "score", *extras).write.mode("overwrite").partitionBy("step").json(path)


def sample_rows(df: DataFrame, n: int, text: str = "input", seed: int = 42) -> DataFrame:
    """``n`` rows in an order by hash of the text and seed, the same in every run."""
    return df.orderBy(F.md5(F.concat_ws("|", text, F.lit(str(seed)))), text).limit(n)


def wide_samples(df: DataFrame, n: int, step: str = "step", number: str = "sample_no") -> DataFrame:
    """One row a step: input_0, output_0, score_0, input_1, ..."""
    pivoted = df.groupBy(step).pivot(number, list(range(n))).agg(F.first("input").alias("input"), F.first("output").alias("output"), F.first("score").alias("score"))
    return pivoted.select(step, *(F.col(f"{i}_{c}").alias(f"{c}_{i}") for i in range(n) for c in ("input", "output", "score")))


def metrics(df: DataFrame, path: str) -> None:
    """Appends ``step, name, value`` rows."""
    df.select("step", "name", "value").write.mode("append").parquet(path)


def console_line(df: DataFrame) -> DataFrame:
    """``step, line``: name:value pairs with three decimals, joined by " - "."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return df.groupBy("step").agg(F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit(":"), F.format_number(p["value"], "0.000"))), " - ").alias("line"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def results_csv(df: DataFrame, path: str, *order: str) -> None:
    """One sorted CSV file; for results of a few rows."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
