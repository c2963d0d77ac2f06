"""Reading of record tables and run logs; configurations as flat keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Rows of all files; with a schema no file is opened for it."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def json(spark: SparkSession, *paths: str, schema: str, array: bool = False) -> DataFrame:
    """Lines of JSON, or files that hold one array (``array``). The schema is given, so the data is read once."""
    return spark.read.schema(schema).option("multiLine", array).json(list(paths))


def by_step(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The JSON files of a glob over global_step directories, with ``step``."""
    return spark.read.schema(schema).json(pattern).withColumn("step", step_of(F.input_file_name()))


def step_of(path: Column) -> Column:
    """Integer after global_step_ (or global_step); null without one."""
    return F.nullif(F.regexp_extract(path, r"global_step_?(\d+)", 1), F.lit("")).cast("long")


def matching(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    """Files of a folder by name."""
    return spark.read.schema(schema).option("pathGlobFilter", glob).json(folder)


def split_slice(df: DataFrame, share: str, *order: str) -> DataFrame:
    """A slice such as "[:75%]" or "[-25%:]" of the rows in an order."""
    from rollmill.operators.batch import positioned

    own = positioned(df, *order)
    n = own.count()
    start, _, stop = share.strip("[]").partition(":")

    def place(text: str, default: int) -> int:
        if not text:
            return default
        value = round(n * float(text[:-1]) / 100) if text.endswith("%") else int(text)
        return max(0, value + n if value < 0 else value)

    return own.where((F.col("pos") >= place(start, 0)) & (F.col("pos") < place(stop, n)))


def flattened(config: dict, prefix: str = "") -> dict:
    """Nested keys joined by points."""
    out: dict = {}
    for key, value in config.items():
        out.update(flattened(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": value})
    return out
