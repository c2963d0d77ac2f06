"""Session helpers shared by every operator: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: dict[str, DataFrame] = {}


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once an application, so that their Python workers find it wherever they start."""
    context = spark.sparkContext
    package = Path(__file__).parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="rollmill-code-")  # read by this process alone, which serves it to the executors
    path = os.path.join(folder, "rollmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the one the cluster names in ``spark.checkpoint.dir``. Only on a local master (tests) may it
    be unset; then a folder of this machine is chosen."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rollmill-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from there; for rows of a few numbers."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed columnar table in the shared checkpoint folder; for rows with texts. Deleted when the
    application ends, or by ``delete``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    _written[path] = out
    return out


def delete(table: DataFrame) -> None:
    """Deletes a ``written`` table that is of no more use."""
    for path in [p for p, own in _written.items() if own is table]:
        _delete(path, _written.pop(path).sparkSession)


def _delete(path: str, spark: SparkSession) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _delete_all() -> None:
    for path, own in _written.items():
        try:
            _delete(path, own.sparkSession)
        except Exception:  # the session may have ended before
            pass
