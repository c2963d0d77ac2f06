"""Positional algebra of batches.

A DataFrame has no row order, so a batch carries its order in the column ``pos`` (0, 1, ...): every function here takes and
gives it. Functions that need the batch's length count it once; nothing else comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.session import cut_lineage


def positioned(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """``df`` with its place in ``order``. Rows are sorted by ranges, each in a task of its own; only the ranges' lengths are
    added up. Ties are placed in any order, so give a unique one."""
    ids = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    lengths = sorted((row.part, row.n) for row in ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for number, n in lengths:
        starts.append((number, total))
        total += n
    if not starts:
        return ids.withColumn(name, F.lit(0).cast("long")).drop("_id")
    known = df.sparkSession.createDataFrame(starts, "part long, start long")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.withColumn("part", part).join(known, "part").withColumn(name, F.col("start") + within).drop("_id", "part", "start")


def select(batch: DataFrame, *columns: str) -> DataFrame:
    return batch.select("pos", *(c for c in columns if c != "pos"))


def pop(batch: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the others); a missing column is an error."""
    if missing := set(columns) - set(batch.columns):
        raise KeyError(f"no columns {sorted(missing)}")
    return select(batch, *columns), batch.drop(*(c for c in columns if c != "pos"))


def rename(batch: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names and {len(new)} new ones")
    return batch.withColumnsRenamed(dict(zip(old, new)))


def take(batch: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows by ``indices`` (``idx, out_pos``), in their order; an index may occur more than once. Negative ones count from the
    end."""
    n = batch.count()
    wanted = indices.select(F.when(F.col("idx") < 0, F.col("idx") + n).otherwise(F.col("idx")).alias("pos"), "out_pos")
    return batch.join(wanted, "pos").drop("pos").withColumnRenamed("out_pos", "pos")


def take_where(batch: DataFrame, mask: Column, *, renumber: bool = True) -> DataFrame:
    kept = batch.where(mask)
    return positioned(kept.withColumnRenamed("pos", "_was"), "_was").drop("_was") if renumber else kept


def slice_rows(batch: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python's slice of the rows, negative places and steps included."""
    places = range(*slice(start, stop, step).indices(batch.count()))
    if not len(places):
        return batch.limit(0)
    low, high, stride = min(places[0], places[-1]), max(places[0], places[-1]), abs(places.step)
    offset = F.col("pos") - places[0]
    kept = batch.where((F.col("pos") >= low) & (F.col("pos") <= high) & (F.pmod(offset, F.lit(stride)) == 0))
    return kept.withColumn("pos", F.expr(f"(pos - {places[0]}) div {places.step}"))


def reorder(batch: DataFrame, permutation: DataFrame) -> DataFrame:
    """``permutation`` has ``new_pos, pos``: which row comes where."""
    return batch.join(permutation, "pos").drop("pos").withColumnRenamed("new_pos", "pos")


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("pos").alias("new_pos"), F.col("new_pos").alias("pos"))


def shuffled(batch: DataFrame, seed: int, *identity: str) -> DataFrame:
    """``new_pos, pos`` of an order by hash, the same wherever and however often it is computed."""
    by = identity or ("pos",)
    keyed = batch.select("pos", F.xxhash64(*by, F.lit(seed)).alias("_hash"))
    return positioned(keyed, "_hash", "pos", name="new_pos").select("new_pos", "pos")


def repeat(batch: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: aabb interleaved, abab otherwise."""
    copies = batch.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else batch.limit(0).withColumn("_k", F.lit(0))
    place = F.col("pos") * times + F.col("_k") if interleave else F.col("_k") * F.lit(batch.count()) + F.col("pos")
    return copies.withColumn("pos", place.cast("long")).drop("_k")


def fold(batch: DataFrame, rows: int) -> DataFrame:
    """A batch of ``rows`` rows, each with the list of its rows (``items``, in order); the length must divide."""
    n = batch.count()
    if rows <= 0 or n % rows:
        raise ValueError(f"{n} rows can't be folded into {rows}")
    width = max(1, n // rows)
    items = F.array_sort(F.collect_list(F.struct(*batch.columns))) if batch.columns[0] == "pos" else F.array_sort(F.collect_list(F.struct("pos", *(c for c in batch.columns if c != "pos"))))
    return batch.groupBy(F.expr(f"pos div {width}").alias("_row")).agg(items.alias("items")).withColumnRenamed("_row", "pos")


def unfold(folded: DataFrame) -> DataFrame:
    return folded.select(F.explode("items").alias("item")).select("item.*")


def chunk(batch: DataFrame, chunks: int) -> DataFrame:
    """``batch`` with ``chunk``; the length must divide (pad first otherwise)."""
    n = batch.count()
    if chunks <= 0 or n % chunks:
        raise ValueError(f"{n} rows can't be split into {chunks} equal chunks")
    return batch.withColumn("chunk", F.expr(f"pos div {max(1, n // chunks)}"))


def split(batch: DataFrame, size: int) -> DataFrame:
    n = batch.count()
    if size <= 0 or n % size:
        raise ValueError(f"{n} rows can't be split by {size}")
    return batch.withColumn("chunk", F.expr(f"pos div {size}"))


def pad_to_divisor(batch: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """(the batch padded by its rows from the start, over again if need be, and how many were added)."""
    n = batch.count()
    added = -n % divisor
    if not added or not n:
        return batch, 0
    rounds = -(-added // n)
    cycles = batch.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("pos", F.col("_k") * n + F.col("pos")).where(F.col("pos") < n + added)
    return batch.unionByName(cycles.drop("_k")), added


def unpad(batch: DataFrame, added: int) -> DataFrame:
    return batch.where(F.col("pos") < batch.count() - added) if added else batch


def pad_with(batch: DataFrame, times: int, which: str = "last") -> DataFrame:
    """``times`` copies of the first or last row at the end."""
    n = batch.count()
    row = batch.where(F.col("pos") == (0 if which == "first" else n - 1))
    copies = row.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("pos", n + F.col("_k")).drop("_k") if times > 0 else row.limit(0)
    return batch.unionByName(copies.withColumn("pos", F.col("pos").cast("long")))


def merge_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both batches' columns side by side. Columns of one name must agree in every row, and the lengths must; NaN equals NaN."""
    shared = [c for c in right.columns if c in left.columns and c != "pos"]
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in shared}).withColumnRenamed("pos", "_other_pos")
    joined = left.join(other, F.col("pos") == F.col("_other_pos"), "full")
    agree = (F.col("pos").isNotNull() & F.col("_other_pos").isNotNull())
    for c in shared:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    checked = F.when(agree, F.col("pos")).otherwise(F.raise_error(F.lit("the batches differ in length or in a shared column")).cast("long"))
    return joined.withColumn("pos", checked).drop("_other_pos", *(f"_other_{c}" for c in shared))


def concat(*batches: DataFrame) -> DataFrame:
    """All rows one after the other; the columns are those of the first."""
    out, offset = None, 0
    for batch in batches:
        own = batch.withColumn("pos", (F.col("pos") + offset).cast("long"))
        out = own if out is None else out.unionByName(own)
        offset += batch.count()
    return out


def epochs(batch: DataFrame, mini_batch: int, n_epochs: int, seed: int | None = None) -> DataFrame:
    """``epoch, batch_id`` of every row in every epoch, in an order by hash of its own if there is a seed."""
    copies = batch.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    if seed is None:
        return copies.withColumn("batch_id", F.expr(f"pos div {mini_batch}"))
    placed = positioned(copies.withColumn("_hash", F.xxhash64("pos", "epoch", F.lit(seed))), "epoch", "_hash", "pos", name="_place")
    return placed.withColumn("batch_id", F.expr(f"(_place - epoch * {batch.count()}L) div {mini_batch}")).drop("_hash", "_place")


def drop_last(batch: DataFrame, size: int) -> DataFrame:
    """Without the incomplete last batch of ``size``."""
    return batch.where(F.col("pos") < batch.count() // size * size)


def rows_of_range(batch: DataFrame, start: float, end: float) -> DataFrame:
    """Rows from ceil(n * start) up to before ceil(n * end)."""
    from math import ceil

    n = batch.count()
    return batch.where((F.col("pos") >= ceil(n * start)) & (F.col("pos") < ceil(n * end)))


def split_files(batch: DataFrame, n_files: int) -> DataFrame:
    """``file_no``: files of ceil(n / n_files) rows, the last ones shorter or without rows."""
    size = max(1, -(-batch.count() // n_files))
    return batch.withColumn("file_no", F.expr(f"pos div {size}"))


def in_group_place(*keys: str, order: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
