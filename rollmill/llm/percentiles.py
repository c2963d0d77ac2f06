"""Problem 4: percentiles of very large numeric columns by exact bisection.

Doubles are mapped to integers of the same order (64 bits). For each group and percentile an interval is kept that holds the
target rank. A pass counts, per group, the rows below the interval's midpoints, those of several halvings at once: the
counts by the interval's next ``bits`` bits, of which prefix sums are the counts below each midpoint. The interval with the
target rank becomes the next one. When few rows are left within the intervals, one pass counts them by all remaining bits.

The first pass is made of partial results per day: counts by the leading 16 bits (sign, exponent and 4 bits of the
mantissa); the further passes make it exact. Partial results that are kept count by the leading ``PARTIAL_BITS`` (12 bits of
the mantissa): they are added up over days, partitions or later deliveries, and give every percentile within a relative
error of 2**-12 (``bounds_from_partials``), of all days or of each (``daily_bounds``), without reading the data again. A
table of them has at most 4096 rows a power of two for each day, group and column, however many values there are.

A percentile ``p`` of ``n`` values is the value of rank ceil(p n / 100), the least that at least ``p`` percent are not above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollmill.session import cut_lineage

PERCENTS = (1, 5, 25, 50, 75, 95, 99)
FIRST_BITS, NEXT_BITS, PARTIAL_BITS = 16, 12, 24
#: So few rows within the intervals are counted by all their remaining bits.
FEW = 500_000
#: Groups whose intervals are broadcast at once (at most so many times the percentiles, 16 bytes each).
BLOCK_GROUPS = 20_000


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def unordered(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64)
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of the batch, value) of all values of a numeric or list column that are neither null nor NaN."""
    rows = np.arange(len(column))
    if pa.types.is_list(column.type):
        flat = column.flatten()
        rows = np.repeat(rows, np.diff(column.offsets.to_numpy()) if not column.null_count else column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    else:
        flat = column
    # nulls become NaN here
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    valid = ~np.isnan(numbers)
    return rows[valid], numbers[valid]


def partial_counts(df: DataFrame, group: str, columns: list[str], at: str, bits: int = PARTIAL_BITS) -> DataFrame:
    """``day, grp, metric, prefix, n``: values per day of ``at`` by their leading ``bits`` bits. Partial results of disjoint
    rows are combined by adding ``n``. Nulls, null arrays, null elements and NaN aren't counted; infinities are values like
    others. A null day or group is one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pd.DataFrame] = []
        for batch in batches:
            keys = pd.DataFrame({"day": batch.column(0).to_pandas(), "grp": batch.column(1).to_pandas()})
            code, own = keys.groupby(["day", "grp"], dropna=False, sort=False).ngroup().to_numpy(), keys.drop_duplicates().reset_index(drop=True)
            for i, metric in enumerate(columns):
                rows, numbers = _values(batch.column(2 + i))
                packed, n = np.unique(code[rows].astype(np.uint64) << np.uint64(bits) | ordered(numbers) >> np.uint64(64 - bits), return_counts=True)
                part = own.iloc[(packed >> np.uint64(bits)).astype(np.int64)].reset_index(drop=True)
                parts.append(part.assign(metric=metric, prefix=(packed & np.uint64((1 << bits) - 1)).astype(np.int64), n=n))
            if len(parts) > 64:
                parts = [_added(parts, ["day", "grp", "metric", "prefix"])]
        if parts:
            yield from pa.Table.from_pandas(_added(parts, ["day", "grp", "metric", "prefix"]), schema=schema, preserve_index=False).to_batches()

    schema = pa.schema([("day", pa.date32()), ("grp", pa.string()), ("metric", pa.string()), ("prefix", pa.int64()), ("n", pa.int64())])
    own = df.select(F.to_date(at).alias("day"), F.col(group).cast("string").alias("grp"), *columns)
    return own.mapInArrow(run, "day date, grp string, metric string, prefix long, n long").groupBy("day", "grp", "metric", "prefix").agg(F.sum("n").alias("n"))


def _added(parts: list[pd.DataFrame], keys: list[str]) -> pd.DataFrame:
    return pd.concat(parts).groupby(keys, dropna=False, sort=False, as_index=False)["n"].sum()


def _targets(counts: DataFrame, live: DataFrame | None) -> DataFrame:
    """From counts ``grp, metric, base, prefix, n`` (all rows of each interval, by its next prefixes): the prefix that holds
    each rank, as ``grp, metric, percent, total, rank, base, n``; ``rank`` counts within the new interval."""
    up_to = Window.partitionBy("grp", "metric", "base").orderBy("prefix")
    sums = counts.withColumn("through", F.sum("n").over(up_to))
    if live is None:
        whole = counts.groupBy("grp", "metric").agg(F.sum("n").alias("total"))
        live = whole.select("grp", "metric", "total", F.lit(0).cast("long").alias("base"), F.explode(F.array(*map(F.lit, PERCENTS))).alias("percent")).withColumn(
            "rank", F.expr("(percent * total + 99) div 100")
        )
    joined = sums.alias("s").join(
        live.alias("l"),
        F.col("s.grp").eqNullSafe(F.col("l.grp")) & (F.col("s.metric") == F.col("l.metric")) & (F.col("s.base") == F.col("l.base")) & (F.col("l.rank") <= F.col("s.through")) & (F.col("l.rank") > F.col("s.through") - F.col("s.n")),
    )
    return joined.select("l.grp", "l.metric", "l.percent", "l.total", (F.col("l.rank") - F.col("s.through") + F.col("s.n")).alias("rank"), F.col("s.prefix").alias("base"), "s.n")


def _edges(bits: int):
    @F.pandas_udf("low double, high double")
    def both(base: pd.Series) -> pd.DataFrame:
        low = base.to_numpy().astype(np.uint64) << np.uint64(64 - bits)
        return pd.DataFrame({"low": unordered(low), "high": unordered(low | np.uint64((1 << (64 - bits)) - 1))})

    return both


def bounds_from_partials(partials: DataFrame, bits: int = PARTIAL_BITS) -> DataFrame:
    """``grp, metric, percent, n_values, low, high``: from partial results alone, bounds that hold the percentile. For normal
    doubles ``high - low`` is under ``2 ** (12 - bits)`` times the value's magnitude. No pass over the data."""
    counts = partials.groupBy("grp", "metric", F.lit(0).cast("long").alias("base"), "prefix").agg(F.sum("n").alias("n"))
    found = _targets(counts, None)
    return found.withColumn("edges", _edges(bits)("base")).select("grp", "metric", "percent", F.col("total").alias("n_values"), "edges.low", "edges.high")


def daily_bounds(partials: DataFrame, bits: int = PARTIAL_BITS) -> DataFrame:
    """``day, grp, metric, percent, n_values, low, high``: the bounds of each day's percentiles, from the same partial results."""
    up_to = Window.partitionBy("day", "grp", "metric").orderBy("prefix")
    whole = Window.partitionBy("day", "grp", "metric")
    sums = partials.withColumn("through", F.sum("n").over(up_to)).withColumn("total", F.sum("n").over(whole))
    ranked = sums.withColumn("percent", F.explode(F.array(*map(F.lit, PERCENTS)))).withColumn("rank", F.expr("(percent * total + 99) div 100"))
    found = ranked.where("rank <= through AND rank > through - n")
    return found.withColumn("edges", _edges(bits)("prefix")).select("day", "grp", "metric", "percent", F.col("total").alias("n_values"), "edges.low", "edges.high")


def percentiles(df: DataFrame, group: str, columns: list[str], at: str) -> DataFrame:
    """``group, metric, percent, n_values, value, error_bound`` of each group (null is one), column and percentile.

    Exact: ``error_bound`` is 0. All values of list columns count. Nulls, null arrays, null elements and NaN don't count;
    infinities, fill values and repeated rows do, as stored. A group without values has no row. Each pass over the data counts
    within its tasks first, so a group of any size or a single repeated value costs no more than others.
    """
    partials = partial_counts(df, group, columns, at, FIRST_BITS)
    counts = partials.groupBy("grp", "metric", F.lit(0).cast("long").alias("base"), "prefix").agg(F.sum("n").alias("n"))
    live, bits = cut_lineage(_targets(counts, None)), FIRST_BITS
    while bits < 64:
        within = live.select("grp", "metric", "base", "n").distinct().agg(F.sum("n").alias("n"), F.count_distinct("grp", "metric").alias("groups")).first()
        if not within.n:
            break
        step = 64 - bits if within.n <= FEW else min(NEXT_BITS, 64 - bits)
        blocks = max(1, -(-(within.groups or 0) // BLOCK_GROUPS))
        parts = None
        for block in range(blocks):
            own = live.where(F.pmod(F.xxhash64("grp", "metric"), F.lit(blocks)) == block).select("grp", "metric", "base").distinct()
            part = _narrowed(df, group, columns, own.toPandas(), bits, step)
            parts = part if parts is None else parts.unionByName(part)
        live, bits = cut_lineage(_targets(parts, live)), bits + step
    return live.withColumn("edges", _edges(64)("base")).select(
        F.col("grp").alias(group), "metric", "percent", F.col("total").alias("n_values"), F.col("edges.low").alias("value"), F.lit(0.0).alias("error_bound")
    )


def _narrowed(df: DataFrame, group: str, columns: list[str], intervals: pd.DataFrame, bits: int, step: int) -> DataFrame:
    """``grp, metric, base, prefix, n``: values within the intervals (``base`` is their leading ``bits`` bits) by the next
    ``step`` bits. ``prefix`` is the longer prefix."""
    plain = [None if pd.isna(g) else g for g in intervals.grp]
    names = {g: i for i, g in enumerate(dict.fromkeys(plain))}
    by_metric: dict[str, dict[int, np.ndarray]] = {}
    for g, metric, base in sorted(zip(map(names.get, plain), intervals.metric, (int(x) for x in intervals.base))):
        by_metric.setdefault(metric, {}).setdefault(g, []).append(base)
    by_metric = {m: {g: np.array(bases, np.int64).astype(np.uint64) for g, bases in own.items()} for m, own in by_metric.items()}
    shared = df.sparkSession.sparkContext.broadcast((names, by_metric))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, wanted = shared.value
        back = {i: g for g, i in codes.items()}
        parts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {m: [] for m in columns}

        def added(own):
            c, p, n = (np.concatenate(x) for x in zip(*own))
            order = np.lexsort((p, c))
            c, p, n = c[order], p[order], n[order]
            new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
            return [(c[new], p[new], np.add.reduceat(n, new))]

        for batch in batches:
            dictionary = batch.column(0).dictionary_encode()
            local = np.array([codes.get(g, -1) for g in dictionary.dictionary.to_pylist()] + [codes.get(None, -1)], np.int64)
            code = local[dictionary.indices.fill_null(len(local) - 1).to_numpy(zero_copy_only=False).astype(np.int64)]
            for i, metric in enumerate(columns):
                if metric not in wanted:
                    continue
                rows, numbers = _values(batch.column(1 + i))
                own, keys = code[rows], ordered(numbers)
                prefix = keys >> np.uint64(64 - bits)
                inside = np.zeros(len(keys), bool)
                order = np.argsort(own, kind="stable")
                present, begin = np.unique(own[order], return_index=True)
                for g, mine in zip(present.tolist(), np.split(order, begin[1:])):
                    if (bases := wanted[metric].get(g)) is not None:
                        at = np.searchsorted(bases, prefix[mine])
                        inside[mine] = bases[np.minimum(at, len(bases) - 1)] == prefix[mine]
                if inside.any():
                    c, p = own[inside], keys[inside] >> np.uint64(64 - bits - step)
                    parts[metric] = added([*parts[metric], *added([(c, p, np.ones(len(c), np.int64))])])
        for metric, own in parts.items():
            for c, p, n in own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([back[x] for x in c.tolist()], pa.string()), pa.array([metric] * len(c)), pa.array((p >> np.uint64(step)).view(np.int64)), pa.array(p.view(np.int64)), pa.array(n)],
                    ["grp", "metric", "base", "prefix", "n"],
                )

    out = "grp string, metric string, base long, prefix long, n long"
    counted = df.select(F.col(group).cast("string").alias("grp"), *columns).mapInArrow(run, out)
    # prefixes of 64 bits are stored as signed numbers; all of one base have the same sign and keep their order
    return counted.groupBy("grp", "metric", "base", "prefix").agg(F.sum("n").alias("n"))
