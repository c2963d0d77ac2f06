"""Balanced placement of sequences by their lengths.

The heaps of these algorithms are sequential, so they run within a batch (one group of rows, of bounded size by its
definition); batches run beside each other. ``serpentine`` places rows of any number by a window over buckets.
"""

from __future__ import annotations

import bisect
import heapq
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ceildiv(a: int, b: int) -> int:
    return -(-a // b)


def largest_differencing(lengths: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Karmarkar-Karp: indices in ``parts`` sets with sums as even as the heuristic gives, sorted within a set; none is empty.

    ``equal_size``: sets of equally many indices; their number must divide.
    """
    n = len(lengths)
    if n < parts:
        raise ValueError(f"{n} sequences for {parts} parts")
    if equal_size and n % parts:
        raise ValueError(f"{n} sequences can't be split into {parts} equal parts")
    order = sorted((length, i) for i, length in enumerate(lengths))
    width = parts if equal_size else 1
    # a set: sum, number and first index, all negative, then the indices as nested pairs; larger sets come first. A state has
    # its sets in order, without the empty ones, which would come last.
    heap = [_ranked(sorted((-length, -1, -i, i) for length, i in order[at : at + width]), parts) for at in range(0, n, width)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        # the largest of one meets the smallest of the other
        met = [(x[0] + y[0], x[1] + y[1], x[2], (x[3], y[3])) for x, y in zip(a[parts - len(b) :], reversed(b[parts - len(a) :]))]
        new = met + b[: parts - len(a)]
        del a[parts - len(b) :]
        if len(new) < 16:  # mostly one sequence that meets many sets
            for own in new:
                bisect.insort(a, own)
        else:
            a += new
            a.sort()
        heapq.heappush(heap, _ranked(a, parts))
    return [sorted(_leaves(s[3])) for s in heap[0][1]]


def _ranked(sets: list[tuple], parts: int) -> tuple[int, list[tuple]]:
    """A state after its negative spread; of equal spreads, the one with the larger first set is taken first."""
    return sets[0][0] - (sets[-1][0] if len(sets) == parts else 0), sets


def _leaves(pairs) -> list[int]:
    out, left = [], [pairs]
    while left:
        at = left.pop()
        if isinstance(at, tuple):
            left += at
        else:
            out.append(at)
    return out


def least_loaded(lengths: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """In the order given, each index to the set with the least sum so far. ``equal_size`` adds a bias that keeps the numbers
    even."""
    bias = sum(lengths) + 1 if equal_size else 0
    sums, sets = [0] * parts, [[] for _ in range(parts)]
    for i, length in enumerate(lengths):
        at = min(range(parts), key=lambda p: (sums[p], p))
        sets[at].append(i)
        sums[at] += length + bias
    return sets


def micro_batches(lengths: list[int], most_tokens: int, least: int = 1) -> list[list[int]]:
    """Balanced sets, as many as the tokens need (``least`` at least, one sequence each at most). A sequence longer than
    ``most_tokens`` counts with its tokens like any other; it stays whole, so its set is over the limit."""
    parts = max(least, min(len(lengths), ceildiv(sum(lengths), most_tokens)))
    return largest_differencing(lengths, parts) if parts else []


def _assigned(df: DataFrame, batch: str, order: str, length: str, make) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", part int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        part = [None] * len(pdf)
        for p, indices in enumerate(make(pdf[length].tolist())):
            for i in indices:
                part[i] = p
        return pdf.assign(part=part)

    return df.groupBy(batch).applyInPandas(run, schema)


def balanced(df: DataFrame, batch: str, order: str, length: str, parts: int, equal_size: bool = False) -> DataFrame:
    """``df`` with ``part`` by Karmarkar-Karp within each batch. A batch of fewer rows than ``parts``, as the last one of a table
    may be, has a part for each row, unless ``equal_size`` is asked for."""
    return _assigned(df, batch, order, length, lambda lengths: largest_differencing(lengths, parts if equal_size else min(parts, len(lengths)), equal_size))


def greedy(df: DataFrame, batch: str, order: str, length: str, parts: int) -> DataFrame:
    return _assigned(df, batch, order, length, lambda lengths: least_loaded(lengths, parts))


def in_micro_batches(df: DataFrame, batch: str, order: str, length: str, most_tokens: int) -> DataFrame:
    """``df`` with ``part``; null in a batch without tokens, which needs no micro-batch."""
    return _assigned(df, batch, order, length, lambda lengths: micro_batches(lengths, most_tokens, least=0))


def serpentine(df: DataFrame, length: str, parts: int, *identity: str, buckets: int = 256) -> DataFrame:
    """``part`` for any number of rows, without a heap: by length within hash buckets, to and fro."""
    bucket = F.pmod(F.xxhash64(*identity), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc(length), *identity)) - 1
    return df.withColumn("_place", place).withColumn("part", to_and_fro(F.col("_place"), parts)).drop("_place")


def to_and_fro(place: Column, parts: int) -> Column:
    step = F.pmod(place, F.lit(2 * parts))
    return F.when(step < parts, step).otherwise(2 * parts - 1 - step).cast("int")


def routed(df: DataFrame, batch: str, order: str, request: str, servers: int, remembered: int = 10_000) -> DataFrame:
    """``server`` of each request: known requests stay with theirs, new ones go to the server with the least so far. The memory
    of requests is a least-recently-used one."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", server int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heap, known, out = [(0, s) for s in range(servers)], OrderedDict(), []
        pdf = pdf.sort_values(order)
        for name in pdf[request]:
            if name in known:
                known.move_to_end(name)
            else:
                load, server = heapq.heappop(heap)
                heapq.heappush(heap, (load + 1, server))
                known[name] = server
                if len(known) > remembered:
                    known.popitem(last=False)
            out.append(known[name])
        return pdf.assign(server=out)

    return df.groupBy(batch).applyInPandas(run, schema)


def admitted(needs: dict[str, int], nodes: dict[str, int]) -> dict[str, list[str]]:
    """Nodes of each pool if all fit, else an error: free units are checked in total, then handed out pool by pool."""
    if sum(needs.values()) > sum(nodes.values()):
        raise ValueError(f"{sum(needs.values())} units are needed, {sum(nodes.values())} are there")
    left, out = dict(nodes), {}
    for pool, units in needs.items():
        node = next((n for n, free in left.items() if free >= units), None)
        if node is None:
            raise ValueError(f"no node has {units} free units for {pool}")
        left[node] -= units
        out[pool] = [node]
    return out
