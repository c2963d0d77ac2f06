"""Problem 1: groups of near-copies by multiple-global-order filtering.

A record is the set of its words. Two records are linked if their Jaccard similarity is at least ``threshold``; groups are
the connected components of the links.

Every global order of the words gives a filter: linked records share words within their prefixes under that order. No
single order is selective enough where most words are in a tenth of all records, so filters under several orders are
intersected before anything is verified:

* Rare words first. Records of up to ``SHORT`` words: the usual prefix, exact. Longer ones: the prefix is the words that at
  most ``RARE`` records have, and ``g`` further orders each put one class of words first (a remainder of the hash). If two
  records share more than ``g`` words of their prefixes, two of these are of one class (pigeonhole), so the records share two
  words of the prefix under that class's order too. The key is that pair of words. ``g`` is a power of two, a sixth to a third
  of the number of rare words, so the keys of a record grow in proportion to its words.
* Links whose records share fewer rare words (all names and numbers replaced) agree in the frequent words all the more.
  ``BANDS`` keys each join the first frequent word under ``DEPTH`` orders by hash.

These keys tell what is connected at once: exactly for short records and for records that share more rare words than ``g``,
otherwise by chance. So nothing rests on them: a second pass compares all records of different components (``across``) by
size and parity bits and verifies those left, and every link that connects anything is found with certainty. That pass is a
comparison of records in blocks, a few operations on bits a pair; its time grows with the square of the records. A filter
by words can't take its place here: most words are in a tenth of all records, and the exact sets of keys considered (pairs or
triples of words of a class, equal classes) are estimated to meet a hundredth of all pairs or need hundreds of keys a record.

Any fixed order keeps the result exact, so word frequencies may be estimated: counts of 2**20 hash buckets, a broadcast of
fixed size (1 MB as logarithms).

Keys that very many rows share (exact copies, the root of a large group, a key of words) are thinned within the task that
makes them or joined in salted parts (``joined_in_parts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rollmill.session import cut_lineage, delete, written

BUCKET_BITS = 20
#: Records of at most so many words are joined on single words of their prefixes.
SHORT = 12
#: A word is rare if at most so many records have it.
RARE = 128
#: The rare words of one record of a pair may be so many times the other's.
UNEVEN = 0.6
BANDS, DEPTH = 6, 8
#: Records of one key up to which all are compared, rows of one key held by a task, and rows of one key in one batch of which
#: only every ``THIN``-th is sent on (the others are linked to their neighbours there).
FULL_GROUP, HELD, THIN = 256, 4096, 64
#: Records of a side of a cell, and of these compared at once.
BLOCK, AT_ONCE = 16_384, 4
#: Parity bits of a record of up to ``LEVEL_WORDS`` words are 64 * ``PARITY_WORDS``; twice the words have twice the bits.
PARITY_WORDS, LEVEL_WORDS = 4, 192
#: A key that more than one of so many rows have is joined in parts; there are at most so many such keys.
HOT = 1000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_TO_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def word_list(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits, as bytes."""
    raw = text.encode()
    if len(raw) == len(text):
        return raw.translate(_TO_SPACES).split()
    return [w.encode() for w in _WORD.findall(text.lower())]


class WordHashes(dict):
    """48-bit hashes of words, remembered; emptied when large. Of two records' words, two different ones are taken for one
    with a probability of some 1e-10."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 16
        return value


def hashed_words(text: str, hashes: WordHashes) -> np.ndarray:
    """The distinct words' hashes, sorted."""
    distinct = set(word_list(text))
    words = np.fromiter(map(hashes.__getitem__, distinct), np.uint64, len(distinct))
    words.sort()
    return words


def packed(words: np.ndarray) -> bytes:
    """Six bytes a word."""
    return words.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def least_overlap(a: int, b: int, threshold: Fraction) -> int:
    """Words that sets of ``a`` and ``b`` words must share to be linked."""
    return ceil(threshold / (1 + threshold) * (a + b))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pairs_within(sorted_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of equal neighbours' runs in a sorted array."""
    n = len(sorted_groups)
    i, j = [], []
    for step in range(1, n):
        at = np.flatnonzero(sorted_groups[step:] == sorted_groups[:-step])
        if not len(at):
            break
        i.append(at)
        j.append(at + step)
    return (np.concatenate(i), np.concatenate(j)) if i else (np.empty(0, np.int64),) * 2


def classes_of(n_rare: np.ndarray) -> np.ndarray:
    """Number of classes for so many rare words: the power of two up to a third of them; 0 for fewer than two."""
    return np.where(n_rare > 1, 1 << np.log2(np.maximum(n_rare, 3) // 3).astype(np.int64), 0)


_SEEDS, _ORDERS = np.random.default_rng(1).integers(0, 1 << 64, (2, BANDS * DEPTH), np.uint64) | np.uint64(1)
_PLACES = (np.arange(1, DEPTH + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def keys_of(sets: list[np.ndarray], logs: np.ndarray, rare_log: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(record, key): keys one of which two records must share to become candidates. ``logs``: log counts by hash bucket, 0 for
    a word of one record alone, which joins nothing; a word is rare up to ``rare_log``."""
    sizes = np.array([len(w) for w in sets], np.int64)
    words, record = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    counts = logs[(words >> np.uint64(48 - BUCKET_BITS)).astype(np.int64)]
    ends, found = np.cumsum(sizes), []
    for at in np.flatnonzero(np.ceil(float(threshold) * sizes - 1e-9) <= SHORT).tolist():  # the smaller of a pair may be short
        size = int(sizes[at])
        own, n = words[ends[at] - size : ends[at]], counts[ends[at] - size : ends[at]]
        order = np.lexsort((own, n))
        prefix = order[: size - least_overlap(size, ceil(threshold * size), threshold) + 1]
        prefix = prefix[n[prefix] > 0]
        found.append((np.full(len(prefix), at), _mix(own[prefix] ^ np.uint64(0x51))))
    longer = sizes[record] > SHORT
    is_rare = longer & (counts > 0) & (counts <= rare_log)
    rare, rare_of = words[is_rare], record[is_rare]
    n_rare = np.bincount(rare_of, minlength=len(sets))
    own_level, other_level = classes_of(n_rare), np.where(n_rare > 1, classes_of((n_rare / UNEVEN).astype(np.int64)), 0)
    for level in (own_level, np.where(other_level != own_level, other_level, 0)):
        used = level[rare_of] > 0
        w, of, classes = rare[used], rare_of[used], level[rare_of[used]].astype(np.uint64)
        group = of.astype(np.uint64) << np.uint64(32) | _mix(w) % np.maximum(classes, np.uint64(1))
        order = np.argsort(group, kind="stable")  # a record's words are sorted, so within a class they stay so
        i, j = _pairs_within(group[order])
        i, j = order[i], order[j]
        found.append((of[i], _mix(_mix(w[i] ^ classes[i] << np.uint64(8)) * np.uint64(3) + w[j])))
    frequent, frequent_of = _mix(words[longer & (counts > rare_log)]), record[longer & (counts > rare_log)]
    if len(frequent):
        begin = np.flatnonzero(np.r_[True, frequent_of[1:] != frequent_of[:-1]])
        for band in range(BANDS):
            key = np.full(len(begin), band, np.uint64)
            for place in range(DEPTH):
                order = band * DEPTH + place
                key += np.minimum.reduceat((frequent ^ _SEEDS[order]) * _ORDERS[order], begin) * _PLACES[place]
            found.append((frequent_of[begin], _mix(key)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def level_of(n_words: int) -> int:
    """0 for up to ``LEVEL_WORDS`` words, one more for each doubling."""
    return (max(1, -(-n_words // LEVEL_WORDS)) - 1).bit_length()


def parity_of(words: np.ndarray) -> np.ndarray:
    """Bits that tell of each class of words whether it holds an odd number of them. The classes of one level less are pairs
    of classes, so folding the bits in half gives that level's."""
    n_bits = 64 * PARITY_WORDS << level_of(len(words))
    odd = np.bincount((_mix(words ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(n_bits)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def short_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bits of each set at the lowest level, a row of ``PARITY_WORDS`` numbers each."""
    n_bits = 64 * PARITY_WORDS
    words, of = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(w) for w in sets])
    odd = np.bincount(of * n_bits + (_mix(words ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(n_bits)).astype(np.int64), minlength=n_bits * len(sets)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, PARITY_WORDS)


def conversation_text(messages: str = "messages") -> Column:
    """The contents of all messages but system messages, by lines; null for null messages."""
    kept = F.filter(messages, lambda m: F.coalesce(m["role"] != "system", F.lit(True)) & m["content"].isNotNull())
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")


def _bucket_counts(records: DataFrame) -> np.ndarray:
    """Records per hash bucket of their words, as rounded logarithms; 2**BUCKET_BITS bytes whatever the data.

    Each task counts in an array of its own; the arrays are added up by ranges of buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            words = unpacked(b"".join(batch.column(0).to_pylist()))
            total += np.bincount((words >> np.uint64(48 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = records.select("words").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    several = counts.where("n > 1").toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    out[several.column("bucket").to_numpy()] = [_log_of(n) for n in several.column("n").to_pylist()]
    return out


def _log_of(n: int) -> int:
    """A count's rounded logarithm in one byte: 0 for one record, then rising."""
    return min(250, round(log2(n) * 4)) if n > 1 else 0


RECORD = "key long, words binary, n int, bits array<long>"


def _versions(rows: DataFrame) -> DataFrame:
    """``high, low`` and RECORD of ``rows``: a 128-bit digest of the set of words, by which equal sets meet, the packed words,
    their number, and their parity bits at the lowest level. Records without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, high, low, sets = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashed_words(text, hashes)
                if len(words):
                    digest = xxhash.xxh3_128_intdigest(words.tobytes())
                    keys.append(key)
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                    sets.append(words)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(short_sketches(sets).ravel()))
            columns = [pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.int64()), pa.array(map(packed, sets), pa.binary()), pa.array([len(w) for w in sets], pa.int32()), bits]
            yield pa.RecordBatch.from_arrays(columns, ["high", "low", "key", "words", "n", "bits"])

    return rows.mapInArrow(run, "high long, low long, " + RECORD)


def joined_in_parts(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """``left`` left-joined with ``right``, which has each key once. A key of more than a ``HOT``-th of the left rows is joined
    in parts, by the hash of the left column ``spread``: no task holds a large group. The hot keys are at most ``HOT`` rows,
    which are broadcast."""
    counted = left.groupBy(*on).agg(F.count("*").alias("_n"))
    limit = max(10_000, counted.agg(F.sum("_n")).first()[0] or 0) // HOT
    hot = counted.where(F.col("_n") > limit).select(*on, F.expr(f"cast(_n div {limit} + 1 AS int)").alias("_parts")).collect()
    if not hot:
        return left.join(right, on, "left")
    few = F.broadcast(left.sparkSession.createDataFrame(hot, ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in on) + ", _parts int"))
    parts = F.coalesce("_parts", F.lit(1))
    salted = left.join(few, on, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    copied = right.join(few, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(copied, [*on, "_part"], "left").drop("_part")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of each node of the links ``a, b``: the smallest node of its component.

    Each round, every node's label is replaced by the smallest label at its neighbours and then by that label's own label
    (pointer jumping), so the rounds grow with the logarithm of a component's diameter. Labels are written as a table in the
    checkpoint folder each round: a checkpointed plan keeps its constraints, which would double from round to round. No
    component is gathered in one place.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("fell"))
        jumped = joined_in_parts(written(lowered), labels.select(F.col("node").alias("root"), F.col("root").alias("further")), ["root"], "node")
        labels = written(jumped.select("node", F.least("root", F.coalesce("further", "root")).alias("root"), (F.col("fell") | F.coalesce(F.col("further") < F.col("root"), F.lit(False))).alias("fell")))
        moving = labels.agg(F.max("fell")).first()[0]
        labels = labels.select("node", "root")
        if not moving:
            return labels
    raise RuntimeError("components did not settle")


def near_links(records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``a, b`` (``a < b``): links of ``records`` (RECORD) with a common key of the filters.

    Records that share a key are compared with each other while they are few; a key of more than ``FULL_GROUP`` records links
    neighbours by size, within the task that makes the keys where one batch holds many of them.
    """
    spark = records.sparkSession
    limit = Fraction(str(threshold))
    rare_log = _log_of(RARE)
    frequency, most_ratio = spark.sparkContext.broadcast(_bucket_counts(records)), float(1 / limit) + 1e-9

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = frequency.value
        for batch in batches:
            sets = [unpacked(raw) for raw in batch.column(1).to_pylist()]
            if sets:
                of, keys = keys_of(sets, log, rare_log, limit)
                columns = _thinned(keys.view(np.int64), batch.column(0).to_numpy()[of], np.array([len(w) for w in sets], np.int32)[of])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["share", "key", "size"])

    shares = records.select("key", "words").mapInArrow(emit, "share long, key long, size int")
    met = shares.repartition("share").sortWithinPartitions("share", "size").mapInArrow(_meeting(most_ratio), "a long, b long")
    return _verified(met.distinct(), records, limit, filtered=True)


def _thinned(share: np.ndarray, key: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Of a key that ``THIN`` rows or more have here, every ``THIN``-th row and the last by size; the rows between become
    candidates with their neighbours, as rows ``(a, b, -1)``."""
    distinct, group, n = np.unique(share, return_inverse=True, return_counts=True)
    if n.max(initial=0) < THIN:
        return [share, key, size]
    many = n[group] >= THIN
    order = np.lexsort((size[many], group[many]))
    s, k, z, g = (x[many][order] for x in (share, key, size, group))
    near = np.flatnonzero(g[1:] == g[:-1])
    first = np.r_[True, g[1:] != g[:-1]]
    place = np.arange(len(g)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    kept = (place % THIN == 0) | np.r_[g[1:] != g[:-1], True]
    links = near[k[near] != k[near + 1]]
    a, b = np.minimum(k[links], k[links + 1]), np.maximum(k[links], k[links + 1])
    return [np.concatenate([share[~many], s[kept], a]), np.concatenate([key[~many], k[kept], b]), np.concatenate([size[~many], z[kept], np.full(len(a), -1, size.dtype)])]


def _meeting(most_ratio: float):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by share and size: pairs that share a key, and for large keys neighbours. Of the current key at most
        ``HELD`` rows are held."""
        held, large = None, None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            yield from within(rows[:, :last], large)
            held = rows[:, last:]
            if held.shape[1] > HELD:
                large = int(held[0, 0])
                yield from within(held, large)
                held = held[:, -1:]
        if held is not None:
            yield from within(held, large)

    def within(rows: np.ndarray, large: int | None) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        direct = rows[2] < 0
        if direct.any():
            yield _candidates([rows[:2, direct]])
            rows = rows[:, ~direct]
            if not rows.shape[1]:
                return
        share, ids, size = rows
        starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
        ends = np.r_[starts[1:], rows.shape[1]]
        many = (ends - starts > FULL_GROUP) | (share[starts] == large if large is not None else False)
        out: list[np.ndarray] = []
        waiting = 0

        def add(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal waiting
            fit = (size[i] * most_ratio >= size[j]) & (size[j] * most_ratio >= size[i]) & (ids[i] != ids[j])
            if fit.any():
                x, y = ids[i[fit]], ids[j[fit]]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                waiting += len(x)

        two = starts[ends - starts == 2]
        add(two, two + 1)
        for start, end in zip(starts[~many & (ends - starts > 2)].tolist(), ends[~many & (ends - starts > 2)].tolist()):
            i, j = np.triu_indices(end - start, 1)
            add(start + i, start + j)
            if waiting > 200_000:
                yield _candidates(out)
                out, waiting = [], 0
        for start, end in zip(starts[many].tolist(), ends[many].tolist()):
            at = np.arange(start, end)
            add(at[:-1], at[1:])
        if out:
            yield _candidates(out)

    return meet


def _candidates(out: list[np.ndarray]) -> pa.RecordBatch:
    distinct = np.unique(np.concatenate(out, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(distinct[0]), pa.array(distinct[1])], ["a", "b"])


def _folded(bits: np.ndarray) -> np.ndarray:
    half = len(bits) // 2
    return bits[:half] ^ bits[half:]


def _sketches(most_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each record above the lowest level its own level's bits, and as a guest those of the levels below where it may
        # have partners
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = unpacked(raw)
                n, bits = len(words), parity_of(words)
                level = level_of(n)
                rows.append((key, n, level, False, bits.tobytes()))
                for lower in range(level - 1, level_of(ceil(n / most_ratio)) - 1, -1):
                    bits = _folded(bits)
                    rows.append((key, n, lower, True, bits.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n", "level", "guest", "bits"])

    return run


def _verified(candidates: DataFrame, records: DataFrame, limit: Fraction, filtered: bool) -> DataFrame:
    """The candidates ``a, b`` that are links, by their sets of words. ``filtered``: by parity bits first."""
    kept = candidates
    if filtered:
        side = lambda of: records.select(F.col("key").alias(of), F.col("n").alias(f"n_{of}"), F.col("bits").alias(f"bits_{of}"))
        differing = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(PARITY_WORDS)), F.lit(0))
        most = F.col("n_a") + F.col("n_b") - 2 * F.ceil(F.lit(float(limit / (1 + limit))) * (F.col("n_a") + F.col("n_b")) - 1e-9)
        kept = candidates.join(side("a"), "a").join(side("b"), "b").where(differing <= most).select(*candidates.columns)
    kept = cut_lineage(kept)
    involved = records.join(kept.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi")

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            both = np.concatenate([unpacked(x), unpacked(y)])
            both.sort()
            out.append(int((both[1:] == both[:-1]).sum()) >= least_overlap(len(x) // 6, len(y) // 6, limit))
        return pd.Series(out, dtype=bool)

    words_of = lambda of: involved.select(F.col("key").alias(of), F.col("words").alias(f"words_{of}"))
    return kept.join(words_of("a"), "a").join(words_of("b"), "b").where(linked("words_a", "words_b")).select(*candidates.columns)


@F.pandas_udf(BinaryType())
def _as_bytes(lists: pd.Series) -> pd.Series:
    return pd.Series([x.tobytes() for x in lists], dtype=object)


def across(records: DataFrame, roots: DataFrame, limit: Fraction) -> DataFrame:
    """``a, b, root_a, root_b``: all pairs of records that lie in different components and meet the size and parity filters.

    Records of one level are dealt into blocks of some ``BLOCK``; a cell holds one block or two, or a block and one of the
    records of the levels above that may have partners in it. The rows moved are ``n_records / BLOCK`` times the records.
    """
    ratio, most_ratio = limit / (1 + limit), float(1 / limit) + 1e-9
    upper = records.where(F.col("n") > LEVEL_WORDS).select("key", "words").mapInArrow(_sketches(most_ratio), "key long, n int, level int, guest boolean, bits binary")
    lowest = records.where(F.col("n") <= LEVEL_WORDS).select("key", "n", F.lit(0).alias("level"), F.lit(False).alias("guest"), _as_bytes("bits").alias("bits"))
    rows = written(lowest.unionByName(upper).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    counted = rows.groupBy("level", "guest").agg(F.count("*").alias("n")).collect()
    blocks, guests = ({r.level: ceil(r.n / BLOCK) for r in counted if r.guest == guest} for guest in (False, True))
    levels = F.create_map(*(F.lit(x) for level in sorted({*blocks, *guests, -1}) for x in (level, blocks.get(level, 0))))
    guest_blocks = F.create_map(*(F.lit(x) for level in sorted({*blocks, *guests, -1}) for x in (level, guests.get(level, 0))))
    n_own, n_guest = levels[F.col("level")], guest_blocks[F.col("level")]
    own = F.pmod(F.xxhash64("key"), F.when(F.col("guest"), n_guest).otherwise(n_own)).cast("int")
    # a resident meets the residents of every block and the guests of every block, a guest the residents of every block
    at = F.when(
        F.col("guest"), F.transform(F.sequence(F.lit(1), n_own), lambda x: F.struct((x - 1).alias("i"), (-own - 1).alias("j"), F.lit(True).alias("right")))
    ).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(1), n_own), lambda x: F.struct(F.least(own, x - 1).alias("i"), F.greatest(own, x - 1).alias("j"), (own >= x).alias("right"))),
            F.transform(F.filter(F.sequence(F.lit(0), n_guest), lambda x: x > 0), lambda x: F.struct(own.alias("i"), (-x).alias("j"), F.lit(False).alias("right"))),
        )
    )
    # where no resident is, n_own is 0 and guests have nothing to meet
    cells = rows.where(n_own > 0).select("key", "root", "n", "level", "bits", F.explode(at).alias("at")).select("key", "root", "n", "level", "bits", "at.i", "at.j", "at.right")
    n_cells = sum(b * (b + 1) // 2 + b * guests.get(level, 0) for level, b in blocks.items())
    cells = cells.repartition(min(4000, max(1, n_cells)), "level", "i", "j")

    def most(n_both):
        return n_both - 2 * (-(-ratio.numerator * n_both // ratio.denominator))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        key, root, n = (pdf[c].to_numpy(np.int64) for c in ("key", "root", "n"))
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
        alone = bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
        is_right = pdf["right"].to_numpy(bool)
        left, right = (np.arange(len(pdf)),) * 2 if alone else (np.flatnonzero(~is_right), np.flatnonzero(is_right))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            sizes, columns = n[right], [np.ascontiguousarray(c) for c in bits[right].T]
            starts = np.searchsorted(sizes, -(-n[left] * limit.numerator // limit.denominator))
            ends = np.searchsorted(sizes, n[left] * limit.denominator // limit.numerator, "right")
            # three quarters of the bits first, in a byte a pair where they fit
            part = len(columns) * 3 // 4
            kind = np.uint8 if 64 * part < 256 else np.uint32
            wide, narrow, sums = np.empty((AT_ONCE, len(right)), np.uint64), np.empty((AT_ONCE, len(right)), np.uint8), np.empty((AT_ONCE, len(right)), kind)
            for first in range(0, len(left), AT_ONCE):
                x = left[first : first + AT_ONCE]
                start, end = (int(first + 1) if alone else int(starts[first])), int(ends[first + len(x) - 1])
                if start >= end:
                    continue
                xor, ones, differing = (buffer[: len(x), : end - start] for buffer in (wide, narrow, sums))
                for i in range(part):
                    np.bitwise_xor(columns[i][start:end], bits[x, i][:, None], out=xor)
                    np.bitwise_count(xor, out=ones)
                    if i:
                        np.add(differing, ones, out=differing)
                    else:
                        differing[...] = ones
                p, q = np.nonzero(differing <= min(most(int(n[x[-1]]) + int(sizes[end - 1])), np.iinfo(kind).max))
                q += start
                if alone:
                    later = q > first + p
                    p, q = p[later], q[later]
                if not len(p):
                    continue
                total, p, y = differing[p, q - start].astype(np.int64), x[p], right[q]
                for i in range(part, len(columns)):
                    total += np.bitwise_count(bits[p, i] ^ bits[y, i])
                smaller = n[p] <= n[y]
                fit = np.where(smaller, n[p], n[y]) * limit.denominator >= np.where(smaller, n[y], n[p]) * limit.numerator
                fit &= (total <= most(n[p] + n[y])) & (root[p] != root[y])
                found.append((p[fit], y[fit]))
        p, q = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        ahead = key[p] < key[q]
        p, q = np.where(ahead, p, q), np.where(ahead, q, p)
        return pd.DataFrame({"a": key[p], "b": key[q], "root_a": root[p], "root_b": root[q]})

    return cells.groupBy("level", "i", "j").applyInPandas(compare, "a long, b long, root_a long, root_b long")


def near_groups(chats: DataFrame, key: str = "chat_id", text: Column | None = None, threshold: float = 0.7) -> DataFrame:
    """``key, root``: each record that has words, with the smallest record of its group (itself if it has no near-copy).

    A repeated row changes nothing; a key whose rows differ is linked wherever one of its versions is. Records without words
    have no group and no row; null keys and null texts are left out. Equal sets of words are one record until the links are
    found, so a group of exact copies of any size costs one record.
    """
    limit = Fraction(str(threshold))
    words = conversation_text() if text is None else text
    rows = chats.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), words.alias("text")).where("text IS NOT NULL")
    sets = written(_versions(rows))
    members = cut_lineage(sets.select("high", "low", "key").distinct())
    own = written(sets.groupBy("high", "low").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("words", "n", "bits"))).drop("high", "low"))
    delete(sets)
    first = cut_lineage(members.groupBy("high", "low").agg(F.min("key").alias("a")))
    # a key of several versions links the versions' first records
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    versions = several.join(members, "key").join(first, ["high", "low"]).select("key", "a")
    same_key = versions.join(versions.groupBy("key").agg(F.min("a").alias("least")), "key").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    roots = components(near_links(own, threshold).unionByName(same_key))
    further = components(_verified(across(own, roots, limit), own, limit, filtered=False).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    # the digests' roots: after the first pass, after the second
    known = first.join(roots.withColumnRenamed("node", "a"), "a", "left").select("high", "low", F.coalesce("root", "a").alias("near"))
    known = joined_in_parts(known, further.withColumnRenamed("node", "near"), ["near"], "high").select("high", "low", F.coalesce("root", "near").alias("root"))
    placed = joined_in_parts(members, known, ["high", "low"], "key")
    return placed.groupBy("key").agg(F.min("root").alias("root")).withColumnRenamed("key", key)


def grouped_pairs(groups: DataFrame, key: str = "chat_id", part_rows: int = 1000) -> DataFrame:
    """``<key>_a, <key>_b``: every pair of distinct records of one group, the smaller first. A group is joined in parts of some
    ``part_rows`` rows of the one side, each with the whole group, so that a large one is spread over tasks."""
    several = written(groups.select("root", F.col(key).alias("key")))
    sized = several.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.expr(f"cast((n - 1) div {part_rows} + 1 AS int)").alias("parts"))
    in_parts = joined_in_parts(several, sized, ["root"], "key").where("parts IS NOT NULL")
    left = in_parts.select("root", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias(f"{key}_a"))
    right = in_parts.select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias(f"{key}_b"))
    return left.join(right, ["root", "part"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
