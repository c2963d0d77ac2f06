"""Literal cases of the batch algebra, and round trips that don't depend on partitions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollmill.operators import batch as B


def batch(spark, values, labels=None):
    rows = [(i, v, labels[i] if labels else chr(97 + i % 26)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, obs int, labels string")


def column(df, name="obs"):
    rows = df.select("pos", name).collect()
    assert sorted(r.pos for r in rows) == list(range(len(rows)))
    return [r[name] for r in sorted(rows, key=lambda r: r.pos)]


def permutation(spark, order):
    return spark.createDataFrame(list(enumerate(order)), "new_pos long, pos long")


def test_reorder(spark):
    out = B.reorder(batch(spark, range(1, 7)), permutation(spark, [3, 4, 2, 0, 1, 5]))
    assert column(out) == [4, 5, 3, 1, 2, 6] and column(out, "labels") == list("decabf")


def test_chunk_and_concat(spark):
    own = batch(spark, range(1, 7))
    with pytest.raises(ValueError):
        B.chunk(own, 5)
    halves = [B.take_where(own, F.col("pos").between(3 * k, 3 * k + 2)) for k in (0, 1)]
    assert [column(h) for h in halves] == [[1, 2, 3], [4, 5, 6]] and column(B.concat(*halves)) == [1, 2, 3, 4, 5, 6]
    assert [r.chunk for r in B.chunk(own, 2).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]


def test_pop_and_rename(spark):
    popped, left = B.pop(batch(spark, [1, 2]), "obs")
    assert popped.columns == ["pos", "obs"] and left.columns == ["pos", "labels"]
    with pytest.raises(KeyError):
        B.pop(left, "obs")
    with pytest.raises(ValueError):
        B.rename(left, ["labels"], [])


def test_repeat(spark):
    own = batch(spark, [1, 3, 5])
    assert column(B.repeat(own, 2), "labels") == list("aabbcc") and column(B.repeat(own, 2, interleave=False), "labels") == list("abcabc")
    assert B.repeat(own, 0).count() == 0


@pytest.mark.parametrize("divisor, want", [(2, "abca"), (3, "abc"), (7, "abcabca"), (10, "abcabcabca")])
def test_pad_to_divisor(spark, divisor, want):
    own = batch(spark, [1, 2, 3])
    padded, added = B.pad_to_divisor(own, divisor)
    assert column(padded, "labels") == list(want) and column(B.unpad(padded, added)) == [1, 2, 3]


def test_fold_reorder_unfold(spark):
    folded = B.fold(B.repeat(batch(spark, [1, 2, 3]), 2), 3)
    turned = B.reorder(folded, permutation(spark, [1, 2, 0]))
    labels = [x.labels for r in sorted(turned.collect(), key=lambda r: r.pos) for x in r["items"]]
    assert labels == list("bbccaa")
    with pytest.raises(ValueError):
        B.fold(batch(spark, [1, 2, 3]), 2)


def test_merge_columns(spark):
    own = batch(spark, [1, 2])
    other = own.select("pos", "obs", F.lit(1.5).alias("x"))
    assert column(B.merge_columns(own, other), "x") == [1.5, 1.5]
    for wrong in (other.withColumn("obs", F.lit(9)), other.where("pos = 0")):
        with pytest.raises(Exception, match="differ"):
            B.merge_columns(own, wrong).collect()
    nans = own.select("pos", F.lit(float("nan")).alias("y"))
    assert B.merge_columns(nans, nans).count() == 2


def test_take_with_repeats_and_negatives(spark):
    wanted = spark.createDataFrame([(2, 0), (0, 1), (2, 2), (-1, 3)], "idx long, out_pos long")
    assert column(B.take(batch(spark, [1, 2, 3, 4]), wanted)) == [3, 1, 3, 4]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.integers(-9, 9)), st.sampled_from([1, 2, 3, -1, -2]))
def test_slices_are_pythons(spark, start, stop, step):
    values = list(range(10, 17))
    assert column(B.slice_rows(batch(spark, values), start, stop, step)) == values[start:stop:step]


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_on_any_partitions(spark, parts):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(parts)
    assert all(r.pos == r.k for r in B.positioned(df, "k").collect())
    assert B.positioned(df.where("k < 0"), "k").count() == 0


def test_shuffle_and_inverse(spark):
    own = batch(spark, range(40))
    there = B.shuffled(own, 5)
    assert column(B.reorder(B.reorder(own, there), B.inverse(there))) == list(range(40))
    assert {tuple(r) for r in there.collect()} == {tuple(r) for r in B.shuffled(own.repartition(5), 5).collect()}


def test_drop_last_and_ranges(spark):
    own = batch(spark, range(10))
    assert column(B.drop_last(own, 4)) == list(range(8)) and B.rows_of_range(own, 0.25, 0.6).count() == 3
    assert column(B.pad_with(own, 2)) == [*range(10), 9, 9] and column(B.pad_with(own, 1, "first"))[-1] == 0
