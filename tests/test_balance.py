"""Placement queries over batches of any size."""

import pytest

from rollmill.operators import balance as B
from rollmill.plans import catalog


def query(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return sorted(tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect())


#: A batch of five rows, one of three and one of a single row without a length.
SHORT = [(0, 5), (1, 3), (2, 9), (3, 1), (4, 2), (200, 7), (201, 4), (399, 6), (400, None)]


def test_balance_batch_of_few_rows(spark, tmp_path):
    got = query(spark, tmp_path, "balance_batch", SHORT)
    assert got == [(0, 0, 1, 9), (0, 1, 1, 5), (0, 2, 2, 3), (0, 3, 1, 3), (1, 0, 1, 7), (1, 1, 1, 6), (1, 2, 1, 4), (2, 0, 1, 0)]


def test_balance_kk_of_few_rows(spark, tmp_path):
    assert query(spark, tmp_path, "balance_kk", SHORT) == [(0, 5, 20), (1, 3, 17), (2, 1, 0)]


def test_micro_batches_of_long_sequences(spark, tmp_path):
    # longer than the limit; much longer beside empty texts; no tokens at all; just at the limit and one beyond
    rows = [(0, 45_000), (1, 10), (200, 100_000), *((200 + i, 0) for i in range(1, 6)), (400, 0), (401, None), (600, 30_000), (800, 30_000), (801, 1)]
    got = query(spark, tmp_path, "micro_batches", rows)
    duckdb = pytest.importorskip("duckdb")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(own.execute(catalog.oracle_sql()["micro_batches"]).fetchall()) == [(0, 2), (1, 4), (2, 0), (3, 1), (4, 2)]


def test_differencing_ties():
    # of equal sums the set of more indices, then the larger first index, is the larger one; so no set stays empty
    assert B.largest_differencing([100, 0, 0, 0], 3) == [[0], [1, 2], [3]]
    assert B.largest_differencing([5, 5, 5, 5], 2, True) == [[0, 3], [1, 2]]
    assert B.micro_batches([70, 0, 0], 30) == [[0], [2], [1]] and B.micro_batches([0, 0], 30, least=0) == []


def test_differencing_of_many_sets():
    sets = B.largest_differencing(list(range(1, 65)), 32, True)
    assert sorted(i for s in sets for i in s) == list(range(64)) and {sum(i + 1 for i in s) for s in sets} == {65}
