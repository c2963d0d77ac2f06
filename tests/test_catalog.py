"""Every core query against its SQL on the smallest test tables."""

import glob
import os

import pytest

from rollmill.plans import catalog

FOLDER = os.environ.get("ROLLMILL_TABLES", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    own = duckdb.connect()
    own.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        own.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return own


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, database, tmp_path, name):
    frame = catalog.queries()[name](spark, FOLDER)
    frame.write.parquet(str(tmp_path / "out"))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    got, want = f"SELECT * FROM '{tmp_path}/out/*.parquet'", f"SELECT * FROM ({sql})"
    names = lambda q: sorted(r[0] for r in database.sql(f"DESCRIBE {q}").fetchall())
    assert names(got) == names(want)
    columns = ", ".join(f'"{c}"' for c in names(got))
    plain = lambda row: repr(tuple(0.0 if x == 0 and isinstance(x, float) else x for x in row))
    rows = lambda q: sorted(map(plain, database.sql(f"SELECT {columns} FROM ({q})").fetchall()))
    assert rows(got) == rows(want)


def test_flagship(spark):
    assert catalog.queries()["adv_grpo"](spark, FOLDER).count() > 0
