"""Every registered query against the SQL that states its result, on the smallest data."""

import os

import pytest

import __spark_entry__ as contract
from checks.registry import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "orders part events documents pages".split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def rows(frame, columns):
    plain = frame[columns].astype(object)
    return sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    found = contract.queries()[name](spark, DATA).toPandas()
    expected = database.execute(contract.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert [found[c].dtype for c in columns] == [expected[c].dtype for c in columns] or found.empty
    assert rows(found, columns) == rows(expected, columns)


def test_human_bytes_beyond_64_bits(spark, tmp_path):
    """Ids as a table of millions of documents has them, and the largest ones."""
    ids = [7, -5, 1_500_000, 2_000_001, 10**12 + 1, 2**62]
    docs = spark.createDataFrame([(i, "x" * 4999, "en", "s") for i in ids], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.path.rsplit("/", 1)[1]: (r.unit, r.value) for r in contract.queries()["human_bytes"](spark, str(tmp_path)).collect()}
    for i in ids:
        size = 4999 * (i + 1) ** 2 * 977
        power = min(sum(size >= 1024**k for k in range(1, 6)), 5)
        unit, value = found[f"doc{i}.en"]
        assert unit == ["B", "KB", "MB", "GB", "TB", "PB"][power]
        assert value == pytest.approx(size / 1024**power, rel=1e-15 if i < 2**62 else 1e-14)


def test_entry(spark):
    assert contract.entry(spark).count() == 200
