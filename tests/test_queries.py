"""Every registered query against its SQL."""

from __future__ import annotations

import duckdb
import pytest

from vectrail.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def values(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got) == values(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_hash_of_texts(spark):
    import xxhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["xxh64"](spark, SF).collect():
        assert r.hash % 2**64 == xxhash.xxh64_intdigest(docs[r.doc_id].encode())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())
