"""The registered queries against their SQL, their columns, and the pipeline's registration."""

from __future__ import annotations

import duckdb
import pytest

from vectrail.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out score predicted", 3: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 4: "query_id rank vec_id score",
    5: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 6: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    7: "doc_id size text_crc32 law shard slot grown_shard", 8: "doc_id size source_size target taken", 9: "doc_id held_out score predicted", 10: "doc_id n_shingles component_id",
}


def values(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert values(QUERIES[name](spark, SF).toPandas()) == values(con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    got = QUERIES[name](spark, SF)
    wanted = COLUMNS.get(int(name[2:].split("_")[0]), "doc_id n_tokens").split()
    assert got.columns[: len(wanted)] == wanted
    assert got.count() > 0


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
