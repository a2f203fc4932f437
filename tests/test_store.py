from __future__ import annotations

import numpy as np
import pytest

from vectrail.model import CollectionConfig
from vectrail.operators import ann
from vectrail.plans.database import Database
from vectrail.sources import binary, suppliers
from vectrail.streaming.ingest import ingest

IN = "vector array<float>, rid string, extra string"


def batch(spark, n, dim=8, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return spark.createDataFrame([(r.tolist(), f"r{i % 5}", f'{{"n":{i}}}') for i, r in enumerate(x)], IN).repartition(3)


def test_lifecycle(spark, tmp_path):
    with Database(spark, str(tmp_path / "db")) as db:
        c = db.create({"name": "flat", "index-type": "no", "compression": "zstd", "similarity-alg": "dot"})
        assert c.add(batch(spark, 25)) == (25, 0)
        assert c.add(batch(spark, 10, seed=1)) == (10, 0)
        assert sorted(r.id for r in c.rows().collect()) == list(range(35))
        with pytest.raises(ValueError):
            db.create({"name": "flat", "type": "FLAT"})
        for bad in ("", "a/b", "_x"):
            with pytest.raises(ValueError):
                db.create(CollectionConfig(bad))
        assert "flat" in db and db.list() == ["flat"] and db.get("none") is None
    again = Database(spark, str(tmp_path / "db"))
    c = again.get("flat")
    assert c.config.similarity.value == "dot" and c.count() == 35 and c.last_id() == 34
    assert c.add(batch(spark, 1)) == (1, 0) and c.last_id() == 35
    q = c.rows().where("id = 3").first().vector
    best = c.search(q, 5, None).collect()
    assert len(best) == 5 and best[0].score >= best[-1].score and '"rid":"r' in best[0].meta
    again.drop("flat")
    assert again.list() == [] and not Database(spark, str(tmp_path / "db")).list()
    with pytest.raises(RuntimeError):
        c.rows()


def test_quarantine(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create(CollectionConfig.from_request({"type": "LSH", "name": "x", "args": {"k": 8, "L": 4, "dim": 2}}))
    rows = spark.createDataFrame([([1.0, 2.0], "a", None), ([1.0], "b", None), (None, "c", None), ([1.0, None], "d", None), ([3.0, 4.0], None, None), ([], "e", None)], IN)
    assert c.add(rows) == (1, 5)
    assert sorted(r.reason for r in c.quarantine().collect()) == ["empty vector", "no rid", "no vector", "null element", "wrong length"]
    assert c.search([1.0, 2.0], 3).first().id == 0
    c.add(spark.createDataFrame([([1.0, 2.1], "z", None)], IN))
    assert {r.id for r in c.search([1.0, 2.0], 3).collect()} == {0, 1}


def test_same_tag_replaces(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create({"type": "FLAT", "name": "x", "allInMemory": True})
    c.add(batch(spark, 5), tag="a")
    c.add(batch(spark, 5), tag="b")
    c.add(batch(spark, 5), tag="b")
    assert sorted(r.id for r in c.rows().collect()) == list(range(10))


def test_transient(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create({"type": "TRANSIENT", "name": "t"})
    assert c.add(batch(spark, 4)) == (4, 0) and c.add(batch(spark, 3)) == (3, 0)
    assert sorted(r.id for r in c.rows().collect()) == list(range(7))
    assert not Database(spark, str(tmp_path)).list()


def test_index_versions(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create({"type": "ANN", "name": "a"})
    c.add(batch(spark, 60))
    assert c.config.dim == 8 and c.search_batch(c.rows(), 3, None).count() == 180  # exact while there is no index
    said = []
    every = ann.AnnParameters(probes=1000, oversample=100)
    first = c.build_index(every, said.append)
    assert said[0]["total"] == 60 and c.active_index() == first
    c.add(batch(spark, 10, seed=9))  # searched beside the index
    got = {(r.query_id, r.id) for r in c.search_batch(c.rows(), 4, None).collect()}
    from vectrail.operators.search import search_batch

    assert got == {(r.query_id, r.id) for r in search_batch(c.rows(), c.rows(), 4, None).collect()}
    newer = [c.build_index(every) for _ in range(2)]
    c.enable(first)
    assert c.purge(1) == [newer[0]] and c.versions() == [first, newer[1]]
    assert c.enable() == newer[1] and c.list_indexes().count() == 2
    with pytest.raises(ValueError):
        c.enable("v0")
    assert c.history().count() == 3 and c.latest_log(2).count() == 2


def test_stream(spark, tmp_path):
    c = Database(spark, str(tmp_path / "db")).create({"type": "FLAT", "name": "s"})
    source = str(tmp_path / "in")
    for n in range(2):
        batch(spark, 6, seed=n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(IN).parquet(source)
        ingest(stream, c, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
        assert sorted(r.id for r in c.rows().collect()) == list(range(6 * (n + 1)))


def test_binary(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((7, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vector array<float>")
    assert binary.write_segments(df, str(tmp_path / "f"), 3, rows_per_segment=4) == 2
    back = binary.read_frames(spark, str(tmp_path / "f"), 3).orderBy("id").collect()
    assert [r.vector for r in back] == [pytest.approx(r.tolist()) for r in x]
    binary.write_segments(df, str(tmp_path / "h"), 3, headered=True)
    assert binary.read_headered(spark, str(tmp_path / "h")).count() == 7
    assert binary.read_header(binary.header(3)) == (1, 3) and len(binary.header(3)) == 16
    with pytest.raises(ValueError):
        binary.read_header(b"\0" * 16)
    cut = binary.to_frames(np.arange(2), x[:2])[:-1]
    assert binary.frame_count(len(cut), 3) == 1 and len(binary.frames(cut, 3)[0]) == 1
    (tmp_path / "a.fvecs").write_bytes(binary.to_records(x, "<f4"))
    (tmp_path / "a.ivecs").write_bytes(binary.to_records(np.arange(6).reshape(2, 3), "<i4"))
    assert binary.read_fvecs(spark, str(tmp_path / "a.fvecs")).count() == 7
    assert [r.vector for r in binary.read_ivecs(spark, str(tmp_path / "a.ivecs")).orderBy("id").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert binary.in_order(["s.10.vec", "s.9.vec"]) == ["s.9.vec", "s.10.vec"]
    gaps = df.where("id in (0, 2, 5)")
    assert [(r.ord, r.id) for r in binary.with_ordinals(gaps).orderBy("ord").collect()] == [(0, 0), (1, 2), (2, 5)]
    binary.write_matrix(spark, x, str(tmp_path / "m"))
    assert np.allclose(binary.read_matrix(spark, str(tmp_path / "m")), x)


def test_suppliers(spark):
    assert suppliers.empty(spark).count() == 0
    assert suppliers.single(spark, [1, 2], "r").first().vector == [1, 2]
    assert [d.count() for d in suppliers.from_iterator(spark, (([i], "r", None) for i in range(5)), 2)] == [2, 2, 1]


def test_metadata_changes_and_compaction(spark, tmp_path):
    c = Database(spark, str(tmp_path)).create({"type": "FLAT", "name": "x"})
    rows = lambda a, b: spark.createDataFrame([([float(i), 1.0], f"r{i}", f'{{"n":{i}}}') for i in range(a, b)], IN)
    c.add(rows(0, 6), tag="a")
    c.add(rows(6, 9), tag="b")
    ids = {r.rid: r.id for r in c.rows().collect()}
    change = lambda rid, id_, extra: spark.createDataFrame([(id_, rid, extra)], "id bigint, rid string, extra string")
    for wrong in (change("r1", ids["r2"], "{}"), change("none", ids["r1"], "{}")):
        with pytest.raises(ValueError):
            c.update_metadata(wrong)
    assert c.update_metadata(change("r1", ids["r1"], '{"n":"new"}')) == 1
    assert c.update_metadata(change("r1", ids["r1"], '{"n":"newer"}')) == 1
    c.delete_metadata(spark.createDataFrame([(ids["r2"],), (999,)], "id bigint"))

    def check():
        meta = {r.id: r.meta for r in c.metadata().collect()}
        assert meta[ids["r1"]] == '{"rid":"r1","extra":{"n":"newer"}}' and ids["r2"] not in meta and len(meta) == 8
        assert c.count() == 9  # vectors stay
        assert {r.id: r.meta for r in c.search([2.0, 1.0], 9, None).collect()}[ids["r2"]] == "{}"

    check()
    c.compact()
    check()
    c.add(rows(6, 9), tag="b")  # a stream repeats its last batch after the compaction
    check()
    assert c.add(rows(9, 11), tag="c") == (2, 0)
    again = Database(spark, str(tmp_path)).get("x")
    assert sorted(r.id for r in again.rows().collect()) == list(range(11))
    c.compact()
    assert sorted(r.id for r in again.rows().collect()) == list(range(11))
    with pytest.raises(TimeoutError):
        c.search([1.0, 1.0], 3, None, timeout_millis=0.01)
    assert c.search([1.0, 1.0], 3, None, timeout_millis=120_000).count() == 3
