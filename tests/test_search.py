from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.model import Similarity
from vectrail.operators import ann, cluster, lsh, search

COS, DOT, L2 = Similarity.COSINE, Similarity.DOT_PRODUCT, Similarity.EUCLIDEAN


def table(spark, vectors):
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>")


@pytest.fixture(scope="module")
def random_rows(spark):
    x = np.random.default_rng(0).standard_normal((300, 16)).astype(np.float32)
    x *= np.random.default_rng(1).uniform(0.5, 3, (300, 1)).astype(np.float32)  # cosine and dot rank differently
    return x, table(spark, [r.tolist() for r in x]).persist()


def brute(x, q, similarity, k, threshold):
    x, q = x.astype(float), q.astype(float)
    s = {COS: lambda: x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), DOT: lambda: x @ q, L2: lambda: np.linalg.norm(x - q, axis=1)}[similarity]()
    key = s if similarity is L2 else -s
    good = np.ones(len(s), bool) if threshold is None else (s <= threshold if similarity is L2 else s >= threshold)
    return [int(i) for i in np.lexsort((np.arange(len(s)), key)) if good[i]][:k]


@pytest.mark.parametrize(("similarity", "threshold"), [(COS, 0.1), (DOT, 1.0), (L2, 6.0), (L2, None)])
def test_exact(spark, random_rows, similarity, threshold):
    x, rows = random_rows
    expected = {q: brute(x, x[q], similarity, 7, threshold) for q in range(20)}
    assert [r.id for r in search.search(rows, x[3], 7, threshold, similarity).collect()] == expected[3]
    queries = rows.where("id < 20")
    for most in (1 << 20, 1):  # in the closure; in slots
        got = search.search_batch(rows, queries, 7, threshold, similarity, 16, most).orderBy("query_id", "rank").collect()
        assert {q: [r.id for r in got if r.query_id == q] for q in range(20)} == expected


def test_odd_rows(spark):
    rows = table(spark, [[1, 0], [0, 0], [math.nan, 1], [1], None, [1, 0], [2, 0], [1, None]])
    got = search.search(rows, [1.0, 0.0], 10, -1.0, COS).collect()
    assert [r.id for r in got] == [0, 5, 6]  # ties by id; zero, NaN, short and null are not found
    batch = search.search_batch(rows, rows.where("id = 0"), 10, -1.0, COS, 2).orderBy("rank").collect()
    assert [r.id for r in batch] == [0, 5, 6]
    assert [r.id for r in search.search(rows, [1.0, 0.0], 1, 1.0, COS).collect()] == [0]  # the threshold is inclusive
    assert [r.id for r in search.search(rows, [1.0, 0.0], 3, 0.5, COS, order="asc").collect()] == [6, 5, 0]
    assert search.search(rows.where("false"), [1.0, 0.0], 3).count() == 0
    for k in (0, -1):
        with pytest.raises(ValueError):
            search.search(rows, [1.0, 0.0], k)


def test_filter_and_metadata(spark, random_rows):
    x, rows = random_rows
    got = search.search(rows, x[0], 5, None, COS, where=F.col("id") % 2 == 1).collect()
    assert all(r.id % 2 for r in got) and len(got) == 5
    meta = spark.createDataFrame([(got[0].id, '{"rid":"a"}')], "id bigint, meta string")
    found = spark.createDataFrame([(r.id, r.score) for r in got], "id bigint, score double")
    left = {r.id: r.meta for r in search.with_metadata(found, meta).collect()}
    assert left[got[0].id] == '{"rid":"a"}' and left[got[1].id] == "{}"
    assert search.with_metadata(found, meta, "inner").count() == 1


def test_merge_and_hybrid(spark, random_rows):
    x, rows = random_rows
    parts = [search.search(rows.where(F.col("id") % 3 == n), x[0], 9, None) for n in range(3)]
    whole = [r.id for r in search.search(rows, x[0], 9, None).collect()]
    assert [r.id for r in search.arranged(search.merge_top_k([p.select("id", "score") for p in parts], 9), COS).collect()] == whole
    overlap = search.hybrid(search.search(rows.where("id <= 200"), x[0], 9, None), search.search(rows.where("id >= 150"), x[0], 9, None), 9)
    assert [r.id for r in search.arranged(overlap, COS).collect()] == whole
    assert search.not_indexed(rows, 250).count() == 49 and search.not_indexed(rows, indexed=rows.where("id < 10")).count() == 290


def test_lsh(spark, random_rows, tmp_path):
    x, rows = random_rows
    with pytest.raises(ValueError):
        lsh.gaussian_planes(12, 1, 16)
    with pytest.raises(ValueError):
        lsh.gaussian_planes(0, 1, 16)
    index = lsh.LshIndex.build(rows, 8, 16, 16)
    found = index.search(rows, rows, 5, None).collect()
    assert len({(r.query_id, r.id) for r in found}) == len(found)
    exact = {(r.query_id, r.id): r.score for r in search.search_batch(rows, rows, 300, None, COS, 16).collect()}
    assert all(r.score == pytest.approx(exact[r.query_id, r.id]) for r in found)
    best = {(q, i) for q in range(300) for i in brute(x, x[q], COS, 5, None)}
    assert len(best & {(r.query_id, r.id) for r in found}) > 0.5 * len(best)
    index.save(str(tmp_path / "i"))
    again = lsh.LshIndex.load(spark, str(tmp_path / "i"))
    assert np.allclose(again.planes, index.planes) and again.rows.count() == 16 * 300
    again.append(str(tmp_path / "i"), table(spark, [x[0].tolist()]))
    assert lsh.LshIndex.load(spark, str(tmp_path / "i")).rows.count() == 16 * 301
    wide = lsh.signatures(rows.where("id < 3"), lsh.gaussian_planes(256, 2, 16)).first()
    assert len(wide.code) == 8
    orthogonal = lsh.signatures(table(spark, [[0.0, 1.0]]), np.array([[[1.0, 0.0]] * 8]))
    assert orthogonal.first().code == [0]  # a product of 0 sets no bit


@pytest.mark.parametrize("similarity", [COS, DOT, L2])
def test_ann(spark, random_rows, similarity, tmp_path):
    x, rows = random_rows
    best = {(q, i) for q in range(300) for i in brute(x, x[q], similarity, 5, None)}
    index = ann.AnnIndex.build(rows, 16, ann.AnnParameters(probes=6), similarity)
    found = index.search(rows, rows, 5, None).collect()
    assert len(best & {(r.query_id, r.id) for r in found}) > 0.6 * len(best)
    every = ann.AnnIndex.build(rows, 16, ann.AnnParameters(probes=10_000, oversample=1000), similarity)
    assert {(r.query_id, r.id) for r in every.search(rows, rows, 5, None).collect()} == best
    if similarity is COS:
        index.save(str(tmp_path / "v1"))
        again = ann.AnnIndex.load(spark, str(tmp_path / "v1")).search(rows, rows, 5, None).collect()
        assert {(r.query_id, r.id) for r in again} == {(r.query_id, r.id) for r in found}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_defaults(spark, sf, tmp_path):
    """Cosine, the 11 nearest at threshold 0.2, the query's own row excluded."""
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = lambda found: {(r.query_id, r.id) for r in found.collect() if r.query_id != r.id}
    best = pairs(search.search_batch(rows, rows, 11, 0.2, COS, 64))
    index = ann.AnnIndex.build(rows, 64)
    found = pairs(index.search(rows, rows, 11, 0.2))
    assert len(best & found) >= 0.9 * len(best)
    assert [s.k for s in index.settings] == [11, 110] and all(s.recall >= 0.95 for s in index.settings)
    wide = pairs(search.search_batch(rows, rows.where("id < 50"), 100, None, COS, 64))
    assert len(wide & pairs(index.search(rows, rows.where("id < 50"), 100, None))) >= 0.9 * len(wide)
    index.save(str(tmp_path / "v1"))
    again = ann.AnnIndex.load(spark, str(tmp_path / "v1"))
    assert again.settings == index.settings and [again.reach(k) for k in (5, 50, 500)] == [index.reach(k) for k in (5, 50, 500)]


def test_lsh_recall_with_more_tables(spark):
    """Eight bits in 256 tables reach the recall at the query's threshold that six tables lack, own rows excluded."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = lambda found: {(r.query_id, r.id) for r in found.collect() if r.query_id != r.id}
    best = pairs(search.search_batch(rows, rows, 11, 0.2, COS, 64))
    recall = lambda tables: len(best & pairs(lsh.LshIndex.build(rows, 8, tables, 64).search(rows, rows, 11, 0.2))) / len(best)
    few, many = recall(6), recall(256)
    print("LSH recall", few, many)
    assert few < 0.5 and many >= 0.9


def test_few_rows(spark):
    rows = table(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert ann.AnnIndex.build(rows, 2).search(rows, rows, 5, None).count() >= 2


def test_sample_and_centroids(spark, random_rows):
    _, rows = random_rows
    a, b = (sorted(r.id for r in cluster.reservoir(rows.repartition(n), 40, 3).collect()) for n in (1, 3))
    assert a == b and len(a) == 40 and cluster.reservoir(rows, 1000).count() == 300
    assert cluster.centroids(rows, 4, 5).shape == (4, 16)


def test_scans(spark, random_rows):
    _, rows = random_rows
    assert search.after(rows, 295).count() == 4 and search.last_id(rows).first()[0] == 299 and search.count(rows).first()[0] == 300
    assert search.get(rows, 5).count() == 1 and search.value(rows, 5).columns == ["id", "vector"]
    keyed = rows.select("id", (F.col("id") % 7).cast("string").alias("rid"))
    assert search.ids_of(keyed, "3").first().id == 297 and search.ids_of(keyed, "x").count() == 0


def test_euclidean_is_exact(spark):
    """Large vectors that lie close together: distances by differences, own rows at 0, ties and near ties in order."""
    rng = np.random.default_rng(3)
    x = (1e4 + rng.standard_normal((200, 32)) * 1e-2).astype(np.float32)
    rows = table(spark, [r.tolist() for r in x])
    wide = x.astype(float)
    for most in (1 << 20, 1):
        got = search.search_batch(rows, rows, 6, None, L2, 32, most).orderBy("query_id", "rank").collect()
        for q in range(200):
            s = np.sqrt(((wide - wide[q]) ** 2).sum(1))
            best = np.lexsort((np.arange(200), s))[:6]
            own = [r for r in got if r.query_id == q]
            assert [r.id for r in own] == best.tolist() and [r.score for r in own] == s[best].tolist() and own[0].score == 0
    assert search.search_batch(rows, rows, 6, 0.0, L2, 32).count() == len({tuple(r) for r in x.tolist()})


def test_timeout(spark):
    import time

    from pyspark.sql.types import LongType

    rows = spark.range(3)
    assert search.within(rows, 60_000).count() == 3
    slow = rows.repartition(2).select(F.udf(lambda i: time.sleep(20) or i, LongType())("id").alias("id"))
    began = time.time()
    with pytest.raises(TimeoutError):
        search.within(slow, 300)
    assert time.time() - began < 15
