"""What leaves a task grows with the queries, not with the pairs, and both ways to the same answer agree."""

from __future__ import annotations

import numpy as np
import pytest

from vectrail.model import Similarity
from vectrail.operators import ann, lsh, search, tiles

COS, DOT, L2 = Similarity.COSINE, Similarity.DOT_PRODUCT, Similarity.EUCLIDEAN


@pytest.fixture(scope="module")
def rows(spark):
    """600 vectors, the last half copies of the first."""
    x = np.random.default_rng(0).standard_normal((300, 16)).astype(np.float32)
    return spark.createDataFrame([(i, x[i % 300].tolist()) for i in range(600)], "id bigint, vector array<float>").repartition(3).persist()


def found(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("similarity", "threshold"), [(COS, 0.2), (DOT, None), (L2, 5.0)])
def test_batch(spark, rows, similarity, threshold, monkeypatch):
    """F8, F9, F10: a query's k best leave a task once; copies are tied and go by id, wherever they lie."""
    out = tiles.meet(rows, rows, lambda part: tiles.Best(part, 4, threshold, similarity), tiles.FOUND, 16, 600)
    assert out.count() <= 4 * 600
    got = found(search.search_batch(rows, rows, 4, threshold, similarity, 16, 1))
    assert got == found(search.search_batch(rows, rows, 4, threshold, similarity, 16))
    assert {q: i for q, rank, i, _ in got if rank <= 2 and similarity is not DOT} == {} | {q: q % 300 + 300 for q in range(600) if similarity is not DOT}


def test_lsh(spark, rows):
    """no pairs are shuffled; a search finds the best of its candidates."""
    index = lsh.LshIndex.build(rows, 8, 3, 16)
    pairs = lsh.candidates(index.codes, index.codes, 8)
    listed = {(r.query_id, r.id) for r in pairs.collect()}
    assert len(listed) == pairs.count()
    code = {}
    for r in index.rows.collect():
        code.setdefault(r.id, {})[r.t] = tuple(r.code)
    assert listed == {(a, b) for a in code for b in code if any(code[a][t] == code[b][t] for t in range(3))}
    scored = search.top_k(lsh.rerank(pairs, rows, rows, 600, 0.1, COS).drop("rank"), 4, COS, by=("query_id",))
    assert found(index.search(rows, rows, 4, 0.1)) == found(scored)
    some = rows.where("id < 20")
    assert found(index.search(rows, some, 4, 0.1)) == [r for r in found(scored) if r[0] < 20]
    wide = lsh.LshIndex.build(rows, 16, 2, 16)
    old = lsh.LshIndex(wide.planes, lsh.signatures(rows, wide.planes))  # signatures as they were kept before
    assert found(wide.search(rows, rows, 4, None)) == found(old.search(rows, rows, 4, None))


@pytest.mark.parametrize("similarity", [COS, DOT, L2])
def test_ann(spark, rows, similarity):
    """whether candidates are listed or met in tiles, the same rows are found; with all kept, the exact ones."""
    index = ann.AnnIndex.build(rows, 16, ann.AnnParameters(probes=9, oversample=4), similarity)
    assert found(index.search(rows, rows, 4, None, listed=0)) == found(index.search(rows, rows, 4, None))
    every = ann.AnnIndex.build(rows, 16, ann.AnnParameters(probes=1 << 30, oversample=1 << 20), similarity)
    assert found(every.search(rows, rows, 4, None)) == found(search.search_batch(rows, rows, 4, None, similarity, 16))
