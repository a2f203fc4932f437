from __future__ import annotations

import math

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.functions import codec, hashing, kernels, register, text, vector
from vectrail.model import CollectionConfig, Compression, IndexStrategy, Similarity, normalize_request


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def arr(*xs):
    return F.lit(list(map(float, xs))) if xs else F.array().cast("array<double>")


def test_scores(spark):
    a, b = arr(1, 2, 2), arr(2, 0, 1)
    got = one(spark, d=vector.dot(a, b), c=vector.cosine(a, b), l=vector.euclidean(a, b), n=vector.norm(a))
    assert got.d == 4 and got.c == pytest.approx(4 / (3 * math.sqrt(5))) and got.l == pytest.approx(math.sqrt(6)) and got.n == 3


def test_zero_and_lengths(spark):
    got = one(spark, z=vector.cosine(arr(0, 0), arr(1, 2)), d=vector.dot(arr(1), arr(1, 2)), t=vector.euclidean(arr(1, 9), arr(4), truncate=True), n=vector.normalize(arr(0, 0)), u=vector.normalize(arr(3, 4)))
    assert got.z is None and got.d is None and got.t == 3 and got.n == [0, 0] and got.u == pytest.approx([0.6, 0.8])


def test_hamming(spark):
    got = one(spark, a=vector.hamming(F.lit(0b1011).cast("bigint"), F.lit(0b0110).cast("bigint")), w=vector.hamming_words(F.array(F.lit(1), F.lit(7)).cast("array<bigint>"), F.array(F.lit(0), F.lit(0)).cast("array<bigint>")))
    assert got.a == 3 and got.w == 4


def test_mean_pool(spark):
    tokens = F.array(arr(1, 2), arr(3, 4), arr(100, 100))
    got = one(spark, m=vector.mean_pool(tokens, F.array(*map(F.lit, (1, 1, 0)))), z=vector.mean_pool(tokens, F.array(*map(F.lit, (0, 0, 0)))))
    assert got.m == [2, 3] and got.z == [0, 0]


def test_fwht():
    x = np.array([[100, 0.1, -200, 0.2, 5, -0.1, -8, 0.3]])
    signs = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    assert np.allclose(kernels.fwht(x), x @ signs)
    assert np.allclose(kernels.fwht(kernels.fwht(x)), 8 * x)
    for n in (0, 1, 3):
        with pytest.raises(ValueError):
            kernels.fwht(np.zeros((1, n)))


@given(st.integers(1, 5), st.integers(0, 3))
def test_sign_words(rows, extra):
    bits = 8 * (1 + 3 * extra)
    dots = np.random.default_rng(rows + extra).standard_normal((rows, bits))
    dots[0, 0] = 0
    words = kernels.sign_words(dots)
    for r in range(rows):
        whole = sum(int(w) << 32 * k for k, w in enumerate(words[r]))
        assert whole == sum(1 << i for i in range(bits) if dots[r, i] > 0)


def test_projection(spark):
    m = kernels.gaussian(2, 4, 1)
    got = one(spark, p=vector.project(arr(1, 2, 3, 4), m))
    assert np.allclose(got.p, m @ [1, 2, 3, 4])
    with pytest.raises(ValueError):
        vector.project(arr(1, 2), np.zeros((2, 2)))
    near, far = np.ones(1024), np.ones(1024)
    near = near + np.random.default_rng(0).normal(0, 0.01, 1024)
    far = np.random.default_rng(1).uniform(0, 5, 1024)
    p = kernels.gaussian(128, 1024, 3)
    assert np.linalg.norm(p @ (near - 1)) < np.linalg.norm(p @ (far - 1))


def test_random_vectors(spark):
    a = vector.random_vectors(spark, 20, 16, 3, unit=True).collect()
    b = vector.random_vectors(spark, 20, 16, 3, unit=True).repartition(3).orderBy("id").collect()
    assert a == b
    assert all(np.linalg.norm(r.vector) == pytest.approx(1, abs=1e-5) for r in a)
    assert np.linalg.norm(kernels.sign_uniform(3, 9, 1), axis=1) == pytest.approx(1)
    u = kernels.uniform(2)
    assert u.shape == (2, 768) and u.min() >= 0 and u.max() < 1


def test_hash(spark):
    got = one(spark, h=hashing.xxh64_seed0(F.lit("abc")), e=hashing.xxh64_seed0(F.lit("")), n=hashing.xxh64_seed0(F.lit(None).cast("string")))
    assert got.h == 4952883123889572249 and got.n is None
    assert got.e % 2**64 == xxhash.xxh64_intdigest(b"")


def test_codec(spark):
    for order in ("big", "little"):
        got = one(spark, b=codec.floats_to_bytes(arr(1.5, -2), order), v=codec.bytes_to_floats(codec.floats_to_bytes(arr(1.5, -2), order), order))
        assert got.v == [1.5, -2] and bytes(got.b) == np.array([1.5, -2], ">f4" if order == "big" else "<f4").tobytes()


def test_text(spark):
    meta = text.metadata_json(F.lit('a"b'), F.lit('{"k": 1}'))
    got = one(spark, m=meta, r=text.metadata_field(meta, "$.rid"), k=text.metadata_field(meta, "$.extra.k"), n=text.metadata_json(F.lit("r"), F.lit(None).cast("string")), v=text.vector_from_json(F.lit("[1, 2.5]")), t=text.millis_text(F.lit(1700000000123)), d=text.duration_text(F.lit(93784000)))
    assert got.r == 'a"b' and got.k == "1" and got.n == '{"rid":"r","extra":null}' and got.v == [1, 2.5]
    assert got.t == "2023-11-14 22:13:20.123" and got.d == "1d 2H 3m 4s"
    for bad in ("[1, null]", '["x"]', "{}"):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, v=text.vector_from_json(F.lit(bad)))


def test_sql(spark):
    register.register(spark, kernels.gaussian(8, 2, 1))
    row = spark.sql("SELECT vec_dot(array(1,2), array(3,4)) d, vec_cosine(array(0,0), array(1,1)) c, vec_l2(array(0,0), array(3,4)) l, vec_hamming(7, 0) h, vec_normalize(array(3,4)) n, vec_fwht(array(1D,2D)) f, xxh64_seed0('abc') x, vec_lsh(array(1D,0D)) s").first()
    assert (row.d, row.c, row.l, row.h, row.n, row.f, row.x) == (11, None, 5, 3, [0.6, 0.8], [3, -1], 4952883123889572249) and len(row.s) == 1
    assert spark.sql("SELECT vec_mean_pool(v) m FROM VALUES (array(1D,2D)), (array(3D,4D)) t(v)").first().m == [2, 3]


def test_settings():
    c = CollectionConfig.from_request({"name": "a", "index-type": "No-Index", "compression": "zstd", "similarity-alg": "DOT_PRODUCT", "transient": True})
    assert c.strategy is IndexStrategy.NO_INDEX and c.compression is Compression.ZSTD and c.similarity is Similarity.DOT_PRODUCT and c.transient
    assert CollectionConfig.from_json(c.to_json()) == c
    lsh = CollectionConfig.from_request({"type": "LSH", "name": "x", "args": {"k": 32, "L": 4, "dim": 8}})
    assert lsh.lsh["bits"] == 32 and lsh.lsh["tables"] == 4 and lsh.dim == 8
    with pytest.raises(ValueError):
        CollectionConfig.from_request({"type": "GRAPH", "name": "x"})
    assert normalize_request("rest", 5, 0.1) == (11, 0.8)
    assert normalize_request("grpc", 0, -1) == (3, 0.8) and normalize_request("grpc", 7, 0.5) == (7, 0.5)
    assert normalize_request("library") == (11, 0.8)
    with pytest.raises(ValueError):
        normalize_request("admin")


def test_wide_vectors(spark):
    """Normalising and pooling take time linear in the dimension: near that of a norm or a sum."""
    import time

    rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda x: (x * (F.col("id") + 1)).cast("double")).alias("v")).persist()
    rows.count()

    def took(column):
        best = math.inf
        for _ in range(2):
            began = time.perf_counter()
            rows.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    base = took(vector.norm("v"))
    assert took(vector.normalize("v")) < 5 * base + 0.5
    tokens = F.array("v", "v", "v")
    assert took(vector.mean_pool(tokens, F.array(*map(F.lit, (1, 0, 1))))) < 15 * base + 0.5
    rows.unpersist()


def test_rows_of_several_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, 2.0, 3.0, 4.0]), (3, [5.0, 6.0])], "id int, v array<double>").coalesce(1)
    got = {r.id: r.f for r in df.select("id", vector.fwht("v").alias("f")).collect()}
    assert got == {0: [3, -1], 1: None, 2: [10, -2, -4, 0], 3: [11, -1]}
    back = {r.id: r.b for r in df.select("id", codec.bytes_to_floats(codec.floats_to_bytes(F.col("v").cast("array<float>"), "big"), "big").alias("b")).collect()}
    assert back == {0: [1, 2], 1: None, 2: [1, 2, 3, 4], 3: [5, 6]}
