"""Operators 1, 4, 7, 8, 9, 10 and the pipeline against brute force, properties or held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import common, jaccard_join, mixing, quality_classifier, queries, score_aware_ann, sharding, toxicity

from .helpers import ODD, documents, no_documents, odd_documents, rows

SF = "/root/testdata/sf0.01"


def labels(spark, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def odd_labels(spark):
    given = [(1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, None), (7, 1, 1), (8, 0, 1), (11, 1, 0), (12, None, 1), (99, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(given, "doc_id bigint, quality int, toxic int")


# 1: quality classifier


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.7):
        p = rng.normal(1.5, 1, (2000, 2))
        positive = rng.random(4000) < prior
        u = np.where(positive[:, None], rng.normal(1.5, 1, (4000, 2)), rng.normal(-1.5, 1, (4000, 2)))
        model = quality_classifier.PUClassifier(p, u)
        assert abs(model.prior - prior) < 0.12
        assert ((model.score(u) >= 0.5) == positive).mean() > 0.93


def test_risk_by_plain_sums():
    """The fit's steps and the scores against the risk written out row by row."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1.2, (60, 3))
    prior, steps, rate, l2 = 0.4, 25, 0.03, 1e-3
    sig = lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))
    soft = lambda v: math.log1p(math.exp(v))
    w, m, v = [0.0] * 3, [0.0] * 3, [0.0] * 3
    ascents = 0
    for t in range(1, steps + 1):
        dot = lambda x: sum(a * b for a, b in zip(w, x, strict=True))
        positive = [-prior * sum((1 - sig(dot(x))) * x[j] for x in p) / len(p) for j in range(3)]
        negative = [sum(sig(dot(x)) * x[j] for x in u) / len(u) - prior * sum(sig(dot(x)) * x[j] for x in p) / len(p) for j in range(3)]
        rest = sum(soft(dot(x)) for x in u) / len(u) - prior * sum(soft(dot(x)) for x in p) / len(p)
        ascents += rest < 0
        g = [(a + b if rest >= 0 else -b) + l2 * c for a, b, c in zip(positive, negative, w, strict=True)]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g, strict=True)]
        v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g, strict=True)]
        w = [c - rate * (a / (1 - 0.9**t)) / (math.sqrt(b / (1 - 0.999**t)) + 1e-8) for c, a, b in zip(w, m, v, strict=True)]
    assert quality_classifier.fit(p, u, prior, steps, rate, l2) == pytest.approx(w, abs=1e-4)


def test_quality_by_plain_model(spark):
    """Every row's score is the fitted model's on the statistics of its whole text."""
    docs, marks = documents(spark, "0.01"), labels(spark)
    model = quality_classifier.fit_quality(docs, marks)
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, marks).collect()}
    for r in docs.collect():
        x = np.array(quality_classifier.statistics(r.text), np.float32).astype(float)
        z = [max(-8.0, min(8.0, (a - m) / s)) for a, m, s in zip(x, model.basis.mean, model.basis.sd, strict=True)]
        row = [1.0, *z, *(max(a - k, 0.0) for knots in model.basis.knots for a, k in zip(z, knots, strict=True))]
        v = sum(a * b for a, b in zip(row, model.weights, strict=True))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, v)))), abs=1e-9)


def test_quality_held_out(spark):
    got = queries.op1_quality_classifier(spark, SF).join(labels(spark), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert right >= 0.95 * n


def check_scores(spark, score):
    got = rows(score(odd_documents(spark), odd_labels(spark)))
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((d or 0) for d, *_ in ODD)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got)
    carried = score(odd_documents(spark), odd_labels(spark), carry=True).select("doc.*")
    assert carried.columns == odd_documents(spark).columns and carried.count() == len(ODD)
    assert score(no_documents(spark), odd_labels(spark)).count() == 0
    assert score(odd_documents(spark), odd_labels(spark).where("false")).count() == len(ODD)


def test_quality_odd(spark):
    check_scores(spark, quality_classifier.score_quality)
    assert len(quality_classifier.statistics("x y.\nz")) == len(quality_classifier.NAMES) == len(quality_classifier.statistics(None))


# 9: toxicity


def test_toxicity_held_out(spark):
    scored = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(labels(spark, "0.1"), "doc_id").where("held_out").persist()
    of = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert of[0, 0] >= 0.99 * (of[0, 0] + of.get((0, 1), 0))
    assert of[1, 1] >= 0.75 * (of[1, 1] + of.get((1, 0), 0))


def test_toxicity_odd(spark):
    check_scores(spark, toxicity.score_toxicity)


def test_toxicity_by_plain_compression(spark):
    """Scores equal those of a plain version: every window compressed with either dictionary, thresholds counted, a logistic function."""
    import zstandard

    docs = documents(spark)
    model = toxicity.fit_toxicity(docs, labels(spark, "0.01"))

    def compressed(content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return lambda w: len(z.compress(w))

    ordinary, both = compressed(model.ordinary), compressed(model.ordinary + model.toxic)
    cal = model.calibration
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels(spark, "0.01")).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        words, saved = text.lower().encode().split(), []
        for i in range(0, len(words), toxicity.WINDOW):
            w = b" " + b" ".join(words[i : i + toxicity.WINDOW]) + b" "
            saved.append(ordinary(w) - both(w))
        reach = [sum(s >= t for s in saved) for t in toxicity.THRESHOLDS]
        x = [*(math.log(1 + 1000 * c / max(1, len(saved))) for c in reach), math.log(1 + reach[2]), math.log(1 + reach[4]), math.log(1 + len(saved))]
        z = sum(w * (v - m) / s for w, v, m, s in zip(cal.w, x, cal.mean, cal.sd, strict=False)) + cal.w[-1]
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_labels_without_documents(spark):
    """Foreign labels change nothing: samples are drawn from labels that have a document."""
    docs, own = documents(spark), labels(spark, "0.01")
    foreign = spark.range(2_000_000).select((F.col("id") + 10_000_000).alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    for score in (toxicity.score_toxicity, quality_classifier.score_quality):
        alone, among = ({r.doc_id: r.score for r in score(docs, x).collect()} for x in (own, own.unionByName(foreign)))
        assert alone == among


def test_trainer_windows(spark):
    """The trainer's budget is spread over all texts, and is a parameter."""
    texts = [" ".join(f"d{d}w{i}" for i in range(50 + 400 * (d % 3))) for d in range(60)]
    every = toxicity.trainer_windows(texts, None)
    assert every == toxicity.trainer_windows(texts, 1 << 30) and sum(len(w.split()) for w in every) == sum(len(t.split()) for t in texts)
    size = sum(map(len, every))
    some = toxicity.trainer_windows(texts, size // 10)
    assert 0.08 * size < sum(map(len, some)) <= 0.11 * size and set(some) < set(every)
    long = {d for d in range(60) if d % 3}
    assert long <= {int(w.split()[0][1:].split(b"w")[0]) for w in some}
    scored = toxicity.score_toxicity(documents(spark), labels(spark, "0.001"), trainer_bytes=50_000)
    assert scored.count() == documents(spark).count()


def test_distance():
    rng = random.Random(0)
    usual = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(400)]
    ordinary = [" ".join(rng.choices(usual, k=60)) for _ in range(200)]
    toxic = [" ".join(w if rng.random() > 0.08 else rng.choice(["zwicked", "qvile", "xfoul"]) for w in rng.choices(usual, k=60)) for _ in range(200)]
    distance = toxicity.Distance(*toxicity.train_dictionaries(toxic[:100], ordinary[:100]))
    assert np.mean([distance.windows(t).max() for t in toxic[100:]]) > np.mean([distance.windows(t).max() for t in ordinary[100:]]) + 2
    assert len(distance.windows(None)) == 0 and len(distance.features("")) == len(distance.features("a b"))
    marks = toxicity.characteristic([set(toxicity.words_of(t)) for t in toxic[:100]], [set(toxicity.words_of(t)) for t in ordinary[:100]])
    assert set(marks) == {b"zwicked", b"qvile", b"xfoul"}
    assert toxicity.unlike([toxic[0], toxic[0].upper(), ordinary[0]]) == [toxic[0], ordinary[0]]
    assert toxicity.train_dictionaries(["bad bad"], ["good day"])[0]
    assert len(toxicity.spread(" ".join(map(str, range(1000))), 0.1).split()) == 100


# 4: nearest neighbours


def brute_nearest(ids, x, q, k=20):
    s = (x * x[q]).sum(1)
    at = np.array([i for i in range(len(ids)) if ids[i] != ids[q]], int)
    return at[np.lexsort((ids[at], -s[at]))[:k]], s


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((9000, 64)).astype(np.float32)
    if scale:
        x *= rng.uniform(0.2, 3, (9000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, vector array<float>")
    index, book, blocks = score_aware_ann.build_index(df)
    assert blocks >= 3 and index.count() == 9000
    got = defaultdict(list)
    for r in score_aware_ann.search(index, book, blocks, index.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, wide, hit = np.arange(9000), x.astype(float), 0
    for q in range(0, 9000, 20):
        best, s = brute_nearest(ids, wide, q)
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and all(v == s[i] for _, i, v in got[q])
        assert [(-v, i) for _, i, v in got[q]] == sorted((-v, i) for _, i, v in got[q])
        hit += len(set(best.tolist()) & {i for _, i, _ in got[q]})
    assert hit >= 0.95 * 20 * 450


def test_anisotropic_loss():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware, plain = score_aware_ann.Codebook(x, threshold=0.3), score_aware_ann.Codebook(x, threshold=0.0)
    assert aware.eta > 2 and plain.eta == 1

    def along(book):
        codes = book.encode(x)
        back = np.stack([book.centres[m][codes[:, m]] for m in range(book.parts)], 1).reshape(len(x), -1)[:, :32]
        return (((x - back) * x).sum(1) ** 2).mean()

    assert along(aware) < 0.8 * along(plain)
    codes = aware.encode(x[:50])
    back = np.stack([aware.centres[m][codes[:, m]] for m in range(aware.parts)], 1).reshape(50, -1)[:, :32]
    assert np.allclose(aware.scan(x[:7], aware.packed(codes)), x[:7] @ back.T, atol=1e-5)


def test_nearest_odd(spark):
    one, nan, inf = [1.0, 0.0, 0.0], [math.nan, 1.0, 0.0], [math.inf, 0.0, 0.0]
    held_rows = [(i, one) for i in range(0, 60)] + [(60, nan), (80, inf), (100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0]), (160, [1.0, None, 2.0]), (180, [0.0, 2.0, 0.0]), (None, one), (0, one), (20, one), (200, [-0.0, 2.0, 0.0])]
    df = spark.createDataFrame(held_rows, "id bigint, vector array<float>").withColumn("code", F.lit("own"))
    index, book, blocks = score_aware_ann.build_index(df)
    got = score_aware_ann.search(index, book, blocks, index.where("id % 20 = 0")).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 180, 200}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 20] == [i for i in range(21) if i != 20]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 180][:2] == [(200, 4.0), (0, 0.0)]
    few = df.where("id in (180, 0)")
    index, book, blocks = score_aware_ann.build_index(few.distinct())
    assert score_aware_ann.search(index, book, blocks, index.where("id % 20 = 0")).count() == 2
    index, book, blocks = score_aware_ann.build_index(df.where("false"))
    assert score_aware_ann.search(index, book, blocks, index).count() == 0


def test_nearest_of_repeated_ids(spark, monkeypatch):
    """An id with several vectors has the best score of any of them, and is found once."""
    monkeypatch.setattr(score_aware_ann, "UNIT", 64)
    rng = np.random.default_rng(8)
    ids = [*rng.integers(0, 120, 400).tolist(), *[20] * 60, *[21] * 60]
    x = rng.standard_normal((len(ids), 8)).astype(np.float32)
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "id bigint, vector array<float>").repartition(3)
    index, book, blocks = score_aware_ann.build_index(df)
    assert blocks > 1
    got = defaultdict(list)
    for r in score_aware_ann.search(index, book, blocks, index.where("id % 20 = 0"), rerank=1000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wide, own = x.astype(float), np.array(ids)
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q in got:
        best = {}
        for v in wide[own == q]:
            for i, s in zip(ids, (wide * v).sum(1), strict=True):
                if i != q:
                    best[i] = max(best.get(i, -math.inf), s)
        assert got[q] == sorted(best.items(), key=lambda e: (-e[1], e[0]))[:20]


def test_samples_of_repeated_rows(spark):
    """A sample holds distinct rows, however often one repeats, and is never lost."""
    hot = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text"))
    more = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    one_id = spark.range(5_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("own "), "id").alias("text"))
    for seed in range(4):
        assert len(common.sampled(common.learnable(hot), 50, seed)) == 1
        both = common.sampled(common.learnable(hot.unionByName(more)), 200, seed)
        assert len(both) == len(set(both)) == 200
        assert len(common.sampled(common.learnable(one_id), 200, seed)) == 200
    vectors = spark.range(20_000).select(F.lit(3).alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    index, book, _ = score_aware_ann.build_index(vectors, sample=100)
    assert book is not None and index.count() == 20_000


# 7: sharding


def check_shards(got, shards):
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    together = defaultdict(set)
    for r in got:
        together[bytes(r["group_key"])].add(r["shard"])
    assert all(len(v) == 1 for v in together.values())


@pytest.mark.parametrize("bundles", [1 << 15, 64])
def test_sharding(spark, bundles):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows(sharding.shard_documents(docs, 8, bundles))
    check_shards(got, 8)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) <= 1.02 * min(loads.values())
    if bundles > 1000:  # the law itself: groups by size to the least-loaded shard
        sizes = Counter()
        for t in texts.values():
            sizes[t] += len(t.encode()) + 16
        bare = [0] * 8
        for v in sorted(sizes.values(), reverse=True):
            bare[bare.index(min(bare))] += v
        assert max(loads.values()) <= 1.005 * max(bare)


def test_schedule():
    assert sharding.schedule([(5, "a"), (3, "b"), (3, "c"), (2, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_sharding_odd(spark):
    got = rows(sharding.shard_documents(odd_documents(spark), 5))
    check_shards(got, 5)
    assert len(got) == len(ODD) and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (3, 4)} == {(16, 0)}
    assert sharding.shard_documents(no_documents(spark), 5).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    check_shards(rows(sharding.shard_documents(hot, 5)), 5)


def test_slots_of_repeated_rows(spark):
    """Equal rows are counted and numbered in runs: no task ranks them all."""
    hot = spark.range(30_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    more = spark.range(500).select(F.when(F.col("id") > 50, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 100).alias("text"))
    got = rows(sharding.shard_documents(hot.unionByName(more).repartition(5), 4))
    check_shards(got, 4)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got)[1, zlib.crc32(b"same")] == 30_000 and len(got) == 30_500


# 8: mixing


def test_targets():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 0}
    got = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)))
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] + got["c"] == pytest.approx(1980) and got["c"] == pytest.approx(1.5 * got["b"])
    assert mixing.cyclic_weights([None, "b", "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}
    rng = random.Random(0)
    for _ in range(300):
        sizes = {str(i): rng.choice([0, rng.randint(1, 50), rng.randint(1, 10_000)]) for i in range(rng.randint(1, 12))}
        weights = mixing.cyclic_weights(list(sizes))
        got = mixing.targets(sizes, weights)
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))
        free = [s for s in sizes if got[s] < 3 * sizes[s] - 1e-9]
        assert all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
        assert len({round(got[s] / weights[s], 6) for s in free}) <= 1


@pytest.mark.parametrize("cell", [4096, 20])
def test_mix(spark, cell):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = rows(mixing.mix(docs.repartition(3), cell=cell))
    again = rows(mixing.mix(docs.repartition(7), cell=cell))
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(again, key=key)
    by = defaultdict(list)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
        by[r["source"]].append(r)
    for own in by.values():
        largest = max(r["size"] for r in own)
        cells = max(1, len(own) // cell)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * largest * math.sqrt(cells)


def test_targets_in_rounds(spark):
    """The same targets, found without collecting the sources."""
    rng = random.Random(6)
    docs = [(i, "w " * rng.choice([0, 1, 5, 60]), rng.choice([None, *"abcdefghijklmnopq", "é", "zz"])) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)
    few, many = ({r["doc_id"]: r for r in rows(mixing.mix(df, most_sources=n))} for n in (100, 0))
    assert few == many
    with pytest.raises(ValueError):
        mixing.mix(df, weights=lambda sources: dict.fromkeys(sources, 1), most_sources=0)


def test_mix_without_ids(spark):
    """Rows without an id, or all of one, are dealt by text; the source still comes near its target."""
    docs = [(None if i % 3 else 5, "w " * (1 + i % 9) + str(i), "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(4)
    mixed = rows(mixing.mix(df, cell=100))
    for source in "ab":
        own = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.05 * own[0]["target"]


def test_fractions_are_probabilities(spark):
    """Over seeds, a document is copied as often as its source's rate says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 3 > 0]) for i in range(60)], "doc_id bigint, text string, source string")
    got = [r for seed in range(30) for r in rows(mixing.mix(docs, seed=seed))]
    per = defaultdict(list)
    for r in got:
        per[r["doc_id"]].append((r["copies"], r["rate"]))
    assert all(abs(np.mean([c for c, _ in v]) - v[0][1]) < 0.4 for v in per.values())
    assert np.mean([c - r for v in per.values() for c, r in v]) == pytest.approx(0, abs=0.02)


def test_mix_odd(spark):
    got = rows(mixing.mix(odd_documents(spark)))
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    emitted = mixing.emit(odd_documents(spark))
    assert emitted.columns == odd_documents(spark).columns and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mix(no_documents(spark)).count() == 0 and mixing.emit(no_documents(spark)).count() == 0


# 10: Jaccard join


def brute_components(docs):
    """doc_id -> (n, component) from every pair; docs: (doc_id, text)."""
    sets = []
    for d, t in docs:
        w = (t or "").encode("utf-8").lower().split()
        sets.append((d, frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if a and b and d is not None and e is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), None if d is None else low[root(i)]) for i, (d, s) in enumerate(sets)), key=str)


def near_copies(seed, groups, most, words=60, rate=0.06):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    out = []
    passage = rng.choices(vocabulary, k=25)
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, words))
        if rng.random() < 0.3:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.randint(1, most)):
            out.append(" ".join(rng.choice(vocabulary) if rng.random() < rate * rng.random() else w for w in base))
    rng.shuffle(out)
    return [(i * 7 % 100_003, t.upper() if i % 5 == 0 else t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "groups", "most"), [(0, 60, 6), (1, 5, 60), (2, 1, 150)])
def test_components(spark, seed, groups, most, monkeypatch):
    docs = near_copies(seed, groups, most)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == brute_components(docs)
    for name, most in (("BLOCK", 16), ("ELEMENTS", 1_500)) if seed == 2 else ():  # large groups in blocks, by nodes and by shingles
        with monkeypatch.context() as m:
            m.setattr(jaccard_join, name, most)
            assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str) == got


def test_components_of_documents(spark):
    df = documents(spark)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])


def test_components_odd(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd_documents(spark)).collect()), key=str)
    assert got == brute_components([(d, t) for d, t, *_ in ODD])
    assert jaccard_join.jaccard_components(no_documents(spark)).count() == 0


def test_components_of_repeated_ids(spark, monkeypatch):
    """One id may stand for several texts, and a row may repeat many times."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    docs = [(i % 40, t) for i, t in near_copies(3, 4, 40)] * 2
    docs += docs[:1] * 300
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == brute_components(docs)


def test_prefix_lemma():
    """Sets that link share l of their l-prefixes, and one of them is among those that are probed with."""
    rng = random.Random(4)
    for _ in range(400):
        a = set(rng.sample(range(10_000), rng.randint(1, 300)))
        b = set(a)
        for x in rng.sample(sorted(a), int(len(a) * rng.random() * 0.3)):
            b.discard(x)
        b |= set(rng.sample(range(10_000), int(len(a) * rng.random() * 0.2)))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        for l in {1, int(jaccard_join.allowed(len(a))), 2}:  # noqa: E741
            if l > min(jaccard_join.longest(len(b)), jaccard_join.allowed(len(a))):
                continue
            pa_, pb = (set(sorted(s)[: len(s) - jaccard_join.need(len(s)) + l]) for s in (a, b))
            assert len(pa_ & pb) >= l
        assert jaccard_join.allowed(len(a)) <= jaccard_join.longest(len(b))


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(50)]
    got = jaccard_join.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(50) for j in range(i + 1, 50))


def test_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: root(n) for n in list(parent) if root(n) != n}


# The pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).persist()
        assert now.columns == docs.columns
        kept.append(now.count())
    marks = labels(spark)
    clean = docs.join(marks.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").count()
    after_two = corpus_pipeline.drop_low_quality(spark, corpus_pipeline.drop_toxic(spark, docs, SF), SF)
    assert after_two.join(marks.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").count() >= 0.97 * clean
    assert docs.count() > kept[0] > kept[1] > kept[2]
    classes = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(after_two).collect()}
    survivors = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, after_two, SF).collect()}
    assert survivors == set(classes.values())
    assert corpus_pipeline.pack_sequences(spark, now, SF).agg(F.sum("length")).first()[0] > 0


def test_near_copies_of_repeated_ids(spark):
    """One row of each component stays, whichever texts share an id."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    docs = [(0, a), (1, near(a)), (1, b), (2, near(b)), (5, c), (5, near(c)), (7, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert {(0, a), (1, b), (7, None), (7, "")} < set(left) and len(left) == 5
    assert sum(d == 5 for d, _ in left) == 1
    many = sorted({(i % 40, t) for i, t in near_copies(4, 30, 6)})
    component = {many[n]: low for n, _, low in brute_components([(n, t) for n, (_, t) in enumerate(many)])}
    df = spark.createDataFrame(many * 2, "doc_id bigint, text string").repartition(5)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(component[x] for x in left) == sorted(set(component.values()))
    assert all(d == min(i for (i, t), low in component.items() if low == component[d, x]) for d, x in left)


def test_pipeline_stages_odd(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd_labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_documents(spark), str(tmp_path))
        assert got.count() >= 0
        assert stage(spark, no_documents(spark), str(tmp_path)).count() == 0
    left = corpus_pipeline.drop_near_copies(spark, odd_documents(spark), "")
    assert left.columns == odd_documents(spark).columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10, 11]


def found_components(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)


def test_hot_shingles(spark, monkeypatch):
    """Shingles split over buckets, by exact or estimated counts, change nothing."""
    docs = near_copies(5, 25, 30)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    expected = brute_components(docs)
    used = []
    make = jaccard_join._hot
    monkeypatch.setattr(jaccard_join, "_hot", lambda *a: used.append(make(*a)) or used[-1])
    for hot, sample in ((4, 1), (12, 1), (6, 3)):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        monkeypatch.setattr(jaccard_join, "SAMPLE", sample)
        assert found_components(df) == expected
        assert len(used[-1].tok) and used[-1].slots.max() > 1


def test_fingerprints_that_clash(spark, monkeypatch):
    """Sets that share half of their fingerprint are told apart by the other half."""
    docs = near_copies(6, 30, 8)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    whole = jaccard_join.fingerprint
    monkeypatch.setattr(jaccard_join, "fingerprint", lambda s: (whole(s)[0] % 17, whole(s)[1]))
    sets, names = jaccard_join._names(jaccard_join._sets(df.select("doc_id", F.col("text").cast("binary").alias("text"))))
    assert names
    assert found_components(df) == brute_components(docs)
