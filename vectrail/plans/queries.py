"""The registered queries over ``embeddings`` (and a few over other tables), with the same queries as SQL.

The query vector of single-vector queries is the one of ``vec_id`` 0; batched
queries use every row as a query.  Scores are doubles rounded to six places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashing, register, text, vector
from ..model import DEFAULT_THRESHOLD, DEFAULT_TOP_K, CollectionConfig, Similarity, normalize_request
from ..operators import ann, cluster, lsh, search
from ..sources import binary, suppliers
from ..sources.files import Files
from ..sources.scratch import shared_path
from ..sources.store import refused
from ..streaming.ingest import ingest
from .database import Database

THRESHOLD = 0.2
BITS, TABLES, DIM, TO = 8, 6, 64, 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(rows: DataFrame) -> list[float]:
    return rows.where("id = 0").select("vector").first()[0]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _single(similarity: Similarity, k: int = DEFAULT_TOP_K, threshold: float | None = THRESHOLD, label: int | None = None, order: str = "desc"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir)
        where = None if label is None else F.col("label") == label
        return _rounded(search.search(rows, _query(rows), k, threshold, similarity, where, order, columns=("label",)))

    return run


def topk_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best last: place says where a row stands in the answer."""
    found = _single(Similarity.COSINE, order="asc")(spark, sf_dir).collect()  # k rows
    return spark.createDataFrame([(n, r.id, r.score) for n, r in enumerate(found, 1)], "place int, id bigint, score double")


def threshold_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _rounded(search.scored(rows, _query(rows), Similarity.COSINE, THRESHOLD).select("id", "score"))


def batched_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _rounded(search.search_batch(rows, rows, DEFAULT_TOP_K, THRESHOLD, Similarity.COSINE, DIM))


def batched_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    found = search.search_batch(rows, rows, 5, 1.2, Similarity.EUCLIDEAN, DIM)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def topk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return search.search(rows, _query(rows), DEFAULT_TOP_K, THRESHOLD, columns=()).select("id")


def merged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    q = _query(rows)
    parts = [search.search(rows, q, DEFAULT_TOP_K, THRESHOLD, where=F.col("label") % 2 == n, columns=()) for n in (0, 1)]
    return _rounded(search.merge_top_k(parts, DEFAULT_TOP_K))


def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(_vectors(spark, sf_dir))


def last_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.last_id(_vectors(spark, sf_dir))


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", F.size("vector").alias("dim"), F.round(vector.norm("vector"), 6).alias("norm"))


def scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keys(_vectors(spark, sf_dir))


def scan_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.after(_vectors(spark, sf_dir), 99).select("id", "label")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.get(_vectors(spark, sf_dir), 42).select("id", "label", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.concat(F.lit("label-"), F.col("label")).alias("rid"))
    return search.ids_of(rows, "label-3")


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.posexplode(vector.normalize(F.transform("vector", lambda x: x * 3))).alias("pos", "x"))
    return rows.select("id", "pos", F.round("x", 6).alias("x"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    rows = _vectors(spark, sf_dir)
    rows.createOrReplaceTempView("vectrail_vectors")
    q = "array(" + ", ".join(f"{x!r}D" for x in _query(rows)) + ")"
    return spark.sql(
        f"SELECT id, round(vec_dot({q}, vector), 6) AS dot, round(vec_cosine({q}, vector), 6) AS cosine, "
        f"round(vec_l2({q}, vector), 6) AS l2, vec_hamming(id, 5) AS hamming FROM vectrail_vectors"
    )


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.signatures(_vectors(spark, sf_dir), lsh.portable_planes(BITS, TABLES, DIM))


def lsh_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("id", "t", F.element_at("code", 1).alias("code"))


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lsh.codes(_vectors(spark, sf_dir), lsh.portable_planes(BITS, TABLES, DIM))
    return lsh.candidates(rows, rows, BITS)


def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    planes = lsh.portable_planes(BITS, TABLES, DIM)
    index = lsh.LshIndex(planes, lsh.codes(rows, planes))
    return _rounded(index.search(rows, rows, DEFAULT_TOP_K, THRESHOLD))


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every row's signatures to those of row 0."""
    rows = _signatures(spark, sf_dir).select("id", "t", F.element_at("code", 1).alias("code"))
    own = rows.where("id = 0").select("t", F.col("code").alias("own"))
    return rows.join(own, "t").select("id", "t", vector.hamming("code", "own").alias("distance"))


def _middle(rows: DataFrame) -> int:
    """Where a stored index would end: half of the ids."""
    return rows.agg((F.max("id") / 2).cast("bigint")).first()[0]


def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the middle as the index's answer, the rest as fresh rows, in one top-k."""
    rows = _vectors(spark, sf_dir)
    q, end = _query(rows), _middle(rows)
    indexed = search.search(rows.where(F.col("id") <= end), q, DEFAULT_TOP_K, THRESHOLD)
    fresh = search.search(search.not_indexed(rows, end), q, DEFAULT_TOP_K, THRESHOLD)
    return _rounded(search.hybrid(indexed, fresh, DEFAULT_TOP_K))


def delta_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return search.not_indexed(rows, indexed=docs.where(F.col("id") <= _middle(rows))).select("id")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), text.metadata_json("source", F.concat(F.lit('{"chars":'), F.col("n_chars"), F.lit("}"))).alias("meta"))


def _metadata(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir)
        best = search.search(rows, _query(rows), DEFAULT_TOP_K, THRESHOLD, columns=())
        return _rounded(search.with_metadata(best, _meta(spark, sf_dir), how))

    return run


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    meta = text.metadata_json("event_type", "props")
    return events.select("event_id", text.metadata_field(meta, "$.rid").alias("rid"), text.metadata_field(meta, "$.extra.k").cast("bigint").alias("k"))


def vector_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    back = text.vector_from_json(F.to_json("vector"))
    return rows.select("id", F.round(vector.norm(back), 5).alias("norm"))


def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select("event_id", text.millis_text(millis).alias("at"), text.duration_text(F.col("event_id") * 1_234_567).alias("lasting"))


def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = vector.mean_vector(_vectors(spark, sf_dir), ["label"])
    return pooled.select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def mean_pool_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token vectors, the row's and its reverse; the mask takes both, one or neither by label."""
    rows = _vectors(spark, sf_dir)
    tokens = F.array(F.col("vector"), F.reverse("vector"))
    mask = F.array((F.col("label") % 3 > 0).cast("int"), (F.col("label") % 3 > 1).cast("int"))
    pooled = rows.select("id", F.posexplode(vector.mean_pool(tokens, mask)).alias("pos", "x"))
    return pooled.select("id", "pos", F.round("x", 6).alias("x"))


def fwht(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.posexplode(vector.fwht_normalized("vector")).alias("pos", "x"))
    return rows.select("id", "pos", F.round("x", 6).alias("x"))


def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = lsh.portable_planes(TO, 1, DIM)[0]
    rows = _vectors(spark, sf_dir).select("id", F.posexplode(vector.project("vector", matrix)).alias("pos", "x"))
    return rows.select("id", "pos", F.round("x", 6).alias("x"))


def dup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    doubled = rows.select("id", "vector").unionByName(rows.where("label = 1").select((F.col("id") + 1_000_000).alias("id"), "vector"))
    return hashing.duplicates(doubled).select("first_id", "rows")


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    bent = F.when(F.col("label") == 1, F.slice("vector", 1, 63)).when(F.col("label") == 2, F.lit(None)).otherwise(F.col("vector"))
    judged = rows.select(bent.alias("vector"), F.when(F.col("label") != 3, F.lit("r")).alias("rid")).select(F.coalesce(refused(DIM), F.lit("stored")).alias("outcome"))
    return judged.groupBy("outcome").agg(F.count("*").alias("n"))


def xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", hashing.xxh64_seed0("text").alias("hash"))


def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.reservoir(_vectors(spark, sf_dir), 100, seed=7).select("id")


def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.centroid_rows(_vectors(spark, sf_dir), 8, max_iter=20)


def pq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.AnnIndex.build(_vectors(spark, sf_dir), DIM)
    return index.codes.select("id", "cell", F.hex("code").alias("code"))


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _rounded(ann.AnnIndex.build(rows, DIM).search(rows, rows, DEFAULT_TOP_K, THRESHOLD))


def ivf_search_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cell probed and every candidate kept, the index answers exactly."""
    rows = _vectors(spark, sf_dir)
    parameters = ann.AnnParameters(probes=1 << 30, oversample=1 << 20)
    return _rounded(ann.AnnIndex.build(rows, DIM, parameters).search(rows, rows, DEFAULT_TOP_K, THRESHOLD))


def random_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector.random_vectors(spark, 200, 32, 5, "gaussian", unit=True)
    return made.select("id", F.round(vector.norm("vector"), 5).alias("norm"))


def euclidean_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.round(vector.euclidean_2d(F.col("p_size").cast("double"), "p_retailprice", F.lit(10.0), F.lit(1000.0)), 4).alias("distance"))


def _collection(spark: SparkSession, sf_dir: str, kind: str):
    """All embeddings in a new collection, in two appends; rids are the ids of the table."""
    rows = _vectors(spark, sf_dir)
    made = Database(spark, shared_path(spark, "database")).create({"type": kind, "name": "vectors"})
    inputs = rows.select("id", "vector", F.col("id").cast("string").alias("rid"), F.concat(F.lit('{"label":'), F.col("label"), F.lit("}")).alias("extra"))
    end = _middle(rows)
    made.add(inputs.where(F.col("id") <= end))
    return made, inputs.where(F.col("id") > end)


def _by_rid(found: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id and id of a batched result as the rids of a collection."""
    rid = rows.select("id", F.col("rid").cast("bigint").alias("rid"))
    q = rid.select(F.col("id").alias("query_id"), F.col("rid").alias("q"))
    return _rounded(found.join(q, "query_id").join(rid, "id").select(F.col("q").alias("query_id"), F.col("rid").alias("id"), "score"))


def collection_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, more = _collection(spark, sf_dir, "FLAT")
    made.add(more)
    return _by_rid(made.search_batch(made.rows(), DEFAULT_TOP_K, THRESHOLD), made.rows())


def collection_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over the first append, every cell probed, and the second append beside it."""
    made, more = _collection(spark, sf_dir, "ANN")
    made.build_index(ann.AnnParameters(probes=1 << 30, oversample=1 << 20))
    made.add(more)
    return _by_rid(made.search_batch(made.rows(), DEFAULT_TOP_K, THRESHOLD), made.rows())


def collection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, more = _collection(spark, sf_dir, "FLAT")
    made.add(more)
    return made.records().select(F.col("rid").cast("bigint").alias("vec_id"), text.metadata_field("meta", "$.extra.label").cast("int").alias("label"))


def collection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are contiguous over appends."""
    made, more = _collection(spark, sf_dir, "FLAT")
    made.add(more)
    return made.rows().select("id")


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.with_ordinals(_vectors(spark, sf_dir).where("label <> 1")).select("ord", "id")


def float_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through big-endian and little-endian bytes and back."""
    rows = _vectors(spark, sf_dir)
    big = codec.bytes_to_floats(codec.floats_to_bytes(F.col("vector"), "big"), "big")
    both = codec.bytes_to_floats(codec.floats_to_bytes(big, "little"), "little")
    return rows.select("id", F.posexplode(both).alias("pos", "x")).select("id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def hamming_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signatures of a row as one wide code, against those of row 0."""
    wide = _signatures(spark, sf_dir).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", F.element_at("code", 1).alias("c")))), lambda z: z["c"]).alias("words"))
    own = F.lit(wide.where("id = 0").first().words).cast("array<bigint>")
    return wide.select("id", vector.hamming_words("words", own).alias("distance"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``add`` refuses, and why, beside what it stores."""
    bent = F.when(F.col("label") == 1, F.slice("vector", 1, 63)).when(F.col("label") == 2, F.lit(None)).when(F.col("label") == 4, F.array().cast("array<float>")).otherwise(F.col("vector"))
    rows = _vectors(spark, sf_dir).select(bent.alias("vector"), F.when(F.col("label") != 3, F.lit("r")).alias("rid"))
    made = Database(spark, shared_path(spark, "database")).create(CollectionConfig("vectors", dim=DIM))
    made.add(rows.where("label % 2 = 0"))
    made.add(rows.where("label % 2 = 1"))
    refused_rows = made.quarantine().groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"))
    return refused_rows.unionByName(made.rows().agg(F.count("*").alias("n")).select(F.lit("stored").alias("outcome"), "n"))


def _exported(headered: bool):
    """Vectors through segment files, some hundred rows to a file, and back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, "segments")
        binary.write_segments(_vectors(spark, sf_dir), path, DIM, headered, 128)
        back = binary.read_headered(spark, path) if headered else binary.read_frames(spark, path, DIM)
        number = F.regexp_extract("file", r"segment\.(\d+)\.vec", 1).cast("bigint")
        return back.select(number.alias("segment"), "id", F.posexplode("vector").alias("pos", "x")).select("segment", "id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))

    return run


def fvecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the vectors as fvecs, and their ids as ivecs, read back by place."""
    some = _vectors(spark, sf_dir).where("id < 100").orderBy("id").collect()
    path, files = shared_path(spark, "vecs"), Files(spark)
    files.make(path)
    files.write(f"{path}/a.fvecs", binary.to_records(np.array([r.vector for r in some], np.float32), "<f4"))
    files.write(f"{path}/a.ivecs", binary.to_records(np.array([[r.id] for r in some], np.int32), "<i4"))
    ids = binary.read_ivecs(spark, f"{path}/a.ivecs").select(F.col("id").alias("at"), F.element_at("vector", 1).cast("bigint").alias("id"))
    back = binary.read_fvecs(spark, f"{path}/a.fvecs").select(F.col("id").alias("at"), F.posexplode("vector").alias("pos", "x"))
    return back.join(ids, "at").select("id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "matrix")
    binary.write_matrix(spark, lsh.portable_planes(TO, 1, DIM)[0], path)
    back = binary.read_matrix(spark, path)
    rows = [(p, d, round(float(x), 6)) for p, row in enumerate(back) for d, x in enumerate(row)]
    return spark.createDataFrame(rows, "p bigint, d bigint, w double")


def index_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds, an older one made active, a purge to one: the newest and the active one stay."""
    made, _ = _collection(spark, sf_dir, "ANN")
    built = [made.build_index(ann.AnnParameters(cells=4, probes=4, sample=500), keep=9) for _ in range(3)]
    made.enable(built[0])
    purged = made.purge(1)
    states = [(n + 1, "purged" if b in purged else "active" if b == made.active_index() else "kept") for n, b in enumerate(built)]
    return spark.createDataFrame(states, "build int, state string").where(F.lit(made.versions() == [built[0], built[2]]))


def build_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each build, from the log, oldest first, and from the newest lines."""
    made, more = _collection(spark, sf_dir, "ANN")
    parameters = ann.AnnParameters(cells=4, probes=4, sample=500)
    made.build_index(parameters)
    made.add(more)
    made.build_index(parameters)
    count_ = lambda c: F.regexp_extract(c, r"with (\d+) rows", 1).cast("bigint")
    log = made.history().select(F.lit("log").alias("source"), count_("message").alias("rows"))
    return log.unionByName(made.latest_log(1).select(F.lit("newest").alias("source"), count_("line").alias("rows")))


def supplied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from Python, none, one and many, in a transient collection."""
    made = Database(spark, shared_path(spark, "database")).create({"type": "TRANSIENT", "name": "few"})
    made.add(suppliers.empty(spark))
    made.add(suppliers.single(spark, [1.0, 2.0], "one"))
    for part in suppliers.from_iterator(spark, (([float(i), 1.0], f"r{i}", None) for i in range(25)), 10):
        made.add(part)
    return made.rows().select("id", "rid")


def streamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a stream into a collection; the second finds only what is new."""
    base = shared_path(spark, "stream")
    made = Database(spark, f"{base}/db").create({"type": "FLAT", "name": "vectors"})
    rows = _vectors(spark, sf_dir).select("vector", F.col("id").cast("string").alias("rid"), F.lit(None).cast("string").alias("extra"), "label")
    for n in (0, 1):
        rows.where(F.col("label") % 2 == n).drop("label").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(suppliers.INPUT).parquet(f"{base}/in")
        ingest(stream, made, f"{base}/checkpoint", once=True).awaitTermination()
    return made.rows().select(F.col("rid").cast("bigint").alias("vec_id"))


def changed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra of label 1 updated, metadata of label 2 deleted, all compacted, and more rows appended."""
    made, more = _collection(spark, sf_dir, "FLAT")
    label = text.metadata_field(text.metadata_json("rid", "extra"), "$.extra.label").cast("int")
    made.update_metadata(made.rows().where(label == 1).select("id", "rid", F.lit('{"label":101}').alias("extra")))
    made.delete_metadata(made.rows().where(label == 2).select("id"))
    made.compact()
    made.add(more)
    return made.metadata().select(text.metadata_field("meta", "$.rid").cast("bigint").alias("vec_id"), text.metadata_field("meta", "$.extra.label").cast("int").alias("label"))


def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created, dropped and read again: names and the settings that were kept."""
    path = shared_path(spark, "database")
    db = Database(spark, path)
    db.create({"name": "a", "index-type": "no", "compression": "zstd", "similarity-alg": "dot"})
    db.create({"type": "ANN", "name": "b"})
    db.create({"type": "FLAT", "name": "c"})
    db.drop("c")
    again = Database(spark, path)
    kept = [(n, again.get(n).config.similarity.value, again.get(n).config.strategy.value) for n in again.list()]
    return spark.createDataFrame(kept, "name string, similarity string, strategy string")


def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("rest", 5, 0.1), ("grpc", 0, -1.0), ("grpc", 7, 0.5), ("library", None, None), ("library", 4, 0.3)]
    rows = [(n, s, *normalize_request(s, k, t)) for n, (s, k, t) in enumerate(asked)]
    return spark.createDataFrame(rows, "n int, surface string, k int, threshold double")


def sql_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_normalize of three times the vector, vec_fwht, and vec_lsh of one table of eight bits, in SQL."""
    register.register(spark, lsh.portable_planes(BITS, 1, DIM)[0])
    _vectors(spark, sf_dir).select("id", vector.doubles("vector").alias("vector")).createOrReplaceTempView("vectrail_vectors")
    made = "SELECT id, vec_lsh(vector)[0] AS code, vec_normalize(transform(vector, x -> 3 * x)) AS unit, vec_fwht(vector) AS fwht FROM vectrail_vectors"
    rows = spark.sql(made).select("id", "code", F.posexplode(F.arrays_zip("unit", "fwht")).alias("pos", "z"))
    return rows.select("id", "pos", F.round("z.unit", 6).alias("unit"), F.round("z.fwht", 6).alias("fwht"), "code")


def sql_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    _vectors(spark, sf_dir).createOrReplaceTempView("vectrail_vectors")
    pooled = spark.sql("SELECT label, vec_mean_pool(cast(vector AS array<double>)) AS v FROM vectrail_vectors GROUP BY label")
    return pooled.select("label", F.posexplode("v").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def sql_xxh64(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    return spark.sql("SELECT s, xxh64_seed0(s) AS hash FROM VALUES (''), ('a'), ('abc') t(s)")


def _recall(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether 0.9 of the exact neighbours at the queries' threshold are found, own rows left out."""
    exact = search.search_batch(rows, rows, DEFAULT_TOP_K, THRESHOLD, Similarity.COSINE, DIM).where("query_id <> id").select("query_id", "id")
    pairs = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return pairs.agg((F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)) >= 0.9).alias("enough"))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _recall(ann.AnnIndex.build(rows, DIM).search(rows, rows, DEFAULT_TOP_K, THRESHOLD), rows)


def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian planes, eight bits in 256 tables, saved and loaded, half of the rows appended."""
    rows, path = _vectors(spark, sf_dir), shared_path(spark, "lsh")
    end = _middle(rows)
    lsh.LshIndex.build(rows.where(F.col("id") <= end), BITS, 256, DIM).save(path)
    lsh.LshIndex.load(spark, path).append(path, rows.where(F.col("id") > end))
    return _recall(lsh.LshIndex.load(spark, path).search(rows, rows, DEFAULT_TOP_K, THRESHOLD), rows)


def reservoir_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of the table in two samples of one seed, and in both."""
    rows = _vectors(spark, sf_dir)
    a, b = cluster.reservoir(rows, 100, seed=7).select("id"), cluster.reservoir(rows.repartition(5), 100, seed=7).select("id")
    return a.join(b, "id").join(rows.select("id"), "id").agg(F.countDistinct("id").alias("n"))


QUERIES = {
    "segments_round_trip": _exported(False),
    "headered_round_trip": _exported(True),
    "cosine_topk": _single(Similarity.COSINE),
    "cosine_topk_default": _single(Similarity.COSINE, threshold=DEFAULT_THRESHOLD),
    "dot_topk": _single(Similarity.DOT_PRODUCT),
    "l2_topk": _single(Similarity.EUCLIDEAN, threshold=None),
    "label_filtered_topk": _single(Similarity.COSINE, threshold=0.0, label=3),
    "metadata_join": _metadata("left"),
    "metadata_join_inner": _metadata("inner"),
} | {
    f.__name__: f
    for f in (
        topk_ascending, threshold_range, batched_topk, batched_l2, topk_ids, merged_topk, count, last_id, scan_all, scan_keys, scan_after, point_lookup, reverse_lookup, normalize, sql_functions,
        lsh_signature, lsh_candidates, lsh_search, hamming, hybrid_union, delta_anti, metadata_json, vector_json, time_text, mean_pool_by_label, mean_pool_masked, fwht, random_projection,
        dup_vectors, validation, xxh64, reservoir_sample, kmeans_centroids, pq_codes, ivf_search, ivf_search_all_cells, random_vectors, euclidean_2d,
        collection_batch, collection_hybrid, collection_records, collection_ids, ordinals, float_bytes, hamming_words,
        quarantine, fvecs_round_trip, matrix_round_trip, index_lifecycle, build_history, supplied_rows, streamed_rows, changed_metadata, collection_names, request_defaults,
        sql_vectors, sql_mean_pool, sql_xxh64, ivf_recall, lsh_recall, reservoir_facts,
    )
}


# SQL. Lists of doubles; a score that is NaN is excluded by name, as DuckDB too holds NaN above every number.

_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
_Q = f"WITH {_V}, q AS (SELECT x AS qx FROM v WHERE id = 0)"
_COS = "list_dot_product(qx, x) / sqrt(list_dot_product(qx, qx) * list_dot_product(x, x))"
_PASS = "NOT isnan(score) AND score"


def _topk_sql(score: str, condition: str, extra: str = "", order: str = "DESC", columns: str = "label, ", k: int = DEFAULT_TOP_K) -> str:
    return f"{_Q}, s AS (SELECT id, label, {score} AS score FROM v, q {extra}) SELECT id, {columns}round(score, 6) AS score FROM s WHERE {condition} ORDER BY score {order}, id LIMIT {k}".replace(", round", ", round")


_ALL = f"WITH {_V}, s AS (SELECT a.id AS query_id, b.id AS id, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) AS score FROM v a, v b)"
_RANKED = f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s WHERE {_PASS} >= {THRESHOLD}) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= {DEFAULT_TOP_K}"
_COSINE_TOPK = _topk_sql(_COS, f"{_PASS} >= {THRESHOLD}")
_META_SQL = "json_object('rid', source, 'extra', json_object('chars', n_chars))"


def _planes_sql(bits: int, tables: int) -> str:
    """Planes as (t, p, d, w), from the same integers."""
    return (
        f"planes AS (SELECT t, p, d, sum((((t * {bits} + p) * 64 + d + 1 + j * 1000003) * 2654435761 % 4294967296) / 4294967296.0) - 6 AS w "
        f"FROM range({tables}) a(t), range({bits}) b(p), range({DIM}) c(d), range(12) e(j) GROUP BY t, p, d), "
        "plane AS (SELECT t, p, list(w ORDER BY d) AS w FROM planes GROUP BY t, p)"
    )


_SIGNS = f"{_planes_sql(BITS, TABLES)}, sig AS (SELECT id, t::INT AS t, sum(CASE WHEN list_dot_product(x, w) > 0 THEN 1 << p::INT ELSE 0 END)::BIGINT AS code FROM v, plane GROUP BY id, t)"

_SEGMENTS = f"WITH {_V}, e AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 128 AS segment, x FROM v), u AS (SELECT segment, id, unnest(range(len(x)))::INT AS pos, unnest(x) AS x FROM e) SELECT segment, id, pos, round(x, 6) AS x FROM u"

ORACLE = {
    "cosine_topk": _COSINE_TOPK,
    "cosine_topk_default": _topk_sql(_COS, f"{_PASS} >= {DEFAULT_THRESHOLD}"),
    "dot_topk": _topk_sql("list_dot_product(qx, x)", f"{_PASS} >= {THRESHOLD}"),
    "l2_topk": _topk_sql("list_distance(qx, x)", "NOT isnan(score)", order="ASC"),
    "label_filtered_topk": _topk_sql(_COS, f"{_PASS} >= 0", extra="WHERE label = 3"),
    "topk_ascending": f"{_Q} SELECT row_number() OVER (ORDER BY s, id DESC)::INT AS place, id, round(s, 6) AS score FROM (SELECT id, {_COS} AS s FROM v, q WHERE {_COS} >= {THRESHOLD} ORDER BY s DESC, id LIMIT {DEFAULT_TOP_K})",
    "topk_ids": f"SELECT id FROM ({_COSINE_TOPK})",
    "merged_topk": f"SELECT id, score FROM ({_COSINE_TOPK})",
    "hybrid_union": f"SELECT id, score FROM ({_COSINE_TOPK})",
    "threshold_range": f"{_Q} SELECT id, round(score, 6) AS score FROM (SELECT id, {_COS} AS score FROM v, q) WHERE {_PASS} >= {THRESHOLD}",
    "batched_topk": f"{_ALL}, {_RANKED}",
    "batched_l2": f"WITH {_V}, s AS (SELECT a.id AS query_id, b.id AS id, list_distance(a.x, b.x) AS score FROM v a, v b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s WHERE score <= 1.2) SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "ivf_search_all_cells": f"{_ALL}, {_RANKED}",
    "count": "SELECT count(*) AS n FROM embeddings",
    "last_id": "SELECT max(vec_id) AS last_id FROM embeddings",
    "scan_all": f"WITH {_V} SELECT id, len(x)::INT AS dim, round(sqrt(list_dot_product(x, x)), 6) AS norm FROM v",
    "scan_keys": "SELECT vec_id AS id FROM embeddings ORDER BY 1",
    "scan_after": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id > 99 ORDER BY 1",
    "point_lookup": "SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id = 42",
    "reverse_lookup": "SELECT max(vec_id) AS id FROM embeddings WHERE label = 3 HAVING count(*) > 0",
    "normalize": f"WITH {_V}, e AS (SELECT id, unnest(range(len(x)))::INT AS pos, unnest(x) AS x, sqrt(list_dot_product(x, x)) AS n FROM v) SELECT id, pos, round(x / n, 6) AS x FROM e",
    "sql_functions": f"{_Q} SELECT id, round(list_dot_product(qx, x), 6) AS dot, round({_COS}, 6) AS cosine, round(list_distance(qx, x), 6) AS l2, bit_count(xor(id, 5::BIGINT))::INT AS hamming FROM v, q",
    "lsh_signature": f"WITH {_V}, {_SIGNS} SELECT id, t, code FROM sig",
    "lsh_candidates": f"WITH {_V}, {_SIGNS} SELECT DISTINCT a.id AS query_id, b.id FROM sig a JOIN sig b USING (t, code)",
    "lsh_search": f"WITH {_V}, {_SIGNS}, c AS (SELECT DISTINCT a.id AS query_id, b.id FROM sig a JOIN sig b USING (t, code)), s AS (SELECT c.query_id, c.id, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) AS score FROM c JOIN v a ON a.id = c.query_id JOIN v b ON b.id = c.id), {_RANKED}",
    "hamming": f"WITH {_V}, {_SIGNS} SELECT a.id, a.t, bit_count(xor(a.code, b.code))::INT AS distance FROM sig a JOIN sig b ON a.t = b.t AND b.id = 0",
    "delta_anti": "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id <= (SELECT max(vec_id) // 2 FROM embeddings))",
    "metadata_join": f"SELECT c.id, c.score, CASE WHEN doc_id IS NULL THEN '{{}}' ELSE {_META_SQL}::VARCHAR END AS meta FROM ({_COSINE_TOPK}) c LEFT JOIN documents ON doc_id = c.id",
    "metadata_join_inner": f"SELECT c.id, c.score, {_META_SQL}::VARCHAR AS meta FROM ({_COSINE_TOPK}) c JOIN documents ON doc_id = c.id",
    "metadata_json": "SELECT event_id, event_type AS rid, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "vector_json": f"WITH {_V} SELECT id, round(sqrt(list_dot_product(x, x)), 5) AS norm FROM v",
    "time_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at, format('{}d {}H {}m {}s', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) AS lasting FROM (SELECT event_id, ts, event_id * 1234567 // 1000 AS s FROM events)",
    "mean_pool_by_label": f"WITH {_V}, e AS (SELECT label, unnest(range(len(x)))::INT AS pos, unnest(x) AS x FROM v) SELECT label, pos, round(avg(x), 6) AS x FROM e GROUP BY label, pos",
    "mean_pool_masked": f"WITH {_V}, e AS (SELECT id, label, unnest(range(len(x)))::INT AS pos, unnest(x) AS x, unnest(list_reverse(x)) AS y FROM v) SELECT id, pos, round(CASE label % 3 WHEN 0 THEN 0.0 WHEN 1 THEN x ELSE (x + y) / 2 END, 6) AS x FROM e",
    "fwht": f"WITH {_V}, e AS (SELECT id, unnest(range(len(x)))::BIGINT AS j, unnest(x) AS x FROM v) SELECT id, i::INT AS pos, round(sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN x ELSE -x END) / sqrt({DIM}), 6) AS x FROM e, range({DIM}) r(i) GROUP BY id, i",
    "random_projection": f"WITH {_V}, {_planes_sql(TO, 1)} SELECT id, p::INT AS pos, round(list_dot_product(x, w), 6) AS x FROM v, plane",
    "dup_vectors": "SELECT min(id) AS first_id, count(*) AS rows FROM (SELECT vec_id AS id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings WHERE label = 1) GROUP BY embedding HAVING count(*) > 1",
    "validation": "SELECT CASE label WHEN 1 THEN 'wrong length' WHEN 2 THEN 'no vector' WHEN 3 THEN 'no rid' ELSE 'stored' END AS outcome, count(*) AS n FROM embeddings GROUP BY 1",
    "collection_batch": f"SELECT query_id, id, score FROM ({_ALL}, {_RANKED})",
    "collection_hybrid": f"SELECT query_id, id, score FROM ({_ALL}, {_RANKED})",
    "collection_records": "SELECT vec_id, label FROM embeddings",
    "collection_ids": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings",
    "ordinals": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, vec_id AS id FROM embeddings WHERE label <> 1",
    "float_bytes": f"WITH {_V}, e AS (SELECT id, unnest(range(len(x)))::INT AS pos, unnest(x) AS x FROM v) SELECT id, pos, round(x, 6) AS x FROM e",
    "hamming_words": f"WITH {_V}, {_SIGNS} SELECT a.id, sum(bit_count(xor(a.code, b.code)))::INT AS distance FROM sig a JOIN sig b ON a.t = b.t AND b.id = 0 GROUP BY a.id",
    "quarantine": "SELECT CASE label WHEN 1 THEN 'wrong length' WHEN 2 THEN 'no vector' WHEN 3 THEN 'no rid' WHEN 4 THEN 'empty vector' ELSE 'stored' END AS outcome, count(*) AS n FROM embeddings GROUP BY 1",
    "segments_round_trip": _SEGMENTS,
    "headered_round_trip": _SEGMENTS,
    "fvecs_round_trip": f"WITH {_V}, e AS (SELECT id, unnest(range(len(x)))::INT AS pos, unnest(x) AS x FROM v WHERE id < 100) SELECT id, pos, round(x, 6) AS x FROM e",
    "matrix_round_trip": f"WITH {_planes_sql(TO, 1)} SELECT p, d, round(w, 6) AS w FROM planes",
    "index_lifecycle": "SELECT * FROM (VALUES (1, 'active'), (2, 'purged'), (3, 'kept')) t(build, state)",
    "build_history": "WITH n AS (SELECT count(*) FILTER (vec_id <= (SELECT max(vec_id) // 2 FROM embeddings)) AS half, count(*) AS every FROM embeddings) SELECT 'log' AS source, half AS rows FROM n UNION ALL SELECT 'log', every FROM n UNION ALL SELECT 'newest', every FROM n",
    "supplied_rows": "SELECT range::BIGINT AS id, CASE range WHEN 0 THEN 'one' ELSE 'r' || (range - 1) END AS rid FROM range(26)",
    "streamed_rows": "SELECT vec_id FROM embeddings",
    "changed_metadata": "SELECT vec_id, CASE WHEN label = 1 AND vec_id <= m THEN 101 ELSE label END AS label FROM embeddings, (SELECT max(vec_id) // 2 AS m FROM embeddings) WHERE NOT (label = 2 AND vec_id <= m)",
    "collection_names": "SELECT * FROM (VALUES ('a', 'dot', 'no_index'), ('b', 'cosine', 'ann')) t(name, similarity, strategy)",
    "request_defaults": "SELECT * FROM (VALUES (0, 'rest', 11, 0.8::DOUBLE), (1, 'grpc', 3, 0.8), (2, 'grpc', 7, 0.5), (3, 'library', 11, 0.8), (4, 'library', 4, 0.3)) t(n, surface, k, threshold)",
    "sql_vectors": f"WITH {_V}, {_planes_sql(BITS, 1)}, g AS (SELECT id, sum(CASE WHEN list_dot_product(x, w) > 0 THEN 1 << p::INT ELSE 0 END)::BIGINT AS code FROM v, plane GROUP BY id), e AS (SELECT id, unnest(range(len(x)))::BIGINT AS j, unnest(x) AS x, sqrt(list_dot_product(x, x)) AS n FROM v), f AS (SELECT id, i, sum(CASE WHEN bit_count(i & j) % 2 = 0 THEN x ELSE -x END) AS f FROM e, range({DIM}) r(i) GROUP BY id, i) SELECT e.id, j::INT AS pos, round(x / n, 6) AS unit, round(f, 6) AS fwht, code FROM e JOIN f ON e.id = f.id AND i = j JOIN g ON g.id = e.id",
    "sql_mean_pool": f"WITH {_V}, e AS (SELECT label, unnest(range(len(x)))::INT AS pos, unnest(x) AS x FROM v) SELECT label, pos, round(avg(x), 6) AS x FROM e GROUP BY label, pos",
    "sql_xxh64": "SELECT * FROM (VALUES ('', -1205034819632174695), ('a', -3292477735350538661), ('abc', 4952883123889572249)) t(s, hash)",
    "ivf_recall": "SELECT TRUE AS enough",
    "lsh_recall": "SELECT TRUE AS enough",
    "reservoir_facts": "SELECT 100::BIGINT AS n",
    "random_vectors": "SELECT range::BIGINT AS id, 1.0::DOUBLE AS norm FROM range(200)",
    "euclidean_2d": "SELECT p_partkey, round(sqrt((p_size - 10.0) ** 2 + (p_retailprice - 1000.0) ** 2), 4) AS distance FROM part",
}
