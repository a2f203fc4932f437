"""Collections on disk.

A collection is a folder::

    _collection.json      all settings
    _ids.json             the next id, and where the last append began
    _data                 names the folder of rows in use: data, or data-<n> after a compaction
    data/part=<tag>/      appended rows: id, vector, rid, extra
    changes/part=<n>/     updated and deleted metadata, by id
    quarantine/part=<tag>/  rows that were refused, with the reason
    log/                  ts, message
    index/v<millis>/      built indexes; index/_active names the one in use

Appends are immutable parts under a tag, so that a batch that is written again
(a stream that restarts) replaces itself.  Ids are contiguous: rows are staged
with their place in their partition, and partitions get the ranges that follow the
collection's last id, which a small file keeps, so that an append reads no other part.
That file is replaced before the rows are written: an append that fails and is not
repeated under its tag leaves a gap.  One writer appends at a time, any number read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from ..model import DEFAULT_THRESHOLD, DEFAULT_TOP_K, ROW, CollectionConfig, IndexStrategy
from ..operators import ann, lsh, search
from .files import Files

KEEP = 11
REFUSED = "vector array<float>, rid string, extra string, reason string"
CHANGES = "id bigint, rid string, extra string, gone boolean, seq bigint"


def refused(dim: int | None) -> Column:
    """Why a row cannot be stored, or null."""
    v = F.col("vector")
    wrong = F.lit(False) if dim is None else F.size(v) != dim
    return (
        F.when(v.isNull(), "no vector").when(F.size(v) == 0, "empty vector").when(F.exists(v, lambda x: x.isNull()), "null element").when(wrong, "wrong length").when(F.col("rid").isNull(), "no rid")
    )


class Collection:
    def __init__(self, spark: SparkSession, path: str, config: CollectionConfig):
        self.spark, self.path, self.config, self.files = spark, path, config, Files(spark)
        self._memory: DataFrame | None = None
        self._rows: DataFrame | None = None
        self.closed = False

    # Reading

    def rows(self) -> DataFrame:
        """id, vector, rid, extra of every row."""
        self._open()
        if self.config.transient:
            return self._rows if self._rows is not None else self.spark.createDataFrame([], ROW)
        if not self.files.exists(self._data()):
            return self.spark.createDataFrame([], ROW)
        if self._memory is not None:
            return self._memory
        rows = self.spark.read.schema(ROW).option("recursiveFileLookup", True).parquet(self._data())
        if self.files.exists(f"{self.path}/changes"):
            rows = self._changed(rows)
        if self.config.in_memory:
            self._memory = rows.persist()
            return self._memory
        return rows

    def _data(self) -> str:
        pointer = f"{self.path}/_data"
        return f"{self.path}/{self.files.read(pointer).strip() if self.files.exists(pointer) else 'data'}"

    def _changed(self, rows: DataFrame) -> DataFrame:
        """Rows with the newest change of each id; deleted metadata leaves a vector without rid and extra."""
        changes = self.spark.read.schema(CHANGES).option("recursiveFileLookup", True).parquet(f"{self.path}/changes")
        newest = changes.groupBy("id").agg(F.max_by(F.struct("rid", "extra", "gone"), "seq").alias("_c"))
        of = lambda name: F.when(F.col("_c").isNull(), F.col(name)).when(~F.col("_c.gone"), F.col(f"_c.{name}")).alias(name)
        return rows.join(newest, "id", "left").select("id", "vector", of("rid"), of("extra"))

    def records(self) -> DataFrame:
        """id, vector, rid, meta; meta is one JSON shape for every kind of collection."""
        return self.rows().select("id", "vector", "rid", text.metadata_json("rid", "extra").alias("meta"))

    def metadata(self) -> DataFrame:
        """id, meta of the rows that have metadata."""
        return self.rows().where(F.col("rid").isNotNull()).select("id", text.metadata_json("rid", "extra").alias("meta"))

    def update_metadata(self, changes: DataFrame) -> int:
        """New extra for (id, rid, extra) rows; a rid that is not the newest of its id is refused, and then nothing changes."""
        self._stored()
        asked = changes.select(F.col("id").cast("bigint").alias("id"), "rid", "extra")
        known = self.rows().where(F.col("rid").isNotNull()).groupBy("rid").agg(F.max("id").alias("_id"))
        wrong = asked.join(known, "rid", "left").where(~F.col("_id").eqNullSafe(F.col("id")))
        if not wrong.isEmpty():
            raise ValueError("rid and id do not match")
        return self._write_changes(asked.withColumn("gone", F.lit(False)))

    def delete_metadata(self, ids: DataFrame) -> int:
        """Drop rid and extra of the ids; one that is unknown is no error. Vectors stay and are found without metadata."""
        self._stored()
        nothing = F.lit(None).cast("string")
        return self._write_changes(ids.select(F.col("id").cast("bigint").alias("id"), nothing.alias("rid"), nothing.alias("extra"), F.lit(True).alias("gone")))

    def _stored(self) -> None:
        self._open()
        if self.config.transient:
            raise ValueError("a transient collection keeps no changes")

    def _write_changes(self, rows: DataFrame) -> int:
        parts = [int(x.removeprefix("part=")) for x in self.files.names(f"{self.path}/changes")]
        seq = max(parts, default=0) + 1
        path = f"{self.path}/changes/part={seq}"
        rows.withColumn("seq", F.lit(seq).cast("bigint")).dropDuplicates(["id"]).write.mode("overwrite").parquet(path)
        self.reload()
        return self.spark.read.schema(CHANGES).parquet(path).count()

    def compact(self) -> str:
        """All parts and changes as one folder of large files in order of id, put in use by a pointer file; the old one goes.

        The last append keeps a part under its tag, so that a stream may still repeat that batch.
        """
        self._stored()
        old, state = self._data(), self._next()
        n = 1 + max([int(x.removeprefix("data-")) for x in self.files.names(self.path) if x.startswith("data-")], default=0)
        fresh = f"{self.path}/data-{n}"
        last = F.col("id") >= (state["start"] if state["tag"] else state["next"])
        for name, rows in (("compact", self.rows().where(~last)), (state["tag"], self.rows().where(last))):
            if name:
                files = max(1, -(-rows.count() // self.config.rows_per_file))
                dealt = rows.repartitionByRange(files, "id").sortWithinPartitions("id")
                dealt.write.mode("overwrite").option("compression", self.config.compression.value).parquet(f"{fresh}/part={name}")
        self.files.write(f"{self.path}/_data", f"data-{n}")
        self.files.delete(old)
        self.files.delete(f"{self.path}/changes")
        self.reload()
        return fresh

    def count(self) -> int:
        return self.rows().count()

    def last_id(self) -> int | None:
        return search.last_id(self.rows()).first()[0]

    def reload(self) -> None:
        if self._memory is not None:
            self._memory.unpersist()
            self._memory = None

    def close(self) -> None:
        self.reload()
        self.closed = True

    def __enter__(self) -> Collection:
        self._open()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError(f"collection {self.config.name!r} is closed")

    # Writing

    def add(self, batch: DataFrame, tag: str | None = None) -> tuple[int, int]:
        """Append (vector, rid, extra) rows; how many were stored and refused. Equal tags replace each other."""
        self._open()
        tag = tag or uuid.uuid4().hex
        batch = batch.select(vector.floats("vector").alias("vector"), F.col("rid").cast("string").alias("rid"), F.col("extra").cast("string").alias("extra") if "extra" in batch.columns else F.lit(None).cast("string").alias("extra"))
        if self.config.dim is None and self.config.strategy is not IndexStrategy.NO_INDEX:
            first = batch.where(refused(None).isNull()).select(F.size("vector")).first()
            if first:
                self.config.dim = first[0]
                self.save_config()
        judged = batch.withColumn("reason", refused(self.config.dim))
        if self.config.transient:
            return self._add_transient(judged)
        stage = f"{self.path}/staging/{tag}"
        judged.withColumn("_m", F.when(F.col("reason").isNull(), 0).otherwise(1)).write.mode("overwrite").partitionBy("_m").parquet(stage)
        staged = self.spark.read.schema(f"{REFUSED}, _m int").parquet(stage)
        good = staged.where("_m = 0").select("vector", "rid", "extra", F.monotonically_increasing_id().alias("_at"))
        placed = f"{stage}-placed"
        good.write.mode("overwrite").parquet(placed)
        good = self.spark.read.parquet(placed).withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND((1 << 33) - 1))
        state = self._next()
        next_id = state["start"] if state["tag"] == tag else state["next"]
        starts, n = [], 0
        for r in good.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row for each task that wrote
            starts.append((r._part, next_id + n))
            n += r.n
        self._save_next({"next": max(state["next"], next_id + n), "tag": tag, "start": next_id})
        target = f"{self._data()}/part={tag}"
        self.files.delete(target)
        if n:
            start = F.broadcast(self.spark.createDataFrame(starts, "_part bigint, _start bigint"))
            out = good.join(start, "_part").select((F.col("_start") + F.col("_pos")).alias("id"), "vector", "rid", "extra")
            compression = self.config.compression.value
            out.sortWithinPartitions("id").write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", self.config.rows_per_file).parquet(target)
        bad = staged.where("_m = 1").drop("_m")
        refused_rows = bad.count()
        if refused_rows:
            bad.write.mode("overwrite").parquet(f"{self.path}/quarantine/part={tag}")
        if n and self.config.strategy is IndexStrategy.LSH:
            self._sign(tag)
        self.files.delete(stage)
        self.files.delete(placed)
        self.reload()
        return n, refused_rows

    def _next(self) -> dict:
        """The next id, and the tag and first id of the last append; read from the rows if the file is not there."""
        path = f"{self.path}/_ids.json"
        if self.files.exists(path):
            return json.loads(self.files.read(path))
        last = self.last_id()
        n = 0 if last is None else last + 1
        return {"next": n, "tag": None, "start": n}

    def _save_next(self, state: dict) -> None:
        self.files.write(f"{self.path}/_ids.json", json.dumps(state))

    def _add_transient(self, judged: DataFrame) -> tuple[int, int]:
        next_id = 0 if self._rows is None else self._rows.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        # Transient collections live in this session's memory, and there partitions keep their rows.
        judged = judged.withColumn("_at", F.monotonically_increasing_id()).persist()
        good = judged.where("reason is null").withColumn("_part", F.shiftright("_at", 33))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
        starts, n = [], 0
        for r in good.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row for each partition
            starts.append((r._part, next_id + n))
            n += r.n
        start = F.broadcast(self.spark.createDataFrame(starts, "_part bigint, _start bigint"))
        rows = good.withColumn("_pos", place).join(start, "_part").select((F.col("_start") + F.col("_pos")).alias("id"), "vector", "rid", "extra").persist()
        rows.count()
        total = judged.count()
        judged.unpersist()
        self._rows = rows if self._rows is None else self._rows.unionByName(rows)
        return n, total - n

    def quarantine(self) -> DataFrame:
        path = f"{self.path}/quarantine"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], REFUSED)
        return self.spark.read.schema(REFUSED).option("recursiveFileLookup", True).parquet(path)

    def save_config(self) -> None:
        if not self.config.transient:
            self.files.write(f"{self.path}/_collection.json", self.config.to_json())

    # Searching

    def search(
        self, query, k: int = DEFAULT_TOP_K, threshold: float | None = DEFAULT_THRESHOLD, where: Column | None = None, order: str = "desc", timeout_millis: float | None = None
    ) -> DataFrame:
        """id, score, meta of the rows nearest to one vector; with a timeout the search runs now, or raises a TimeoutError."""
        self._open()
        if timeout_millis is not None:
            found = self.search(query, k, threshold, where, order)
            return search.arranged(search.within(found, timeout_millis), self.config.similarity, order)
        s = self.config.similarity
        if where is None and self.config.strategy is not IndexStrategy.NO_INDEX:
            one = self.spark.createDataFrame([(0, [float(x) for x in query])], "id bigint, vector array<float>")
            best = self.search_batch(one, k, threshold).select("id", "score")
        else:
            best = search.search(self.rows(), query, k, threshold, s, where, columns=())
        return search.arranged(search.with_metadata(best, self.metadata()), s, order)

    def search_batch(self, queries: DataFrame, k: int = DEFAULT_TOP_K, threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
        """query_id, id, score, rank by the collection's strategy; an index and the rows newer than it answer together."""
        self._open()
        rows, s = self.rows(), self.config.similarity
        if self.config.strategy is IndexStrategy.LSH and self.files.exists(f"{self.path}/lsh/planes"):
            return lsh.LshIndex.load(self.spark, f"{self.path}/lsh").search(rows, queries, k, threshold, s)
        active = self.active_index() if self.config.strategy is IndexStrategy.ANN else None
        if active is None:
            return search.search_batch(rows, queries, k, threshold, s)
        index = ann.AnnIndex.load(self.spark, f"{self.path}/index/{active}")
        held = index.search(rows.where(F.col("id") <= index.last_id), queries, k, threshold)
        fresh = search.search_batch(search.not_indexed(rows, index.last_id), queries, k, threshold, s)
        both = held.unionByName(fresh).drop("rank").dropDuplicates(["query_id", "id"])
        return search.top_k(both, k, s, by=("query_id",))

    # Indexes

    def _sign(self, tag: str) -> None:
        path, settings = f"{self.path}/lsh", self.config.lsh
        fresh = self.spark.read.schema(ROW).parquet(f"{self._data()}/part={tag}")
        if self.files.exists(f"{path}/planes"):
            lsh.LshIndex.load(self.spark, path).append(path, fresh)
        else:
            lsh.LshIndex.build(fresh, settings["bits"], settings["tables"], self.config.dim, settings["seed"]).save(path)

    def snapshot(self) -> dict:
        """The parts and the last id that an index build reads."""
        return {"segments": self.files.names(self._data()), "last_vector_id": self.last_id()}

    def build_index(self, parameters: ann.AnnParameters | None = None, hook=None, keep: int = KEEP) -> str:
        """Build, log, call ``hook`` with a summary, make active, purge; returns the version's name."""
        began = time.time()
        parameters = parameters or ann.AnnParameters(**self.config.ann)
        taken = self.snapshot()
        last = taken["last_vector_id"]
        if last is None:
            raise ValueError("an index needs rows")
        version = max([int(began * 1000), *(int(x[1:]) + 1 for x in self.versions())])
        frozen = self.rows().where(F.col("id") <= last)
        dim = self.config.dim or frozen.select(F.size("vector")).first()[0]
        built = ann.AnnIndex.build(frozen, dim, parameters, self.config.similarity, version)
        name = f"v{version}"
        built.save(f"{self.path}/index/{name}")
        self.files.write(f"{self.path}/index/{name}/snapshot.json", json.dumps(taken))
        self.log(f"built {name} with {last + 1} rows in {time.time() - began:.1f} s")
        if hook:
            hook({"total": last + 1, "duration_ms": int(1000 * (time.time() - began)), "message": f"index {name} built"})
        self.enable(name)
        self.purge(keep)
        return name

    def versions(self) -> list[str]:
        """Index names, oldest first, by number."""
        return sorted((x for x in self.files.names(f"{self.path}/index") if x.startswith("v") and x[1:].isdigit()), key=lambda x: int(x[1:]))

    def list_indexes(self) -> DataFrame:
        rows = [(x, int(x[1:]), x == self.active_index()) for x in self.versions()]
        return self.spark.createDataFrame(rows, "name string, millis bigint, active boolean").select("name", text.millis_text("millis").alias("built"), "active").orderBy("name")

    def active_index(self) -> str | None:
        path = f"{self.path}/index/_active"
        return self.files.read(path).strip() if self.files.exists(path) else None

    def enable(self, name: str | None = None) -> str:
        """Make a version active, the newest if none is named, by replacing the pointer file."""
        known = self.versions()
        name = name or (known[-1] if known else None)
        if name not in known:
            raise ValueError(f"no index {name!r}")
        self.files.write(f"{self.path}/index/_active", name)
        return name

    def purge(self, keep: int = KEEP) -> list[str]:
        """Delete all but the newest ``keep`` versions, and never the active one."""
        old = [x for x in self.versions()[: -keep or None] if x != self.active_index()]
        for x in old:
            self.files.delete(f"{self.path}/index/{x}")
        return old

    # Build log

    def log(self, message: str, ts: int | None = None) -> None:
        ts = int(time.time() * 1000) if ts is None else ts
        self.spark.createDataFrame([(ts, message)], "ts bigint, message string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def history(self) -> DataFrame:
        """Oldest first."""
        path = f"{self.path}/log"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], "ts bigint, message string")
        return self.spark.read.parquet(path).orderBy("ts", "message")

    def latest_log(self, n: int = 20) -> DataFrame:
        """"time, message" lines, newest first."""
        rows = self.history().orderBy(F.desc("ts"), F.desc("message")).limit(n)
        return rows.select(F.concat_ws(", ", text.millis_text("ts"), "message").alias("line"))
