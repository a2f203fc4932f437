"""Schemas, enumerations and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import types as T

#: One row of a collection. ``extra`` is JSON or null; ids are unique, rids need not be.
ROW = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), True), True),
    T.StructField("rid", T.StringType(), True),
    T.StructField("extra", T.StringType(), True),
])

DEFAULT_TOP_K, DEFAULT_THRESHOLD = 11, 0.8
#: Defaults differ by surface: (k, threshold) for missing or non-positive values; None: what the caller gives.
SURFACES = {"library": (11, 0.8), "rest": (11, 0.8), "grpc": (3, 0.8), "admin": (None, None)}


class Similarity(Enum):
    """EUCLIDEAN is a distance: nearest first, and a threshold is an upper bound."""

    DOT_PRODUCT = "dot"
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"

    @classmethod
    def parse(cls, name: str | Similarity) -> Similarity:
        if isinstance(name, cls):
            return name
        for s in cls:
            if name.strip().lower().replace("-", "_") in (s.value, s.name.lower()):
                return s
        raise ValueError(f"unknown similarity {name!r}")


class IndexStrategy(Enum):
    NO_INDEX = "no_index"
    ANN = "ann"
    LSH = "lsh"

    @classmethod
    def parse(cls, name: str | IndexStrategy) -> IndexStrategy:
        if isinstance(name, cls):
            return name
        plain = name.strip().lower().replace("-", "_")
        if plain in ("no", "no_index"):
            return cls.NO_INDEX
        if plain in ("ann", "lsh"):
            return cls(plain)
        raise ValueError(f"unknown index strategy {name!r}")


class Compression(Enum):
    """What the Parquet files of a collection are compressed with."""

    NO = "none"
    ZSTD = "zstd"
    LZ4 = "lz4_raw"

    @classmethod
    def parse(cls, name: str | Compression) -> Compression:
        return name if isinstance(name, cls) else cls[name.strip().upper()]


@dataclass
class CollectionConfig:
    """All settings of a collection; they are saved whole and read back whole."""

    name: str
    strategy: IndexStrategy = IndexStrategy.NO_INDEX
    similarity: Similarity = Similarity.COSINE
    compression: Compression = Compression.NO
    transient: bool = False
    in_memory: bool = False
    dim: int | None = None
    rows_per_file: int = 250_000
    lsh: dict = field(default_factory=lambda: {"bits": 16, "tables": 8, "seed": 1})
    ann: dict = field(default_factory=dict)

    def to_json(self) -> str:
        values = asdict(self) | {"strategy": self.strategy.value, "similarity": self.similarity.value, "compression": self.compression.name}
        return json.dumps(values, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CollectionConfig:
        v = json.loads(text)
        return cls(**v | {"strategy": IndexStrategy.parse(v["strategy"]), "similarity": Similarity.parse(v["similarity"]), "compression": Compression.parse(v["compression"])})

    @classmethod
    def from_request(cls, request: dict) -> CollectionConfig:
        """From either request form: strategy names, or a type TRANSIENT, FLAT, ANN or LSH."""
        if "type" in request:
            kind = str(request["type"]).strip().upper()
            if kind not in ("TRANSIENT", "FLAT", "ANN", "LSH"):
                raise ValueError(f"unknown collection type {request['type']!r}")
            strategy = IndexStrategy[kind] if kind in ("ANN", "LSH") else IndexStrategy.NO_INDEX
            made = cls(request["name"], strategy, transient=kind == "TRANSIENT", in_memory=bool(request.get("allInMemory", False)))
            args = request.get("args", {})
            if kind == "LSH" and args:
                made.lsh |= {"bits": args.get("k", made.lsh["bits"]), "tables": args.get("L", made.lsh["tables"])}
                made.dim, made.in_memory = args.get("dim"), bool(args.get("loadAllVectorsIntoMemory", False))
            return made
        return cls(
            request["name"],
            IndexStrategy.parse(request.get("index-type", "no_index")),
            Similarity.parse(request.get("similarity-alg", "cosine")),
            Compression.parse(request.get("compression", "NO")),
            transient=bool(request.get("transient", False)),
        )


def normalize_request(surface: str, k: int | None = None, threshold: float | None = None) -> tuple[int, float]:
    """The k and threshold that a query from ``surface`` runs with; the REST surface always uses its own."""
    own_k, own_t = SURFACES[surface]
    if surface == "rest":
        return own_k, own_t
    if own_k is None:
        if k is None or threshold is None:
            raise ValueError(f"{surface} queries give k and threshold")
        return k, threshold
    if surface == "grpc":
        return (k if k and k > 0 else own_k), (threshold if threshold and threshold > 0 else own_t)
    return (own_k if k is None else k), (own_t if threshold is None else threshold)
