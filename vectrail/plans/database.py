"""A database: a folder of collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..model import CollectionConfig
from ..sources.files import Files
from ..sources.store import Collection

#: Makes a collection from a database and a request; register one under a type name to extend the database.
Creator = Callable[["Database", dict], Collection]


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.creators: dict[str, Creator] = {}
        self.collections: dict[str, Collection] = {}
        self.files.make(self.path)
        for name in self.files.names(self.path):
            settings = f"{self.path}/{name}/_collection.json"
            if self.files.exists(settings):
                config = CollectionConfig.from_json(self.files.read(settings))
                self.collections[config.name] = Collection(spark, f"{self.path}/{name}", config)

    def __contains__(self, name: str) -> bool:
        return name in self.collections

    def list(self) -> list[str]:
        return sorted(self.collections)

    def get(self, name: str) -> Collection | None:
        return self.collections.get(name)

    def register(self, kind: str, creator: Creator) -> None:
        self.creators[kind.upper()] = creator

    def create(self, request: dict | CollectionConfig) -> Collection:
        """From settings or from either request form; a name that exists is refused."""
        if isinstance(request, dict) and str(request.get("type", "")).upper() in self.creators:
            made = self.creators[str(request["type"]).upper()](self, request)
            self.collections[made.config.name] = made
            return made
        config = request if isinstance(request, CollectionConfig) else CollectionConfig.from_request(request)
        if not config.name or "/" in config.name or config.name.startswith((".", "_")):
            raise ValueError(f"not a collection name: {config.name!r}")
        if config.name in self:
            raise ValueError(f"collection {config.name!r} exists")
        made = Collection(self.spark, f"{self.path}/{config.name}", config)
        made.save_config()
        self.collections[config.name] = made
        return made

    def drop(self, name: str) -> None:
        gone = self.collections.pop(name, None)
        if gone is None:
            raise ValueError(f"no collection {name!r}")
        gone.close()
        self.files.delete(gone.path)

    def close(self) -> None:
        for c in self.collections.values():
            c.close()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()
