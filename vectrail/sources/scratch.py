"""A folder that the driver and all executors share, for tables of one application."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_swept: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset, in a local one for a local master, else an error.

    Paths lie under the application's id. That folder is deleted when the driver's
    Python ends; after a crash a cluster can sweep it by its name.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = os.path.join(tempfile.gettempdir(), "vectrail-scratch")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{folder}/{spark.sparkContext.applicationId}"
    if own not in _swept:
        _swept.add(own)
        atexit.register(remover(spark), own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def remover(spark: SparkSession) -> Callable[[str], None]:
    """Deletes a folder, now or when the session has ended; one that is gone is no error."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete(path: str) -> None:
        with contextlib.suppress(Exception):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    return delete
