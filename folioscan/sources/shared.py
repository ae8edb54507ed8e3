"""Folders that every machine of a cluster sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dirs: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Where neither is set a local session gets a folder of its own; a cluster is refused,
    as its machines would not see one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (held := context._jsc.sc().getCheckpointDir()).isDefined():
        named = held.get().rsplit("/", 1)[0]  # the context adds a folder of its own
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_dirs.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="folioscan-"))
    return named.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/folioscan/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
