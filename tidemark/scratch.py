"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs one table at most.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends (Spark 4.1; an earlier Spark has no such setting and takes no notice).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _freeing = threading.Lock(), {}


@contextmanager
def freeing(spark: SparkSession):
    """Shuffle files of what is written inside go when each write ends. Else they stay until the driver happens to collect
    its garbage: the more memory it has, the more of them lie on the executors' disks. The session's setting
    comes back with the last of the threads that write."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _freeing.get(session) or (0, spark.conf.get(CLEANUP, "false"))
        _freeing[session] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _freeing.pop(session)
            if n > 1:
                _freeing[session] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else the context's checkpoint folder. Where neither is set,
    a temporary one is, on a local master only: on a cluster, other machines would not see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidemark-"))
        folder = context.getCheckpointDir()
    return folder


class Scratch:
    """The tables of one run, by label. ``close`` deletes those that were not written with ``keep``.

    A table may be dropped once nothing that is still to run reads it; those that a lazy result reads are kept until the
    application ends, when the file system deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, list[str]] = {}
        self._count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def written(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        self._count += 1
        path = f"{self.folder}/{self._count}-{label}"
        with freeing(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        if keep:
            at, files = self._at(path)
            files.deleteOnExit(at)
        else:
            self._paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *labels: str) -> None:
        """Delete every table written under these labels so far."""
        for label in labels:
            for path in self._paths.pop(label, []):
                at, files = self._at(path)
                files.delete(at, True)

    def close(self) -> None:
        """Delete the tables, and their folder where nothing was kept in it."""
        self.drop(*list(self._paths))
        at, files = self._at(self.folder)
        if files.exists(at) and not len(files.listStatus(at)):
            files.delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """One table that stays, for results that are read lazily."""
    return Scratch(df.sparkSession, "tidemark").written(df, label, keep=True)
