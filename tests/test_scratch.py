"""Scratch tables: where they lie, and that they go."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark import scratch


class Session:
    """A session's settings alone."""

    def __init__(self, master, folder=None):
        self.sparkContext = self.conf = self
        self.master, self.folder, self.made = master, folder, None

    def get(self, name, default):
        return self.folder or default

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, folder):
        self.made = folder


def test_root():
    assert scratch.root(Session("spark://host:7077", "s3a://bucket/shared")) == "s3a://bucket/shared"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            scratch.root(Session(master))
    session = Session("local[4]")
    assert scratch.root(session) == scratch.root(session) == session.made


def test_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda _: str(tmp_path))
    with scratch.Scratch(spark, "run") as tmp:
        kept = tmp.written(spark.range(3), "kept", keep=True)
        tmp.written(spark.range(4), "first")
        tmp.drop("first", "unknown")
        assert tmp.written(spark.range(5), "second").count() == 5
    assert [p.name for p in tmp_path.glob("run-*/*")] == ["1-kept"] and kept.count() == 3


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_go_with_their_write(spark, tmp_path, monkeypatch):
    """Shuffle files of a table's query go once it is written, also where several threads write, and the session keeps its setting."""
    monkeypatch.setattr(scratch, "root", lambda _: str(tmp_path))
    setting, before = spark.conf.get(scratch.CLEANUP, "false"), shuffle_files(spark)
    with scratch.Scratch(spark, "run") as tmp, ThreadPoolExecutor(3) as threads:
        rows = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n"))
        tables = list(threads.map(lambda i: tmp.written(rows.where(F.col("k") % 3 == i).orderBy("n"), f"table {i}"), range(3)))
        until = time.time() + 20  # executors are told, not waited for
        while (left := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left
        assert sum(t.count() for t in tables) == 997
    assert spark.conf.get(scratch.CLEANUP, "false") == setting
