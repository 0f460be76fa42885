"""Tables in parts, with one commit marker over all of them.

Rows that are added lie in ``table/commit=N/*.parquet``; parts that a commit writes anew, a bucket of a keyed table
or an older commit's rows, in ``table/commit=N-parts/part=NAME``. All of it becomes visible with ``_commits/N.json``,
written last and by a rename that fails where the marker exists; readers fold the markers once and read the parts
they name, so they see all tables at one point. There is one writer at a time; a second one fails. Paths go
through Spark's Hadoop file system, which must rename atomically (HDFS does, most object stores do not).
"""

from __future__ import annotations

import json
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.schema import COUNTED, KEYED, TABLES, evolved, struct
from tidemark.scratch import Scratch, freeing

#: Commits between two summaries of the markers, buckets of keyed tables in a new store, and tables written side by side.
FULL, BUCKETS, WRITERS = 50, 16, 4
#: Hashes in hexadecimal, of which there are many, take half the room.
CODEC = "zstd"


def bucket(key: str | Column, buckets: int) -> Column:
    """The name of a key's part."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


class Store:
    """``version`` pins a reader; a writer moves on with its own commits. ``buckets`` counts in a new store alone."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs_path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._fs_path(self.path)).toUri(), conf)
        self._known: dict[int, dict] = {}
        numbers, full = self._markers()
        self.version = max(numbers, default=0) if version is None else version
        at = max((n for n in full if n <= self.version), default=None)
        self._state = json.loads(self._text(f"_full.{at}")) if at is not None else {"commit": 0, "live": {}, "last": {}, "done": {}, "schema": 0, "buckets": buckets}
        for marker in self._read([n for n in numbers if self._state["commit"] < n <= self.version]):
            self._fold(marker)

    # Markers.

    def _names(self, folder: str) -> list[str]:
        at = self._fs_path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _markers(self) -> tuple[list[int], list[int]]:
        """Numbers of all markers, and of the summaries."""
        names = self._names("_commits")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), [int(n[6:]) for n in names if n.startswith("_full.")]

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._fs_path(f"{self.path}/_commits/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, content: dict) -> None:
        ready, at = self._fs_path(f"{self.path}/_commits/.{name}.tmp"), self._fs_path(f"{self.path}/_commits/{name}")
        out = self._fs.create(ready, True)
        out.write(json.dumps(content).encode())
        out.close()
        self._files.rename(ready, at, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))  # fails if it exists

    def _read(self, numbers: list[int]) -> list[dict]:
        """The markers of these numbers; they never change, so each is read once."""
        for n in numbers:
            if n not in self._known:
                self._known[n] = json.loads(self._text(f"{n}.json"))
        return [self._known[n] for n in numbers]

    def _fold(self, m: dict) -> None:
        live, n = self._state["live"], m["commit"]
        for table in m["tables"]:
            if table in m.get("rewrites", []):
                live[table] = {}
            live.setdefault(table, {})[f"c{n}"] = f"commit={n}"
        for table, change in m.get("parts", {}).items():
            own = live.setdefault(table, {})
            for name in change["gone"]:
                own.pop(name, None)
            own |= {name: f"commit={n}-parts/part={name}" for name in change["made"]}
        for table, columns in m.get("last", {}).items():
            own = self._state["last"].setdefault(table, {})
            own |= {c: max(x, own.get(c, 0)) for c, x in columns.items()}
        if m.get("batch") is not None:
            stream = m.get("stream") or ""
            self._state["done"][stream] = max(m["batch"], self._state["done"].get(stream, m["batch"]))
        self._state["schema"] = max(self._state["schema"], m.get("schema") or 0)
        self._state["buckets"] = m.get("buckets", self._state["buckets"])
        self._state["commit"] = n

    def commits(self) -> list[dict]:
        """Every marker up to this version."""
        return self._read([n for n in self._markers()[0] if n <= self.version])

    # Reading.

    @property
    def buckets(self) -> int:
        return self._state["buckets"]

    @property
    def schema_version(self) -> int:
        return self._state["schema"]

    def is_done(self, batch: int | None, stream: str = "") -> bool:
        """Whether a batch of a stream is committed already; a stream's batches come in order."""
        return batch is not None and batch <= self._state["done"].get(stream, batch - 1)

    def parts(self, table: str) -> dict[str, str]:
        """Name and folder of each of a table's parts."""
        return dict(self._state["live"].get(table, {}))

    def read(self, table: str, parts: Collection[str] | None = None, named: bool = False) -> DataFrame:
        """The committed rows of a table, or of some of its ``parts`` alone; empty with its schema if there are none. With
        ``named``, the column ``part`` says where a row lies."""
        schema, live = struct((TABLES | KEYED)[table]), self.parts(table)
        folders = {name: f"{self.path}/{table}/{live[name]}" for name in (live if parts is None else parts) if name in live}
        rows = self.spark.read.schema(schema).parquet(*folders.values()) if folders else self.spark.createDataFrame([], schema)
        if not named:
            return rows
        made = F.regexp_extract(F.col("_metadata.file_path"), r"/part=([^/]+)/[^/]*$", 1) if folders else F.lit("")
        plain = F.concat(F.lit("c"), F.regexp_extract(F.col("_metadata.file_path"), r"/commit=(\d+)/[^/]*$", 1)) if folders else F.lit("")
        return rows.select("*", F.when(made != "", made).otherwise(plain).alias("part"))

    def next_of(self, table: str, column: str) -> int:
        """One more than the largest number that a commit has given, tombstones and rows that are gone since included."""
        last = self._state["last"].get(table, {})
        if column in last or table in COUNTED and column in COUNTED[table]:
            return last.get(column, 0) + 1
        return self.read(table).agg(F.coalesce(F.max(column), F.lit(0))).first()[0] + 1

    # Writing.

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None, rewrites: tuple[str, ...] = (), parts: dict[str, tuple[DataFrame, Collection[str]]] | None = None, stream: str = "", schema: int | None = None, note: dict | None = None, lying: Collection[str] = (), writers: int = WRITERS) -> bool:
        """Write rows and make them visible at once; False where ``batch`` of ``stream`` is committed already.

        ``tables`` are rows to add, to an empty table for those in ``rewrites``. ``parts`` has for a table the rows of the
        parts it replaces, with their names in the column ``part``, and the names: a part without rows goes. Those of the tables
        ``lying`` come part by part already and are written by the tasks that read them. A ``schema`` number and a
        ``note`` are kept in the marker. ``writers`` tables are written side by side, and their shuffles lie on disk together.
        """
        if self.is_done(batch, stream):
            return False
        n, marker = self.version + 1, {"batch": batch, "tables": sorted(tables), "rewrites": list(rewrites), "parts": {}, "last": {}, "stream": stream, "schema": schema, "note": note or {}, "buckets": self.buckets}
        with ThreadPoolExecutor(writers) as threads, freeing(self.spark):  # jobs of their own, which Spark runs side by side
            added = {table: threads.submit(self._add, rows, table, n) for table, rows in tables.items()}
            made = {table: threads.submit(self._write_parts, rows, table, n, table in lying) for table, (rows, _) in (parts or {}).items()}
            wait([*added.values(), *made.values()])
        marker["last"] = {table: last for table, done in added.items() if (last := done.result())}
        for table, (_, names) in (parts or {}).items():
            if extra := set(made[table].result()) - set(names):
                raise ValueError(f"{table}: rows of parts that are not replaced: {sorted(extra)}")
            marker["parts"][table] = {"gone": sorted(names), "made": sorted(made[table].result())}
        self._write(f"{n}.json", {"commit": n} | marker)
        self.version = n
        self._fold({"commit": n} | marker)
        if n % FULL == 0:
            self._write(f"_full.{n}", self._state)
        return True

    def _add(self, rows: DataFrame, table: str, n: int) -> dict[str, int]:
        """Write the rows of a commit; the largest of the numbers that are counted."""
        folder = f"{self.path}/{table}/commit={n}"
        evolved(rows, TABLES[table]).write.mode("overwrite").option("compression", CODEC).parquet(folder)
        columns = COUNTED.get(table, ())
        return self.spark.read.schema(struct(TABLES[table])).parquet(folder).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns]).first().asDict() if columns else {}

    def _write_parts(self, rows: DataFrame, table: str, n: int, lying: bool = False) -> list[str]:
        """Write rows by ``part``; names of the parts that have rows. Small parts are dealt to few tasks, and one of more than
        ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` to as many as it takes: a commit's rows are one part, however many.
        Rows that are ``lying`` by part are not shuffled."""
        rows = evolved(rows, (TABLES | KEYED)[table] + ", part string")
        rows = rows if lying else rows.hint("rebalance", F.col("part"))
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy("part").parquet(f"{self.path}/{table}/commit={n}-parts")
        return [x[5:] for x in self._names(f"{table}/commit={n}-parts") if x.startswith("part=")]

    def touched(self, keys: DataFrame, key: str) -> list[str]:
        """Names of the parts of a keyed table that ``keys`` fall in: as many as there are buckets at most."""
        return sorted(r[0] for r in keys.select(bucket(key, self.buckets)).distinct().collect())

    def placed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("part", bucket(key, self.buckets))

    def purge(self) -> int:
        """Delete the folders of parts that are replaced or gone, once no reader of an older version is left; how many."""
        gone = 0
        for table in TABLES | KEYED:
            live = {f for f in self.parts(table).values()}
            for folder in self._names(table):
                inside = [f"{folder}/{x}" for x in self._names(f"{table}/{folder}") if x.startswith("part=")] or [folder]
                for name in inside:
                    if name not in live:
                        self._fs.delete(self._fs_path(f"{self.path}/{table}/{name}"), True)
                        gone += 1
        return gone


def numbered(rows: DataFrame, column: str, first: int, *order: str | Column, tmp: Scratch | None = None) -> DataFrame:
    """Consecutive numbers by ``order`` from ``first``: partitions are sorted by range, counted, and offset, so
    no single task sees all rows. The sorted rows are written once, in ``tmp`` if it is given, and go with it."""
    keep = tmp is None
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())  # partition, then row
    placed = (tmp or Scratch(rows.sparkSession, "numbered")).written(placed, "numbered", keep=keep)
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    offsets, at = [], first
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    if not offsets:
        return placed.withColumn(column, F.lit(first).cast("long")).drop("_at")
    start = rows.sparkSession.createDataFrame(offsets, "_part long, _begin long")
    placed = placed.withColumn("_part", part.cast("long")).join(F.broadcast(start), "_part")  # a row a partition
    return placed.withColumn(column, F.col("_begin") + F.col("_at").bitwiseAND(2**33 - 1)).drop("_at", "_part", "_begin")


def new_only(rows: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or ignore: rows whose ``keys`` a table does not have yet, of equal keys the first by ``order``."""
    names = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
    return first.join(existing.select(*keys), keys, "left_anti")
