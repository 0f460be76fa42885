"""Landed polls as a Spark data source, for batches and streams: ``spark.read.format("landed_feed")``.

A poll is one or more files ``POLL.PART.json`` (or ``.xml``), POLL being a name that sorts by time; it is a partition of its
own and is read in whole. A part that cannot be read is left out; only a poll all of whose parts fail is an error. A stream's
offset is the name of the last poll, so polls must land in the order of their names, each complete at once (written
elsewhere, then moved).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.feeds import RAW, REGISTRY

SCHEMA = "_feed string, _at long, item string"


class Poll(InputPartition):
    def __init__(self, name: str, files: list[str]):
        self.name, self.files = name, files


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def polls(path: str) -> list[Poll]:
    """The polls in a folder by name."""
    from pyarrow import fs

    system, folder = _files(path)
    found: dict[str, list[str]] = {}
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
            found.setdefault(info.base_name.split(".", 1)[0], []).append(info.path)
    return [Poll(name, sorted(files)) for name, files in sorted(found.items())]


def items_of(body: bytes, xml: bool) -> list[dict]:
    """The items of one response: a JSON list of objects, or the item elements of RSS."""
    if not xml:
        items = json.loads(body)
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            raise ValueError("a response is a list of objects")
        return items
    text = lambda e, name: (e.find(name).text or "") if e.find(name) is not None else None
    return [{"title": text(e, "title"), "link": text(e, "link"), "pubDate": text(e, "pubDate"), "source": text(e, "source"), "category": [{"_domain": c.get("domain"), "_VALUE": c.text} for c in e.findall("category")]} for e in ElementTree.fromstring(body).iter("item")]


def rows_of(path: str, poll: Poll) -> Iterator[tuple[str, int, str]]:
    """(poll, place, item) of all parts of a poll that can be read."""
    system, _ = _files(path)
    good, errors, at = 0, [], 0
    for name in poll.files:
        try:
            with system.open_input_stream(name) as f:
                items = items_of(f.read(), name.endswith(".xml"))
        except (OSError, ValueError, ElementTree.ParseError) as error:  # a part's failure
            errors.append(f"{name}: {type(error).__name__}")
            continue
        good += 1
        for item in items:
            yield poll.name, at, json.dumps(item)
            at += 1
    if errors and not good:
        raise RuntimeError(f"all parts of poll {poll.name} failed: {'; '.join(errors)}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Poll]:
        return polls(self.path)

    def read(self, partition: Poll) -> Iterator[tuple]:
        return rows_of(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max((p.name for p in polls(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        return [p for p in polls(self.path) if start["last"] < p.name <= end["last"]]

    def read(self, partition: Poll) -> Iterator[tuple]:
        return rows_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LandedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedFeed)


def records(rows: DataFrame, source: str) -> DataFrame:
    """Records of a registered source from landed ``item`` texts; fields of another kind than the source's are null."""
    kind = RAW[source] if source in RAW else RAW["rss"]
    return REGISTRY[source].parse(rows.select("_feed", "_at", F.from_json("item", kind).alias("r")).select("_feed", "_at", "r.*"))
