"""The calendar's last known good copy: one JSON file of ``{fetched_at, events}``, or an older bare list."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import parse_utc

EVENT = "date string, title string, country string, impact string, forecast string, previous string, actual string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events with ``fetched_at``; a bare list takes the file's own time."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("written"))
    events = f"array<struct<{', '.join(x.replace(' ', ':') for x in EVENT.split(', '))}>>"
    whole = F.from_json("value", f"fetched_at string, events {events}")
    listed = F.trim("value").startswith("[")
    rows = text.select(F.when(listed, F.col("written")).otherwise(parse_utc(whole["fetched_at"])).alias("fetched_at"), F.explode(F.when(listed, F.from_json("value", events)).otherwise(whole["events"])).alias("e"))
    return rows.select("fetched_at", "e.*")


def write(path: str, events: list[dict], fetched_at: str) -> None:
    """Replace the copy at once: written beside it, flushed to disk, renamed. For the driver's own small file."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, ready = tempfile.mkstemp(dir=folder, prefix=".calendar-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump({"fetched_at": fetched_at, "events": events}, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(ready, path)
