"""Frozen windows: filters, cursors, page envelopes with checkpoints, and the byte bound of a page."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import calendar, changes

#: Kinds and fields of cursors and the codes of errors are part of the wire format.
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MOST_ROWS, MOST_BYTES, CURSOR_LENGTH = 500, 5 * 1024 * 1024, 2_048


class PageError(ValueError):
    """A request that cannot be answered, by HTTP-like status and code."""

    def __init__(self, status: int, code: str, **more):
        super().__init__(f"{status} {code}")
        self.status, self.code, self.more = status, code, more


def iso(value: datetime) -> str:
    value = value.astimezone(UTC)
    return value.strftime("%Y-%m-%dT%H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "") + "Z"


def parse(value: str) -> datetime:
    found = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if found.tzinfo is None:
        raise ValueError("an offset is required")
    return found.astimezone(UTC)


def _packed(value: dict) -> bytes:
    return json.dumps(value, separators=(",", ":"), sort_keys=True).encode()


def digest(kind: str, after: datetime, as_of: datetime, checkpoint: int | None = None) -> str:
    filters = {"kind": kind, "updated_after": iso(after), "as_of": iso(as_of)}
    return hashlib.sha256(_packed(filters if checkpoint is None else filters | {"after_sequence": checkpoint})).hexdigest()


def encode_cursor(value: dict) -> str:
    return base64.urlsafe_b64encode(_packed(value)).rstrip(b"=").decode()


def decode_cursor(text: str, kind: str) -> dict:
    try:
        if not text or len(text) > CURSOR_LENGTH:
            raise ValueError
        value = json.loads(base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True))
        parse(value["updated_after"])
        parse(value["as_of"])
        mark = value.get("after_sequence")
        if value["v"] != 1 or value["kind"] != kind or mark is not None and (type(mark) is not int or mark < 0):
            raise ValueError
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise PageError(400, "invalid_cursor") from e
    return value


@dataclass(frozen=True)
class Frozen:
    after: datetime
    as_of: datetime
    checkpoint: int | None
    cursor: dict | None


def frozen(kind: str, now: datetime, cursor: str | None = None, after: str | None = None, as_of: str | None = None, checkpoint: int | None = None) -> Frozen:
    """The window of a request: its filters, or those that its cursor carries. A cursor takes no filters beside it."""
    slack = timedelta(minutes=5)
    if cursor is None:
        out = []
        for name, value, default in (("updated_after", after, EPOCH), ("as_of", as_of, now)):
            try:
                out.append(default if value is None else parse(value))
            except ValueError as e:
                raise PageError(422, f"invalid_{name}") from e
            if out[-1] - now > slack:
                raise PageError(422, f"future_{name}")
        if out[0] > out[1]:
            raise PageError(422, "invalid_time_window")
        return Frozen(*out, checkpoint, None)
    value = decode_cursor(cursor, kind)
    start, end = parse(value["updated_after"]), parse(value["as_of"])
    if (after, as_of, checkpoint) != (None, None, None):
        raise PageError(400, "cursor_filter_mismatch")
    if start > end or end - now > slack or value.get("filter") != digest(kind, start, end, value.get("after_sequence")):
        raise PageError(400, "invalid_cursor")
    return Frozen(start, end, value.get("after_sequence"), value)


def bounded(rows: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The rows of a page, in sequence, whose JSON fits in ``most`` bytes together; sizes are running sums."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    upto = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))  # one page
    return rows.withColumn("_upto", upto).where(F.col("_upto") < most).drop("_upto")


def news_changes(log: DataFrame, observations: DataFrame, now: datetime, limit: int = 50, most_bytes: int = MOST_BYTES, **filters) -> dict:
    """One page of the change feed: items, whether there are more, and where to go on.

    The watermark is taken on the first page and rides in the cursor; while there are more pages the next
    checkpoint is None. A single row that does not fit is an error that names its sequence.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise PageError(422, "invalid_limit")
    w = frozen("news_changes", now, **filters)
    if w.cursor:
        mark, floor = w.cursor["watermark"], w.cursor["sequence"]
    else:
        mark, floor = changes.watermark(log, F.lit(w.as_of)).first()["watermark"], 0
        if w.checkpoint is not None and w.checkpoint > mark:
            raise PageError(409, "checkpoint_ahead")
    rows = changes.page(changes.window(log, watermark=mark, as_of=F.lit(w.as_of), after=F.lit(w.after), floor=floor, checkpoint=w.checkpoint), limit)
    found = changes.envelopes(rows, observations).orderBy("sequence")
    kept = [r.asDict(recursive=True) for r in bounded(found, most_bytes).orderBy("sequence").collect()][:limit]  # limit + 1 rows at most
    first = found.select("sequence").limit(limit + 1).collect()
    if first and not kept:
        raise PageError(413, "change_too_large", sequence=first[0]["sequence"])
    more = len(first) > len(kept)
    cursor = {"v": 1, "kind": "news_changes", "updated_after": iso(w.after), "as_of": iso(w.as_of), "watermark": mark, "sequence": kept[-1]["sequence"], "filter": digest("news_changes", w.after, w.as_of, w.checkpoint)} if more else None
    if cursor and w.checkpoint is not None:
        cursor["after_sequence"] = w.checkpoint
    return {"items": kept, "has_more": more, "as_of": iso(w.as_of), "next_cursor": encode_cursor(cursor) if cursor else None, "next_updated_after": None if more else iso(w.as_of), "next_after_sequence": None if more else mark}


def news_item(log: DataFrame, observations: DataFrame, news_id: int, as_of: datetime) -> dict | None:
    """One entity as known at ``as_of``, with the sources known at its own change by the number of their observation; None
    once it is deleted."""
    row = changes.state_as_of(log.where(F.col("news_id") == news_id), F.lit(as_of), live=True)
    known = observations.where(F.col("canonical_news_id") == news_id).join(row.select(F.col("news_id").alias("canonical_news_id"), "available_at"), "canonical_news_id").where(F.col("observed_at") <= F.col("available_at"))
    found = row.join(changes.evidence_by_key(known), "news_id", "left").select(changes.news_payload(F.coalesce("sources", F.array().cast("array<string>"))).alias("news")).first()
    return found["news"].asDict(recursive=True) if found else None


def micros(local: datetime) -> int:
    """Microseconds since the epoch of a timestamp as Spark hands it to the driver, in the driver's own zone."""
    return round((local.astimezone(UTC) - EPOCH) / timedelta(microseconds=1))


def calendar_page(snapshots: DataFrame, events: DataFrame, now: datetime, limit: int = 200, **filters) -> dict:
    """One page of the latest snapshot, pinned by sequence and token; items only if it is news to the caller."""
    if not 1 <= limit <= MOST_ROWS:
        raise PageError(422, "invalid_limit")
    w = frozen("calendar", now, **filters)
    if w.cursor:
        head = snapshots.where((F.col("snapshot_sequence") == w.cursor["snapshot_sequence"]) & (F.col("snapshot_token") == w.cursor["snapshot_token"])).withColumn("has_changes", F.lit(True)).first()
        if head is None:
            raise PageError(409, "snapshot_expired")
    else:
        head = calendar.latest_snapshot(snapshots, F.lit(w.as_of), F.lit(w.after)).first()
    if head is None:
        return {"items": [], "has_more": False, "snapshot_token": None, "next_cursor": None, "next_after_sequence": None}
    if w.checkpoint is not None and w.checkpoint > head["snapshot_sequence"]:
        raise PageError(409, "checkpoint_ahead")
    items = []
    if w.cursor or calendar.includes_items(head["has_changes"], head["snapshot_sequence"], w.checkpoint):
        page = calendar.event_page(events, head["snapshot_sequence"], w.cursor["ordinal"] if w.cursor else 0, limit)
        wire = calendar.wire_items(page, F.lit(head["is_stale"]), *(F.timestamp_micros(F.lit(micros(head[c]))) for c in ("source_fetched_at", "available_at")))
        items = [r.asDict() for r in wire.orderBy("ordinal").collect()]
    more, items = len(items) > limit, items[:limit]
    cursor = {"v": 1, "kind": "calendar", "updated_after": iso(w.after), "as_of": iso(w.as_of), "snapshot_sequence": head["snapshot_sequence"], "snapshot_token": head["snapshot_token"], "ordinal": items[-1]["ordinal"], "filter": digest("calendar", w.after, w.as_of, w.checkpoint)} if more else None
    if cursor and w.checkpoint is not None:
        cursor["after_sequence"] = w.checkpoint
    return {"items": items, "has_more": more, "snapshot_token": head["snapshot_token"], "is_stale": head["is_stale"], "next_cursor": encode_cursor(cursor) if cursor else None, "next_after_sequence": None if more else head["snapshot_sequence"]}


def health_page(spark: SparkSession, log: DataFrame, snapshots: DataFrame, health: DataFrame) -> dict:
    """Largest sequences, the newest data_through, and every source's state by name."""
    from tidemark.operators.health import data_through, latest

    sequences = [df.agg(F.coalesce(F.max(c), F.lit(0)).alias("n")).first()["n"] for df, c in ((log, "change_sequence"), (snapshots, "snapshot_sequence"))]
    sources = [r.asDict() for r in latest(health).orderBy("source").collect()]  # a row a configured source
    return {"max_change_sequence": sequences[0], "max_snapshot_sequence": sequences[1], "data_through": data_through(health).first()["data_through"], "sources": sources}
