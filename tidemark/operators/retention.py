"""Retention: expired entities become tombstones unless something refers to them; logs and snapshots shrink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashes import change_hash
from tidemark.functions.times import utc_text
from tidemark.operators import state
from tidemark.operators.store import Store, numbered
from tidemark.scratch import Scratch, freeing

BATCH = 500
#: Rows to drop up to which their keys are broadcast, and a part is written by the tasks that read it; beyond, tables are shuffled.
FEW = 500_000


def candidates(entities: DataFrame, cutoff: Column, protectors: list[tuple[DataFrame, str]], key: str = "news_id", batch: int = BATCH) -> DataFrame:
    """The ``batch`` oldest entities from before ``cutoff`` that no protecting table refers to. Entities without a
    time are kept; null references protect nothing."""
    rows = entities.where(F.col("effective_at") < cutoff)
    for table, column in protectors:
        rows = rows.join(table.select(F.col(column).alias(key)).where(F.col(key).isNotNull()), key, "left_anti")
    return rows.orderBy("effective_at", key).limit(batch)


def tombstones(expired: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete images of entities, stamped ``now``; they take part in the log like any change."""
    return expired.drop(*{"effective_at"} - set(keep)).withColumns({"operation": F.lit("delete"), "updated_at": now, "available_at": now})


def cascaded(children: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """``children`` without those of entities that are gone."""
    return children.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def kept_snapshots(snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """Snapshots since ``cutoff``, and the newest one always."""
    last = snapshots.agg(F.coalesce(F.max("snapshot_sequence"), F.lit(0)).alias("_last"))
    return snapshots.join(F.broadcast(last)).where((F.col("available_at") >= cutoff) | (F.col("snapshot_sequence") == F.col("_last"))).drop("_last")  # one row


def missing(entities: DataFrame, log: DataFrame, key: str, log_key: str) -> DataFrame:
    """Entities that a log has no row of: what a backfill adds."""
    return entities.join(log.select(F.col(log_key).alias(key)), key, "left_anti")


def superseded(changes: DataFrame, latest: DataFrame, cutoff: Column) -> DataFrame:
    """Changes from before ``cutoff`` that are not among the ``latest(change_sequence)`` of their keys: what compaction drops."""
    return changes.where(F.col("available_at") < cutoff).join(latest.select("change_sequence"), "change_sequence", "left_anti")


def cleanup(store: Store, now: datetime, protectors: list[tuple[DataFrame, str]] = (), news_days: int = 365, change_days: int = 365, snapshot_days: int = 90, batch: int | None = None, most: int = BATCH) -> dict[str, int]:
    """Retention as one commit; {news_items, news_changes, calendar_snapshots} that went.

    The ``most`` oldest expired entities without a protector become tombstones (none if ``news_days`` is 0); their
    observations, keys and evidence go. Older changes that are not the latest of their key go, and older snapshots but for
    the newest, with their events. Only the parts that hold such rows are written anew, and they become visible together
    with the tombstones. A ``batch`` number that is committed already is skipped; where nothing is due, nothing is committed.
    """
    none = {"news_items": 0, "news_changes": 0, "calendar_snapshots": 0}
    if store.is_done(batch, "retention"):
        return none
    days = lambda n: F.lit(now) - F.make_dt_interval(F.lit(n))
    with Scratch(store.spark, "retention") as tmp:
        entities = store.read("entities")
        gone = tmp.written(candidates(state.live(entities).select("news_id", state.effective().alias("effective_at")), days(news_days), list(protectors), batch=most) if news_days else entities.select("news_id", state.effective().alias("effective_at")).limit(0), "gone")
        held = store.read("entities", store.touched(gone, "news_id")).join(F.broadcast(gone), "news_id")  # most rows
        stones = tombstones(held.drop("change_sequence", "payload_hash"), F.lit(now), keep=("effective_at",))
        stones = stones.withColumn("payload_hash", change_hash(F.col("operation"), F.col("news_id"), F.col("content_hash"), utc_text(F.col("updated_at"))))
        stones = tmp.written(numbered(stones, "change_sequence", store.next_of("news_changes", "change_sequence"), "effective_at", "news_id", tmp=tmp).drop("effective_at"), "stones")

        latest = entities.select("news_id", "change_sequence").join(stones.select("news_id"), "news_id", "left_anti").select("change_sequence").union(stones.select("change_sequence"))
        old = tmp.written(superseded(store.read("news_changes", named=True).select("change_sequence", "available_at", "part"), latest, days(change_days)), "old")
        headers = store.read("calendar_snapshots", named=True).select("snapshot_sequence", "available_at", "part")
        kept = kept_snapshots(headers, days(snapshot_days)).select("snapshot_sequence")
        past = tmp.written(headers.join(kept, "snapshot_sequence", "left_anti"), "past")
        counts = {"news_items": stones.count(), "news_changes": old.count(), "calendar_snapshots": past.count()}

        parts, few = {}, {what: n <= FEW for what, n in counts.items()}
        lying = {"news_items": ["entities", "observation_keys", "evidence", "entity_keys", "news_source_observations"], "news_changes": ["news_changes"], "calendar_snapshots": ["calendar_snapshots", "calendar_events"]}
        if counts["news_items"]:
            parts |= state.without(store, stones, few=few["news_items"])
            parts |= _cut(store, "news_source_observations", stones.select(F.col("news_id").alias("canonical_news_id")), "canonical_news_id", few["news_items"])
        if counts["news_changes"]:
            parts |= _cut(store, "news_changes", old.select("change_sequence"), "change_sequence", few["news_changes"])
        if counts["calendar_snapshots"]:
            for table in lying["calendar_snapshots"]:
                parts |= _cut(store, table, past.select("snapshot_sequence"), "snapshot_sequence", few["calendar_snapshots"])
        if parts:
            store.commit({"news_changes": stones} if counts["news_items"] else {}, batch, parts=parts, stream="retention", lying=[t for what in few if few[what] for t in lying[what]])
        return counts if parts else none


def _cut(store: Store, table: str, gone: DataFrame, key: str, few: bool = False) -> dict[str, tuple[DataFrame, list[str]]]:
    """The parts of ``table`` that hold rows of ``gone``, without these rows; if these are ``few``, the rest lies where it was read."""
    gone = F.broadcast(gone) if few else gone
    with freeing(store.spark):
        names = [r["part"] for r in store.read(table, named=True).select(key, "part").join(gone, key, "left_semi").select("part").distinct().collect()]  # parts, not rows
    return {table: (store.read(table, names, named=True).join(gone, key, "left_anti"), names)} if names else {}
