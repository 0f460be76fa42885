"""A store brought up to date: older rows, first observations, baseline changes and the current state, each step once."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashes import observation_hash
from tidemark.operators import changes as log
from tidemark.operators import state
from tidemark.operators.retention import missing
from tidemark.operators.schema import ENTITY, TABLES, migrated, struct
from tidemark.operators.store import Store, numbered
from tidemark.scratch import Scratch


def first_observations(entities: DataFrame, observations: DataFrame, now: datetime) -> DataFrame:
    """An observation of each entity that has none: its own source, title, URL and tickers, seen ``now``."""
    rows = missing(entities, observations, "news_id", "canonical_news_id")
    rows = rows.select(F.col("news_id").alias("canonical_news_id"), "source", F.col("title").alias("original_title"), F.col("url").alias("original_url"), "source_tickers", F.lit(now).alias("observed_at"))
    return rows.withColumn("observation_hash", observation_hash(F.col("source"), F.col("original_title"), F.col("original_url"), F.col("source_tickers")))


def baseline_changes(entities: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """An upsert of each entity that the log has no change of, available from ``now``; its payload hash is its content hash."""
    rows = missing(entities, changes, "news_id", "news_id")
    return rows.withColumns({"operation": F.lit("upsert"), "available_at": F.lit(now), "payload_hash": F.col("content_hash")})


def upgrade(store: Store, legacy: DataFrame | None = None, now: datetime | None = None) -> list[str]:
    """Run the steps that the store's recorded schema number does not have yet; their names.

    ``legacy`` are entities of an older table, some columns of which may be missing. Each step is one commit that also records
    its number, so a run that is stopped goes on with the next step, at the time that its first step recorded. Running it
    again does nothing.
    """
    done = []
    noted = next((m["note"]["upgraded_at"] for m in store.commits() if m.get("note", {}).get("upgraded_at")), None)
    now = datetime.fromisoformat(noted) if noted else now or datetime.now(UTC)
    note = {"upgraded_at": now.isoformat()}
    old = migrated(legacy) if legacy is not None else store.spark.createDataFrame([], struct(f"news_id long, {ENTITY}"))
    for number, (name, step) in enumerate(STEPS, 1):
        if store.schema_version < number:
            with Scratch(store.spark, "upgrade") as tmp:
                tables, parts = step(store, old, now, tmp)
                store.commit(tables, parts=parts, schema=number, note=note, writers=1)  # whole tables: one's shuffles at a time
            done.append(name)
    return done


def _observations(store: Store, old: DataFrame, now: datetime, tmp: Scratch):
    """Of older rows and of what the log has alive."""
    known = state.live(log.state_as_of(store.read("news_changes"))).select(*old.columns)
    rows = first_observations(old.unionByName(missing(known, old, "news_id", "news_id")), store.read("news_source_observations"), now)
    return {"news_source_observations": numbered(rows, "observation_id", store.next_of("news_source_observations", "observation_id"), "canonical_news_id", tmp=tmp)}, {}


def _changes(store: Store, old: DataFrame, now: datetime, tmp: Scratch):
    rows = baseline_changes(old, store.read("news_changes"), now)
    return {"news_changes": numbered(rows, "change_sequence", store.next_of("news_changes", "change_sequence"), "news_id", tmp=tmp)}, {}


def _state(store: Store, old: DataFrame, now: datetime, tmp: Scratch):
    return {}, state.rebuilt(store)


STEPS = (("first observations", _observations), ("baseline changes", _changes), ("current state", _state))
