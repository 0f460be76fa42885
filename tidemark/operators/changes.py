"""The change log: watermarks, windows, state as of a time, source evidence, compaction.

A log has change_sequence, news_id, operation and available_at; evidence has canonical_news_id, source,
observed_at and observation_id. All are ordinary DataFrames, so filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermark(changes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row: the largest sequence available at ``as_of``; 0 if there is none."""
    seen = changes if as_of is None else changes.where(F.col("available_at") <= as_of)
    return seen.agg(F.coalesce(F.max("change_sequence"), F.lit(0)).cast("long").alias("watermark"))


def window(changes: DataFrame, *, watermark: int, as_of: Column, after: Column | None = None, floor: int = 0, checkpoint: int | None = None) -> DataFrame:
    """Changes of a frozen window. With a sequence ``checkpoint`` no lower time bound holds, so a change that
    became visible late is still read."""
    rows = changes.where((F.col("change_sequence") > max(floor, checkpoint or 0)) & (F.col("change_sequence") <= watermark) & (F.col("available_at") <= as_of))
    return rows if checkpoint is not None or after is None else rows.where(F.col("available_at") > after)


def page(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` + 1 changes by sequence: the last one tells that there are more."""
    return rows.orderBy("change_sequence").limit(limit + 1)


def state_as_of(changes: DataFrame, as_of: Column | None = None, live: bool = False) -> DataFrame:
    """The latest change of each key by sequence, as known at ``as_of``; without tombstones if ``live``."""
    seen = changes if as_of is None else changes.where(F.col("available_at") <= as_of)
    names = [c for c in seen.columns if c != "news_id"]
    last = seen.groupBy("news_id").agg(F.max_by(F.struct(*names), "change_sequence").alias("r")).select("news_id", "r.*")
    last = last.select(*seen.columns)
    return last.where("operation <> 'delete'") if live else last


def first_sightings(observations: DataFrame) -> DataFrame:
    """(canonical_news_id, source_key, observed_at, observation_id, source): of each source of a key, told apart in lower
    case, the first observation by time, then number."""
    first = observations.groupBy("canonical_news_id", F.lower("source").alias("source_key")).agg(F.min(F.struct("observed_at", "observation_id", "source")).alias("o"))
    return first.select("canonical_news_id", "source_key", "o.*")


def merged_sightings(known: DataFrame, more: DataFrame) -> DataFrame:
    """First sightings of old and new observations, from the first sightings of the old and the new ones alone."""
    both = known.unionByName(first_sightings(more)).groupBy("canonical_news_id", "source_key").agg(F.min(F.struct("observed_at", "observation_id", "source")).alias("o"))
    return both.select("canonical_news_id", "source_key", "o.*")


def with_evidence(changes: DataFrame, seen: DataFrame) -> DataFrame:
    """``changes`` with the sources observed for a change's key up to its availability, an empty list if there are none.

    ``seen`` are observations, or first sightings that are kept up (with a source_key). Sources are listed as first seen, by
    time, then observation. A key's first sightings are one ordered list, a row a source, that meets each of its changes
    once and is cut at its time.
    """
    first = seen if "source_key" in seen.columns else first_sightings(seen)
    lists = first.groupBy("canonical_news_id").agg(F.array_sort(F.collect_list(F.struct("observed_at", "observation_id", "source"))).alias("_seen"))  # as many as there are sources
    rows = changes.join(lists, F.col("news_id") == F.col("canonical_news_id"), "left").drop("canonical_news_id")
    known = F.filter("_seen", lambda x: x["observed_at"] <= F.col("available_at"))
    return rows.withColumn("sources", F.coalesce(F.transform(known, lambda x: x["source"]), F.array().cast("array<string>"))).drop("_seen")


def evidence_by_key(observations: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(news_id, sources): of each key the sources observed up to ``as_of``, by the number of their first observation alone.

    This is the order of one entity's evidence; that of a change (with_evidence) goes by time first.
    """
    known = observations if as_of is None else observations.where(F.col("observed_at") <= as_of)
    first = known.groupBy(F.col("canonical_news_id").alias("news_id"), F.lower("source").alias("k")).agg(F.min(F.struct("observation_id", "source")).alias("o"))
    return first.groupBy("news_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["source"]).alias("sources"))


def source_evidence(changes: DataFrame, observations: DataFrame) -> DataFrame:
    """(change_sequence, sources, source_count) of the changes whose key was observed by their time."""
    rows = with_evidence(changes.select("change_sequence", "news_id", "available_at"), observations).where(F.size("sources") > 0)
    return rows.select("change_sequence", "sources", F.size("sources").cast("long").alias("source_count"))


def compacted(changes: DataFrame, cutoff: Column) -> DataFrame:
    """The log without what became available before ``cutoff``, but with the latest change of every key."""
    latest = changes.groupBy("news_id").agg(F.max("change_sequence").alias("change_sequence")).select("change_sequence")
    old = F.coalesce(F.col("available_at") < cutoff, F.lit(False))
    return changes.where(~old).unionByName(changes.where(old).join(latest, "change_sequence", "left_semi").select(*changes.columns))


def news_payload(row_sources: Column | None = None) -> Column:
    """The entity as served: sources known at the change, else the row's own."""
    own = F.array("source")
    sources = own if row_sources is None else F.when(F.size(row_sources) > 0, row_sources).otherwise(own)
    names = ("title", "summary", "url", "image_url", "published_at", "fetched_at", "source_tickers", "content_hash", "updated_at")
    return F.struct(F.col("news_id").alias("id"), "source", *names, sources.alias("sources"), F.size(sources).alias("source_count"))


def envelopes(changes: DataFrame, observations: DataFrame) -> DataFrame:
    """The change feed's rows: sequence, operation, times, news_id, and ``news`` (null for a tombstone)."""
    rows = with_evidence(changes, observations)
    return rows.select(
        F.col("change_sequence").alias("sequence"), "operation", F.col("available_at").alias("changed_at"), F.col("updated_at").alias("source_updated_at"), "available_at",
        F.when(F.col("operation") == "upsert", news_payload(F.col("sources"))).alias("news"), "news_id",
    )
