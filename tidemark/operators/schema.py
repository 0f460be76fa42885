"""Table schemas of the feed engine; times are TimestampType in a UTC session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "source string, title string, summary string, url string, image_url string, published_at timestamp, fetched_at timestamp, source_tickers array<string>, content_hash string, updated_at timestamp"
CHANGES = f"change_sequence long, news_id long, operation string, {ENTITY}, available_at timestamp, payload_hash string"
OBSERVATIONS = "observation_id long, canonical_news_id long, source string, original_title string, original_url string, source_tickers array<string>, observed_at timestamp, observation_hash string"
HEALTH = "source string, status string, last_attempt_at timestamp, last_success_at timestamp, data_through timestamp, consecutive_failures long, next_attempt_at timestamp, raw_count long, inserted_count long, duplicates_count long, error_code string, updated_at timestamp, version long"
SNAPSHOTS = "snapshot_sequence long, snapshot_token string, source string, source_fetched_at timestamp, data_through timestamp, is_stale boolean, available_at timestamp, payload_hash string"
CALENDAR = "snapshot_sequence long, ordinal long, event_id string, country_code string, country string, title string, impact string, impact_zh string, scheduled_at string, scheduled_at_utc timestamp, forecast string, previous string, actual string, content_hash string"
TABLES = {"news_changes": CHANGES, "news_source_observations": OBSERVATIONS, "source_health": HEALTH, "calendar_snapshots": SNAPSHOTS, "calendar_events": CALENDAR}
#: The current state, in parts by a hash of the key: the latest change of every entity (tombstones too), which entity has a
#: key, which observations there are, the first sighting of each source; and the latest live entities, one part.
KEYED = {
    "entities": CHANGES,
    "entity_keys": "key string, news_id long",
    "observation_keys": "canonical_news_id long, observation_hash string",
    "evidence": "canonical_news_id long, source_key string, observed_at timestamp, observation_id long, source string",
    "entity_pool": "news_id long, bucket string, title string, recency timestamp",
}
#: Columns whose largest number a commit's marker keeps.
COUNTED = {"news_changes": ("change_sequence", "news_id"), "news_source_observations": ("observation_id",), "calendar_snapshots": ("snapshot_sequence",)}
#: What enumerated columns may hold, and how many characters texts keep.
ALLOWED = {"operation": ("upsert", "delete"), "status": ("ok", "degraded", "unavailable", "disabled", "not_configured"), "impact": ("low", "medium", "high", "holiday")}
LENGTHS = {"source": 500, "title": 4_000, "summary": 50_000, "url": 8_000, "image_url": 8_000, "original_title": 4_000, "original_url": 8_000}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def evolved(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with the columns of ``ddl``: missing ones are null, extra ones go, texts are cut, enums checked."""
    out = []
    for f in struct(ddl):
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in LENGTHS:
            c = F.substring(c, 1, LENGTHS[f.name])
        if f.name in ALLOWED and f.name in df.columns:
            c = F.when(c.isNull() | c.isin(*ALLOWED[f.name]), c).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: "), c)).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def migrated(legacy: DataFrame) -> DataFrame:
    """Entities of an older table: missing tickers are an empty list, a missing update time is that of the fetch."""
    rows = evolved(legacy, f"news_id long, {ENTITY}")
    return rows.withColumns({"source_tickers": F.coalesce("source_tickers", F.array().cast("array<string>")), "updated_at": F.coalesce("updated_at", "fetched_at")})
