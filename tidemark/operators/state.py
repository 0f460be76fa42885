"""The current state of a store: what a batch looks up, in parts by a hash of the key.

A batch reads the parts that its keys fall in and writes them anew; everything else stays as it is, whatever the length
of the history. The tables are those of schema.KEYED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_title
from tidemark.operators import changes as log
from tidemark.operators.store import Store

#: Latest entities that similar titles of a batch are compared with.
POOL = 2_000
Parts = dict[str, tuple[DataFrame, list[str]]]


def effective() -> Column:
    return F.coalesce("published_at", "fetched_at")


def keys_of(entities: DataFrame) -> DataFrame:
    """(key, news_id): what an entity is found by: its content hash and its canonical URL."""
    rows = entities.select(F.explode(F.array("content_hash", F.concat(F.lit("url:"), "url"))).alias("key"), "news_id")
    return rows.where("key IS NOT NULL AND key <> 'url:'")


def titles_of(entities: DataFrame) -> DataFrame:
    """(news_id, bucket, title, recency) of entities, as the pool keeps them."""
    return entities.select("news_id", F.date_format(effective(), "yyyy-MM-dd").alias("bucket"), normalize_title(F.col("title")).alias("title"), effective().alias("recency"))


def latest(titles: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` newest; of equally new ones the smaller id."""
    return titles.orderBy(F.desc("recency"), "news_id").limit(pool)


def ranked(pool: DataFrame, most: int) -> DataFrame:
    """The pool with positions before those of any batch, newest first; one task numbers its rows, ``most`` at most."""
    return pool.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("recency"), "news_id")) - most - 1).cast("long"))


def live(entities: DataFrame) -> DataFrame:
    return entities.where("operation <> 'delete'")


def with_batch(store: Store, changed: DataFrame, fresh: DataFrame, seen: DataFrame, pool: int = POOL) -> Parts:
    """The parts that a batch writes anew: ``changed`` (the new latest changes of entities), ``fresh`` (those of them that
    are new entities) and ``seen`` (new observations, numbered)."""
    names, keys = store.touched(changed.select("news_id").union(seen.select("canonical_news_id")), "news_id"), keys_of(fresh)
    key_names = store.touched(keys, "key")
    read = store.read
    kept = read("entities", names).join(changed.select("news_id"), "news_id", "left_anti")
    rows = {
        "entities": kept.unionByName(changed.select(*kept.columns)), "observation_keys": read("observation_keys", names).unionByName(seen.select("canonical_news_id", "observation_hash")),
        "evidence": log.merged_sightings(read("evidence", names), seen),
    }
    by = {"entities": "news_id"}
    parts = {table: (store.placed(df, by.get(table, "canonical_news_id")), names) for table, df in rows.items()}
    if key_names:
        parts["entity_keys"] = (store.placed(read("entity_keys", key_names).unionByName(keys), "key"), key_names)
        parts["entity_pool"] = (latest(read("entity_pool").unionByName(titles_of(fresh)), pool).withColumn("part", F.lit("all")), ["all"])
    return parts


def without(store: Store, stones: DataFrame, pool: int = POOL, *, few: bool = False) -> Parts:
    """The parts that tombstones write anew: the entities' latest change, and no keys, observations or evidence of them. If
    these are ``few``, rows but for the pool's lie by part, as they were read."""
    names, keys = store.touched(stones, "news_id"), keys_of(stones)
    key_names, gone = store.touched(keys, "key"), F.broadcast(stones.select("news_id")) if few else stones.select("news_id")
    as_seen = gone.withColumnRenamed("news_id", "canonical_news_id")
    entities = store.read("entities", names)
    made = store.placed(stones.select(*entities.columns), "news_id")
    parts = {"entities": (store.placed(entities.join(gone, "news_id", "left_anti"), "news_id").unionByName(made.repartition("part") if few else made), names)}
    for table in ("observation_keys", "evidence"):
        parts[table] = (store.placed(store.read(table, names).join(as_seen, "canonical_news_id", "left_anti"), "canonical_news_id"), names)
    parts["entity_keys"] = (store.placed(store.read("entity_keys", key_names).join(gone, "news_id", "left_anti"), "key"), key_names)
    held = store.read("entity_pool")
    if not held.join(gone, "news_id", "left_semi").isEmpty():  # older entities move up: all are asked, once
        rest = live(store.read("entities")).join(gone, "news_id", "left_anti")
        parts["entity_pool"] = (latest(titles_of(rest), pool).withColumn("part", F.lit("all")), ["all"])
    return parts


def rebuilt(store: Store, pool: int = POOL) -> Parts:
    """All parts from the logs: for a store that has no state yet."""
    changes, seen = store.read("news_changes"), store.read("news_source_observations")
    latest_of = lambda *names: log.state_as_of(changes.select("change_sequence", "news_id", "operation", *names))  # noqa: E731  shuffles these alone
    every = [str(i) for i in range(store.buckets)]
    rows = {"entities": (log.state_as_of(changes), "news_id"), "entity_keys": (keys_of(live(latest_of("content_hash", "url"))), "key"), "observation_keys": (seen.select("canonical_news_id", "observation_hash").distinct(), "canonical_news_id"), "evidence": (log.first_sightings(seen), "canonical_news_id")}
    parts = {table: (store.placed(df, key), every) for table, (df, key) in rows.items()}
    return parts | {"entity_pool": (latest(titles_of(live(latest_of("title", "published_at", "fetched_at"))), pool).withColumn("part", F.lit("all")), ["all"])}
