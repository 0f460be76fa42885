"""Streaming ingest: landed records to the store, micro-batch by micro-batch, and tailing the change log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.hashes import change_hash, observation_hash
from tidemark.functions.text import merge_tickers, normalize_title
from tidemark.functions.times import utc_text
from tidemark.operators import state
from tidemark.operators.dedup import exact_keys, greedy, key_hits, similar_pairs
from tidemark.operators.schema import TABLES, evolved
from tidemark.operators.store import Store, new_only, numbered
from tidemark.scratch import Scratch

RECORDS = "source string, title string, summary string, url string, image_url string, published_at string, source_tickers array<string>"
#: Rows of other tables, by the counts of a batch.
More = Callable[[dict[str, int]], dict[str, DataFrame]]


def resolved(items: DataFrame, hits: DataFrame, pool: DataFrame, first: int, tmp: Scratch) -> DataFrame:
    """(pos, news_id, is_new): the entity of every item of a batch, numbered from ``first`` where it is new.

    ``items(pos, content_hash, legacy_hash, url_key, bucket, title)`` from position 1, ``hits(pos, rank, news_id)`` of their
    exact keys among all entities, ``pool(pos, news_id, bucket, title)`` the latest ones at positions below. An item asks
    content hash, legacy hash and URL, of all entities and of the new ones before it in the batch, then the titles of the
    pool, newest first, then those of the new ones before it. Only items that match nothing become new and register their
    keys.
    """
    hits = hits.select("pos", F.struct("rank", F.lit(0).cast("long").alias("order"), "news_id").alias("owner"))
    latest = tmp.written(pool, "pool")
    both = latest.select("pos", "bucket", "title").union(items.select("pos", "bucket", "title"))
    # Positions in the pool come before those of the batch; the joins keep pairs of an item with an entity.
    pairs = similar_pairs(both).join(latest.select(F.col("pos").alias("prior"), "news_id"), "prior").join(items.select("pos"), "pos", "left_semi")
    titles = pairs.groupBy("pos").agg(F.min(F.struct(F.lit(3).alias("rank"), F.col("prior").alias("order"), "news_id")).alias("owner"))
    old = tmp.written(hits.unionByName(titles), "old")
    held = old.select("pos").distinct()
    fresh = tmp.written(greedy(items.join(held, "pos", "left_anti"), tmp), "fresh")
    named = numbered(fresh.where("pos = canonical").select("pos"), "news_id", first, "pos", tmp=tmp)
    # What an entity or the pool matches may still share a better key with a new item before it.
    asked = exact_keys(items)
    keys = asked.join(named, "pos").groupBy("key").agg(F.min(F.struct(F.col("pos").alias("order"), "news_id")).alias("new"))
    batch = asked.join(held, "pos").join(keys, "key").where("new.order < pos").select("pos", F.struct("rank", F.col("new.order").alias("order"), F.col("new.news_id").alias("news_id")).alias("owner"))
    owned = old.unionByName(batch).groupBy("pos").agg(F.min("owner").alias("owner")).select("pos", F.col("owner.news_id").alias("news_id"), F.lit(False).alias("is_new"))
    return owned.union(fresh.join(named.withColumnRenamed("pos", "canonical"), "canonical").select("pos", "news_id", (F.col("pos") == F.col("canonical")).alias("is_new")))


def ingest(store: Store, prepared: DataFrame, now: datetime | None = None, batch: int | None = None, stream: str = "", more: More | None = None) -> dict[str, int]:
    """One batch of prepared records (feeds.prepared) into the store; {inserted, duplicates}.

    Exact keys are looked up in the whole history, similar titles in its state.POOL latest entities and in the
    batch itself. New entities, corroborations and merged tickers are changes; what repeats is nothing. Only the parts of the
    state that the batch's keys fall in are read and written anew. ``more`` gives rows of other tables, from the counts,
    that belong to the same commit. A batch number of ``stream`` that is already committed is skipped, so a replay adds
    nothing.
    """
    if store.is_done(batch, stream):
        return {"inserted": 0, "duplicates": 0}
    with Scratch(store.spark, "ingest") as tmp:
        items = numbered(prepared, "pos", 1, *(["_at"] if "_at" in prepared.columns else ["fetched_at", "url", "title"]), tmp=tmp)
        shape = [F.col("url").alias("url_key"), F.date_format(state.effective(), "yyyy-MM-dd").alias("bucket"), normalize_title(F.col("title")).alias("title")]
        asked = items.select("pos", "content_hash", "legacy_hash", *shape)
        pool = state.ranked(state.latest(store.read("entity_pool"), state.POOL), state.POOL)
        owner = resolved(asked, key_hits(asked, known_keys(store, asked)), pool, store.next_of("news_changes", "news_id"), tmp)
        return committed(store, tmp.written(items.join(owner, "pos"), "rows"), now or datetime.now(UTC), tmp, batch, stream, more)


def insert(store: Store, prepared: DataFrame, now: datetime | None = None) -> int | None:
    """One prepared record as a new entity: its id, or None where any of its keys is known; titles are not compared.

    A known one is a duplicate of the smallest id that has one of the keys: its observation and tickers are recorded.
    """
    with Scratch(store.spark, "insert") as tmp:
        item = tmp.written(prepared.withColumn("pos", F.lit(1).cast("long")), "item")
        if item.count() != 1:
            raise ValueError("one record at a time")
        asked = item.select("pos", "content_hash", "legacy_hash", F.col("url").alias("url_key"))
        old = key_hits(asked, known_keys(store, asked)).agg(F.min("news_id")).first()[0]
        number = F.lit(store.next_of("news_changes", "news_id") if old is None else old).cast("long")
        committed(store, tmp.written(item.withColumns({"news_id": number, "is_new": F.lit(old is None)}), "rows"), now or datetime.now(UTC), tmp)
        return None if old is not None else store.next_of("news_changes", "news_id") - 1


def known_keys(store: Store, asked: DataFrame) -> DataFrame:
    """(key, news_id) of the parts that the items' keys fall in."""
    if store.parts("news_changes") and not store.parts("entities"):
        raise ValueError("the store has no state yet: run migrate.upgrade once")
    return store.read("entity_keys", store.touched(exact_keys(asked), "key"))


def committed(store: Store, rows: DataFrame, now: datetime, tmp: Scratch, batch: int | None = None, stream: str = "", more: More | None = None) -> dict[str, int]:
    """Commit the items ``rows`` with their news_id and whether it is_new: changes, observations and state at once."""
    at = F.lit(now)
    seen = rows.select(F.col("news_id").alias("canonical_news_id"), "source", "original_title", "original_url", "source_tickers", at.alias("observed_at"), observation_hash(F.col("source"), F.col("original_title"), F.col("original_url"), F.col("source_tickers")).alias("observation_hash"), "pos")
    names = store.touched(rows.select("news_id"), "news_id")
    entities = tmp.written(state.live(store.read("entities", names)), "entities")
    seen = tmp.written(new_only(seen, store.read("observation_keys", names), ["canonical_news_id", "observation_hash"], "pos"), "seen")
    gathered = rows.groupBy("news_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_tickers"))), lambda x: x["source_tickers"])).alias("more"), F.max("is_new").alias("is_new"))
    changed = entities.join(gathered, "news_id").join(seen.select(F.col("canonical_news_id").alias("news_id")).distinct().withColumn("seen", F.lit(True)), "news_id", "left")
    merged = merge_tickers(F.col("source_tickers"), F.col("more"))
    changed = changed.where((merged != F.col("source_tickers")) | F.col("seen")).withColumns({"source_tickers": merged, "updated_at": at}).select(*entities.columns)
    new = rows.where("is_new").join(gathered.select("news_id", "more"), "news_id").withColumn("source_tickers", merge_tickers(F.col("source_tickers"), F.col("more")))
    out = new.unionByName(changed, allowMissingColumns=True).withColumns({"operation": F.lit("upsert"), "available_at": at})
    out = out.withColumn("payload_hash", change_hash(F.col("operation"), F.col("news_id"), F.col("content_hash"), utc_text(F.col("updated_at"))))
    out = numbered(evolved(out, f"{TABLES['news_changes']}, is_new boolean").drop("change_sequence"), "change_sequence", store.next_of("news_changes", "change_sequence"), "news_id", tmp=tmp)
    notes = numbered(seen, "observation_id", store.next_of("news_source_observations", "observation_id"), "pos", tmp=tmp)
    counts = rows.agg(F.count_if("is_new").alias("inserted"), F.count_if(~F.col("is_new")).alias("duplicates")).first().asDict()
    tables = {"news_changes": out, "news_source_observations": notes} | (more(counts) if more else {})
    store.commit(tables, batch, parts=state.with_batch(store, out.drop("is_new"), out.where("is_new").drop("is_new"), notes), stream=stream)
    return counts


def start(spark: SparkSession, landed: str, store_path: str, checkpoint: str, prepare, interval: str | None = None, repeats: str | None = "1 day") -> StreamingQuery:
    """Stream landed JSON records into a store: every ``interval``, or all there is and stop if it is None.

    A record that lands again within ``repeats`` of its first landing is dropped before the store is asked; one that lands
    later is known to the store, so it adds nothing either, and none is too late to be read. ``foreachBatch`` may repeat a
    batch after a failure; the store knows its number and skips it.
    """
    raw = spark.readStream.schema(RECORDS).json(landed)
    if repeats:
        names = raw.columns
        raw = raw.withColumn("_read_at", F.current_timestamp()).withWatermark("_read_at", repeats).dropDuplicatesWithinWatermark(names).select(*names)
    store = Store(spark, store_path)
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest(store, prepare(df), batch=n, stream=checkpoint) and None)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def tail(spark: SparkSession, store_path: str, checkpoint: str, handle, table: str = "news_changes", interval: str | None = None) -> StreamingQuery:
    """Follow a table: ``handle(rows, batch)`` gets the rows of the commits that became visible since the last call.

    The stream is the store's markers, so rows of failed, unfinished or rewritten commits are never read; Structured
    Streaming's own offsets are the reader's checkpoint. A rewrite is passed on as the rows it leaves, and a commit that
    retention has cut meanwhile as what is left of it.
    """

    def read(markers: DataFrame, batch: int) -> None:
        commits = sorted(r["commit"] for r in markers.where(F.array_contains("tables", table)).select("commit").collect())  # new commits alone
        if commits:
            store = Store(spark, store_path)
            if names := [f"c{n}" for n in commits if f"c{n}" in store.parts(table)]:
                handle(store.read(table, names), batch)

    raw = spark.readStream.schema("commit long, batch long, tables array<string>, rewrites array<string>").json(f"{store_path.rstrip('/')}/_commits/*.json")
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(read)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def activity(changes: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Changes a day and operation of a stream or a table, by availability, so that late publications count."""
    return changes.withWatermark("available_at", late).groupBy(F.window("available_at", width), "operation").agg(F.count("*").alias("n"))
