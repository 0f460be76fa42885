"""Economic calendar: normalised events, immutable snapshots, frozen pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import calendar_event_id, ordered_digest, snapshot_token
from tidemark.functions.times import parse_utc, utc_text
from tidemark.operators import health
from tidemark.operators.schema import HEALTH
from tidemark.operators.store import Store, numbered
from tidemark.scratch import Scratch
from tidemark.sources import calendar_cache

#: Labels of currencies and impacts, and the currencies that are kept.
COUNTRIES = {"USD": "🇺🇸 美国", "EUR": "🇪🇺 欧元区", "GBP": "🇬🇧 英国", "JPY": "🇯🇵 日本", "CNY": "🇨🇳 中国", "AUD": "🇦🇺 澳大利亚", "CAD": "🇨🇦 加拿大", "CHF": "🇨🇭 瑞士", "NZD": "🇳🇿 新西兰"}
IMPACTS = {"high": "高", "medium": "中", "low": "低", "holiday": "假日"}
#: Seconds that a fresh snapshot need not be polled again.
TTL = 600
MAJORS = ("USD", "EUR", "GBP", "JPY", "CNY", "AUD", "CAD", "CHF")


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, the code itself where it has none."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def normalized(raw: DataFrame) -> DataFrame:
    """Events of ``raw(date, title, country, impact, forecast, previous, actual)`` worth keeping, by date text:
    of major currencies, and of high or medium impact or with an actual value."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    code, impact = F.upper(text("country")), F.lower(text("impact"))
    rows = raw.select(
        F.trim(text("date")).alias("date"), F.trim(text("title")).alias("title"), code.alias("country_code"), label(code, COUNTRIES).alias("country"),
        impact.alias("impact"), label(impact, IMPACTS).alias("impact_zh"), text("forecast").alias("forecast"), text("previous").alias("previous"), text("actual").alias("actual"),
    )
    return rows.where((F.col("date") != "") & (F.col("title") != "") & F.col("country_code").isin(*MAJORS) & (F.col("impact").isin("high", "medium") | (F.col("actual") != "")))


def snapshot_events(events: DataFrame, by: tuple[str, ...] = (), tmp: Scratch | None = None) -> DataFrame:
    """Detail rows: valid events with ids, UTC times, content hashes and ordinals by time, then id.

    ``by`` are columns that tell several snapshots apart; a snapshot is one week of events from one payload, so one
    window holds no more than that. One snapshot of any size is numbered by ranges, with a table in ``tmp``.
    """
    impact = F.lower(F.coalesce(F.nullif("impact", F.lit("")), F.lit("low")))
    rows = events.select(
        *by, calendar_event_id(F.col("date"), F.col("country_code"), F.col("title")).alias("event_id"), F.upper("country_code").alias("country_code"), F.coalesce("country", "country_code").alias("country"),
        F.substring(F.trim("title"), 1, 4_000).alias("title"), impact.alias("impact"), F.coalesce(F.nullif("impact_zh", F.lit("")), impact).alias("impact_zh"), F.trim("date").alias("scheduled_at"),
        parse_utc(F.trim("date")).alias("scheduled_at_utc"), *[F.nullif(c, F.lit("")).alias(c) for c in ("forecast", "previous", "actual")],
    )
    rows = rows.where((F.length("country_code") == 3) & (F.col("title") != "") & (F.col("scheduled_at") != "") & F.col("impact").isin(*IMPACTS))
    wire = F.struct("actual", "country", "country_code", "event_id", "forecast", "impact", "impact_zh", "previous", "scheduled_at", utc_text(F.col("scheduled_at_utc")).alias("scheduled_at_utc"), "title")
    rows = rows.withColumn("content_hash", F.sha2(F.to_json(wire, {"ignoreNullFields": "false"}), 256))
    if tmp is not None and not by:
        return numbered(rows, "ordinal", 1, "scheduled_at_utc", "event_id", tmp=tmp)
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy("scheduled_at_utc", "event_id")).cast("long"))


def snapshot_header(detail: DataFrame, fetched: Column, stale: Column, observed: Column, source: str = "calendar") -> DataFrame:
    """The snapshot's header: payload hash over its ordered events, and a token of fetch time, staleness and payload.

    The same stale payload has the same token; a fresh fetch has a new one even where nothing changed.
    """
    head = ordered_digest(detail, "ordinal", "content_hash").withColumnRenamed("digest", "payload_hash")
    return head.select(
        snapshot_token(utc_text(fetched), stale, F.col("payload_hash")).alias("snapshot_token"), F.lit(source).alias("source"), fetched.alias("source_fetched_at"),
        fetched.alias("data_through"), stale.alias("is_stale"), F.greatest(observed, fetched).alias("available_at"), "payload_hash",
    )


def recorded(fetches: DataFrame, order: str, first: int = 1, known: DataFrame | None = None, tmp: Scratch | None = None) -> DataFrame:
    """``fetches(snapshot_token, ...)`` with snapshot_sequence and ``reused``: a token's first fetch makes a snapshot,
    numbered from ``first`` by ``order``; later ones, and those of a ``known(snapshot_token, snapshot_sequence)``, reuse it."""
    opened = fetches.groupBy("snapshot_token").agg(F.min(order).alias("_opened"))
    if known is not None:
        opened = opened.join(known.select("snapshot_token"), "snapshot_token", "left_anti")
    named = numbered(opened, "snapshot_sequence", first, "_opened", tmp=tmp)
    if known is not None:
        named = named.unionByName(known.select("snapshot_token", "snapshot_sequence"), allowMissingColumns=True)
    out = fetches.join(named, "snapshot_token")
    return out.withColumn("reused", ~F.col(order).eqNullSafe(F.col("_opened"))).drop("_opened")


def record_snapshot(store: Store, events: DataFrame, fetched: datetime, stale: bool, observed: datetime, source: str = "calendar", state: DataFrame | None = None) -> tuple[str, int]:
    """(token, sequence) of the snapshot of normalised ``events``: a new one, or the one that has the token already.

    Header, events and the health rows ``state`` become visible in one commit; a reused snapshot commits ``state`` alone.
    """
    with Scratch(store.spark, "snapshot") as tmp:
        detail = snapshot_events(events, tmp=tmp)
        head = tmp.written(snapshot_header(detail, F.lit(fetched), F.lit(stale), F.lit(observed), source), "head")
        known = store.read("calendar_snapshots").join(head.select("snapshot_token"), "snapshot_token", "left_semi")
        named = recorded(head, "available_at", store.next_of("calendar_snapshots", "snapshot_sequence"), known, tmp)
        row = named.select("snapshot_token", "snapshot_sequence", "reused").first()
        more = {} if state is None else {"source_health": state}
        if not row["reused"]:
            more |= {"calendar_snapshots": named, "calendar_events": detail.withColumn("snapshot_sequence", F.lit(row["snapshot_sequence"]).cast("long"))}
        if more:
            store.commit(more)
        return row["snapshot_token"], row["snapshot_sequence"]


def cached_enough(store: Store, now: datetime, ttl: int = TTL, retry: int = health.STALE_RETRY, source: str = "calendar") -> tuple[str, int] | None:
    """(token, sequence) of the newest snapshot while it need not be polled again: ``ttl`` seconds after a fresh one,
    ``retry`` after a stale one; None where a poll is due."""
    last = latest_snapshot(store.read("calendar_snapshots").where(F.col("source") == source), F.lit(now), F.lit(now)).first()
    if last is None:
        return None
    polled = health.latest(store.read("source_health").where(F.col("source") == source)).select(F.unix_micros("updated_at").alias("at"), "status").first()
    age = int(now.timestamp() * 1_000_000) - polled["at"] if polled is not None else None
    return (last["snapshot_token"], last["snapshot_sequence"]) if age is not None and age < (ttl if polled["status"] == "ok" else retry) * 1_000_000 else None


def refresh(store: Store, attempted: datetime, observed: datetime, fresh: DataFrame | None = None, fetched: datetime | None = None, cached: DataFrame | None = None, error: str = "calendar_fetch_failed", source: str = "calendar", cache_path: str | None = None) -> tuple[str, int] | None:
    """A poll's outcome as snapshot and health in one commit: the ``fresh`` raw events, or where they are None, hold none or
    do not normalise, the ``cached`` ones (calendar_cache.read) as a stale snapshot, if they are no older than health.STALE_DAYS.

    A stale refresh keeps the last success and what the data reaches, counts a failure and asks for another try soon. With
    no usable copy either, or one that does not normalise, the failure alone is recorded, and None is returned. Once a fresh
    snapshot is committed, its raw events replace the copy at ``cache_path``.
    """
    spark, events, raw = store.spark, None, fresh
    if fresh is not None:
        events, error = _readable(fresh, error)
    stale = events is None
    if stale:
        at = cached.agg(F.max(F.when(health.usable_cache(F.col("fetched_at"), F.lit(observed)), F.unix_micros("fetched_at"))).alias("at")).first()["at"] if cached is not None else None
        if at is not None:
            fetched = datetime.fromtimestamp(0, attempted.tzinfo) + timedelta(microseconds=at)
            events, error = _readable(cached, error, kept=error)
        if events is None:
            failed = spark.createDataFrame([(source, attempted, error)], "source string, attempted_at timestamp, error_code string")
            store.commit({"source_health": health.after_failure(store.read("source_health"), failed)})
            return None
    prior = health.latest(store.read("source_health").where(F.col("source") == source)).first()
    kept = lambda name: prior[name] if prior is not None and prior[name] is not None else fetched
    failures = (prior["consecutive_failures"] or 0) + 1 if prior is not None else 1
    row = (source, "degraded" if stale else "ok", attempted, kept("last_success_at") if stale else fetched, kept("data_through") if stale else fetched, failures if stale else 0, observed + timedelta(seconds=health.STALE_RETRY) if stale else None, 0 if stale else events.count(), None, None, error if stale else None, observed, None)
    state = health.versioned(store.read("source_health"), spark.createDataFrame([row], HEALTH))
    found = record_snapshot(store, events, fetched, stale, observed, source, state)
    if cache_path and not stale:
        calendar_cache.write(cache_path, [r.asDict() for r in raw.select("date", "title", "country", "impact", "forecast", "previous", "actual").collect()], fetched.isoformat())  # one week's events
    return found


def _readable(raw: DataFrame, error: str, kept: str | None = None) -> tuple[DataFrame | None, str]:
    """The normalised events of ``raw``, or None and ``calendar_parse_failed`` where there is no event at all, columns are missing,
    or a kept event has no time that can be read."""
    try:
        events = normalized(raw)
        bad = raw.isEmpty() or not events.where(parse_utc(F.col("date")).isNull()).isEmpty()
    except AnalysisException:
        bad = True
    return (None, "calendar_parse_failed") if bad else (events, kept or error)


def latest_snapshot(snapshots: DataFrame, as_of: Column, after: Column) -> DataFrame:
    """The last snapshot available at ``as_of``, and whether it came after ``after``; no row if there is none."""
    seen = snapshots.where(F.col("available_at") <= as_of)
    names = [F.col(c) for c in seen.columns]
    last = seen.agg(F.max_by(F.struct(*names), "snapshot_sequence").alias("r")).where("r IS NOT NULL").select("r.*")
    return last.withColumn("has_changes", F.col("available_at") > after)


def event_page(events: DataFrame, sequence: int, after_ordinal: int, limit: int) -> DataFrame:
    """One page of a snapshot, pinned by its sequence, with one row more to tell that it goes on."""
    return events.where((F.col("snapshot_sequence") == sequence) & (F.col("ordinal") > after_ordinal)).orderBy("ordinal").limit(limit + 1)


def wire_items(events: DataFrame, is_stale: Column, fetched: Column, available: Column) -> DataFrame:
    """Events as a page shows them: UTC texts, nulls where nothing was said, and their snapshot's age on each of them."""
    return events.select(
        "event_id", "country_code", "country", "title", "impact", "impact_zh", "scheduled_at", utc_text(F.col("scheduled_at_utc")).alias("scheduled_at_utc"), "forecast", "previous", "actual",
        is_stale.cast("boolean").alias("is_stale"), utc_text(fetched).alias("source_fetched_at"), utc_text(available).alias("available_at"), "ordinal",
    )


def includes_items(has_changes: bool, sequence: int, checkpoint: int | None) -> bool:
    return sequence > checkpoint if checkpoint is not None else has_changes
