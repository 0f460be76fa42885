"""Calendar polls with their fallback, snapshots that are reused, health of runs, batch dedup, messages of errors, older rows."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_dedup import SCHEMA, similar
from tidemark.functions import text
from tidemark.operators import calendar, dedup, health, schema
from tidemark.operators.store import Store
from tidemark.sources import calendar_cache

NOW = datetime(2026, 7, 15, 12, tzinfo=UTC)
RAW = [("2026-07-15T08:30:00-04:00", "CPI", "usd", "High", "2.5%", "", ""), ("2026-07-16T08:30:00-04:00", "Jobs", "USD", "high", "", "", "1")]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def state(store):
    return health.latest(store.read("source_health")).first()


def test_polls(spark, store):
    raw = spark.createDataFrame(RAW, calendar_cache.EVENT)
    cached = lambda at: raw.withColumn("fetched_at", F.lit(at))
    at = lambda m: NOW + timedelta(minutes=m)
    assert calendar.refresh(store, at(0), at(0)) is None and store.read("calendar_snapshots").count() == 0
    assert (state(store).status, state(store).consecutive_failures, state(store).version) == ("unavailable", 1, 1)
    first = calendar.refresh(store, at(1), at(1), raw, at(1))
    assert first[1] == 1 and (state(store).status, state(store).consecutive_failures, state(store).raw_count, state(store).version) == ("ok", 0, 2, 2)
    stale = calendar.refresh(store, at(2), at(2), cached=cached(at(1)))
    again = calendar.refresh(store, at(3), at(3), cached=cached(at(1)))
    assert stale == again and stale[1] == 2  # the same stale copy is one snapshot
    last = state(store)
    assert (last.status, last.consecutive_failures, last.raw_count, last.error_code) == ("degraded", 2, 0, "calendar_fetch_failed")
    assert last.last_success_at == at(1).replace(tzinfo=None) == last.data_through and last.next_attempt_at == at(8).replace(tzinfo=None)
    fresh = calendar.refresh(store, at(4), at(4), raw, at(4))
    assert fresh[1] == 3 and fresh[0] != first[0]  # a new fetch is news even where nothing changed
    assert calendar.refresh(store, at(5), NOW + timedelta(days=9), cached=cached(at(1))) is None  # too old
    assert store.read("calendar_snapshots").count() == 3 and store.read("calendar_events").count() == 6
    assert len(store.commits()) == 6  # one a poll


def test_recorded_against_known(spark):
    fetches = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "snapshot_token string, at long")
    known = spark.createDataFrame([("a", 7)], "snapshot_token string, snapshot_sequence long")
    got = {r.at: (r.snapshot_sequence, r.reused) for r in calendar.recorded(fetches, "at", 8, known).collect()}
    assert got == {1: (8, False), 2: (7, True), 3: (8, True), 4: (9, False)}


def test_runs(spark):
    """What the data reaches moves only once rows are stored; failures defer the next attempt."""
    run = lambda **more: {"source": "a", "enabled": True, "configured": True, "forced": False, "interval_seconds": 300, "spread": 1.0, "attempted_at": NOW, "fetched_at": NOW, "fetch_ok": True, "persisted": True, "raw_count": 9, "inserted_count": 5, "duplicates_count": 4} | more
    kinds = "source string, enabled boolean, configured boolean, forced boolean, interval_seconds int, spread double, attempted_at timestamp, fetched_at timestamp, fetch_ok boolean, persisted boolean, raw_count long, inserted_count long, duplicates_count long"
    log, seen = spark.createDataFrame([], schema.HEALTH), []
    for n, more in enumerate([{}, {"persisted": False}, {"fetch_ok": False}, {}, {"forced": True, "fetch_ok": False}, {"enabled": False}, {"attempted_at": NOW + timedelta(days=1), "fetched_at": NOW + timedelta(days=1)}]):
        at = {"attempted_at": NOW + timedelta(seconds=n), "fetched_at": NOW + timedelta(seconds=n)}
        rows = health.after_runs(log, spark.createDataFrame([tuple(run(**at | more).values())], kinds))
        r = rows.first()
        through = (r.data_through - NOW.replace(tzinfo=None)).total_seconds() if r.data_through else None
        seen.append((r.outcome, r.status, through, r.consecutive_failures, r.inserted_count, r.version))
        log = spark.createDataFrame(log.collect() + rows.drop("outcome").select(*log.columns).collect(), schema.HEALTH)
    assert seen == [("ok", "ok", 0, 0, 5, 1), ("degraded", "degraded", 0, 0, 0, 2), ("error", "degraded", 0, 1, 0, 3), ("backoff", "degraded", 0, 1, 0, 4), ("error", "degraded", 0, 2, 0, 5), ("disabled", "disabled", 0, 2, 0, 6), ("ok", "ok", 86400, 0, 5, 7)]


def test_batch_without_hashes(spark):
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(5, 10))] for _ in range(8)]
    rows = []
    for pos in range(90):
        words = list(rng.choice(bases))
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((pos, "same", "same", f"u{rng.randrange(70)}" if rng.random() < 0.8 else "", f"d{rng.randrange(2)}", " ".join(words) if rng.random() < 0.9 else ""))
    urls, titles, kept = set(), {}, set()
    for pos, _, _, url, day, title in rows:
        if url in urls or title and any(similar(title, t) for t in titles.get(day, [])):
            continue
        kept.add(pos)
        if url:
            urls.add(url)
        if title:
            titles.setdefault(day, []).append(title)
    got = dedup.url_or_title_batch(spark.createDataFrame(rows, SCHEMA))
    assert {r.pos for r in got.collect() if r.pos == r.canonical} == kept


def test_messages(spark):
    rows = [("HTTPStatusError", "m", 503, "https://u:p@a.example/x?key=1"), ("ConnectError", "m", None, "https://a.example/x?token=2#f"), ("ValueError", "token=abc, and key k1", None, None)]
    df = spark.createDataFrame(rows, "kind string, message string, status int, url string")
    got = [r.m for r in df.select(text.safe_message(F.col("kind"), F.col("message"), F.col("status"), F.col("url"), ("k1",)).alias("m")).collect()]
    assert got == ["HTTP 503 at https://a.example/x", "ConnectError at https://a.example/x", "ValueError: token=[REDACTED], and key [REDACTED]"]


def test_older_rows(spark):
    row = schema.migrated(spark.createDataFrame([(1, "T", NOW)], "news_id long, title string, fetched_at timestamp")).first()
    assert row.source_tickers == [] and row.updated_at == row.fetched_at == NOW.replace(tzinfo=None) and row.summary is None
