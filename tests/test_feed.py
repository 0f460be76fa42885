"""Sources, store, ingest, streaming, paging, calendar, retention, health and configuration end to end."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, changes, health, retention
from tidemark.operators.store import Store, numbered
from tidemark.plans import paging
from tidemark.sources import calendar_cache, config, feeds
from tidemark.streaming import ingest as stream

NOW = datetime(2026, 7, 15, 12, tzinfo=UTC)


def records(spark, rows):
    full = [(r.get("source", "finnhub/x"), r["title"], r.get("summary"), r["url"], None, r.get("published_at"), r.get("tickers", [])) for r in rows]
    return spark.createDataFrame(full, stream.RECORDS)


def prepared(spark, rows, fetched="2026-07-15T10:00:00Z"):
    df = records(spark, rows).withColumn("_at", F.monotonically_increasing_id())
    return feeds.prepared(df, F.to_timestamp(F.lit(fetched)))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_cross_source_duplicate_merges_tickers(spark, store):
    one = [{"title": "AMD beats", "url": "https://a.example/1", "published_at": "2026-07-15T01:00:00Z", "tickers": ["AMD"]}]
    two = [{"source": "massive/y", "title": "AMD Beats!", "url": "https://b.example/2?utm_source=q", "published_at": "2026-07-15T02:00:00Z", "tickers": ["nvda"]}]
    assert stream.ingest(store, prepared(spark, one), NOW) == {"inserted": 1, "duplicates": 0}
    assert stream.ingest(store, prepared(spark, two), NOW + timedelta(seconds=1)) == {"inserted": 0, "duplicates": 1}
    log = store.read("news_changes").orderBy("change_sequence").collect()
    assert [(r.change_sequence, r.news_id, r.source_tickers) for r in log] == [(1, 1, ["AMD"]), (2, 1, ["AMD", "NVDA"])]
    assert store.read("news_source_observations").count() == 2
    page = paging.news_changes(store.read("news_changes"), store.read("news_source_observations"), NOW + timedelta(minutes=1))
    assert [(i["sequence"], i["news"]["sources"]) for i in page["items"]] == [(1, ["finnhub/x"]), (2, ["finnhub/x", "massive/y"])]  # the first keeps what was known then
    assert page["next_after_sequence"] == 2 and not page["has_more"]
    assert stream.ingest(store, prepared(spark, two), NOW + timedelta(seconds=2)) == {"inserted": 0, "duplicates": 1}
    assert store.read("news_changes").count() == 2  # nothing new was said
    assert paging.news_item(store.read("news_changes"), store.read("news_source_observations"), 1, NOW + timedelta(minutes=1))["source_count"] == 2


def test_similar_titles_within_and_across_batches(spark, store):
    title = "Central bank holds its main interest rate steady at 5 percent after long debate today"
    rows = [{"title": title, "url": "https://a.example/1", "published_at": "2026-07-15T01:00:00Z"}, {"title": title.replace("today", "Today,"), "url": "https://a.example/2", "published_at": "2026-07-15T03:00:00Z"}, {"title": title.replace("5", "6"), "url": "https://a.example/3", "published_at": "2026-07-15T03:00:00Z"}]
    assert stream.ingest(store, prepared(spark, rows), NOW) == {"inserted": 2, "duplicates": 1}
    again = [{"title": title.replace("holds", "holding"), "url": "https://a.example/9", "published_at": "2026-07-15T09:00:00Z"}]
    assert stream.ingest(store, prepared(spark, again), NOW + timedelta(seconds=1))["duplicates"] == 1


def test_replayed_batch_adds_nothing(spark, store):
    rows = [{"title": "T", "url": "https://a.example/1"}]
    assert stream.ingest(store, prepared(spark, rows), NOW, batch=7)["inserted"] == 1
    assert stream.ingest(store, prepared(spark, rows), NOW, batch=7) == {"inserted": 0, "duplicates": 0}
    old = Store(spark, store.path, version=0)
    assert old.read("news_changes").count() == 0 and Store(spark, store.path).read("news_changes").count() == 1


def test_required_fields(spark):
    with pytest.raises(Exception, match="source, title, and url are required"):
        prepared(spark, [{"title": " ", "url": "https://a.example"}]).collect()
    row = prepared(spark, [{"title": "T", "url": "u", "published_at": "sometime yesterday"}]).first()
    assert row.published_at is None


def test_stream(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    rows = [{"source": "gnews/a", "title": f"Story number {i} about thing {i}", "url": f"https://a.example/{i}", "published_at": "2026-07-15T01:00:00Z", "source_tickers": ["A"]} for i in range(4)]
    (landed / "one.json").write_text("\n".join(map(json.dumps, rows)))
    run = lambda: stream.start(spark, str(landed), str(tmp_path / "s"), str(tmp_path / "c"), lambda df: feeds.prepared(df, F.to_timestamp(F.lit("2026-07-15T10:00:00Z")))).awaitTermination(120)
    run()
    (landed / "two.json").write_text(json.dumps(rows[0] | {"source": "newsapi/b"}))
    run()
    log = Store(spark, str(tmp_path / "s")).read("news_changes")
    assert log.count() == 5 and log.select("news_id").distinct().count() == 4
    tailed = []
    follow = lambda: stream.tail(spark, str(tmp_path / "s"), str(tmp_path / "t"), lambda rows, _: tailed.extend(rows.collect())).awaitTermination(60)
    follow()
    assert len(tailed) == 5
    log.limit(3).write.parquet(str(tmp_path / "s" / "news_changes" / "commit=9"))  # a commit that failed before its marker
    follow()
    assert len(tailed) == 5
    Store(spark, str(tmp_path / "s")).commit({"news_changes": log.limit(2)})
    follow()
    assert len(tailed) == 7
    assert stream.activity(log).agg(F.sum("n")).first()[0] == 5


def _log(spark, n, size=10):
    rows = [(i, i, "upsert", "s", "t" * size, None, f"u{i}", None, None, NOW, [], f"h{i}", NOW, NOW + timedelta(microseconds=100 * i), "p") for i in range(1, n + 1)]
    from tidemark.operators.schema import CHANGES, OBSERVATIONS

    return spark.createDataFrame(rows, CHANGES), spark.createDataFrame([], OBSERVATIONS)


def test_pages_follow_a_frozen_watermark(spark):
    log, seen = _log(spark, 7)
    later = NOW + timedelta(seconds=1)
    first = paging.news_changes(log.where("change_sequence <= 6"), seen, later, limit=4)
    assert [i["sequence"] for i in first["items"]] == [1, 2, 3, 4] and first["has_more"] and first["next_after_sequence"] is None
    second = paging.news_changes(log, seen, later, limit=4, cursor=first["next_cursor"])
    assert [i["sequence"] for i in second["items"]] == [5, 6] and second["next_after_sequence"] == 6
    third = paging.news_changes(log, seen, later, checkpoint=6)
    assert [i["sequence"] for i in third["items"]] == [7]
    for kind, more, status in (("cursor_filter_mismatch", {"cursor": first["next_cursor"], "as_of": "2026-07-15T12:00:00Z"}, 400), ("invalid_cursor", {"cursor": first["next_cursor"][:-4]}, 400), ("checkpoint_ahead", {"checkpoint": 99}, 409), ("invalid_updated_after", {"after": "2026-07-15"}, 422), ("future_as_of", {"as_of": "2027-01-01T00:00:00Z"}, 422), ("invalid_time_window", {"after": "2026-07-15T12:00:00Z", "as_of": "2026-07-14T12:00:00Z"}, 422)):
        with pytest.raises(paging.PageError, match=kind) as e:
            paging.news_changes(log, seen, later, **more)
        assert e.value.status == status
    window = paging.news_changes(log, seen, later, after="2026-07-15T12:00:00.000100Z", as_of="2026-07-15T12:00:00.000300Z")
    assert [i["sequence"] for i in window["items"]] == [2, 3]


def test_pages_keep_a_byte_bound(spark):
    log, seen = _log(spark, 9, size=4000)
    page = paging.news_changes(log, seen, NOW + timedelta(seconds=1), limit=9, most_bytes=20_000)
    assert 3 <= len(page["items"]) <= 5 and page["has_more"]
    rest = paging.news_changes(log, seen, NOW + timedelta(seconds=1), limit=9, cursor=page["next_cursor"])
    assert [i["sequence"] for i in page["items"] + rest["items"]] == list(range(1, 10))
    with pytest.raises(paging.PageError, match="413"):
        paging.news_changes(log, seen, NOW + timedelta(seconds=1), most_bytes=1000)


RAW = [
    ("2026-07-15T08:30:00-04:00", "CPI", "usd", "High", "2.5%", "", ""), ("2026-07-15T01:00:00+00:00", "Talk", "EUR", "low", "", "", ""), ("2026-07-14T01:00:00+00:00", "Holiday", "JPY", "Holiday", "", "", "x"),
    ("2026-07-16T01:00:00+00:00", "Rate", "NZD", "high", "", "", "1"), ("", "No date", "USD", "high", "", "", ""), (None, None, None, None, None, None, None),
]


def test_calendar(spark, tmp_path):
    events = calendar.normalized(spark.createDataFrame(RAW, calendar_cache.EVENT))
    rows = {r.title: r for r in events.collect()}
    assert set(rows) == {"CPI", "Holiday"} and rows["CPI"].country == "🇺🇸 美国" and rows["CPI"].impact_zh == "高"
    detail = calendar.snapshot_events(events).orderBy("ordinal").collect()
    assert [(d.ordinal, d.title, d.actual) for d in detail] == [(1, "Holiday", "x"), (2, "CPI", None)]
    at = lambda t: F.to_timestamp(F.lit(t))
    head = lambda fetched, stale: calendar.snapshot_header(calendar.snapshot_events(events), at(fetched), F.lit(stale), at("2026-07-15T00:00:00Z")).first()
    a, b, c = head("2026-07-15T01:00:00Z", True), head("2026-07-15T01:00:00Z", True), head("2026-07-15T02:00:00Z", False)
    assert a.snapshot_token == b.snapshot_token != c.snapshot_token and a.payload_hash == c.payload_hash and len(a.snapshot_token) == 44
    assert c.available_at == c.source_fetched_at  # never before the fetch
    path = str(tmp_path / "cache.json")
    calendar_cache.write(path, [{"date": "2026-07-15T01:00:00Z", "title": "X"}], "2026-07-15T01:00:00Z")
    row = calendar_cache.read(spark, path).first()
    assert row.title == "X" and row.fetched_at is not None
    (tmp_path / "old.json").write_text('[{"title": "Y"}]')
    assert calendar_cache.read(spark, str(tmp_path / "old.json")).first().title == "Y"


def test_calendar_pages(spark):
    from tidemark.operators.schema import CALENDAR, SNAPSHOTS

    snaps = spark.createDataFrame([(i, f"cal_{i}", "s", NOW, NOW, False, NOW + timedelta(hours=i), "p") for i in (1, 2)], SNAPSHOTS)
    events = spark.createDataFrame([(s, o, f"e{o}", "USD", "U", "t", "high", "h", "x", NOW, None, None, None, "c") for s in (1, 2) for o in range(1, 6)], CALENDAR)
    later = NOW + timedelta(hours=3)
    page = paging.calendar_page(snaps, events, later, limit=3)
    assert page["snapshot_token"] == "cal_2" and [i["ordinal"] for i in page["items"]] == [1, 2, 3]
    rest = paging.calendar_page(snaps, events, later, limit=3, cursor=page["next_cursor"])
    assert [i["ordinal"] for i in rest["items"]] == [4, 5] and rest["next_after_sequence"] == 2
    assert paging.calendar_page(snaps, events, later, checkpoint=2)["items"] == []
    with pytest.raises(paging.PageError, match="snapshot_expired"):
        paging.calendar_page(snaps.where("snapshot_sequence = 1"), events, later, cursor=page["next_cursor"])
    assert paging.calendar_page(snaps.limit(0), events, later)["items"] == []


def test_retention(spark):
    at = lambda t: datetime.fromisoformat(t).replace(tzinfo=UTC)
    entities = spark.createDataFrame([(1, at("2020-01-01")), (2, at("2020-01-02")), (3, at("2026-07-14")), (4, None)], "news_id long, effective_at timestamp")
    log = spark.createDataFrame([(1, 1, at("2020-01-01")), (2, 1, at("2020-02-01")), (3, 3, at("2026-07-14"))], "change_sequence long, news_id long, available_at timestamp")
    snaps = spark.createDataFrame([(1, at("2020-01-01")), (2, at("2020-01-02"))], "snapshot_sequence long, available_at timestamp")
    legacy = spark.createDataFrame([(2,), (None,)], "ref long")
    gone = retention.candidates(entities, F.lit(NOW - timedelta(days=365)), [(legacy, "ref")])
    assert [r.news_id for r in gone.collect()] == [1]
    assert sorted(r.change_sequence for r in changes.compacted(log, F.lit(NOW - timedelta(days=365))).collect()) == [2, 3]
    assert [r.snapshot_sequence for r in retention.kept_snapshots(snaps, F.lit(NOW - timedelta(days=90))).collect()] == [2]
    assert retention.cascaded(log, "news_id", gone, "news_id").count() == 1


def test_health(spark):
    from tidemark.operators.schema import HEALTH

    row = lambda s, v, ok, through: (s, "ok", NOW, NOW if ok else None, through, 0, None, 1, 1, 0, None, NOW, v)
    log = spark.createDataFrame([row("a", 1, True, NOW), row("a", 2, True, NOW + timedelta(hours=1)), row("b", 1, False, None)], HEALTH)
    attempts = spark.createDataFrame([("a", NOW, "x"), ("b", NOW, "x"), ("c", NOW, "x")], "source string, attempted_at timestamp, error_code string")
    got = {r.source: (r.status, r.consecutive_failures, r.version) for r in health.after_failure(log, attempts).collect()}
    assert got == {"a": ("degraded", 1, 3), "b": ("unavailable", 1, 2), "c": ("unavailable", 1, 1)}
    assert health.data_through(log).first()[0] == (NOW + timedelta(hours=1)).replace(tzinfo=None)
    assert health.trigger_seconds(300) == {"jitter": 30, "misfire": 300}
    registry = spark.createDataFrame([("a", True, True), ("z", False, True)], "source string, enabled boolean, configured boolean")
    assert {r.source: r.consecutive_failures for r in health.source_snapshot(registry, log).collect()} == {"a": 0, "z": 0}
    assert health.clamped(log.withColumn("raw_count", F.lit(-5).cast("long"))).first().raw_count == 0


def test_feeds(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"headline": "H &amp; M", "url": "https://a.example", "datetime": 1752570000, "related": "aapl, ,msft", "source": "CNBC"}, {"headline": "", "url": "x"}]))
    row = feeds.finnhub(feeds.read_json(spark, str(tmp_path / "f.json"), "finnhub")).collect()
    assert [(r.source, r.title, r.published_at, r.source_tickers) for r in row] == [("finnhub/CNBC", "H & M", "2025-07-15T09:00:00Z", ["AAPL", "MSFT"])]
    (tmp_path / "m.json").write_text(json.dumps([{"title": "T", "article_url": "u", "published_utc": "2025-07-15T09:00:00", "publisher": {"name": "P"}, "tickers": ["a", "b"], "description": "d" * 600}]))
    row = feeds.massive(feeds.read_json(spark, str(tmp_path / "m.json"), "massive")).first()
    assert (row.source, row.published_at, len(row.summary), row.source_tickers) == ("massive/P", "2025-07-15T09:00:00Z", 500, ["A", "B"])
    (tmp_path / "n.json").write_text(json.dumps([{"title": "[Removed]", "url": "u"}, {"title": "T", "url": "u", "source": {"name": ""}}]))
    assert [r.source for r in feeds.newsapi(feeds.read_json(spark, str(tmp_path / "n.json"), "newsapi"), "Label").collect()] == ["newsapi/Label"]
    assert [r.source for r in feeds.gnews(feeds.read_json(spark, str(tmp_path / "n.json"), "gnews"), "G").collect()] == ["gnews/G", "gnews/G"]
    items = "".join(f"<item><title>Story {i % 40} - more - Reuters</title><link>https://a.example/{i}</link><pubDate>Tue, 15 Jul 2025 10:00:00 +0200</pubDate><source url='x'>Reuters</source><category domain='x/symbol'>aapl</category><category domain='y'>no</category></item>" for i in range(45))
    (tmp_path / "g.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, source struct<_url:string,_VALUE:string>, category array<struct<_domain:string,_VALUE:string>>").load(str(tmp_path / "g.xml"))
    raw = raw.withColumns({"source": F.col("source._VALUE"), "_feed": F.lit("g"), "_at": F.monotonically_increasing_id()})
    google = feeds.first_seen(feeds.google(feeds.capped(raw)), "title")
    rows = google.collect()
    assert len(rows) == 30 and rows[0].title.endswith(" - more") and rows[0].published_at == "2025-07-15T10:00:00Z" and rows[0].source == "google/Reuters"
    sa = feeds.seekingalpha(raw, "daily").first()
    assert (sa.source, sa.summary, sa.published_at, sa.source_tickers) == ("seekingalpha/daily", "[AAPL]", "2025-07-15T08:00:00Z", ["AAPL"])
    both = feeds.union([feeds.google(raw), feeds.seekingalpha(raw)])
    assert both.count() == 90


TOML = """
[storage]
database_path = "data"
news_retention_days = 0
change_retention_days = 365
calendar_snapshot_retention_days = 90
retention_interval_seconds = 3600
[calendar]
interval_seconds = 600
"""


def test_config(tmp_path):
    sources = "".join(f'[sources.{n}]\nenabled = true\ninterval_seconds = 300\napi_key_env = "KEY"\n' for n in feeds.REGISTRY)
    good = tmp_path / "c.toml"
    good.write_text(TOML + sources)
    s = config.load_settings(str(good), {"KEY": " k "})
    assert s.news_days == 0 and s.sources["finnhub"].api_key == "k" and s.sources["google"].configured
    assert not config.load_settings(str(good), {}).sources["finnhub"].configured
    for bad in (TOML, TOML + sources + "[other]\n", TOML.replace("600", "true") + sources, TOML + sources.replace("enabled = true", 'enabled = "x"', 1), TOML + sources + "x = 1\n"):
        good.write_text(bad)
        with pytest.raises(config.ConfigurationError):
            config.load_settings(str(good), {})


def test_numbers_are_consecutive(spark):
    rows = numbered(spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7), "n", 5, "k").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(5, 1005)) and [r.k for r in rows] == sorted(r.k for r in rows)


def test_evidence_is_bounded_by_each_change(spark):
    log = spark.createDataFrame([(1, 9, NOW), (2, 9, NOW + timedelta(hours=2))], "change_sequence long, news_id long, available_at timestamp")
    seen = spark.createDataFrame([(1, 9, "B", NOW), (2, 9, "a", NOW), (3, 9, "b", NOW + timedelta(hours=1)), (4, 9, "c", NOW + timedelta(hours=1))], "observation_id long, canonical_news_id long, source string, observed_at timestamp")
    got = {r.change_sequence: r.sources for r in changes.source_evidence(log, seen).collect()}
    assert got == {1: ["B", "a"], 2: ["B", "a", "c"]}
