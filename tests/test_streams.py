"""Deadlines with a manual clock, repeated landings, and the data source of landed polls."""

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health, schema
from tidemark.operators.store import Store
from tidemark.sources import feeds, landed
from tidemark.streaming import ingest as stream
from tidemark.streaming import schedule

T0 = datetime(2026, 7, 15, 12, tzinfo=UTC)


@pytest.fixture
def clock(spark, tmp_path):
    """Land rows (source, kind, interval, seconds since T0) and run the stream over them; the runs that it starts."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schedule.use_timers(spark)
    folder, step = tmp_path / "events", [0]
    folder.mkdir()

    def run(*rows):
        step[0] += 1
        lines = [json.dumps({"source": s, "kind": k, "interval_seconds": i, "at": (T0 + timedelta(seconds=t)).isoformat()}) for s, k, i, t in rows]
        (folder / f"{step[0]:04}.json").write_text("\n".join(lines))
        started = []
        events = spark.readStream.schema(schedule.EVENT).json(str(folder))
        query = schedule.due_runs(events, event_time=True, even=True).writeStream.foreachBatch(lambda df, _: started.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        seconds = lambda t: round((t.replace(tzinfo=UTC) if t.tzinfo is None else t).timestamp() - T0.timestamp())
        return sorted((r.source, seconds(r.due_at), r.merged) for r in started)

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_deadlines(spark, clock):
    assert clock(("a", "plan", 300, 0), ("b", "plan", 1000, 0)) == []
    assert clock(("clock", "tick", None, 200)) == []
    assert clock(("clock", "tick", None, 310)) == [("a", 300, 0)]
    assert clock(("clock", "tick", None, 700)) == []  # a run is in flight
    assert clock(("a", "ok", None, 710), ("clock", "tick", None, 920)) == [("a", 900, 0)]
    assert clock(("a", "failed", None, 930), ("clock", "tick", None, 1010)) == [("b", 1000, 0)]
    # One failure: held for 600 seconds, as health.after_runs says; the deadline in between starts nothing.
    kinds = "source string, enabled boolean, configured boolean, forced boolean, interval_seconds int, spread double, attempted_at timestamp, fetched_at timestamp, fetch_ok boolean, persisted boolean, raw_count long, inserted_count long, duplicates_count long"
    at = T0 + timedelta(seconds=930)
    row = health.after_runs(spark.createDataFrame([], schema.HEALTH), spark.createDataFrame([("a", True, True, False, 300, 1.0, at, at, False, True, 0, 0, 0)], kinds)).first()
    held = (row.next_attempt_at - at.replace(tzinfo=None)).total_seconds()
    assert held == health.delay(300, 1, 1.0) == 600
    assert clock(("clock", "tick", None, 1520)) == []
    assert clock(("clock", "tick", None, 1540)) == [("a", 1500, 1)]  # that of 1200 is merged with it
    assert clock(("a", "ok", None, 1550), ("clock", "tick", None, 5000)) == [("a", 4800, 10)]
    assert clock(("a", "stop", None, 5001), ("b", "stop", None, 5001), ("clock", "tick", None, 9000)) == []


def test_repeated_landings(spark, tmp_path):
    folder, counts = tmp_path / "landed", []
    folder.mkdir()
    rows = [{"source": "gnews/a", "title": f"Story number {i} about thing {i}", "url": f"https://a.example/{i}", "published_at": "2026-07-15T01:00:00Z", "source_tickers": ["A"]} for i in range(4)]

    def run(name, landed_rows, repeats):
        (folder / name).write_text("\n".join(map(json.dumps, landed_rows)))

        def prepare(df):
            counts.append(df.count())
            return feeds.prepared(df, F.to_timestamp(F.lit("2026-07-15T10:00:00Z")))

        stream.start(spark, str(folder), str(tmp_path / "s"), str(tmp_path / f"c{repeats}"), prepare, repeats=repeats).awaitTermination(120)

    run("one.json", rows[:3] + rows[:1], "1 day")
    run("two.json", rows[1:], "1 day")
    assert counts[0] == 3 and sum(counts) == 4  # repeats within the bound are not even asked
    store = Store(spark, str(tmp_path / "s"))
    assert (store.read("news_changes").count(), store.read("news_source_observations").count()) == (4, 4)
    run("three.json", rows, None)  # another stream, without a bound: the store knows them all
    store = Store(spark, store.path)
    assert (store.read("news_changes").count(), store.read("news_source_observations").count()) == (4, 4)


def item(i):
    return {"headline": f"H &amp; {i}", "url": f"https://a.example/{i}", "datetime": 1752570000, "related": "aapl", "source": "CNBC"}


def test_landed_polls(spark, tmp_path):
    landed.register(spark)
    folder = tmp_path / "polls"
    folder.mkdir()
    (folder / "t1.general.json").write_text(json.dumps([item(1), item(2)]))
    (folder / "t1.forex.json").write_text("<html>gateway error</html>")  # one part of a poll fails
    (folder / "t2.general.json").write_text(json.dumps([item(3)]))
    raw = spark.read.format("landed_feed").load(str(folder))
    assert raw.rdd.getNumPartitions() == 2
    rows = landed.records(raw, "finnhub").orderBy("url").collect()
    assert [(r.title, r._feed, r.source_tickers) for r in rows] == [("H & 1", "t1", ["AAPL"]), ("H & 2", "t1", ["AAPL"]), ("H & 3", "t2", ["AAPL"])]
    seen = []
    run = lambda: spark.readStream.format("landed_feed").load(str(folder)).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    assert sorted(json.loads(r.item)["url"][-1] for r in seen) == ["1", "2", "3"]
    (folder / "t3.general.xml").write_text("<rss><channel><item><title>S</title><link>u</link><category domain='x/symbol'>a</category></item></channel></rss>")
    run()
    assert len(seen) == 4 and json.loads(seen[-1].item)["category"] == [{"_domain": "x/symbol", "_VALUE": "a"}]
    assert landed.records(spark.createDataFrame(seen[-1:]), "seekingalpha_daily").first().source_tickers == ["A"]
    (folder / "t4.a.json").write_text("{}")
    (folder / "t4.b.json").write_text("not json")
    with pytest.raises(Exception, match="all parts of poll t4 failed"):
        spark.read.format("landed_feed").load(str(folder)).collect()
    os.remove(folder / "t4.a.json")
