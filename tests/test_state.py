"""State in parts, retention, migration, runs and single inserts as commits."""

import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.operators import changes, migrate, retention, runs, schema, state
from tidemark.operators import store as stores
from tidemark.operators.store import Store
from tidemark.plans import catalogue, paging
from tidemark.sources import feeds
from tidemark.streaming import ingest as stream

NOW = datetime(2026, 7, 15, 12, tzinfo=UTC)


def prepared(spark, rows):
    frame = spark.createDataFrame([(s, t, None, u, None, at, ["A"]) for s, t, u, at in rows], stream.RECORDS).withColumn("_at", F.monotonically_increasing_id())
    return feeds.prepared(frame, F.lit(NOW))


def item(i, source="finnhub/x", at="2026-07-15T01:00:00Z"):
    return source, f"Story {i} of {i * 7919} on item{i} and thing{i * 31}", f"https://a.example/{i}", at


def tables(store):
    names = [*schema.TABLES, *schema.KEYED]
    return {t: sorted(map(str, store.read(t).collect())) for t in names}


def same_state(store):
    """The state that is kept up, against the state from the logs."""
    for table, (rows, _) in state.rebuilt(store).items():
        want, got = rows.drop("part"), store.read(table)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), table


def test_a_batch_reads_the_parts_of_its_keys(spark, tmp_path, monkeypatch):
    """A history of 5,000 entities, then four items: rows read are those of the touched parts, and no log is read."""
    store = Store(spark, str(tmp_path / "store"), buckets=64)
    stream.ingest(store, prepared(spark, [item(i) for i in range(5_000)]), NOW)
    sizes = {t: {r["part"]: r["count"] for r in store.read(t, named=True).groupBy("part").count().collect()} for t in schema.KEYED}
    asked, read = [], Store.read

    def counting(self, table, parts=None, named=False):
        asked.append((table, None if parts is None else tuple(parts)))
        return read(self, table, parts, named)

    monkeypatch.setattr(Store, "read", counting)
    rows = [item(17, "massive/y"), item(9_001), item(9_002), ("gnews/z", "Quite another title", "https://a.example/99", "2026-07-15T02:00:00Z")]
    assert stream.ingest(store, prepared(spark, rows), NOW + timedelta(seconds=1)) == {"inserted": 2, "duplicates": 2}
    monkeypatch.setattr(Store, "read", read)
    assert {t for t, parts in asked if parts is None} == {"entity_pool"}  # bounded by the pool
    for table, most in (("entities", 4), ("entity_keys", 4 * 3), ("observation_keys", 4), ("evidence", 4)):
        parts = {p for t, own in asked if t == table and own for p in own}
        assert 0 < len(parts) <= most and sum(sizes[table].get(p, 0) for p in parts) < 0.3 * sum(sizes[table].values()), table
    same_state(store)


def test_many_batches_leave_no_scratch(spark, tmp_path, monkeypatch):
    from tidemark import scratch

    shared = tmp_path / "shared"
    monkeypatch.setattr(scratch, "root", lambda _: str(shared))
    monkeypatch.setattr(stores, "FULL", 3)
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    for n in range(4):
        stream.ingest(store, prepared(spark, [item(n), item(n + 1), item(100 + n)]), NOW + timedelta(seconds=n), batch=n)
    assert not shared.exists() or not list(shared.iterdir())
    same_state(store)
    again = Store(spark, store.path)
    assert again._state == store._state and len(again._known) < 4  # a summary stands for the markers before it
    assert again.is_done(3) and not again.is_done(4) and not again.is_done(0, "another stream")
    live, before = tables(store), sum(1 for p in (tmp_path / "store").rglob("part=*") if p.is_dir())
    assert store.purge() > 0 and tables(Store(spark, store.path)) == live
    assert sum(1 for p in (tmp_path / "store").rglob("part=*") if p.is_dir()) < before


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([(1,)], "change_sequence long")
    assert one.commit({"news_changes": row})
    with pytest.raises(Exception, match="FileAlreadyExists"):
        two.commit({"news_changes": row})
    assert Store(spark, one.path).read("news_changes").count() == 1


def old_store(spark, tmp_path):
    """Seven entities of which three are expired, in three commits, two of them seen by two sources."""
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    old, new = "2024-01-0{}T00:00:00Z", "2026-07-15T01:00:00Z"
    long_ago = NOW - timedelta(days=800)
    stream.ingest(store, prepared(spark, [item(i, at=old.format(i)) for i in (1, 2, 3)]), long_ago)
    stream.ingest(store, prepared(spark, [item(2, "massive/y", old.format(2)), *[item(i, at=new) for i in (4, 5)]]), long_ago + timedelta(days=1))
    stream.ingest(store, prepared(spark, [item(4, "massive/y", new), *[item(i, at=new) for i in (6, 7)]]), NOW - timedelta(days=1))
    snaps = spark.createDataFrame([(i, f"cal_{i}", "s", NOW, NOW, False, NOW - timedelta(days=200 - i), "p") for i in (1, 2)], schema.SNAPSHOTS)
    events = spark.createDataFrame([(s, 1, "e", "USD", "U", "t", "high", "h", "x", NOW, None, None, None, "c") for s in (1, 2)], schema.CALENDAR)
    store.commit({"calendar_snapshots": snaps.limit(1), "calendar_events": events.where("snapshot_sequence = 1")})
    store.commit({"calendar_snapshots": snaps.where("snapshot_sequence = 2"), "calendar_events": events.where("snapshot_sequence = 2")})
    return store


def test_retention_is_one_commit(spark, tmp_path):
    store = old_store(spark, tmp_path)
    tailed = []
    follow = lambda: stream.tail(spark, store.path, str(tmp_path / "t"), lambda rows, _: tailed.extend(rows.collect())).awaitTermination(60)
    follow()
    assert len(tailed) == 9
    before, parts = tables(store), store.parts("news_source_observations")
    keep = spark.createDataFrame([(3,), (None,)], "ref long")
    assert retention.cleanup(store, NOW, [(keep, "ref")], batch=1) == {"news_items": 2, "news_changes": 4, "calendar_snapshots": 1}
    assert tables(Store(spark, store.path, version=store.version - 1)) == before  # a reader of the version before
    log = {(r.news_id, r.operation) for r in store.read("news_changes").collect()}
    assert {x for x in log if x[0] in (1, 2)} == {(1, "delete"), (2, "delete")} and (3, "upsert") in log
    assert {r.canonical_news_id for r in store.read("news_source_observations").collect()} == {3, 4, 5, 6, 7}
    assert [r.snapshot_sequence for r in store.read("calendar_snapshots").collect()] == [2] == [r.snapshot_sequence for r in store.read("calendar_events").collect()]
    assert store.parts("news_source_observations")["c3"] == parts["c3"]  # a part without expired rows stays as it is
    same_state(store)
    after = tables(store)
    assert retention.cleanup(store, NOW, [(keep, "ref")], batch=1)["news_items"] == 0 and retention.cleanup(store, NOW, [(keep, "ref")])["news_changes"] == 0
    assert tables(store) == after == tables(Store(spark, store.path))
    follow()
    assert [(r.operation, r.news_id) for r in tailed[9:]] == [("delete", 1), ("delete", 2)]
    store.purge()
    assert tables(store) == after
    assert stream.ingest(store, prepared(spark, [item(1)]), NOW + timedelta(seconds=1)) == {"inserted": 1, "duplicates": 0}  # its keys are free again
    assert max(r.news_id for r in store.read("news_changes").collect()) == 8  # ids are not given twice
    assert retention.cleanup(store, NOW, news_days=0, change_days=9999, snapshot_days=9999) == {"news_items": 0, "news_changes": 0, "calendar_snapshots": 0}


def test_pool_is_filled_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state.with_batch, "__defaults__", (3,))
    monkeypatch.setattr(state.without, "__defaults__", (3,))
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    stream.ingest(store, prepared(spark, [item(i, at=f"2024-01-0{i}T00:00:00Z") for i in range(1, 7)]), NOW)
    pool = lambda: sorted(r.news_id for r in store.read("entity_pool").collect())
    assert pool() == [4, 5, 6]
    assert retention.cleanup(store, NOW, [(spark.createDataFrame([(1,), (2,), (3,), (6,)], "ref long"), "ref")])["news_items"] == 2
    assert pool() == [2, 3, 6]


LEGACY = [(1, "a", "Old story one", "https://l.example/1", "h1", NOW), (5, "b", "Old story two", "https://l.example/5", "h5", NOW)]


def test_upgrade(spark, tmp_path, monkeypatch):
    legacy = spark.createDataFrame(LEGACY, "news_id long, source string, title string, url string, content_hash string, fetched_at timestamp")
    want = Store(spark, str(tmp_path / "a"), buckets=4)
    assert migrate.upgrade(want, legacy, NOW) == ["first observations", "baseline changes", "current state"]
    log = want.read("news_changes").orderBy("news_id").collect()
    assert [(r.change_sequence, r.news_id, r.operation, r.payload_hash, r.source_tickers) for r in log] == [(1, 1, "upsert", "h1", []), (2, 5, "upsert", "h5", [])]
    assert [r.canonical_news_id for r in want.read("news_source_observations").orderBy("observation_id").collect()] == [1, 5]
    same_state(want)
    done = tables(want)
    assert migrate.upgrade(want, legacy, NOW + timedelta(days=9)) == [] and tables(want) == done
    # Killed behind the first step, then before the marker of the second: the same store, at the time of the first run.
    half = Store(spark, str(tmp_path / "b"), buckets=4)
    steps = migrate.STEPS

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(migrate, "STEPS", (steps[0], ("baseline changes", killed), steps[2]))
    with pytest.raises(RuntimeError):
        migrate.upgrade(half, legacy, NOW)
    monkeypatch.setattr(migrate, "STEPS", steps)
    write = Store._write
    monkeypatch.setattr(Store, "_write", killed)
    with pytest.raises(RuntimeError):
        migrate.upgrade(Store(spark, half.path), legacy, NOW)
    monkeypatch.setattr(Store, "_write", write)
    half = Store(spark, half.path)
    assert migrate.upgrade(half, legacy, NOW + timedelta(days=1)) == ["baseline changes", "current state"] and tables(half) == done
    assert stream.ingest(half, prepared(spark, [("c", "Another", "https://l.example/5", "2026-07-15T01:00:00Z")]), NOW) == {"inserted": 0, "duplicates": 1}


def test_stores_without_state_say_so(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"news_changes": spark.createDataFrame([(1, 1, "upsert", "h", NOW)], "change_sequence long, news_id long, operation string, content_hash string, available_at timestamp")})
    with pytest.raises(ValueError, match="upgrade"):
        stream.ingest(store, prepared(spark, [item(1)]), NOW)
    migrate.upgrade(store, now=NOW)
    assert stream.ingest(store, prepared(spark, [item(1)]), NOW)["inserted"] == 1


def test_single_inserts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    title = "Central bank holds its main interest rate steady at 5 percent after long debate today"
    one = lambda s, t, u: stream.insert(store, prepared(spark, [(s, t, u, "2026-07-15T01:00:00Z")]), NOW)
    assert one("a/x", title, "https://a.example/1") == 1
    assert one("a/x", title.replace("holds", "holding"), "https://a.example/2") == 2  # titles are not compared
    assert one("b/y", title, "https://a.example/2") is None  # the hash of 1 and the URL of 2: the smaller id
    assert {(r.source, r.canonical_news_id) for r in store.read("news_source_observations").collect()} == {("a/x", 1), ("a/x", 2), ("b/y", 1)}
    assert store.read("news_changes").count() == 3
    same_state(store)
    with pytest.raises(ValueError, match="one record"):
        stream.insert(store, prepared(spark, [item(1), item(2)]), NOW)


def test_runs(spark, tmp_path, monkeypatch):
    store, at = Store(spark, str(tmp_path / "s"), buckets=4), [NOW]
    run = lambda fetch, **more: runs.aggregate(store, "finnhub", fetch, 300, clock=lambda: at[0], **more)
    health = lambda: runs.health.latest(store.read("source_health")).first()
    rows = lambda _: prepared(spark, [item(1), item(2), item(1, "massive/y")])
    assert run(rows) == {"source": "finnhub", "status": "ok", "raw": 3, "inserted": 2, "duplicates": 1}
    assert len(store.commits()) == 1 and (health().inserted_count, health().status) == (2, "ok")  # rows and health are one commit
    through = health().data_through

    def broken(_):
        raise RuntimeError("no answer")

    at[0] += timedelta(hours=1)
    assert run(broken)["status"] == "error" and health().consecutive_failures == 1 and health().data_through == through
    assert run(rows)["status"] == "backoff" and run(rows, enabled=False)["status"] == "disabled" and run(rows, forced=True, configured=False)["status"] == "not_configured"
    at[0] += timedelta(hours=9)
    commit = Store.commit

    def failing(self, added, *args, **more):
        if "news_changes" in added:
            raise RuntimeError("disk full")
        return commit(self, added, *args, **more)

    monkeypatch.setattr(Store, "commit", failing)
    assert run(lambda _: prepared(spark, [item(3)]))["status"] == "degraded"
    monkeypatch.setattr(Store, "commit", commit)
    assert (health().error_code, health().data_through) == ("news_persistence_failed", through) and store.read("news_changes").select("news_id").distinct().count() == 2
    both = runs.aggregate(store, "seekingalpha", lambda s: prepared(spark, [item(7, f"{s}/x")]), 300, clock=lambda: at[0])
    assert (both["inserted"], both["duplicates"], len(both["results"])) == (1, 1, 2)


def test_evidence_of_one_entity_goes_by_number(spark):
    seen = spark.createDataFrame([(1, 9, "late", NOW + timedelta(hours=1)), (2, 9, "early", NOW), (3, 9, "Late", NOW - timedelta(hours=1)), (4, 9, "unknown yet", NOW + timedelta(hours=9))], "observation_id long, canonical_news_id long, source string, observed_at timestamp")
    assert changes.evidence_by_key(seen, F.lit(NOW + timedelta(hours=2))).first().sources == ["late", "early"]
    log = spark.createDataFrame([(1, 9, "upsert", "own", "t", None, "u", None, None, NOW, [], "h", NOW, NOW + timedelta(hours=2), "p")], schema.CHANGES)
    item = paging.news_item(log, seen, 9, NOW + timedelta(hours=3))
    assert (item["sources"], item["source_count"]) == (["late", "early"], 2)
    first = changes.first_sightings(seen.where("observation_id < 3"))
    merged = changes.merged_sightings(first, seen.where("observation_id >= 3"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, changes.first_sightings(seen).collect()))
    assert changes.with_evidence(log, merged).first().sources == ["Late", "early"]  # that of a change by time


def test_a_large_part_is_dealt_to_many_tasks(spark, tmp_path):
    """A commit's 20,000 rows are one part: retention writes what is left of them by several tasks, and a small part by one."""
    store, rows = Store(spark, str(tmp_path / "store")), spark.range(0, 20_000, 1, 8)
    seen = rows.select((F.col("id") + 1).alias("observation_id"), F.col("id").alias("canonical_news_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("observation_hash"))
    store.commit({"news_source_observations": seen})
    store.commit({"news_source_observations": seen.limit(10).withColumn("observation_id", F.col("observation_id") + 20_000)})
    most, gone = "spark.sql.adaptive.advisoryPartitionSizeInBytes", rows.where("id % 1000 = 3").withColumnRenamed("id", "canonical_news_id")
    before = spark.conf.get(most)
    spark.conf.set(most, "128k")
    try:
        store.commit({}, parts=retention._cut(store, "news_source_observations", gone, "canonical_news_id"))
    finally:
        spark.conf.set(most, before)
    left = store.read("news_source_observations", named=True)
    files = left.groupBy("part", F.input_file_name().alias("file")).count().collect()
    sizes = sorted(r["count"] for r in files if r["part"] == "c1")
    assert sum(sizes) == 19_980 and len(sizes) > 2 and sizes[-1] < 10_000
    assert [r["count"] for r in files if r["part"] == "c2"] == [9]
    want = {(i + 1, i) for i in range(20_000) if i % 1000 != 3} | {(i + 20_001, i) for i in range(10) if i != 3}
    assert {(r[0], r[1]) for r in left.select("observation_id", "canonical_news_id").collect()} == want


def written_bytes(spark):
    """Bytes of the shuffle files that lie on disk now."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while found.hasNext():
        f = found.next()
        total += f.length() if f.getName().startswith("shuffle_") else 0
    return total


def test_few_rows_go_without_a_shuffle_of_the_rest(spark, tmp_path, monkeypatch):
    """A part loses a few rows by the tasks that read it; beyond FEW tables are shuffled, with the same rows after."""
    plans, write = [], Store._write_parts

    def planned(self, rows, table, n, lying=False):
        plans.append((table, lying))
        return write(self, rows, table, n, lying)

    monkeypatch.setattr(Store, "_write_parts", planned)
    left = []
    for few in (retention.FEW, 0):
        monkeypatch.setattr(retention, "FEW", few)
        store = old_store(spark, tmp_path / str(few))
        plans.clear()
        assert retention.cleanup(store, NOW, [(spark.createDataFrame([(3,)], "ref long"), "ref")]) == {"news_items": 2, "news_changes": 4, "calendar_snapshots": 1}
        assert {t for t, lying in plans if lying} == ({t for t, _ in plans} - {"entity_pool"} if few else set()) and len(plans) == 9
        same_state(store)
        left.append(tables(store))
        names = {t: set(store.parts(t)) for t in left[-1]}
        assert all({r.part for r in store.read(t, named=True).select("part").distinct().collect()} <= names[t] for t in names)
    assert left[0] == left[1]


def test_rows_lying_by_part_have_no_exchange(spark, tmp_path):
    store = old_store(spark, tmp_path)
    rows, names = retention._cut(store, "news_source_observations", spark.createDataFrame([(1,)], "canonical_news_id long"), "canonical_news_id", True)["news_source_observations"]
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().toString() and names
    store.commit({}, parts={"news_source_observations": (rows, names)}, lying=["news_source_observations"])
    assert 1 not in {r.canonical_news_id for r in store.read("news_source_observations").collect()}


def test_a_store_keeps_no_shuffles_and_a_query_no_older_parts(spark, tmp_path, monkeypatch):
    """Once a store is made and cleaned up, its shuffles are gone, and of each table's parts only those that are read are left."""
    monkeypatch.setattr(scratch, "root", lambda _: str(tmp_path))
    before = written_bytes(spark)
    out = catalogue.QUERIES["retention_commit"](spark, "/root/testdata/sf0.001")
    until = time.time() + 20
    while written_bytes(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert written_bytes(spark) <= before
    (store,) = (Store(spark, str(p)) for p in tmp_path.glob("retention-*") if (p / "_commits").exists())
    for table in ("news_changes", "news_source_observations", "entities"):
        lies = {str(p.parent.relative_to(tmp_path)).split("/", 2)[2] for p in tmp_path.glob(f"retention-*/{table}/**/*.parquet")}
        assert lies == set(store.parts(table).values())
    assert not list(tmp_path.glob("entities-*")) and out.count() > 0
