"""Batches into the store against a sequential model: key priority, order of the title pool, keys of the same batch."""

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tests.test_dedup import similar
from tidemark.functions.text import normalize_title
from tidemark.operators import state
from tidemark.operators.store import Store
from tidemark.sources import feeds
from tidemark.streaming import ingest as stream

NOW = datetime(2026, 7, 15, 12, tzinfo=UTC)
POOL = 6


class Model:
    """The rule, item by item: history and batch by hash, older hash and URL, then titles of the pool and the batch."""

    def __init__(self):
        self.rows = []  # (id, title, bucket, recency, content hash, url)

    def batch(self, items):
        hashes, urls, titles = {}, {}, {}
        for i, _, _, _, content, url in sorted(self.rows):
            hashes.setdefault(content, i)
            urls.setdefault(url, i)
        for i, title, bucket, _, _, _ in sorted(self.rows, key=lambda r: (-r[3], r[0]))[:POOL]:
            titles.setdefault(bucket, []).append((title, i))
        out = []
        for title, bucket, recency, content, legacy, url in items:
            owner = hashes.get(content) or hashes.get(legacy) or urls.get(url)
            if owner is None:
                owner = next((i for t, i in titles.get(bucket, []) if similar(title, t)), None)
            if owner is None:
                owner = len(self.rows) + 1
                self.rows.append((owner, title, bucket, recency, content, url))
                hashes[content] = hashes[legacy] = urls[url] = owner
                titles.setdefault(bucket, []).append((title, owner))
            out.append(owner)
        return out


def test_random_batches(spark, tmp_path, monkeypatch, seed=1):
    monkeypatch.setattr(state, "POOL", POOL)
    monkeypatch.setattr(state.with_batch, "__defaults__", (POOL,))
    rng, store, model = random.Random(seed), Store(spark, str(tmp_path / "store")), Model()
    bases = [[f"w{rng.randrange(50)}" for _ in range(rng.randint(5, 12))] + [str(rng.randrange(3))] for _ in range(7)]
    wanted = []
    for n in range(3):
        rows = []
        for i in range(22):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
            hour = f"2026-07-1{rng.randrange(4, 6)}T{rng.randrange(24):02}:{rng.randrange(60):02}:00Z"
            rows.append((f"s{n}/{i}", " ".join(words), None, f"https://a.example/{rng.randrange(40)}", None, hour, []))
        frame = spark.createDataFrame(rows, stream.RECORDS).withColumn("_at", F.substring("source", 4, 9).cast("long"))
        prepared = feeds.prepared(frame, F.lit(NOW))
        known = sorted(prepared.select("_at", "source", normalize_title(F.col("title")).alias("t"), F.date_format("published_at", "yyyy-MM-dd").alias("b"), F.unix_micros("published_at").alias("r"), "content_hash", "legacy_hash", "url").collect())
        got = stream.ingest(store, prepared, NOW + timedelta(seconds=n))
        owners = model.batch([tuple(r)[2:] for r in known])
        wanted += [(r.source, o) for r, o in zip(known, owners)]
        assert got["inserted"] + got["duplicates"] == len(rows)
        seen = {r.source: r.canonical_news_id for r in store.read("news_source_observations").collect()}
        assert seen == dict(wanted)
    assert len(model.rows) == store.read("news_changes").select("news_id").distinct().count()


def test_url_of_a_new_item_comes_before_a_title_of_the_pool(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    title = "Central bank holds its main interest rate steady at 5 percent after long debate today"

    def batch(rows, at):
        frame = spark.createDataFrame([(s, t, None, u, None, "2026-07-15T01:00:00Z", []) for s, t, u in rows], stream.RECORDS).withColumn("_at", F.substring("source", 2, 9).cast("long"))
        stream.ingest(store, feeds.prepared(frame, F.lit(NOW)), at)

    batch([("a1", title, "https://a.example/1")], NOW)
    batch([("b1", "Quite another story", "https://a.example/2"), ("b2", title.replace("holds", "holding"), "https://a.example/2")], NOW + timedelta(seconds=1))
    assert {r.source: r.canonical_news_id for r in store.read("news_source_observations").collect()} == {"a1": 1, "b1": 2, "b2": 2}
