"""Calendar polls: copies that do not parse, empty answers, the copy written after the commit, and snapshots that are fresh enough."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tests.test_runs import RAW, state, store  # noqa: F401
from tidemark.functions.hashes import ordered_digest
from tidemark.operators import calendar
from tidemark.sources import calendar_cache

NOW = datetime(2026, 7, 15, 12, tzinfo=UTC)
at = lambda m: NOW + timedelta(minutes=m)


def test_unreadable_answers_and_copies(spark, store, tmp_path):  # noqa: F811
    raw, path = spark.createDataFrame(RAW, calendar_cache.EVENT), str(tmp_path / "copy.json")
    assert calendar.cached_enough(store, at(0)) is None
    first = calendar.refresh(store, at(0), at(0), raw, at(0), cache_path=path)
    assert calendar_cache.read(spark, path).count() == 2  # the copy is there once the snapshot is
    assert calendar.cached_enough(store, at(5)) == first and calendar.cached_enough(store, at(11)) is None
    untimed = spark.createDataFrame([("soon", "CPI", "USD", "high", "", "", "")], calendar_cache.EVENT)
    for n, bad in enumerate((untimed, raw.limit(0), raw.drop("impact")), 1):
        found = calendar.refresh(store, at(20 + n), at(20 + n), bad, at(20 + n), cached=calendar_cache.read(spark, path), cache_path=path)
        assert found[1] == 2 and (state(store).status, state(store).error_code, state(store).consecutive_failures) == ("degraded", "calendar_parse_failed", n)
    assert calendar_cache.read(spark, path).count() == 2  # never replaced by what does not parse
    assert calendar.cached_enough(store, at(27)) == found and calendar.cached_enough(store, at(29)) is None  # a stale one is asked again soon
    copy = untimed.withColumn("fetched_at", F.lit(at(0)))
    assert calendar.refresh(store, at(30), at(30), cached=copy) is None
    assert (state(store).error_code, state(store).consecutive_failures) == ("calendar_parse_failed", 4)
    assert calendar.refresh(store, at(31), at(31)) is None and state(store).error_code == "calendar_fetch_failed"
    assert store.read("calendar_snapshots").count() == 2


def test_digest_under_any_partitioning(spark):
    rows = spark.range(1, 5001).select(F.col("id").alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    want = ordered_digest(rows.coalesce(1), "ordinal", "h").first().digest
    assert all(ordered_digest(rows.repartition(n), "ordinal", "h").first().digest == want for n in (2, 7))
    assert ordered_digest(rows.where("ordinal <> 7"), "ordinal", "h").first().digest != want
    assert ordered_digest(rows.limit(0), "ordinal", "h").first().digest == ordered_digest(rows.where("ordinal < 0").coalesce(1), "ordinal", "h").first().digest
