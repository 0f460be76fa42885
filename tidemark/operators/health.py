"""Source health: status derivation, backoff, latest state per source, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKOFF_CAP, BACKOFF_FLOOR, STALE_DAYS, STALE_RETRY = 21_600, 60, 7, 300


def status(enabled: Column, configured: Column, fetch_ok: Column, persisted: Column, last_success: Column) -> Column:
    """disabled > not_configured > a failed fetch (degraded after any success) > a failed write > ok."""
    failed = F.when(last_success.isNotNull(), "degraded").otherwise("unavailable")
    return F.when(~enabled, "disabled").when(~configured, "not_configured").when(~fetch_ok, failed).when(~persisted, "degraded").otherwise("ok")


def backoff_seconds(interval: Column, failures: Column, spread: Column) -> Column:
    """interval * 2 ** failures (6 at most) * spread (0.85 to 1.15), between the floor and the cap."""
    return F.least(F.lit(BACKOFF_CAP), F.greatest(F.lit(BACKOFF_FLOOR), F.floor(interval * F.pow(F.lit(2), F.least(failures, F.lit(6))) * spread))).cast("long")


def delay(interval: int, failures: int, spread: float) -> int:
    """backoff_seconds of one run, for state that is kept outside of tables."""
    return min(BACKOFF_CAP, max(BACKOFF_FLOOR, int(interval * 2 ** min(failures, 6) * spread)))


def trigger_seconds(interval: int) -> dict[str, int]:
    """How far a poll may be moved, and how late it may start."""
    return {"jitter": min(60, max(5, interval // 10)), "misfire": max(30, min(interval, 300))}


def latest(log: DataFrame) -> DataFrame:
    """The last row of each source by version."""
    names = [c for c in log.columns if c != "source"]
    return log.groupBy("source").agg(F.max_by(F.struct(*names), "version").alias("r")).select("source", "r.*").select(*log.columns)


def clamped(rows: DataFrame) -> DataFrame:
    """Counters not below zero, names and error codes within their lengths."""
    counters = ("consecutive_failures", "raw_count", "inserted_count", "duplicates_count")
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.col(c)).cast("long")) for c in counters}).withColumns({"source": F.substring("source", 1, 200), "error_code": F.substring("error_code", 1, 100)})


def after_failure(prior: DataFrame, attempts: DataFrame, retry: int = STALE_RETRY) -> DataFrame:
    """attempts(source, attempted_at, error_code) that failed, on top of each source's prior state."""
    old = latest(prior).select("source", "last_success_at", "data_through", "consecutive_failures", "version")
    rows = attempts.join(old, "source", "left")
    return rows.select(
        "source", F.when(F.col("last_success_at").isNotNull(), "degraded").otherwise("unavailable").alias("status"), F.col("attempted_at").alias("last_attempt_at"), "last_success_at", "data_through",
        (F.coalesce("consecutive_failures", F.lit(0)) + 1).alias("consecutive_failures"), (F.col("attempted_at") + F.make_dt_interval(secs=F.lit(retry))).alias("next_attempt_at"), "error_code",
        F.col("attempted_at").alias("updated_at"), (F.coalesce("version", F.lit(0)) + 1).alias("version"),
    )


def versioned(log: DataFrame, rows: DataFrame) -> DataFrame:
    """An upsert of ``rows``, one a source: clamped, with the version after the source's latest."""
    old = log.groupBy("source").agg(F.max("version").alias("_last"))
    return clamped(rows).join(old, "source", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).drop("_last").select(*rows.columns)


def after_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The health rows that runs of sources leave, on top of each source's latest state, with their ``outcome``.

    ``runs(source, enabled, configured, forced, interval_seconds, spread, attempted_at, fetched_at, fetch_ok, persisted,
    raw_count, inserted_count, duplicates_count)``. A source that is disabled, waits for its next attempt or has no key is
    not fetched; a failed fetch counts and defers the next attempt; a failed write keeps what the data reaches, which
    moves only once rows are stored.
    """
    names = ("status", "last_success_at", "data_through", "consecutive_failures", "next_attempt_at", "raw_count", "inserted_count", "duplicates_count", "error_code", "version")
    old = latest(log).select("source", F.struct(*names).alias("old"))
    rows = runs.join(old, "source", "left")
    outcome = F.when(~F.col("forced") & ~F.col("enabled"), "disabled").when(~F.col("forced") & F.coalesce(F.col("old.next_attempt_at") > F.col("attempted_at"), F.lit(False)), "backoff")
    outcome = outcome.when(~F.col("configured"), "not_configured").when(~F.col("fetch_ok"), "error").when(~F.col("persisted"), "degraded").otherwise("ok")
    rows = rows.withColumn("outcome", outcome)
    of = lambda *names: F.col("outcome").isin(*names)
    kept = lambda name: F.col(f"old.{name}")
    failures = F.coalesce(kept("consecutive_failures"), F.lit(0)) + of("error").cast("int")
    later = F.col("attempted_at") + F.make_dt_interval(secs=backoff_seconds(F.col("interval_seconds"), failures, F.col("spread")))
    number = lambda name, shown: F.when(of(*shown), F.col(name)).when(of("error", "degraded"), 0).otherwise(kept(name)).cast("long")
    failed = F.when(kept("last_success_at").isNotNull(), "degraded").otherwise("unavailable")
    return rows.select(
        "source", F.when(of("error"), failed).when(of("backoff"), F.coalesce(kept("status"), F.lit("unavailable"))).otherwise(F.col("outcome")).alias("status"), F.col("attempted_at").alias("last_attempt_at"),
        F.when(of("ok", "degraded"), F.col("fetched_at")).otherwise(kept("last_success_at")).alias("last_success_at"), F.when(of("ok"), F.col("fetched_at")).otherwise(kept("data_through")).alias("data_through"),
        F.when(of("ok", "degraded"), 0).otherwise(failures).cast("long").alias("consecutive_failures"), F.when(of("error"), later).when(~of("ok", "degraded"), kept("next_attempt_at")).alias("next_attempt_at"),
        number("raw_count", ("ok", "degraded")).alias("raw_count"), number("inserted_count", ("ok",)).alias("inserted_count"), number("duplicates_count", ("ok",)).alias("duplicates_count"),
        F.when(of("error"), "source_fetch_failed").when(of("degraded"), "news_persistence_failed").when(of("not_configured"), "source_not_configured").when(~of("ok"), kept("error_code")).alias("error_code"),
        F.col("attempted_at").alias("updated_at"), (F.coalesce(kept("version"), F.lit(0)) + 1).cast("long").alias("version"), "outcome",
    )


def data_through(log: DataFrame) -> DataFrame:
    """One row: the largest non-empty data_through over the sources' latest states."""
    return latest(log).agg(F.max("data_through").alias("data_through"))


def usable_cache(fetched_at: Column, now: Column) -> Column:
    """Whether a last known good copy may stand in: STALE_DAYS old at most."""
    return fetched_at >= now - F.make_dt_interval(F.lit(STALE_DAYS))


def source_snapshot(registry: DataFrame, log: DataFrame) -> DataFrame:
    """Every configured source with its latest state, defaults where it has none."""
    state = latest(log).drop("version")
    rows = registry.join(state, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "enabled", "configured", F.coalesce("status", F.lit("unavailable")).alias("status"), "last_attempt_at", "last_success_at", "data_through", zero("consecutive_failures"), zero("raw_count"), zero("inserted_count"), zero("duplicates_count"), "error_code")


def due(registry: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """The sources to poll at ``now``: enabled, with their key where they need one, and past their next attempt."""
    waiting = latest(log).where(F.col("next_attempt_at") > now).select("source")
    return registry.where("enabled AND configured").join(waiting, "source", "left_anti")


def counters(results: DataFrame) -> DataFrame:
    """Per source and in total: raw, inserted and duplicate rows of a run; results(source, matched)."""
    duplicate = F.col("matched").isNotNull()
    return results.rollup("source").agg(F.count("*").alias("raw"), F.count_if(~duplicate).alias("inserted"), F.count_if(duplicate).alias("duplicates"))
