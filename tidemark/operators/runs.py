"""A source's run: fetch, ingest and health, the rows and their health in one commit."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.operators.store import Store
from tidemark.scratch import Scratch
from tidemark.streaming.ingest import ingest

#: What health.after_runs reads of a run.
RUN = "source string, enabled boolean, configured boolean, forced boolean, interval_seconds int, spread double, attempted_at timestamp, fetched_at timestamp, fetch_ok boolean, persisted boolean, raw_count long, inserted_count long, duplicates_count long"
CHILDREN = {"seekingalpha": ("seekingalpha_breaking", "seekingalpha_daily")}


def aggregate(store: Store, source: str, fetch: Callable[[str], DataFrame], interval: int, enabled: bool = True, configured: bool = True, forced: bool = False, spread: float = 1.0, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> dict:
    """One run of a source: {source, status, raw, inserted, duplicates}.

    ``fetch(source)`` gives the prepared records; it is not asked where the source is disabled, waits for its next attempt
    or has no key. A failed fetch is counted and defers the next attempt. Records and health become visible in one commit; if
    that fails, health alone says so, and what the data reaches stays. ``seekingalpha`` runs its two feeds.
    """
    if source in CHILDREN:
        results = [aggregate(store, child, fetch, interval, enabled, configured, forced, spread, clock) for child in CHILDREN[source]]
        return {"source": source, "inserted": sum(r["inserted"] for r in results), "duplicates": sum(r["duplicates"] for r in results), "results": results}
    attempted = clock()
    log = store.read("source_health").where(F.col("source") == source)

    def after(**more) -> DataFrame:
        run = {"source": source, "enabled": enabled, "configured": configured, "forced": forced, "interval_seconds": interval, "spread": spread, "attempted_at": attempted, "fetched_at": attempted, "fetch_ok": True, "persisted": True, "raw_count": 0, "inserted_count": 0, "duplicates_count": 0} | more
        return health.after_runs(log, store.spark.createDataFrame([tuple(run[name] for name in _names())], RUN))

    def alone(**more) -> str:
        rows = after(**more)
        store.commit({"source_health": rows.drop("outcome")})
        return rows.first()["outcome"]

    result = {"source": source, "raw": 0, "inserted": 0, "duplicates": 0}
    if (outcome := after().first()["outcome"]) in ("disabled", "backoff", "not_configured"):
        alone()
        return result | {"status": outcome}
    with Scratch(store.spark, "run") as tmp:
        try:
            rows = tmp.written(fetch(source), "fetched")
            raw = rows.count()
        except Exception as error:  # whatever a source does wrong is its failure, not the run's
            return result | {"status": alone(fetch_ok=False), "error": type(error).__name__}
        fetched = clock()
        try:
            counts = ingest(store, rows, fetched, more=lambda n: {"source_health": after(fetched_at=fetched, raw_count=raw, inserted_count=n["inserted"], duplicates_count=n["duplicates"]).drop("outcome")})
        except Exception as error:  # the commit did not happen
            return result | {"status": alone(fetched_at=fetched, raw_count=raw, persisted=False), "raw": raw, "error": type(error).__name__}
    return result | counts | {"status": "ok", "raw": raw}


def _names() -> list[str]:
    return [part.split()[0] for part in RUN.split(", ")]
