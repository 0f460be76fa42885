"""Due times of sources as a stream's state: one deadline a source, backoff, one run in flight, missed runs merged.

The stream has what happens to sources, ``source, kind, interval_seconds, at``: ``plan`` (its interval from now on), ``ok``
and ``failed`` (a run's end), ``stop``, and with event times ``tick``, which only moves the clock. Its result are the runs to
start. Deadlines are timers of the state store, so they survive a restart, and no job scans all sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.health import delay, trigger_seconds

EVENT = "source string, kind string, interval_seconds long, at timestamp"
RUN = "source string, due_at timestamp, started_at timestamp, merged long"
_STATE = "interval long, due long, running boolean, failures long, held long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def spread(source: str, failures: int) -> float:
    """0.85 to 1.15, the same whenever it is asked."""
    return 0.85 + crc32(f"{source}:{failures}".encode()) % 1001 * 0.3 / 1000


class Deadlines(StatefulProcessor):
    """``due`` is the next start, ``held`` until when backoff defers it, both in milliseconds; every run has the time of its
    deadline, and ``merged`` deadlines passed before it without a run."""

    def __init__(self, event_time: bool, even: bool = False):
        self.event_time, self.even = event_time, even  # even: without spread

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("schedule", _STATE)

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.event_time else times.getCurrentProcessingTimeInMs()

    def _set(self, interval: int, due: int, running: bool, failures: int, held: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(due, held))
        self.state.update((interval, due, running, failures, held))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        source = key[0]
        for row in sorted(rows, key=lambda r: r["at"]):
            at = int(row["at"].timestamp() * 1000) if self.event_time else self._now(timerValues)
            known = self.state.get() if self.state.exists() else None
            if row["kind"] == "plan":
                kept = (known[2], known[3], known[4]) if known else (False, 0, 0)
                self._set(row["interval_seconds"], at + row["interval_seconds"] * 1000, *kept)
            elif row["kind"] == "stop" and known:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.state.clear()
            elif row["kind"] == "ok" and known:
                self._set(known[0], known[1], False, 0, 0)
            elif row["kind"] == "failed" and known:
                failures = known[3] + 1
                self._set(known[0], known[1], False, failures, at + 1000 * delay(known[0], failures, 1.0 if self.even else spread(source, failures)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return iter(())
        interval, due, running, failures, held = self.state.get()
        now, step = max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs()), interval * 1000
        passed = max(0, (now - due) // step)  # deadlines behind the first that passed too: all of them are one run
        last = due + passed * step
        late = now - last > 1000 * trigger_seconds(interval)["misfire"]
        starts = not running and held <= now and not late
        self._set(interval, last + step, running or starts, failures, held)
        return iter([Row(source=key[0], due_at=_time(last), started_at=_time(now), merged=passed)] if starts else ())

    def close(self) -> None:
        pass


def _time(ms: int):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(ms / 1000, UTC)


def due_runs(events: DataFrame, event_time: bool = False, even: bool = False) -> DataFrame:
    """The runs to start, of a stream of EVENT rows; by the clock of the cluster, or by the rows' own times if ``event_time``.

    A deadline starts no run while one is in flight, while backoff holds the source, or if it is noticed later than its
    misfire bound; deadlines that passed together are one. ``even`` leaves out the spread of backoff.
    """
    rows = events.withWatermark("at", "0 seconds") if event_time else events
    return rows.groupBy("source").transformWithState(Deadlines(event_time, even), RUN, "Append", "EventTime" if event_time else "ProcessingTime")


def use_timers(spark: SparkSession) -> None:
    """Timers need the state store that keeps them; call this before the stream is started."""
    spark.conf.set(*_PROVIDER)
