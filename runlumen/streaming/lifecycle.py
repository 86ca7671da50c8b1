"""Lifecycle of attempts as a keyed state machine with an expiry timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runlumen.operators.lifecycle import LEASE
from runlumen.schemas import LEASE_MINUTES, MAX_ATTEMPTS
from runlumen.session import STREAM_SETTINGS, settings

LEASE_MICROS = LEASE_MINUTES * 60_000_000
OPEN = ("DISCOVERED", "RETRYABLE")
FINAL = ("PUBLISHED", "TERMINAL_FAILURE")
CORE = "state string, attempts int, claimed long, upto long, shown string, step long, wake long, lease long"
PENDING = "ts long, event_id string, action string"
UPDATES = "attempt string, state string, attempts int, claimed long, step long, late long"


def after(state: str, attempts: int, claimed: int | None, ts: int, action: str) -> tuple[str, int, int | None]:
    """State, attempts and time of the last claim after one event."""
    if state == "ABSENT":
        return ("DISCOVERED" if action == "discover" else state), attempts, claimed
    if state in OPEN and action == "claim" and attempts < MAX_ATTEMPTS:
        return "COLLECTING", attempts + 1, ts
    if state == "COLLECTING":
        if action == "publish":
            return "PUBLISHED", attempts, claimed
        if action == "fail" or (action in ("discover", "tick") and ts >= claimed + LEASE_MICROS):
            return failed(attempts), attempts, claimed
    return state, attempts, claimed


def failed(attempts: int) -> str:
    return "TERMINAL_FAILURE" if attempts >= MAX_ATTEMPTS else "RETRYABLE"


class Tracker(StatefulProcessor):
    """One attempt: its state up to the watermark and the events after it.

    Events up to the watermark are applied in order of (time, id) and forgotten; events after it wait,
    because earlier ones may still come, and are applied on a copy for what is shown. Two timers wake
    the attempt: at its last waiting event, and at the end of a running lease, when the claim is shown
    as failed though no event has come. A late event of a collector that goes on still counts, as in
    the batch fold. Events behind the watermark of an attempt are counted as late, never applied.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", CORE)
        self.pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._advance(key, [(r["ts"], r["event_id"], r["action"]) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, [], timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, fresh: list, timer_values) -> Iterator[Row]:
        now = timer_values.getCurrentWatermarkInMs() * 1000
        state, attempts, claimed, upto, shown, step, wake, lease = self.core.get() or (
            "ABSENT", 0, None, -1, None, 0, -1, -1)
        late = sum(ts <= upto for ts, _, _ in fresh)
        waiting = {(ts, event): (ts, event, action) for ts, event, action in [
            *((r[0], r[1], r[2]) for r in self.pending.get()), *(f for f in fresh if f[0] > upto)]}
        waiting = [waiting[k] for k in sorted(waiting)]
        ready = sum(ts <= now for ts, _, _ in waiting)
        for ts, _, action in waiting[:ready]:
            state, attempts, claimed = after(state, attempts, claimed, ts, action)
        waiting = [] if state in FINAL else waiting[ready:]
        view = (state, attempts, claimed)
        for ts, _, action in waiting:
            view = after(*view, ts, action)
        running = view[0] == "COLLECTING"
        over = running and now >= view[2] + LEASE_MICROS
        seen = f"{failed(view[1]) if over else view[0]}|{view[1]}|{view[2]}"
        wakes = (waiting[-1][0] // 1000 + 1 if waiting else -1,
                 (view[2] + LEASE_MICROS) // 1000 if running and not over else -1)
        for old, new in zip((wake, lease), wakes):
            if old >= 0 and old not in wakes:
                self.handle.deleteTimer(old)
            if new >= 0 and new not in (wake, lease):
                self.handle.registerTimer(new)
        self.pending.put(waiting) if waiting else self.pending.clear()
        changed = seen != shown
        self.core.update((state, attempts, claimed, max(now, upto), seen, step + changed, *wakes))
        if changed or late:
            yield Row(attempt=key[0], state=failed(view[1]) if over else view[0], attempts=view[1],
                      claimed=view[2], step=step + changed, late=late)


def drain_lifecycle(stream: DataFrame, out: str, checkpoint: str, lateness: str) -> None:
    """Append state changes of attempts for all available events (attempt, event_id, ts, action), then stop.

    Events may come out of order by ``lateness``. However they are cut into batches the newest changes
    say what the batch fold says of the same events. No batch reads earlier events: what an attempt
    needs is in its state. A batch that runs again replaces its own folder.
    """
    # the derived time carries no watermark of its own, so events behind it reach their attempt, which counts them
    events = stream.withWatermark("ts", lateness).select(
        F.col("attempt").cast("string").alias("attempt"), F.unix_micros("ts").alias("ts"),
        F.col("event_id").cast("string").alias("event_id"), "action")
    # order of (time, id): ids of one length compare as numbers do
    events = events.withColumn("event_id", F.lpad("event_id", 20, "0"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(stream.sparkSession, STREAM_SETTINGS):
        query = (events.groupBy("attempt").transformWithState(Tracker(), UPDATES, "Update", "EventTime")
                 .writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    query.awaitTermination()


def latest(updates: DataFrame, as_of: Column) -> DataFrame:
    """Newest state per attempt; a claim whose lease has ended by ``as_of`` has failed."""
    newest = F.max_by(F.struct("state", "attempts", "claimed"), "step")
    rows = updates.groupBy("attempt").agg(newest.alias("s")).select(
        F.col("attempt").cast("long").alias("attempt"), "s.state", "s.attempts",
        F.timestamp_micros(F.col("s.claimed")).alias("last_attempted_at"))
    over = (F.col("state") == "COLLECTING") & (as_of >= F.col("last_attempted_at") + F.expr(LEASE))
    ended = F.when(F.col("attempts") >= MAX_ATTEMPTS, "TERMINAL_FAILURE").otherwise("RETRYABLE")
    return rows.withColumn("state", F.when(over, ended).otherwise(F.col("state")))
