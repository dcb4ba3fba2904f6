"""Session mistakes as a stream with state by key: an event reads and writes the entries that it concerns, not its session's whole history.

A session has a value, its open failure; a map from a file and the content that an edit began from to those edits; and a map of the events that wait
for the watermark. A timer stands at the earliest waiting event, and at the time when the oldest edits are of no more use. State is kept by RocksDB, so it may
exceed memory, and a checkpoint writes what has changed.

Results are those of `sessions.mistakes(..., ordered=True)`: events are judged in order of time once the watermark has passed them, later ones are
dropped. A session without failure, edits and waiting events has no state. Null files and contents are like any others; events without a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.sessions import FAIL_SECONDS, REVERT_SECONDS
from corvane.streaming.sessions import OUT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FAILURE = "us long, idx long"
CONTENT, EDITS = "file string, sha string", "us array<long>, idx array<long>"
PLACE, EVENT = "us long, idx long", "event string, file string, sha_before string, sha_after string, exit long"


class Mistakes(StatefulProcessor):
    def __init__(self, revert_seconds: float, fail_seconds: float):
        self.revert, self.fail = round(revert_seconds * 1_000_000), round(fail_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failure = handle.getValueState("failure", FAILURE)
        self.edits = handle.getMapState("edits", CONTENT, EDITS)
        self.waiting = handle.getMapState("waiting", PLACE, EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.us, r.idx), (r.event, r.file, r.sha_before, r.sha_after, r.exit))
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())

    def _judge(self, key, watermark: int) -> Iterator[Row]:
        """Mistakes of the events that the watermark has passed, in order."""
        every = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator())
        due = [x for x in every if x[0][0] <= watermark * 1000]
        for place, event in due:
            yield from self._event(key, *place, *event)
            self.waiting.removeKey(place)
        self._tidy(watermark, every[len(due)][0][0] if len(due) < len(every) else None)

    def _event(self, key, us: int, idx: int, event: str, file, before, after, exit_) -> Iterator[Row]:
        if event == "test_run":
            if exit_:
                self.failure.update((us, idx))
            elif self.failure.exists():
                self.failure.clear()
        if event != "edit":
            return
        at = datetime.fromtimestamp(us / 1_000_000, timezone.utc)
        row = lambda kind, old: Row(session=key[0], idx=idx, ts=at, file=file, kind=kind, pre_event_idx=old)
        back = [i for t, i in self._of(file, after) if us - t <= self.revert]
        if back:
            yield row("reverted_edit", min(back))
        failed = self.failure.get() if self.failure.exists() else None
        if failed and us - failed[0] <= self.fail:
            yield row("failed_then_re_edited", failed[1])
        left = [(t, i) for t, i in self._of(file, before) if us - t <= self.revert] + [(us, idx)]
        self.edits.updateValue((file, before), ([t for t, _ in left], [i for _, i in left]))

    def _of(self, file, sha) -> list[tuple[int, int]]:
        found = self.edits.getValue((file, sha)) if self.edits.containsKey((file, sha)) else None
        return list(zip(found[0], found[1], strict=True)) if found else []

    def _tidy(self, watermark: int, next_event: int | None) -> None:
        """One timer: at the next waiting event, else when what is kept has no more use. Edits and failures go when no later event can look back to them."""
        timers = list(self.handle.listTimers())
        wake = None
        if next_event is not None:
            wake = -(-next_event // 1000)
        elif not any(t > watermark for t in timers):
            ends = []
            for k, (times, _) in [(tuple(k), v) for k, v in self.edits.iterator()]:
                if max(times) + self.revert < watermark * 1000:
                    self.edits.removeKey(k)
                else:
                    ends.append(max(times) + self.revert)
            if self.failure.exists():
                end = self.failure.get()[0] + self.fail
                if end < watermark * 1000:
                    self.failure.clear()
                else:
                    ends.append(end)
            if ends:
                wake = max(ends) // 1000 + 1
        if wake is not None:
            for t in timers:
                if t > wake:
                    self.handle.deleteTimer(t)
            if wake not in timers:
                self.handle.registerTimer(max(wake, watermark + 1))


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which keyed state needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def keyed_mistakes(events: DataFrame, watermark: str = "30 minutes", revert_seconds: float = REVERT_SECONDS, fail_seconds: float = FAIL_SECONDS) -> DataFrame:
    """Mistakes of a stream of events (session, idx, ts, event, file, sha_before, sha_after, exit)."""
    use_rocksdb(events.sparkSession)
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null").withWatermark("ts", watermark)
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = own.select(text("session"), "ts", F.unix_micros("ts").alias("us"), F.col("idx").cast("long").alias("idx"), text("event"), text("file"), text("sha_before"), text("sha_after"), F.col("exit").cast("long").alias("exit"))
    return rows.groupBy("session").transformWithState(Mistakes(revert_seconds, fail_seconds), OUT, "Append", "EventTime")
