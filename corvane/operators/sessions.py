"""Session analytics: edits that were taken back, failures that were edited again, and rates over sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVERT_SECONDS, FAIL_SECONDS = 30 * 60, 10 * 60


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def reverted_edits(edits: DataFrame, seconds: float = REVERT_SECONDS) -> DataFrame:
    """Edits (session, idx, ts, file, sha_before, sha_after) whose result an earlier edit of the file began from, at most `seconds` before.

    An equi-join on (session, file, sha); the time bound and the order are join conditions, and only the earliest matching edit is kept.
    """
    now = edits.select("session", "file", "idx", "ts", "sha_before", "sha_after")
    then = edits.select("session", "file", F.col("sha_before").alias("sha_after"), F.col("idx").alias("_i"), F.col("ts").alias("_t"))
    close = (F.col("_i") < F.col("idx")) & (_seconds(F.col("ts")) - _seconds(F.col("_t")) <= seconds)
    return now.join(then, ["session", "file", "sha_after"]).filter(close).groupBy("session", "file", "idx", "ts", "sha_after").agg(F.min("_i").alias("pre_event_idx")).withColumn("kind", F.lit("reverted_edit"))


def failed_then_reedited(events: DataFrame, seconds: float = FAIL_SECONDS) -> DataFrame:
    """Edits after a failed test run that no later run has passed, at most `seconds` after it: an as-of lookup by window."""
    w = Window.partitionBy("session").orderBy("ts", "idx").rowsBetween(Window.unboundedPreceding, -1)
    run = F.when(F.col("event") == "test_run", F.struct("ts", "idx", "exit"))
    seen = events.withColumn("_r", F.last(run, ignorenulls=True).over(w))
    late = _seconds(F.col("ts")) - _seconds(F.col("_r.ts"))
    return seen.filter((F.col("event") == "edit") & (F.col("_r.exit") != 0) & (late <= seconds)).select("session", "file", "idx", "ts", F.col("_r.idx").alias("pre_event_idx"), F.lit("failed_then_re_edited").alias("kind"))


def mistakes(events: DataFrame, revert_seconds: float = REVERT_SECONDS, fail_seconds: float = FAIL_SECONDS) -> DataFrame:
    """Both kinds in order of time; at equal times a revert comes first."""
    edits = events.filter("event = 'edit'")
    names = ["session", "idx", "ts", "file", "kind", "pre_event_idx"]
    both = reverted_edits(edits, revert_seconds).select(*names, F.lit(0).alias("seq")).unionAll(failed_then_reedited(events, fail_seconds).select(*names, F.lit(1).alias("seq")))
    return both.orderBy("session", "ts", "seq", "idx")


def repeated_mistake_rate(found: DataFrame, documented: Column, sessions: int, least: int = 20) -> DataFrame:
    """Mistakes and documented ones by kind, with the total; blocked below `least` sessions."""
    agg = found.rollup("kind").agg(F.count("*").alias("mistakes"), F.count_if(documented).alias("documented"))
    rate = F.coalesce(F.try_divide("documented", "mistakes"), F.lit(0.0))
    return agg.select(F.coalesce("kind", F.lit("all")).alias("kind"), "mistakes", "documented", F.round(rate, 6).alias("rate"), F.lit("ok" if sessions >= least else "blocked-input").alias("status"))


def last_sessions(sessions: DataFrame, name: str = "session", keep: int = 50) -> DataFrame:
    """Rows of the last `keep` sessions by name: a top-k of the names, joined back."""
    names = sessions.select(name).distinct().orderBy(F.desc(name)).limit(keep)
    return sessions.join(F.broadcast(names), name, "left_semi")  # `keep` rows


def pre_context(events: DataFrame, payload: Column, chars: int = 4_000) -> DataFrame:
    """For each event the last `chars` characters of the session's events before it, as a JSON list. One ordered pass, which remembers `chars` characters; null payloads count as none."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.select("session", "idx", "ts", payload.cast("string").alias("_p")).repartition("session").sortWithinPartitions("session", "ts", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text = object(), ""
        for b in batches:
            out = []
            for session, added in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if session != now:
                    now, text = session, "["
                out.append((text + "]")[-chars:])
                if added is not None:
                    text = (text + added if text == "[" else f"{text},{added}")[-chars - 1 :]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["session", "idx", "context"])

    return rows.mapInArrow(run, f"session {kinds['session']}, idx {kinds['idx']}, context string")


def tail(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("idx")).limit(n)
