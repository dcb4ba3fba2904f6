"""Session mistakes as a stream: the state of a session is its open failure, the edits of the last half hour, and events that wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.sessions import FAIL_SECONDS, REVERT_SECONDS

OUT = "session string, idx long, ts timestamp, file string, kind string, pre_event_idx long"
COLUMNS = ("ts", "idx", "event", "file", "sha_before", "sha_after", "exit")
STATE = "fail_ts double, fail_idx long, ts array<double>, idx array<long>, file array<string>, sha array<string>, waiting array<struct<ts:double,idx:long,event:string,file:string,sha_before:string,sha_after:string,exit:long>>"


def mistakes(events: DataFrame, watermark: str = "30 minutes", revert_seconds: float = REVERT_SECONDS, fail_seconds: float = FAIL_SECONDS, ordered: bool = False) -> DataFrame:
    """Mistakes of a stream of events (session, idx, ts, event, file, sha_before, sha_after, exit).

    Events later than the watermark are dropped. Without `ordered` a batch's events are judged at once, in order of time; an event that
    comes in a later batch than one after it is judged after that. With `ordered` events wait until the watermark has passed them, so
    they are judged in order of time across batches, as all at once would be. A session's state goes once the watermark has passed its last look-back.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fail_ts, fail_idx, *history, waiting = state.get if state.exists else (None, None, [], [], [], [], [])
        past = list(zip(*history, strict=True)) if len(history[0]) else []
        new = [] if state.hasTimedOut else [tuple(None if pd.isna(v) else v for v in (e.ts.timestamp(), *row[1:])) for b in batches for e in b.itertuples() for row in [tuple(getattr(e, c) for c in COLUMNS)]]
        every = sorted([*(tuple(w) for w in waiting), *new], key=lambda e: (e[0], e[1]))
        passed = state.getCurrentWatermarkMs() / 1000 if ordered else float("inf")
        due, waiting = [e for e in every if e[0] <= passed], [e for e in every if e[0] > passed]
        found = []
        for at, idx, event, file, before, after, exit_ in due:
            if event == "test_run":
                fail_ts, fail_idx = (at, int(idx)) if exit_ else (None, None)
            elif event == "edit":
                past = [p for p in past if at - p[0] <= revert_seconds]
                back = [p[1] for p in past if p[2] == file and p[3] == after]
                moment = pd.Timestamp(round(at * 1e6), unit="us")
                if back:
                    found.append((key[0], int(idx), moment, file, "reverted_edit", int(min(back))))
                if fail_ts is not None and at - fail_ts <= fail_seconds:
                    found.append((key[0], int(idx), moment, file, "failed_then_re_edited", fail_idx))
                past.append((at, int(idx), file, before))
        if state.hasTimedOut and not waiting:
            state.remove()
        else:
            columns = [list(c) for c in zip(*past, strict=True)] if past else [[], [], [], []]
            state.update((fail_ts, fail_idx, *columns, [(e[0], int(e[1]), *e[2:6], None if e[6] is None else int(e[6])) for e in waiting]))
            last = max([p[0] for p in past] + [fail_ts or 0.0]) + max(revert_seconds, fail_seconds)
            wake = min(e[0] for e in waiting) if waiting else last
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(wake * 1000)))
        yield pd.DataFrame(found, columns=["session", "idx", "ts", "file", "kind", "pre_event_idx"])

    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return own.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
