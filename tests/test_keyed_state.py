"""Session mistakes with state by key: results of the batch operator, restarts, and what is left in the state."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import sessions
from corvane.streaming.keyed import PROVIDER, keyed_mistakes

SCHEMA = "session string, idx long, ts timestamp, event string, file string, sha_before string, sha_after string, exit int"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get(PROVIDER, None)
    yield
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run(spark, home, batches):
    """Each batch is a run of its own, so every one starts again from the checkpoint; progress of the last trigger of each."""
    told = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(home / f"in/{n:03d}"))
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).json(str(home / "in"))
        q = keyed_mistakes(source).writeStream.format("parquet").option("checkpointLocation", str(home / "c")).option("path", str(home / "out")).start()
        try:
            q.processAllAvailable()
            told.append(json.loads(q.lastProgress.json) if q.lastProgress else {})
        finally:
            q.stop()
    return {(r.session, r.idx, r.kind, r.pre_event_idx) for r in spark.read.parquet(str(home / "out")).collect()}, told


def test_equals_batch_over_restarts(spark, tmp_path):
    r, rows = random.Random(7), []
    for s in "abc":
        at = 0
        for i in range(25):
            at += r.randint(0, 9)
            event = r.choice(["edit", "edit", "edit", "test_run", "tool_call"])
            sha = (r.choice("XYZ"), r.choice(["X", "Y", "Z", None])) if event == "edit" else (None, None)
            rows.append((s, i, START + timedelta(minutes=at, seconds=i), event, r.choice("fg") if event == "edit" else None, *sha, r.choice([0, 1]) if event == "test_run" else None))
    r.shuffle(rows)  # within the watermark what comes first is not what happened first
    last = max(x[2] for x in rows)
    near = sorted(rows, key=lambda x: (x[2] + timedelta(minutes=r.randint(0, 25))))
    batches = [near[:30], near[30:55], near[55:]]
    flush = [[("z", n, last + timedelta(hours=n + 2), "tool_call", None, None, None, None)] for n in range(2)]
    got, _ = run(spark, tmp_path, batches + flush)
    want = {(x.session, x.idx, x.kind, x.pre_event_idx) for x in sessions.mistakes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len({k[2] for k in got}) == 2


def test_state_follows_what_an_event_concerns(spark, tmp_path):
    """200 files wait in a session; an edit of one changes a few entries, and when time has passed the state is empty."""
    many = [("s", i, START + timedelta(seconds=i), "edit", f"f{i}", "X", "Y", None) for i in range(200)]
    later = START + timedelta(minutes=36)
    one = [("s", 500, START + timedelta(minutes=7), "edit", "f3", "Y", "X", None)]
    batches = [many, [("t", 0, later, "tool_call", None, None, None, None)], one + [("t", 1, later, "tool_call", None, None, None, None)], [("t", 2, later + timedelta(hours=3), "tool_call", None, None, None, None)], [("t", 3, later + timedelta(hours=9), "tool_call", None, None, None, None)]]
    got, told = run(spark, tmp_path, batches)
    assert got == {("s", 500, "reverted_edit", 3)}
    state = [t["stateOperators"][0] for t in told if t.get("stateOperators")]
    assert state[1]["numRowsTotal"] >= 200 and state[2]["numRowsUpdated"] < 20
    assert state[-1]["numRowsTotal"] < 10
