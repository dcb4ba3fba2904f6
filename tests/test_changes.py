"""File changes as a source, incremental sync, sinks of batches, and the sync command."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.plans import workspace
from corvane.sources import changes, files
from corvane.sources.commits import BatchSink
from corvane.sources.stored import GraphStore
from corvane.streaming import sync

NOTE = "---\nid: {0}\ntype: spec\nnode-kind: Guard\n---\n{1}\n"


def put(root, name, text, time=None):
    p = Path(root) / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if time:
        os.utime(p, ns=(time, time))
    return p


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- the source ---


def stream(spark, root, listings, checkpoint, seen, **options):
    changes.register(spark)
    source = spark.readStream.format("corvane_changes").option("path", str(root)).option("listings", str(listings)).options(**options).load()
    q = source.writeStream.foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.select("path", "change", "old_path", "content").collect())).option("checkpointLocation", str(checkpoint)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_only_changed_files_are_opened(spark, tmp_path):
    root, at = tmp_path / "my tree", (tmp_path / "listings", tmp_path / "checkpoint")
    for i in range(5):
        put(root, f"a/f {i}.txt", f"text {i}", (i + 1) * 10**18)
    put(root, "node_modules/x.txt", "never")
    seen = []
    stream(spark, root, *at, seen)
    assert sorted(r[1] for r in seen) == [f"a/f {i}.txt" for i in range(5)] and {r[2] for r in seen} == {"created"}
    stream(spark, root, *at, seen)  # a restart, and nothing has changed
    assert len(seen) == 5
    put(root, "a/f 3.txt", "other")
    stream(spark, root, *at, seen)
    assert [r[1:] for r in seen[5:]] == [("a/f 3.txt", "modified", None, b"other")]
    put(root, "new.txt", "n")
    (root / "a/f 0.txt").unlink()
    (root / "a/f 1.txt").rename(root / "b.txt")
    stream(spark, root, *at, seen)
    assert sorted(r[1:] for r in seen[6:]) == [("a/f 0.txt", "deleted", None, None), ("b.txt", "moved", "a/f 1.txt", b"text 1"), ("new.txt", "created", None, b"n")]
    assert sum(r[4] is not None for r in seen) == 5 + 1 + 2
    assert len(list(at[0].glob("*.parquet"))) <= changes.KEPT + 1


def test_reads_open_what_was_planned(tmp_path, monkeypatch):
    """Three triggers without Spark: each file that is opened is counted."""
    opened = []

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def open_input_stream(self, path):
            opened.append(Path(path).name)
            return self.fs.open_input_stream(path)

    for i in range(20):
        put(tmp_path / "t", f"{i}.txt", "x" * 100)
    tree = changes.Tree({"path": str(tmp_path / "t"), "partitionbytes": "500"})
    reader, plain = changes._Stream(tree, str(tmp_path / "l")), changes.file_system
    monkeypatch.setattr(changes, "file_system", lambda uri: (lambda fs, p: (Counting(fs), p))(*plain(uri)) if uri.endswith("/t") else plain(uri))

    def trigger(start):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        out = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        reader.commit(end)
        return end, len(parts), out

    end, parts, out = trigger(reader.initialOffset())
    assert len(opened) == len(out) == 20 and parts == 4
    put(tmp_path / "t", "7.txt", "changed")
    opened.clear()
    end, parts, out = trigger(end)
    assert opened == ["7.txt"] and [(r["path"], r["change"]) for r in out] == [("7.txt", "modified")]
    opened.clear()
    again, parts, out = trigger(end)
    assert again == end and parts == 0 and opened == []
    put(tmp_path / "t", "8.txt", "changed too")
    end = reader.latestOffset()
    (tmp_path / "t/8.txt").unlink()
    assert [r["change"] for p in reader.partitions(again, end) for b in reader.read(p) for r in b.to_pylist()] == ["vanished"]


def test_differences():
    d = lambda old, new: [r[:3] for r in changes.difference(old, new)]
    assert d({"a": (1, 1)}, {"b": (1, 1)}) == [("b", "moved", "a")]
    assert d({"a": (1, 1), "c": (1, 1)}, {"b": (1, 1)}) == [("a", "deleted", None), ("b", "created", None), ("c", "deleted", None)]
    assert d({"a": (1, 1)}, {"a": (2, 1), "b": (1, 1)}) == [("a", "modified", None), ("b", "created", None)]


def test_triggers_of_few_changes(spark, tmp_path):
    for i in range(7):
        put(tmp_path / "t", f"{i}.md", str(i))
    put(tmp_path / "t", "x.txt", "no note")
    put(tmp_path / "t", "old/y.md", "left out")
    seen = []
    stream(spark, tmp_path / "t", tmp_path / "l", tmp_path / "c", seen, include="*.md", exclude="old/**", maxFilesPerTrigger="3")
    assert sorted(r[1] for r in seen) == [f"{i}.md" for i in range(7)]
    assert sorted(sum(r[0] == n for r in seen) for n in {r[0] for r in seen}) == [1, 3, 3]
    batch = spark.read.format("corvane_changes").option("path", str(tmp_path / "t")).load()
    assert batch.count() == 9 and {r.change for r in batch.collect()} == {"created"}
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("corvane_changes").load().count()
    assert spark.read.format("corvane_changes").option("path", str(tmp_path / "none")).load().count() == 0


# --- sinks ---


def test_a_batch_is_replaced(spark, tmp_path):
    sink = BatchSink(spark, str(tmp_path / "s"), "kind string, n int", "kind")
    frame = lambda *r: spark.createDataFrame(list(r), "kind string, n int")
    assert sink.read().count() == 0
    assert [sink.write(frame(("a", 1), ("b", 2)), "s", 0), sink.write(frame(("a", 3)), "s", 1), sink.write(frame(("c", 9)), "t", 0)] == [2, 1, 1]
    assert sink.write(frame(("b", 5)), "s", 0) == 1 and sink.write(frame(), "s", 2) == 0
    assert rows(sink.read()) == [("a", 3), ("b", 5), ("c", 9)] and sink.batches("s") == [0, 1, 2] and sink.batches("t") == [0]
    frame(("z", 1)).write.partitionBy("kind").json(str(tmp_path / "s/data/corvane_run=s-000000000009-killed"))  # a run that was killed before its commit
    assert rows(sink.read()) == [("a", 3), ("b", 5), ("c", 9)]


def test_commits_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corvane.sources.commits.GATHER", 2)
    sink = BatchSink(spark, str(tmp_path / "s"), "n int")
    for i in range(4):
        sink.write(spark.createDataFrame([(i,)], "n int"), "s", i)
    sink.write(spark.createDataFrame([(70,)], "n int"), "s", 0)
    assert rows(sink.read()) == [(1,), (2,), (3,), (70,)] and len(list((tmp_path / "s/commits").glob("*.json"))) <= 3


# --- sync by changes ---


def _change(spark, *given):
    return spark.createDataFrame([(p, c, o, t) for p, c, o, t in given], "path string, change string, old_path string, content string")


def _describe(df):
    return df.withColumn("content_hash", F.sha2("content", 256)).withColumn("node_id", F.regexp_extract("content", r"id=(\w+)", 1)).withColumn("node_id", F.nullif("node_id", F.lit("")))


def test_changes_of_a_state(spark, tmp_path):
    state, seen = sync.state_table(spark, str(tmp_path / "state"), 4), []
    run = lambda n, *given: sync.run_changes(_change(spark, *given), state, n, _describe, [lambda d, b: seen.append(("records", b, rows(d.select("path", "status"))))], [lambda d, b: seen.append(("dead", b, rows(d.select("source_path", "id"))))], "2024-01-01T00:00:00Z", [lambda d, b: seen.append(("moves", b, rows(d.select("src", "dest"))))])
    run(0, ("a", "created", None, "id=x 1"), ("b", "created", None, "id=y 1"), ("c", "created", None, "z"))
    run(1, ("a", "modified", None, "id=x 2"), ("c", "modified", None, "z"))  # c was touched, its content is the same
    run(2, ("b2", "moved", "b", "id=y 1"), ("c", "deleted", None, None), ("d", "vanished", None, None))
    run(2, ("b2", "moved", "b", "id=y 1"))  # again: it was done
    run(3, ("a", "deleted", None, None), ("e", "created", None, "id=x 2"))  # a move that the source did not see
    assert [s[2] for s in seen if s[0] == "records"] == [[("a", "created"), ("b", "created"), ("c", "created")], [("a", "updated")], [("b2", "created")], [("e", "created")]]
    assert [s[2] for s in seen if s[0] == "dead"] == [[], [], [("c", None)], []]
    assert [s[2] for s in seen if s[0] == "moves"] == [[], [], [("b", "b2")], [("a", "e")]]
    assert rows(state.read().select("path", "node_id")) == [("b2", "y"), ("e", "x")]


def test_a_batch_killed_between_sinks(spark, tmp_path):
    state = sync.state_table(spark, str(tmp_path / "state"), 4)
    kept, dead = BatchSink(spark, str(tmp_path / "r"), "path string, status string"), BatchSink(spark, str(tmp_path / "d"), "source_path string")
    killed = []

    def deletions(df, n):
        if n == 1 and not killed:
            killed.append(n)
            raise KeyboardInterrupt
        dead.write(df.select("source_path"), "s", n)

    run = lambda n, *given: sync.run_changes(_change(spark, *given), state, n, _describe, [lambda d, b: kept.write(d.select("path", "status"), "s", b)], [deletions], "2024-01-01T00:00:00Z")
    run(0, ("a", "created", None, "1"), ("b", "created", None, "2"))
    second = [("a", "modified", None, "3"), ("b", "deleted", None, None)]
    with pytest.raises(KeyboardInterrupt):
        run(1, *second)
    assert state.done("0") == 0 and dead.batches("s") == [0]
    run(1, *second)
    run(1, *second)
    assert rows(kept.read()) == [("a", "created"), ("a", "updated"), ("b", "created")] and rows(dead.read()) == [("b",)]


def test_sync_command_three_times(spark, tmp_path, capsys):
    """Each run without a batch goes on from the last: nothing is created twice, and deletions are told."""
    root = tmp_path / "my vault"
    for n in "xyz":
        put(root, f"some notes/{n} 1.md", NOTE.format(n, "body"))
    told = []

    def run(*more):
        assert workspace.main(["sync", "--root", str(root), "--state", str(tmp_path / "state"), "--audit", str(tmp_path / "audit"), *more]) == 0
        told.append(json.loads(capsys.readouterr().out.splitlines()[-1]))
        return {k: told[-1][k] for k in ("created", "updated", "deleted", "renamed")}

    assert run() == {"created": 3, "updated": 0, "deleted": 0, "renamed": 0}
    assert run() == {"created": 0, "updated": 0, "deleted": 0, "renamed": 0}
    (root / "some notes/x 1.md").unlink()
    put(root, "some notes/y 1.md", NOTE.format("y", "new body"))
    assert run() == {"created": 0, "updated": 1, "deleted": 1, "renamed": 0}
    assert run("--batch", "2") == {"created": 0, "updated": 1, "deleted": 1, "renamed": 0}  # the same batch replaces what it wrote
    space = workspace.Workspace(spark, "sync")
    records, gone, _ = space._sinks(str(tmp_path / "audit"), "sync", {})
    tombs = BatchSink(spark, str(tmp_path / "audit/tombstones"), "id string, deleted_at timestamp, source_path string, last_known_hash string, reason string, deleted_date date", "deleted_date")
    assert rows(tombs.read().select("id", "source_path", "reason")) == [("x", "some notes/x 1.md", "offline_prune")]
    assert BatchSink(spark, str(tmp_path / "audit/records"), "target string, payload string", "target").read().count() == 4


def test_watch_command(spark, tmp_path, capsys):
    root = tmp_path / "my vault"
    run = lambda: workspace.main(["watch", "--once", "--root", str(root), "--state", str(tmp_path / "state"), "--audit", str(tmp_path / "audit"), "--checkpoint", str(tmp_path / "c")])
    told = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    for n in "xy":
        put(root, f"{n} 1.md", NOTE.format(n, "body"))
    assert run() == 0 and told()["created"] == 2
    (root / "x 1.md").rename(root / "z 1.md")
    (root / "y 1.md").unlink()
    assert run() == 0 and {k: v for k, v in told().items() if k in ("renamed", "deleted")} == {"renamed": 1, "deleted": 1}
    assert rows(sync.state_table(spark, str(tmp_path / "state/files")).read().select("path", "node_id")) == [("z 1.md", "x")]


def test_damaged_state(spark, tmp_path):
    schema, seen = "path string, content_hash string, node_id string", []
    run = lambda n: sync.run_batch(spark.createDataFrame([("a", "1", "x")], schema), str(tmp_path / "s"), n, [lambda d, b: seen.append(d.count())], [], "2024-01-01T00:00:00Z")
    run(0)
    run(1)
    for p in (tmp_path / "s").glob("version-*-1/*.parquet"):
        p.write_bytes(b"broken")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning, match="damaged"):
        run(2)
    for p in (tmp_path / "s").glob("version-*/*.parquet"):
        p.write_bytes(b"broken")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning, match="damaged"):
        run(3)
    assert seen == [1, 0, 0, 1]


# --- names of files ---


def test_paths_with_spaces(spark, tmp_path):
    root = tmp_path / "my vault"
    put(root, "my notes/c d+e%20.md", NOTE.format("n", "b"))
    assert [r.path for r in files.note_files(spark, str(root)).collect()] == ["my notes/c d+e%20.md"]
    put(root, "s 1.jsonl", "\n".join(json.dumps({"t": "2024-01-01T00:00:00Z", "event": f"e{i}"}) + "\n" * (i % 2) for i in range(2_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = files.sessions(spark, str(root / "s 1.jsonl"))
        assert got.rdd.getNumPartitions() >= 1
        found = {r.idx: (r.session, r.event) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {i: ("s 1", f"e{i}") for i in range(2_000)}


# --- stored graphs and chunks ---


def test_stored_graph(spark, tmp_path):
    g = GraphStore(spark, str(tmp_path / "g"), 8)
    node = lambda *r: spark.createDataFrame([(i, "N", p) for i, p in r], "id string, label string, properties map<string,string>")
    edge = lambda *r: spark.createDataFrame([(a, b, "R") for a, b in r], "src_id string, dst_id string, relationship string")
    g.upsert_nodes(node(*((f"n{i}", {"k": "1"}) for i in range(20))))
    before = g.nodes.manifest()["parts"]
    g.upsert_nodes(node(("n3", {"k": "2", "m": "x"}), ("new", {})))
    changed = [b for b, p in g.nodes.manifest()["parts"].items() if before.get(b) != p]
    assert 1 <= len(changed) <= 2
    assert {r.id: r.properties for r in g.nodes.read().filter("id in ('n3', 'new', 'n4')").collect()} == {"n3": {"k": "2", "m": "x"}, "new": {}, "n4": {"k": "1"}}
    g.upsert_edges(edge(*((f"n{i}", f"n{i + 1}") for i in range(19)), ("n0", "nowhere"), ("n0", "n1")))
    assert g.edges().count() == 19 and g.into.read().count() == 19
    assert rows(g.near(spark.createDataFrame([("n5",)], "id string"), 2)) == [("n3", 2), ("n4", 1), ("n5", 0), ("n6", 1), ("n7", 2)]
    out, into = g.out.manifest()["parts"], g.into.manifest()["parts"]
    g.delete_nodes(spark.createDataFrame([("n5",)], "id string"))
    assert g.edges().count() == g.into.read().count() == 17 and g.nodes.read().count() == 20
    assert sum(g.out.manifest()["parts"].get(b) != p for b, p in out.items()) <= 2 and sum(g.into.manifest()["parts"].get(b) != p for b, p in into.items()) <= 2


def test_a_deletion_that_broke_off(spark, tmp_path, monkeypatch):
    g = GraphStore(spark, str(tmp_path / "g"), 4)
    g.upsert_nodes(spark.createDataFrame([(x, "N", {}) for x in "abcd"], "id string, label string, properties map<string,string>"))
    g.upsert_edges(spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "d", "R")], "src_id string, dst_id string, relationship string"))
    gone, broke = spark.createDataFrame([("b",)], "id string"), type(g.into).delete

    def fail(self, *given):
        if self is g.into:
            raise KeyboardInterrupt
        return broke(self, *given)

    monkeypatch.setattr(type(g.into), "delete", fail)
    with pytest.raises(KeyboardInterrupt):
        g.delete_nodes(gone, ("w", 1))
    monkeypatch.setattr(type(g.into), "delete", broke)
    g.delete_nodes(gone, ("w", 1))
    assert rows(g.edges()) == rows(g.into.read()) == [("c", "d", "R")] and sorted(r.id for r in g.nodes.read().collect()) == ["a", "c", "d"]
