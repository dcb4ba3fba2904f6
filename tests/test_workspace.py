"""The tools, the facade, streams that start again, and searches over lists and codes."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann, sessions, vector
from corvane.plans import receipts, tools, workspace
from corvane.plans.engine import Engine
from corvane.sources.files import Source
from corvane.streaming import sync as stream
from corvane.streaming.sessions import mistakes

NAMES = {"search_code", "search_docs", "find_tests", "find_docs", "neighbors", "context", "impact", "brief_feature", "evaluate", "add_episode", "memory_add", "memory_query", "memory_revoke"}


@pytest.fixture
def box(spark, tmp_path):
    code = spark.createDataFrame([(i, f"src/m{i % 4}.py", "python", [float(i % 4), 1.0]) for i in range(12)] + [(50, "tests/test_m1.py", "python", [9.0, 1.0])], "id long, file_path string, language string, embedding array<float>")
    nodes = spark.createDataFrame([("a", "File", {"p": "1"}), ("b", "File", {"p": "2"})], "id string, label string, properties map<string,string>")
    edges = spark.createDataFrame([(1, "a", "b", "CONTAINS")], "edge_id long, src_id string, dst_id string, relationship string")
    fixtures = spark.createDataFrame([("f1", "code", "q", ["src/m0.py"]), ("f2", "code", "q", ["src/none.py"]), ("f3", "docs", "q", ["src/m0.py", "src/m1.py"])], "id string, category string, query string, expected array<string>")
    engine = Engine(code, code.limit(3), nodes, edges, lambda q: [0.0, 1.0])
    clock = iter(f"2024-01-01T00:00:{i:02d}Z" for i in range(60))
    return tools.Toolbox(engine, tools.Memory(spark, str(tmp_path / "memory")), str(tmp_path / "episodes"), lambda: next(clock), fixtures, receipts.HmacSigner(b"k"))


def test_thirteen_tools(box):
    assert set(box.tools) == NAMES
    arguments = {"search_code": {"query": "m1", "limit": 3}, "search_docs": {"query": "x"}, "find_tests": {"subject": "m1"}, "find_docs": {"subject": "m"}, "neighbors": {"node": "a"}, "context": {"entity": "a"}, "impact": {"target": "a"}, "brief_feature": {"feature": "m1"}, "evaluate": {}, "add_episode": {"name": "Demo", "body": "b"}, "memory_add": {"text": "remember"}, "memory_query": {"query": "remember"}, "memory_revoke": {"memory_id": "memory.x.1", "reason": "old"}}
    for name in sorted(NAMES):
        got = box.call(name, arguments[name])
        assert got["status"] == "ok" and got["tool"] == name, got
        assert ("receipt" in got) == (name not in box.unsigned)
        if "receipt" in got:
            assert receipts.verify(got, box.signer) == (True, "ok")
        assert box.tools[name].input_schema["type"] == "object" and box.tools[name].description


def test_bad_arguments_are_answers(box):
    assert box.call("search_code")["reason"] == "missing: query" and box.call("search_code", {"query": "x", "y": 1})["reason"] == "unknown: y"
    assert box.call("search_code", {"query": "x", "limit": 51})["status"] == "error" and box.call("nothing")["status"] == "error"
    assert box.call("add_episode", {"name": "x"})["status"] == box.call("memory_revoke", {"memory_id": "x"})["status"] == "error"


def test_memory_is_appended_and_revoked(box):
    first = box.call("memory_add", {"text": "alpha note", "session_id": "S 1"})["memory_id"]
    second = box.call("memory_add", {"text": "alpha again", "session_id": "S 1"})["memory_id"]
    assert (first, second) == ("memory.s-1.1", "memory.s-1.2")
    box.call("memory_revoke", {"memory_id": first, "reason": "wrong"})
    assert [r["id"] for r in box.call("memory_query", {"query": "alpha"})["results"]] == [second]


def test_evaluation(box):
    got = box.call("evaluate")
    assert got["metrics"]["fixture_count"] == 3 and got["misses"] == ["f2"] and got["metrics"]["categories"]["docs"] == "A" and got["grade"] == "F"
    assert box.call("evaluate", {"category": "docs"})["grade"] == "A" and box.call("evaluate", {"category": "none"})["state"] == "blocked-input"


def test_workspace(spark, tmp_path):
    for name, text in {"src/a.py": "def alpha():\n    return 1\n", "src/b.py": "class B:\n    x = 2\n", "docs/c.md": "# C\ntext\n", "node_modules/d.py": "x = 1"}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    space, source = workspace.Workspace(spark, "ws_test"), Source("p", str(tmp_path / "t"))
    assert space.ingest(source, reset=True) == {"code_chunks": 2, "doc_chunks": 1}
    (tmp_path / "t/src/a.py").write_text("def alpha():\n    return 2\n\n\ndef beta():\n    return 3\n")
    assert space.ingest(source) == {"code_chunks": 3, "doc_chunks": 1}
    for name in ("exact", "quantized"):
        assert {r.file_path for r in space.query("alpha", 5, backend=name).collect()} == {"src/a.py", "src/b.py"}
    nodes, edges = space.graph(source)
    assert nodes.count() == 4 and edges.count() == 3
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one.yml").write_text("id: one\ncategory: code\nquery: alpha\nexpected: [src/a.py, src/b.py]\n")
    assert space.evaluate(str(tmp_path / "f"))["grade"] == "A"
    (tmp_path / "n").mkdir()
    (tmp_path / "n/x.md").write_text("---\nid: x\ntype: spec\nnode-kind: Guard\n---\nbody\n")
    run = lambda n: space.sync(str(tmp_path / "n"), str(tmp_path / "state"), n, "2024-01-01T00:00:00Z", str(tmp_path / "audit"))
    assert run(0)["created"] == 1 and run(1)["created"] == 0
    (tmp_path / "n/x.md").rename(tmp_path / "n/y.md")
    assert {k: v for k, v in run(2).items() if k in ("renamed", "deleted", "created")} == {"renamed": 1, "deleted": 0, "created": 1}
    spark.sql("DROP DATABASE ws_test CASCADE")


def test_verify_command(tmp_path, capsys):
    signer = receipts.Ed25519Signer(b"s" * 32)
    path = tmp_path / "r.json"
    path.write_text(json.dumps(receipts.sign({"status": "ok", "results": []}, signer)))
    assert workspace.main(["verify", "--response", str(path), "--public-key", signer.public_key.hex()]) == 0
    path.write_text(json.dumps({**json.loads(path.read_text()), "results": [1]}))
    assert workspace.main(["verify", "--response", str(path), "--public-key", signer.public_key.hex()]) == 1 and "hash mismatch" in capsys.readouterr().out


def test_sync_goes_on_after_a_new_checkpoint(spark, tmp_path):
    schema, seen, gone, moved = "path string, content_hash string, node_id string", [], [], []
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    run = lambda snapshot, n, s: stream.run_batch(snapshot, str(tmp_path / "state"), n, [lambda d, b: seen.append(d.count())], [lambda d, b: gone.append(d.count())], "2024-01-01T00:00:00Z", [lambda d, b: moved.append(d.count())], s)
    run(frame(("a", "1", "x"), ("b", "1", "y"), ("c", "1", None)), 0, "s")
    run(frame(("a", "1", "x"), ("b", "1", "y"), ("c", "1", None)), 1, "s")
    run(frame(("a", "1", "x"), ("b2", "1", "y"), ("c", "1", None)), 2, "s")
    run(frame(("a", "1", "x"), ("b2", "1", "y"), ("c", "1", None)), 2, "s")  # again
    run(frame(("a", "2", "x"), ("b2", "1", "y")), 0, "new")
    run(frame(("a", "2", "x"), ("b2", "1", "y")), 1, "new")
    assert seen == [3, 0, 1, 1, 1, 0] and gone == [0, 0, 0, 0, 1, 0] and moved == [0, 0, 1, 1, 0, 0]
    left = {p.name for p in (tmp_path / "state").iterdir() if not p.name.startswith(".")}
    assert sum(n.startswith("version") for n in left) == stream.KEPT and sum(n.startswith("snapshot") for n in left) == 1


def test_ordered_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("s", 0, 0, "edit", "X", "Y", None), ("s", 1, 5, "test_run", None, None, 1), ("s", 2, 15, "edit", "Y", "X", None), ("s", 3, 8, "edit", "Q", "R", None), ("s", 4, 200, "edit", "A", "B", None)]
    events = spark.createDataFrame([(s, i, start + timedelta(minutes=t), e, "f", a, b, x) for s, i, t, e, a, b, x in rows], "session string, idx long, ts timestamp, event string, file string, sha_before string, sha_after string, exit int")
    for n, ids in enumerate(([0, 2], [1, 3], [4], [4])):  # what comes first is not what happened first
        events.filter(F.col("idx").isin(ids)).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {n // 3} HOUR")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = mistakes(source, ordered=True).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = {(r.idx, r.kind, r.pre_event_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.idx, r.kind, r.pre_event_idx) for r in sessions.mistakes(events).collect()}
    assert got == want and (3, "failed_then_re_edited", 1) in got and (2, "reverted_edit", 0) in got


def test_searches_of_lists_and_codes(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + r.normal(size=16) * 0.4).tolist()) for i in range(900)] + [(900, [0.0] * 16), (901, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = e.filter("vec_id % 20 = 0 and vec_id < 900").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vector.batch_top_k(e, asked, 8)
    assert ann.recall(ann.search_with("exact", e, asked, 8), exact) == 1.0
    assert ann.recall(ann.search_with("lists", e, asked, 8, lists=24, probes=6), exact) >= 0.9
    assert ann.recall(ann.search_with("quantized", e, asked, 8), exact) >= 0.9
    for bits in (4, 5, 8):
        codes = {x.id: x for x in ann.build_codes(e, bits=bits).collect()}
        for x in e.filter("vec_id < 30").select("vec_id", ann.quantize(F.col("embedding"), bits).alias("q")).collect():
            assert ann._unpacked([bytes(codes[x.vec_id].codes)], bits, 16)[0].tolist() == list(x.q.codes)
    with pytest.raises(ValueError, match="bits"):
        ann.build_codes(e, bits=1)


def test_engine_without_stores(spark):
    e = Engine(None, None, None, None, lambda q: [0.0, 1.0])
    assert e.search_code("x").count() == e.search_docs("x").count() == e.neighbors("a").count() == e.context("a").count() == e.impact("a").count() == 0
    assert e.brief("x").count() == 0 and e.snapshot("s").first()[0] == "s:code=0:0:doc=0:0"


def test_graph_folders(spark, tmp_path):
    from corvane.sources import sinks

    nodes = spark.createDataFrame([(f"n{i}", "AB"[i % 2], {"k": "v"}) for i in range(20)], "id string, label string, properties map<string,string>")
    edges = spark.createDataFrame([(i, f"n{i}", "n0", "R") for i in range(9)], "edge_id long, src_id string, dst_id string, relationship string")
    sinks.append_graph(nodes, edges, str(tmp_path))
    sinks.append_graph(nodes.limit(0), edges, str(tmp_path))
    assert {p.name for p in (tmp_path / "nodes").glob("label=*")} == {"label=A", "label=B"}
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 20 and spark.read.parquet(str(tmp_path / "edges")).count() == 18
