"""Truth tables of single operators on small inline tables."""

import fnmatch
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.prior import NamedFile, Prior
from corvane.functions.vectors import checked, cosine, hash_embedding
from corvane.operators import audit, chunking, evals, graph, memory, notes, sessions, sync, vector
from corvane.plans import receipts
from corvane.plans.engine import Engine
from corvane.plans.registry import Registry, load_plugins
from corvane.sources import sinks
from corvane.sources.files import ConfigError, fixtures, ingest, load_sources, malformed, merged_fixtures, parsed, tree
from corvane.sources.files import sessions as read_sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Vectors


def vectors(spark):
    rows = [(1, "a", "t1", [1.0, 0.0], '{"k": {"a": 1}}'), (2, "b", "t2", [0.0, 1.0], '{"k": {"a": 2}}'), (3, "c", "t1", [0.9, 0.1], None)]
    return spark.createDataFrame(rows, "id long, text string, tenant string, embedding array<float>, properties string")


def test_cosine_order_and_allowlist(spark):
    rows = vector.scored(vectors(spark), [1.0, 0.0])
    assert [r.id for r in vector.top_k(rows, 3, "id").collect()] == [1, 3, 2]
    some = vector.allowed(rows, spark.createDataFrame([(2,), (3,)], "id long"))
    assert [r.id for r in vector.top_k(some, 3, "id").collect()] == [3, 2]


def test_cosine_of_zero_vector_is_zero(spark):
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_filters(spark):
    ids = lambda **k: {r.id for r in vector.with_filters(vectors(spark), **k).collect()}
    assert ids(tenant="t2") == {2} and ids() == {1, 2, 3} and ids(tenant="") == set()
    assert ids(properties={"k": {"a": 2}}) == {2}


def test_batch_top_k_equals_single_queries(spark):
    r = random.Random(1)
    v = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4)], "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vector.batch_top_k(v, q, 7).collect()
    for row in q.collect():
        want = [x.vec_id for x in vector.top_k(vector.scored(v, row.embedding), 7, "vec_id").collect()]
        assert [g.id for g in sorted((g for g in got if g.query_id == row.query_id), key=lambda g: g["rank"])] == want
    assert vector.batch_top_k(v, q.limit(0), 7).count() == 0


def test_upsert_replaces_by_id(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    assert {(r.id, r.v) for r in vector.upsert_latest(old, new, "id").collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_dimension_check_fails_the_job(spark):
    with pytest.raises(Exception, match="embedding of length"):
        spark.range(1).select(checked(F.array(F.lit(1.0)), 2)).collect()


def test_hash_embedding_pads(spark):
    got = one(spark, hash_embedding(F.lit("a"), 40))
    assert len(got) == 40 and got[33] == 0.0 and got[0] == (0xCA - 128) / 128


def test_find_tests_falls_back(spark):
    hits = spark.createDataFrame([("src/a.py",), ("tests/test_b.py",)], "file_path string")
    assert [r.file_path for r in vector.find_tests(hits, "b").collect()] == ["tests/test_b.py"]
    assert vector.find_tests(hits.filter("file_path = 'src/a.py'"), "zzz").count() == 1


# Paths, globs, prior


@pytest.mark.parametrize(("path", "pattern", "expected"), [("decisions/a.md", "decisions/**/*.md", True), ("decisions/x/y/a.md", "decisions/**/*.md", True), ("a.md", "**/*.md", True), ("docs", "docs/**", True), ("docs/a/b", "docs/**", True), ("src/a/b.py", "src/*.py", True), ("src/a/b.py", "src/**/c.py", False), ("a[1].md", "a[[]1].md", True), ("b.md", "[!a].md", True)])
def test_glob(spark, path, pattern, expected):
    assert one(spark, tx.glob_match(F.lit(path), pattern)) is expected
    if "**" not in pattern:
        assert fnmatch.fnmatchcase(path, pattern) is expected


def test_skipped_and_documents(spark):
    assert one(spark, tx.is_skipped(F.lit("a/node_modules/b.js"))) and not one(spark, tx.is_skipped(F.lit("a/my_build/b")))
    assert one(spark, tx.is_document(F.lit("docs/x.py"), F.lit("python"))) and not one(spark, tx.is_document(F.lit("src/x.py"), F.lit("python")))


def test_binary_text_reads_as_null(spark):
    df = spark.createDataFrame([(bytearray(b"a\x00b"),), (bytearray(b"caf\xff"),)], "c binary").select(tx.readable_text(F.col("c")).alias("t"))
    assert [r.t for r in df.collect()] == [None, "caf�"]


@pytest.mark.parametrize(("path", "query", "score"), [("src/eval/fixtures/a.yml", "x", -0.70), ("tests/test_auth.py", "how does auth work", -0.55 + 0.08), ("tests/test_auth.py", "tests/test_auth.py", 0.70 + 0.45 + 0.10 + 0.30 + 0.16 + 0.20), ("Makefile", "what", -0.50), ("infra/Dockerfile", "docker compose up", 0.0), ("plan.md", "goals", -0.25), ("decisions/adr-1.md", "which decision", 0.25), ("./a\\b.py", "zzz", 0.0)])
def test_path_prior(spark, path, query, score):
    assert one(spark, Prior().score(F.lit(path), F.lit(query))) == pytest.approx(score)


def test_named_file_rules(spark):
    p = Prior(named=(NamedFile("gateway.py", ("8111",), 0.4),))
    assert one(spark, p.score(F.lit("x/gateway.py"), F.lit("port 8111"))) == pytest.approx(0.4)


# Chunks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t", max_size=30), max_size=60), st.integers(10, 80), st.integers(0, 3))
def test_packed_chunks_cover_all_text(rows, most, overlap):
    text = "\n".join(rows)
    chunks = chunking.pack(text, most, overlap)
    if not text.strip():
        assert chunks == []
        return
    lines, seen = text.splitlines(), set()
    for c in chunks:
        assert 1 <= c.line_start <= c.line_end <= len(lines)
        seen |= set(range(c.line_start, c.line_end + 1))
    assert {i for i, x in enumerate(lines, 1) if x.strip()} <= seen


def test_long_text_overlaps():
    text = "\n".join(f"line {i} of the text" for i in range(400))
    chunks = chunking.pack(text, 500, 2)
    assert len(chunks) > 1 and chunks[1].line_start <= chunks[0].line_end


def test_one_oversized_line_makes_progress():
    assert [(c.line_start, c.line_end) for c in chunking.pack("x" * 50 + "\n" + "y" * 50, 20, 2)] == [(1, 1), (2, 2)]


def test_markdown_headings_outside_fences():
    text = "intro\n# One\n```\n# not\n~~~\n```\n## Two ##\nbody"
    assert [(c.name, c.kind, c.line_start, c.line_end) for c in chunking.chunk_markdown(text)] == [("<preamble>", "preamble", 1, 1), ("One", "h1", 2, 6), ("Two", "h2", 7, 8)]


def test_python_decorators_are_absorbed():
    text = "import x\n\n@cached\n@other\ndef f():\n    def g(): pass\n\nclass A:\n    def m(self): pass\nasync def h(): pass"
    assert [(c.name, c.kind, c.line_start) for c in chunking.chunk_python(text)] == [("<module>", "module", 1), ("f", "function", 3), ("A", "class", 8), ("h", "function", 10)]


def test_typescript_units():
    text = "import a\n@Dec()\nexport class B {}\nexport default async function c() {}\ntype D = 1\nconst e = () => 1\n  const inner = 2\ndeclare enum F {}"
    assert [(c.name, c.kind) for c in chunking.chunk_typescript(text)] == [("<module>", "module"), ("B", "class"), ("c", "function"), ("D", "type"), ("e", "binding"), ("F", "enum")]


def test_config_sections():
    text = "top\nbuild:\n\tgo\nFROM alpine AS x\n# ====\n[tool.a]\nk=1"
    assert [(c.name, c.line_start, c.line_end) for c in chunking.chunk_config(text)] == [("chunk#1", 1, 1), ("build", 2, 3), ("alpine", 4, 4), ("chunk#4", 5, 5), ("chunk#5", 6, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=12), min_size=1, max_size=40))
def test_split_units_keep_every_line_once(rows):
    unit = chunking.Chunk("u", "k", 5, 4 + len(rows), "\n".join(rows))
    parts = chunking.split_unit(unit, 20)
    if len(parts) > 1:
        spans = [(c.line_start, c.line_end) for c in parts]
        assert spans[0][0] == 5 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_ranges_cover_without_gaps(spark):
    got = one(spark, chunking.boundaries_to_ranges(F.array(F.lit(4), F.lit(9), F.lit(4)), F.lit(10)))
    assert [(r.line_start, r.line_end) for r in got] == [(1, 3), (4, 8), (9, 10)]


def test_lines_like_splitlines(spark):
    for text in ("", "a", "a\n", "a\n\nb", "a\r\nb\rc", "\n"):
        assert one(spark, tx.lines(F.lit(text))) == text.splitlines()


# Graph


def star(spark):
    nodes = spark.createDataFrame([("a", "L", {"p": "1"}), ("b", "L", {}), ("c", "M", {})], "id string, label string, properties map<string,string>")
    edges = spark.createDataFrame([(1, "a", "b", "R"), (2, "b", "c", "R"), (3, "c", "a", "S")], "edge_id long, src_id string, dst_id string, relationship string")
    return nodes, edges


def test_paths_do_not_reuse_edges(spark):
    _, edges = star(spark)
    found = graph.paths(edges, spark.createDataFrame([("a",)], "id string"), 3).collect()
    assert {tuple(r.edges) for r in found} == {(1,), (3,), (1, 2), (3, 2), (1, 2, 3), (3, 2, 1)}
    assert graph.paths(edges, spark.createDataFrame([("a",)], "id string"), 0).count() == 2


def test_upserts_and_deletes(spark):
    nodes, edges = star(spark)
    new = spark.createDataFrame([("a", "L", {"p": "2", "q": "3"}), ("d", "L", None)], nodes.schema)
    got = {r.id: r.properties for r in graph.upsert_nodes(nodes, new).collect()}
    assert got["a"] == {"p": "2", "q": "3"} and got["d"] == {} and len(got) == 4
    ends = spark.createDataFrame([("a", "zz", "R"), ("a", "c", "R"), ("a", "b", "R")], "src_id string, dst_id string, relationship string")
    assert graph.upsert_edges(edges, ends, nodes).count() == 4
    left, kept = graph.delete_node(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert left.count() == 2 and [r.edge_id for r in kept.collect()] == [3]
    assert graph.existence_violations(nodes, "L", F.element_at("properties", "p")).count() == 1


def test_impact_classifies(spark):
    nodes = spark.createDataFrame([("file:x", "File"), ("t", "TestCase"), ("doc:1", "Page")], "id string, label string")
    edges = spark.createDataFrame([(1, "file:x", "t", "R"), (2, "file:x", "doc:1", "R")], "edge_id long, src_id string, dst_id string, relationship string")
    got = graph.impact(nodes, edges, spark.createDataFrame([("file:x", 0), ("x", 1)], "id string, rank int"))
    assert {(r.id, r.section) for r in got.collect()} == {("t", "tests"), ("doc:1", "docs")}
    assert graph.impact_candidates("x") == ["file:x", "crate:x", "x"]


def test_file_projection(spark):
    files = spark.createDataFrame([("crates/a/x.rs", "rust"), ("crates/a/y.rs", "rust")], "path string, language string")
    nodes, edges = graph.project_files(files, F.split("path", "/")[1])
    assert nodes.count() == 3 and edges.count() == 2


# Sessions


def log(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "session string, idx long, ts timestamp, event string, file string, sha_before string, sha_after string, exit int")


def at(minutes, seconds=0):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes, seconds=seconds)


@pytest.mark.parametrize(("minutes", "seconds", "file", "n"), [(15, 0, "f", 1), (30, 0, "f", 1), (30, 1, "f", 0), (35, 0, "f", 0), (15, 0, "g", 0)])
def test_reverts(spark, minutes, seconds, file, n):
    rows = [(at(0), "edit", "f", "X", "Y", None), (at(minutes, seconds), "edit", file, "Y", "X", None)]
    assert sessions.reverted_edits(log(spark, rows)).count() == n


@pytest.mark.parametrize(("rows", "n"), [([(0, 1), (5, None)], 1), ([(0, 1), (10, None)], 1), ([(0, 1), (3, 0), (5, None)], 0), ([(0, 1), (12, None)], 0)])
def test_failures(spark, rows, n):
    events = [(at(m), "edit" if x is None else "test_run", "f", "a", "b", x) for m, x in rows]
    assert sessions.failed_then_reedited(log(spark, events)).count() == n


def test_no_mistakes_rate(spark):
    got = sessions.repeated_mistake_rate(log(spark, []).withColumn("kind", F.lit("k")), F.lit(True), 3).collect()
    assert got == [] or got[0].rate == 0.0


# Evaluations


def test_metrics(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id long, item string")
    got = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "a", 9), (2, "z", 6)], "query_id long, item string, rank int")
    assert {(r.query_id, r.precision, r.mrr) for r in evals.ranked_scores(want, got).collect()} == {(1, 0.5, 0.5), (2, 0.0, 0.0)}


def test_disagreement_is_strict(spark):
    rows = [(1, "d", "A", 5), (1, "d", "B", 3), (1, "d", "C", 4), (2, "d", "A", 3), (2, "d", "B", 4), (3, "d", "A", 1)]
    got = {r.run: r.disagrees for r in evals.rater_disagreement(spark.createDataFrame(rows, "run int, dimension string, rater string, score int")).collect()}
    assert got == {1: True, 2: False, 3: False}
    none = evals.rater_pair_rate(spark.createDataFrame(rows[:0], "run int, dimension string, rater string, score int"), "B", "C").first()
    assert none.pairs == 0 and none.rate is None


def test_confusion_of_nothing(spark):
    got = evals.confusion(spark.createDataFrame([], "p boolean, a boolean"), F.col("p"), F.col("a")).first()
    assert (got.precision, got.recall, got.meets_floor) == (1.0, 1.0, True)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(-5, 5).map(lambda x: round(x, 3)), min_size=1, max_size=60))
def test_p95_is_nearest_rank(spark, values):
    want = sorted(values)[min(len(values) - 1, round((len(values) - 1) * 0.95))]
    got = evals.p95(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert math.isclose(got.p95, want, abs_tol=1e-9) and got.n == len(values)


def test_gate_statuses(spark):
    assert [one(spark, evals.gate_status(*map(F.lit, x), 8)) for x in ((9, 0, 9), (3, 0, 9), (9, 1, 9), (0, 0, 0))] == ["ok", "blocked-fixtures", "blocked-malformed", "blocked-input"]


# Notes and memory

NOTE = "---\nid: spec.a\ntype: spec\nstatus: accepted\nnode-kind: Capability\nowners: [x, 'y']\nlast-validated: 2024-01-02\ntitle: \"T: u\"\n---\nsee [[decisions/a|b]] and [[c]]\n"


def test_notes(spark):
    files = spark.createDataFrame([("a.md", NOTE), ("b.md", "no frontmatter"), ("c.md", "---\nid: e\ntype: episode-release-note\ntitle: R\n---\n")], "path string, text string")
    got = {r.path: r for r in notes.notes(files).collect()}
    assert set(got) == {"a.md", "c.md"}
    a = got["a.md"]
    assert (a.id, a.owners, str(a.last_validated), a.n_links, a.n_decision_links, a.properties["title"]) == ("spec.a", ["x", "y"], "2024-01-02", 2, 1, "T: u")
    assert {(r.target, r.id) for r in notes.derived_records(notes.notes(files)).collect()} == {("graph", "spec.a"), ("episodes", "e")}
    assert notes.stale(notes.notes(files), "2024-06-01").count() == 1 and notes.stale(notes.notes(files), "2024-02-01").count() == 0


def test_memory_revocation(spark):
    rows = [("memory.s.1", "p", 0, "remember This"), ("memory.s.2", "p", 1, "remember that")]
    sections = spark.createDataFrame(rows, "id string, path string, position int, body string")
    assert [r.id for r in memory.query(sections, "THIS").collect()] == ["memory.s.1"]
    gone = spark.range(1).select(F.lit("memory.r.9").alias("id"), F.lit("p").alias("path"), F.lit(2).alias("position"), memory.revocation(F.lit("memory.s.1"), F.lit("remember")).alias("body"))
    assert [r.id for r in memory.query(sections.unionByName(gone), "remember").collect()] == ["memory.s.2"]


# Sync


def test_diff_and_idempotence(spark):
    schema = "path string, content_hash string, node_id string"
    state = spark.createDataFrame([("a", "1", "x"), ("b", "1", None), ("c", "1", "z")], schema)
    files = spark.createDataFrame([("a", "1", "x"), ("b", "2", None), ("d", "1", "w")], schema)
    assert {(r.path, r.status) for r in sync.diff(state, files).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "created")}
    assert sync.changed(sync.next_state(state, files), files).count() == 0 and sync.pruned(files, files).count() == 0


def test_rename_table(spark):
    rows = [("i", "i", True), ("i", "j", True), (None, "j", True), ("i", None, True), (None, None, True), ("i", "i", False)]
    got = sync.renames(spark.createDataFrame([(n, "s", "d", *r) for n, r in enumerate(rows)], "n int, src string, dest string, old_id string, new_id string, readable boolean")).orderBy("n").collect()
    assert [r.action for r in got] == ["renamed_same_id", "renamed_new_id", "create_only", "delete_only", "noop", "delete_only"]
    assert [r.emits_delete for r in got] == [False, True, False, True, False, True]


def test_churn_converges(spark):
    ops = [(1, "upsert", "x", 1), (2, "upsert", "y", 1), (3, "upsert", "x", 2), (4, "delete", "y", None), (5, "upsert", "y", 2), (6, "delete", "x", None), (7, "delete", "y", None), (8, "upsert", "x", 6)]
    got = sync.replay(spark.createDataFrame([(*o, "p") for o in ops], "seq int, op string, id string, version int, path string")).collect()
    assert [(r.id, r.version) for r in got] == [("x", 6)]


def test_stream_of_syncs(spark, tmp_path):
    from corvane.streaming.sync import run_batch

    seen, gone = [], []
    schema = "path string, content_hash string, node_id string"
    first = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], schema)
    second = spark.createDataFrame([("a", "2", "x")], schema)
    for n, snapshot in enumerate([first, first, second, second]):
        run_batch(snapshot, str(tmp_path / "state"), n, [lambda df, b: seen.append((b, df.count()))], [lambda df, b: gone.append((b, df.count()))], "2024-01-01T00:00:00Z")
    assert seen == [(0, 2), (1, 0), (2, 1), (3, 0)] and gone == [(0, 0), (1, 0), (2, 1), (3, 0)]


def test_stream_of_sessions(spark, tmp_path):
    from corvane.streaming.sessions import mistakes

    rows = [(at(0), "edit", "f", "X", "Y", None), (at(15), "edit", "f", "Y", "X", None), (at(16), "test_run", "f", None, None, 1), (at(20), "edit", "f", "X", "Z", None)]
    events = log(spark, rows)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = mistakes(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {(r.idx, r.kind, r.pre_event_idx) for r in spark.table("found").collect()}
    finally:
        q.stop()
    batch = {(r.idx, r.kind, r.pre_event_idx) for r in sessions.mistakes(events).collect()}
    assert got == batch == {(1, "reverted_edit", 0), (3, "failed_then_re_edited", 2)}


# Audit


def test_gate(spark):
    rows = [("a", "vault/spec/x.md", ""), ("b", "README.md", ""), ("c", "src/Guard.rs", "KB-gate: ack")]
    got = {r.change: r.status for r in audit.gate(spark.createDataFrame(rows, "change string, path string, body string")).collect()}
    assert got == {"a": "warn", "b": "pass", "c": "acknowledged"}
    strict = audit.gate(spark.createDataFrame(rows[:1], "change string, path string, body string"), advisory=False).first()
    assert strict.status == "fail"


def test_signatures(spark):
    diff = '+def test_a(x):\n+  def test_b():\n def test_c():\n+ it("does x", f)\n+ async fn test_d() {\n+  "id": "s1",\n+ "id": "s2"'
    sig = lambda p: one(spark, audit.test_signatures(F.lit(diff), F.lit(p)))
    assert sig("t.py") == ["t.py::test_a", "t.py::test_b"] and sig("t.test.ts") == ["t.test.ts:does x"]
    assert sig("t.rs") == ["t.rs::test_d"] and sig("t.json") == ["t.json#s1"] and sig("t.txt") == []


def test_failure_kinds(spark):
    kind = lambda m: one(spark, audit.failure_kind(F.lit(m)))
    assert [kind(m) for m in ("", "fix: a", "thread panicked\nleft: 1", "a" * 90, "short")] == ["unknown", "commit-subject", "real-test-failure", "unknown", "commit-subject"]


def test_verdict(spark):
    v = one(spark, audit.verdict(F.lit('text {"was_documented": true, "confidence": 0.7} more')))
    assert v.was_documented and v.accepted and v.evidence == []
    assert one(spark, audit.verdict(F.lit("nothing"), 2)).needs_manual_review


# Plans, sources, sinks


def test_receipts():
    signer = receipts.HmacSigner(b"k")
    out = receipts.signed(lambda: {"status": "ok", "tool": "t", "results": [{"id": 1}, {"file_path": "p"}]}, signer)()
    assert receipts.verify(out, signer) == (True, "ok") and out["receipt"]["result_ids"] == ["1", "p"]
    assert receipts.verify({**out, "tool": "u"}, signer) == (False, "hash mismatch")
    out["receipt"]["tool"] = "u"
    assert receipts.verify(out, signer) == (False, "signature mismatch")
    assert "receipt" not in receipts.signed(lambda: {"status": "error"}, signer)()


def test_registry(spark):
    r = Registry()
    r.tool("a", len)
    with pytest.raises(ValueError, match="tool exists"):
        r.tool("a", len)
    with pytest.raises(TypeError):
        r.projector(3)
    r.chunker("x", len)
    r.chunker("x", max)
    assert r.by_language()["x"] is len and load_plugins(r, "no.such.group") == []
    n = spark.createDataFrame([("spec", 1), ("adr", 2)], "type string, id int")
    r.handler("spec", lambda df: df.select("id"))
    r.handler("*", lambda df: df.select("id"))
    assert sorted(x.id for x in r.handle(n).collect()) == [1, 1, 2]


def test_engine(spark):
    rows = [(i, f"src/m{i % 4}.py", "python", [float(i), 1.0]) for i in range(12)] + [(50, "tests/test_m1.py", "python", [1.0, 1.0])]
    code = spark.createDataFrame(rows, "id long, file_path string, language string, embedding array<float>")
    nodes, edges = star(spark)
    e = Engine(code, code.limit(3), nodes, edges, lambda q: [1.0, 0.0])
    assert e.search_code("m1", 2).first().file_path == "src/m1.py"
    assert {r.file_path for r in e.find_tests("m1").collect()} == {"src/m1.py", "tests/test_m1.py"}
    assert e.neighbors("a").count() == 2 and e.context("a").count() == 2 and e.impact("a").count() > 1
    assert {r.section for r in e.brief("m1").collect()} >= {"code", "docs", "tests"}
    with pytest.raises(ValueError, match="limit"):
        e.search_code("x", 51)
    r = Registry()
    e.register(r)
    assert len(r.tools) == 10 and e.memory_query("x").count() == 0


def test_tree_and_ingest(spark, tmp_path):
    for path, text in {"a.py": "def f():\n    pass\n", "crates/k/README.md": "# H\nx\n", "node_modules/b.py": "x = 1\n", "c.bin": "\x00"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    src = load_sources(f'[[source]]\npack = "p"\nroot = "{tmp_path}"\ninclude = ["**/*"]\nexclude = ["**/*.bin"]\n', "/", {"p"})[0]
    files = parsed(tree(spark, src))
    assert {(r.path, r.language, r.crate) for r in files.collect()} == {("a.py", "python", "unknown"), ("crates/k/README.md", "markdown", "k")}
    assert {(r.file_path, r.name, r.language) for r in ingest(files, "root").collect()} == {("a.py", "f", "python"), ("crates/k/README.md", "H", "markdown")}


@pytest.mark.parametrize("text", ["x", "", "[[source]]\npack = 'q'\nroot = 'r'", "[[source]]\npack = 'p'", "[[source]]\npack = 'p'\nroot = 'r'\nglob = 'x'", "[[source]]\npack = 'p'\nroot = 'r'\nglob = []\ninclude = []", "[[source]]\npack = 'p'\nroot = 'r'\nother = 1", "source = 3", "[[source]]\npack = 'p'\nroot = 'r'\nexclude = [1]"])
def test_bad_sources(text):
    with pytest.raises(ConfigError):
        load_sources(text, "/", {"p"})


def test_session_files_and_fixtures(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text('{"t": "2024-01-01T00:00:00Z", "event": "edit", "file": "f"}\n\nnot json\n{"t": "2024-01-01T00:01:00Z", "event": "test_run", "exit": 1}\n')
    assert {(r.session, r.event) for r in read_sessions(spark, str(tmp_path / "s1.jsonl")).collect()} == {("s1", "edit"), ("s1", "test_run")}
    assert malformed(spark, str(tmp_path / "s1.jsonl")).first().malformed == 1
    (tmp_path / "a.yml").write_text("id: q1\nquery: x\nexpected: [p]\n")
    (tmp_path / "example.yml").write_text("id: no\nexpected: [p]\n")
    (tmp_path / "b.yml").write_text("id: q2\n")
    got = fixtures(spark, str(tmp_path))
    assert [(r.id, r.expected) for r in got.collect()] == [("q1", ["p"])]
    assert merged_fixtures(got, got).count() == 1


def test_sinks(spark):
    for bad in ("A", "1a", "a-b", "a; drop", ""):
        with pytest.raises(ValueError):
            sinks.schema_name(bad)
    sinks.bootstrap(spark, "kb_test")
    sinks.bootstrap(spark, "kb_test")
    chunks = spark.createDataFrame([(1, "f", "r", "python", 1, 2, "t", [1.0, 2.0])], "id long, file_path string, source_root string, language string, line_start int, line_end int, chunk_text string, embedding array<float>")
    sinks.append_chunks(chunks, "kb_test", "code_chunks", 2)
    with pytest.raises(Exception, match="embedding of length"):
        sinks.append_chunks(chunks, "kb_test", "code_chunks", 3)
    assert spark.table("kb_test.code_chunks").count() == 1
    assert sinks.replace_files(chunks, spark.table("kb_test.code_chunks")).count() == 1
    sinks.reset(spark, "kb_test")
    assert spark.table("kb_test.code_chunks").count() == 0
    spark.sql("DROP DATABASE kb_test CASCADE")
    assert sinks.markdown_table(chunks.select("id"), "T").endswith("| 1 |\n")
    seeds = spark.createDataFrame([("a", "h1", "B"), ("b", "h2", "B"), ("c", "h3", "B")], "slug string, hash string, body string")
    old = spark.createDataFrame([("a", "seed-hash: h1\nB"), ("b", "seed-hash: zz\nB\n<!-- human -->\nkeep me")], "slug string, text string")
    got = {r.slug: r for r in sinks.seed_notes(seeds, old).collect()}
    assert [got[k].status for k in "abc"] == ["skipped", "updated", "created"] and got["b"].text.endswith("keep me")


# Further operators


def test_list_index_recall(spark):
    from corvane.operators import ann

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centres = ann.centroids(e, 16)
    index = ann.build(e, centres)
    assert index.count() == e.count()
    assert ann.recall(ann.search(index, asked, centres, 8, 10), vector.batch_top_k(e, asked, 8)) >= 0.9
    assert ann.recall(ann.search(index, asked, centres, 8, len(centres)), vector.batch_top_k(e, asked, 8)) == 1.0
    code = e.select(ann.quantize(F.col("embedding")).alias("q"), "embedding").select(ann.dequantize(F.col("q")).alias("d"), "embedding", "q").first()
    assert max(abs(a - b) for a, b in zip(code.d, code.embedding, strict=True)) <= code.q.scale / 2 + 1e-9
    with pytest.raises(ValueError, match="no such vector backend"):
        ann.backend("other")


def test_imports(spark):
    text = "import a.b\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import c_pack\nimport importlib\nx = importlib.import_module('d_pack')\nfrom . import e\n"
    got = audit.imports(spark.createDataFrame([("p.py", text), ("q.py", "def (")], "path string, text string"))
    assert {(r.line, r.module, r.kind) for r in got.collect()} == {(1, "a.b", "static"), (2, "typing", "static"), (4, "c_pack", "type_checking"), (5, "importlib", "static"), (6, "d_pack", "dynamic")}
    assert audit.boundary_violations(got, "_pack$").count() == 2


def test_episodes_sources_receipts(spark):
    from corvane.sources.files import default_sources

    got = memory.episodes(spark.createDataFrame([("A b!", " x "), ("!!", "y")], "name string, body string"), "20240101-000000").collect()
    assert [r.id for r in got] == ["episode.a-b.20240101-000000", "episode.untitled.20240101-000000"] and got[0].text.endswith("# A b!\n\nx\n")
    assert default_sources(["/a", "/b"], lambda p: p.startswith("/b")) == "/b/sources.toml" and default_sources([], lambda p: True) is None
    assert sinks.resolve_schema(None, "e", "d") == "e" and sinks.resolve_schema("f", "e", "d") == "f"
    s = receipts.HmacSigner(b"k")
    assert receipts.evaluate([receipts.sign({"status": "ok", "results": []}, s)], s) == {"verifiable_fraction": 1.0, "tamper_rejection_fraction": 1.0}
