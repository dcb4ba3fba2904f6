"""Scans of file trees, frontmatter in block form, and the words of audits."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import audit, notes
from corvane.sources.files import Source, tree


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_skipped_folders_are_not_read(spark, tmp_path):
    for name in ("a.py", "node_modules/b.py", "x/target/c.py", "d e+f%20.md", "é.txt", "x/g.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    found = tree(spark, Source("p", str(tmp_path), exclude=("x/g*",)))
    assert {r.path for r in found.collect()} == {"a.py", "d e+f%20.md", "é.txt"} and {r.text for r in found.collect()} == {"text"}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = tree(spark, Source("p", str(tmp_path), exclude=("x/g*",)))
        assert len(found.collect()) == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 3


def test_frontmatter_in_block_form(spark):
    text = "---\nid: a.b  # note\nowners:\n  - ann\n  - \"bo b\"\ntags: [x, y]\nempty:\nmeta:\n  level: 2\n  name: 'n'\nsummary: >\n  first\n  second\nurl: http://x/y\nid: again\nlast:\n- z\n# comment\n---\nbody\n- not an item\n"
    got = one(spark, notes.frontmatter(F.lit(text)))
    assert got == {"id": "a.b", "owners": "[ann, bo b]", "tags": "[x, y]", "empty": "", "meta": "{level: 2, name: n}", "summary": "first second", "url": "http://x/y", "last": "[z]"}
    rows = notes.notes(spark.createDataFrame([("p.md", text)], "path string, text string")).first()
    assert rows.owners == ["ann", "bo b"] and rows.id == "a.b"
    assert one(spark, notes.frontmatter(F.lit("no frontmatter"))) == {} and one(spark, notes.frontmatter(F.lit("---\n- x\n  y: z\n---\n"))) == {}


@pytest.mark.parametrize(("message", "want"), [("feat: x", True), ("Fix(core): y", True), ("fix(a:b): y", True), ("feat!: x", False), ("feat:x", False), ("feat(x: y", False), ("feature: x", False), ("", False), ("fix: ", False)])
def test_conventional_subjects(spark, message, want):
    assert one(spark, audit.is_conventional(F.lit(message))) is want


def test_conformance_paths(spark):
    cases = {"tests/conformance/test_a.py": True, "tests/test_a.py": False, "x/conformance/a.test.ts": True, "x/conformance/a.ts": False, "x/conformance_b/conformance_cli.rs": True, "tests/conformance/native/scenarios/a.json": True, "tests/conformance/a.json": False, "integrations/mcp-adapter/tests/a.txt": True, "crates/a/conformance/tests/b.rs": True, "crates/a/tests/b.rs": False, "own/test_b.py": True, "x/conformance/test_.py": False}
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", audit.is_test_file("p", ("own/",)).alias("x")).collect()}
    assert got == cases


def test_failure_tokens(spark):
    kind = lambda m: one(spark, audit.failure_kind(F.lit(m)))
    assert [kind(m) for m in ("a\nb\nc", "x > y", "a::b", "a\nb\nFAIL\tz", "unexpected failure", "line\x0bother\nthird")] == ["unknown", "real-test-failure", "real-test-failure", "real-test-failure", "commit-subject", "unknown"]


def test_backtest_and_histogram(spark):
    rows = [("a", "vault/spec/x", "", True), ("b", "README", "", False), ("c", "lib/chart.py", "", True), ("d", "engine/x", "gate: ACK", False)]
    got = {r.change: (r.outcome, r.status) for r in audit.backtest(spark.createDataFrame(rows, "change string, path string, body string, expected boolean")).collect()}
    assert got == {"a": ("tp", "warn"), "b": ("tn", "pass"), "c": ("fn", "pass"), "d": ("fp", "acknowledged")}
    guessed = audit.backtest(spark.createDataFrame([(c, p, b) for c, p, b, _ in rows], "change string, path string, body string"), words=("chart",))
    assert {r.change: r.outcome for r in guessed.collect()} == {"a": "fp", "b": "tn", "c": "fn", "d": "fp"}
    notes_ = spark.createDataFrame([("x confidence=low",), ("confidence=high y",), ("confidence=low",), ("none",), (None,), ("confidence=odd",)], "review string")
    assert [tuple(r) for r in audit.confidence_histogram(notes_).collect()] == [("high", 1), ("low", 2)]
