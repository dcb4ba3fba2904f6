"""Predicates and classifiers on paths, messages, diffs and lines: impact gate, fixture audit, test signatures."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.shared import settled
from corvane.functions.text import col, contains_any, first_json_object, has_extension, lines

# Words that begin a conventional commit subject.
CONVENTIONAL_TYPES = ("feat", "fix", "chore", "docs", "refactor", "test", "perf", "style", "build", "ci", "revert")
# What stands in the output of a failed test, in any case.
FAILURE_TOKENS = ("FAILED", "FAIL ", "FAIL!", "FAIL\t", "FAIL\n", "expected:", "got:", "assertion", "Traceback", "Error:", "error:", "panicked", "AssertionError", "InvalidSignature", "Reason:", "Got verdict", "Expected verdict", " > ", "::")
# Paths of fixes and of conformance tests, and words of risky paths.
FIX_PREFIXES = ("crates/", "spec/", "docs/standards/", "docs/conformance/", "docs/sdk/", "docs/protocol/", "docs/release/", "docs/mcp/")
CONFORMANCE_PREFIXES = ("tests/conformance/", "integrations/mcp-adapter/tests/")
CONFORMANCE_PARTS = ("/conformance/", "/conformance_")
SCENARIO_PREFIX = "tests/conformance/native/scenarios/"
ADAPTER_TESTS = "integrations/mcp-adapter/tests/"
RISK_WORDS = ("capability", "receipt", "guard", "policy", "attenuation", "revocation")
RISK_PREFIXES = ("crates/core/", "crates/trust/")
#: What a description says, in any case, where impacts were seen to.
ACKNOWLEDGED = "gate: ack"


#: What stands between words, and candidates up to which texts are not shuffled to be tested.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
FEW_CANDIDATES = 200_000


@dataclass(frozen=True)
class ImpactRules:
    """The first rule that holds: a canonical document, a guard or policy, an engine path."""

    spec_prefix: str = "vault/spec/"
    guard_words: tuple[str, ...] = ("guard", "policy")
    engine_prefixes: tuple[str, ...] = ("engine/", "pack/")

    def relationship(self, path: Column | str) -> Column:
        p = col(path)
        engine = F.lit(False)
        for x in self.engine_prefixes:
            engine = engine | p.startswith(x)
        return F.when(p.startswith(self.spec_prefix), "CANONICAL_DOC").when(contains_any(F.lower(p), *self.guard_words), "GUARDS").when(engine, "IMPLEMENTS")


def gate(changes: DataFrame, rules: ImpactRules = ImpactRules(), advisory: bool = True, acknowledged: str = ACKNOWLEDGED) -> DataFrame:
    """One row per change set (change, path, body): impacts, whether acknowledged, status."""
    seen = changes.withColumn("_r", rules.relationship("path"))
    n = seen.groupBy("change").agg(F.count_if(F.col("_r").isNotNull()).alias("impacts"), F.max(F.lower(F.coalesce("body", F.lit(""))).contains(acknowledged.lower())).alias("acknowledged"))
    status = F.when(F.col("acknowledged") & (F.col("impacts") > 0), "acknowledged").when(F.col("impacts") > 0, "warn" if advisory else "fail").otherwise("pass")
    return n.withColumn("status", status)


def _starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.startswith(p) for p in prefixes), F.lit(False))


def expected_impact(path: Column | str, words: tuple[str, ...] = ()) -> Column:
    """A stand-in label for a path where no follow-up is known. words: names of a repository's own risky parts."""
    low = F.lower(col(path))
    return contains_any(low, *RISK_WORDS, *words) | _starts_with_any(low, RISK_PREFIXES)


def backtest(changes: DataFrame, rules: ImpactRules = ImpactRules(), words: tuple[str, ...] = ()) -> DataFrame:
    """change, predicted, expected and outcome (tp, fp, tn, fn) of each change set (change, path, body and, where it is known, expected); its counts by confusion()."""
    label = F.col("expected") if "expected" in changes.columns else F.lit(None).cast("boolean")
    expected = changes.groupBy("change").agg(F.coalesce(F.max(label), F.max(expected_impact("path", words))).alias("expected"))
    found = gate(changes, rules).select("change", "status", (F.col("impacts") > 0).alias("predicted")).join(expected, "change")
    outcome = F.when(F.col("predicted"), F.when(F.col("expected"), "tp").otherwise("fp")).otherwise(F.when(F.col("expected"), "fn").otherwise("tn"))
    return found.withColumn("outcome", outcome)


def is_test_file(path: Column | str, prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a file is a conformance test: it lies in a conformance folder, one of `prefixes` among them, and is a test by its name or place."""
    p = col(path)
    base = F.substring_index(p, "/", -1)
    inside = _starts_with_any(p, CONFORMANCE_PREFIXES + prefixes) | contains_any(p, *CONFORMANCE_PARTS)
    longer = lambda tail: base.endswith(tail) & (F.length(base) > len(tail))
    named = (base.startswith("test_") & base.endswith(".py") & (F.length(base) > 8)) | longer(".test.ts") | longer(".test.js") | (base.startswith("conformance") & base.endswith(".rs"))
    placed = (p.startswith(SCENARIO_PREFIX) & p.endswith(".json")) | (p.startswith("crates/") & p.contains("/tests/") & p.endswith(".rs")) | p.startswith(ADAPTER_TESTS)
    return inside & (named | placed)


def is_canonical_fix(path: Column | str) -> Column:
    p = col(path)
    return _starts_with_any(p, FIX_PREFIXES) & ~p.startswith("tests/") & ~has_extension(p, ".lock", ".toml")


def failure_kind(message: Column | str, tokens: tuple[str, ...] = FAILURE_TOKENS) -> Column:
    """real-test-failure, commit-subject or unknown: a token of test output anywhere, else a short message, else what a person must judge."""
    full = F.filter(F.coalesce(lines(message), F.array().cast("array<string>")), lambda x: x.rlike("(?U)\\S"))
    first = F.regexp_replace(F.coalesce(F.get(full, 0), F.lit("")), "(?U)^\\s+|\\s+$", "")
    short = (F.length(first) < 80) & (F.size(full) <= 2)
    return F.when(first == "", "unknown").when(contains_any(F.lower(col(message)), *(t.lower() for t in tokens)), "real-test-failure").when(short, "commit-subject").otherwise("unknown")


def is_conventional(message: Column | str) -> Column:
    """Whether a message begins like `type: text` or `type(scope): text`, the type in any case."""
    m = col(message)
    kind = F.regexp_extract(F.lower(m), "^[a-z]*", 0)
    after = F.substr(m, F.length(kind) + 1)
    scope_end = F.instr(after, F.lit(")"))
    rest = F.when(after.startswith("("), F.when(scope_end > 0, F.substr(after, scope_end + 1)).otherwise("")).otherwise(after)
    return kind.isin(*CONVENTIONAL_TYPES) & rest.startswith(":") & F.substr(rest, F.lit(2)).rlike("^\\s+\\S")


def confidence_histogram(fixtures: DataFrame, review: str = "review") -> DataFrame:
    """confidence and n: how many fixtures have each, from a `confidence=word` note; high, medium and low in this order."""
    found = F.nullif(F.regexp_extract(review, "confidence=(\\w+)", 1), F.lit(""))
    known = F.array(*map(F.lit, ("high", "medium", "low")))
    return fixtures.groupBy(found.alias("confidence")).agg(F.count("*").alias("n")).filter(F.array_contains(known, F.col("confidence"))).orderBy(F.array_position(known, F.col("confidence")))


def added_lines(diff: Column | str) -> Column:
    """The lines that a diff adds, without their mark and indent."""
    return F.transform(F.filter(F.split(col(diff), "\n"), lambda x: x.startswith("+")), lambda x: F.ltrim(F.substr(x, F.lit(2))))


def _named_call(line: Column, *words: str) -> Column:
    """The name of `words... test_name(` that a line begins with, else null."""
    head = F.split(F.rtrim(F.substring_index(line, "(", 1)), " ")
    name = F.element_at(head, -1)
    return F.when(line.contains("(") & (F.slice(head, 1, len(words)) == F.array(*map(F.lit, words))) & (F.size(head) == len(words) + 1) & name.rlike("^test_\\w+$"), name)


def _titled_call(line: Column) -> Column:
    """The title of `it("title"` or `test('title'` that a line begins with, else null."""
    call = F.rtrim(F.substring_index(line, "(", 1))
    argument = F.ltrim(F.substr(line, F.instr(line, F.lit("(")) + 1))
    parts = F.split(argument, "['\"]", -1)
    return F.when(line.contains("(") & call.isin("it", "test") & (F.size(parts) > 2) & (F.get(parts, F.lit(0)) == ""), F.nullif(F.get(parts, F.lit(1)), F.lit("")))


def _id_field(line: Column) -> Column:
    """The value of the JSON member "id" that a line begins with, else null."""
    parts = F.split(line, '"', -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when((F.size(parts) > 4) & (part(0) == "") & (part(1) == "id") & (F.trim(part(2)) == ":"), F.nullif(part(3), F.lit("")))


def test_signatures(diff: Column | str, path: Column | str) -> Column:
    """Names of tests that a diff adds: what is declared in its added lines, by the kind of file. A scenario file is one test, named by its first id if it has one."""
    p, added = col(path), added_lines(diff)
    found = lambda sep, name: F.transform(F.filter(F.transform(added, name), lambda n: n.isNotNull()), lambda n: F.concat(p, F.lit(sep), n))
    kinds = {
        (".py",): found("::", lambda x: _named_call(x, "def")),
        (".test.ts", ".test.js"): found(":", _titled_call),
        (".rs",): found("::", lambda x: F.coalesce(_named_call(x, "fn"), _named_call(x, "async", "fn"))),
        (".json",): F.slice(F.concat(found("#", _id_field), F.array(p)), 1, 1),
    }
    out = None
    for endings, names in kinds.items():
        here = reduce(Column.__or__, (p.endswith(e) for e in endings))
        out = F.when(here, names) if out is None else out.when(here, names)
    return out.otherwise(F.array().cast("array<string>"))


def flagged_lines(files: DataFrame, wanted: str, excused: str, path: str = "path", text: str = "text") -> DataFrame:
    """path, line number and line of each line that matches wanted and not excused."""
    each = files.select(F.col(path), F.posexplode(F.split(text, "\n")).alias("_i", "line"))
    return each.filter(F.col("line").rlike(wanted) & ~F.col("line").rlike(excused)).select(path, (F.col("_i") + 1).alias("line_number"), "line")


def verdict(response: Column | str, passes: int = 1) -> Column:
    """documented, confidence and needs_manual_review from a judge's JSON answer, with defaults for what it lacks."""
    got = F.from_json(first_json_object(response), "was_documented boolean, confidence double, evidence array<string>, rationale string")
    confidence = F.coalesce(got["confidence"], F.lit(0.0))
    return F.struct(F.coalesce(got["was_documented"], F.lit(False)).alias("was_documented"), confidence.alias("confidence"), F.coalesce(got["evidence"], F.array().cast("array<string>")).alias("evidence"), ((confidence < 0.3) & F.lit(passes >= 2)).alias("needs_manual_review"), (confidence >= 0.5).alias("accepted"))


def imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line, module, kind (static, dynamic, type_checking) of each import of Python files; files that do not parse give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *found) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for found in _imports(t or "")]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "line", "module", "kind"])

    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(run, "path string, line int, module string, kind string")


def _imports(source: str) -> Iterator[tuple[int, str, str]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    guarded = {n.lineno for x in ast.walk(tree) if isinstance(x, ast.If) and ast.unparse(x.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING") for y in x.body for n in ast.walk(y) if hasattr(n, "lineno")}
    for node in ast.walk(tree):
        kind = "type_checking" if getattr(node, "lineno", 0) in guarded else "static"
        if isinstance(node, ast.Import):
            yield from ((node.lineno, a.name, kind) for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            yield node.lineno, node.module, kind
        elif isinstance(node, ast.Call) and ast.unparse(node.func) in ("importlib.import_module", "import_module", "__import__") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            yield node.lineno, node.args[0].value, "dynamic"


def boundary_violations(found: DataFrame, forbidden: str) -> DataFrame:
    """Imports of modules that match a pattern."""
    return found.filter(F.col("module").rlike(forbidden))


def _triples(words: Column) -> Column:
    """The hash of each three words in a row."""
    return F.transform(F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))), lambda z, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), z))


def _anchor(words: Column) -> Column:
    """Of the words inside a text the three in a row that are longest together; null for texts of fewer than five words."""
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    sizes = F.transform(F.slice(inner, 3, F.greatest(F.size(inner) - 2, F.lit(0))), lambda z, i: F.length(F.get(inner, i)) + F.length(F.get(inner, i + 1)) + F.length(z))
    return F.array_max(F.arrays_zip(sizes.alias("size"), _triples(inner).alias("gram")))["gram"]


def _of_words(text: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text's words, which are split once however often f names them."""
    return F.transform(F.array(F.split(text, SPACE, -1)), f)[0]


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """doc_id, item_id of every pair of rows whose document's text holds the item's at any place.

    Words inside an item, all but its first and last, are whole words of a text that holds it. So three of them are sought among the threes of
    each text, and only texts that have them are tested. Items of fewer than five words are tested against all texts.
    """
    once = items.filter(F.col(text).isNotNull()).groupBy(F.col(item_id).alias("_item"), F.col(text).alias("_text")).agg(F.count("*").cast("int").alias("_n"))
    known = once.select("*", F.xxhash64("_item", "_text").alias("_key"), _of_words(F.col("_text"), _anchor).alias("_gram"))
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_in"))
    grams = own.select("_doc", F.explode(_of_words(F.col("_in"), _triples)).alias("_gram"))
    near = settled(grams.join(known.filter("_gram is not null").select("_gram", "_key"), "_gram").select(F.col("_doc").alias("_near"), "_key").distinct())
    near = F.broadcast(near) if near.count() <= FEW_CANDIDATES else near
    tested = own.join(near, F.col("_doc").eqNullSafe(F.col("_near"))).join(known, "_key").select("_doc", "_in", "_item", "_text", "_n")
    short = own.crossJoin(known.filter("_gram is null").select("_item", "_text", "_n"))
    found = tested.unionAll(short).filter(F.col("_in").contains(F.col("_text")))
    return found.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_n")).select(doc_id, item_id)
