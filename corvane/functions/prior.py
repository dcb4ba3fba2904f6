"""The lexical path prior: an additive score of a path for a query, as one expression over a rule table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import basename, contains_any, normalize_path, stem

# Weights and markers of the generic rules.
NOISE = ("/eval/fixtures/", "/.cursor/", "/__pycache__/", "/.venv/")
PLANNING_FILES = ("plan.md", "agents.md", "claude.md")


@dataclass(frozen=True)
class NamedFile:
    """A rule on one file: paths with this ending get delta if the query has (or, with unless, lacks) any of the cues."""

    ending: str
    cues: tuple[str, ...]
    delta: float
    unless: bool = False


@dataclass(frozen=True)
class Prior:
    named: tuple[NamedFile, ...] = field(default=())
    playbooks: str = "vault/playbooks/"
    decisions: str = "decisions/"
    specs: str = "vault/spec/"

    def score(self, path: Column | str, query: Column | str) -> Column:
        path = normalize_path(path)
        q = F.lower(F.col(query) if isinstance(query, str) else query)
        low = F.lower(path)
        rooted = F.concat(F.lit("/"), low)
        base, root = F.lower(basename(path)), F.lower(stem(path))
        in_tests = rooted.contains("/tests/") | path.startswith("tests/")
        asks_test, asks = q.contains("test"), lambda *w: contains_any(q, *w)
        parts = F.split(low, "/")
        parents = F.slice(parts, 1, F.size(parts) - 1)
        named = lambda c: F.instr(q, c) > 0
        tokens = F.filter(F.split(F.translate(root, "_", "-"), "-"), lambda t: (F.length(t) >= 4) & named(t))
        docker = asks("dockerfile") | (asks("docker") & asks("compose"))
        rules: list[tuple[Column, Column | float]] = [
            (contains_any(rooted, *NOISE), -0.40),
            (in_tests & ~asks_test, -0.55),
            (path.endswith(".yml") & rooted.contains("/fixtures/") & ~asks("fixture"), -0.30),
            (path.endswith("/__init__.py"), -0.35),
            (rooted.contains("fake_server") & ~asks("fake", "stub"), -0.55),
            (path.endswith("schema.py") & ~asks("schema"), -0.15),
            ((base == "makefile") & ~asks("makefile", "make kb-"), -0.50),
            (base.startswith("dockerfile") & ~docker, -0.45),
            (base.isin(*PLANNING_FILES) & ~named(base) & ~named(root) & ~asks("plan", "agents", "hard rule"), -0.25),
            (named(low), 0.70),
            (named(base) | named(root), 0.45),
            (F.lit(True), F.size(F.filter(parents, lambda p: (F.length(p) >= 4) & named(p))) * 0.10),
            ((F.size(parts) >= 2) & named(F.concat(F.element_at(F.concat(F.array(F.lit("")), parts), -2), F.lit("/"), root)), 0.30),
            (F.lit(True), F.least(F.lit(0.30), F.size(tokens) * 0.08)),
            (asks("playbook") & (rooted.contains("/playbooks/") | path.startswith(self.playbooks)), 0.35),
            (asks("adr", "charter", "decision") & path.startswith(self.decisions), 0.25),
            (asks("spec") & path.startswith(self.specs), 0.30),
            (asks("tool", "mcp") & rooted.contains("/tools/"), 0.15),
            (asks_test & in_tests, 0.20),
        ]
        for r in self.named:
            rules.append((path.endswith(r.ending) & (~asks(*r.cues) if r.unless else asks(*r.cues)), r.delta))
        terms = [F.when(c, d if isinstance(d, Column) else F.lit(d)).otherwise(F.lit(0.0)) for c, d in rules]
        return F.round(reduce(lambda a, b: a + b, terms), 4)
