"""The tools that a server offers: by name, with a description and the arguments they take. A call gives a mapping and raises nothing.

Answers are small by contract, so their rows come to the driver: at most `limit` of them, which is bounded, plus one section each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import evals, memory, vector
from corvane.plans import receipts
from corvane.plans.engine import Engine

MOST_ROWS = 400


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    run: Callable[..., dict[str, Any]]

    @property
    def input_schema(self) -> dict[str, Any]:
        integers = {"limit", "depth", "k"}
        return {"type": "object", "properties": {a: {"type": "integer" if a in integers else "string"} for a in self.required + self.optional}, "required": list(self.required)}

    def call(self, arguments: dict[str, Any]) -> dict[str, Any]:
        """The answer with status `ok`, or `error` and its reason."""
        missing = [a for a in self.required if arguments.get(a) in (None, "")]
        unknown = sorted(set(arguments) - set(self.required) - set(self.optional))
        if missing or unknown:
            return {"status": "error", "tool": self.name, "reason": f"missing: {', '.join(missing)}" if missing else f"unknown: {', '.join(unknown)}"}
        try:
            return {"status": "ok", "tool": self.name, **self.run(**arguments)}
        except Exception as e:  # a server must get an answer
            return {"status": "error", "tool": self.name, "reason": str(e).split("\n")[0] or type(e).__name__}


@dataclass
class Memory:
    """Sections of governed memory as JSON lines in a folder: written once, never changed. A revocation is a section that names another."""

    spark: SparkSession
    path: str
    fields: str = "id string, session string, recorded_at string, title string, tags string, body string, path string, position long"

    def sections(self) -> DataFrame:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        there = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        return self.spark.read.schema(self.fields).json(self.path) if there else self.spark.createDataFrame([], self.fields)

    def add(self, text: str, session: str, title: str, at: str, tags: str = "") -> str:
        """Appends a section; its id is made of the session and its place there."""
        one = self.spark.createDataFrame([(session, text, title, at, tags)], "session string, text string, title string, at string, tags string")
        row = one.select(memory.entry(F.lit("-"), F.col("session"), F.col("at"), F.col("title"), F.col("tags"), F.col("text")).alias("e")).select("e.*").first()
        place = self.sections().filter(F.col("session") == row["session"]).count() + 1
        name = f"memory.{row['session']}.{place}"
        head = f"title: {title}\ntags: {tags}\n\n"
        new = self.spark.createDataFrame([(name, row["session"], at, title, tags, head + row["body"], f"memory/{row['session']}.md", place)], self.fields)
        new.coalesce(1).write.mode("append").json(self.path)
        return name

    def revoke(self, memory_id: str, reason: str, session: str, at: str) -> str:
        told = self.spark.range(1).select(memory.revocation(F.lit(memory_id), F.lit(reason)).alias("t")).first()["t"]
        return self.add(told, session, f"Revocation for {memory_id}", at, "revocation")


@dataclass
class Toolbox:
    """The thirteen tools over an engine. fixtures: id, category, query, expected; files of hits count as answers."""

    engine: Engine
    store: Memory
    episodes_path: str
    now: Callable[[], str]
    fixtures: DataFrame | None = None
    signer: receipts.Signer | None = None
    tools: dict[str, Tool] = field(default_factory=dict)
    #: Tools that write or measure; their answers carry no receipt.
    unsigned: frozenset[str] = frozenset({"evaluate", "add_episode", "memory_add", "memory_revoke"})

    def __post_init__(self) -> None:
        e = self.engine
        rows = lambda f: lambda **a: {"results": collected(f(**a)), "index_snapshot": snapshot_of(e)}
        whole = lambda a: {k: int(v) if k in ("limit", "depth") else v for k, v in a.items()}
        for name, text, required, optional, run in (
            ("search_code", "The code nearest to a query, the best of each file.", ("query",), ("limit", "language", "prefix"), rows(lambda **a: e.search_code(**whole(a)))),
            ("search_docs", "The documents nearest to a query, the best of each file.", ("query",), ("limit", "language", "prefix"), rows(lambda **a: e.search_docs(**whole(a)))),
            ("find_tests", "Tests of a file or symbol.", ("subject",), ("limit",), rows(lambda **a: e.find_tests(**whole(a)))),
            ("find_docs", "Documents on a file or unit.", ("subject",), (), rows(lambda **a: e.find_docs(**a))),
            ("neighbors", "Paths from a node of the graph.", ("node",), ("depth", "limit"), rows(lambda **a: e.neighbors(**whole(a)))),
            ("context", "Edges at an entity.", ("entity",), (), rows(lambda **a: e.context(**a))),
            ("impact", "What lies near a file or unit, by section.", ("target",), ("limit",), rows(lambda **a: e.impact(**whole(a)))),
            ("brief_feature", "Code, documents, tests and impact of a feature.", ("feature",), ("limit",), rows(lambda **a: e.brief(**whole(a)))),
            ("evaluate", "Runs the retrieval fixtures: grade, metrics and misses.", (), ("category", "k"), self._evaluate),
            ("add_episode", "Writes an episode note.", ("name", "body"), ("source",), self._add_episode),
            ("memory_add", "Appends a section of memory.", ("text",), ("session_id", "title"), self._memory_add),
            ("memory_query", "Sections that hold a text, without revoked ones.", ("query",), ("limit",), lambda query, limit=10: {"results": collected(memory.query(self.store.sections(), query, int(limit)))}),
            ("memory_revoke", "Appends the revocation of a section.", ("memory_id", "reason"), ("session_id",), self._memory_revoke),
        ):
            self.tools[name] = Tool(name, text, required, optional, run)

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> dict[str, Any]:
        if name not in self.tools:
            return {"status": "error", "tool": name, "reason": f"no such tool: {name}"}
        call = self.tools[name].call
        return receipts.signed(call, self.signer, self.unsigned)(arguments or {}) if self.signer else call(arguments or {})

    def _evaluate(self, category: str | None = None, k: int = 5) -> dict[str, Any]:
        if self.fixtures is None:
            raise ValueError("no retrieval fixtures")
        asked = self.fixtures if category is None else self.fixtures.filter(F.col("category") == category)
        return retrieval_report(asked, self.engine.code, self.engine.embed, int(k))

    def _add_episode(self, name: str, body: str, source: str = "episode") -> dict[str, Any]:
        spark = self.store.spark
        at = self.now()
        stamp = "".join(c for c in at if c.isdigit())
        note = memory.episodes(spark.createDataFrame([(name, body)], "name string, body string"), stamp, source)
        note.coalesce(1).write.mode("append").json(self.episodes_path)
        row = note.first()
        return {"episode_id": row["id"], "path": row["path"]}

    def _memory_add(self, text: str, session_id: str = "default", title: str = "Governed memory") -> dict[str, Any]:
        return {"memory_id": self.store.add(text, session_id, title, self.now())}

    def _memory_revoke(self, memory_id: str, reason: str, session_id: str = "default") -> dict[str, Any]:
        return {"revoked": memory_id, "memory_id": self.store.revoke(memory_id, reason, session_id, self.now())}


def collected(rows: DataFrame) -> list[dict[str, Any]]:
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"an answer has at most {MOST_ROWS} rows")
    return [r.asDict(recursive=True) for r in found]


def snapshot_of(engine: Engine) -> str:
    return engine.snapshot("engine").first()[0]


def retrieval_scores(fixtures: DataFrame, code: DataFrame, k: int = 5, path: str = "file_path", id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """id, category, precision, mrr of fixtures (id, category, embedding, expected): all queries are one job, and files count by their best chunk."""
    numbered = vector.stable_ids(fixtures.select("id"), "id", "id", "query_id").join(fixtures, "id")
    ranked = vector.batch_top_k(code, numbered.select("query_id", "embedding"), k, id_col, embedding, group=path)
    expected = numbered.select("query_id", F.explode("expected").alias("item"))
    scores = evals.ranked_scores(expected, ranked.select("query_id", F.col(path).alias("item"), "rank"), k)
    return scores.join(numbered.select("query_id", "id", "category"), "query_id").select("id", "category", "precision", "mrr")


def retrieval_report(fixtures: DataFrame, code: DataFrame, embed: Callable[[str], Iterable[float]], k: int = 5) -> dict[str, Any]:
    """Grade, metrics by category and missed fixtures. Fixtures (id, category, query, expected) are a stated set: their texts are embedded one by one on the driver."""
    spark = fixtures.sparkSession
    rows = [(r["id"], r["category"], [float(x) for x in embed(r["query"] or "")], r["expected"]) for r in fixtures.toLocalIterator()]
    if not rows:
        return {"grade": None, "metrics": {}, "misses": [], "state": "blocked-input"}
    scores = retrieval_scores(spark.createDataFrame(rows, "id string, category string, embedding array<double>, expected array<string>"), code, k).persist()
    try:
        grades = {r["category"]: r.asDict() for r in evals.grades(scores).collect()}  # a row for each category
        misses = [r["id"] for r in scores.filter("precision < 1").select("id").orderBy("id").limit(MOST_ROWS).collect()]
    finally:
        scores.unpersist()
    every = grades.pop("all")
    return {"grade": every["grade"], "metrics": {"fixture_count": every["n"], "mean_precision": every["mean_precision"], "mean_mrr": every["mean_mrr"], "categories": {c: g["grade"] for c, g in grades.items()}}, "misses": misses, "state": "ok"}

