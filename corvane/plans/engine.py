"""The engine's tools over one set of tables: search, tests, documents, neighbours, context, impact, brief."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.prior import Prior
from corvane.operators import graph, memory, vector
from corvane.plans.registry import Registry


# Columns of the stores.
EMPTY = {
    "code": "id long, file_path string, language string, embedding array<float>",
    "docs": "id long, file_path string, language string, embedding array<float>",
    "nodes": "id string, label string, properties map<string,string>",
    "edges": "edge_id long, src_id string, dst_id string, relationship string",
}


def bounded(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be from 1 to {most}")
    return value


@dataclass
class Engine:
    """code and docs: id, file_path, language, embedding. embed turns a query text into a vector. All tools return frames; a store that is not configured, None, answers with no rows."""

    code: DataFrame | None
    docs: DataFrame | None
    nodes: DataFrame | None
    edges: DataFrame | None
    embed: object
    sections: DataFrame | None = None
    prior: Prior = field(default_factory=Prior)
    post_filter: bool = False

    def __post_init__(self) -> None:
        spark = SparkSession.active()
        for name, schema in EMPTY.items():
            if getattr(self, name) is None:
                setattr(self, name, spark.createDataFrame([], schema))

    def search_code(self, query: str, limit: int = 10, **filters: str) -> DataFrame:
        return vector.search(self.code, query, self.embed(query), bounded("limit", limit, 50), prior=self.prior, post_filter=self.post_filter, **filters)

    def search_docs(self, query: str, limit: int = 10, **filters: str) -> DataFrame:
        return vector.search(self.docs, query, self.embed(query), bounded("limit", limit, 50), prior=self.prior, post_filter=self.post_filter, **filters)

    def find_tests(self, subject: str, limit: int = 10) -> DataFrame:
        return vector.find_tests(self.search_code(f"tests for {subject}", limit), subject)

    def find_docs(self, subject: str) -> DataFrame:
        return self.search_docs(subject, 12)

    def neighbors(self, node: str, depth: int = 1, limit: int = 50) -> DataFrame:
        return graph.neighbors(self.edges, self._ids([node]), bounded("depth", depth, 4), bounded("limit", limit, 200))

    def context(self, entity: str) -> DataFrame:
        return graph.context(self.edges, self._ids([entity]))

    def impact(self, target: str, limit: int = 50) -> DataFrame:
        rows = self.nodes.sparkSession.createDataFrame([(c, n) for n, c in enumerate(graph.impact_candidates(target))], "id string, rank int")
        near = graph.impact(self.nodes, self.edges, rows, 2, bounded("limit", limit, 200)).select("section", "id", "label")
        hits = self.search_code(target, min(12, limit)).select(F.lit("components").alias("section"), F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("id"), F.lit(None).cast("string").alias("label"))
        return near.unionAll(hits)

    def brief(self, feature: str, limit: int = 10) -> DataFrame:
        """Code, documents, tests and impact of a feature, by section."""
        bounded("limit", limit, 20)
        part = lambda name, df: df.select(F.lit(name).alias("section"), F.col("file_path").alias("id"), F.col("similarity").alias("score"))
        near = self.impact(feature, limit).select(F.lit("impact").alias("section"), "id", F.lit(None).cast("double").alias("score"))
        return part("code", self.search_code(feature, limit)).unionAll(part("docs", self.search_docs(feature, limit))).unionAll(part("tests", self.find_tests(feature, limit))).unionAll(near)

    def memory_query(self, needle: str, limit: int = 10) -> DataFrame:
        if self.sections is None:
            return self.nodes.sparkSession.createDataFrame([], "id string, path string, position long, excerpt string")
        return memory.query(self.sections, needle, limit)

    def snapshot(self, schema: str) -> DataFrame:
        return vector.snapshot(self.code, self.docs, schema)

    def register(self, registry: Registry) -> None:
        for name in ("search_code", "search_docs", "find_tests", "find_docs", "neighbors", "context", "impact", "brief", "memory_query", "snapshot"):
            registry.tool(name, getattr(self, name))

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")
