"""A facade from files to answers: ingest, sync, query, verify, evaluate; and the same as commands.

    python -m corvane.plans.workspace ingest --config sources.toml --schema kb
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.shared import settled
from corvane.functions.text import content_hash, is_document, readable_text
from corvane.functions.vectors import hash_embedding
from corvane.operators import ann, graph, notes, sessions, sync, vector
from corvane.operators.stored_index import StoredIndex
from corvane.plans import receipts, tools
from corvane.sources import files, sinks
from corvane.sources.buckets import BucketTable
from corvane.sources.commits import BatchSink
from corvane.sources.folders import Folder
from corvane.sources.stored import chunk_table
from corvane.streaming.sync import Sink, next_batch, run_batch, start_changes


#: Lists that a query of the backend `lists` looks into.
PROBES = 24


@dataclass
class Workspace:
    """A schema of chunk tables, and what turns texts into vectors: `embed` a column of texts, `embed_one` a text on the driver."""

    spark: SparkSession
    schema: str
    dim: int = 32
    embed: Callable[[Column], Column] | None = None
    embed_one: Callable[[str], list[float]] | None = None

    def _vectors(self, text: Column) -> Column:
        return (self.embed or (lambda c: hash_embedding(c, self.dim)))(text).cast("array<float>")

    def _vector(self, text: str) -> list[float]:
        if self.embed_one:
            return self.embed_one(text)
        return [float(x) for x in self.spark.range(1).select(self._vectors(F.lit(text)).alias("e")).first()["e"]]

    def ingest(self, source: files.Source, reset: bool = False) -> dict[str, int]:
        """Reads a source's files, chunks and embeds them, and replaces the chunks of the files that were read: rows by table."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {sinks.schema_name(self.schema)}")
        if reset:
            for table in sinks.TABLES:
                for path in (self._path(table), self._path(table) + "_index"):
                    Folder(self.spark, path).delete()
        parsed = files.parsed(files.tree(self.spark, source))
        chunks = files.ingest(parsed, source.root).withColumn("chunk_text", F.col("text")).withColumn("embedding", self._vectors(F.col("text"))).withColumn("id", F.abs(F.xxhash64("source_root", "file_path", "ordinal")))
        rows = settled(chunks.withColumn("properties", F.to_json(F.struct("name"))).withColumn("created_at", F.current_timestamp()).withColumn("is_doc", is_document("file_path", "language")))
        own_files = rows.select("source_root", "file_path").distinct()
        counts = {}
        for table, test in (("code_chunks", ~F.col("is_doc")), ("doc_chunks", F.col("is_doc"))):
            stored, own = self.stored(table), rows.filter(test)
            if StoredIndex.there(self.spark, self._path(table) + "_index"):
                index = self.index(table)
                index.delete(stored.lookup(own_files).select("id").join(own.select("id"), "id", "left_anti"))
                index.upsert(own, "id")
            stored.upsert(own, deleted=own_files)
            counts[table] = stored.read().filter(F.col("source_root") == source.root).count()
        return counts

    def _path(self, table: str) -> str:
        where = self.spark.sql(f"DESCRIBE DATABASE {sinks.schema_name(self.schema)}").filter("info_name = 'Location'").first()["info_value"]
        return f"{where.rstrip('/')}/stored/{sinks.table_name(table)}"

    def stored(self, table: str) -> BucketTable:
        """The stored chunks: an ingest rewrites the buckets of the files that it read, and what others read meanwhile stays."""
        return chunk_table(self.spark, self._path(table))

    def chunks(self, table: str = "code_chunks") -> DataFrame:
        return self.stored(table).read()

    def index(self, table: str = "code_chunks", lists: int = 64, parts: int = 16) -> StoredIndex:
        """The stored index of a table's vectors, built when it is first asked for and kept in step by ingests."""
        path = self._path(table) + "_index"
        if StoredIndex.there(self.spark, path):
            return StoredIndex(self.spark, path)
        return StoredIndex.build(self.chunks(table), path, lists, parts, ("file_path", "language"), "id")

    def graph(self, source: files.Source) -> tuple[DataFrame, DataFrame]:
        return graph.project_files(files.parsed(files.tree(self.spark, source)), F.col("crate"))

    def _described(self, found: DataFrame) -> DataFrame:
        parsed = notes.notes(found).select("path", F.col("id").alias("node_id"), "type")
        return found.join(parsed, "path", "left").withColumn("content_hash", content_hash("text"))

    def _sinks(self, audit_path: str, stream: str, told: dict[str, int]) -> tuple[Sink, Sink, Sink]:
        """Of records, deletions and moves: each batch has a folder, which the batch, run again, replaces."""
        kept = BatchSink(self.spark, f"{audit_path}/records", "target string, payload string", "target")
        dead = BatchSink(self.spark, f"{audit_path}/tombstones", "id string, deleted_at timestamp, source_path string, last_known_hash string, reason string, deleted_date date", "deleted_date")

        def records(df: DataFrame, batch: int) -> None:
            kept.write(sinks.audit_rows(notes.derived_records(notes.notes(df.select("path", "text")))), stream, batch)
            told.update(sync.stats(df.select("status")).first().asDict())

        def gone(df: DataFrame, batch: int) -> None:
            told["deleted"] = dead.write(df, stream, batch)

        return records, gone, lambda df, _: told.update(renamed=df.count())

    def sync(self, root: str, state_path: str, batch: int | None, deleted_at: str, audit_path: str) -> dict[str, int]:
        """One sync of all notes below root; numbers by outcome. Records and tombstones go to audit_path. Without a number the batch is the one after the last; a batch that is run again replaces what it wrote."""
        snapshot = self._described(files.note_files(self.spark, root)).select("path", "content_hash", "node_id", "type", "text")
        told: dict[str, int] = {}
        records, gone, moved = self._sinks(audit_path, "sync", told)
        number = next_batch(self.spark, state_path) if batch is None else batch
        run_batch(snapshot, state_path, number, [records], [gone], deleted_at, [moved])
        return told

    def watch(self, root: str, state_path: str, audit_path: str, checkpoint: str, seconds: int = 1, told: dict[str, int] | None = None) -> StreamingQuery:
        """A stream that syncs the notes below root as they change; told gets the numbers of the last batch."""

        def describe(changes: DataFrame) -> DataFrame:
            return self._described(changes.withColumn("text", readable_text("content")).drop("content"))

        records, gone, moved = self._sinks(audit_path, "watch", {} if told is None else told)
        return start_changes(self.spark, root, state_path, checkpoint, describe, [records], [gone], [moved], {"include": "*.md"}, seconds)

    def query(self, text: str, limit: int = 10, table: str = "code_chunks", backend: str = "exact") -> DataFrame:
        """The chunks nearest to a text, the best of each file. Other backends ask the stored index first: `lists` some of its lists, `quantized` all codes."""
        chunks = self.chunks(table)
        if (kind := ann.backend(backend)) != "exact" and not chunks.isEmpty():
            asked = self.spark.createDataFrame([(0, self._vector(text))], "query_id long, embedding array<double>")
            near = self.index(table).search(asked, vector.over_fetch(limit), probes=PROBES if kind == "lists" else None)
            chunks = chunks.join(near.select("id"), "id", "left_semi")
        return vector.search(chunks.select("id", "file_path", "language", "line_start", "line_end", "embedding"), text, self._vector(text), limit)

    def evaluate(self, fixtures_root: str, k: int = 5) -> dict[str, Any]:
        return tools.retrieval_report(files.fixtures(self.spark, fixtures_root), self.chunks(), self._vector, k)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *names: [c := commands.add_parser(name), [c.add_argument(n, required=True) for n in names]][0]
    add("ingest", "--config", "--schema").add_argument("--reset", action="store_true")
    add("sync", "--root", "--state", "--audit").add_argument("--batch", type=int, help="the number of a batch that is run again; the next one if it is left out")
    w = add("watch", "--root", "--state", "--audit", "--checkpoint")
    w.add_argument("--seconds", type=int, default=1)
    w.add_argument("--once", action="store_true", help="ends when all changes so far are synced")
    add("session", "--logs", "--name").add_argument("--last", type=int, default=20)
    q = add("query", "--schema", "--text")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--backend", default="exact")
    add("evaluate", "--schema", "--fixtures").add_argument("--fail-below-a", action="store_true")
    add("verify", "--response", "--public-key")
    given = parser.parse_args(arguments)
    if given.command == "verify":
        with open(given.response, encoding="utf-8") as f:
            ok, reason = receipts.verify(json.load(f), receipts.Ed25519Verifier(bytes.fromhex(given.public_key)))
        print(reason)
        return int(not ok)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    if given.command == "sync":
        at = spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ssXXX\")").first()[0]
        print(json.dumps(Workspace(spark, "sync").sync(given.root, given.state, given.batch, at, given.audit)))
        return 0
    if given.command == "watch":
        told: dict[str, int] = {}
        stream = Workspace(spark, "sync").watch(given.root, given.state, given.audit, given.checkpoint, given.seconds, told)
        try:
            stream.processAllAvailable() if given.once else stream.awaitTermination()
        finally:
            stream.stop()
        print(json.dumps(told))
        return 0
    if given.command == "session":
        for row in sessions.tail(files.sessions(spark, given.logs).filter(F.col("session") == given.name), given.last).toJSON().collect():  # `last` rows
            print(row)
        return 0
    space = Workspace(spark, given.schema)
    if given.command == "ingest":
        with open(given.config, encoding="utf-8") as f:
            text = f.read()
        packs = set(re.findall(r'(?m)^pack\s*=\s*"([^"]+)"', text))
        for source in files.load_sources(text, given.config.rpartition("/")[0] or ".", packs):
            print(json.dumps({"root": source.root, **space.ingest(source, given.reset)}))
        return 0
    if given.command == "query":
        for row in space.query(given.text, given.limit, backend=given.backend).toJSON().collect():  # `limit` rows
            print(row)
        return 0
    report = space.evaluate(given.fixtures)
    print(json.dumps(report))
    return int(given.fail_below_a and report["grade"] != "A")


if __name__ == "__main__":
    sys.exit(main())
