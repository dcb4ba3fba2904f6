"""Scans of file trees, notes, session logs, fixtures and configuration."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import content_hash, is_skipped, path_selected, readable_text
from corvane.operators.chunking import chunk, language

EVENT = T.StructType([T.StructField(n, t) for n, t in (("t", T.TimestampType()), ("event", T.StringType()), ("tool", T.StringType()), ("file", T.StringType()), ("sha_before", T.StringType()), ("sha_after", T.StringType()), ("cmd", T.StringType()), ("exit", T.IntegerType()), ("failures", T.ArrayType(T.StringType())), ("kind", T.StringType()), ("reason", T.StringType()), ("_corrupt_record", T.StringType()))])


@dataclass(frozen=True)
class Source:
    pack: str
    root: str
    glob: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())


class ConfigError(ValueError):
    pass


def load_sources(text: str, base: str, packs: set[str]) -> list[Source]:
    """[[source]] tables of a TOML text; `include` is another name of `glob`, roots are relative to base."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from e
    found = data.get("source")
    if not isinstance(found, list) or not found:
        raise ConfigError("needs at least one [[source]]")
    out = []
    for n, s in enumerate(found):
        if not isinstance(s, dict):
            raise ConfigError(f"source {n} is no table")
        if unknown := set(s) - {"pack", "root", "glob", "include", "exclude"}:
            raise ConfigError(f"source {n} has unknown keys: {', '.join(sorted(unknown))}")
        if "glob" in s and "include" in s:
            raise ConfigError(f"source {n} has both glob and include")
        pack, root = s.get("pack"), s.get("root")
        if not isinstance(pack, str) or pack not in packs:
            raise ConfigError(f"source {n} has an unknown pack: {pack!r}")
        if not isinstance(root, str) or not root:
            raise ConfigError(f"source {n} has no root")
        lists = [s.get("glob", s.get("include", [])), s.get("exclude", [])]
        for given in lists:
            if not isinstance(given, list) or not all(isinstance(x, str) and x for x in given):
                raise ConfigError(f"source {n}: glob and exclude are lists of patterns")
        out.append(Source(pack, root if "://" in root or root.startswith("/") else str(PurePosixPath(base) / root), tuple(lists[0]), tuple(lists[1])))
    return out


def default_sources(candidates: list[str], exists: Callable[[str], bool]) -> str | None:
    """The first `sources.toml` of the folders, in their order: the working folder before the repository."""
    return next((p for p in (f"{c.rstrip('/')}/sources.toml" for c in candidates) if exists(p)), None)


def tree(spark: SparkSession, source: Source) -> DataFrame:
    """path (relative to the root), text (null for binary files), size, modified of the files that a source selects.

    What is selected is said of the files' metadata alone, so that files of skipped folders are left out of the scan before any content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source.root)
    path = below(source.root)
    kept = raw.filter(~is_skipped(path) & path_selected(path, list(source.glob), list(source.exclude)))
    return kept.select(path.alias("path"), readable_text("content").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_path() -> Column:
    """The path of a row's file as it is written on disk; metadata has it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def below(root: str) -> Column:
    """The path of a row's file, relative to the root."""
    return F.regexp_replace(file_path(), "^.*?" + escaped(root.split("://")[-1].rstrip("/")) + "/", "")


def escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def parsed(files: DataFrame) -> DataFrame:
    """Adds language, crate (the directory after `crates/`) and content_hash; files that no chunker takes go."""
    crate = F.coalesce(F.nullif(F.regexp_extract("path", "^crates/([^/]+)/", 1), F.lit("")), F.lit("unknown"))
    known = files.withColumn("language", language("path")).filter("language is not null and text is not null")
    own = known.withColumn("text", F.when(F.col("language") == "rust", "").otherwise(F.col("text")))  # a node of the graph, without chunks
    return own.withColumn("crate", crate).withColumn("content_hash", content_hash("text"))


def ingest(files: DataFrame, source_root: str) -> DataFrame:
    """Chunk rows of parsed files: file_path, source_root, language, ordinal, name, kind, line_start, line_end, text."""
    chunks = chunk(files, "path", "text", "language").withColumnRenamed("id", "file_path")
    return chunks.join(files.select(F.col("path").alias("file_path"), "language"), "file_path").withColumn("source_root", F.lit(source_root))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Events of session logs, one JSON object a line; malformed lines are left out, counted by malformed()."""
    return _events(spark, path).filter("_corrupt_record is null").drop("_corrupt_record")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    return _events(spark, path).groupBy("session").agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"))


def _events(spark: SparkSession, path: str) -> DataFrame:
    """idx is an event's place in its file, blank lines left out, however the file is split."""
    lines = spark.read.text(path).select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").filter(F.trim("value") != "")
    session = F.regexp_extract("path", "([^/]+?)(?:\\.jsonl?)?$", 1)
    place = Window.partitionBy("session").orderBy("path", "block", "at")
    raw = lines.withColumn("session", session).withColumn("idx", F.row_number().over(place).cast("long") - 1)
    return raw.select("session", "idx", F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")).select("session", "idx", "e.*")


def note_files(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    return raw.select(below(root).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """Retrieval fixtures (YAML): id, category, query, expected. Examples and files without id or expected are left out; what else is left out says broken_fixtures()."""
    return _fixtures(spark, root).filter("reason is null").select("id", "category", "query", "expected")


def broken_fixtures(spark: SparkSession, root: str) -> DataFrame:
    """path, reason of the files that are no fixtures."""
    return _fixtures(spark, root).filter("reason is not null").select("path", "reason")


def _fixtures(spark: SparkSession, root: str) -> DataFrame:
    """A row for each file but the examples, parsed where the files are read."""
    names = ["path", "id", "category", "query", "expected", "reason"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *_fixture(text)) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=names)

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.yml").text(root, wholetext=True)
    files = raw.select(below(root).alias("path"), "value").filter(~F.concat(F.lit("/"), "path").rlike("/_example|/example\\.yml$"))
    return files.mapInArrow(parse, "path string, id string, category string, query string, expected array<string>, reason string")


def _fixture(text: str) -> tuple:
    """id, category, query, expected, and why they are none."""
    import yaml

    try:
        d = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return None, None, None, None, f"not YAML: {str(e).splitlines()[0]}"
    if not isinstance(d, dict):
        return None, None, None, None, "no mapping"
    missing = [k for k in ("id", "expected") if not d.get(k)]
    if missing:
        return None, None, None, None, f"without {missing[0]}"
    want = d["expected"] if isinstance(d["expected"], list) else [d["expected"]]
    named = [None if d.get(k) is None else str(d[k]) for k in ("category", "query")]
    return str(d["id"]), *named, [str(x) for x in want], None


def merged_fixtures(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """All fixtures; those of extra only under ids that primary lacks."""
    return primary.unionByName(extra.join(primary.select("id"), "id", "left_anti"), allowMissingColumns=True)
