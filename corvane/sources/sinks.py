"""Tables of the stores: creation, checked appends, audit logs and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.vectors import checked

CHUNKS = "id bigint, file_path string, source_root string, language string, line_start int, line_end int, chunk_text string, embedding array<float>, properties string, created_at timestamp, kind string"
_NAME = re.compile(r"[a-z][a-z0-9_]*")
TABLES = ("code_chunks", "doc_chunks")


def schema_name(name: str) -> str:
    """A schema name that is safe in SQL text."""
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not a schema name: {name!r}")
    return name


def resolve_schema(flag: str | None, env: str | None, default: str) -> str:
    """A flag counts before the environment, and that before the default."""
    return schema_name(flag or env or default)


def table_name(name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"not a chunk table: {name!r}")
    return name


def bootstrap(spark: SparkSession, schema: str) -> None:
    """Creates the schema and its chunk tables, partitioned by source; again is harmless."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema_name(schema)}")
    for t in TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{t} ({CHUNKS.replace('source_root string, ', '')}, source_root string) USING parquet PARTITIONED BY (source_root)")


def append_chunks(chunks: DataFrame, schema: str, table: str, dim: int) -> None:
    """Appends chunks whose embeddings have the right length; the job fails otherwise."""
    spark = chunks.sparkSession
    name = f"{schema_name(schema)}.{table_name(table)}"
    wanted = spark.table(name).columns
    rows = chunks.withColumn("embedding", checked("embedding", dim))
    for c in wanted:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(spark.table(name).schema[c].dataType))
    rows.select(*wanted).write.mode("append").insertInto(name)


def replace_files(chunks: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks after an ingest: those of files that were read again take the place of the old ones."""
    return old.join(chunks.select("source_root", "file_path").distinct(), ["source_root", "file_path"], "left_anti").unionByName(chunks, allowMissingColumns=True)


def reset(spark: SparkSession, schema: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {schema_name(schema)} CASCADE")
    bootstrap(spark, schema)


def audit_rows(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """target, payload (JSON) of derived records, targets renamed by aliases."""
    target = F.col("target")
    if aliases:
        target = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), target), target)
    return records.select(target.alias("target"), F.to_json(F.col("payload")).alias("payload"))


def append_json(rows: DataFrame, path: str, partition: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(partition) if partition else w).json(path)


def append_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Appends nodes in a folder for each label and edges in one for each relationship, so that a batch of one kind is one folder."""
    for rows, kind, name in ((nodes, "label", "nodes"), (edges, "relationship", "edges")):
        rows.repartition(kind, F.pmod(F.hash(*[c for c in rows.columns if not rows.schema[c].dataType.simpleString().startswith("map")]), F.lit(32))).write.mode("append").partitionBy(kind).parquet(f"{path}/{name}")


def dry_run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def seed_notes(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """What to write of seeds (slug, hash, body): new, changed or skipped, with the part below the human mark kept."""
    mark = "<!-- human -->"
    old = existing.select("slug", F.regexp_extract("text", "(?m)^seed-hash: (\\S+)$", 1).alias("old_hash"), F.when(F.instr("text", mark) > 0, F.substring_index("text", mark, -1)).alias("human"))
    both = seeds.join(old, "slug", "left")
    status = F.when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") == F.col("hash"), "skipped").otherwise("updated")
    return both.select("slug", status.alias("status"), F.concat(F.lit("seed-hash: "), "hash", F.lit("\n"), "body", F.lit(f"\n{mark}"), F.coalesce("human", F.lit("\n"))).alias("text"))


def markdown_table(rows: DataFrame, title: str, most: int = 200) -> str:
    """A report of a small result; over `most` rows are refused rather than cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in found)
