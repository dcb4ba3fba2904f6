"""Incremental sync: what changed between a state table and a snapshot of files, renames, deletions and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(state: DataFrame, files: DataFrame) -> DataFrame:
    """path, status, old_hash, new_hash, old_id, new_id. status: created, updated, unchanged or deleted.

    state: path, content_hash, node_id. files: path, content_hash, node_id.
    """
    old = state.select("path", F.col("content_hash").alias("old_hash"), F.col("node_id").alias("old_id"), F.lit(True).alias("_o"))
    new = files.select("path", F.col("content_hash").alias("new_hash"), F.col("node_id").alias("new_id"), F.lit(True).alias("_n"))
    both = old.join(new, "path", "full")
    status = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("updated")
    return both.select("path", status.alias("status"), "old_hash", "new_hash", "old_id", "new_id")


def changed(state: DataFrame, files: DataFrame) -> DataFrame:
    return diff(state, files).filter(F.col("status").isin("created", "updated"))


def pruned(state: DataFrame, files: DataFrame) -> DataFrame:
    """State of paths that are gone."""
    return state.join(files.select("path"), "path", "left_anti")


def process_status(readable: Column, has_frontmatter: Column, note_type: Column, unchanged: Column) -> Column:
    """What becomes of a changed file."""
    return F.when(~readable, "io_error").when(unchanged, "unchanged").when(~has_frontmatter, "no_frontmatter").when(note_type.isNull(), "no_type").otherwise("processed")


def renames(moves: DataFrame) -> DataFrame:
    """action of each move (src, dest, old_id, new_id, readable): identity is kept if the id stays, else delete and create."""
    old, new = F.col("old_id"), F.col("new_id")
    action = F.when(~F.col("readable"), "delete_only").when(old.isNotNull() & new.isNotNull() & (old == new), "renamed_same_id").when(old.isNotNull() & new.isNotNull(), "renamed_new_id").when(new.isNotNull(), "create_only").when(old.isNotNull(), "delete_only").otherwise("noop")
    out = moves.withColumn("action", action)
    return out.withColumn("emits_delete", F.col("action").isin("renamed_new_id", "delete_only") & old.isNotNull()).withColumn("emits_record", F.col("action").isin("renamed_same_id", "renamed_new_id", "create_only"))


def resolve_renames(deleted: DataFrame, created: DataFrame) -> DataFrame:
    """Pairs deletions and creations of one snapshot by node id: full outer, so what has no partner stays a delete or create."""
    d = deleted.select(F.col("path").alias("src"), F.col("node_id").alias("node_id"))
    c = created.select(F.col("path").alias("dest"), F.col("node_id").alias("node_id"))
    known = d.filter("node_id is not null").join(c.filter("node_id is not null"), "node_id", "full")
    rest = d.filter("node_id is null").select("node_id", "src", F.lit(None).cast("string").alias("dest")).unionAll(c.filter("node_id is null").select("node_id", F.lit(None).cast("string").alias("src"), "dest"))
    kind = F.when(F.col("src").isNotNull() & F.col("dest").isNotNull(), "renamed_same_id").when(F.col("dest").isNotNull(), "create_only").otherwise("delete_only")
    return known.select("node_id", "src", "dest").unionAll(rest).withColumn("action", kind)


def tombstones(gone: DataFrame, deleted_at: str, reason: str) -> DataFrame:
    """Append-only audit rows, partitioned by deleted_date when written."""
    at = F.to_timestamp(F.lit(deleted_at))
    return gone.select(F.col("node_id").alias("id"), at.alias("deleted_at"), F.col("path").alias("source_path"), F.col("content_hash").alias("last_known_hash"), F.lit(reason).alias("reason"), F.to_date(at).alias("deleted_date"))


def stats(statuses: DataFrame, status: str = "status") -> DataFrame:
    """Files seen and the number of each outcome, those without a counter included."""
    names = ("processed", "unchanged", "no_frontmatter", "no_type", "io_error", "created", "updated", "deleted")
    return statuses.agg(F.count("*").alias("files_seen"), *(F.count_if(F.col(status) == n).alias(n) for n in names))


def next_state(state: DataFrame, files: DataFrame) -> DataFrame:
    """State after a sync: the files' own hashes and ids."""
    return files.select("path", "content_hash", "node_id", *(c for c in state.columns if c not in ("path", "content_hash", "node_id") and c in files.columns))


def replay(events: DataFrame) -> DataFrame:
    """Final version of each logical id after a sequence of operations (seq, op, id, version); deleted ids are gone."""
    last = events.groupBy("id").agg(F.max_by(F.struct("op", "version", "path"), "seq").alias("l"))
    return last.filter("l.op != 'delete'").select("id", "l.version", "l.path")
