"""Sync as a stream: records, moves and deletions are handed on as files change.

`start_changes` follows a tree by the source of file changes: a trigger opens the files that changed, reads the buckets of the state that
they are in, and rewrites those. `start` compares a snapshot of all files with the whole state at each trigger, for files that come from elsewhere.

What a trigger sees is written before anything is compared, so sinks and state see the same files even where executors are lost.
That state has a folder per version, named by the stream and batch that wrote it: a batch that is run again starts from the version before its
own, and a stream with a new checkpoint, whose batches count from 0 again, goes on from the newest.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.shared import settled
from corvane.operators import sync
from corvane.sources import changes as file_changes
from corvane.sources.buckets import BucketTable

Sink = Callable[[DataFrame, int], None]
STATE = "path string, content_hash string, node_id string"
#: Versions of the state that are left, the newest among them.
KEPT = 3


def run_batch(snapshot: DataFrame, state_path: str, batch: int, records: list[Sink], deletions: list[Sink], deleted_at: str, moves: list[Sink] | None = None, stream: str = "0") -> None:
    """One sync: changed files go to the record sinks, files that moved under their id to the sinks of moves, deleted ones to the deletion sinks; then the state is replaced."""
    spark = snapshot.sparkSession
    done = versions(spark, state_path)
    if done and done[-1].endswith(f"-{stream}-{batch}"):
        done.pop()  # this batch was run before
    number = int(done[-1].split("-")[1]) + 1 if done else 0
    state = _newest(spark, state_path, done)
    seen = f"{state_path}/snapshot-{number:010d}"
    snapshot.write.mode("overwrite").parquet(seen)
    now = spark.read.schema(snapshot.schema).parquet(seen)
    found = sync.changed(state, now)
    changed = found.join(now, "path", "left")
    for sink in records:
        sink(changed, batch)
    gone = sync.pruned(state, now)
    moved = sync.resolve_renames(gone, found.filter("status = 'created'").select("path", F.col("new_id").alias("node_id"))).filter("action = 'renamed_same_id'")
    for sink in moves or []:
        sink(moved, batch)
    left = gone.join(moved.select(F.col("src").alias("path")), "path", "left_anti")
    dead = sync.tombstones(left, deleted_at, "offline_prune")
    for sink in deletions:
        sink(dead, batch)
    sync.next_state(state, now).write.mode("overwrite").parquet(f"{state_path}/version-{number:010d}-{stream}-{batch}")
    _forget(spark, state_path, [*done[: -KEPT + 1]], number)


#: What Spark says of files that are no Parquet or not whole.
_DAMAGE = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "Could not read footer")


def _newest(spark: SparkSession, state_path: str, done: list[str]) -> DataFrame:
    """The newest version that can be read, an empty state if there is none: a damaged one is told as a warning, and files since then count as new."""
    for name in reversed(done):
        try:
            return settled(spark.read.parquet(f"{state_path}/{name}"))
        except Exception as e:
            if not any(d in str(e) for d in _DAMAGE):
                raise
            warnings.warn(f"the state {state_path}/{name} is damaged and left out", stacklevel=2)
    return spark.createDataFrame([], STATE)


def next_batch(spark: SparkSession, state_path: str, stream: str = "0") -> int:
    """The number after the stream's last batch."""
    own = [int(n.rpartition("-")[2]) for n in versions(spark, state_path) if n.split("-", 2)[2].rpartition("-")[0] == stream]
    return max(own, default=-1) + 1


def state_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """The state that run_changes keeps."""
    return BucketTable(spark, path, STATE, ["path"], buckets)


def run_changes(changes: DataFrame, state: BucketTable, batch: int, describe: Callable[[DataFrame], DataFrame], records: list[Sink], deletions: list[Sink], deleted_at: str, moves: list[Sink] | None = None, stream: str = "0") -> None:
    """One sync by changes: path, change, old_path and content of the source of file changes.

    describe: adds content_hash and node_id, and what the sinks take, to path, change, old_path, content. Sinks come before the state, and the state knows its
    last batch: a batch that was killed on the way is run again whole, one that was done is not.
    """
    if state.done(stream) >= batch:
        return
    own = settled(describe(changes))
    old = settled(state.lookup(own.select("path").union(own.filter("old_path is not null").select(F.col("old_path").alias("path")))))
    now = own.filter(F.col("change").isin("created", "modified", "moved"))
    left = own.filter("change = 'deleted'").select("path").union(own.filter("change = 'moved'").select("old_path"))
    found = sync.changed(old, now)
    changed = found.join(now, "path")
    for sink in records:
        sink(changed, batch)
    gone = old.join(left, "path", "left_semi")
    moved = sync.resolve_renames(gone, found.filter("status = 'created'").select("path", F.col("new_id").alias("node_id"))).filter("action = 'renamed_same_id'")
    for sink in moves or []:
        sink(moved, batch)
    dead = sync.tombstones(gone.join(moved.select(F.col("src").alias("path")), "path", "left_anti"), deleted_at, "file_deleted")
    for sink in deletions:
        sink(dead, batch)
    state.upsert(now.select("path", "content_hash", "node_id"), left, writer=(stream, batch))
    state.forget()


def start_changes(spark: SparkSession, root: str, state_path: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame], records: list[Sink], deletions: list[Sink], moves: list[Sink] | None = None, options: dict[str, str] | None = None, seconds: int = 1, buckets: int = 64) -> StreamingQuery:
    """A query that follows the tree below root; its listings are kept beside its state."""
    file_changes.register(spark)
    state = state_table(spark, f"{state_path}/files", buckets)
    own = {"path": root, "listings": f"{state_path}/listings"} | (options or {})

    def each(df: DataFrame, batch: int) -> None:
        run_changes(df, state, batch, describe, records, deletions, _now(spark), moves, "changes")

    source = spark.readStream.format("corvane_changes").options(**own).load()
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def _now(spark: SparkSession) -> str:
    return spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ssXXX\")").first()[0]


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, state_path: str) -> list[str]:
    """The complete versions of a state, the oldest first."""
    jvm, root, fs = _folder(spark, state_path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in names if n.startswith("version-") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))


def _forget(spark: SparkSession, state_path: str, old: list[str], number: int) -> None:
    """Removes versions that no batch will start from, and snapshots before this one."""
    jvm, root, fs = _folder(spark, state_path)
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    for name in [*old, *(n for n in names if n.startswith("snapshot-") and int(n.split("-")[1]) < number)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)


def start(spark: SparkSession, snapshot: Callable[[], DataFrame], state_path: str, checkpoint: str, records: list[Sink], deletions: list[Sink], seconds: int = 1, moves: list[Sink] | None = None) -> StreamingQuery:
    """A query that syncs every few seconds; modified and deleted files are found by comparing snapshots, which file sources do not do."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def each(_: DataFrame, batch: int) -> None:
        run_batch(snapshot(), state_path, batch, records, deletions, _now(spark), moves, stream)

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def changes_since(files: DataFrame, modified_after: str) -> DataFrame:
    return files.filter(F.col("modified") > F.to_timestamp(F.lit(modified_after)))
