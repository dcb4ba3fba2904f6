"""Line dedup by suffix ranks over line-id sequences, built by distributed prefix doubling.

Every line with a word is a symbol; a document is a sequence of symbols. Round k names each run of 2^k lines by its place
among the sorted distinct runs, from the names of its two halves, so a name is the rank of a suffix by its first 2^k lines.
Suffixes that stand alone in their rank are left out of later rounds, as no repeated run begins there. The suffixes that
share their first d lines are one longest-common-prefix interval of depth d; for any d of 2^k or more, less than 2^(k+1),
it is named by the ranks of its first and its last 2^k lines. A run counts when it has `min_words` words. A maximal repeated run
is the union of the shortest runs of that size which it holds, taken from each of its lines forwards and backwards, so
doubling may stop at the longest of these, and a line is deleted if one of them, with that line in it, also stands at an earlier
place. Places are ordered by doc_id, then line, so the first copy of each maximal run is left.

Exact copies of a text are folded into the one with the smallest id before any line is looked at: a later copy is one
repeated run from end to end.

Results for edge cases: null and empty texts have no lines and lose none. Texts and lines of any length are read whole. Lines without words are no symbols: they neither
end a run nor are deleted with it. A null id counts as smaller than all ids. Repeated rows (same id and text) are one document;
rows that share an id but differ in text are ordered by a hash of the text. Empty tables give an empty result. Other
columns are not read by repeated_runs() and are passed on by dedup_lines().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Rows, Scratch, map_arrow, rows_of, small_batches

NULL_ID = -(1 << 63)
_LINE = np.dtype([("a", "<u8"), ("b", "<u8"), ("ahead", "<i4"), ("back", "<i4")])


def reach(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the fewest lines from it onwards, and up to it, that hold min_words words; 0 if there are too few."""
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(counts))
    end = np.searchsorted(total, total[:-1] + min_words)
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    return np.where(end <= len(counts), end - at, 0), np.where(total[1:] >= min_words, at + 1 - begin, 0)


def _documents(min_words: int):
    schema = pa.schema([("id", pa.int64()), ("h", pa.binary()), ("n_lines", pa.int32()), ("n_words", pa.int64()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest = Rows(schema, 2_000), xxhash.xxh3_128_digest
        for batch in batches:
            for i, text, h in rows_of(batch):
                lines = [line for line in text.split(b"\n") if line.split()] if text else []
                counts = np.array([len(line.split()) for line in lines], np.int64)
                table = np.zeros(len(lines), _LINE)
                ids = np.frombuffer(b"".join(map(digest, lines)), "<u8").reshape(-1, 2)
                table["a"], table["b"] = ids[:, 0], ids[:, 1]
                table["ahead"], table["back"] = reach(counts, min_words)
                words = int(counts.sum())
                out.add(i, h, len(lines), words, table.tobytes() if words >= min_words else b"")
                if out.full:
                    yield out.take()
        yield out.take()

    return run, "id long, h binary, n_lines int, n_words long, lines binary"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, lines in rows_of(batch):
            t = np.frombuffer(lines, _LINE)
            cols = [np.full(len(t), doc, np.int64), np.arange(len(t), dtype=np.int32), t["a"].astype(np.int64), t["b"].astype(np.int64), t["ahead"], t["back"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["doc", "at", "a", "b", "ahead", "back"])


def _ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Numbers that grow with the sorted keys; to be written before use. Range partitions keep the order without one sorting task."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40) -> DataFrame:
    """The runs of lines to delete: doc_id, text_md5, line_start, line_end (counted over lines with words, from 0, end not included), n_lines of the document."""
    scratch = Scratch(docs.sparkSession, "lines")
    run, schema = _documents(min_words)
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    every = scratch.keep(text.select("id", "text", F.unhex(F.md5("text")).alias("h")).filter("text is not null").transform(map_arrow, run, schema).filter(F.col("n_words") >= min_words), "documents")
    first = scratch.keep(_ranked(every.groupBy("h").agg(F.min("id").alias("first")), ["first", "h"], "doc"), "first")
    mine = every.join(first.withColumnRenamed("first", "id"), ["h", "id"]).dropDuplicates(["doc"]).select("doc", "lines")
    lines = scratch.keep(mine.transform(map_arrow, _explode, "doc long, at int, a long, b long, ahead int, back int"), "lines")

    names = scratch.keep(_ranked(lines.groupBy("a", "b").count().filter("count > 1").drop("count"), ["a", "b"], "rank"), "names")
    active = scratch.keep(lines.join(names, ["a", "b"]).select("doc", "at", "rank", "ahead", "back"), "active")
    scratch.drop(lines, names)
    level = active.select("doc", "at", "rank")
    windows = active.filter("ahead > 0").select("doc", "at", F.col("ahead").alias("d")).union(active.filter("back > 0").select("doc", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("d"))).distinct()
    longest = active.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0  # min_words at most
    flagged = None
    size, spent = 1, []
    while size <= longest:
        # The first and last `size` lines name the interval that a window of this size class belongs to.
        own = windows.filter((F.col("d") >= size) & (F.col("d") < 2 * size))
        named = scratch.keep(_named(own, level, size), "named")
        # Written, so that both sides of the join below are shuffled for it and Spark may split the rows of a hot interval.
        interval = scratch.keep(named.groupBy("d", "rank", "last").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "intervals")
        later = scratch.keep(named.join(interval, ["d", "rank", "last"]).filter(F.struct("doc", "at") > F.col("first")).select("doc", "at", "d"), "later")
        scratch.drop(named, interval)
        flagged = later if flagged is None else flagged.union(later)
        if 2 * size > longest:
            break
        pairs = level.join(level.select("doc", (F.col("at") - F.lit(size)).alias("at"), F.col("rank").alias("next")), ["doc", "at"])
        keys = scratch.keep(_ranked(pairs.groupBy("rank", "next").count().filter("count > 1").drop("count"), ["rank", "next"], "new"), "names")
        following = scratch.keep(pairs.join(keys, ["rank", "next"]).select("doc", "at", F.col("new").alias("rank")), "level")
        scratch.drop(keys, *spent)
        level, spent, size = following, [following], 2 * size

    result = "doc long, line_start int, line_end int"
    if flagged is None:
        runs = docs.sparkSession.createDataFrame([], result)
    else:
        runs = flagged.groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("d").alias("d")).transform(map_arrow, _merged, result)
    in_first = runs.join(first, "doc").select("h", F.col("first").alias("id"), "line_start", "line_end")
    copies = every.select("h", "id", "n_lines").distinct().join(first.select("h", "first"), "h")
    whole = copies.filter("id > first").select("h", "id", F.lit(0).alias("line_start"), F.col("n_lines").alias("line_end"))
    found = scratch.keep(in_first.union(whole).join(every.select("h", "id", "n_lines").distinct(), ["h", "id"]), "runs")
    scratch.drop(every, first, active, *spent)
    return found.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.col("h").alias("text_md5"), "line_start", "line_end", "n_lines")


def _named(windows: DataFrame, level: DataFrame, size: int) -> DataFrame:
    """Windows with the ranks of their first and last `size` lines; those with a line that stands alone have none and go."""
    begin = windows.join(level, ["doc", "at"]).withColumn("tail", F.col("at") + F.col("d") - F.lit(size))
    return begin.join(level.select("doc", F.col("at").alias("tail"), F.col("rank").alias("last")), ["doc", "tail"]).select("doc", "at", "d", "rank", "last")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Rows(pa.schema([("doc", pa.int64()), ("line_start", pa.int32()), ("line_end", pa.int32())]))
    for batch in batches:
        for doc, at, d in rows_of(batch):
            begin = end = -1
            for s, n in sorted(zip(at, d, strict=True)):
                if s > end:
                    if end >= 0:
                        out.add(doc, begin, end)
                    begin, end = s, s + n
                else:
                    end = max(end, s + n)
            out.add(doc, begin, end)
        if out.full:
            yield out.take()
    yield out.take()


def drop_lines(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    gone = {k for s, e in spans for k in range(s, e)}
    left, k = [], 0
    for line in text.split(b"\n"):
        if line.split():
            if k not in gone:
                left.append(line)
            k += 1
        else:
            left.append(line)
    return b"\n".join(left)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = 40) -> DataFrame:
    """docs with the deleted lines taken out of the text; a document that loses every line goes. length_col, where docs have it, follows the text."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    spans = runs.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__corvane_i"), F.col("text_md5").alias("__corvane_h")).agg(F.collect_list("line_start").alias("__corvane_s"), F.collect_list("line_end").alias("__corvane_e"), F.max("n_lines").alias("__corvane_n"), F.sum(F.col("line_end") - F.col("line_start")).alias("__corvane_gone"))
    small_batches(docs.sparkSession)
    keyed = docs.withColumns({"__corvane_ki": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "__corvane_kh": F.unhex(F.md5(F.col(text_col).cast("binary")))})
    # Merged at every size: a broadcast at small sizes alone would hide the shuffle of the texts that larger ones need.
    joined = keyed.join(spans.hint("merge"), (F.col("__corvane_ki") == F.col("__corvane_i")) & (F.col("__corvane_kh") == F.col("__corvane_h")), "left").filter("__corvane_gone is null or __corvane_gone < __corvane_n")
    cut = _cut(F.when(F.col("__corvane_gone").isNotNull(), F.col(text_col)), F.col("__corvane_s"), F.col("__corvane_e"))
    text = F.when(F.col("__corvane_gone").isNull(), F.col(text_col)).otherwise(cut)
    names = docs.columns
    out = joined.withColumn("__corvane_new", text)
    length = {length_col: F.when(F.col("__corvane_gone").isNull(), F.col(length_col)).otherwise(F.length("__corvane_new")).cast(docs.schema[length_col].dataType)} if length_col in names else {}
    return out.withColumns(length | {text_col: F.col("__corvane_new")}).select(*[F.col(f"`{n}`") for n in names])


@F.arrow_udf(T.StringType())
def _cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
    return pa.array([None if t is None else drop_lines(t.encode(), list(zip(s, e, strict=True))).decode() for t, s, e in rows], pa.string())


#: Runs of equal lines on each diagonal of two places; only for small tables, as it lists all pairs of equal lines.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM d),
w AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM x),
y AS (SELECT doc_id, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM w WHERE words > 0),
n AS (SELECT doc_id, count(*) AS n_lines FROM y GROUP BY doc_id),
m AS (SELECT a.doc_id, a.p, a.words, b.doc_id AS other, a.p - b.p AS gap FROM y a JOIN y b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.p < a.p))),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, other, gap ORDER BY p) AS island FROM m),
r AS (SELECT doc_id, min(p) AS s, max(p) AS e FROM g GROUP BY doc_id, other, gap, island HAVING sum(words) >= 40),
t AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS p FROM r),
q AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM t)
SELECT q.doc_id, CAST(min(p) AS INTEGER) AS line_start, CAST(max(p) + 1 AS INTEGER) AS line_end, CAST(any_value(n_lines) AS INTEGER) AS n_lines
FROM q JOIN n ON n.doc_id = q.doc_id GROUP BY q.doc_id, island
"""
