"""Vector search: exact cosine top-k, alone or for many queries in one job, with filters, reranking and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.prior import Prior
from corvane.functions.shared import settled
from corvane.functions.vectors import cosine

#: Bytes of query vectors that are sent to the tasks at once, queries and vectors that are multiplied at once (16 MB of products), and products that are selected from at once.
QUERY_BYTES = 64 << 20
QUERY_ROWS = 1_024
VECTOR_ROWS = 2_048
SELECTED = 1 << 18


def scored(vectors: DataFrame, query: list[float], embedding: str = "embedding", score: str = "similarity") -> DataFrame:
    return vectors.withColumn(score, F.round(cosine(F.col(embedding), F.array(*(F.lit(float(x)) for x in query))), 6))


def with_filters(vectors: DataFrame, tenant: str | int | None = None, properties: dict[str, object] | None = None, tenant_col: str = "tenant", properties_col: str = "properties") -> DataFrame:
    """Keeps a tenant (None: all; an empty string is a tenant) and rows whose JSON properties contain the given ones."""
    out = vectors if tenant is None else vectors.filter(F.col(tenant_col) == F.lit(tenant))
    return out.filter(contains_properties(properties_col, properties)) if properties else out


def contains_properties(column: str, wanted: dict[str, object]) -> Column:
    """Whether a JSON string column contains the wanted value: objects hold at least the wanted keys, arrays at least the wanted items, and scalars, null among them, are equal in type and value. False where the text is null or no JSON."""
    return F.coalesce(_contains(F.try_parse_json(F.col(column)), wanted), F.lit(False))


def _contains(found: Column, wanted: object) -> Column:
    """Containment in a variant; null or false where it is none."""
    kind = F.schema_of_variant(found)
    if isinstance(wanted, dict):
        return reduce(Column.__and__, (_contains(F.try_variant_get(found, f"$[{_quoted(k)}]", "variant"), v) for k, v in wanted.items()), kind.startswith("OBJECT"))
    if isinstance(wanted, (list, tuple)):
        items = F.try_variant_get(found, "$", "array<variant>")
        among = lambda v: F.exists(items, lambda x: F.coalesce(_contains(x, v), F.lit(False)))
        return reduce(Column.__and__, map(among, wanted), kind.startswith("ARRAY"))
    if wanted is None:
        return F.is_variant_null(found)
    if isinstance(wanted, bool):
        return F.try_variant_get(found, "$", "boolean").eqNullSafe(F.lit(wanted)) & (kind == "BOOLEAN")
    if isinstance(wanted, (int, float)):
        return F.try_variant_get(found, "$", "double").eqNullSafe(F.lit(float(wanted))) & (kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE"))
    return F.try_variant_get(found, "$", "string").eqNullSafe(F.lit(str(wanted))) & (kind == "STRING")


def _quoted(key: str) -> str:
    """A key of any characters, but not with both kinds of quotes, as a step of a path."""
    mark = '"' if "'" in key else "'"
    if mark in key:
        raise ValueError(f"not a property name: {key!r}")
    return f"{mark}{key}{mark}"


def allowed(vectors: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is in the list, before any top-k."""
    return vectors.join(ids.select(id_col).distinct(), id_col, "left_semi")


def top_k(rows: DataFrame, k: int, tie: str, score: str = "similarity") -> DataFrame:
    return rows.orderBy(F.desc(score), tie).limit(k)


def best_per(rows: DataFrame, key: str, tie: str, score: str = "similarity") -> DataFrame:
    """The best row of each key. An aggregate with map-side combining, so a key with most of the rows is no hot task."""
    others = [c for c in rows.columns if c not in (key, score, tie)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(score, tie, *others), F.struct(F.col(score), (-F.col(tie)))).alias("_b"))
    return best.select(key, "_b.*")


def distinct_top_k(rows: DataFrame, k: int, key: str, tie: str, score: str = "similarity") -> DataFrame:
    """Best chunk of each file, nearest first, file path as the tie break."""
    return best_per(rows, key, tie, score).orderBy(F.desc(score), key).limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id", query_embedding: str = "embedding", group: str | None = None) -> DataFrame:
    """query_id, id, similarity, rank of the k nearest vectors of every query, and with group the best of each group only.

    Queries are sent to the tasks until they fill QUERY_BYTES, one scan of the vectors for each such block. A task multiplies VECTOR_ROWS vectors
    by QUERY_ROWS queries at a time and hands on the k best vectors, or groups, of each query: a vector or group among the k best of all has
    fewer than k better ones in any task. So the shuffle carries k rows for each query and task.
    """
    own = vectors.filter(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).alias("e"), _tag(group).alias("tag"))
    every = reduce(DataFrame.unionAll, (own.mapInArrow(nearest(spark_block, k, group is not None), NEAREST) for spark_block in query_blocks(vectors.sparkSession, queries, query_id, query_embedding)))
    if not group:
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return every.drop("tag").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = every.groupBy("query_id", "tag").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b")).select("query_id", "b.id", "b.similarity", "tag")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "tag")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", "similarity", F.when(F.col("tag") != "", F.substr("tag", F.lit(2))).alias(group), "rank")


def _tag(group: str | None) -> Column:
    """A group as text that sorts like it, without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def query_blocks(spark: SparkSession, queries: DataFrame, query_id: str, embedding: str) -> Iterator[Broadcast]:
    """Ids and unit vectors of the queries, read through an iterator, in blocks of at most QUERY_BYTES; one empty block if there are none."""
    keys: list[int] = []
    rows: list[np.ndarray] = []
    held = sent = 0
    for row in queries.select(F.col(query_id).cast("long"), embedding).toLocalIterator():
        keys.append(row[0])
        rows.append(np.array(row[1], np.float64))
        held += rows[-1].nbytes
        if held >= QUERY_BYTES:
            yield spark.sparkContext.broadcast((np.array(keys, np.int64), unit_rows(np.stack(rows))))
            keys, rows, held, sent = [], [], 0, sent + 1
    if rows or not sent:
        yield spark.sparkContext.broadcast((np.array(keys, np.int64), unit_rows(np.stack(rows)) if rows else np.zeros((0, 1))))


def vector_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, at most VECTOR_ROWS at a time and never none: what a task makes of a block is bounded, whatever the session's batches are."""
    for b in batches:
        for at in range(0, b.num_rows, VECTOR_ROWS):
            yield b.slice(at, VECTOR_ROWS)


NEAREST = "query_id long, id long, similarity double, tag string"


class Best:
    """The k best of each query so far, as arrays of query, id, similarity and tag; with by_tag the best of each tag counts alone."""

    def __init__(self, k: int, by_tag: bool):
        self.k, self.by_tag = k, by_tag
        self.rows: tuple[np.ndarray, ...] | None = None

    def add(self, query: np.ndarray, id_: np.ndarray, similarity: np.ndarray, tag: np.ndarray) -> None:
        new = (query, id_, similarity, tag)
        self.rows = new if self.rows is None else tuple(np.concatenate(x) for x in zip(self.rows, new, strict=True))
        if self.by_tag:
            self._take(np.lexsort((self.rows[1], -self.rows[2], self.rows[3], self.rows[0])), (0, 3), 1)
        self._take(np.lexsort((self.rows[3 if self.by_tag else 1], -self.rows[2], self.rows[0])), (0,), self.k)

    def add_all(self, query: np.ndarray, id_: np.ndarray, similarity: np.ndarray, places: int | None = None) -> None:
        """A matrix of similarities, a row for each query and a column for each id, without tags; places: those that are rounded to."""
        q, c = k_of_rows(similarity, self.least(query), self.k, np.argsort(id_, kind="stable"), places)
        if len(q):
            found = similarity[q, c]
            self.add(query[q], id_[c], found if places is None else np.round(found, places) + 0.0, np.zeros(len(q), "U1"))

    def least(self, query: np.ndarray) -> np.ndarray:
        """The k-th best similarity of each query so far, without end if it has fewer."""
        if self.rows is None:
            return np.full(len(query), -np.inf)
        keys, first, n = np.unique(self.rows[0], return_index=True, return_counts=True)
        last = np.where(n >= self.k, self.rows[2][first + n - 1], -np.inf)
        at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
        return np.where(keys[at] == query, last[at], -np.inf)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(self.rows, (pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["query_id", "id", "similarity", "tag"])

    def _take(self, order: np.ndarray, keys: tuple[int, ...], n: int) -> None:
        """The first n rows of each key in the order."""
        rows = tuple(x[order] for x in self.rows)
        new = np.ones(len(order), bool)
        new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in keys], axis=0)
        at = np.arange(len(order))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        self.rows = tuple(x[place < n] for x in rows)


class Bests:
    """The k best of each query by its place among the keys, held apart for every QUERY_ROWS queries, so that a block sorts only what its queries hold."""

    def __init__(self, keys: np.ndarray, k: int):
        self.keys, self.k = keys, k
        self.held: dict[int, Best] = {}

    def add(self, asked: np.ndarray, id_: np.ndarray, similarity: Callable[[np.ndarray], np.ndarray], places: int | None = None) -> None:
        """asked: ascending places of queries. similarity: a row for each of some of them, a column for each id."""
        for q in query_parts(asked):
            self.held.setdefault(int(q[0]) // QUERY_ROWS, Best(self.k, False)).add_all(self.keys[q], id_, similarity(q), places)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for best in self.held.values():
            yield from best.batches()


def query_parts(asked: np.ndarray) -> list[np.ndarray]:
    """Ascending places of queries, those of the same QUERY_ROWS together."""
    return [q for q in np.split(asked, np.flatnonzero(np.diff(asked // QUERY_ROWS)) + 1) if len(q)]


def nearest(sent: Broadcast, k: int, by_tag: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k best of each query of the block, from batches of id, embedding and tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix = sent.value
        found = [Best(k, by_tag) for _ in range(0, len(keys), QUERY_ROWS)]
        for b in vector_blocks(batches):
            ids, tags = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(str)
            v = unit_rows(b.column(1).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1))
            if by_tag:
                order = np.lexsort((ids, tags))
                ids, tags, v = ids[order], tags[order], v[order]
                edge = np.append(np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1]])), len(ids))
            for n, best in enumerate(found):
                part = slice(n * QUERY_ROWS, (n + 1) * QUERY_ROWS)
                if not by_tag:
                    best.add_all(keys[part], ids, matrix[part] @ v.T, 6)
                    continue
                s = matrix[part] @ v.T
                np.round(s, 6, out=s)
                s += 0.0
                tops = np.maximum.reduceat(s, edge[:-1], axis=1)
                q, g = k_of_rows(tops, best.least(keys[part]), k, np.arange(len(edge) - 1))
                if len(q):
                    c = _firsts(s, q, tops[q, g], edge[g], edge[g + 1] - edge[g])
                    best.add(keys[part][q], ids[c], s[q, c], tags[c])
        for best in found:
            yield from best.batches()

    return run


def k_of_rows(s: np.ndarray, least: np.ndarray, k: int, order: np.ndarray, places: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the values that reach their row's least, the k largest of a row at most, and of equal ones those that come first in the
    order of columns: what equal vectors add is bounded too. places: values are equal if they are when rounded to so many."""
    slack, step = 0 if places is None else 10.0**-places, max(1, SELECTED // max(1, s.shape[1]))
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(s), step):
        part = s[at : at + step]
        keep = part >= least[at : at + step, None] - slack
        q, c = np.nonzero(keep)
        many = np.flatnonzero(np.bincount(q, minlength=len(part)) > k)
        if len(many):
            own = np.where(keep[many], part[many], -np.inf)[:, order]
            own = own if places is None else np.round(own, places)
            cut = np.partition(own, -k, axis=1)[:, -k, None]
            above, equal = own > cut, own == cut
            equal &= np.cumsum(equal, axis=1, dtype=np.int32) <= k - np.count_nonzero(above, axis=1)[:, None]
            keep[many[:, None], order] = above | equal
            q, c = np.nonzero(keep)
        rows.append(q + at)
        columns.append(c)
    return np.concatenate(rows), np.concatenate(columns)


def _firsts(s: np.ndarray, row: np.ndarray, value: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first column of each row's range that has the value."""
    out, step = np.zeros(len(row), np.int64), max(1, SELECTED // int(size.max()))
    for at in range(0, len(row), step):
        n = size[at : at + step]
        pair = np.repeat(np.arange(at, at + len(n)), n)
        c = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + start[pair]
        hit = s[row[pair], c] == value[pair]
        _, first = np.unique(pair[hit], return_index=True)
        out[at : at + step] = c[hit][first]
    return out


def over_fetch(limit: int) -> int:
    return max(limit * 4, 20)


def rerank(hits: DataFrame, query: str, limit: int, path: str = "file_path", prior: Prior = Prior(), score: str = "similarity", tie: str | None = None) -> DataFrame:
    """Adds the path prior; similarity becomes the sum and rank_components keeps both parts."""
    scored_ = hits.withColumn("_p", prior.score(path, F.lit(query)))
    out = scored_.withColumn("rank_components", F.struct(F.round(score, 4).alias("cosine"), F.col("_p").alias("prior"))).withColumn(score, F.round(F.col(score) + F.col("_p"), 6)).drop("_p")
    return out.orderBy(F.desc(score), tie or path).limit(limit)


def search(chunks: DataFrame, query: str, query_vector: list[float], limit: int = 10, language: str | None = None, prefix: str | None = None, post_filter: bool = True, path: str = "file_path", tie: str = "id", prior: Prior = Prior()) -> DataFrame:
    """Over-fetch, filter, rerank, limit. post_filter filters after the over-fetch, as may give fewer than limit hits."""

    def keep(df: DataFrame) -> DataFrame:
        df = df if language is None else df.filter(F.col("language") == language)
        return df if prefix is None else df.filter(F.col(path).startswith(prefix))

    near = distinct_top_k(scored(chunks if post_filter else keep(chunks), query_vector).drop("embedding"), over_fetch(limit), path, tie)
    return rerank(keep(near) if post_filter else near, query, limit, path, prior)


def merged_search(code: DataFrame, docs: DataFrame, limit: int, path: str = "file_path", test_bonus: bool = False) -> DataFrame:
    """Code and document hits, each path once (the code hit wins), in order of their score; tests get 0.2 where tests are sought."""
    both = code.withColumn("_s", F.lit(0)).unionByName(docs.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(path).orderBy("_s", F.desc("similarity"))
    once = both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    if test_bonus:
        is_test = F.col(path).contains("/tests/") | F.col(path).startswith("tests/")
        once = once.withColumn("similarity", F.round(F.col("similarity") + F.when(is_test, 0.20).otherwise(0.0), 6))
    return once.orderBy(F.desc("similarity"), "_s", path).limit(max(limit, 10)).drop("_s")


def find_tests(hits: DataFrame, subject: str, path: str = "file_path") -> DataFrame:
    """Hits on test files or files named like the subject; all hits if there are none."""
    name = subject.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    tests = hits.withColumn("_t", F.lower(path).contains("test") | F.lower(path).contains(name))
    any_ = F.max(F.col("_t").cast("int")).over(Window.partitionBy())  # hits are at most a search's limit
    return tests.withColumn("_a", any_).filter((F.col("_a") == 0) | F.col("_t")).drop("_t", "_a")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Replace by id: the row with the largest order wins, rows of new over rows of old."""
    order_col = F.col(order) if order else F.lit(0)
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "_v")]
    return both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_v", order_col)).alias("_r")).select(key, "_r.*")


def stable_ids(rows: DataFrame, key: str, seen: str, name: str = "internal_id") -> DataFrame:
    """Numbers keys by first appearance, without one sorting task: ranks within range partitions plus the counts before. The ranked keys are written first, as both sides of the join must see the same partitions."""
    first = settled(rows.groupBy(key).agg(F.min(seen).alias("_f")).repartitionByRange("_f", key).sortWithinPartitions("_f", key).withColumn("_m", F.monotonically_increasing_id()).drop("_f"))
    part = first.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each partition
    return part.join(F.broadcast(before), "_p").select(key, (F.col("_i") + F.col("_b")).alias(name))


def snapshot(code: DataFrame, docs: DataFrame, schema: str, id_col: str = "id") -> DataFrame:
    """`schema:code=n:max:doc=n:max` of two stores, one aggregate over each."""
    one = lambda df, k: df.agg(F.count("*").alias(f"{k}_n"), F.coalesce(F.max(id_col), F.lit(0)).alias(f"{k}_max"))
    return one(code, "c").crossJoin(one(docs, "d")).select(F.format_string("%s:code=%d:%d:doc=%d:%d", F.lit(schema), "c_n", "c_max", "d_n", "d_max").alias("snapshot_id"))  # one row each


def memory_snapshot(vectors: DataFrame, dim: int, bits: int | None = None) -> DataFrame:
    tail = "" if bits is None else f":bits={bits}"
    return vectors.agg(F.format_string(f"n=%d:dim={dim}{tail}", F.count("*")).alias("snapshot_id"))


Search = Callable[[str, int], DataFrame]
