"""N-gram Jaccard join with several global token orders, and the components that its links make.

A document is its set of five-word shingles. Equal sets are one class, so links are only sought between different sets.

1. Tasks turn documents into sets and send each token, once for each different set of theirs, to a bucket of its hash. The bucket
   counts in how many sets a token stands and sends back those that stand in two or more. A token of one set is no link, so
   all later steps work on the shared tokens alone, and sets of which under 80 % is shared drop out here. A token of very many
   sets of a segment is sent as one entry with their number, so no bucket gathers a row for each set that holds it.
2. The first order is by frequency, then hash; prefixes under it meet in an inverted index. Of the sets that share a token, the
   one with the fewest rarer tokens is the centre; each set is paired with the centre that it shares most prefix tokens with.
   A pair must pass the size and position bounds, then share a prefix token under two more orders too, and is then verified.
3. Links make components. Whatever shares a prefix token but lies in different components is paired and verified in the
   same way, so no link between components is missed, and pairs inside a component are never listed. Sets that meet in a token of
   many are dealt by their prefix tokens under the second order before they are paired.

Results for edge cases: a null or empty text has an empty set and is linked with nothing. A document of fewer than `size`
words is one shingle. Texts of any length are read whole: a longer one makes a larger set. A null id is linked like any other; its component_id is the smallest id that is not null there, else
null. Repeated rows give repeated result rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Rows, Scratch, hash_words, id_and_text, map_arrow, mix, rows_of, window_hashes
from corvane.llm.components import components
from corvane.llm.packed import Buckets, first_segment, next_segment, planes, unplanes

#: A token of so many sets of a segment is sent as one entry with their number; which sets they are stays with the segment.
HEAVY = 256
MARK = 0xFFFFFFFF
#: Tokens that a task gathers before it sends them.
SEGMENT = 1_000_000  # below 2 ** IDX_BITS
#: Bits of a set's number in its segment; a segment holds fewer sets than tokens.
IDX_BITS = 22
#: Sets of different components that meet in a prefix token under the first order; where more do, they are dealt by their prefix tokens under the second, as no task should pair the square of a hot group.
HOT = 2_048
_ORDERS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The sorted set of hashed shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hash_words(words), min(size, len(words))))


_SENT = pa.schema([("bucket", pa.int32()), ("seg", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("idx", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_SENT_SQL = "bucket int, seg long, kind int, doc_id long, n long, sig binary, idx long, a binary, b binary"
MEMBER, SIZES, TOKENS, OWN = 0, 1, 2, 3


def _send(buckets: Buckets, size: int, least: int, segment: int, heavy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = first_segment(TaskContext.get().partitionId())
        out = Rows(_SENT, 5_000)
        known: dict[bytes, int] = {}
        sizes: list[int] = []
        sets: list[np.ndarray] = []
        where: list[int] = []
        held = told = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if sets:
                token = np.concatenate(sets)
                idx = np.repeat(np.array(where, np.uint32), [len(s) for s in sets])
                order = np.argsort(token, kind="stable")
                token, idx = token[order], idx[order]
                start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                n = np.diff(np.append(start, len(token)))
                if (n >= heavy).any():  # these sets come to the segment's own gathering, past the buckets
                    many = np.repeat(n >= heavy, n)
                    for lo in range(0, int(many.sum()), 500_000):
                        out.add(buckets.any(seg), seg, OWN, None, None, None, None, planes(buckets.short(token[many][lo : lo + 500_000])), planes(idx[many][lo : lo + 500_000]))
                    first = np.zeros(len(token), bool)
                    first[start] = True
                    keep = ~many | first
                    weight = np.where(many, np.repeat(n, n), 1).astype(np.uint32)[keep]
                    token, idx = token[keep], np.where(many, MARK, idx)[keep].astype(np.uint32)
                else:
                    weight = np.ones(len(token), np.uint32)
                which, edges = buckets.edges(token)
                token = buckets.short(token)
                for k, lo, hi in zip(which.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out.add(k, seg, TOKENS, None, None, None, None, planes(np.diff(token[lo:hi], prepend=buckets.base(k))), planes(idx[lo:hi]) + planes(weight[lo:hi]))
                    if len(out) >= 500:
                        yield out.take()
                out.add(buckets.any(seg), seg, SIZES, None, None, None, None, np.array(sizes, np.uint32).tobytes(), None)
            yield out.take()

        for batch in batches:
            for i, text, *texthash in rows_of(batch):
                s = shingles(text, size)
                told += 1
                if not len(s):
                    out.add(buckets.any(seg + told), seg, MEMBER, i, 0, None, None, *(texthash or [None]), None)
                    continue
                sig = xxhash.xxh3_128_digest(s.tobytes())
                if sig not in known:
                    known[sig] = len(sizes)
                    sizes.append(len(s))
                    held += len(s)
                    if len(s) >= least:
                        sets.append(s)
                        where.append(known[sig])
                out.add(buckets.any(seg + told), seg, MEMBER, i, len(s), sig, known[sig], *(texthash or [None]), None)
                if held >= segment:
                    yield from flush()
                    seg, held = next_segment(seg), 0
                    known, sizes, sets, where = {}, [], [], []
            if out.full:
                yield out.take()
        yield from flush()

    return run


def _count(buckets: Buckets):
    """For each bucket: the tokens of two sets or more, with their number of sets, back to each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_SENT, 5_000)
        now, parts = None, []

        def close() -> None:
            token = np.concatenate([p[1] for p in parts])
            idx = np.concatenate([p[2] for p in parts])
            weight = np.concatenate([p[3] for p in parts])
            seg = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p[1]) for p in parts])
            order = np.argsort(token, kind="stable")
            token, idx, seg = token[order], idx[order], seg[order]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            df = np.repeat(np.add.reduceat(weight[order].astype(np.int64), start), np.diff(np.append(start, len(token))))
            shared = df > 1
            token, idx, seg, df = token[shared], idx[shared], seg[shared], np.minimum(df[shared], 0xFFFFFFFF).astype(np.uint32)  # only an order depends on it
            order = np.argsort(seg, kind="stable")
            edges = np.searchsorted(seg[order], np.arange(len(parts) + 1))
            for k, p in enumerate(parts):
                own = order[edges[k] : edges[k + 1]]
                if len(own):
                    out.add(now, p[0], TOKENS, None, None, None, None, planes(token[own]), planes(idx[own]) + planes(df[own]))

        for batch in batches:
            for row in rows_of(batch):
                if row[2] != TOKENS:
                    out.add(*row)
                else:
                    if row[0] != now and parts:
                        close()
                        parts = []
                    now = row[0]
                    half = len(row[8]) // 2
                    parts.append((row[1], np.cumsum(unplanes(row[7], "<u8"), dtype=np.uint64), unplanes(row[8][:half], "<u4"), unplanes(row[8][half:], "<u4")))
            if out.full or sum(map(len, filter(None, out.columns[7]))) > 30_000_000:
                yield out.take()
        if parts:
            close()
        yield out.take()

    return run


_SET = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("shared", pa.binary())])


def _gather(buckets: Buckets, percent: int):
    """For each segment: the sets that stand for their class and may have a link, with their shared tokens by frequency, then hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(_SET, 2_000)
        now, parts, homes, sizes, many = None, [], [], None, []

        def close() -> None:
            if not parts or not homes:
                return
            token = np.concatenate([p[0] for p in parts])
            idx = np.concatenate([p[1] for p in parts])
            df = np.concatenate([p[2] for p in parts])
            if many:
                mark = idx == MARK
                order = np.argsort(token[mark])
                known, times = token[mark][order], df[mark][order]
                own, sets = (np.concatenate(x) for x in zip(*many, strict=True))
                at = np.searchsorted(known, own)
                token, idx, df = (np.concatenate([x[~mark], y]) for x, y in ((token, own), (idx, sets), (df, times[at])))
            n = np.frombuffer(sizes, np.uint32).astype(np.int64)
            home = np.zeros(len(n), bool)
            home[homes] = True
            good = home & (100 * np.bincount(idx, minlength=len(n)) >= percent * n)
            keep = good[idx]
            token, idx, df = token[keep], idx[keep], df[keep]
            order = np.lexsort((token, df, idx))
            token, idx = token[order], idx[order]
            edges = np.searchsorted(idx, np.arange(len(n) + 1))
            for k in np.flatnonzero(good).tolist():
                out.add(now << IDX_BITS | k, int(n[k]), token[edges[k] : edges[k + 1]].tobytes())

        for batch in batches:
            for seg, kind, idx, a, b, bucket in rows_of(batch):
                if seg != now:
                    close()
                    now, parts, homes, sizes, many = seg, [], [], None, []
                    if out.full:
                        yield out.take()
                if kind == MEMBER:
                    homes.append(idx)
                elif kind == SIZES:
                    sizes = a
                elif kind == OWN:
                    many.append((unplanes(a, "<u8"), unplanes(b, "<u4")))
                else:
                    token, half = unplanes(a, "<u8") + buckets.base(bucket), len(b) // 2
                    parts.append((token, unplanes(b[:half], "<u4"), unplanes(b[half:], "<u4")))
        close()
        yield out.take()

    return run


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _index(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, c, n, pos = [], [], [], []
            for own, size, shared in rows_of(batch):
                t = np.frombuffer(shared, np.int64)
                alone = size - len(t)  # tokens of no other set are the rarest: they come first and meet nothing
                k = max(0, prefix_length(size, percent) - alone)
                token.append(t[:k])
                pos.append(np.arange(alone, alone + len(t[:k]), dtype=np.int32))
                c += [own] * len(t[:k])
                n += [size] * len(t[:k])
            cols = [np.concatenate(token) if token else np.empty(0, np.int64), np.array(c, np.int64), np.array(n, np.int64), np.concatenate(pos) if pos else np.empty(0, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "c", "n", "pos"])

    return run


def _other_prefix(shared: np.ndarray, n: int, percent: int, seed: np.uint64) -> np.ndarray:
    """Shared tokens of the prefix under another order: tokens of one set first, the rest by a hash of their own."""
    k = prefix_length(n, percent) - (n - len(shared))
    if k <= 0:
        return shared[:0]
    if k >= len(shared):
        return shared
    return shared[np.argpartition(mix(shared ^ seed), k - 1)[:k]]


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for a, b, n, m, x, y in rows_of(batch):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if all(np.intersect1d(_other_prefix(s, n, percent, o), _other_prefix(t, m, percent, o), assume_unique=True).size for o in _ORDERS):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (n + m - both):
                        out.add(a, b)
            if out.full:
                yield out.take()
        yield out.take()

    return run


def _may_link(n, pos, m, at, percent: int):
    """Size and position bounds: what is left from a common token on must make the overlap that the sizes need."""
    size = (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))
    return size & (F.lit(100 + percent) * F.least(n - pos, m - at) >= F.lit(percent) * (n + m))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("c").alias("a"), F.col("n").alias("n"), F.col("shared").alias("x"))
    b = sets.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "n", "m", "x", "y").transform(map_arrow, _verify(percent), "a long, b long")


def _second_prefix(percent: int):
    """token, second, c, n, pos, label for each prefix token under the second order."""
    names = ["token", "second", "c", "n", "pos", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [_other_prefix(np.frombuffer(x, np.uint64), n, percent, _ORDERS[0]) for n, x in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            of = pa.array(np.repeat(np.arange(batch.num_rows), [len(p) for p in part]))
            second = pa.array(np.concatenate([*part, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), second, *(batch.column(k).take(of) for k in range(1, 5))], names=names)

    return run


def _grouped(docs: DataFrame, scratch: Scratch, size: int, percent: int, segment: int, heavy: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of docs (_id, _text and more columns): doc_id, n, sig and more of each, then sig and label of each class of equal sets; and the tables that both read."""
    volume = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = Buckets(volume)
    least = next(n for n in range(1, 200) if 100 * n >= percent * (n + 1))  # smaller sets only link with equal ones: one of n links at best with one of n + 1 that holds it
    sent = docs.transform(map_arrow, _send(buckets, size, least, segment, max(2, heavy)), _SENT_SQL)
    counted = scratch.keep(buckets.deal(sent).transform(map_arrow, _count(buckets), _SENT_SQL), "counted")
    members = counted.filter(F.col("kind") == MEMBER).select("doc_id", "n", "sig", (F.shiftleft("seg", IDX_BITS).bitwiseOR(F.col("idx"))).alias("at"), F.col("a").alias("h"))
    classes = scratch.keep(members.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("at").alias("c")), "classes")
    null = lambda t: F.lit(None).cast(t)
    homes = classes.select(F.shiftright("c", IDX_BITS).alias("seg"), F.lit(MEMBER).alias("kind"), F.col("c").bitwiseAND(F.lit((1 << IDX_BITS) - 1)).alias("idx"), null("binary").alias("a"), null("binary").alias("b"), null("int").alias("bucket"))
    rest = counted.filter(F.col("kind") != MEMBER).select("seg", "kind", "idx", "a", "b", "bucket")
    sets = scratch.keep(rest.union(homes).repartition("seg").sortWithinPartitions("seg").transform(map_arrow, _gather(buckets, percent), "c long, n long, shared binary"), "sets", "none")

    index = scratch.keep(sets.transform(map_arrow, _index(percent), "token long, c long, n long, pos int"), "index")
    centre = index.groupBy("token").agg(F.min(F.struct("pos", "c", "n")).alias("p"), F.count("*").alias("k")).filter("k > 1").select("token", "p")
    met = index.join(centre, "token").filter(F.col("c") != F.col("p.c")).filter(_may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent))
    star = met.groupBy(F.col("c").alias("a"), F.col("p.c").alias("b")).agg(F.count("*").alias("k")).groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))
    links = scratch.keep(_links(star, sets, percent), "links")
    label = components(links, scratch)

    own = index.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    split = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("token", "k")
    mixed = scratch.keep(own.join(split, "token").select("token", "c", "n", "pos", "label", "k"), "mixed")
    few = mixed.filter(F.col("k") <= HOT).select("token", F.lit(0).cast("long").alias("second"), "c", "n", "pos", "label")
    many = mixed.filter(F.col("k") > HOT).join(sets.select("c", "shared"), "c").select("token", "c", "n", "pos", "label", "shared").transform(map_arrow, _second_prefix(percent), "token long, second long, c long, n long, pos int, label long")
    met = scratch.keep(few.unionAll(many), "met")
    other = met.select("token", "second", *(F.col(x).alias(f"{x}_") for x in ("c", "n", "pos", "label")))
    cross = met.join(other, (met["token"] == other["token"]) & (met["second"] == other["second"]) & (F.col("c") < F.col("c_")) & (F.col("label") != F.col("label_")) & _may_link(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_"), percent))
    more = scratch.keep(_links(cross.select(F.col("c").alias("a"), F.col("c_").alias("b")).distinct(), sets, percent), "links")
    scratch.drop(index, mixed, met, sets)
    label = components(links.union(more), scratch)
    scratch.drop(links, more)
    named = classes.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c")).select("sig", "least", "label")
    return members, named, [counted, classes, label]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, segment: int = SEGMENT, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, named, spent = _grouped(id_and_text(docs, id_col, text_col), scratch, size, percent, segment, heavy)
    group = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(group, "label").select("sig", "component_id")
    linked = members.filter("sig is not null").join(by_class, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.filter("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = scratch.keep(linked.union(alone), "found")
    scratch.drop(*spent)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, by_row: bool = False) -> DataFrame:
    """docs without near copies, with all their columns; texts of any length are read whole, an empty table gives an empty one.

    One document of each component stays, that with the smallest id, and every document without words. Where by_row is not set, rows of
    one id are one document, so all of them stay or go, and every row without an id stays. With by_row a document is a row: rows without
    an id are compared too, and stay only where no row of their component has one; of rows that share id and component one stays, that with
    the smallest MD5 of its text, and of rows that share id and text any one.
    """
    # Merged at every size, so that small runs show the shuffle of the texts that large ones need.
    if not by_row:
        kept = jaccard_components(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, size, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("__corvane_kept")).distinct()
        none = docs.filter(F.col(id_col).isNull())
        return docs.join(kept.hint("merge"), F.col(id_col).cast("long") == F.col("__corvane_kept"), "left_semi").unionAll(none)
    scratch = Scratch(docs.sparkSession, "copies")
    texthash = F.unhex(F.md5(F.col(text_col).cast("binary")))
    members, named, spent = _grouped(id_and_text(docs, id_col, text_col).withColumn("_h", F.unhex(F.md5("_text"))), scratch, size, percent, SEGMENT, HEAVY)
    place = members.filter("sig is not null").join(named, "sig").groupBy("label", "doc_id", "h").agg(F.count("*").alias("times"))
    best = place.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "times")).alias("b"))
    kept = scratch.keep(best.select(F.col("b.doc_id").alias("__corvane_i"), F.col("b.h").alias("__corvane_h"), F.col("b.times").alias("__corvane_times")).unionAll(members.filter("sig is null").select("doc_id", "h", F.lit(1)).distinct()), "kept")
    scratch.drop(*spent)
    names = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.withColumn("__corvane_kh", texthash).join(kept.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__corvane_i")) & F.col("__corvane_kh").eqNullSafe(F.col("__corvane_h")))
    once = joined.filter("__corvane_times = 1").select(names)
    if kept.filter("__corvane_times > 1").limit(1).count() == 0:
        return once
    return once.unionAll(joined.filter("__corvane_times > 1").dropDuplicates(["__corvane_i", "__corvane_h"]).select(names))


#: All pairs that share a shingle, and the closure of their links; only for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
