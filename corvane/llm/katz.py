"""Katz backoff over word n-grams: Good-Turing discounted counts, exactly normalised backoff weights, evaluated recursively.

    P(w)     = d(c) c / N for a training word, and what the discounts leave over for the one unknown word
    P(w | h) = d(c(h, w)) c(h, w) / c(h) if the n-gram is in the training texts, else a(h) P(w | h'); P(w | h') if h is not
    a(h)     = (1 - sum of P(w | h) over the words seen after h) / (1 - sum of P(w | h') over them)

h' is h without its first word; the start of a text is a context of one symbol. d(r) is Katz's discount for counts of 1 to 5,
with each order's own counts of counts; where these give no discount between 0 and 1, (r - D) / r with D = n1 / (n1 + 2 n2) is
used, and 1 - 1e-6 above 5, so no weight is zero.

Texts are turned into segments of a few million tokens, each with the words and n-grams of its own. A segment sends its words
and n-grams, once each, to buckets of their hashes, with their training counts, one order after another; these partitioned tables
are summed there, and each segment gets the totals of what it sent. One segment owns each n-gram and adds it to the sums of its
context; backoff weights come from these sums, for the contexts that some scored text backs off from.

Results for edge cases: a null or empty text is its end token alone. Texts of any length are scored whole. A null id is held out.
Repeated rows count and score once each. An empty table gives an empty result; without training texts every token is the unknown
word. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, hash_words, id_and_text, map_arrow, mix, rows_of
from corvane.llm.packed import Buckets, first_segment, next_segment, pack, unpack

SEGMENT = 1_000_000
TOP = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
START = np.uint64(xxhash.xxh3_64_intdigest(b" "))
#: Beside a total: whether the segment owns the n-gram, and whether some text asks for its weight.
OWNS, ASKED = np.uint64(1 << 63), np.uint64(1 << 62)
_COUNT = ASKED - np.uint64(1)

_SEGMENT = pa.schema([("seg", pa.int64()), ("ids", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary()), ("train_docs", pa.int64()), ("train_tokens", pa.int64())])
_SEGMENT_SQL = "seg long, ids binary, held binary, sizes binary, words binary, tokens binary, train_docs long, train_tokens long"


def is_held_out(doc_id: int | None, mod: int, rest: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == rest


def _segments(mod: int, rest: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = first_segment(TaskContext.get().partitionId())
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            out = np.array([is_held_out(i, mod, rest) for i in ids], bool)
            tokens, words = pd.factorize(np.concatenate(texts))
            often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            # Frequent words get numbers of one byte, then of two, whose other bytes compress; among their like words are sorted, so that their steps compress.
            order = np.concatenate([part[np.argsort(words[part])] for part in np.split(often, [1 << 8, 1 << 16])])
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words, tokens = words[order], rank[tokens]
            key = pa.array(ids, pa.int64())
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
                    w.write_batch(pa.record_batch([key], names=["id"]))
                packed = sink.getvalue().to_pybytes()
            row = [seg, packed, out.tobytes(), sizes.tobytes(), pack(np.diff(words, prepend=np.uint64(0))), pack(tokens), int((~out).sum()), int(sizes[~out].sum())]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            for i, text in rows_of(batch):
                ids.append(i)
                texts.append(np.append(hash_words(text.lower().split()) if text else np.empty(0, np.uint64), END))
                held += len(texts[-1])
                if held >= segment:
                    yield close()
                    seg, ids, texts, held = next_segment(seg), [], [], 0
        if ids:
            yield close()

    return run


class Grams:
    """The different n-grams of an order: their hashes, the place of one token of each, its context among those of the order before (-1: start), and each token's n-gram (-1: none)."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, context: np.ndarray, of: np.ndarray):
        self.hashes, self.at, self.context, self.of = hashes, at, context, of

    def context_hashes(self, before: Grams, which: np.ndarray) -> np.ndarray:
        return np.where(which < 0, START, before.hashes[which])


class Segment:
    """A segment's texts as arrays: words, and for each token its word, its text and whether that trains."""

    def __init__(self, ids: bytes, held: bytes, sizes: bytes, words: bytes, tokens: bytes):
        self.ids = pa.ipc.open_stream(ids).read_all().column(0)
        self.held, self.sizes = np.frombuffer(held, bool), np.frombuffer(sizes, np.int64)
        self.words, self.token = np.cumsum(unpack(words, "<u8")[0], dtype=np.uint64), unpack(tokens, "<u4")[0].astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.trains = ~self.held[self.doc]

    def before(self, of: np.ndarray) -> np.ndarray:
        """The value of the token before, -1 at the start of a text."""
        out = np.empty_like(of)
        out[1:] = of[:-1]
        out[self.first] = -1
        return out

    def grams(self, order: int) -> list[Grams]:
        """Those of order 1 to `order`."""
        none = np.empty(0, np.int64)
        out = [Grams(self.words, none, none, self.token)]
        for n in range(2, order + 1):
            context = self.before(out[-1].of)
            some = np.arange(len(context)) if n == 2 else np.flatnonzero(context >= 0)
            which, kinds = pd.factorize((context[some] + 1) * len(self.words) + self.token[some])
            at, of = np.empty(len(kinds), np.int64), np.full(len(context), -1, np.int64)
            at[which] = some
            of[some] = which
            with np.errstate(over="ignore"):
                hashes = mix(np.where(context[at] < 0, START, out[-1].hashes[context[at]]) * _STEP + self.words[self.token[at]])
            out.append(Grams(hashes, at, context[at], of))
        return out


_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("seg", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_MESSAGE_SQL = "bucket int, kind int, seg long, a binary, b binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in _MESSAGE]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MESSAGE, strict=True)], schema=_MESSAGE)


def _send(buckets: Buckets, orders: list[int], top: int):
    """The n-grams of these orders with their training counts, and a mark on those that held-out texts ask for as contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, *parts in rows_of(batch):
                s = Segment(*parts)
                for kind, g in enumerate(s.grams(orders[-1]), 1):
                    if kind not in orders:
                        continue
                    count = np.bincount(g.of[s.trains & (g.of >= 0)], minlength=len(g.hashes)).astype(np.uint32)
                    if kind < top:
                        wanted = s.before(g.of)[~s.trains]
                        count[wanted[wanted >= 0]] |= np.uint32(1 << 31)
                    order = np.argsort(g.hashes, kind="stable")
                    which, edges = buckets.edges(g.hashes[order])
                    low, n = buckets.short(g.hashes[order]), count[order]
                    rows = []
                    for k, lo, hi in zip(which.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        rows.append((k, kind, seg, None, pack(np.diff(low[lo:hi], prepend=buckets.base(k)), n[lo:hi])))
                        if len(rows) >= 256:
                            yield _messages(rows)
                            rows = []
                    yield _messages(rows)

    return run


_TOTAL = pa.schema([*_MESSAGE, ("histogram", pa.list_(pa.int64()))])
_TOTAL_SQL = _MESSAGE_SQL + ", histogram array<long>"


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The training counts of a bucket's n-grams; each segment gets those of what it sent, with the marks OWNS and ASKED."""
    now, parts = None, []

    def close() -> Iterator[pa.RecordBatch]:
        bucket, kind = now
        key = np.concatenate([p[1] for p in parts])
        sent = np.concatenate([p[2] for p in parts])
        order = np.argsort(key, kind="stable")  # segments stay in their order
        sorted_, n = key[order], sent[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        times = n & np.uint32(0x7FFFFFFF)
        total = np.add.reduceat(times.astype(np.uint64), start)
        total = np.where(np.bitwise_or.reduceat(n, start) >> np.uint32(31) == 1, total | ASKED, total)
        has = times > 0
        before = np.cumsum(has) - has
        back = np.empty(len(key), np.uint64)
        back[order] = np.where(has & (before == before[start][group]), total[group] | OWNS, total[group])
        histogram = np.bincount(np.minimum(total & _COUNT, np.uint64(TOP + 2)).astype(np.int64), minlength=TOP + 3)[1:].tolist()
        at = 0
        for k, p in enumerate(parts):
            row = [bucket, kind, p[0], None, pack(back[at : at + len(p[1])]), histogram if k == 0 else None]
            at += len(p[1])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _TOTAL, strict=True)], schema=_TOTAL)

    for batch in batches:
        for bucket, kind, seg, _, b in rows_of(batch):
            if (bucket, kind) != now:
                if parts:
                    yield from close()
                now, parts = (bucket, kind), []
            step, count = unpack(b, "<u8", "<u4")
            parts.append((seg, np.cumsum(step, dtype=np.uint64), count))
    if parts:
        yield from close()


def discounts(n: list[int]) -> np.ndarray:
    """d(0) to d(TOP + 1) from the numbers of items that are counted once, twice and so on; the last is for all higher counts."""
    d = np.full(TOP + 2, 1 - 1e-6)
    high = (TOP + 1) * n[TOP] / n[0] if n[0] else 0
    spare = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    for r in range(1, TOP + 1):
        x = ((r + 1) * n[r] / n[r - 1] / r - high) / (1 - high) if n[r - 1] and n[r] and high < 1 else 0
        d[r] = x if 0 < x < 1 else (r - min(spare, 0.999)) / r
    return d


class Model:
    """What the driver knows of the model: totals and discounts."""

    def __init__(self, n: int, docs: int, counts: list[list[int]], left: float):
        self.n, self.docs, self.types = n, docs, sum(counts[0])
        self.d = [discounts(c) for c in counts]
        self.left = left

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        return np.where(c > 0, self.d[0][np.minimum(c, TOP + 1)] * c / max(self.n, 1), self.left)


#: Kinds of messages after scoring: a segment's texts with their backoff events, sums of contexts, and contexts whose weights a segment asks for.
TEXTS, CONTEXT, ASK = 0, 1, 2
_DOC = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_DOC_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of the values of each."""
    which, kinds = pd.factorize(keys)
    order = np.argsort(kinds, kind="stable")
    return kinds[order], *(np.bincount(which, v, len(kinds))[order] for v in values)


def _by_bucket(buckets: Buckets, kind: int, seg: int, hashes: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """Sorted hashes with their values, a message for each bucket."""
    which, edges = buckets.edges(hashes)
    low = buckets.short(hashes)
    return _messages([(k, kind, seg, None, pack(np.diff(low[lo:hi], prepend=buckets.base(k)), *(v[lo:hi] for v in values))) for k, lo, hi in zip(which.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)])


def _score(model: Model, buckets: Buckets):
    def finish(seg: int, parts: list, got: dict[int, dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        s = Segment(*parts)
        n = len(s.sizes)
        asked = chance = c = before = None
        sums: list[tuple[np.ndarray, ...]] = []
        events: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, g in enumerate(s.grams(len(model.d)), 1):
            total = np.empty(len(g.hashes), np.uint64)
            if len(total):
                total[np.argsort(g.hashes, kind="stable")] = np.concatenate([unpack(got[kind][k], "<u8")[0] for k in sorted(got[kind])])
            r = (total & _COUNT).astype(np.int64)
            if kind == 1:
                base = np.log10((r + 0.1) / (model.n + 0.1 * (model.types + 1)))[s.token]
                known, chance = (r > 0)[s.token], model.word(r)
                here = chance[s.token]
            else:
                lower = chance[before.of[g.at]]
                times = np.where(g.context < 0, model.docs, c[g.context])
                seen = r > 0
                chance = np.where(seen, model.d[kind - 1][np.minimum(r, TOP + 1)] * r / np.maximum(times, 1), lower)
                some = g.of >= 0
                here[some] = chance[g.of[some]]
                own = np.flatnonzero((total & OWNS > 0) & seen & np.where(g.context < 0, True, asked[g.context]))
                left = r[own] * (1 - model.d[kind - 1][np.minimum(r[own], TOP + 1)])
                ctx, *parts_ = _grouped(g.context[own], r[own], left, lower[own])
                sums.append((g.context_hashes(before, ctx), *parts_))
                # Backoff events: a known context, but not this n-gram.
                event = np.flatnonzero(some)[(~seen & (times > 0))[g.of[some]]]
                events.append((s.doc[event], g.context_hashes(before, g.context[g.of[event]])))
            asked, c, before = total & ASKED > 0, r, g
        hashes, times, left, lower = (np.concatenate(z) for z in zip(*sums, strict=True))
        order = np.argsort(hashes, kind="stable")
        yield _by_bucket(buckets, CONTEXT, seg, hashes[order], times[order].astype(np.uint64), left[order], lower[order])
        doc, hashes = (np.concatenate(z) for z in zip(*events, strict=True))
        which, kinds = pd.factorize(hashes)
        order = np.argsort(kinds, kind="stable")
        yield _by_bucket(buckets, ASK, seg, kinds[order])
        rank = np.empty(len(kinds), np.int64)
        rank[order] = np.arange(len(kinds))
        pairs, times = _grouped(doc.astype(np.int64) * max(1, len(kinds)) + rank[which], np.ones(len(doc)))
        packed = pack(*(v.astype(np.uint32) for v in (np.diff(pairs // max(1, len(kinds)), prepend=0), pairs % max(1, len(kinds)), times)))
        texts = pa.record_batch([s.ids.combine_chunks(), pa.array(s.held), pa.array(s.sizes), *(pa.array(np.bincount(s.doc, w, n), t) for w, t in ((known, pa.int64()), (base, pa.float64()), (np.log10(here), pa.float64())))], schema=_DOC)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, _DOC) as w:
                w.write_batch(texts)
            yield _messages([(-1, TEXTS, seg, sink.getvalue().to_pybytes(), packed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, got = None, None, {}
        for b in batches:
            for seg, kind, bucket, counts, *own in rows_of(b):
                if seg != now:
                    if now is not None:
                        yield from finish(now, parts, got)
                    now, parts, got = seg, None, {}
                if kind < 0:
                    parts = own
                else:
                    got.setdefault(kind, {})[bucket] = counts
        if now is not None:
            yield from finish(now, parts, got)

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The logarithms of the backoff weights of a bucket's contexts, to each segment that asks, in the order in which it asks."""
    now, sums, asks = None, [], []

    def close() -> pa.RecordBatch:
        if not asks:
            return _messages([])
        keys, times, left, lower = _grouped(*(np.concatenate(z) for z in zip(*sums, strict=True)))
        weight = np.log10(left / times / (1 - lower))
        return _messages([(now, ASK, seg, None, pack(weight[np.searchsorted(keys, key)])) for seg, key in asks])

    for batch in batches:
        for bucket, kind, seg, _, b in rows_of(batch):
            if bucket != now:
                yield close()
                now, sums, asks = bucket, [], []
            step, *own = unpack(b, "<u8", "<u8", "<f8", "<f8") if kind == CONTEXT else unpack(b, "<u8")
            key = np.cumsum(step, dtype=np.uint64)
            if kind == CONTEXT:
                sums.append((key, *own))
            else:
                asks.append((seg, key))
    yield close()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each segment with the weights of their backoff events added."""
    now, texts, weights = None, None, []

    def close() -> pa.RecordBatch:
        table = pa.ipc.open_stream(texts[0]).read_all()
        step, which, times = unpack(texts[1], "<u4", "<u4", "<u4")
        score = table.column("score").to_numpy().copy()
        if len(step):
            score += np.bincount(np.cumsum(step), np.concatenate(weights)[which] * times, len(score))
        return table.set_column(5, _DOC.field(5), pa.array(score)).combine_chunks().to_batches()[0]

    for batch in batches:
        for _, kind, seg, a, b in rows_of(batch):
            if seg != now:
                if texts:
                    yield close()
                now, texts, weights = seg, None, []
            if kind == TEXTS:
                texts = (a, b)
            else:
                weights.append(unpack(b, "<f8")[0])
    if texts:
        yield close()


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, rest: int = 0, order: int = 2, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; texts whose id's CRC leaves `rest` train nothing. order: words of the longest n-grams, 2 or more."""
    scratch = Scratch(docs.sparkSession, "katz")
    texts = id_and_text(docs, id_col, text_col)
    buckets = Buckets(texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)
    segments = scratch.keep(texts.transform(map_arrow, _segments(mod, rest, segment), _SEGMENT_SQL), "segments")
    held = ["ids", "held", "sizes", "words", "tokens"]
    tables = []
    for orders in ([1, 2], *([n] for n in range(3, order + 1))):  # a shuffle each, so that its files are gone before the next
        sent = segments.select("seg", *held).transform(map_arrow, _send(buckets, orders, order), _MESSAGE_SQL)
        tables.append(scratch.keep(buckets.deal(sent, "kind", "seg").transform(map_arrow, _sum, _TOTAL_SQL), "tables"))
    every = reduce(DataFrame.unionAll, tables)

    n_docs, n = segments.agg(F.sum("train_docs"), F.sum("train_tokens")).first()
    n_docs, n = n_docs or 0, n or 0
    hist = [[0] * (TOP + 2) for _ in range(order)]
    for row in every.filter("histogram is not null").select("kind", F.posexplode("histogram").alias("r", "n")).groupBy("kind", "r").agg(F.sum("n").alias("n")).collect():  # TOP + 2 rows for each order
        hist[row["kind"] - 1][row["r"]] = row["n"]
    d = discounts(hist[0])
    low = sum(r * hist[0][r - 1] * (1 - d[r]) for r in range(1, TOP + 1))
    rest_tokens = n - sum(r * hist[0][r - 1] for r in range(1, TOP + 1))
    model = Model(n, n_docs, hist, (low + rest_tokens * (1 - d[TOP + 1])) / n if n else 1.0)

    null = lambda t: F.lit(None).cast(t)
    asks = every.select("seg", "kind", "bucket", F.col("b").alias("counts"), *(null("binary").alias(c) for c in held))
    own = segments.select("seg", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), null("binary").alias("counts"), *held)
    scored = scratch.keep(own.union(asks).repartition("seg").sortWithinPartitions("seg", "kind", "bucket").transform(map_arrow, _score(model, buckets), _MESSAGE_SQL), "scored")
    scratch.drop(segments, *tables)
    weights = scratch.keep(buckets.deal(scored.filter(F.col("kind") != TEXTS), "kind", "seg").transform(map_arrow, _weigh, _MESSAGE_SQL), "weights")
    told = scored.filter(F.col("kind") == TEXTS).union(weights).repartition("seg").sortWithinPartitions("seg", "kind", "bucket")
    found = scratch.keep(told.transform(map_arrow, _finish, _DOC_SQL), "scores")
    scratch.drop(scored, weights)
    return found.withColumn("train_tokens", F.lit(n).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
