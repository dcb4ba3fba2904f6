"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

The `OWN` most frequent words of the corpus, counted over all texts, have vectors of their own; all rarer ones share `SHARED` hash rows,
so the table has a fixed size. Tokens are words in lower case, runs of capitals, digits and punctuation. A vector is the sum of
the sparse random index vectors of the tokens within two places of its token, over the whole corpus. A document is pooled to the mean and
the spread of its tokens' vectors, the mean over its different tokens, its length and its share of different tokens. The network is trained
on the driver from at most `sample` labelled documents (those with the smallest hashes of their ids), and its temperature is fitted on a
fifth of them, left out of the training, so that scores are probabilities.

Labels are only learnt from documents whose id's CRC does not leave `rest`; labels, ids, languages and sources are no inputs.

Results for edge cases: a null or empty text is pooled to zeros and scored like any other, a text of any length is pooled whole. A null
id is not held out and has no label. Ids with several labels use the larger one; null labels are not used. With no labels, or one class
alone, the score is the share of ones, or 0.5. Repeated rows give repeated result rows. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, id_and_text, map_arrow, mix, rows_of
from corvane.llm.packed import pack, unpack

OWN, SHARED = 49_152, 16_384
ROWS, DIM, WINDOW = OWN + SHARED, 32, 2
SLICES, SALTS = 64, 16
#: Tokens whose rows a Python worker remembers, and different tokens that it counts before it hands them on.
TOKEN_CACHE = 500_000
COUNTED = 200_000
FEATURES = 3 * DIM + 2
_TOKEN = re.compile(rb"[A-Z]{2,}|[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def tokens(text: bytes | None) -> list[bytes]:
    return _TOKEN.findall(text) if text else []


def token_hash(token: bytes) -> int:
    """The hash of a token's word."""
    if len(token) > 1 and token.isalpha() and token.isupper():
        token = b"<caps>"
    elif token.isdigit():
        token = b"<number>"
    return xxhash.xxh3_64_intdigest(token.lower())


class Vocabulary:
    """The rows of tokens: their own for the words with these hashes, a shared one for all others."""

    def __init__(self, often: list[int]):
        self.own = {h: row for row, h in enumerate(often)}
        self.known: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {"own": self.own, "known": {}}

    def row(self, token: bytes) -> int:
        h = token_hash(token)
        return self.own.get(h, OWN + h % SHARED)

    def rows(self, text: bytes | None) -> np.ndarray:
        found, known = tokens(text), self.known
        try:
            return np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        except KeyError:
            if len(known) > TOKEN_CACHE:
                known.clear()
            for t in set(found):
                if t not in known:
                    known[t] = self.row(t)
            return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words with their numbers in a task."""
    seen: Counter[bytes] = Counter()

    def take() -> pa.RecordBatch:
        hashes, n = np.array([token_hash(t) for t in seen], np.uint64), np.fromiter(seen.values(), np.int64, len(seen))
        kinds, of = np.unique(hashes, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(of, n, len(kinds)).astype(np.int64))], names=["h", "n"])

    for batch in batches:
        for (text,) in rows_of(batch):
            seen.update(tokens(text))
            if len(seen) > COUNTED:
                yield take()
                seen.clear()
    yield take()


def vocabulary(texts: DataFrame) -> Vocabulary:
    """The OWN most frequent words; no more come to the driver."""
    each = texts.select("_text").transform(map_arrow, _count, "h long, n long")
    often = each.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(OWN)
    return Vocabulary([r["h"] & 0xFFFFFFFFFFFFFFFF for r in often.collect()])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row, the place of its +1 and that of its -1."""
    h = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    plus = h % np.uint64(DIM)
    minus = (plus + np.uint64(1) + (h >> np.uint64(32)) % np.uint64(DIM - 1)) % np.uint64(DIM)
    return plus.astype(np.int64), minus.astype(np.int64)


def _contexts(sent):
    """The sums of a task's contexts, in slices of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        plus, minus = index_vectors()
        total = np.zeros(ROWS * DIM, np.int64)

        def add(rows: np.ndarray, of: np.ndarray) -> None:
            base = rows * DIM
            total[:] += np.bincount(base + plus[of], minlength=ROWS * DIM)
            total[:] -= np.bincount(base + minus[of], minlength=ROWS * DIM)

        part, held = [], 0
        gap = np.full(WINDOW, -1, np.int64)

        def close() -> None:
            flat = np.concatenate(part)
            for o in range(1, WINDOW + 1):
                a, b = flat[:-o], flat[o:]
                good = (a >= 0) & (b >= 0)
                a, b = a[good], b[good]
                add(np.concatenate([a, b]), np.concatenate([b, a]))

        for batch in batches:
            for (text,) in rows_of(batch):
                part += [words.rows(text), gap]
                held += len(part[-2])
                if held >= 1_000_000:
                    close()
                    part, held = [], 0
        if part:
            close()
        salt = TaskContext.get().partitionId() % SALTS
        yield _slices({(k, salt): x for k, x in enumerate(total.reshape(SLICES, -1))})

    return run


def _slices(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = sorted(total)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array([pack(total[k]) for k in keys], pa.binary())], names=["slice", "salt", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, salt, sums in rows_of(batch):
            (x,) = unpack(sums, "<i8")
            total[k, salt] = total[k, salt] + x if (k, salt) in total else x
    yield _slices(total)


def context_sums(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """For each row the sum of its contexts' index vectors; at most ROWS x DIM numbers come to the driver."""
    kind = "slice int, salt int, sums binary"
    sent = texts.sparkSession.sparkContext.broadcast(words)
    once = texts.select("_text").transform(map_arrow, _contexts(sent), kind).repartition("slice", "salt").transform(map_arrow, _add, kind)
    twice = once.withColumn("salt", F.lit(0)).repartition("slice").transform(map_arrow, _add, kind)
    table = np.zeros((SLICES, ROWS * DIM // SLICES), np.int64)
    for row in twice.toLocalIterator():
        table[row["slice"]] += unpack(row["sums"], "<i8")[0]
    return table.reshape(ROWS, DIM)


def word_vectors(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """Unit vectors of the rows."""
    table = context_sums(texts, words).astype(np.float64)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(size > 0, size, 1)).astype(np.float32)


def pool(text: bytes | None, words: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    rows = words.rows(text)
    out = np.zeros(FEATURES, np.float32)
    if len(rows):
        kinds, n = np.unique(rows, return_counts=True)
        v = vectors[kinds]
        share = (n / len(rows)).astype(np.float32)
        mean = share @ v
        out[:DIM], out[DIM : 2 * DIM], out[2 * DIM : 3 * DIM] = mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0)), v.mean(0)
        out[-2], out[-1] = np.log1p(len(rows)) / 5, len(kinds) / len(rows)
    return out


class Network:
    """tanh layer and logistic output, inputs brought to one scale; probabilities are calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        apart = max(1, len(y) // 5)
        test, train = order[:apart], order[apart:]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.w, self.b = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden)
        self.v, self.c = rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0
        self.temperature = 1.0
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.b, self.v, np.zeros(1))]
        step = 0
        for _ in range(epochs):
            rng.shuffle(train)
            for at in range(0, len(train), 256):
                k = train[at : at + 256]
                h = np.tanh(z[k] @ self.w + self.b)
                d = (1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30))) - y[k]) / len(k)
                dh = np.outer(d, self.v) * (1 - h * h)
                step += 1
                moved = []
                for g, (m, s) in zip((z[k].T @ dh + 1e-4 * self.w, dh.sum(0), h.T @ d, np.array([d.sum()])), moments, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    moved.append(0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
                self.w -= moved[0]
                self.b -= moved[1]
                self.v -= moved[2]
                self.c -= float(moved[3][0])
        logit = self.logit(x[test])
        loss = lambda t: np.logaddexp(0, -np.where(y[test] > 0, 1, -1) * logit / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 101), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w + self.b) @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", mod: int = 4, rest: int = 2, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    texts = id_and_text(docs, id_col, text_col)
    words = vocabulary(texts)
    sent = spark.sparkContext.broadcast((words, word_vectors(texts, words)))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pool(t, *sent.value).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "x"])

    every = scratch.keep(texts.transform(map_arrow, pooled, "doc_id long, x binary"), "pooled")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))
    marked = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = every.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()  # `sample` rows at most
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, FEATURES)
    net = spark.sparkContext.broadcast(Network(x, np.array([r["y"] for r in rows], np.float64)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.value.score(x), pa.float64())], names=["doc_id", "score"])

    out = every.transform(map_arrow, scored, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
