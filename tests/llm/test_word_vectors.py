"""Random indexing against plain sums, the network's calibration, and scores that beat the share of the larger class."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import quality_classifier as q
from corvane.llm.common import id_and_text

from .test_llm import clashing, docs, texts

SF = "/root/testdata/sf0.01"


def word(t):
    return b"<caps>" if len(t) > 1 and t.isalpha() and t.isupper() else b"<number>" if t.isdigit() else t.lower()


def test_vectors_are_sums_of_contexts(spark, monkeypatch):
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, f"{t.translate(letters)} ABC 12 x9! Été") for i, t in texts(40, 6, 60, 50)] + [(900, None), (901, ""), (902, "one"), (903, "w1 " * 5_000)]
    monkeypatch.setattr(q, "COUNTED", 7)
    frame = id_and_text(docs(spark, rows).repartition(3), "doc_id", "text")
    words = q.vocabulary(frame)
    count = Counter(word(t) for _, x in rows for t in q.tokens((x or "").encode()))
    assert len(words.own) == min(q.OWN, len(count)) and words.row(b"Wbc") == words.row(b"wbc") < q.OWN
    ordered = sorted(words.own.values(), key=lambda r: r)
    by_row = {words.own[q.token_hash(w)]: n for w, n in count.items()}
    assert [by_row[r] for r in ordered] == sorted(by_row.values(), reverse=True)
    plus, minus = q.index_vectors()
    want = defaultdict(lambda: np.zeros(q.DIM, np.int64))
    for _, x in rows:
        r = [words.row(t) for t in q.tokens((x or "").encode())]
        for i, a in enumerate(r):
            for j in range(max(0, i - q.WINDOW), min(len(r), i + q.WINDOW + 1)):
                if i != j:
                    want[a][plus[r[j]]] += 1
                    want[a][minus[r[j]]] -= 1
    got = q.context_sums(frame, words)
    assert np.flatnonzero(np.abs(got).sum(1)).tolist() == sorted(a for a, v in want.items() if v.any())
    assert all((got[a] == v).all() for a, v in want.items())
    empty = q.context_sums(frame.limit(0), q.vocabulary(frame.limit(0)))
    assert not empty.any()


def test_rare_words_share_rows():
    words = q.Vocabulary([q.token_hash(b"often")])
    assert words.row(b"Often") == 0 and q.OWN <= words.row(b"rare") < q.ROWS and words.rows(b"often rare often").tolist() == [0, words.row(b"rare"), 0]


def test_balanced_accuracy_on_held_out_labels(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.quality_scores(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    right = {y: (got[got.quality == y].predicted == y).mean() for y in (0, 1)}
    assert min(right.values()) > 0.8  # each class alone, as most labels are 1
    assert abs(got.score.mean() - got.quality.mean()) < 0.1  # calibrated
    again = q.quality_scores(clashing(d), labels.withColumn("toxic", F.lit(None))).filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2)
    assert {r.doc_id: r.score for r in again.collect()}.items() >= dict(zip(got.doc_id, got.score, strict=True)).items()


def test_held_out_labels_are_not_learnt(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in q.quality_scores(d, labels).collect()} == {r.doc_id: r.score for r in q.quality_scores(d, turned).collect()}
