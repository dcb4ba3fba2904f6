"""Every stage of the corpus pipeline, and the whole of it, against plain versions on the smallest tables; odd rows and long texts through all stages."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from corvane.llm import quality_rules
from corvane.llm.packing import public_tokenizer
from corvane.llm.queries import PIECES, WORD_BPE, queries

from ..conftest import SMALL
from .test_llm import clashing, docs, plain_components, plain_deleted
from .test_tiling import plain as plain_tiles


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def left_lines(text, gone):
    out, k = [], 0
    for line in text.split("\n"):
        out += [] if line.split() and k in gone else [line]
        k += bool(line.split())
    return "\n".join(out)


def holds(text, items):
    words = re.findall(r"\w+", text.lower())
    for item in items:
        least = min(5, len(item))
        common = {tuple(item[i : i + least]) for i in range(len(item) - least + 1)}
        near = sorted({i + o for i in range(len(words) - least + 1) if tuple(words[i : i + least]) in common for o in range(least)})
        part = [x for a, b in zip([None, *near], near) for x in ([words[b]] if a is None or b == a + 1 else [-1, words[b]])]
        ids = {w: n for n, w in enumerate(dict.fromkeys(item))}
        if near and sum(t[2] for t in plain_tiles([ids[w] for w in item], [-1 if w == -1 else ids.get(w, -1) for w in part], least)) >= 0.5 * len(item):
            return True
    return False


def packed(found, texts):
    """The pieces hold each text's tokens in order, and sequences have no gaps and at most 4096 tokens."""
    from tokenizers import Tokenizer

    model, pieces, places = Tokenizer.from_file(public_tokenizer(WORD_BPE)), defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(n, at, min(4096, len(ids) - at)) for n, at in enumerate(range(0, len(ids), 4096))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in own]
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)


def test_stages_equal_plain(spark):
    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = rows(d)

    after = rows(stages["quality_rules"](spark, d, SMALL))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    told = {r[0]: r for r in c.sql(f"SELECT doc_id, kept, n_words - lost_words FROM ({quality_rules.ORACLE_SQL})").fetchall()}
    assert set(after) == {i for i, r in told.items() if r[1]} and all(len(after[i].encode().split()) == told[i][2] for i in after)
    for i, text in after.items():
        lines = iter(before[i].split("\n"))
        assert all(line in lines for line in text.split("\n")) or not text

    as_frame = lambda texts: docs(spark, list(texts.items()))
    gone = defaultdict(set)
    for i, k in plain_deleted(list(after.items()), 40):
        gone[i].add(k)
    want = {i: left_lines(t, gone[i]) for i, t in after.items()}
    want = {i: t for i, t in want.items() if t.split() or not gone[i]}
    got = rows(stages["line_dedup"](spark, as_frame(after), SMALL))
    assert got == want and len(want) < len(after)

    want = {i: got[i] for i, (_, c_) in plain_components(list(got.items())).items() if i == c_}
    fewer = rows(stages["ngram_jaccard_join"](spark, as_frame(got), SMALL))
    assert fewer == want

    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {i: t for i, t in fewer.items() if not holds(t, items)}
    clean = rows(stages["benchmark_decontamination"](spark, as_frame(fewer), SMALL))
    assert clean == want and len(want) < len(fewer)

    last = packed(stages["best_fit_packing"](spark, as_frame(clean), SMALL).collect(), clean)
    assert packed(corpus_pipeline.run(spark, SMALL).collect(), clean) == last


def test_odd_rows_and_long_texts_through_all_stages(spark):
    long = "\n".join(f"Sentence number {i} says that value {i * i} stands here." for i in range(20_000))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g h i j k l.", "en", "s", 1), (3, "x y", "en", None, 3), (3, "x y", "en", None, 3), (5, "a b c d e f g h i j k l.", "en", "s", 1), (6, long), (7, long), (8, long + "\nOne line more that is its own.")]
    d = clashing(docs(spark, odd))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SMALL)
        assert out.columns == d.columns, name
        assert stage(spark, d.limit(0), SMALL).count() == 0, name
        d = spark.createDataFrame(out.collect(), d.schema)
    assert sorted(r.doc_id for r in d.collect()) in ([5, 6], [5, 6, 8]) and max(len(r.text) for r in d.collect()) == len(long)
    assert corpus_pipeline.STAGES[-1][1](spark, d.limit(0), SMALL).count() == 0
    packed(corpus_pipeline.STAGES[-1][1](spark, d, SMALL).collect(), {r.doc_id: r.text for r in d.collect()})
    raw = clashing(docs(spark, odd[:6]))
    got = Counter(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, raw, SMALL).collect())
    assert got == Counter(r[0] for r in odd[:6])


def test_token_counts_of_whole_texts(spark):
    """The query against the library, word by word, as a word never shares a piece with its neighbour."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    from corvane.llm import token_counts

    vocabulary = token_counts.vocabulary(public_tokenizer(PIECES))
    model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    known = {}

    def count(word):
        if word not in known:
            known[word] = len(model.encode(word, add_special_tokens=False).ids)
        return known[word]

    texts = rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    found = {r.doc_id: r.n_tokens for r in queries()["op8_token_counts"](spark, SMALL).collect()}
    assert found == {i: sum(count(w.decode()) for w in (t or "").encode().split()) for i, t in texts.items()}
