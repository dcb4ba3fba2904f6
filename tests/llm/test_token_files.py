"""Token files: Elias-Fano sequences against plain lists, files against the tokenizer's own ids."""

import mmap
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing, token_files
from corvane.llm.queries import WORD_BPE, queries

from ..conftest import SMALL
from .test_llm import ODD, clashing, docs, texts

TOKENIZER = packing.public_tokenizer(WORD_BPE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=700), st.integers(0, 3))
def test_sequence(values, shape):
    values = sorted(v >> 40 * (shape == 1) for v in values)
    if shape == 2:
        values = list(range(len(values) * 3))
    s = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
    assert s.values().tolist() == values and len(s) == len(values)
    assert [s[k] for k in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        s[len(values)]


def test_sequence_is_small():
    r = np.random.default_rng(1)
    for mean in (20, 900, 40_000):
        values = np.cumsum(r.integers(1, 2 * mean, 100_000)).astype(np.uint64)
        data = token_files.EliasFano.encode(values)
        assert 8 * len(data) / len(values) < 2.3 + np.log2(mean)
        s = token_files.EliasFano(data)
        assert (s.values() == values).all() and all(s[k] == values[k] for k in range(0, 100_000, 997))


def test_gaps_between_kept_places():
    values = [0] * 300 + [2**40] * 300 + [2**40 + 1] + [2**60] * 3
    s = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.uint64)))
    assert [s[k] for k in range(len(values))] == values


def plain(rows):
    """doc_id, start, n_tokens, ids_crc32, by the tokenizers library alone."""
    model = Tokenizer.from_file(TOKENIZER)
    hashed = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest((t or "").encode(), seed=42)))[0]
    ids = [(i, hashed(t), [*model.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    packed = lambda x: struct.pack(f"<{len(x)}I", *x)
    out, start = [], 0
    for i, _, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.append((i, start, len(x), zlib.crc32(packed(x))))
        start += len(x)
    return out


def ran(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_query_equals_tokenizer(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert ran(queries()["op12_token_files"](spark, SMALL)) == plain(rows)


@pytest.mark.parametrize("file_ids", [1, 60, 10_000_000])
def test_odd_rows_and_sizes_of_files(spark, file_ids):
    own = [(-5, "minus five"), (2**62, "far away"), (-(2**62), "far below"), *[(77, "the same row")] * 40, *[(None, "no id")] * 5, (4, "word " * 20_000), *((100 + i, t) for i, t in texts(30, 8))]
    rows = [r[:2] for r in ODD] + own
    df = clashing(docs(spark, [*ODD, *own])).repartition(3)
    assert ran(token_files.token_round_trip(df, TOKENIZER, file_ids=file_ids)) == plain(rows)
    assert token_files.token_round_trip(df.limit(0), TOKENIZER).count() == 0


def test_files_by_select(spark, tmp_path):
    """A file is mapped, and documents are read by number and by id without a look at the others."""
    rows = [(3 * i, t) for i, t in texts(500, 3, 60)] + [(None, "nameless")]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs(spark, rows), path, TOKENIZER, file_ids=2_000)
    model, seen = Tokenizer.from_file(TOKENIZER), 0
    paths = list(Path(path).glob("part-*"))
    assert len(paths) > 4
    for p in paths:
        with p.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
            data = m[:]
        file = token_files.TokenFile(data)
        assert file.ids.dtype == np.uint16 and file.n_ids <= 2_000
        for k in range(file.n):
            own = file.document(k)
            text = dict(rows)[file.doc_id(k)]
            assert own.tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]
            assert file.doc_id(k) is None or file.find(file.doc_id(k)) == k
        assert file.find(1) is None
        seen += file.n
        for cut in (data[:-1], data[: len(data) // 2], data[:10]):
            with pytest.raises(ValueError, match="cut off|no token file"):
                token_files.TokenFile(cut)
    assert seen == len(rows)
    got = {r.doc_id: r.ids for r in token_files.read_token_files(spark, path, with_ids=True).collect()}
    assert got == {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
