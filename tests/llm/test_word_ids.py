"""Ids of many texts at once: the same as the tokenizer's own, and each word met once a group."""

import random
import struct
from collections import Counter

import pyarrow as pa
import pytest

from corvane.llm import packing
from corvane.llm.queries import WORD_BPE

TOKENIZER = packing.public_tokenizer(WORD_BPE)
WORDS = [
    "the", "THE", "it's", "don't.", "end.", "end...", "a.b", "x,", "!?", "3.", "42nd)", "été", "été,", "ÉTÉ!", "größe;", "ÿ", "×", "÷.", "a÷.", "a×b×,", "œuvre.", "naïvé.", "é,", "ΣΑΣ.", "İ.", "日本。", "日.",
    "<|endoftext|>", "A<|startoftext|>B.", "<|", "A<|.", "ab\xa0cd.", "ab\x85", "ab\x1c.", "\x00.", "🎉!", "_", "a_", "ª.", "µ,", "ß", "ǆ.", "ͅ.", "word" * 40 + ",",
]


def own(model, text):
    ids = model.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("group_bytes", [1, 300, 8 << 20])
@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_texts_of_slices(monkeypatch, group_bytes, kind):
    r = random.Random(5)
    texts = [None, b"", b"  ", b"\n the \t\x0b\x0c\r\n", *("".join(r.choice(WORDS) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.randrange(12))).encode() for _ in range(400)), b"a \xff\xc3. \xe4\xc3\xa4, \xc3", None]
    monkeypatch.setattr(packing, "GROUP_BYTES", group_bytes)
    model = packing.WordTokenizer(TOKENIZER)
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts, kind)], names=["id", "text"])
    want = list(zip(batch.column(0).to_pylist(), [own(model.model, t) for t in texts], strict=True))
    assert list(packing.encoded(batch, model)) == want
    assert list(packing.encoded(batch.slice(7, 300), model)) == want[7:307]
    assert list(packing.encoded(batch.slice(3, 0), model)) == [] and model.ids([]) == []


def test_words_are_met_once(monkeypatch):
    """4 MB of alike texts: a word is looked for once, with and without punctuation behind it."""
    seen = Counter()
    learn = packing.WordTokenizer.learn
    monkeypatch.setattr(packing.WordTokenizer, "learn", lambda self, words: (seen.update(words), learn(self, words))[1])
    text = b"some words, some words. Some words! " * 120
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000), pa.int64()), pa.array([text] * 1_000, pa.binary())], names=["id", "text"])
    got = {ids for _, ids in packing.encoded(batch, packing.WordTokenizer(TOKENIZER))}
    assert got == {own(packing.WordTokenizer(TOKENIZER).model, text)}
    assert seen == Counter([b"some", b"words", b",", b".", b"!", b""])
