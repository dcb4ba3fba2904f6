"""Token counts by a count-only Viterbi search over a unigram vocabulary.

A word is written with the word mark before it. An Aho-Corasick automaton lists the vocabulary's pieces that end at each
character; the best score of each prefix and the number of pieces on its path are carried forward, nothing else. The tie
rules are those of the Unigram model of the `tokenizers` library: of paths with equal scores the one whose last piece begins
first stays; a character that is no piece costs the lowest score less 10 and becomes its UTF-8 bytes where the vocabulary has
pieces for all bytes, else a run of such characters is one unknown piece.

Results for edge cases: a null or empty text has no words and no tokens. Texts and words of any length are counted whole. A null id stays null. Repeated rows give
repeated result rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import Rows, id_and_text, map_arrow, rows_of

#: Words whose counts a Python worker remembers.
WORD_CACHE = 500_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_counters: dict[str, Counter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with their scores, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best path over the text."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.find.iter(text):
            ends[end + 1].append(match)
        score, pieces, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, at, single = None, -1, False
            for size, s in ends[end] if len(ends[end]) < 2 else sorted(ends[end], reverse=True):
                single |= size == 1
                total = score[end - size] + s
                if best is None or total > best:
                    best, at = total, end - size
            if not single and (best is None or score[end - 1] + self.unknown > best):
                score[end], lost[end] = score[end - 1] + self.unknown, True
                pieces[end] = pieces[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.bytes else not lost[end - 1])
            else:
                score[end], pieces[end] = best, pieces[at] + 1
        return pieces[n]

    def learn(self, words: set[bytes]) -> None:
        if len(self.young) + len(words) > WORD_CACHE // 2:
            self.old, self.young = self.young, {}
        for w in words:
            if w not in self.young:
                n = self.old.get(w)
                self.young[w] = self.count(MARK + w.decode("utf-8", "replace")) if n is None else n

    def total(self, words: list[bytes]) -> int:
        try:
            return sum(map(self.young.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return sum(map(self.young.__getitem__, words))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _counters:
            _counters[vocabulary_path] = Counter(vocabulary(vocabulary_path))
        counter, out = _counters[vocabulary_path], Rows(schema)
        for batch in batches:
            for i, text in rows_of(batch):
                words = text.split() if text else []
                out.add(i, len(words), counter.total(words))
            if out.full:
                yield out.take()
        yield out.take()

    return id_and_text(docs, id_col, text_col).transform(map_arrow, run, "doc_id long, n_words long, n_tokens long")
