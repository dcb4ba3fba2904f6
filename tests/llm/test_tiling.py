"""Decontamination against plain greedy tiling: tiles, their order, coverage, and the whole query."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import decontamination
from corvane.llm.queries import queries

from ..conftest import SMALL


def plain(item, text, least):
    """Greedy string tiling by trying all pairs of places, the longest first, then by place in the item, then in the text."""
    free_i, free_t, tiles = [True] * len(item), [x >= 0 for x in text], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_i[i + n] and free_t[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return tiles
        free_i[i : i + n] = [False] * n
        free_t[j : j + n] = [False] * n
        tiles.append(best)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=22), st.lists(st.integers(-1, 3), max_size=40), st.integers(1, 5))
def test_tiles_equal_plain_tiling(item, text, least):
    least = min(least, len(item))
    assert decontamination.tile(np.array(item), np.array(text, dtype=np.int64), least) == plain(item, text, least)


def test_an_occluded_match_waits_for_its_turn():
    item, text = [int(c) for c in "1010100100011110001111"], [int(c) for c in "101111000000010010100100001010000"]
    assert decontamination.tile(np.array(item), np.array(text), 5) == plain(item, text, 5)


def test_long_matches_equal_plain_tiling():
    r = random.Random(3)
    for _ in range(40):
        item = [r.randrange(3) for _ in range(r.randint(70, 150))]
        text = [r.randrange(3) for _ in range(20)] + item[40:] + [r.randrange(3) for _ in range(9)] + item[: r.randint(5, 60)]
        assert decontamination.tile(np.array(item), np.array(text), 5) == plain(item, text, 5)


def test_the_query_equals_plain_tiling(spark):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want, grams = set(), lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    for k, item in items:
        least = min(5, len(item))
        own = grams(item, least)
        for d, text in docs:
            common = own & grams(text, least)
            if not common:
                continue
            near = sorted({i + o for i in range(len(text) - least + 1) if tuple(text[i : i + least]) in common for o in range(least)})
            part = [x for a, b in zip([None, *near], near) for x in ([text[b]] if a is None or b == a + 1 else [-1, text[b]])]  # words of no common run can be in no tile
            ids = {w: n for n, w in enumerate(dict.fromkeys(item))}
            tiles = plain([ids[w] for w in item], [-1 if w == -1 else ids.get(w, -1) for w in part], least)
            covered = sum(t[2] for t in tiles)
            if covered >= 0.5 * len(item):
                want.add((d, k, len(item), covered, len(tiles), covered / len(item)))
    got = queries()["op1_benchmark_decontamination"](spark, SMALL).select("doc_id", "item_id", "item_words", "covered_words", "n_tiles", "coverage").collect()
    assert want and len(got) == len(want) and set(map(tuple, got)) == want


def test_items_with_one_seed_in_common():
    """3,000 items begin with the same words: a text that holds these words, and one item, tiles that item alone, and gets what tiling all gives."""
    import time

    stock = "answer the following question with care"
    items = [(n, f"{stock} about the matter {n} of {n % 7} in detail {n * 3} once".split()) for n in range(3_000)]
    block = decontamination.Block(items, 5)
    text = f"x {stock} y z {' '.join(items[17][1][6:])} and more".encode()
    began = time.process_time()
    fast = [x for x in block.holds(text, 0.5) if x[2] >= 0.5 * x[1]]
    took = time.process_time() - began
    slow = [x for x in block.holds(text) if x[2] >= 0.5 * x[1]]
    assert fast == slow and [x[0] for x in fast] == [17] and took < 0.2
    assert len(list(block.holds(text))) == 3_000 and len(list(block.holds(text, 0.5))) < 20
