"""Ranked search against a plain version that scores every document for every item."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from fiscora.llm import ranking
from fiscora.llm.slabs import Slab
from tests.llm.conftest import ODD

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=20):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * total) // length
            score = sum(floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if bag[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **limits):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranking.rank(docs, items, **limits).select(
        "item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé9", k=rng.randint(1, 24))) for _ in range(120)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(90)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "a")]
    # The same bag in another order and case, and one of another length.
    docs += [(2000 + i, " ".join(reversed(docs[7][1].upper().split(" ")))) for i in range(5)]
    docs += [(3000, docs[7][1] + " zzz" * 50), (3001, None), (3002, ""), (3003, "..!")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    return docs, items + [(3, "a b c"), (None, docs[7][1]), (40, None), (41, ""), (42, "unseen"), (43, docs[7][1])]


@pytest.mark.parametrize("cells, block", [(1 << 20, 1_000_000), (64, 40)])
def test_against_plain_version(spark, monkeypatch, cells, block):
    monkeypatch.setattr(ranking, "CELLS", cells)
    docs, items = corpus()
    assert found(spark, docs, items, block_terms=block) == plain(docs, items)
    assert found(spark, docs, items[:4], top=3) == plain(docs, items[:4], 3)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    docs = [(d, t) for d, t, *_ in ODD]
    items = [(1, "the FOX ñandú 日本語"), (2, "nobody y ab")]
    benchmark = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, bag string, rank string")
    got = sorted((tuple(r) for r in ranking.rank(odd, benchmark).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items)
    assert ranking.rank(empty, benchmark).count() == 0
    assert ranking.rank(odd, benchmark.limit(0)).count() == 0


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(Slab, "hashes", lambda self, first, last, lower: np.full(len(first), 77, np.uint64))
    vocabulary = ranking.Vocabulary([b"alphabetsoupofwords"])
    slab = Slab([b"x alphabetsoupofwordy AlphabetSoupOfWords alphabetsoupofword"], np.arange(1))
    at, owner, n = vocabulary.find(slab)
    assert at.tolist() == [0] and n.tolist() == [4]
