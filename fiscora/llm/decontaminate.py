"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Seeds are pairs of words that follow each other in a test item, next to each
other or with one word between. Where a text holds enough of an item's seeds,
the passage around them is aligned with the item, so edited and paraphrased
copies are scored by what they share in order.

No copy that reaches the score is lost. Let an item have L words and an
alignment M matches and E errors (words replaced, dropped or inserted), so that
its score 2M - E is at least 2sL. Of its M - 1 steps from match to match at most
E / 2 hold two errors or more, so at least sL - 1 hold one or none, and each of
these is a pair of the item and of the passage. An item's pairs therefore may
miss (L - 1) - (sL - 1) places: whichever more places are seeds, one is hit, and
T more seeds give T more hits. The rarest places are taken, by the counts of
their words in all texts: that choice decides what is compared, not what is found,
and a corpus twice as large leaves it as it is.

The test items are a stated query set. They go through the texts in blocks of a
bounded number of words, each broadcast, so no text is shuffled however often a
passage was copied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import Slab, combine, fields, record, slabs, starts_of
from fiscora.session import hand_over

REACH = 2                   # the words of a seed are at most this far apart
BLOCK_WORDS = 1_000_000     # words of test items that are broadcast at a time, 8 bytes each
SPARE = 4                   # one in so many words of an item adds a seed, and a hit that is asked for
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5             # of the score of a full copy
CELLS = 1 << 21             # alignment cells held at a time
HITS = 1 << 20              # places of seeds, times the items they belong to, held at a time

_EDGE = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}|*#"))


def item_words(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z folded, punctuation around it dropped) and the text it belongs to."""
    first, last, owner = slab.words()
    while True:
        inner = (first < last) & _EDGE[slab.data[first]]
        if not inner.any():
            break
        first = first + inner
    while True:
        inner = (first < last) & _EDGE[slab.data[last - 1]]
        if not inner.any():
            break
        last = last - inner
    kept = first < last
    return slab.hashes(first[kept], last[kept], True), owner[kept]


def _pairs(word: np.ndarray, owner: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every pair of words so far apart in one text, and the place of its first word."""
    size = max(len(word) - apart, 0)
    at = np.flatnonzero(owner[:size] == owner[apart:])
    return combine(np.full(len(at), 2, np.uint64), word[at], word[at + apart]), at


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over words: best local score of each pair, and the passage word it ends before."""
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    width = np.array([len(p) for p in passages], np.int64)
    order = np.argsort(-width, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, CELLS // max(int(width[order[at]]), 1))
        pairs = order[at:at + size]
        at += size
        w = int(width[pairs[0]])
        h = max(len(items[i]) for i in pairs)
        # Padding that equals nothing.
        passage = np.zeros((len(pairs), w), np.uint64)
        item = np.ones((len(pairs), h), np.uint64)
        for k, i in enumerate(pairs):
            passage[k, :len(passages[i])] = passages[i]
            item[k, :len(items[i])] = items[i]
        slope = np.arange(w, dtype=np.int32) * -GAP
        row = np.zeros((len(pairs), w + 1), np.int32)
        top, where = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64)
        for j in range(h):
            step = np.where(passage == item[:, j:j + 1], MATCH, MISMATCH).astype(np.int32)
            new = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
            # A gap in the item: the best earlier cell of the row, less the distance.
            new = np.maximum.accumulate(new + slope, axis=1) - slope
            row[:, 1:] = new
            peak = new.argmax(axis=1)
            value = new[np.arange(len(pairs)), peak]
            better = value > top
            top[better], where[better] = value[better], peak[better] + 1
        best[pairs], end[pairs] = top, where
    return best, end


class Items:
    """A block of test items with its seeds, ready for search."""

    def __init__(self, ids: pa.Array, words: list[np.ndarray], frequency: dict[int, int], least: float = MIN_SCORE):
        self.ids, self.words, self.least = ids, words, least
        self.size = np.array([len(w) for w in words], np.int64)
        # Hits that every alignment of the least score has within the item's reach.
        self.need = np.ones(len(words), np.int64)
        # Words that such an alignment may insert.
        self.slack = np.floor(2 * (1 - least) * self.size + 1e-9).astype(np.int64)
        self.single = False
        seeds, of, offsets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, word in enumerate(words):
            if len(word) < 2:
                self.single = self.single or len(word) == 1
                seeds.append(combine(np.ones(len(word), np.uint64), word))
                offsets.append(np.zeros(len(word), np.int64))
                of.append(np.full(len(word), i))
                continue
            places = len(word) - 1
            sure = min(max(math.ceil(least * len(word) - 1e-9) - 1, 1), places)
            spare = min(len(word) // SPARE, sure - 1)
            self.need[i] = spare + 1
            known = np.array([frequency.get(int(w), 0) for w in word], float)
            after = known[1:] + np.append(known[2:], 0)
            taken = np.zeros(len(word), bool)
            taken[np.argsort(known[:-1] * after, kind="stable")[:places - sure + spare + 1]] = True
            for apart in range(1, REACH + 1):
                pair, at = _pairs(word, np.zeros(len(word), np.int8), apart)
                seeds.append(pair[taken[at]])
                offsets.append(at[taken[at]])
                of.append(np.full(len(offsets[-1]), i))
        seed, of, offset = (np.concatenate(x) for x in (seeds, of, offsets))
        order = np.lexsort((offset, of, seed))
        seed, self.of, self.offset = seed[order], of[order], offset[order]
        self.seed, rank = np.unique(seed, return_inverse=True)
        # Entries by seed, and by item within a seed.
        self.entry = rank * len(words) + self.of
        self.shift = np.uint64(64 - min(max(len(self.seed).bit_length() + 4, 16), 24))
        self.filter = np.zeros(1 << (64 - int(self.shift)), bool)
        self.filter[(self.seed >> self.shift).astype(np.int64)] = True

    def _hits(self, at: np.ndarray, seed: np.ndarray, text: np.ndarray, low: int, high: int):
        """(text, item, place, offset) of the seeds at ``at`` for items ``low`` to ``high``, in bounded parts."""
        first = np.searchsorted(self.entry, seed * len(self.words) + low)
        count = np.searchsorted(self.entry, seed * len(self.words) + high) - first
        if count.sum() > HITS and text[0] != text[-1]:
            # Two halves of whole texts.
            cut = np.searchsorted(text, text[min(np.searchsorted(np.cumsum(count), count.sum() // 2), len(text) - 1)])
            cut = cut or np.searchsorted(text, text[0], "right")
            yield from self._hits(at[:cut], seed[:cut], text[:cut], low, high)
            yield from self._hits(at[cut:], seed[cut:], text[cut:], low, high)
        elif count.sum() > HITS and high - low > 1:
            middle = (low + high) // 2
            yield from self._hits(at, seed, text, low, middle)
            yield from self._hits(at, seed, text, middle, high)
        elif count.sum():
            entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield np.repeat(text, count), self.of[entry], np.repeat(at, count), self.offset[entry]

    def _windows(self, text: np.ndarray, item: np.ndarray, at: np.ndarray, offset: np.ndarray):
        """(text, item, low, high) around hits that are close and many enough for the least score."""
        order = np.lexsort((offset, at, item, text))
        text, item, at, offset = text[order], item[order], at[order], offset[order]
        # Both pairs of a place may be found at one word.
        one = np.ones(len(text), bool)
        one[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(at) != 0) | (np.diff(offset) != 0)
        text, item, at, offset = text[one], item[one], at[one], offset[one]
        span = self.size[item] + self.slack[item]
        last = np.arange(len(text)) + self.need[item] - 1
        end = np.minimum(last, len(text) - 1)
        enough = (last < len(text)) & (text[end] == text) & (item[end] == item) & (at[end] - at <= span)
        step = np.zeros(len(text) + 1, np.int64)
        np.add.at(step, np.flatnonzero(enough), 1)
        np.add.at(step, end[enough] + 1, -1)
        kept = np.cumsum(step)[:-1] > 0
        text, item, begin = text[kept], item[kept], (at - offset)[kept]
        order = np.lexsort((begin, item, text))
        text, item, begin = text[order], item[order], begin[order]
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(begin) > self.slack[item[1:]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(text))[:len(head)] - 1
        text, item, low, high = text[head], item[head], begin[head], begin[tail]
        return text, item, low - self.slack[item], high + self.size[item] + self.slack[item]

    def search(self, slab: Slab) -> tuple[np.ndarray, ...]:
        """(text, item, score, first word, end word) of every pair that reaches the score."""
        none = np.zeros(0, np.int64)
        word, owner = item_words(slab)
        found_at, found_seed = [none], [none]
        for apart in range(0 if self.single else 1, REACH + 1):
            if apart:
                gram, at = _pairs(word, owner, apart)
            else:
                gram, at = combine(np.ones(len(word), np.uint64), word), np.arange(len(word))
            maybe = np.flatnonzero(self.filter[(gram >> self.shift).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.seed, gram[maybe]), len(self.seed) - 1)
            exact = self.seed[place] == gram[maybe]
            found_at.append(at[maybe[exact]])
            found_seed.append(place[exact])
        at, seed = np.concatenate(found_at), np.concatenate(found_seed)
        parts = [(none, none, np.zeros(0), none, none)]
        if len(at):
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            edge = starts_of(owner, len(slab))
            for hits in self._hits(at, seed, owner[at].astype(np.int64), 0, len(self.words)):
                parts.append(self._score(word, edge, *self._windows(*hits)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _score(self, word: np.ndarray, edge: np.ndarray, text: np.ndarray, item: np.ndarray, low: np.ndarray,
               high: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best passage of every pair of text and item, if it reaches the score."""
        low, high = np.maximum(low, edge[text]), np.minimum(high, edge[text + 1])
        passages = [word[a:z] for a, z in zip(low.tolist(), high.tolist())]
        items = [self.words[i] for i in item.tolist()]
        score, end = align(items, passages)
        share = score / (MATCH * self.size[item])
        good = np.flatnonzero(share >= self.least)
        # The start, by aligning what ends there backwards.
        _, back = align([items[i][::-1] for i in good], [passages[i][:end[i]][::-1] for i in good])
        stop = low[good] + end[good]
        text, item, share = text[good], item[good], share[good]
        order = np.lexsort((stop, -share, item, text))
        text, item, share, stop, back = text[order], item[order], share[order], stop[order], back[order]
        one = np.ones(len(text), bool)
        one[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        text, item, share, stop, back = text[one], item[one], share[one], stop[one], back[one]
        return text, item, share, stop - back - edge[text], stop - edge[text]


def blocks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
           item_text: str = "text", block_words: int = BLOCK_WORDS, least: float = MIN_SCORE) -> Iterator[Items]:
    """The test items, block by block, with seeds chosen by a count of their words in all texts.

    NULL and empty items have no words and match nothing; repeated items are
    searched for once per row.
    """
    spark = docs.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch):
                word, owner = item_words(slab)
                lists = pa.ListArray.from_arrays(pa.array(starts_of(owner, len(slab)), pa.int32()),
                                                 pa.array(word.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [fields(batch, "item").take(pa.array(slab.rows)), lists], names=["item", "words"])

    items = hand_over(benchmark.select(F.col(item).cast("long").alias("item"),
                                       F.col(item_text).cast("string").alias("text"))
                      .mapInArrow(words, "item long, words array<long>")
                      .filter(F.size("words") > 0), "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block_words)
    for block in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == block).toArrow()
        if not part.num_rows:
            continue
        lists = part.column("words").combine_chunks()
        flat = lists.flatten().to_numpy().view(np.uint64)
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        own = [flat[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        vocabulary = spark.sparkContext.broadcast(np.unique(flat))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = vocabulary.value
            seen = np.zeros(len(known), np.int64)
            for batch in batches:
                for slab in slabs(batch):
                    word, _ = item_words(slab)
                    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    seen += np.bincount(at[known[at] == word], minlength=len(known))
            got = np.flatnonzero(seen)
            yield record(pa.schema([("word", pa.int64()), ("n", pa.int64())]), known[got].view(np.int64), seen[got])

        counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
            count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        frequency = dict(zip(counts.column("word").to_numpy().view(np.uint64).tolist(),
                             counts.column("n").to_pylist()))
        yield Items(part.column("item").combine_chunks(), own, frequency, least)


_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                    ("first_word", pa.int64()), ("end_word", pa.int64())])
_MATCH_DDL = "doc_id long, item_id long, score double, first_word long, end_word long"


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            least: float = MIN_SCORE, **names) -> DataFrame:
    """One row per text and test item of which it holds a copy: score and place of the best passage.

    ``score`` is the alignment score as a share of that of a full copy, at least
    ``least``; places count words. An item of two words or one is found only whole
    or with a word between. Texts that are NULL or empty match nothing;
    repeated rows match alike; an empty benchmark gives no rows.
    """
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    result = docs.sparkSession.createDataFrame([], _MATCH_DDL)
    for block in blocks(docs, benchmark, text, least=least, **names):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for slab in slabs(batch):
                    rows, item, share, first, end = shared.value.search(slab)
                    if len(rows):
                        yield record(_MATCH, fields(batch, "doc_id").take(pa.array(slab.rows[rows])),
                                     shared.value.ids.take(pa.array(item)), share, first, end)

        result = result.unionByName(frame.mapInArrow(run, _MATCH_DDL))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = MIN_SCORE, **names) -> DataFrame:
    """``docs`` without the texts that hold a copy of a test item; all columns stay."""
    for block in blocks(docs, benchmark, text, least=least, **names):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for slab in slabs(batch, text):
                    rows, *_ = shared.value.search(slab)
                    keep[slab.rows[rows]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "end_word")
