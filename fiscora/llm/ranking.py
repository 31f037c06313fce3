"""Ranked lexical search: the best documents for every item of a table.

Bag deduplication. An item only sees the terms that items have, so a document
is reduced to its counts of those (its bag) and its length class m. Documents
with the same bag and m score alike for every item: they form one class, found
by a hash of both and verified on the bytes themselves. Classes are scored once;
the members of the winning classes are then listed by ascending key.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII,
A-Z lower-cased. All scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import LOWER, Slab, fields, record, slabs, starts_of
from fiscora.session import hand_over

TOP = 20
BLOCK_TERMS = 1_000_000     # terms of the items that are searched for at once
SLAB_BYTES = 512 << 10
CELLS = 1 << 20             # scores held at once in a task
UNKEYED = (1 << 63) - 1     # rows without a key come after all others

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every term, and the index of its text."""
    solid = TERM[slab.data]
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    first, last = turn[::2], turn[1::2]
    return first, last, np.searchsorted(slab.end, first)


class Vocabulary:
    """The terms of a block of items, found in texts by hash and verified byte by byte."""

    def __init__(self, terms: list[bytes]):
        slab = Slab(terms, np.arange(len(terms)))
        hashes = slab.hashes(slab.start, slab.end, True)
        order = np.argsort(hashes)
        self.place = order.astype(np.int32)         # of a sorted hash among the terms
        self.hash = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(int(np.ceil(np.log2(max(len(terms), 1)))) + 3, 8)
        self.shift = np.uint64(64 - bits)
        slot = (self.hash[:-1] >> self.shift).astype(np.int64)
        self.start = np.searchsorted(slot, np.arange(1 << bits)).astype(np.int32)
        self.depth = int(np.bincount(slot).max()) if len(terms) else 0
        self.size = (slab.end - slab.start)[order]
        self.bytes = np.append(LOWER[slab.data], np.zeros(8, np.uint8))
        self.first = slab.start[order]

    def __len__(self) -> int:
        return len(self.place)

    @staticmethod
    def _eight(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place as one number."""
        view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        shift = np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64)
        return view[at] << shift

    def find(self, slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of every known term of a slab, its text, and the number of terms of every text."""
        first, last, owner = terms_of(slab)
        n = np.bincount(owner, minlength=len(slab))
        h = slab.hashes(first, last, True)
        at = self.start[(h >> self.shift).astype(np.int64)]
        for _ in range(self.depth):
            at = at + (self.hash[at] < h)
        same = np.flatnonzero(self.hash[at] == h)
        same = same[at[same] < len(self)]
        at, first, size, owner = at[same], first[same], (last - first)[same], owner[same]
        right = self.size[at] == size
        low = np.append(LOWER[slab.data], np.zeros(8, np.uint8))
        todo, done = np.flatnonzero(right), 0
        while len(todo):
            left = size[todo] - done
            equal = (self._eight(low, first[todo] + done, left)
                     == self._eight(self.bytes, self.first[at[todo]] + done, left))
            right[todo[~equal]] = False
            done += 8
            todo = todo[equal & (left > 8)]
        return self.place[at[right]], owner[right], n


class Items:
    """A block of items: per known term, the items that have it and how often."""

    def __init__(self, ids: pa.Array, lists: list[list[bytes]]):
        self.ids = ids
        terms = sorted({t for own in lists for t in own})
        index = {t: k for k, t in enumerate(terms)}
        self.vocabulary = Vocabulary(terms)
        term = np.array([index[t] for own in lists for t in own], np.int64)
        item = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        pair, self.count = np.unique(term * len(lists) + item, return_counts=True)
        self.item = pair % len(lists)
        self.start = np.searchsorted(pair // len(lists), np.arange(len(terms) + 1))

    def __len__(self) -> int:
        return len(self.ids)


_WORDS = "item long, terms array<string>"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in slabs(batch):
            first, last, owner = terms_of(slab)
            low = LOWER[slab.data].tobytes()
            flat = pa.array([low[a:z].decode() for a, z in zip(first.tolist(), last.tolist())], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(starts_of(owner, len(slab)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [fields(batch, "item").take(pa.array(slab.rows)), lists], names=["item", "terms"])


def item_blocks(items: DataFrame, item: str, text: str, block_terms: int) -> Iterator[Items]:
    """The items with a term, in blocks of about ``block_terms`` terms."""
    rows = hand_over(items.select(F.col(f"`{item}`").cast("long").alias("item"),
                                  F.col(f"`{text}`").cast("string").alias("text"))
                     .mapInArrow(_item_terms, _WORDS).filter(F.size("terms") > 0), "items")
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // block_terms)
    for block in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(n)) == block).toArrow()
        if part.num_rows:
            yield Items(part.column("item").combine_chunks(),
                        [[t.encode() for t in own] for own in part.column("terms").to_pylist()])


_BAG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Per text its key, its terms and its bag: ascending (term, count) pairs of 32 bits each."""
    for batch in batches:
        for slab in slabs(batch, limit=SLAB_BYTES):
            at, owner, n = vocabulary.find(slab)
            pair, count = np.unique(owner * len(vocabulary) + at, return_counts=True)
            flat = np.stack([pair % len(vocabulary), count], axis=1).astype("<i4")
            edge = 8 * starts_of(pair // len(vocabulary), len(slab))
            bag = pa.Array.from_buffers(pa.binary(), len(slab), [
                None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat)])
            yield record(_BAG, fields(batch, "doc_id").take(pa.array(slab.rows)), n, bag)


def _unpack(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of a column of bags."""
    raw = bags.to_pylist()
    flat = np.frombuffer(b"".join(raw), "<i4").reshape(-1, 2)
    row = np.repeat(np.arange(len(raw)), [len(b) // 8 for b in raw])
    return row, flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, per task."""
    seen = np.zeros(size, np.int64)
    for batch in batches:
        _, term, _ = _unpack(fields(batch, "bag"))
        seen += np.bincount(term, minlength=size)
    got = np.flatnonzero(seen)
    yield record(pa.schema([("term", pa.int64()), ("df", pa.int64())]), got, seen[got])


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The ``top`` best classes per item of those seen so far: by score, then by smallest key."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item, self.score, self.first, self.id = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.ones(items, np.int64)       # a score must be above 0

    def add(self, item: np.ndarray, score: np.ndarray, first: np.ndarray, id_: np.ndarray) -> None:
        item, score, first, id_ = (np.concatenate(x) for x in (
            (self.item, item), (self.score, score), (self.first, first), (self.id, id_)))
        order = np.lexsort((first, -score, item))
        item = item[order]
        begin = np.searchsorted(item, item)
        keep = np.arange(len(item)) - begin < self.top
        order = order[keep]
        self.item, self.score, self.first, self.id = item[keep], score[order], first[order], id_[order]
        last = (np.arange(len(keep)) - begin)[keep] == self.top - 1
        self.least[self.item[last]] = self.score[last]


_WINNER = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("score", pa.int64()),
                     ("first", pa.int64()), ("class", pa.int64())])
_WINNER_DDL = "item long, item_id long, score long, first long, class long"


def _score(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """The best classes of a task for every item."""
    best = Best(len(items), top)
    many = np.diff(items.start)
    rows_at_once = max(1, CELLS // len(items))
    for batch in batches:
        for at in range(0, batch.num_rows, rows_at_once):
            part = batch.slice(at, rows_at_once)
            row, term, tf = _unpack(fields(part, "bag"))
            m = fields(part, "m").to_numpy()
            share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            scores = np.zeros(part.num_rows * len(items), np.int64)
            # Entries times the items that have their term, some at a time.
            count = many[term]
            edge = np.concatenate([[0], np.cumsum(count)])
            a = 0
            while a < len(term):
                z = max(int(np.searchsorted(edge, edge[a] + CELLS, "right")) - 1, a + 1)
                own = count[a:z]
                place = np.repeat(items.start[term[a:z]] - (edge[a:z] - edge[a]), own) + np.arange(own.sum())
                np.add.at(scores, np.repeat(row[a:z] * len(items), own) + items.item[place],
                          np.repeat(share[a:z], own) * items.count[place])
                a = z
            scores = scores.reshape(part.num_rows, len(items))
            of, item = np.nonzero(scores >= best.least)
            if len(of):
                best.add(item, scores[of, item], fields(part, "first").to_numpy()[of],
                         fields(part, "class").to_numpy()[of])
    yield record(_WINNER, best.item, items.ids.take(pa.array(best.item)), best.score, best.first, best.id)


def _top(rows: DataFrame, by: list[str], top: int, *order) -> DataFrame:
    """The first ``top`` rows per group; each task passes on no more than that many."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of every item: (item_id, rank, doc_id, score), scores above 0 only.

    Equal scores rank by ascending key. Every row is a document, and every row of ``items``
    an item, also when keys repeat; rows with a NULL key rank after equals that have one.
    Texts that are NULL or empty have no terms: such documents count nowhere and such items
    have no result. Empty tables give no rows; other columns are not read. A task holds a
    slab of texts, or a few times a single text that is longer.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item, item_text, block_terms):
        shared = spark.sparkContext.broadcast(block)
        size = len(block.vocabulary)
        rows = hand_over(frame.mapInArrow(
            lambda it, shared=shared: _bags(it, shared.value.vocabulary),
            "doc_id long, n long, bag binary").filter("n > 0"), "bags")
        total = rows.agg(F.count("*"), F.sum("n")).first()
        documents, length = total[0], total[1] or 1
        df = rows.select("bag").mapInArrow(lambda it, size=size: _frequencies(it, size), "term long, df long") \
            .groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        held = np.zeros(size, np.int64)
        held[df.column("term").to_numpy()] = df.column("df").to_numpy()
        weights = spark.sparkContext.broadcast(np.array([weight(documents, int(x)) for x in held], np.int64))
        # Bag and m decide the score: one class each, told apart by a hash and by the bytes.
        placed = rows.filter(F.length("bag") > 0).select(
            "doc_id", "bag", F.expr(f"75 + (25 * n * {documents}L) div {length}L").alias("m")
        ).withColumn("fingerprint", F.xxhash64("m", "bag"))
        alike = ["fingerprint", "m", "bag"]
        classes = hand_over(placed.groupBy(*alike).agg(
            F.coalesce(F.min("doc_id"), F.lit(UNKEYED)).alias("first")
        ).withColumn("class", F.monotonically_increasing_id()), "classes")
        found = classes.select("bag", "m", "first", "class").mapInArrow(
            lambda it, shared=shared, weights=weights: _score(it, shared.value, weights.value, top), _WINNER_DDL)
        # The best documents are in the classes that are best by score and smallest key.
        winners = hand_over(_top(found, ["item"], top, F.desc("score"), "first").drop("rank", "first"), "winners")
        chosen = classes.join(winners.select("class").distinct(), "class", "left_semi").select("class", *alike)
        members = _top(placed.join(chosen, alike).select("class", "doc_id"), ["class"], top,
                       F.asc_nulls_last("doc_id")).drop("rank")
        ranked = _top(winners.join(hand_over(members, "members"), "class"), ["item"], top,
                      F.desc("score"), F.asc_nulls_last("doc_id"))
        result = result.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return result


_SPLIT = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
totals AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, totals GROUP BY term, total),
scored AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length))))::BIGINT AS score
  FROM q JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored
      WHERE score > 0)
WHERE rank <= 20"""


@query("op11_ranked_search", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
