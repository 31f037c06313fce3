"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits over XXH64 of word shingles; documents link at 2 or fewer
differing bits. It is cut into two segments of 32 bits, each with its own table. If two
fingerprints differ in 2 bits or fewer, their lower segments are equal, or their upper
ones are, or the uppers differ in one bit and the lowers in one. So equal segments
and a Hamming ball of one bit on the upper segment miss nothing. Two values that
differ in one bit have different parity, so only even ones enumerate the ball. Members
that meet in a table are verified over the complete fingerprint, and links are joined
into components.

Documents with equal fingerprints are one class, so copies are never paired. All pairs
of a table entry are compared; an entry that is too large for a task is cut up by balls
of one bit around its whole members, of which none holds more than 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.graph import components
from fiscora.llm.registry import query, table
from fiscora.llm.slabs import LOWER, SPACE, fields, mix, record, slabs, starts_of
from fiscora.session import hand_over

MAX_DISTANCE = 2
SHINGLE = 3
SLAB_BYTES = 512 << 10
# A table entry with more distinct fingerprints is cut up before its members are compared.
MAX_BUCKET = 1 << 14
SMALL = 8                   # members of an entry up to which all its pairs are compared at once
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns; runs of 255 rows are added as bytes."""
    whole = len(bits) // 255 * 255
    total = np.add.reduce(bits[whole:], axis=0, dtype=np.uint8).astype(np.int32)
    if whole:
        parts = np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8)
        total += parts.sum(axis=0, dtype=np.int32)
    return total


def _majority(bits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint bits of each owner: set in over half of its rows."""
    at = starts_of(owner, n)
    count = np.diff(at)
    sums = np.zeros((n, bits.shape[1]), np.int32)
    for i in np.flatnonzero(count):
        sums[i] = _column_sums(bits[at[i]:at[i + 1]])
    return 2 * sums > count[:, None]


def _prints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("w0", pa.int64())])
    digest = xxhash.xxh64_digest
    for batch in batches:
        out = []
        for slab in slabs(batch, limit=SLAB_BYTES):
            n = len(slab)
            first, last, owner = slab.words()
            # Words joined by one space each, lower-cased.
            low = LOWER[slab.data]
            keep = ~SPACE[low]
            keep[last] = True
            low[last] = 32
            joined = low[keep].tobytes()
            size = last - first
            begin = np.cumsum(size + 1) - size - 1
            finish = begin + size
            at = starts_of(owner, n)
            place = np.arange(len(first))
            until = np.minimum(place + shingle, at[owner + 1]) - 1
            # Every full window, or the whole sequence of a shorter text.
            whole = (place + shingle <= at[owner + 1]) | (place == at[owner])
            grams = zip(begin[whole].tolist(), finish[until[whole]].tolist())
            hashes = np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in grams]), np.uint8)
            bits = _majority(np.unpackbits(hashes.reshape(-1, 8), axis=1), owner[whole], n)
            out.append(np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64))
        if out:
            yield record(schema, fields(batch, "doc_id"), np.concatenate(out).view(np.int64))


def _flips(width: int, weight: int) -> np.ndarray:
    """All masks of ``weight`` bits among ``width``."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), weight)], np.uint64)


def _bucket(tag: int, *values: np.ndarray) -> np.ndarray:
    h = np.full(values[0].shape, tag, np.uint64)
    for v in values:
        h = mix((h ^ v) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return h


def _buckets(word: np.ndarray) -> np.ndarray:
    """Table entries of each fingerprint; 0 where there is none."""
    high, low = word >> HALF, word & LOW
    even = np.bitwise_count(high) % 2 == 0
    ball = _bucket(3, high[:, None] ^ _flips(32, 1))
    ball[~even, 1:] = 0
    ball[~even, 0] = _bucket(3, high[~even])
    return np.concatenate([_bucket(1, low)[:, None], _bucket(2, high)[:, None], ball], axis=1)


def _split(word: np.ndarray) -> np.ndarray:
    """Entries of balls of one bit: fingerprints within 2 bits share one, none holds over 65."""
    balls = _bucket(4, word[:, None] ^ _flips(64, 1))
    return np.concatenate([_bucket(4, word)[:, None], balls], axis=1)


def _enter(batches: Iterator[pa.RecordBatch], entries) -> Iterator[pa.RecordBatch]:
    """One row per fingerprint and table entry."""
    schema = pa.schema([(c, pa.int64()) for c in ("bucket", "node", "w0")])
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            word, node = fields(part, "w0").to_numpy(), fields(part, "node").to_numpy()
            keys = entries(word.view(np.uint64))
            row, col = np.nonzero(keys)
            yield record(schema, keys[row, col].view(np.int64), node[row], word[row])


def _forest(words: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Groups of places in ``words`` connected by distances up to ``limit``.

    Walks the graph; each row is compared only with rows not yet reached.
    """
    left = np.arange(len(words))
    while len(left):
        group, todo = [left[0]], [left[0]]
        left = left[1:]
        while todo and len(left):
            here = todo.pop()
            near = np.bitwise_count(words[left] ^ words[here]) <= limit
            if near.any():
                found = left[near]
                group.extend(found.tolist())
                todo.extend(found.tolist())
                left = left[~near]
        yield np.array(group)


def _link(batches: Iterator[pa.RecordBatch], limit: int, most: float) -> Iterator[pa.RecordBatch]:
    """Links within table entries of a partition sorted by entry and fingerprint.

    Rows (a, b) join each member to the smallest of its connected group in the
    entry. Members of an entry that grows beyond ``most`` come out unlinked,
    as (a, NULL, bucket), to be cut up.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])
    held: list[np.ndarray] = []      # members of the entry that is still open
    held_bucket, held_rows, over = None, 0, False

    def finish() -> Iterator[pa.RecordBatch]:
        nonlocal held, held_rows, over
        rows = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        held, held_rows = [], 0
        if over:
            yield record(schema, rows[:, 0], pa.nulls(len(rows), pa.int64()),
                         np.full(len(rows), held_bucket, np.int64))
        elif len(rows) > 1:
            yield from linked(rows)

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.unique(rows, axis=0) if len(rows) > 2 else rows
        a, b = [], []
        for group in _forest(np.ascontiguousarray(rows[:, 1]).view(np.uint64), limit):
            if len(group) > 1:
                nodes = rows[group, 0]
                root = nodes.min()
                nodes = nodes[nodes != root]
                a.append(np.full(len(nodes), root))
                b.append(nodes)
        if a:
            a = np.concatenate(a)
            yield record(schema, a, np.concatenate(b), pa.nulls(len(a), pa.int64()))

    for batch in batches:
        bucket = fields(batch, "bucket").to_numpy()
        rows = np.stack([fields(batch, c).to_numpy() for c in ("node", "w0")], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        size = np.diff(edge)
        # Entries wholly inside the batch: most hold one member and need no look, and all
        # pairs of the small ones are compared at once, row by row with the next ones.
        inner = np.ones(len(size), bool)
        inner[[0, -1]] = False
        small = np.repeat(inner & (size <= SMALL), size)
        values = np.ascontiguousarray(rows[:, 1]).view(np.uint64)
        for lag in range(1, SMALL):
            one = np.flatnonzero(small[:-lag] & (bucket[lag:] == bucket[:-lag])) if len(small) > lag else []
            if not len(one):
                break
            near = np.bitwise_count(values[one] ^ values[one + lag]) <= limit
            if near.any():
                a, b = rows[one[near], 0], rows[one[near] + lag, 0]
                yield record(schema, a, b, pa.nulls(len(a), pa.int64()))
        for k in np.flatnonzero(~inner | (size > SMALL)):
            part, key = rows[edge[k]:edge[k + 1]], bucket[edge[k]]
            if key != held_bucket:
                yield from finish()
                held_bucket, over = key, False
            held.append(part)
            held_rows += len(part)
            if held_rows > most:
                over = True
            if over:
                yield from finish()
    yield from finish()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, w0): the fingerprint as a signed number.

    A text of fewer words than a shingle is one shingle; a text without words,
    or NULL, has fingerprint zero.
    """
    frame = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    return frame.mapInArrow(lambda it: _prints(it, shingle), "doc_id long, w0 long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
           distance: int = MAX_DISTANCE, most: int = MAX_BUCKET) -> DataFrame:
    """Each document's fingerprint and component: (doc_id, w0, component_id).

    ``distance`` is at most 2, which the tables are made for. The component id is the
    smallest key reachable over links, itself included. Documents without words have
    fingerprint zero and are linked like any other. A row without a key takes part in no
    class of its own: it gets the component of its fingerprint, or NULL. Repeated rows and
    ties fall into one class; an empty table gives no rows; other columns are not read. A
    task holds a slab of texts, or some 100 bytes per word of a single longer text.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"fingerprints link at up to {MAX_DISTANCE} differing bits")
    prints = hand_over(fingerprints(docs, key, text, shingle), "prints")
    classes = hand_over(prints.filter("doc_id IS NOT NULL").groupBy("w0").agg(
        F.min("doc_id").alias("node")), "classes")

    def enter(rows: DataFrame, entries) -> DataFrame:
        return rows.select("w0", "node").mapInArrow(lambda it: _enter(it, entries), "bucket long, node long, w0 long")

    def link(rows: DataFrame, limit: float) -> DataFrame:
        placed = rows.repartition("bucket").sortWithinPartitions("bucket", "w0")
        return placed.mapInArrow(lambda it: _link(it, distance, limit), "a long, b long, bucket long")

    found = hand_over(link(enter(classes, _buckets), most), "links")
    links = found.filter("b IS NOT NULL").select("a", "b")
    # Crowded entries are cut so that all of their close pairs still meet; what is cut is not cut again.
    crowded = found.filter("b IS NULL").select(F.col("a").alias("_a")).distinct()
    if not crowded.isEmpty():
        again = classes.join(crowded, F.col("_a") == F.col("node"))
        links = links.union(hand_over(link(enter(again, _split), inf), "links").select("a", "b"))
    roots = components(links).withColumnRenamed("node", "_node")
    labels = hand_over(classes.join(roots, F.col("node") == F.col("_node"), "left").select(
        F.col("w0").alias("_w0"), F.coalesce("root", "node").alias("component_id")), "labels")
    return prints.join(labels, F.col("w0") == F.col("_w0"), "left").select("doc_id", "w0", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             distance: int = MAX_DISTANCE, most: int = MAX_BUCKET) -> DataFrame:
    """``docs`` with one document of each group of ``groups``, that with the smallest key.

    Texts without words are near-duplicates of each other. Rows that share a key and
    whose group keeps that key count as one document and leave one row; rows with a NULL
    key stay. All columns stay, whatever their names. An empty table stays empty.
    """
    def fresh(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    gone_key, shared_key = fresh("_gone"), fresh("_shared")
    found = groups(docs, key, text, shingle, distance, most)
    gone = hand_over(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone_key)).distinct(), "gone")
    kept = docs.join(gone, F.col(f"`{key}`") == F.col(gone_key), "left_anti")
    shared = hand_over(found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(shared_key)).agg(
        F.count("*").alias("n")).filter("n > 1").select(shared_key), "shared")
    if shared.isEmpty():
        return kept
    same = F.col(f"`{key}`") == F.col(shared_key)
    once = kept.join(shared, same, "left_semi").dropDuplicates([key])
    return kept.join(shared, same, "left_anti").unionByName(once)


@query("op7_simhash_groups")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
