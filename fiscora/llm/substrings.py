"""Exact removal of repeated byte strings by bucket-pointer refinement.

Every start of a 100-byte string is put into a bucket, buckets are refined by
sorting on the identifiers of what lies at later offsets, and buckets with one
member leave. Refined buckets are the input of the next round:

1. Initial buckets are 32-byte grams, taken at one anchor per string: the gram
   with the smallest hash inside it. Equal strings have equal anchors, and
   neighbouring starts share one, so a run of starts is a single member. Members
   are sorted by (bucket, identifier of the run's whole content). Later members
   with an equal identifier repeat an earlier string at each of their starts; a
   bucket whose members differ goes on.
2. Those runs are cut into cells of eight starts on a grid fixed by the anchor.
   The bucket is the 93 bytes that all strings of a cell share, the identifier
   its whole content.
3. What is left is refined to single starts, from the bucket of round 2 and the
   bytes around its core; no text is needed for that.

Identifiers are content hashes, so no global numbering is needed; two strings
are taken as equal if 120 or more bits agree. Before rows move, each task keeps
one member of every (bucket, identifier) and one mark for a bucket that is mixed
already; a string in a third of all documents costs a row per task and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import BASE, BYTE_VALUES, SLAB_BYTES, Slab, combine, fields, mix, record, slabs
from fiscora.session import hand_over

LENGTH = 100                # bytes of a repeated string
GRAM = 32                   # bytes of an initial bucket's gram
CELL = 8                    # starts of one cell in round 2
CORE = LENGTH - CELL + 1
UNIT_ROWS = 500_000         # members a task combines before it passes them on

#: What is known of a member: first of its kind so far, repeated, to be refined; or a mark
#: that its bucket is mixed.
FIRST, REPEAT, REFINE, MIXED = 0, 1, 2, 3

_MEMBER = [("b", pa.int64()), ("r", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("kind", pa.int8())]
_FLANKS = [("left", pa.int64()), ("right", pa.int64())]


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'byte' if f.type == pa.int8() else 'long'}" for f in schema)


MEMBER = pa.schema(_MEMBER)
CELLS = pa.schema(_MEMBER + _FLANKS)
# Position, places to the anchor (or into the cell) and number of starts share one number.


def _pack(place: np.ndarray, offset: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (place << 16) | (offset << 8) | n


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, (at >> 8) & 255, at & 255


def _doublings(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all strings of 1, 2, 4 ... 64 bytes, by their start."""
    found, k = {1: BYTE_VALUES[data]}, 1
    while k < 64 and len(data) >= 2 * k:
        h = found[k]
        found[2 * k] = h[:-k] * np.uint64(pow(BASE, k, 1 << 64)) + h[k:]
        k *= 2
    return found


def _string_hash(doublings: dict[int, np.ndarray], n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``n`` bytes from each place (every place if not given)."""
    size = len(doublings[1]) - n + 1
    h, done = None, 0
    for part in (1 << k for k in reversed(range(7)) if n >> k & 1):
        piece = doublings[part]
        piece = piece[done:done + size] if at is None else piece[at + done]
        h = piece if h is None else h * np.uint64(pow(BASE, part, 1 << 64)) + piece
        done += part
    return h


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    k, low = 1, v
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    size = len(v) - width + 1
    return np.minimum(low[:size], low[width - k:width - k + size])


def _runs(slab: Slab) -> tuple[np.ndarray, ...]:
    """Bucket, identifier, owner, position in the text, places to the anchor, number of starts."""
    data, n = slab.data, LENGTH
    long = slab.end - slab.start >= n
    none = np.zeros(0, np.int64)
    if not long.any():
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    doublings = _doublings(data)
    gram = mix(_string_hash(doublings, GRAM))
    whole = _string_hash(doublings, n)
    # Hash above, place below: the smallest is the leftmost of the smallest grams.
    bits = np.uint64(max(len(data).bit_length(), 1))
    keyed = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_smallest(keyed, n - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[slab.start[long]] = 1
    inside[slab.end[long] - n + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[:len(anchor)])
    anchor = anchor[start]
    first = np.flatnonzero(np.concatenate(
        [[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    begin, finish, anchor = start[first], start[last], anchor[first]
    offset, count = anchor - begin, finish - begin + 1
    # First and last string cover the run; with their places they fix its content.
    identifier = combine(whole[begin], whole[finish], (offset * 256 + count).astype(np.uint64))
    owner = np.searchsorted(slab.end, begin)
    return gram[anchor], identifier, owner, begin - slab.start[owner], offset, count


def _combine(schema: pa.Schema, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Give the members of one task's unit their kind; ``columns`` follow the schema without kind."""
    b, r, doc, at, *more = columns
    order = np.lexsort((at, doc, r, b))
    b, r, doc, at, *more = (c[order] for c in (b, r, doc, at, *more))
    n = len(b)
    new_b, new = np.ones(n, bool), np.ones(n, bool)
    new_b[1:] = b[1:] != b[:-1]
    new[1:] = new_b[1:] | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    head_of = head[np.cumsum(new) - 1]
    # A repeated row is the same string, not another one.
    itself = (doc == doc[head_of]) & (at == at[head_of])
    group = np.cumsum(new_b) - 1
    mixed = np.bincount(group, weights=new) > 1
    kind = np.where(itself, np.where(mixed[group], REFINE, FIRST), REPEAT).astype(np.int8)
    mark = np.flatnonzero(new_b & mixed[group])
    marks = [b[mark], r[mark], np.zeros(len(mark), np.int64), np.zeros(len(mark), np.int64),
             np.full(len(mark), MIXED, np.int8), *[c[mark] for c in more]]
    if not more:
        # Members decided here need their bucket no more: any value that sorts them apart will do.
        decided = (kind == REPEAT) | (kind == REFINE)
        b = np.where(decided, mix(doc.view(np.uint64) ^ mix(at.view(np.uint64))).view(np.int64), b)
        r = np.where(decided, 0, r)
    keep = ~((kind == FIRST) & ~new)        # repeated rows of a first need no second look
    rows = [c[keep] for c in (b, r, doc, at, kind, *more)]
    return record(schema, *[np.concatenate([x, y]) for x, y in zip(rows, marks)])


class _Unit:
    """Members gathered until there are enough to combine."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.parts, self.rows = schema, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append([c.view(np.int64) if c.dtype == np.uint64 else c for c in columns])
            self.rows += len(columns[0])
        if self.rows >= UNIT_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            self.parts, self.rows = [], 0
            yield _combine(self.schema, columns)


def _first_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = _Unit(MEMBER)
    for batch in batches:
        ids = fields(batch, "doc").to_numpy()
        for slab in slabs(batch):
            b, r, owner, place, offset, count = _runs(slab)
            yield from unit.add(b, r, ids[slab.rows][owner], _pack(place, offset, count))
    yield from unit.flush()


def _texts(batch: pa.RecordBatch) -> Iterator[Slab]:
    """Slabs of packed texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts, rows, size = [], [], 0
    for i, z in enumerate(fields(batch, "z")):
        text = unpack(z.as_buffer()) if z.is_valid and len(z.as_buffer()) else b""
        texts.append(text)
        rows.append(i)
        size += len(text)
        if size >= SLAB_BYTES:
            yield Slab(texts, np.array(rows))
            texts, rows, size = [], [], 0
    if texts:
        yield Slab(texts, np.array(rows))


def _listed(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the list column ``ats`` for these rows, and the row each belongs to."""
    lists = fields(batch, "ats").slice(int(rows[0]), len(rows))
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(rows)), counts)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of round 2: cells of the runs listed for each text."""
    unit = _Unit(CELLS)
    for batch in batches:
        ids = fields(batch, "doc").to_numpy()
        for slab in _texts(batch):
            at, owner = _listed(batch, slab.rows)
            if not len(at):
                continue
            place, offset, count = _unpack(at)
            begin = slab.start[owner] + place
            finish, anchor = begin + count - 1, begin + offset
            low, high = (anchor - finish) // CELL, (anchor - begin) // CELL
            each = high - low + 1
            k = np.repeat(np.arange(len(at)), each)
            g = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(each) - each, each)
            core = anchor[k] - CELL * g                    # last start of the full cell
            corner = core - CELL + 1                       # its first start
            first, last = np.maximum(corner, begin[k]), np.minimum(core, finish[k])
            left, right = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for j in range(CELL - 1):
                shift = 8 * (CELL - 2 - j)
                here, there = corner + j, corner + LENGTH + j
                left |= np.where(here >= first, slab.data[np.maximum(here, 0)].astype(np.int64) << shift, 0)
                right |= np.where(there < last + LENGTH,
                                  slab.data[np.minimum(there, len(slab.data) - 1)].astype(np.int64) << shift, 0)
            bucket = combine(_string_hash(_doublings(slab.data), CORE, core), g.astype(np.uint64))
            n = last - first + 1
            identifier = combine(bucket, left.view(np.uint64), right.view(np.uint64),
                                 ((first - corner) * 256 + n).astype(np.uint64))
            owner = owner[k]
            yield from unit.add(bucket, identifier, ids[slab.rows][owner],
                                _pack(first - slab.start[owner], first - corner, n), left, right)
    yield from unit.flush()


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of round 3: the single starts of each cell."""
    unit = _Unit(MEMBER)
    for batch in batches:
        b, doc, at, left, right = (fields(batch, c).to_numpy() for c in ("b", "doc", "at", "left", "right"))
        place, offset, n = _unpack(at)
        for j in range(CELL):
            has = (j >= offset) & (j < offset + n)
            inner = left[has] & ((1 << 8 * (CELL - 1 - j)) - 1)
            outer = right[has] >> 8 * (CELL - 1 - j)
            step = np.full(has.sum(), j, np.uint64)
            parts = [step, inner.view(np.uint64), outer.view(np.uint64)]
            core = b[has].view(np.uint64)
            spot = place[has] + j - offset[has]
            yield from unit.add(combine(core, *parts), combine(*parts, core), doc[has],
                                _pack(spot, np.zeros_like(spot), np.ones_like(spot)))
    yield from unit.flush()


def _settle(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Members that repeat or go on, from rows sorted by bucket, identifier, document, place."""
    held = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
        b = rows[0]
        cut = int(np.searchsorted(b, b[-1])) if len(b) else 0       # the last bucket may go on
        held = [c[cut:] for c in rows]
        if cut:
            yield _decide([c[:cut] for c in rows], schema)
    if held is not None and len(held[0]):
        yield _decide(held, schema)


def _decide(rows: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    b, r, doc, at, kind = rows[:5]
    n = len(b)
    group = np.concatenate([[0], np.cumsum(b[1:] != b[:-1])])
    mixed = np.zeros(group[-1] + 1, bool)
    mixed[group[kind == MIXED]] = True
    one = np.flatnonzero(kind == FIRST)
    new = np.ones(len(one), bool)
    new[1:] = (b[one][1:] != b[one][:-1]) | (r[one][1:] != r[one][:-1])
    mixed |= np.bincount(group[one], weights=new, minlength=len(mixed)) > 1
    result = np.where((kind == REPEAT) | (kind == REFINE), kind, FIRST).astype(np.int8)
    if len(one):
        head = one[np.flatnonzero(new)][np.cumsum(new) - 1]
        itself = (doc[one] == doc[head]) & (at[one] == at[head])
        result[one] = np.where(itself, np.where(mixed[group[one]] & new, REFINE, FIRST), REPEAT)
    keep = result != FIRST
    return record(schema, *[(result if k == 4 else c)[keep] for k, c in enumerate(rows)])


def _round(members: DataFrame, schema: pa.Schema, name: str) -> DataFrame:
    order = ("b", "r", "doc", "at")
    # Only undecided members have to meet; the others are spread evenly.
    where = F.when(F.col("kind").isin(FIRST, MIXED), F.col("b")).otherwise(F.xxhash64("doc", "at"))
    return hand_over(members.repartition(where).sortWithinPartitions(*order).mapInArrow(
        lambda it: _settle(it, schema), _ddl(schema)), name)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = fields(batch, "text").cast(pa.binary())
        z = [pack(t.as_buffer()) if t.is_valid else None for t in texts]
        yield pa.RecordBatch.from_arrays([fields(batch, "doc"), pa.array(z, pa.binary())], names=["doc", "z"])


_REPORT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in _texts(batch):
            at, owner = _listed(batch, slab.rows)
            place, _, count = _unpack(at)
            begin = slab.start[owner] + place
            change = np.zeros(len(slab.data) + 1, np.int32)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + count - 1 + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            runs = np.concatenate([[0], np.cumsum(gone[1:] & ~gone[:-1])])
            kept = [slab.data[s:e][~gone[s:e]].tobytes() if removed[e] > removed[s] else slab.raw[s:e]
                    for s, e in zip(slab.start.tolist(), slab.end.tolist())]
            yield record(_REPORT, fields(batch, "doc").take(pa.array(slab.rows)), slab.end - slab.start,
                         removed[slab.end] - removed[slab.start], runs[slab.end - 1] - runs[slab.start - 1],
                         [sha256(k).hexdigest() for k in kept],
                         pa.array(kept, pa.binary()) if keep_text else pa.nulls(len(kept), pa.binary()))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept bytes.

    A byte goes if a 100-byte string that covers it also starts earlier
    (smaller key, or earlier in the same text), judged on the input. NULL counts
    as empty; texts under 100 bytes lose nothing. Rows that share a key count
    as one document, the smallest of their texts. Rows with a NULL key are
    returned whole and are not compared. Other columns are not read.
    """
    frame = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    named = frame.filter("doc IS NOT NULL")
    shared = hand_over(named.groupBy("doc").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc"), "shared")
    if not shared.isEmpty():
        named = named.join(shared, "doc", "left_anti").unionByName(
            named.join(shared, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")))
    packed = named.mapInArrow(_packed, "doc long, z binary")

    def lists(rows: DataFrame) -> DataFrame:
        # Bounded by the length of a text.
        return rows.groupBy("doc").agg(F.collect_list("at").alias("ats"))

    one = _round(named.mapInArrow(_first_members, _ddl(MEMBER)), MEMBER, "runs")
    runs = lists(one.filter(F.col("kind") == REFINE))
    two = _round(packed.join(runs, "doc").mapInArrow(_cells, _ddl(CELLS)), CELLS, "cells")
    three = _round(two.filter(F.col("kind") == REFINE).mapInArrow(_starts, _ddl(MEMBER)), MEMBER, "starts")
    repeats = [x.filter(F.col("kind") == REPEAT).select("doc", "at") for x in (one, two, three)]
    gone = lists(repeats[0].union(repeats[1]).union(repeats[2]))
    report = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    found = packed.join(gone, "doc", "left").mapInArrow(lambda it: _remove(it, keep_text), report)
    nameless = frame.filter("doc IS NULL").withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        (F.encode("text", "UTF-8") if keep_text else F.lit(None).cast("binary")).alias("kept"))
    rows = found.unionByName(nameless).withColumnRenamed("doc", key)
    return rows if keep_text else rows.drop("kept")


_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0))) AS i FROM d),
s AS (SELECT doc_id, i, substring(x, 2 * i + 1, 200) AS w FROM p),
f AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
o AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY ALL),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r),
t AS (SELECT k.doc_id, string_agg(substring(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS head, max(z) AS z,
        count(*) AS n_spans, sum(k.z - k.a) AS n_removed
      FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN head IS NULL THEN x ELSE head || substring(x, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


@query("op9_repeated_strings", _SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
