"""CSV records that span lines, read from one large file by many tasks.

Spark splits a file of lines freely, a file of records only if no record holds
a line end. Whether a line begins a record depends on all quotes before it. So
the lines are read twice. First every block reports what it does to both
possible beginnings: between records, or inside a quoted value. Running over
the few blocks, that gives each block's true beginning. Then all blocks are cut
into records at the same time, and only records that cross a block's end meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fiscora.session import hand_over

#: Encodings in which quotes, commas and line ends are single bytes of their own.
BYTE_ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1",
                  "latin1": "ISO-8859-1"}

# A quoted value ends at the first quote without a backslash before it. What
# then stands before the next comma belongs to the value but quotes nothing.
_INSIDE = rb'(?:[^"\\]++|\\.?)*+"[^,]*+'
_REST = re.compile(_INSIDE, re.DOTALL)
_VALUES = re.compile(rb'(?:(?:"' + _INSIDE + rb'|(?!")[^,]*+),)*+', re.DOTALL)

_FACTS = "path string, start long, after0 int, after1 int, began boolean, head binary"
_PIECES = "path string, owner long, start long, value binary, first boolean"


def stays_open(line: bytes, inside: bool) -> bool:
    """Whether a quoted value is open at the end of ``line``, begun inside one or not."""
    at = 0
    if inside:
        rest = _REST.match(line)
        if rest is None:
            return True
        at = rest.end() + 1
    if at > len(line):
        return False
    at = _VALUES.match(line, at).end()
    return line[at:at + 1] == b'"' and _REST.match(line, at + 1) is None


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with file and first byte of their block; a carriage return stays on the line."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        # Blocks must not change with the number of executors between the two readings.
        spark.conf.set(name, str(max(spark.sparkContext.defaultParallelism, 1)))
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, list[int]]]:
    """Stretches of lines of one block, with the places of those that hold a quote."""
    for batch in batches:
        path, start, value = (batch.column(i) for i in range(3))
        if not len(value):
            continue
        codes = path.dictionary_encode().indices.to_numpy()
        starts = start.to_numpy()
        cut = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        quoted = pc.match_substring(value, '"').to_numpy(zero_copy_only=False)
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(value)]):
            yield path[a].as_py(), int(starts[a]), value.slice(a, z - a), np.flatnonzero(quoted[a:z]).tolist()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: where it ends for both beginnings, if a record begins after an open one, the header."""
    block, state, began, head, done = None, [0, 1], False, [], False

    def row() -> pa.RecordBatch:
        text = b"\n".join(head).removesuffix(b"\r") if done else None
        return pa.RecordBatch.from_arrays(
            [pa.array([block[0]]), pa.array([block[1]], pa.int64()), pa.array(state[:1], pa.int32()),
             pa.array(state[1:], pa.int32()), pa.array([began]), pa.array([text], pa.binary())],
            names=["path", "start", "after0", "after1", "began", "head"])

    for path, start, value, quoted in _runs(batches):
        if block != (path, start):
            if block is not None:
                yield row()
            block, state, began, head, done = (path, start), [0, 1], False, [], False
        if start == 0 and not done:
            for line in value:
                line = line.as_py()
                if not head and line in (b"", b"\r"):
                    continue
                still = stays_open(line, bool(head))
                head.append(line)
                if not still:
                    done = True
                    break
        for i in quoted:
            line = value[i].as_py()
            one = int(stays_open(line, False))
            two = int(stays_open(line, True)) if 1 in state else one
            state = [two if s else one for s in state]
            began = began or not state[1]
    if block is not None:
        yield row()


def _starts(facts: DataFrame) -> DataFrame:
    """Blocks that begin inside a quoted value, and the block in which its record began."""
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A block keeps the state, swaps it, or sets it whatever it was.
    swaps = ((F.col("after0") == 1) & (F.col("after1") == 0)).cast("int")
    upto = F.sum(swaps).over(Window.partitionBy("path").orderBy("start"))
    sets = F.when(F.col("after0") == F.col("after1"), F.pmod(F.col("after0") + upto, F.lit(2)))
    state = F.pmod(F.coalesce(F.last("_set", ignorenulls=True).over(earlier), F.lit(0))
                   + F.coalesce(F.sum(swaps).over(earlier), F.lit(0)), F.lit(2))
    known = facts.withColumn("_set", sets).withColumn("inside", state)
    begins = (F.col("inside") == 0) | F.col("began")
    return known.withColumn("owner", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(earlier)) \
        .filter("inside = 1").select("path", "start", "owner")


def _cutter(begun, step: int | None):
    """Task that cuts blocks into records; ``begun`` holds the blocks that begin inside a value."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = begun.value
        block, inside, owner, pending, first = None, False, -1, [], False

        def rows(path, owner, start, values, first) -> pa.RecordBatch:
            n = len(values)
            flags = np.zeros(n, bool)
            flags[:1] = first
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(np.full(n, owner), pa.int64()),
                 pa.array(np.full(n, start), pa.int64()), values, pa.array(flags)],
                names=["path", "owner", "start", "value", "first"])

        def tail() -> pa.RecordBatch:
            return rows(*block[:1], owner, block[1], pa.array([b"\n".join(pending)], pa.binary()),
                        first and owner == block[1])

        for path, start, value, quoted in _runs(batches):
            if block != (path, start):
                if pending:
                    yield tail()
                if start and (step is None or start % step):
                    raise ValueError("the blocks of the files changed between two readings; read again")
                block, pending = (path, start), []
                owner = owners.get(block, start)
                inside, first = block in owners, start == 0
            whole, at, pieces = np.ones(len(value), bool), 0, []
            for i in quoted:
                line = value[i].as_py()
                still = stays_open(line, inside)
                if inside and not still:
                    whole[at:i + 1] = False
                    pending += value.slice(at, i + 1 - at).to_pylist()
                    if owner != start:
                        yield tail()
                    else:
                        pieces.append((at, b"\n".join(pending)))
                    owner, pending = start, []
                elif still and not inside:
                    at = i
                inside = still
                if not inside:
                    at = i + 1
            if inside:
                whole[at:] = False
                pending += value.slice(at).to_pylist()
            lines = pc.filter(value, pa.array(whole))
            ends = pc.and_(pc.not_equal(lines, pa.scalar(b"", lines.type)),
                           pc.not_equal(lines, pa.scalar(b"\r", lines.type)))
            place = np.flatnonzero(whole)[ends.to_numpy(zero_copy_only=False)]
            lines = pc.filter(lines, ends)
            # The earliest record comes first, so that the header can be told.
            early = bool(pieces) and (not len(place) or pieces[0][0] < place[0])
            parts = ([pieces] if early else []) + [None] + ([pieces] if pieces and not early else [])
            for part in parts:
                found = lines if part is None else pa.array([p[1] for p in part], pa.binary())
                if len(found):
                    yield rows(path, -1, start, found.cast(pa.binary()), first)
                    first = False
        if pending:
            yield tail()

    return cut


def read_records(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, dict[str, bytes]]:
    """(path, value) per record after the header, and the header record of every file.

    Values are the record's bytes. Records end with a line feed, with or without
    carriage return; empty lines are none; files without a record have no header.
    One file's blocks are read by as many tasks. The tasks are told of blocks that
    begin inside a quoted value, at most one entry per block. A value whose quote is
    never closed reaches to the end of its file and must fit in a task.
    """
    lines = _lines(spark, paths)
    facts = hand_over(lines.mapInArrow(_facts, _FACTS), "blocks")
    step = facts.filter("start > 0").agg(F.min("start")).first()[0]
    heads = facts.filter("start = 0").select("path", "head", "after0").collect()
    if any(r["head"] is None and r["after0"] for r in heads):
        raise ValueError("a header record does not end within the first block of its file")
    begun = spark.sparkContext.broadcast({(r["path"], r["start"]): r["owner"] for r in _starts(facts).collect()})
    pieces = lines.mapInArrow(_cutter(begun, step), _PIECES)
    if begun.value:
        # Pieces of one record, in the order of their blocks.
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))),
                                        lambda p: p["value"].cast("string")), "\n")
        crossing = (lines.mapInArrow(_cutter(begun, step), _PIECES).filter("owner >= 0").groupBy("path", "owner")
                    .agg(text.cast("binary").alias("value"), F.max("first").alias("first")))
        whole = pieces.filter("owner < 0").select("path", "value", "first")
        pieces = whole.unionByName(crossing.select("path", "value", "first"))
    return (pieces.filter(~F.col("first")).select("path", "value"),
            {r["path"]: bytes(r["head"]) for r in heads if r["head"] is not None})
