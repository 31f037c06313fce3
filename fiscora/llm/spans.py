"""Spans found in texts: (start, rank of the kind, stop, kind, level), offsets in code points.

``level`` is NULL for spans that are certain; others count if their level
reaches a limit fixed later over the whole corpus.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()),
                  ("kind", pa.string()), ("band", pa.int32()), ("level", pa.float64())])
SPANS_DDL = "array<struct<start: long, rank: int, stop: long, kind: string, band: int, level: double>>"


def span_lists(spans: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("start", "rank", "stop", "kind", "band", "level"), s)) for s in x]
                     for x in spans], pa.list_(SPAN))


def certain(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["band"].isNull())


def joined(spans: Column) -> Column:
    """kind:start:stop by start, then rank of the kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["stop"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
