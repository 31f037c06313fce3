"""Secrets in texts: known forms, and strings that pass for random.

Strings without a known form are judged by a battery of tests. The encoding is
inferred from the characters used; chi-squared uniformity over its alphabet, the
number of runs of character classes and the serial correlation of neighbouring
symbols each say how likely written text is to look that random. Runs of token
characters are cut at inner equals signs (NAME=value, a=b), and every part of
MIN_LENGTH or more that has a letter is tested, with or without digits. The combined
evidence of all candidates of the corpus goes through false-discovery control in
bands of length and families of form, because short strings are many and carry little evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import Slab, fields, slabs
from fiscora.llm.spans import SPANS_DDL, certain, count_kind, joined, span_lists
from fiscora.session import hand_over

KINDS = ("assign", "access", "hex", "random")
# The known forms.
_ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

MIN_LENGTH = 20             # of a string that is tested
BANDS = (20, 32, 64)        # lengths from which a band of its own begins
FAMILIES = 3                # of strings, with bands of their own
DISCOVERY_RATE = 1e-3
LEVEL_STEP, LEVELS = 0.05, 400      # evidence -log10(p), in steps

# Written text: share of neighbours of different class, their correlation, and how far
# its symbols are from uniform (chi-squared per symbol) in each encoding.
SWITCHES, CORRELATION = 0.12, 0.3
UNEVEN = {"hex": 0.5, "base26": 0.7, "base32": 1.0, "base36": 1.2, "base52": 1.4, "base64": 1.6}
CAMEL_SWITCHES = 0.35       # of names written in both cases without digits
_MARKS = b"+/-_"

_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_TOKEN = np.isin(np.arange(256), list(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_COLON = np.isin(np.arange(256), list(b":="))
_normal = NormalDist()


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` marked bytes; texts are set apart by unmarked ones."""
    turn = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    first, last = turn[::2], turn[1::2]
    long = last - first >= least
    return first[long], last[long]


def _cases(token: bytes) -> tuple[bool, bool, bool]:
    return (any(65 <= c <= 90 for c in token), any(97 <= c <= 122 for c in token),
            any(48 <= c <= 57 for c in token))


def _body(token: bytes) -> bytes:
    """The symbols that are tested: no padding; signs only where they are symbols, not where they part groups."""
    body = token.rstrip(b"=")
    return body if all(_cases(body)) else body.translate(None, _MARKS)


def infer_encoding(token: bytes) -> tuple[str, int] | None:
    """Encoding by the characters used, and the size of its alphabet; None if there is no letter.

    Signs belong to the alphabet of strings with digits and both cases. In all
    others (UUIDs, prefixed keys, words, paths) they part groups.
    """
    body = _body(token)
    upper, lower, digit = _cases(body)
    if not (upper or lower):
        return None
    if not digit:
        return ("base52", 52) if upper and lower else ("base26", 26)
    if upper and lower:
        return "base64", 64
    if all(c in b"0123456789abcdefABCDEF" for c in body):
        return "hex", 16
    if not lower and all(65 <= c <= 90 or 50 <= c <= 55 for c in body):
        return "base32", 32
    return "base36", 36


def family(token: bytes) -> int:
    """Strings that are judged together: with digits, with digits and parted by signs, or without digits.

    Words and slugs are many; they do not weigh on the limits of keys.
    """
    body = token.rstrip(b"=")
    if not _cases(body)[2]:
        return 2
    return int(len(_body(token)) < len(body))


def evidence(token: bytes) -> float | None:
    """-log10 of the probability that written text looks as random; None if not testable."""
    found = infer_encoding(token)
    if not found:
        return None
    encoding, k = found
    body = np.frombuffer(_body(token), np.uint8)
    n = len(body)
    if n < 3:
        return 0.0
    counts = np.bincount(body, minlength=256)
    expected = n / k
    chi = float(((counts[counts > 0] - expected) ** 2 / expected).sum() + expected * (k - np.count_nonzero(counts)))
    shift = n * UNEVEN[encoding]
    uniform = (chi - (k - 1) - shift) / math.sqrt(2 * (k - 1) + 4 * shift)
    group = np.select([body < 58, body < 91, body < 123], [0, 1, 2], 3)
    changes = np.count_nonzero(group[1:] != group[:-1])
    rate = CAMEL_SWITCHES if encoding == "base52" else SWITCHES
    spread = math.sqrt((n - 1) * rate * (1 - rate))
    switching = ((n - 1) * rate - changes + 0.5) / spread
    value = body.astype(float)
    a, b = value[:-1] - value[:-1].mean(), value[1:] - value[1:].mean()
    scale = math.sqrt(float((a * a).sum() * (b * b).sum()))
    serial = (abs(float((a * b).sum()) / scale) if scale else 1.0)
    drift = (serial - CORRELATION) * math.sqrt(n)
    # Weighted sum of the three scores; each is low where text would rarely be.
    # Letters of one case are one class: their runs say nothing.
    z = ((2 * uniform + drift) / math.sqrt(5) if encoding == "base26"
         else (2 * uniform + 2 * switching + drift) / 3)
    p = max(_normal.cdf(z), 10.0 ** -(LEVEL_STEP * LEVELS))
    return -math.log10(p)


def _parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of token characters, cut at inner equals signs; those at the end of a run are padding."""
    first, last = _runs(_TOKEN[data], MIN_LENGTH)
    solid_first, solid_last = _runs(_TOKEN[data] & (data != 61), 1)
    run = np.searchsorted(first, solid_first, "right") - 1
    inside = (run >= 0) & (solid_last <= last[run]) if len(first) else np.zeros(len(run), bool)
    begin, end, run = solid_first[inside], solid_last[inside], run[inside]
    final = np.append(run[1:] != run[:-1], True)[:len(run)]
    end = np.where(final, last[run], end)
    long = end - begin >= MIN_LENGTH
    return begin[long], end[long]


def _spans(slab: Slab) -> list[list[tuple]]:
    """Spans of every text of a slab: known forms, then tested strings with band and level."""
    data, raw = slab.data, slab.raw
    found: list[list[tuple]] = [[] for _ in range(len(slab))]
    hits: list[tuple[int, int, int]] = []
    colon = np.flatnonzero(_COLON[data])
    for i in np.unique(np.searchsorted(slab.end, colon)):
        for m in _ASSIGN.finditer(raw, slab.start[i], slab.end[i]):
            if len(m[1]) >= ASSIGN_LENGTH:
                hits.append((m.start(), 0, m.end()))
    hits += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LENGTH]
    hits += [(s, 2, e) for s, e in zip(*(x.tolist() for x in _runs(_HEX[data], HEX_LENGTH)))]
    first, last = _parts(data)
    if not hits and not len(first):
        return found
    hits.sort()
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = np.array([h[0] for h in hits], np.int64)
    # Furthest end of any hit so far: no later hit reaches back.
    reach = np.maximum.accumulate(np.array([h[2] for h in hits], np.int64)) if hits else starts

    def add(s: int, kind: int, e: int, band, level) -> None:
        i = int(np.searchsorted(slab.end, s))
        base = point[slab.start[i]]
        found[i].append((int(point[s] - base), kind, int(point[e] - base), KINDS[kind], band, level))

    for s, kind, e in hits:
        add(s, kind, e, None, None)
    for s, e in zip(first.tolist(), last.tolist()):
        before = int(np.searchsorted(starts, e))
        if before and reach[before - 1] > s:
            continue                        # it overlaps a known form
        level = evidence(raw[s:e])
        if level is not None:
            band = family(raw[s:e]) * len(BANDS) + sum(e - s >= b for b in BANDS) - 1
            add(s, 3, e, band, level)
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for slab in slabs(batch) for x in _spans(slab)]
        if found:
            yield pa.RecordBatch.from_arrays(
                [fields(batch, "doc_id"), span_lists(found)], names=["doc_id", "spans"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, spans) with all known forms, and tested strings with their evidence."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(_scan, f"doc_id long, spans {SPANS_DDL}")


def limits(found: DataFrame, rate: float = DISCOVERY_RATE) -> list[float]:
    """Evidence from which a string of each band counts (Benjamini-Hochberg over the corpus).

    Each family of strings has bands of its own. Only counts per band and step of
    evidence are gathered, at most 9 x (LEVELS + 1) numbers. A band in which nothing is significant gets infinity.
    """
    step = F.least(F.floor(F.col("s.level") / LEVEL_STEP), F.lit(LEVELS)).cast("int")
    rows = (found.select(F.explode("spans").alias("s")).filter("s.band IS NOT NULL")
            .groupBy(F.col("s.band").alias("band"), step.alias("step")).count().collect())
    out = []
    for band in range(FAMILIES * len(BANDS)):
        counts = np.zeros(LEVELS + 1, np.int64)
        for r in rows:
            if r.band == band:
                counts[r.step] += r["count"]
        at_least = counts[::-1].cumsum()[::-1]
        # All strings of a step are taken at its weakest evidence, so none is judged too well.
        p = 10.0 ** (-LEVEL_STEP * np.arange(LEVELS + 1))
        good = np.flatnonzero((counts > 0) & (p <= rate * at_least / max(at_least[0], 1)))
        out.append(float(good[0] * LEVEL_STEP) if len(good) else math.inf)
    return out


def accepted(spans, levels: list[float]):
    """Known forms and the strings whose evidence reaches their band's limit (Column)."""
    def keep(s):
        ok = s["band"].isNull()
        for band, level in enumerate(levels):
            ok = ok | ((s["band"] == band) & (F.floor(s["level"] / LEVEL_STEP) * LEVEL_STEP >= level - 1e-9))
        return ok
    return F.filter(spans, keep)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = DISCOVERY_RATE) -> DataFrame:
    """Rows (doc_id, spans) of what counts as a secret.

    Offsets are code points, ends exclusive. NULL and empty texts have none;
    repeated rows are scanned alike (their strings count once each for the
    false-discovery control); other columns are not read.
    """
    found = hand_over(find(docs, key, text), "secrets")
    return found.withColumn("spans", accepted(F.col("spans"), limits(found, rate)))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = DISCOVERY_RATE,
           mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; all columns stay.

    The scan runs twice, once for the limits and once where the text is, so no
    text is shuffled. Overlapping secrets become one mask. NULL stays NULL.
    """
    levels = limits(find(docs, key, text), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for slab in slabs(batch, text):
                for i, spans in enumerate(_spans(slab)):
                    spans = [s for s in spans if s[4] is None
                             or math.floor(s[5] / LEVEL_STEP) * LEVEL_STEP >= levels[s[4]] - 1e-9]
                    source = slab.raw[slab.start[i]:slab.end[i]].decode()
                    texts.append(_masked(source, spans, mask) if spans else source)
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            new = pa.array([t if column[i].is_valid else None for i, t in enumerate(texts)], column.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple], mask: str) -> str:
    parts, at = [], 0
    for start, _, stop, *_ in sorted(spans):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = certain(F.col("spans"))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count_kind(base, k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
