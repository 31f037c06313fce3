"""Personal data in texts, also in disguise, at exact source offsets.

Plain identifiers are found in the text as it is. A chain of transducers then
rewrites the text: homoglyphs and full-width forms become ASCII, invisible
characters vanish, runs of spelled digits become digits, and at/dot disguises
become signs. Every rewritten character keeps the source span it stands for, so
an identifier found in the rewritten text maps back to source characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import LOWER, Slab, fields, slabs
from fiscora.llm.spans import SPANS_DDL, certain, count_kind, joined, span_lists

KINDS = ("email", "ip", "card", "phone")
DIGIT_RUN = 3               # spelled digits in a row that are read as a number

# The patterns of plain identifiers.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first one only: later starts have the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones, in the order of the alphabet.
_LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "а": "a", "с": "c", "ԁ": "d", "е": "e",
    "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w",
    "х": "x", "у": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "․": ".", "‐": "-", "‑": "-", "–": "-",
}
# Full-width forms stand at a fixed distance from ASCII.
GLYPHS = {ord(k): v for k, v in _LOOKALIKES.items()} | {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], "")
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
               "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(
    rf"(?<![A-Za-z])(?:(?ai:plus)\s+)?(?:(?ai:{_WORD})(?![A-Za-z])[\s,;/-]*"
    rf"(?:(?ai:dot|point)\s+(?=(?ai:{_WORD})))?){{{DIGIT_RUN},}}")
_SPELLED_PART = re.compile(rf"((?ai:plus))|((?ai:{_WORD}))|((?ai:dot|point))|[\s,;/-]+")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s*{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}\s*|\s+dot\s+)(?=[A-Za-z0-9])", re.I)
_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s*{_OPEN}\s*(?:at|@)\s*{_CLOSE}\s*(?=[A-Za-z0-9])", re.I)


@lru_cache
def _bare_at(mark: str) -> re.Pattern:
    """Without brackets "at" is a common word: the domain behind it must have a marked dot."""
    return re.compile(rf"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+{mark})", re.I)


# First bytes of UTF-8 sequences that can hold a disguised character.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xCD, 0xD5), 0xE2, 0xEF]] = True
_ODD_NEXT = np.zeros(256, bool)
_ODD_NEXT[0xAD] = True      # after 0xC2: the soft hyphen
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# A bracketed sign or word of _DOT and _AT in UTF-8, with all that \s is between; in \s are also these:
_BLANK = rb"(?:[\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)*+"
_BRACKETED = re.compile(_OPEN.encode() + _BLANK + rb"(?:at|dot|[@.])" + _BLANK + _CLOSE.encode(), re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, stop) of plain identifiers, leftmost and non-overlapping per kind."""
    found = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, 0, free))
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return found


class Rewritten:
    """A text under rewriting; character i stands for source characters begin[i] to end[i]."""

    def __init__(self, text: str):
        self.text = text
        self.begin = np.arange(len(text))
        self.end = self.begin + 1
        self.fresh = np.zeros(len(text), bool)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans by at most one character each, in order."""
        if not edits:
            return
        text, rows, at = [], [], 0
        for start, stop, char in edits:
            if start > at:
                text.append(self.text[at:start])
                rows.append((self.begin[at:start], self.end[at:start], self.fresh[at:start]))
            if char:
                text.append(char)
                rows.append(([self.begin[start]], [self.end[stop - 1]], [True]))
            at = stop
        text.append(self.text[at:])
        rows.append((self.begin[at:], self.end[at:], self.fresh[at:]))
        self.text = "".join(text)
        self.begin, self.end = (np.concatenate([np.asarray(r[k], np.int64) for r in rows]) for k in (0, 1))
        self.fresh = np.concatenate([np.asarray(r[2], bool) for r in rows])

    def substitute(self, pattern: re.Pattern, char: str) -> None:
        self.apply([(m.start(), m.end(), char) for m in pattern.finditer(self.text)])


def normalise(text: str) -> Rewritten:
    """The transducers in order: glyphs, spelled digits, dots, then at-signs."""
    out = Rewritten(text)
    table_ = GLYPHS | INVISIBLE
    out.apply([(i, i + 1, table_[ord(c)]) for i, c in enumerate(text) if ord(c) in table_])
    edits = []
    for m in _SPELLED.finditer(out.text):
        last = max(p.end() for p in _SPELLED_PART.finditer(m[0]) if p[2]) + m.start()
        for p in _SPELLED_PART.finditer(out.text, m.start(), last):
            sign = "+" if p[1] else "." if p[3] else ""
            edits.append((p.start(), p.end(), DIGIT_WORDS[p[2].lower()] if p[2] else sign))
    out.apply(edits)
    # A dot read from a disguise is marked, by a character that the text does not have,
    # until the at-signs before it are judged.
    mark = next(c for c in map(chr, range(0xF0000, 0x110000)) if c not in out.text)
    out.substitute(_DOT, mark)
    out.substitute(_AT, "@")
    out.substitute(_bare_at(mark), "@")
    out.text = out.text.replace(mark, ".")
    return out


def disguised(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of identifiers that appear only after rewriting, apart from known ones of their kind."""
    out = normalise(text)
    fresh = np.concatenate([[0], np.cumsum(out.fresh)])
    gaps = np.concatenate([[0, 0], np.cumsum(out.begin[1:] != out.end[:-1])]) if len(out.text) else fresh
    starts, kinds, stops = np.array(known, np.int64).reshape(-1, 3).T
    found = []
    for start, kind, stop in plain(out.text):
        if fresh[stop] == fresh[start] and gaps[stop] == gaps[start + 1]:
            continue                        # nothing in it was rewritten
        a, z = int(out.begin[start]), int(out.end[stop - 1])
        if not np.any((starts < z) & (stops > a) & (kinds == kind)):
            found.append((a, kind, z))
    return found


def _suspects(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Which texts can hold a plain identifier, and which a disguise.

    Every pattern of ``normalise`` needs a disguised character, three spelled digits,
    the word "dot" or a bracketed sign, so no text without one of these is changed by it.
    """
    data = slab.data

    def any_(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[slab.end] > total[slab.start]

    sign = any_((data == 64) | (data == 43) | ((data >= 48) & (data <= 57)))
    odd = _ODD[data]
    soft = data == 0xC2
    odd[:-1] &= ~soft[:-1] | _ODD_NEXT[data[1:]]
    strange = any_(odd)
    # Runs of letters between anything else: "dot", and spelled digits.
    solid = _LETTER[data]
    turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    first, last = turn[::2], turn[1::2]
    size = last - first
    short = (size >= 3) & (size <= 5)
    first, size = first[short], size[short]
    low = LOWER[data]
    code = np.zeros(len(first), np.int64)
    for k in range(5):
        code = (code << 8) | np.where(k < size, low[np.minimum(first + k, len(data) - 1)], 0)
    known = np.array([int.from_bytes(w.encode().ljust(5, b"\0"), "big") for w in DIGIT_WORDS])
    dot = int.from_bytes(b"dot\0\0", "big")
    text_of = np.searchsorted(slab.end, first)
    digit = np.bincount(text_of[np.isin(code, known)], minlength=len(slab)) >= DIGIT_RUN
    dotted = np.bincount(text_of[code == dot], minlength=len(slab)) > 0
    bracketed = np.zeros(len(slab), bool)
    for m in _BRACKETED.finditer(slab.raw):
        # One that spans two texts is in neither; it counts for the later one.
        bracketed[np.searchsorted(slab.end, m.end() - 1)] = True
    return sign, strange | digit | dotted | bracketed


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for slab in slabs(batch):
            sign, odd = _suspects(slab)
            for i in range(len(slab)):
                if not (sign[i] or odd[i]):
                    found.append([])
                    continue
                text = slab.raw[slab.start[i]:slab.end[i]].decode()
                base = plain(text) if sign[i] else []
                more = disguised(text, base) if odd[i] else []
                found.append([(s, k, e, KINDS[k], None, None) for s, k, e in base]
                             + [(s, k, e, KINDS[k], 0, None) for s, k, e in more])
        if found:
            yield pa.RecordBatch.from_arrays(
                [fields(batch, "doc_id"), span_lists(found)], names=["doc_id", "spans"])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, spans): plain spans have no band, those found behind a disguise band 0.

    Offsets are code points of the source, ends exclusive. NULL and empty texts
    have no spans; every row is scanned, whole; other columns are not read.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(_scan, f"doc_id long, spans {SPANS_DDL}")


@query("op4_personal_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = certain(F.col("spans"))
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count_kind(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
