"""Fill-in-middle: texts are cut in three and rearranged, so that a model learns to write the middle.

Cuts fall between tokens and are wanted both in bytes (to cut the buffer) and in
code points (to report). ASCII needs no conversion, so an index holds only the
exceptions: the places of multibyte characters and the bytes they have in excess
of one. A cut is converted by a binary search among the exceptions before it;
everything between them is arithmetic.

A token is a word with the white space before it; white space at the end of a
text is a token of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import Slab, fields, slabs, starts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50                   # percent of texts that are rearranged
SPM_RATE = 80               # percent of these with the suffix first

_DRAWS = ("h1", "h2", "h3", "h4")
_ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Where characters of several bytes are in a buffer, and by how many bytes each exceeds one."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(more)])
        self.point = self.at - self.excess[:-1]

    def points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte place that begins a character."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.excess[np.searchsorted(self.point, point)]


def cuts(slab: Slab, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every text, and the byte places of its two cuts."""
    _, last, owner = slab.words()
    at = starts_of(owner, len(slab))
    words = np.diff(at)
    # What follows the last word is white space.
    end = np.where(words > 0, last[np.maximum(at[1:] - 1, 0)] if len(last) else 0, slab.start)
    n = words + (slab.end > end)
    places = []
    for units in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        inner = last[np.minimum(at[:-1] + np.maximum(units, 1), len(last)) - 1] if len(last) else slab.end
        place = np.where(units == 0, slab.start, np.where(units <= words, inner, slab.end))
        places.append(place)
    return n, *places


def _marked(slab: Slab) -> np.ndarray:
    """Texts that hold a marker already."""
    found = np.zeros(len(slab), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        mark = mark.encode()
        at = slab.raw.find(mark)
        while at >= 0:
            i = int(np.searchsorted(slab.end, at))
            found[i] = True
            at = slab.raw.find(mark, int(slab.end[i]))
    return found


def _rearrange(batches: Iterator[pa.RecordBatch], text: str, draws: list[str], rate: int,
               spm_rate: int, drop: set[str]) -> Iterator[pa.RecordBatch]:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        h = [fields(batch, c).to_numpy(zero_copy_only=False) for c in draws]
        for slab in slabs(batch, text):
            h1, h2, h3, h4 = (x[slab.rows] for x in h)
            n, one, two = cuts(slab, h1, h2)
            plain = (slab.start == slab.end) | _marked(slab) | (h3 % 100 >= rate)
            spm = h4 % 100 < spm_rate
            index = Exceptions(slab.data)
            begin, first, second = (index.points(x) for x in (slab.start, one, two))
            output = []
            for i, (a, b, c, z) in enumerate(zip(slab.start.tolist(), one.tolist(), two.tolist(),
                                                 slab.end.tolist())):
                if plain[i]:
                    output.append(slab.raw[a:z])
                elif spm[i]:
                    output.append(b"".join((s, slab.raw[c:z], p, slab.raw[a:b], m, slab.raw[b:c])))
                else:
                    output.append(b"".join((p, slab.raw[a:b], s, slab.raw[c:z], m, slab.raw[b:c])))
            take = pa.array(slab.rows)
            kept = [(name, c.take(take)) for name, c in zip(batch.schema.names, batch.columns)
                    if name not in drop]
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in kept], pa.array(n, pa.int64()),
                 pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
                 pa.array(first - begin, pa.int64(), mask=plain),
                 pa.array(second - first, pa.int64(), mask=plain),
                 pa.array(output, pa.binary()).view(pa.string())],
                names=[*[name for name, _ in kept], "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE,
              spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` without ``text``, with n (tokens), form, prefix_chars, middle_chars and output.

    The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``:
    the text itself, for texts that are empty or NULL, hold a marker, or are not drawn.
    Lengths count code points and are NULL for plain texts. Draws come from the SHA-256
    of seed and key, so repeated rows are cut alike, and a NULL key draws as an empty one.
    Input columns named like an added one are replaced. An empty table gives no rows. A
    task holds a slab of texts, or about six times a single text that is longer.
    """
    added = [c.split()[0] for c in _ADDED.split(", ")]
    others = [f for f in docs.schema.fields if f.name != text and f.name not in added]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    taken = {f.name for f in others} | {text}
    draws, hidden = [], []
    for k, name in enumerate(_DRAWS):
        while name in taken:
            name += "_"
        hidden.append(name)
        draws.append(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name))
    frame = docs.select(*[F.col(f"`{f.name}`") for f in others],
                        F.col(f"`{text}`").cast("string").alias(text), *draws)
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], _ADDED])
    drop = {text, *hidden}
    return frame.mapInArrow(lambda it: _rearrange(it, text, hidden, rate, spm_rate, drop), ddl)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of that form was made.

    A rearranged text holds no marker itself, and no marker can arise where a piece
    meets one, so the first two markers found are the inserted ones.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    middle = F.substring_index(body, MIDDLE, -1)
    rest = F.substring_index(body, MIDDLE, 1)

    def joined(mark: str, prefix_first: bool) -> Column:
        one, two = F.substring_index(rest, mark, 1), F.substring_index(rest, mark, -1)
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(form == "psm", joined(SUFFIX, True)).when(
        form == "spm", joined(PREFIX, False)).otherwise(output)


SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS p,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


@query("op13_fill_in_middle", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
