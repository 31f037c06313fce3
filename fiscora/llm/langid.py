"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of order 0 to 3 with escape
probabilities (method C). The probability of a byte after a context is
its count over (seen bytes + distinct bytes); an escape moves to the context one
byte shorter, renormalised over bytes the longer one has not seen, and order -1
is uniform, so the probabilities of all bytes sum to one. Statistics are frozen
before scoring, so a code length is a sum of table entries: fitting works out the
entry of every byte string that any language has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import Slab, fields, record, slabs

ORDER = 3
DOCS_PER_LANGUAGE = 400     # bound of the sample that the classifier is fitted on
BYTES_PER_LANGUAGE = 8 << 20    # and its bytes, if the texts of a language are long
LANGUAGE_BLOCK = 8          # languages whose trees share tables: an entry costs a number for each
UNDETERMINED = "und"
SLAB_BYTES = 256 << 10

_LETTER = r"\p{L}"


def _grams(slab: Slab, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its ``order`` predecessors as one number, and the text it belongs to.

    A text is preceded by newlines, as many as the order.
    """
    size = slab.end - slab.start
    owner = np.repeat(np.arange(len(slab)), size)
    at = np.arange(len(owner)) + (slab.start - (np.cumsum(size) - size))[owner]
    since = at - slab.start[owner]
    value = np.zeros(len(at), np.uint32)
    for k in range(order, -1, -1):
        byte = slab.data[np.maximum(at - k, 0)].astype(np.uint32)
        value = (value << np.uint32(8)) | np.where(since >= k, byte, 10).astype(np.uint32)
    return value, owner


class Trees:
    """Frozen context trees of several languages, as tables of code lengths in bits."""

    def __init__(self, languages: list[str], grams: np.ndarray, language: np.ndarray, counts: np.ndarray):
        """``grams``: strings of ORDER + 1 bytes as numbers, with their count in a language."""
        self.languages = languages
        n = len(languages)
        # Order -1: every byte alike.
        self.code = [np.full((1, n), 8.0)]
        self.key = [np.zeros(1, np.uint32)]
        self.escape, self.context = [], []
        for order in range(ORDER + 1):
            # Counts of (order + 1)-byte strings: their last bytes.
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            key, back = np.unique(grams & mask, return_inverse=True)
            count = np.zeros((len(key), n))
            np.add.at(count, (back, language), counts)
            context, of = np.unique(key >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            lower = self._lookup(order - 1, key)
            weight = total + kinds
            seen = count > 0
            covered = np.zeros((len(context), n))
            np.add.at(covered, of, np.where(seen, 2.0 ** -lower, 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                # Where all bytes are seen nothing can escape; a context not seen costs nothing.
                open_ = np.maximum(1 - covered, 1e-12)
                escape = np.where(kinds > 0, np.log2(weight / kinds) + np.log2(open_), 0.0)
                direct = np.log2(weight[of] / np.maximum(count, 1e-300))
            self.key.append(key)
            self.context.append(context)
            self.escape.append(escape)
            self.code.append(np.where(seen, direct, escape[of] + lower))
        self._slots()

    def _slots(self) -> None:
        """Direct table of the longest strings; those that share a slot are searched for."""
        key = self.key[-1]
        bits = max(int(np.ceil(np.log2(max(len(key), 1)))) + 2, 8)
        self.shift = np.uint32(32 - min(bits, 24))
        self.slot_at = np.full(1 << min(bits, 24), -1, np.int32)
        self.slot_at[self._slot(key)] = np.arange(len(key), dtype=np.int32)
        self.code32 = self.code[-1].astype(np.float32)

    def __getstate__(self) -> dict:
        """The direct table is made anew where the trees arrive; it need not travel."""
        return {k: v for k, v in self.__dict__.items() if k not in ("slot_at", "shift", "code32")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._slots()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(2654435761)) >> self.shift

    def _lookup(self, order: int, gram: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each string after at most ``order`` bytes."""
        if order < 0:
            return np.broadcast_to(self.code[0], (len(gram), len(self.languages)))
        key = gram & np.uint32((1 << 8 * (order + 1)) - 1)
        known = self.key[order + 1]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        out = np.zeros((len(gram), len(self.languages)))
        out[hit] = self.code[order + 1][at[hit]]
        miss = ~hit
        if miss.any():
            prefix = key[miss] >> np.uint32(8)
            contexts = self.context[order]
            c = np.minimum(np.searchsorted(contexts, prefix), len(contexts) - 1)
            escape = np.where((contexts[c] == prefix)[:, None], self.escape[order][c], 0.0)
            out[miss] = escape + self._lookup(order - 1, gram[miss])
        return out

    def bits(self, slab: Slab) -> np.ndarray:
        """Code length of every text of a slab in every language."""
        total = np.zeros((len(slab), len(self.languages)))
        if not len(self.key[-1]):
            return total + 8.0 * (slab.end - slab.start)[:, None]     # order -1
        gram, owner = _grams(slab, ORDER)
        at = self.slot_at[self._slot(gram)]
        hit = (at >= 0) & (self.key[-1][at] == gram)
        # Sums over runs of one text; float64 sums of float32 entries.
        codes = self.code32[np.maximum(at, 0)]
        codes[~hit] = 0
        full = np.flatnonzero(slab.end > slab.start)
        size = (slab.end - slab.start)[full]
        if len(full):
            total[full] = np.add.reduceat(codes, np.cumsum(size) - size, axis=0, dtype=np.float64)
        if not hit.all():
            slow = self._lookup(ORDER, gram[~hit])
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(owner[~hit], weights=slow[:, k], minlength=len(slab))
        return total


class Forest:
    """Trees of any number of languages, in blocks: tables grow with the languages, not with their square."""

    def __init__(self, parts: list[Trees]):
        self.parts = parts
        self.languages = [name for p in parts for name in p.languages]

    def bits(self, slab: Slab) -> np.ndarray:
        """Code length of every text of a slab in every language."""
        return np.concatenate([p.bits(slab) for p in self.parts], axis=1)


_GRAM = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(fields(batch, "lang").to_pylist(), object)
        for slab in slabs(batch, limit=SLAB_BYTES):
            gram, owner = _grams(slab, ORDER)
            own = langs[slab.rows][owner]
            for lang in sorted(set(own)):
                key, n = np.unique(gram[own == lang], return_counts=True)
                yield record(_GRAM, [lang] * len(key), key.astype(np.int64), n)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = DOCS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> Forest:
    """Trees from a bounded sample: per language about ``per_language`` texts, drawn by key hash.

    Where these would hold more than ``most_bytes`` on average, fewer are drawn. Sampled
    texts count whole, and every language is learned. Rows without text or language are
    left out; a NULL key is a key like any other.
    """
    rows = labelled.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                           F.col(lang).cast("string").alias("lang")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    common = {r.lang: min(1.0, per_language / r.n, most_bytes / max(r.size, 1)) for r in rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if not common:
        return Forest([])
    # Per language the share of the hash range that holds the wanted number: nothing is sorted.
    limits = [(name, min(-(1 << 63) + int((1 << 64) * share), (1 << 63) - 1)) for name, share in common.items()]
    limits = labelled.sparkSession.createDataFrame(limits, "_lang string, _most long")
    sample = rows.join(F.broadcast(limits), F.col("lang") == F.col("_lang")).filter(
        F.xxhash64("doc_id", "lang") <= F.col("_most")).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toArrow()
    languages = sorted(common)
    index = {name: i for i, name in enumerate(languages)}
    language = np.array([index[x] for x in counts.column("lang").to_pylist()], np.int64)
    gram, n = counts.column("gram").to_numpy().astype(np.uint32), counts.column("n").to_numpy().astype(float)
    parts = []
    for at in range(0, len(languages), LANGUAGE_BLOCK):
        own = (language >= at) & (language < at + LANGUAGE_BLOCK)
        parts.append(Trees(languages[at:at + LANGUAGE_BLOCK], gram[own], language[own] - at, n[own]))
    return Forest(parts)


def _guess(batches: Iterator[pa.RecordBatch], trees: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = fields(batch, "has_letter").to_numpy(zero_copy_only=False)
        for slab in slabs(batch, limit=SLAB_BYTES):
            n = len(slab)
            name = np.full(n, UNDETERMINED, object)
            score, rate = np.zeros(n), np.zeros(n)
            if trees.languages:
                bits = trees.bits(slab)
                best = bits.argmin(1)
                least = bits.min(1)
                sure = letters[slab.rows].astype(bool)
                share = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
                name = np.where(sure, np.array(trees.languages, object)[best], UNDETERMINED)
                score = np.where(sure, share, 0.0)
                rate = least / np.maximum(slab.end - slab.start, 1)
            take = pa.array(slab.rows)
            yield pa.RecordBatch.from_arrays([
                *[c.take(take) for k, c in enumerate(batch.columns)
                  if batch.schema.names[k] not in ("text", "has_letter")],
                pa.array(name, pa.string()), pa.array(score), pa.array(rate)],
                names=[*[c for c in batch.schema.names if c not in ("text", "has_letter")],
                       "lang_pred", "score", "bits_per_byte"])


def predict(docs: DataFrame, trees: Forest, text: str = "text") -> DataFrame:
    """Add lang_pred, score and bits_per_byte to the other columns of ``docs`` (not ``text``).

    The language with the shortest code wins, the first in name order at a tie;
    score is its share of the languages' probabilities. ``und`` with score 0 if
    the text is NULL or has no letter, or if nothing was learned. Columns named like an
    added one are replaced; an empty table stays empty. A task holds a slab of texts, or,
    of a longer one, some 30 bytes per byte and language of a block.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)
    others = [f for f in docs.schema.fields
              if f.name not in (text, "text", "has_letter", "lang_pred", "score", "bits_per_byte")]
    letter = F.coalesce(F.col(text).cast("string").rlike(_LETTER), F.lit(False))
    frame = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(text).cast("string").alias("text"),
                        letter.alias("has_letter"))
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others],
                     "lang_pred string", "score double", "bits_per_byte double"])
    return frame.mapInArrow(lambda it: _guess(it, shared.value), ddl)


def identify(docs: DataFrame, learn_from: Column | None = None, key: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """Predict the language of every text, learning from rows where ``learn_from`` holds.

    Returns key, lang_pred, score (0 to 1) and bits_per_byte. Labels, sources and
    keys never enter a prediction. Repeated rows are predicted alike.
    """
    source = docs if learn_from is None else docs.filter(learn_from)
    trees = fit(source, key, text, lang)
    return predict(docs.select(F.col(key).alias(key), F.col(text).alias("text")), trees)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    least: float = 0.5) -> DataFrame:
    """``docs`` without texts that have no letter, or no language with a share of ``least``.

    Learns from the labelled rows of ``docs``. All columns stay. Where nothing
    can be learned, only texts without a letter (and NULLs) go.
    """
    trees = fit(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    flag = "_has_letter"
    while flag in docs.columns:
        flag += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keep = fields(batch, flag).to_numpy(zero_copy_only=False).astype(bool)
            if known.languages:
                for slab in slabs(batch, text, SLAB_BYTES):
                    bits = known.bits(slab)
                    share = 1 / np.exp2(np.minimum(bits.min(1)[:, None] - bits, 0)).sum(1)
                    keep[slab.rows] &= share >= least
            yield batch.drop_columns([flag]).filter(pa.array(keep))

    letter = F.coalesce(F.col(f"`{text}`").cast("string").rlike(_LETTER), F.lit(False))
    return docs.withColumn(flag, letter).mapInArrow(run, docs.schema)


@query("op8_ppm_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")
