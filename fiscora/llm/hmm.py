"""Hidden Markov language model over words.

Latent states emit word classes; a class emits its words by their corpus counts:
P(word | state) = P(class | state) P(word | class). The most frequent words are
classes of their own, the others are classed by ending and length, so the
tables that Baum-Welch trains have a fixed size however many words there are.

Word counts cover all training texts. Words frequent enough to fit a fixed
table are looked up in the task; the counts of the others come by a join.
Baum-Welch runs over all training texts, cut into pieces of PIECE tokens; each
task sums its expected counts and the sums are added in two steps. Scoring runs
the scaled forward recursion over whole texts and is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import LOWER, fields, mix, record, slabs, starts_of
from fiscora.session import hand_over

STATES = 8
OWN = 1023                  # words with a class of their own; class 0 is the end of a text
ENDINGS = 768               # classes of the other words
CLASSES = 1 + OWN + ENDINGS
LOOKUP_WORDS = 1 << 20      # most words in the broadcast table, 16 bytes each
PIECE = 128
FAN_IN = 16                 # rows of sums that one task adds up
ITERATIONS = 5
UNIT_WORDS = 400_000
SEED = 11
END_HASH = np.uint64(0xE0D0E0D0E0D0E0D1)
ADD = 0.5                   # added to every count


def _ending_class(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Class of a word by its last two bytes and its length."""
    size = np.minimum(last - first, 12).astype(np.uint64)
    one = LOWER[data[last - 1]].astype(np.uint64)
    two = np.where(last - first > 1, LOWER[data[last - 2]], 0).astype(np.uint64)
    h = mix(((one << np.uint64(8) | two) << np.uint64(8)) | size)
    return (1 + OWN + h % np.uint64(ENDINGS)).astype(np.int32)


_COUNT = pa.schema([("word", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, kinds, counts, held, texts = [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        word, at, back = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
        return record(_COUNT, word.view(np.int64), np.concatenate(kinds)[at], n)

    for batch in batches:
        for slab in slabs(batch):
            texts += len(slab)
            first, last, _ = slab.words()
            if not len(first):
                continue
            word, at, n = np.unique(slab.hashes(first, last, True), return_index=True, return_counts=True)
            words.append(word)
            kinds.append(_ending_class(slab.data, first[at], last[at]))
            counts.append(n)
            held += len(word)
            if held >= UNIT_WORDS:
                yield flush()
                words, kinds, counts, held = [], [], [], 0
    if words:
        yield flush()
    if texts:
        yield record(_COUNT, [int(END_HASH.view(np.int64))], [0], [texts])


class Lookup:
    """Counts of frequent words and the class of each, with the constants of every class."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: np.ndarray,
                 kind_log: np.ndarray, end_count: int):
        order = np.argsort(words)
        self.words, self.counts, self.own = words[order], counts[order], own[order]
        self.kind_log, self.end_count = kind_log, end_count

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is in the table, its count and its own class (or 0)."""
        if not len(self.words):
            nothing = np.zeros(len(word), np.int64)
            return nothing.astype(bool), nothing, nothing
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[at] == word
        return known, np.where(known, self.counts[at], 0), np.where(known, self.own[at], 0)


_SEQUENCE = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("log_counts", pa.float64()), ("log_inside", pa.float64()), ("kinds", pa.binary()),
    ("rare", pa.list_(pa.int64()))])
_SEQUENCE_DDL = ("doc_id long, held_out boolean, n_tokens long, known long, log_counts double, "
                 "log_inside double, kinds binary, rare array<long>")


def _sequences(batches: Iterator[pa.RecordBatch], lookup: Lookup) -> Iterator[pa.RecordBatch]:
    """Class sequence of every text, sums over its frequent words, and its other words.

    log_counts sums log10(count + ADD) over frequent words and the end;
    log_inside sums log10 P(word | class), leaving out the counts of other words.
    """
    end_log = math.log10(lookup.end_count + ADD)
    for batch in batches:
        for slab in slabs(batch):
            n = len(slab)
            first, last, owner = slab.words()
            word, at, back = np.unique(slab.hashes(first, last, True), return_index=True, return_inverse=True)
            frequent, count, own = lookup.find(word)
            ending = _ending_class(slab.data, first[at], last[at])
            kind = np.where(own > 0, own, ending)
            log_count = np.where(frequent, np.log10(count + ADD), 0.0)
            inside = np.where(own > 0, 0.0, log_count - lookup.kind_log[kind])
            edge = starts_of(owner, n)
            tokens = np.diff(edge) + 1

            def total(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=values[back], minlength=n)

            # Each sequence is followed by the end, class 0.
            out = np.zeros(len(word[back]) + n, np.uint16)
            out[np.arange(len(back)) + owner] = kind[back]
            raw = out.tobytes()
            cut = 2 * (edge + np.arange(n + 1))
            other = ~frequent[back]
            rare = word[back][other].view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(starts_of(owner[other], n), pa.int32()), pa.array(rare, pa.int64()))
            take = pa.array(slab.rows)
            yield record(
                _SEQUENCE, fields(batch, "doc_id").take(take), fields(batch, "held_out").take(take), tokens,
                total(frequent.astype(float)).astype(np.int64) + (lookup.end_count > 0),
                total(log_count) + end_log, total(inside),
                [raw[s:e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())], lists)


class Model:
    """Start, transition and emission probabilities, and the states' shares over all places."""

    def __init__(self, start, shift, emit, share):
        self.start, self.shift, self.emit, self.share = start, shift, emit, share

    @classmethod
    def initial(cls, class_share: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = class_share * np.exp(rng.normal(0, 1.0, (states, len(class_share))))
        shift = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        even = np.full(states, 1 / states)
        return cls(even, shift / shift.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), even)


def _lanes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as a matrix; their lengths and original order."""
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    matrix = np.zeros((size.max(), len(size)), np.uint16)
    for lane, i in enumerate(order):
        matrix[:size[i], lane] = sequences[i]
    return matrix, size[order], order


def _bundles(size: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Indices by falling length, cut so that lanes x longest stays within ``cells``."""
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(8192, cells // int(size[order[at]])))
        yield order[at:at + n]
        at += n


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each whole sequence by the scaled forward recursion."""
    result = np.zeros(len(sequences))
    size = np.array([len(s) for s in sequences])
    by_class = np.ascontiguousarray(model.emit.T)
    for bundle in _bundles(size, 1 << 21):
        matrix, lengths, order = _lanes([sequences[i] for i in bundle])
        total = np.zeros(len(lengths))
        alpha = model.start * by_class[matrix[0]]
        active = len(lengths)
        for t in range(len(matrix)):
            if t:
                active = int(np.searchsorted(-lengths, -t, "left"))
                alpha = (alpha[:active] @ model.shift) * by_class[matrix[t, :active]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:active] += np.log(scale)
        result[bundle[order]] = total
    return result


def expected(model: Model, pieces: list[np.ndarray], opening: np.ndarray) -> list[np.ndarray]:
    """Expected counts of starts, transitions, emissions and the log likelihood of pieces.

    ``opening`` tells which pieces begin a text; the others begin anywhere.
    """
    k, classes = model.emit.shape
    start, shift, emit, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
    by_class = np.ascontiguousarray(model.emit.T)
    size = np.array([len(p) for p in pieces])
    for bundle in _bundles(size, 1 << 18):
        matrix, lengths, order = _lanes([pieces[i] for i in bundle])
        opens = opening[bundle][order]
        steps, lanes = matrix.shape
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]
        alphas, scales = [], []
        alpha = np.where(opens[:, None], model.start, model.share) * by_class[matrix[0]]
        for t in range(steps):
            if t:
                alpha = (alpha[:active[t]] @ model.shift) * by_class[matrix[t, :active[t]]]
            scale = alpha.sum(1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            scales.append(scale)
            likelihood += float(np.log(scale).sum())
        beta = np.ones((lanes, k))
        gammas = [None] * steps
        for t in range(steps - 1, -1, -1):
            n = active[t]
            if t + 1 < steps and active[t + 1]:
                m = active[t + 1]
                onward = beta[:m] * by_class[matrix[t + 1, :m]] / scales[t + 1]
                shift += alphas[t][:m].T @ onward
                beta[:m] = onward @ model.shift.T
            gammas[t] = alphas[t] * beta[:n]
        flat = np.concatenate(gammas)
        seen = np.concatenate([matrix[t, :active[t]] for t in range(steps)])
        for s in range(k):
            emit[s] += np.bincount(seen, weights=flat[:, s], minlength=classes)
        start += gammas[0][opens].sum(0)
    return [start, shift * model.shift, emit, np.array([likelihood])]


def _expected_sums(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """One row per task with its expected counts in a row of numbers."""
    total = None
    for batch in batches:
        pieces, opening = [], []
        for raw in fields(batch, "kinds"):
            sequence = np.frombuffer(raw.as_buffer(), np.uint16)
            for at in range(0, len(sequence), PIECE):
                pieces.append(sequence[at:at + PIECE])
                opening.append(at == 0)
        if pieces:
            row = np.concatenate([x.ravel() for x in expected(model, pieces, np.array(opening))])
            total = row if total is None else total + row
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in fields(batch, "sums"):
            values = row.values.to_numpy()
            total = values.copy() if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])


def train(sequences: DataFrame, class_share: np.ndarray, iterations: int = ITERATIONS,
          states: int = STATES, seed: int = SEED) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows of ``sequences`` (kinds); also the log likelihood per iteration.

    Tasks' sums are added up in groups of FAN_IN until one row is left, which the
    driver receives. Without sequences the initial model is returned.
    """
    spark = sequences.sparkSession
    model, history = Model.initial(class_share, states, seed), []
    k, classes = model.emit.shape
    tasks = sequences.rdd.getNumPartitions()
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)
        rows = sequences.select("kinds").mapInArrow(
            lambda it: _expected_sums(it, shared.value), "sums array<double>")
        left = tasks
        while left > 1:
            left = -(-left // FAN_IN)
            rows = rows.repartition(left).mapInArrow(_add_up, "sums array<double>")
        sums = rows.collect()
        shared.unpersist()
        if not sums:
            break
        total = np.sum([r.sums for r in sums], axis=0)
        start, shift, emit = np.split(total[:-1], [k, k + k * k])
        shift, emit = shift.reshape(k, k), emit.reshape(k, classes)
        history.append(float(total[-1]))
        # A little of the overall share keeps every class possible in every state.
        emit = emit + 10 * class_share
        model = Model(*[x / x.sum(-1, keepdims=True) for x in (
            start + 0.1, shift + 0.1, emit, emit.sum(1))])
    return model, history


_SCORE = pa.schema([("row", pa.int64()), ("log_states", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequences = [np.frombuffer(x.as_buffer(), np.uint16) for x in fields(batch, "kinds")]
        if sequences:
            yield record(_SCORE, fields(batch, "row"), forward(model, sequences) / math.log(10))


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text",
          states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Score every text under a model of the texts that are not ``held_out`` (a Column).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). NULL counts as an empty text, whose only token is its end; a
    NULL held_out counts as false. Each row is scored, repeated ones equally. With
    nothing to train on, every word is unknown and base scores are 0. Words are
    told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = hand_over(frame.filter(~F.col("held_out")).select("text").mapInArrow(
        _count_words, "word long, kind int, n long").groupBy("word").agg(
        F.min("kind").alias("kind"), F.sum("n").alias("n")), "counts")
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                       F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("ends")).first()
    # Words per eighth of a power of two, at most 8 x 63 rows: where the lookup table has to end.
    level = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    room, least = LOOKUP_WORDS, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    table_ = counts.filter((level >= least) & (F.col("kind") > 0)).select("word", "n") if least is not None \
        else counts.limit(0).select("word", "n")
    frequent = table_.toArrow()
    words = frequent.column("word").to_numpy().view(np.uint64)
    times = frequent.column("n").to_numpy()
    own = np.zeros(len(words), np.int32)
    top = np.lexsort((words, -times))[:OWN]
    own[top] = 1 + np.arange(len(top))
    apart = [int(w) for w in words[top].view(np.int64)]
    kinds = counts.filter((F.col("kind") > 0) & ~F.col("word").isin(apart)).groupBy("kind").agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    size, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in kinds:
        size[row.kind], types[row.kind] = row.n, row.v
    kind_log = np.log10(size + ADD * (types + 1))
    size[0] = facts.ends or 0
    size[1:1 + len(top)] = times[top]
    class_share = (size + ADD) / (size + ADD).sum()
    lookup = spark.sparkContext.broadcast(Lookup(words, times, own, kind_log, facts.ends or 0))
    sequences = hand_over(frame.mapInArrow(
        lambda it: _sequences(it, lookup.value), _SEQUENCE_DDL)
        .withColumn("row", F.monotonically_increasing_id()), "sequences")
    model, _ = train(sequences.filter(~F.col("held_out")), class_share, iterations, states)
    shared = spark.sparkContext.broadcast(model)
    rare = sequences.select("row", F.explode("rare").alias("_word"))
    count = F.coalesce("n", F.lit(0))
    others = rare.join(counts.select("word", "n"), F.col("_word") == F.col("word"), "left").groupBy(
        F.col("row").alias("_row")).agg(F.sum(F.log10(count + F.lit(ADD))).alias("_logs"),
                                        F.count_if(count > 0).alias("_known"))
    states_ = sequences.select("row", "kinds").mapInArrow(
        lambda it: _score(it, shared.value), "row long, log_states double")
    logs = F.coalesce("_logs", F.lit(0.0))
    base = F.lit(math.log10(facts.n + ADD * (facts.v + 1)))
    return (sequences.drop("kinds", "rare").join(states_, "row").join(
        others, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(facts.n)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("log_states") + F.col("log_inside") + logs).alias("score")))


@query("op3_hidden_markov")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
