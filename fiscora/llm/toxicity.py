"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are the words it holds and their beginnings. Besides the
labelled texts, training sees differences: every labelled sentence that names a
group is rewritten to name each other group of the same kind, and what the
rewriting changes in the features enters twice, once under each label. The loss
of such a pair is least where its score is zero, that is where swapping the
group does not change the score, and grows with the change. So a group's name
cannot become evidence merely because toxic texts often mention it.

Training sees a bounded sample of labelled rows, drawn by key hash; all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.llm.ranking import TERM, terms_of
from fiscora.llm.registry import query, table
from fiscora.llm.slabs import LOWER, Slab, combine, fields, record, slabs, starts_of
from fiscora.session import hand_over

SAMPLE = 20_000             # labelled rows of each class that the classifier is fitted on, about
FEATURES = 2048             # features it may use
SEEN = 3                    # labelled texts a feature must occur in
BEGINNINGS = range(3, 9)    # bytes of a word's beginnings
PENALTY = 1.0               # weight of a swapped sentence, in labelled texts
RIDGE = 1.0                 # weight of the squared weights, on summed losses
OFFSET = 10.0               # value of the constant feature: large, so its weight is hardly penalised
SLAB_BYTES = 256 << 10
FILTER_BITS = 18

# Names of groups; within a tuple each can stand in for the others. Fixed values.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("africans", "europeans", "americans", "asians", "arabs", "mexicans"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)

_BREAK = np.isin(np.arange(256), list(b".!?\n"))


def text_features(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of every text as 64-bit hashes, and the text they belong to."""
    first, last, owner = terms_of(slab)
    hashes, owners = [combine(slab.hashes(first, last, True))], [owner]
    for size in BEGINNINGS:
        longer = np.flatnonzero(last - first > size)
        begin = slab.hashes(first[longer], first[longer] + size, True)
        hashes.append(combine(begin, np.full(len(begin), size, np.uint64)))
        owners.append(owner[longer])
    feature, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((feature, owner))
    feature, owner = feature[order], owner[order]
    new = np.ones(len(feature), bool)
    new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    return feature[new], owner[new]


class Known:
    """Place of each chosen feature, for fast look-up."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.features)] = True

    @staticmethod
    def _slot(features: np.ndarray) -> np.ndarray:
        return (features >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def find(self, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
        """Chosen features of every text, by place, and the text they belong to."""
        feature, owner = text_features(slab)
        maybe = np.flatnonzero(self.filter[self._slot(feature)])
        at = np.minimum(np.searchsorted(self.features, feature[maybe]), len(self.features) - 1)
        hit = self.features[at] == feature[maybe]
        return at[hit], owner[maybe[hit]]


@dataclass
class Classifier:
    """Weights of the chosen features; without features every text gets ``share``."""
    known: Known | None
    weights: np.ndarray
    constant: float
    share: float

    def scores(self, slab: Slab) -> np.ndarray:
        if self.known is None:
            return np.full(len(slab), self.share)
        at, owner = self.known.find(slab)
        margin = np.bincount(owner, weights=self.weights[at], minlength=len(slab)) + self.constant
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a feature, per slab."""
    schema = pa.schema([("feature", pa.int64()), ("one", pa.int64()), ("zero", pa.int64())])
    for batch in batches:
        label = fields(batch, "label").to_numpy()
        for slab in slabs(batch, limit=SLAB_BYTES):
            feature, owner = text_features(slab)
            one = label[slab.rows][owner]
            feature, back = np.unique(feature, return_inverse=True)
            n = np.bincount(back, minlength=len(feature))
            ones = np.bincount(back, weights=one, minlength=len(feature)).astype(np.int64)
            yield record(schema, feature.view(np.int64), ones, n - ones)


def _telling(found: DataFrame, ones: int, zeros: int, most: int) -> np.ndarray:
    """The ``most`` features whose occurrence depends most on the label (likelihood ratio)."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    one, zero = F.col("one").cast("double"), F.col("zero").cast("double")
    n, total = one + zero, float(ones + zeros)
    ratio = (part(one, n * ones / total) + part(zero, n * zeros / total)
             + part(F.lit(ones) - one, (total - n) * ones / total)
             + part(F.lit(zeros) - zero, (total - n) * zeros / total))
    rows = found.groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).filter(
        n >= SEEN).orderBy(F.round(ratio, 9).desc(), "feature").limit(most).toArrow()
    return np.sort(rows.column("feature").to_numpy().view(np.uint64))


def swaps(text: bytes, others: dict[bytes, tuple[bytes, ...]]) -> Iterator[tuple[bytes, bytes]]:
    """Every sentence that names a group, with its rewriting for each other group of the kind.

    All groups of a sentence move on by the same number of places within their kinds.
    """
    low = LOWER[np.frombuffer(text, np.uint8)].tobytes()
    if not any(name in low for name in others):
        return
    data = np.frombuffer(low, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(_BREAK[data]) + 1, [len(data)]])
    solid = np.concatenate([[False], TERM[data], [False]])
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    first, last = turn[::2], turn[1::2]
    at = starts_of(np.searchsorted(edges, first, "right") - 1, len(edges) - 1)
    for s in range(len(edges) - 1):
        words = [(a, z) for a, z in zip(first[at[s]:at[s + 1]].tolist(), last[at[s]:at[s + 1]].tolist())
                 if low[a:z] in others]
        if not words:
            continue
        begin, end = int(edges[s]), int(edges[s + 1])
        for step in range(max(len(others[low[a:z]]) for a, z in words)):
            pieces, done = [], begin
            for a, z in words:
                names = others[low[a:z]]
                pieces += [low[done:a], names[step % len(names)]]
                done = z
            yield low[begin:end], b"".join([*pieces, low[done:end]])


def _names(identities: Sequence[Sequence[str]]) -> dict[bytes, tuple[bytes, ...]]:
    """Each name with the others of its kind, beginning after it."""
    return {name.encode(): tuple(o.encode() for o in (*kind[k + 1:], *kind[:k]))
            for kind in identities for k, name in enumerate(kind) if len(kind) > 1}


_ROW = pa.schema([("label", pa.float64()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
_ROW_DDL = "label double, at array<int>, value array<double>"


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts_of(owner, n), pa.int32()), pa.array(values, kind))


def _examples(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = fields(batch, "label").to_numpy().astype(float)
        for slab in slabs(batch, limit=SLAB_BYTES):
            at, owner = known.find(slab)
            yield record(_ROW, label[slab.rows], _lists(at, owner, len(slab), pa.int32()),
                         _lists(np.ones(len(at)), owner, len(slab), pa.float64()))


def _differences(batches: Iterator[pa.RecordBatch], known: Known,
                 others: dict[bytes, tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
    """What rewriting a sentence changes in its chosen features."""
    size = len(known.features)
    for batch in batches:
        pairs = [p for text in fields(batch, "text").to_pylist() if text for p in swaps(text.encode(), others)]
        for begin in range(0, len(pairs), 512):
            part = pairs[begin:begin + 512]
            at, owner = known.find(Slab([t for p in part for t in p], np.arange(2 * len(part))))
            sign = np.where(owner % 2, 1.0, -1.0)
            place, back = np.unique(owner // 2 * size + at, return_inverse=True)
            change = np.bincount(back, weights=sign, minlength=len(place))
            place, change = place[change != 0], change[change != 0]
            own = place // size
            yield record(_ROW, np.zeros(len(part)), _lists(place % size, own, len(part), pa.int32()),
                         _lists(change, own, len(part), pa.float64()))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, label_key: str,
           most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled rows of each class, drawn by key hash.

    A key with several labels counts as 1 if one of them is. The labels drawn are bounded, so
    they are broadcast.
    """
    once = labels.select(F.col(f"`{label_key}`").cast("long").alias("_key"),
                         F.col(f"`{label}`").cast("int").alias("label")).filter(
        "_key IS NOT NULL AND label IN (0, 1)").groupBy("_key").agg(F.max("label").alias("label"))
    count = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    drawn = F.lit(False)
    for value, n in count.items():
        limit = min(-(1 << 63) + int((1 << 64) * min(1.0, most / n)), (1 << 63) - 1)
        drawn = drawn | ((F.col("label") == value) & (F.xxhash64("_key") <= limit))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    return rows.join(F.broadcast(once.filter(drawn)), F.col("doc_id") == F.col("_key")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        label_key: str = "doc_id", identities: Sequence[Sequence[str]] = IDENTITIES, penalty: float = PENALTY,
        most: int = SAMPLE, features: int = FEATURES) -> Classifier:
    """A classifier from about ``most`` labelled texts of each class.

    NULL texts count as empty; rows without a key or a label of 0 or 1 are left out. If
    nothing, or only one class, is labelled, every text gets the smoothed share of label 1.
    """
    spark = docs.sparkSession
    rows = hand_over(sample(docs, labels, key, text, label, label_key, most), "labelled")
    count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, zeros = count.get(1, 0), count.get(0, 0)
    share = ones / (ones + zeros + 1)
    found = rows.mapInArrow(_occurrences, "feature long, one long, zero long")
    chosen = _telling(found, ones, zeros, features) if ones and zeros else np.zeros(0, np.uint64)
    if not len(chosen):
        return Classifier(None, np.zeros(0), 0.0, share)
    known = Known(chosen)
    shared = spark.sparkContext.broadcast(known)
    others = _names(identities)
    examples = rows.mapInArrow(lambda it: _examples(it, shared.value), _ROW_DDL).withColumn(
        "weight", F.lit(1.0)).withColumn("constant", F.lit(OFFSET))
    # Equal changes are one row; the label says nothing about them, so each enters under both.
    changes = rows.mapInArrow(lambda it: _differences(it, shared.value, others), _ROW_DDL).filter(
        F.size("at") > 0).groupBy("at", "value").agg((F.count("*") * penalty).alias("weight"))
    both = changes.select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("label"), "at", "value", "weight",
                          F.lit(0.0).alias("constant"))
    size = len(chosen)

    @F.udf(VectorUDT())
    def vector(at, value, constant):
        return Vectors.sparse(size + 1, [*at, size], [*value, constant])

    # Two empty rows that no weight can change: the learner leaves out columns that never vary.
    data = examples.unionByName(spark.createDataFrame(
        [(v, [], [], 1.0, 0.0) for v in (0.0, 1.0)], f"{_ROW_DDL}, weight double, constant double"))
    if penalty > 0:
        data = data.unionByName(both)
    ready = hand_over(data.select("label", "weight", vector("at", "value", "constant").alias("features")), "examples")
    total = ready.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(weightCol="weight", fitIntercept=False, standardization=False, maxIter=200,
                               tol=1e-9, regParam=RIDGE / total).fit(ready)
    weights = model.coefficients.toArray()
    return Classifier(known, weights[:-1], float(weights[-1] * OFFSET), share)


def score(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1, from the text alone.

    NULL counts as empty; repeated rows score alike; an empty table gives no rows and other
    columns are not read. A task holds a slab of texts, or, of a longer one, some 80 bytes
    per byte for its features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(slab) for slab in slabs(batch, limit=SLAB_BYTES)]
            if parts:
                yield record(schema, fields(batch, "doc_id"), np.concatenate(parts))

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return score(docs, fit(docs, learn)).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
