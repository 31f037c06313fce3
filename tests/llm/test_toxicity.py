"""The toxicity classifier: features and scores against plain versions, swaps, and what the penalty does."""

from __future__ import annotations

import random
from math import exp

import numpy as np

from fiscora.llm import toxicity
from fiscora.llm.queries import QUERIES
from fiscora.llm.slabs import Slab, combine
from tests.llm.conftest import ODD
from tests.llm.test_ranking import LOWER, TERM

CALM = "the of and to in is it that was for on are with as by at from".split()
RUDE = "grumble snarl sneer".split()


def plain_features(text):
    words = {w.encode() for w in TERM.findall((text or "").translate(LOWER))}
    return {(w, 0) for w in words} | {(w[:k], k) for w in words for k in range(3, 9) if len(w) > k}


def hashed(features):
    out = set()
    for text, size in features:
        slab = Slab([text], np.arange(1))
        h = slab.hashes(slab.start, slab.end, True)
        out.add(int((combine(h, np.full(1, size, np.uint64)) if size else combine(h))[0]))
    return out


def test_features_against_plain_version():
    texts = ["Idiot, idiot! Straße élan", "", "a b", "x" * 30, "worthless worth wor"]
    slab = Slab([t.encode() for t in texts], np.arange(len(texts)))
    feature, owner = toxicity.text_features(slab)
    for i, t in enumerate(texts):
        assert set(feature[owner == i].tolist()) == hashed(plain_features(t))
        assert (owner == i).sum() == len(plain_features(t))


def test_swaps_rewrite_sentences():
    others = toxicity._names([("women", "men"), ("red", "green", "blue")])
    got = list(toxicity.swaps(b"Red women sing. Nobody here!\nGREEN tea, omen.", others))
    assert got == [
        (b"red women sing.", b"green men sing."), (b"red women sing.", b"blue men sing."),
        (b"green tea, omen.", b"blue tea, omen."), (b"green tea, omen.", b"red tea, omen.")]
    assert list(toxicity.swaps(b"", others)) == [] == list(toxicity.swaps("é".encode(), others))


def world(spark, seed=11, n=400):
    """Rude texts often name one group; calm ones seldom do."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(CALM, k=25)
        if toxic:
            # A third of the rude texts can only be told by the group they name.
            words += rng.choices(RUDE, k=2) if i % 3 else []
        if rng.random() < (0.9 if toxic else 0.03):
            words.append("muslims")
        elif rng.random() < 0.3:
            words.append("buddhists")
        rng.shuffle(words)
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_penalty_takes_evidence_from_groups(spark):
    docs, labels = world(spark)
    calm = "the of and to in is it that was for on are with as by at from "
    pair = [calm + g for g in ("muslims", "buddhists")]
    slab = Slab([t.encode() for t in [*pair, calm + "snarl grumble"]], np.arange(3))
    free = toxicity.fit(docs, labels, penalty=0.0).scores(slab)
    fair = toxicity.fit(docs, labels, penalty=1.0).scores(slab)
    assert free[0] >= 0.5 and free[0] - free[1] > 0.4         # a neutral mention is taken for rude
    assert fair[0] < 0.5 and abs(fair[0] - fair[1]) < 0.2
    assert fair[2] >= 0.5 and free[2] >= 0.5


def test_scores_against_plain_version(spark, odd):
    docs, labels = world(spark)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.known.features.tolist(), model.weights.tolist()))
    rows = toxicity.score(odd, model).collect()
    want = [(d, 1 / (1 + exp(-model.constant - sum(weight.get(f, 0.0) for f in hashed(plain_features(t))))))
            for d, t, *_ in ODD]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [r[0] for r in sorted(map(tuple, rows), key=key)] == [w[0] for w in sorted(want, key=key)]
    assert np.allclose([r[1] for r in sorted(map(tuple, rows), key=key)], [w[1] for w in sorted(want, key=key)])


def test_nothing_or_one_class_labelled(spark, odd, empty):
    docs, labels = world(spark, n=40)
    none = toxicity.fit(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    one = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert {r.score for r in toxicity.score(odd, one).collect()} == {10 / 11}
    assert toxicity.score(empty, none).count() == 0
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 7)], labels.schema))
    rows = toxicity.sample(docs.unionByName(docs.limit(1)), twice, "doc_id", "text", "toxic", "doc_id", 1000)
    assert rows.count() == 41
    few = toxicity.sample(*world(spark), "doc_id", "text", "toxic", "doc_id", 50).groupBy("label").count().collect()
    assert all(25 <= r["count"] <= 80 for r in few)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op12_toxicity"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").groupBy("toxic", "predicted").count()
    n = {(r.toxic, r.predicted): r["count"] for r in rows.collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.88
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) <= 0.01
