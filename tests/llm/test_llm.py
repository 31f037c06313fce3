"""The operators against brute force, on odd input, and with their limits forced low."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fiscora.llm import decontaminate, graph, hmm, langid, pieces, pii, quality, secrets, simhash, slabs, substrings, urls
from fiscora.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import DOCS, ODD, PROSE, rows_of
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def frame(spark, pairs):
    return spark.createDataFrame(rows_of(pairs), DOCS)


def texts(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(200)]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


# 1

def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        words = rng.choices(vocabulary, k=150)
        if d % 4 == 0:
            copy = items[d % 20][1].split()
            for k in rng.sample(range(30), 4):       # words replaced, dropped or put in
                copy[k] = rng.choice(["", "zz", copy[k] + " qq"])
            words[60:60] = " ".join(copy).upper().split()
            want.add((d, items[d % 20][0]))
        docs.append((d, ", ".join(words)))
    df, bench = frame(spark, docs), benchmark(spark, items)
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert found == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench, block_words=100).collect()} == want
    kept = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert kept == set(range(200)) - {d for d, _ in want}


def edited(rng, words, every, how):
    """Every so many words replaced, dropped, followed by another, or one of these at random."""
    out = []
    for k, w in enumerate(words):
        kind = rng.choice(["replace", "drop", "insert"]) if how == "mixed" else how
        if k % every != every - 1:
            out.append(w)
        elif kind == "replace":
            out.append("zz")
        elif kind == "insert":
            out += [w, "zz"]
    return out


def planted(rng, items, words_per_text=60):
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    docs, edits = [], []
    for item, text in items:
        for every in (2, 3, 4, 5):
            for how in ("replace", "drop", "insert", "mixed"):
                words = rng.choices(vocabulary, k=words_per_text)
                words[20:20] = edited(rng, text.split(), every, how)
                edits.append((len(docs), item, every, how))
                docs.append((len(docs), " ".join(words)))
    return docs, edits


def test_decontamination_equals_aligning_all_pairs(spark):
    """Common words throughout, so that seeds meet by chance as well."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 4, 5, 7, 12, 25, 40])))) for i in range(12)]
    docs, _ = planted(rng, items, 30)
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=80))) for i in range(60)]
    slab = slabs.Slab([t.encode() for _, t in docs], np.arange(len(docs)))
    word, owner = decontaminate.item_words(slab)
    cuts = slabs.starts_of(owner, len(docs))
    asked = slabs.Slab([t.encode() for _, t in items], np.arange(len(items)))
    own, of = decontaminate.item_words(asked)
    for least in (0.5, 0.75):
        want = {}
        for d, (doc, _) in enumerate(docs):
            passages = [word[cuts[d]:cuts[d + 1]]] * len(items)
            each = [own[of == i] for i in range(len(items))]
            score, _ = decontaminate.align(each, passages)
            want.update({(doc, i): s / (2 * len(w)) for i, (s, w) in enumerate(zip(score, each))
                         if s / (2 * len(w)) >= least})
        rows = decontaminate.matches(frame(spark, docs), benchmark(spark, items), least=least).collect()
        assert {(r.doc_id, r.item_id): r.score for r in rows} == want and len(want) > 50


@pytest.mark.parametrize("hits", [1 << 20, 64])
def test_decontamination_recall_of_edited_copies(spark, monkeypatch, hits):
    """Every copy whose alignment can reach the score is found, also if few hits fit in memory."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(25)]
    docs, edits = planted(rng, items)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    ids, words = pa.array([i for i, _ in items]), slabs.Slab([t.encode() for _, t in items], np.arange(len(items)))
    own, of = decontaminate.item_words(words)
    block = decontaminate.Items(ids, [own[of == i] for i in range(len(items))], {})
    text, item, share, first, end = block.search(slabs.Slab([t.encode() for _, t in docs], np.arange(len(docs))))
    found = set(zip(text.tolist(), item.tolist()))
    for doc, i, every, how in edits:
        # Matches less errors, at the least: an edit touches one word in ``every``.
        lost = -(-30 // every) * {"replace": 3, "drop": 3, "insert": 1, "mixed": 3}[how]
        if 60 - lost >= 30:
            assert (doc, i) in found, (every, how)
    assert (share >= 0.5).all() and (first >= 0).all() and (end > first).all()


def test_seeds_do_not_depend_on_corpus_size():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 50, n).astype(np.uint64) for n in (3, 8, 30)]
    counts = {w: int(rng.integers(0, 1000)) for w in range(50)}
    once = decontaminate.Items(pa.array([1, 2, 3]), words, counts)
    twice = decontaminate.Items(pa.array([1, 2, 3]), words, {w: 2 * n for w, n in counts.items()})
    assert (once.seed == twice.seed).all() and (once.entry == twice.entry).all()


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    items = [rng.integers(2, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    passages = [rng.integers(2, 6, rng.integers(0, 30)).astype(np.uint64) for _ in range(40)]
    score, end = decontaminate.align(items, passages)
    for i, (a, b) in enumerate(zip(items, passages)):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for x in range(len(a)):
            for y in range(len(b)):
                h[x + 1, y + 1] = max(0, h[x, y] + (2 if a[x] == b[y] else -1), h[x, y + 1] - 1, h[x + 1, y] - 1)
        assert score[i] == h.max()
        assert not score[i] or h[:, end[i]].max() == h.max()


def test_decontamination_odd(spark, odd, empty):
    bench = benchmark(spark, [(1, PROSE), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "no key here")])
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, bench).collect()}
    assert {(1, 1), (2, 1), (13, 1), (6, 4), (None, None)} <= found
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)


# 2

def test_url_rules_and_odd_urls(spark):
    pages = spark.createDataFrame([
        (1, "http://a.Example.COM/en/x", 1), (2, "https://www.example.com/en/1", 1), (3, "http://x.net/es/", 1),
        (4, None, 1), (5, "no scheme", 1), (6, "http://listed.org/p?utm_source=1#f", 1), (7, "http://badexample.com/en/", 1),
        (8, "http://free.org/p", 1), (8, "http://free.org/p", 1), (9, "://", 1), (10, "http://x.net?/es/", 1)],
        "page_id long, url string, host int")
    listing = spark.createDataFrame([("https://www.listed.org/p/",), (None,), ("https://listed.org/p",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listing).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/", "net/es/", "block")
    assert got[4] == got[5] == got[9] == ("", "", None, "allow")
    assert got[6] == ("listed.org", "/p", None, "block")
    assert got[7] == ("badexample.com", "/en/", "com/", "allow")
    assert got[10] == ("x.net", "", None, "allow")
    assert urls.judge(pages, listing).count() == 11
    assert urls.judge(pages, listing.limit(0)).filter("listed").count() == 0
    assert urls.judge(pages.limit(0), listing).count() == 0


def test_bloom_filter_false_positives_are_removed(spark):
    pages = spark.range(3000).selectExpr("id", "concat('u', id) AS u")
    listing = spark.range(500).selectExpr("concat('u', id * 5) AS u")
    marked = urls.mark_listed(pages, "u", listing, "u", bits_per_url=1)     # a filter that lets most pass
    assert {r.id for r in marked.filter("listed").collect()} == set(range(0, 2500, 5))
    assert marked.count() == 3000


# 3

def test_forward_is_exact():
    rng = np.random.default_rng(4)
    model = hmm.Model.initial(rng.dirichlet(np.ones(9)), 3)
    sequences = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 2, 5, 5, 7)]
    got = hmm.forward(model, sequences)
    for value, s in zip(got, sequences):
        alpha = model.start * model.emit[:, s[0]]
        for c in s[1:]:
            alpha = (alpha @ model.shift) * model.emit[:, c]
        assert math.isclose(value, math.log(alpha.sum()), rel_tol=1e-9)


def test_expected_counts():
    rng = np.random.default_rng(6)
    model = hmm.Model.initial(rng.dirichlet(np.ones(5)), 2)
    s = rng.integers(0, 5, 4).astype(np.uint16)
    start, shift, emit, likelihood = hmm.expected(model, [s], np.array([True]))
    total, a, e = 0.0, np.zeros((2, 2)), np.zeros((2, 5))
    for path in np.ndindex(2, 2, 2, 2):
        p = model.start[path[0]] * model.emit[path[0], s[0]]
        for t in range(1, 4):
            p *= model.shift[path[t - 1], path[t]] * model.emit[path[t], s[t]]
        total += p
        for t in range(4):
            e[path[t], s[t]] += p
            if t:
                a[path[t - 1], path[t]] += p
    assert np.allclose(shift, a / total) and np.allclose(emit, e / total)
    assert np.isclose(likelihood[0], math.log(total)) and np.isclose(start.sum(), 1)


def test_language_model(spark):
    docs = texts(80)
    df = frame(spark, docs)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = {r.doc_id: r for r in hmm.score(df, held, iterations=2).collect()}
    words = {d: brute.WORD.findall(t.translate(brute.LOWER)) + ["\n"] for d, t in docs}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words.items():
        base = sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in ws)
        assert math.isclose(rows[d].base_score, base, rel_tol=1e-9)
        assert (rows[d].n_tokens, rows[d].n_known, rows[d].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)


def test_rare_words_come_by_a_join(spark, monkeypatch):
    df = frame(spark, texts(40))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    whole = {r.doc_id: r.base_score for r in hmm.score(df, held, iterations=1).collect()}
    monkeypatch.setattr(hmm, "LOOKUP_WORDS", 20)
    for r in hmm.score(df, held, iterations=1).collect():
        assert math.isclose(r.base_score, whole[r.doc_id], rel_tol=1e-9)


def test_training_raises_the_likelihood(spark):
    from fiscora.session import hand_over
    df = hand_over(spark.createDataFrame(
        [(bytearray(np.array([1, 2, 3, 1, 2, 3] * 20 + [0], np.uint16).tobytes()),),
         (bytearray(np.array([4, 5] * 30 + [0], np.uint16).tobytes()),)], "kinds binary"), "t")
    _, history = hmm.train(df, np.full(6, 1 / 6), iterations=6, states=3)
    assert all(b > a - 1e-6 for a, b in zip(history, history[1:])) and history[-1] > history[0] + 10


def test_sums_of_many_tasks_are_added_up_in_a_tree(spark):
    rng = np.random.default_rng(2)
    rows = [(bytearray(rng.integers(0, 6, 30).astype(np.uint16).tobytes()),) for _ in range(400)]
    one = spark.createDataFrame(rows, "kinds binary").coalesce(1)
    many = one.repartition(hmm.FAN_IN * hmm.FAN_IN + 5)
    share = np.full(6, 1 / 6)
    (a, first), (b, second) = (hmm.train(df, share, iterations=2, states=3) for df in (one, many))
    assert np.allclose(first, second) and np.allclose(a.emit, b.emit) and np.allclose(a.shift, b.shift)


def test_language_model_odd(spark, odd, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = hmm.score(odd, held, iterations=1).collect()
    assert len(rows) == len(ODD)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[8].n_tokens == 40_001
    assert hmm.score(empty, held).count() == 0
    alone = hmm.score(odd, F.lit(True), iterations=1).collect()
    assert all(abs(r.base_score) < 1e-6 and r.train_tokens == 0 for r in alone)


# 4 and 5

HARD = ["", "a@b", "a@b.c_d@e.f.g", "x@y@z.com", "a.b+c@d-e.f..g", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4x", "1..2.3.4",
        "4539148803436467 4539-1488-0343-6467 4539 1488 0343 6468", "+1 (415) 555-2671 +12345678 +1-2-3-4-5-6-7-8-9.", "++1234567890",
        "+1 ( ) . - ", "é@é.com ü+49 30 1234567", "1" * 300, "a" * 300 + "@x.y", "1.1.1.1.1.1.1", "٣@x.com ¹²³"]
KEYS = ["password=abcdefghijkl", "PASSWORD : 'abcdefghijkl", "token==abcdefghijkl", "api_key\"= \"A+b/c_d.e=f-g1", "apikey:short",
        "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "AKIAABCDEFGHIJKLMN AKIAABC xAKIAABCDEFGHIJKLMN0", "0123456789abcdef0 0123456789abcde",
        "secret secret=secret=abcdefghijkl", "password=é token\n=abcdefghijkl", "é é secret='deadbeefdeadbeef'"]


def alphabet_soup(seed, letters, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


def test_plain_identifiers():
    for text in HARD + alphabet_soup(1, "a1@.+- 2(é") + alphabet_soup(2, "12.+-@ x"):
        assert sorted(pii.plain(text)) == brute.personal(text), text


def test_plain_secrets():
    for text in KEYS + alphabet_soup(3, ["token", "secret", "=", ":", " ", "'", "abc", "0f", "AKIA", "é", "Z9"]):
        slab = slabs.Slab([text.encode()], np.arange(1))
        got = sorted((s, k, e) for s, k, e, _, band, _ in secrets._spans(slab)[0] if band is None)
        assert got == brute.secret(text), text


@pytest.mark.parametrize("name,fn,kinds", [("op4_personal_data", brute.personal, pii.KINDS),
                                           ("op5_secrets", brute.secret, secrets.KINDS[:3])])
def test_scans_of_the_table(spark, name, fn, kinds):
    want = {r.doc_id: fn(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES[name](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.base_sha256 == brute.digest(want[r.doc_id], kinds)
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == i for s in want[r.doc_id]) for i in range(len(kinds))]


@pytest.mark.parametrize("text,found", [
    ("mail jоhn [at] exаmple [dot] com now", "jоhn [at] exаmple [dot] com"),
    ("mail jane at mail dot example dot org now", "jane at mail dot example dot org"),
    ("call plus one five five five, one two three four five six", "plus one five five five, one two three four five six"),
    ("host one nine two dot one six eight dot zero dot one up", "one nine two dot one six eight dot zero dot one"),
    ("pay ４５３９１４８８０３４３６４６７ today", "４５３９１４８８０３４３６４６７"),
    ("pay 4539​1488​0343​6467 today", "4539​1488​0343​6467"),
    ("\x00 mail john dot smith [at] example [dot] com now", "john dot smith [at] example [dot] com"),
    ("\x00\U000f0000 jane at mail dot example dot org.", "jane at mail dot example dot org"),
    ("write bob (at) 10.20.30.40.example.com", "bob (at) 10.20.30.40.example.com"),
    ("we met at the station one two three dots", None), ("he looked at example.com once", None)])
def test_disguises_map_back(text, found):
    spans = pii.disguised(text, pii.plain(text))
    assert [text[s:e] for s, _, e in spans] == ([found] if found else [])


def test_disguises_pass_the_gate(spark):
    found = ["jоhn [at] exаmple [dot] com", "jane at mail dot example dot org", "john [at] example.com", "john(at)example.com",
             "john [@] example [.] com", "a.b {at} mail.org", "JOHN < AT > example.com", "a.b (\u00a0at\u3000) mail.org",
             "plus one five five five, one two three four five six", "４５３９１４８８０３４３６４６７", "john@example(.)com",
             "plus\u00a0one\u00a0five\u00a0five\u00a0five\u00a0one\u00a0two\u00a0three\u00a0four\u00a0five\u00a0six",
             "one\u3000nine\u3000two dot one\u3000six\u3000eight dot zero dot one"]
    # Quoted, so that no blank is next to the words either.
    docs = [(i, f'é "{t}" up') for i, t in enumerate(found)] + [
        (100, "met (at the station) one two, a [list] of <at least> ten"), (101, "oпe ſix ſix ſix nıne nıne four four four")]
    got = {r.doc_id: [docs[r.doc_id][1][s.start:s.stop] for s in r.spans if s.band == 0]
           for r in pii.find(frame(spark, docs)).filter("doc_id < 100").collect()}
    assert got == {i: [t] for i, t in enumerate(found)}
    assert [list(r.spans) for r in pii.find(frame(spark, docs)).filter("doc_id >= 100").collect()] == [[], []]


def test_randomness_battery(spark):
    rng = random.Random(9)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(b62, k=40)) for _ in range(20)]
    plain = ["thisIsACamelCaseIdentifier2021", "zzzzzzzzzzzzzzzzzzzzzzzz1", "some_long_variable_name_v2", "2024_01_01-2024_01_02", "Abcdefghijklmnopqrstuvwxyz012345"]
    docs = [(i, f"{PROSE} {k} {PROSE}") for i, k in enumerate(keys + plain)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(frame(spark, docs)).collect()}
    assert all(got[i] == ["random"] for i in range(20)) and all(got[i] == [] for i in range(20, 25))
    masked = {r.doc_id: r.text for r in secrets.redact(frame(spark, docs)).collect()}
    assert masked[0] == f"{PROSE} [secret] {PROSE}" and masked[21] == docs[21][1]


def test_every_form_of_string_is_tested(spark):
    rng = random.Random(21)
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"

    def key(alphabet, n=40):
        return "".join(rng.choices(alphabet, k=n))
    forms = [
        lambda: ("AWS_KEY=", key(letters + digits + "+/"), ""), lambda: ("a=1&sig=", key(letters + digits), "&b=2"),
        lambda: ("=", key(letters + digits, 42) + "==", ""), lambda: ("x=y=", key(digits + letters[26:]), "=z"),
        lambda: ("", "-".join(key(digits + letters[26:], 12) for _ in range(4)), ""),
        lambda: ("", "xoxb-" + key(digits, 12) + "-" + key(digits + letters[26:]), ""),
        lambda: ("", "_".join(key("234567" + letters[:26], 30) for _ in range(4)), ""),
        lambda: ("", key(letters, 80), ""), lambda: ("", key(letters[:26], 300), "")]
    keys = [form() for form in forms for _ in range(6)]
    words = ["SomeTitleCasedPathOfWordsInARow", "some/Path/With/Many/Title/Words", "this-is-a-long-slug-of-words-in-a-url",
             "donaudampfschifffahrtsgesellschaft", "SOME_LONG_CONSTANT_NAME_OF_WORDS", "name_of_a_thing=name_of_another_thing",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "/usr/lib/python3/dist-packages/module"]
    docs = [(i, f"{PROSE} {''.join(k)} {PROSE}") for i, k in enumerate(keys)] + [
        (100 + i, f"{PROSE} {w} {PROSE}") for i, w in enumerate(words)]
    masked = {r.doc_id: r.text for r in secrets.redact(frame(spark, docs)).collect()}
    for i, (before, _, after) in enumerate(keys):
        assert masked[i] == f"{PROSE} {before}[secret]{after} {PROSE}", keys[i]
    assert all(masked[d] == t for d, t in docs if d >= 100)
    # Short ones are judged too, though little evidence is in them.
    for token in (b"qzkxvjwpfhgqzmxkvbwy", b"QZKXVJWPFHGQZMXKVBWY", b"qzKXvjWPfhGQzmXKvbWY", b"ab12-cd34-ef56-ab78-cd"):
        assert secrets.evidence(token) is not None


def test_scans_odd(spark, odd, empty):
    for find in (pii.find, secrets.scan):
        assert find(odd).count() == len(ODD) and find(empty).count() == 0
    out = secrets.redact(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert secrets.redact(empty).count() == 0


# 6

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_segmentation_is_best(vocabulary):
    score = {vocabulary.text[i]: vocabulary.scores[i] for i in vocabulary.usable}
    for text in ["hello world", "  two  spaces\n\ttab", "ñandú größe 日本 🎉", "aaaaaaaaaaaaaaaa", "The of▁x"] + [t for _, t in texts(10)]:
        raw = (" " + text).encode()
        best = [0.0] + [-math.inf] * len(raw)
        starts = [i for i in range(len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        for a, i in enumerate(starts[:-1]):
            char = raw[i:starts[a + 1]]
            for j in starts[a + 1:a + 60]:
                if raw[i:j] in score:
                    best[j] = max(best[j], best[i] + score[raw[i:j]])
            if char not in score:
                best[i + len(char)] = max(best[i + len(char)], best[i] + vocabulary.unknown)
        data = np.frombuffer(raw, np.uint8)
        _, _, total = pieces.segment(vocabulary, data, np.array([0]), np.array([len(raw)]))
        assert math.isclose(total[0], best[-1], rel_tol=1e-9), text
        ids, offsets = pieces.encode_texts(vocabulary, [text.encode()])
        got = sum(score.get(vocabulary.text[i], 0.0) for i in ids if i not in set(vocabulary.byte_ids.tolist()))
        assert pieces.decode_ids(vocabulary, ids, offsets) == [text.encode()]
        assert got >= best[-1] - 1e-6


def test_pieces_round_trip(spark, odd, empty, vocabulary):
    coded = pieces.encode(odd, vocabulary)
    assert coded.schema["ids"].dataType.simpleString() == "array<int>" and "text" not in coded.columns
    assert coded.columns.count("ids") == 1
    back = pieces.decode(coded.withColumn("text", F.lit("x")), vocabulary)
    assert back.columns.count("text") == 1
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "")
    assert [(r.doc_id, r.text) for r in sorted(back.collect(), key=key)] == \
        [(r.doc_id, r.text) for r in sorted(odd.collect(), key=key)]
    rows = pieces.digests(odd, vocabulary).collect()
    assert len(rows) == len(ODD) and all(r.exact for r in rows)
    assert {r.doc_id: r.n_ids for r in rows}[3] == 0
    assert pieces.encode(empty, vocabulary).count() == 0


# 7

def brute_groups(docs, shingle=3, limit=2):
    prints = {}
    for d, t in docs:
        w = brute.WORD.findall((t or "").translate(brute.LOWER))
        grams = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


@pytest.mark.parametrize("most", [1 << 14, 2])
def test_simhash_groups(spark, most):
    rng = random.Random(8)
    docs = []
    for i in range(150):
        words = (PROSE * 9).split()
        for k in rng.sample(range(len(words)), rng.randint(0, 4)):
            words[k] = "q" + str(rng.randint(0, 5))
        docs.append((i, " ".join(words)))
    docs += [(200, ""), (201, None), (202, "one"), (203, "One"), (204, "a b")]
    want = brute_groups(docs)
    got = simhash.groups(frame(spark, docs), most=most).select(
        "doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want


def test_keep_one_with_clashing_names(spark):
    rng = random.Random(4)
    docs = []
    for g in range(8):
        words = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(300)]
        docs += [(g * 100 + c, " ".join(words).title() if c % 2 else " ".join(words)) for c in range(6)]
    named = frame(spark, docs).withColumns({"_gone": F.lit("x"), "_shared": F.lit(1), "n": F.lit(2)})
    kept = simhash.keep_one(named.unionByName(named))
    assert kept.columns == named.columns
    assert sorted(r.doc_id for r in kept.collect()) == [g * 100 for g in range(8)]


def test_simhash_odd(spark, odd, empty):
    got = simhash.groups(odd).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(ODD) and by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[10] == 10
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect())[10] == 1
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(40)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8

def test_probabilities_add_up():
    rng = np.random.default_rng(3)
    raw = rng.choice(np.frombuffer(b"abcde \n", np.uint8), 400)
    slab = slabs.Slab([raw.tobytes()], np.arange(1))
    gram, _ = langid._grams(slab, langid.ORDER)
    key, n = np.unique(gram, return_counts=True)
    trees = langid.Trees(["x"], key, np.zeros(len(key), int), n.astype(float))
    for context in (b"abc", b"zzz", b"az\n", b"\n\n\n"):
        grams = np.array([int.from_bytes(context + bytes([c]), "big") for c in range(256)], np.uint32)
        assert math.isclose((2.0 ** -trees._lookup(langid.ORDER, grams)).sum(), 1, rel_tol=1e-6)


def brute_ppm(train, text, order=3):
    """Code length in bits, byte by byte, with counts of every context kept in dictionaries."""
    seen = {}
    for t in train:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen.setdefault(padded[i - k:i], Counter())[padded[i]] += 1

    def order0(byte):
        counts = seen.get(b"", Counter())
        total = sum(counts.values()) + len(counts)
        if byte in counts:
            return counts[byte] / total
        return len(counts) / total / 256 / (1 - len(counts) / 256)

    def full(context, byte):
        if not context:
            return order0(byte)
        counts = seen.get(context)
        if not counts:
            return full(context[1:], byte)
        total = sum(counts.values()) + len(counts)
        if byte in counts:
            return counts[byte] / total
        return len(counts) / total * full(context[1:], byte) / (1 - sum(full(context[1:], b) for b in counts))

    padded = b"\n" * order + text
    return -sum(math.log2(full(padded[i - order:i], padded[i])) for i in range(order, len(padded)))


def test_code_lengths_against_plain_version(spark):
    rng = random.Random(5)
    train = {n: [" ".join("".join(rng.choices(a, k=4)) for _ in range(30)).encode() for _ in range(3)]
             for n, a in (("x", "abcde"), ("y", "cdefé"))}
    rows = frame(spark, [(10 * i + k, t.decode(), n, "s") for i, (n, ts) in enumerate(train.items())
                         for k, t in enumerate(ts)])
    trees = langid.fit(rows)
    asked = [b"abcd ecd", "fé de cab zz".encode(), b"", b"\n", train["x"][0] + b"q"]
    bits = trees.bits(slabs.Slab(asked, np.arange(len(asked))))
    for i, text in enumerate(asked):
        for k, name in enumerate(trees.languages):
            assert math.isclose(bits[i, k], brute_ppm(train[name], text), rel_tol=1e-5, abs_tol=1e-6)


def test_code_lengths_by_slots_and_by_search(monkeypatch):
    slab = slabs.Slab([b"the cat sat on the mat", b"", b"zzz", "naïve".encode()], np.arange(4))
    gram, _ = langid._grams(slab, langid.ORDER)
    key, n = np.unique(gram[:20], return_counts=True)
    trees = langid.Trees(["x", "y"], np.concatenate([key, key[:5]]), np.repeat([0, 1], [len(key), 5]),
                         np.concatenate([n, n[:5]]).astype(float))
    fast = trees.bits(slab)
    trees.slot_at[:] = -1
    assert np.allclose(fast, trees.bits(slab), atol=1e-4)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_ppm_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.99


def test_every_language_and_whole_texts_are_learned(spark):
    rng = random.Random(7)
    names = [f"l{i:02}" for i in range(70)]
    alphabets = {n: "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for n in names}

    def words(name, n):
        return " ".join("".join(rng.choices(alphabets[name], k=5)) for _ in range(n))
    # Where two learned texts are long, what is typical of the language comes late in them.
    head = "same in all of them " * 1000
    known = [(i, words(n, 400) if i % 10 else head + words(n, 400), n, "s") for i, n in enumerate(names)]
    asked = [(1000 + i, words(n, 40), None, "s") for i, n in enumerate(names)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, known + asked), F.col("doc_id") < 1000).collect()}
    assert [got[1000 + i] for i in range(70)] == names


def test_language_odd(spark, odd, empty):
    rows = {r.doc_id: r for r in langid.identify(odd).collect()}
    for d in (3, 4, 5, 9):
        assert (rows[d].lang_pred, rows[d].score) == ("und", 0)
    assert rows[7].lang_pred == "fr" and rows[1].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(odd).count() == len(ODD) and langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not {3, 4, 5, 9} & {r.doc_id for r in kept.collect()}


# 9

def brute_repeats(docs, n=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - n + 1):
            w = raw[i:i + n]
            if w in seen:
                gone[i:i + n] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] and len(raw) > 0))
        out[d] = (len(raw), int(gone.sum()), spans, sha256(kept).hexdigest())
    return out


def test_repeated_strings(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abc de\né", k=rng.randint(50, 700))) for _ in range(12)]
    docs = []
    for i in range(80):
        parts = [rng.choice(base)[rng.randint(0, 200):] if rng.random() < .7 else
                 "".join(rng.choices("xyz w", k=rng.randint(0, 90))) for _ in range(rng.randint(0, 4))]
        docs.append((i, "".join(parts)))
    docs += [(100, "ab" * 300), (101, "ba" * 80), (102, "z" * 99), (103, "z" * 100), (104, "z" * 101), (105, None), (106, base[0]), (107, base[0])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute_repeats(docs)


def test_repeated_strings_in_small_units(spark, monkeypatch):
    monkeypatch.setattr(substrings, "UNIT_ROWS", 3)
    docs = [(i, (PROSE * 3)[i:] + str(i) * 30 + PROSE) for i in range(12)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in substrings.remove_repeats(frame(spark, docs)).collect()}
    assert got == brute_repeats(docs)


def test_repeated_strings_odd(spark, odd, empty):
    rows = substrings.remove_repeats(odd, keep_text=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) - 1         # rows that share a key are one document
    assert by[2].n_removed == len(PROSE) * 4 and by[1].n_removed < len(PROSE) * 4
    assert bytes(by[10].kept) == b"y" * 100 or by[10].n_removed == 70_000 - 1
    assert by[None].n_removed == 0 and bytes(by[None].kept) == b"no key here"
    assert by[3].n_bytes == 0 and by[8].n_spans == 1
    assert substrings.remove_repeats(empty).count() == 0


# 10

def test_quality_odd(spark, odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) and quality.judge(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and not by[3].kept
    assert by[8].n_repeat_words == 40_000 and by[8].base_failed
    assert by[12].n_words == 6 and by[12].word_chars == 13


def test_bad_hosts_lose_all(spark):
    good = "one two three four five six seven eight nine ten ".split()
    docs = [(i, " ".join(f"{w}{i}{k}" for k in range(6) for w in good), "en", f"h{i % 5}") for i in range(100)]
    docs += [(1000 + i, "short", "en", "bad") for i in range(60)] + [(2000, docs[0][1], "en", "bad")]
    rows = {r.doc_id: r.kept for r in quality.judge(frame(spark, docs)).collect()}
    assert all(rows[i] for i in range(100)) and not rows[2000]


def test_a_host_goes_by_any_rule(spark):
    """Symbols, repeated lines and scraps of words drop no document, but a host full of them."""
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in range(30)]
    clean = " ".join(words)
    letters = random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=400)
    bad = {"marks": " ".join("#|" + w for w in words), "scraps": " ".join(letters),
           "lines": "\n".join(words[:90] + ["the same"] * 10)}
    docs = [(i, clean, "en", f"h{i % 8}") for i in range(160)]
    for at, (host, text) in enumerate(bad.items()):
        docs += [(1000 * (at + 1) + i, text, "en", host) for i in range(40)] + [(5000 + at, clean, "en", host)]
    docs += [(9000 + i, None if i % 2 else clean, "en", None) for i in range(4)]
    rows = {r.doc_id: r for r in quality.judge(frame(spark, docs)).collect()}
    assert all(rows[i].kept for i in range(160)) and rows[9000].kept and not rows[9001].kept
    assert [rows[5000 + at].host_rule for at in range(3)] == ["symbols", "fragments", "dup_lines"]
    assert not any(rows[5000 + at].kept or rows[5000 + at].base_failed for at in range(3))
    assert not rows[1000].base_failed and not rows[3000].base_failed and rows[1000].host_symbols_failed == 40


# the pipeline

def test_pipeline(spark, odd):
    import corpus_pipeline as cp
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    out = cp.run(spark, SF)
    assert "ids" in out.columns and out.count() > 0
    docs = odd
    for _, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if "text" in docs.columns:
            assert docs.columns == before.columns
    kept = {r.doc_id for r in docs.collect()}
    assert 1 in kept and not {2, 3, 4, 5, 9} & kept


def test_pipeline_on_an_empty_table(spark, empty):
    import corpus_pipeline as cp
    docs = empty
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
