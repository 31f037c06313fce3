"""Fill-in-middle against a plain version, and back."""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fiscora.llm import infill
from fiscora.llm.slabs import Slab
from tests.llm.conftest import ODD

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[5]))


MORE = [(i, t, "en", "s") for i, t in enumerate(
    ["<P", "a <S> b", "x <M>", "<<P>", "P> <", "é <S", "日本 語🎉 \t", "\n\n", "a\x0bb", "\x00 \x1f", "< P >",
     "🎉" * 500 + " é", " lead", "trail "] * 12, 100)]


def test_against_plain_version(spark, odd):
    from tests.llm.test_llm import frame
    docs = odd.unionByName(frame(spark, MORE))
    got = infill.transform(docs)
    assert set(got.columns) == set(odd.columns) - {"text"} | {"n", "form", "prefix_chars", "middle_chars", "output"}
    rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    want = [plain(d, t) for d, t, *_ in ODD + MORE]
    assert by_row(map(tuple, rows)) == by_row(want)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in back) == sorted(
        ((d or -1), t or "") for d, t, *_ in ODD + MORE)


def test_clashing_names_rates_and_empty(spark, odd, empty):
    named = odd.select("doc_id", "text", F.lit("x").alias("h1"), F.lit("y").alias("form"), F.lit(1).alias("output"))
    rows = infill.transform(named, rate=100, spm_rate=0).collect()
    assert {r.form for r in rows} == {"plain", "psm"} and {r.h1 for r in rows} == {"x"}
    assert {r.form for r in infill.transform(named, rate=0).collect()} == {"plain"}
    assert infill.transform(empty).count() == 0


def test_text_longer_than_a_slab(spark):
    from tests.llm.test_llm import frame
    text = "wörd " * 600_000
    docs = frame(spark, [(k, text) for k in range(6)])
    rows = infill.transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert by_row(map(tuple, rows)) == by_row([plain(k, text) for k in range(6)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_exception_index(texts):
    texts = [t.encode("utf8", "ignore").decode() for t in texts]
    slab = Slab([t.encode() for t in texts], np.arange(len(texts)))
    index = infill.Exceptions(slab.data)
    whole = "\n" + "\n".join(texts) + "\n"
    place = np.cumsum([0] + [len(c.encode()) for c in whole[:-1]])
    assert index.points(place).tolist() == list(range(len(whole)))
    assert index.bytes(np.arange(len(whole))).tolist() == place.tolist()
