"""Quality rules per document, judged together with the record of its host.

Documents are measured and checked against rules; failures of every rule are
summed per host; each rule's host rates are shrunk with a beta prior fitted to
all hosts by moments; the verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import SPACE, fields, mix, record, slabs, starts_of, windows
from fiscora.session import hand_over

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50       # percent of words in repeated windows
MAX_SYMBOL_SHARE = 10       # percent of characters in words
WORDS_PER_DUP_LINE = 20     # fewer words than this for each repeated line
MIN_WORD_CHARS = 2          # mean length of a word
# A whole host goes if a rule's shrunk failure rate is above both of these: a
# share of its documents, and so many deviations of the rule's prior over its mean.
MAX_HOST_RATE = 0.5
MAX_DEVIATIONS = 3.0
MAX_LIMIT = 0.9             # a rate above this is too high whatever the prior
REPEAT_WINDOW = 3
SYMBOLS = "#*$%&|<>"

_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over items: equal to an earlier item of the owner; found twice or more there."""
    order = np.lexsort((hashes, owner))     # stable: equal items stay in text order
    o, h = owner[order], hashes[order]
    same = np.zeros(len(o), bool)
    same[1:] = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, any_ = np.zeros(len(o), bool), np.zeros(len(o), bool)
    later[order], any_[order] = same, twice
    return later, any_


def _measure(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for slab in slabs(batch):
            n = len(slab)
            first, last, owner = slab.words()
            word_at = starts_of(owner, n)
            # Code points inside words: bytes that neither separate nor continue a character.
            point = np.zeros(len(slab.data) + 1, np.int64)
            np.cumsum(~SPACE[slab.data] & ((slab.data & 0xC0) != 0x80), out=point[1:])
            symbol = np.zeros(len(slab.data) + 1, np.int64)
            np.cumsum(_SYMBOL[slab.data], out=symbol[1:])
            line_end = np.flatnonzero(slab.data == 10)
            line_from, line_to = line_end[:-1] + 1, line_end[1:]
            line_owner = np.searchsorted(slab.end, line_to)
            wordy = np.searchsorted(first, line_to) > np.searchsorted(first, line_from)
            line_from, line_to, line_owner = (x[wordy] for x in (line_from, line_to, line_owner))
            dup_line, _ = _repeats(line_owner, slab.hashes(line_from, line_to, False))
            grams, at = windows(slab.hashes(first, last, False), owner, REPEAT_WINDOW)
            _, repeated = _repeats(owner[at], grams)
            covered = np.zeros(len(first) + REPEAT_WINDOW, bool)
            for k in range(REPEAT_WINDOW):
                covered[at[repeated] + k] = True
            parts.append((
                np.diff(word_at), point[slab.end] - point[slab.start],
                symbol[slab.end] - symbol[slab.start],
                np.bincount(line_owner[dup_line], minlength=n),
                np.bincount(owner[covered[:len(first)]], minlength=n)))
        if parts:
            schema = pa.schema([(key, pa.int64()), *[(c.split()[0], pa.int64())
                                                     for c in _MEASURES.split(", ")]])
            yield record(schema, fields(batch, key), *map(np.concatenate, zip(*parts)))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key and the measures the rules need.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line) and n_repeat_words (words in windows
    of three words found twice or more). NULL counts as an empty text: all
    measures are 0. A repeated key gives one row for each of its rows.
    """
    frame = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(lambda it: _measure(it, "key"), f"key long, {_MEASURES}")


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_SHARE * n_words)


def rules() -> dict[str, Column]:
    """What counts against a host, by name. ``base`` also decides on the document itself."""
    n = F.col("n_words")
    return {"base": F.col("base_failed"),
            "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars"),
            "dup_lines": WORDS_PER_DUP_LINE * F.col("n_dup_lines") > n,
            "fragments": F.col("word_chars") < MIN_WORD_CHARS * n}


def host_verdicts(rows: DataFrame, checks: Mapping[str, Column], host: str = "host",
                  max_rate: float = MAX_HOST_RATE, deviations: float = MAX_DEVIATIONS) -> DataFrame:
    """Per host: documents, and for every check its failures and shrunk rate; the failed rule; the verdict.

    Each check has a beta prior of its own, fitted to the host rates by moments,
    each host weighted by its documents; hosts that do not differ more than
    chance allows get a prior so heavy that all share the overall rate.
    ``host_rule`` is the first check, in their order, by which the host goes. A
    NULL host is a host, a NULL check no failure. Failures are combined before
    rows move, so one host with a third of all documents costs one row per task.
    Without rows there are no hosts.
    """
    names = list(checks)
    hosts = rows.groupBy(host).agg(F.count("*").alias("host_docs"), *[
        F.count_if(check).alias(f"host_{name}_failed") for name, check in checks.items()])
    n = F.col("host_docs").cast("double")
    failed = {name: F.col(f"host_{name}_failed").cast("double") for name in names}
    moments = hosts.agg(F.sum(n).alias("_n"), F.count("*").alias("_hosts"), *[c for name, f in failed.items() for c in (
        F.sum(f).alias(f"_f_{name}"), F.sum(f * f / n).alias(f"_ff_{name}"))])
    prior = []
    for name in names:
        mean = F.col(f"_f_{name}") / F.col("_n")
        # Between-host variance: what is left of the spread after binomial noise.
        spread = F.col(f"_ff_{name}") / F.col("_n") - mean * mean
        noise = mean * (1 - mean) * F.col("_hosts") / F.col("_n")
        between = F.greatest(spread - noise, F.lit(1e-9))
        strength = F.greatest(mean * (1 - mean) / between - 1, F.lit(1e-3))
        prior += [mean.alias(f"_mean_{name}"), strength.alias(f"_strength_{name}")]

    def rate(name: str) -> Column:
        strength = F.col(f"_strength_{name}")
        return (failed[name] + F.col(f"_mean_{name}") * strength) / (n + strength)

    def limit(name: str) -> Column:
        mean = F.col(f"_mean_{name}")
        deviation = F.sqrt(mean * (1 - mean) / (F.col(f"_strength_{name}") + 1))
        return F.greatest(F.lit(float(max_rate)), F.least(mean + deviations * deviation, F.lit(MAX_LIMIT)))

    rule = F.coalesce(*[F.when(rate(name) > limit(name), F.lit(name)) for name in names])
    # The priors are one row.
    return hosts.join(F.broadcast(moments.select(*prior))).select(
        host, "host_docs", *[f"host_{name}_failed" for name in names],
        *[rate(name).alias(f"host_{name}_rate") for name in names],
        rule.alias("host_rule"), rule.isNull().alias("host_kept"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
          max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures, base verdict, host record and final verdict of every document.

    A document is kept if it passes the base rules itself and its host is kept;
    the host's record also counts rules() that alone drop no document.
    Empty and NULL texts fail (no words). Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.col(text).cast("string").alias("text"))
    measured = hand_over(
        base.mapInArrow(_measure_with_host, f"doc_id long, host string, {_MEASURES}")
        .withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words"))), "quality")
    verdicts = hand_over(host_verdicts(measured, rules(), max_rate=max_rate), "hosts")
    hosts = verdicts.withColumnRenamed("host", "_host")
    # Sized at run time: few hosts are broadcast, many are joined with split hot hosts.
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.drop("_host").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def _measure_with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _measure(iter([batch]), "doc_id"):
            yield pa.RecordBatch.from_arrays(
                [out.column(0), fields(batch, "host"), *out.columns[1:]],
                names=["doc_id", "host", *out.schema.names[1:]])


_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || chr(10) || lead(word) OVER o || chr(10) || lead(word, 2) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g
      WHERE gram IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
      SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
        length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
o AS (SELECT source, count(*)::DOUBLE AS n, [
        count(*) FILTER (base_failed), count(*) FILTER (100 * n_symbols > 10 * word_chars),
        count(*) FILTER (20 * n_dup_lines > n_words), count(*) FILTER (word_chars < 2 * n_words)] AS fs
      FROM b GROUP BY source),
h AS (SELECT source, n, unnest([0, 1, 2, 3]) AS k, unnest(fs)::DOUBLE AS f FROM o),
q AS (SELECT k, sum(f) / sum(n) AS mu, sum(f * f / n) / sum(n) AS ff, count(*) / sum(n) AS hn FROM h GROUP BY k),
s AS (SELECT k, mu, greatest(mu * (1 - mu) / greatest(ff - mu * mu - mu * (1 - mu) * hn, 1e-9) - 1, 1e-3) AS st FROM q),
j AS (SELECT source, n, k, f, (f + mu * st) / (n + st)
        > greatest(0.5, least(mu + 3 * sqrt(mu * (1 - mu) / (st + 1)), 0.9)) AS bad FROM h JOIN s USING (k)),
v AS (SELECT source, any_value(n)::BIGINT AS host_docs, max(f) FILTER (k = 0)::BIGINT AS host_failed,
        ['base', 'symbols', 'dup_lines', 'fragments'][min(k) FILTER (bad) + 1] AS host_rule
      FROM j GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       host_docs, host_failed, host_rule, NOT base_failed AND host_rule IS NULL AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


@query("op10_host_quality", _SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_docs", F.col("host_base_failed").alias("host_failed"),
        "host_rule", "kept")
