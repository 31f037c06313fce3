"""Lookups and record matching.

No join carries a broadcast hint: dimension and reference tables may grow
with the data, so Spark decides from run-time sizes and splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def lookup_left(df: DataFrame, dim: DataFrame, pairs: Sequence[tuple[str, str]],
                keep: Sequence[str]) -> DataFrame:
    """Left equi-join on differently named keys; adds the ``keep`` columns of ``dim``.

    A key that ``dim`` repeats gives the smallest of its rows (by the ``keep``
    columns in order), so rows of ``df`` never multiply.
    """
    keys = [f"_r{i}" for i in range(len(pairs))]
    side = dim.select(*[F.col(right).alias(k) for k, (_, right) in zip(keys, pairs)],
                      F.struct(*keep).alias("_kept")).groupBy(*keys).agg(
        F.min("_kept").alias("_kept")).select(*keys, "_kept.*")
    cond = F.lit(True)
    for i, (left, _) in enumerate(pairs):
        cond = cond & (df[left] == side[f"_r{i}"])
    return df.join(side, cond, "left").select(*df.columns, *keep)


def _years_per_key(ref: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """One row per key with its distinct event years (a few dozen at most)."""
    return ref.filter(F.col(year).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_set(year)).alias("_years"))


def _event_for(years: Column, observed: Column | None) -> Column:
    """Earliest event after the observed year, else the latest event known."""
    latest = F.array_max(years)
    if observed is None:
        return latest
    return F.coalesce(F.array_min(F.filter(years, lambda y: y > observed)), latest)


def match_exact(df: DataFrame, ref: DataFrame, keys: Sequence[str], year: str, out: str,
                observed: str | None = None) -> DataFrame:
    """Left match on equal keys; duplicates in ``ref`` never multiply rows of ``df``."""
    found = df.join(_years_per_key(ref, keys, year), list(keys), "left")
    pick = _event_for(F.col("_years"), F.col(observed) if observed else None)
    return found.withColumn(out, pick).select(*df.columns, out)


def match_prefix(df: DataFrame, ref: DataFrame, prefix: str, state: str, year: str, out: str,
                 observed: str | None = None) -> DataFrame:
    """Left match on the first words of a name and the state."""
    return match_exact(df, ref, (prefix, state), year, out, observed)


def match_two_pass(df: DataFrame, ref: DataFrame, name: str, prefix: str, state: str,
                   year: str, out: str, observed: str | None = None) -> DataFrame:
    """Full-name match first, prefix match where that found nothing.

    Both lookups extend the same rows one after the other, so repeated
    filings of one key are not paired with each other.
    """
    first = match_exact(df, ref, (name, state), year, "_full", observed)
    both = match_prefix(first, ref, prefix, state, year, "_prefix", observed)
    return both.withColumn(out, F.coalesce("_full", "_prefix")).drop("_full", "_prefix")


def attach_keys(fact: DataFrame,
                dims: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Pick up surrogate ids by natural keys: ``dims`` holds (dimension, keys, id)."""
    for dim, keys, key_id in dims:
        fact = fact.join(dim.select(*keys, key_id), list(keys), "left")
    return fact


def attach_dim(fact: DataFrame, dim: DataFrame, key_id: str, attributes: Sequence[str]) -> DataFrame:
    """Dimension attributes by surrogate id."""
    return fact.join(dim.select(key_id, *attributes), key_id, "left")


def flag_membership(df: DataFrame, keys: DataFrame, pairs: Sequence[tuple[str, str]],
                    out: str) -> DataFrame:
    """1 where the row's key tuple occurs in ``keys``, else 0."""
    side = keys.select(*[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(pairs)]).distinct()
    side = side.withColumn("_hit", F.lit(1))
    cond = F.lit(True)
    for i, (left, _) in enumerate(pairs):
        cond = cond & (df[left] == side[f"_k{i}"])
    return df.join(side, cond, "left").withColumn(
        out, F.coalesce("_hit", F.lit(0))).select(*df.columns, out)


def match_rate(df: DataFrame, col: str) -> DataFrame:
    """Rows, unmatched rows and their share, in one pass."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(col).isNull()).alias("unmatched"),
        F.avg(F.col(col).isNull().cast("double")).alias("unmatched_share"))
