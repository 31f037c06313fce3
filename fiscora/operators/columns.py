"""Projections, renames and row predicates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fiscora.functions import numeric

# Fixed value: characters a layer table may not carry in a column name.
FORBIDDEN_NAME_CHARS = r"[ ,;{}()\n\t=]+"


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One projection for all names; two columns must not end up as one."""
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, names):
        if not new:
            raise ValueError(f"column {old!r} has no usable characters in its name")
        other = seen.setdefault(new.lower(), old)
        if other is not old:
            raise ValueError(f"columns {other!r} and {old!r} both become {new!r}")
    return df.toDF(*names)


def sanitize_columns_basic(df: DataFrame) -> DataFrame:
    """Forbidden characters become underscores; case stays."""
    return _renamed(df, [re.sub(FORBIDDEN_NAME_CHARS, "_", c).strip("_") for c in df.columns])


def sanitize_columns_snake(df: DataFrame) -> DataFrame:
    """Lower-case snake names."""
    return _renamed(
        df, [re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_helpers(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def missing_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in cols if c not in present]


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    absent = missing_columns(df, cols)
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    return df


def filter_at_least(df: DataFrame, col: str, n: float) -> DataFrame:
    """Keep values of at least ``n``; NULL goes."""
    return df.filter(F.col(col) >= n)


def filter_positive_or_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a zero or negative value; unknown values stay."""
    for c in cols:
        df = df.filter((F.col(c) > 0) | F.col(c).isNull())
    return df


def filter_sql(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(predicate)


def filter_year_range(df: DataFrame, col: str, first: int | None = None,
                      last: int | None = None) -> DataFrame:
    if first is not None:
        df = df.filter(F.col(col) >= first)
    if last is not None:
        df = df.filter(F.col(col) <= last)
    return df


def filter_isin(df: DataFrame, col: str, values: Sequence[int]) -> DataFrame:
    return df.filter(F.col(col).isin(*values))


def cast_all(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    """Cast many columns at once; text that is no such value becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(dtype) for c in cols})


def coalesce_priority(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """First non-NULL column wins."""
    return df.withColumn(out, F.coalesce(*[F.col(c) for c in cols]))


def inf_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric.inf_to_null(c) for c in cols})


def with_params(df: DataFrame, params: DataFrame, columns) -> DataFrame:
    """Add columns that use a one-row table of fitted values.

    The row is fetched once, as a fitted model would be, and enters the plan
    as constants: the big side is neither joined nor shuffled, and later
    actions do not fit again. ``columns`` receives {name: constant column} and
    returns the columns to set.
    """
    rows = params.take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one row of fitted values, found {len(rows)}")
    values = {f.name: F.lit(rows[0][f.name]).cast(f.dataType) for f in params.schema.fields}
    return df.withColumns(columns(values))
