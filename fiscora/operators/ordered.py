"""Work along a global order without ever sorting it in one task.

Three tools: dense keys, running sums over ordered values and exact
quantiles. Each splits the order into ranges first, so a group that holds a
third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from fiscora.session import hand_over

# Rows a range should hold, and the fewest bits of a range number.
RANGE_ROWS = 1_000_000
RANGE_BITS = 3
SKETCH_ACCURACY = 20_000
# Rows that tell about where a rank of all rows lies, and how far off that may be.
GUESS_ROWS = 1_000_000
GUESS_SLACK = 0.004


def surrogate_key(df: DataFrame, order_cols: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Dense unique bigint per row, numbered along ``order_cols``.

    ``order_cols`` must be unique, which makes the numbering repeatable. Rows
    are range-partitioned and sorted, and their place (partition, offset) is
    written with them: sampled range bounds cannot shift between counting the
    partitions and numbering the rows.
    """
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    placed = hand_over(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_place", F.monotonically_increasing_id()), "placed")
    # Bit layout of monotonically_increasing_id: partition above, row below bit 33.
    part = F.shiftright("_place", 33)
    row = F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (placed.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part", "left")
            .withColumn(out, (F.col("_before") + row + start).cast("bigint"))
            .select(*df.columns, out))


def range_number(value: Column, bounds: Column, bits: int) -> list[Column]:
    """Steps of a binary search for the number of sorted ``bounds`` below ``value``.

    To be applied one after the other to a column ``_range`` that starts at 0.
    """
    step = 1 << (bits - 1)
    steps = []
    while step:
        place = F.col("_range")
        steps.append(place + F.when(value > F.get(bounds, place + (step - 1)), step).otherwise(0))
        step >>= 1
    return steps


def range_bits(rows: int) -> int:
    """Bits that number enough ranges for ``rows``, so that ranges stay the same size."""
    return max(RANGE_BITS, (rows // RANGE_ROWS).bit_length())


def split_ranges(df: DataFrame, value: str, bits: int,
                 source: DataFrame | None = None) -> DataFrame:
    """Add ``_range``: which of 2**bits equally filled value ranges a row is in.

    Range limits come from one mergeable sketch (bounded size) as a scalar
    subquery. They are a function of the data alone, so recomputed tasks agree.
    """
    cuts = 1 << bits
    sketch = (source or df).agg(F.percentile_approx(
        F.col(value).cast("double"), [i / cuts for i in range(1, cuts)],
        max(SKETCH_ACCURACY, 16 * cuts)).alias("cuts"))
    df = df.withColumn("_cuts", sketch.scalar()).withColumn("_range", F.lit(0))
    for step in range_number(F.col(value).cast("double"), F.col("_cuts"), bits):
        df = df.withColumn("_range", step)
    return df.drop("_cuts")


def running_sums(df: DataFrame, value: str, sums: Mapping[str, Column],
                 by: Sequence[str] = (), descending: bool = False,
                 bits: int | None = None) -> DataFrame:
    """Per distinct ``value`` (within ``by``): sums, and sums of all values before it.

    Output columns: ``by``, ``value``, each name of ``sums`` and ``<name>_before``.
    Equal values are merged before anything is ordered, and the merged values
    are written once: finding the ranges, their totals and the sums inside them
    all read that small table instead of computing ``df`` again.
    """
    by = list(by)
    names = list(sums)
    grouped = hand_over(
        df.groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()]), "merged")
    placed = split_ranges(grouped, value, range_bits(grouped.count()) if bits is None else bits)

    def sign(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    totals = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in names])
    # At most 2**bits rows per group.
    earlier = (Window.partitionBy(*by).orderBy(sign("_range"))
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_offset_range"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in names])
    if not by:
        offsets = F.broadcast(offsets)
    inside = (Window.partitionBy(*by, "_range").orderBy(sign(value))
              .rowsBetween(Window.unboundedPreceding, -1))
    match = F.col("_range") == F.col("_offset_range")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    local = placed.withColumns(
        {f"_{n}_local": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
    return local.join(offsets, match, "left").select(
        *by, value, *names,
        *[(F.col(f"_{n}_offset") + F.col(f"_{n}_local")).alias(f"{n}_before") for n in names])


def exact_quantile(df: DataFrame, cols: Sequence[str], q: float, by: Sequence[str] = (),
                   method: str = "interpolate", keep_empty: bool = False) -> DataFrame:
    """Exact quantile per column (and group): rows (by..., column_name, n, value).

    ``df`` is evaluated once. Without groups its columns are written, a guess tells
    between which two values the rank lies, and all others are only counted; if the
    counts show that a rank lies elsewhere, or with groups, all values are kept:
    each distinct (column, group, value) becomes one
    row with its count, and these rows are sorted by ranges and written. Counts
    per group and range tell in which range a rank lies, and only such ranges
    are ordered, so a hot group costs one or two of its ranges. ``method`` is
    ``interpolate`` (linear between neighbours) or ``element`` (the lower one).
    NULL and NaN are no values; a NULL group is a group. Groups without any
    value are left out unless ``keep_empty``; without rows there are no groups.
    """
    keys = list(by) + ["column_name"]
    ranges = _value_counts(df, list(cols), list(by)) if by else _near_rank(df, list(cols), q)
    held = ranges.groupBy(*keys, "_range").agg(F.sum("_c").alias("_in_range"))
    # One row per group, and one more for each range limit inside a group.
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    rank = (F.col("n") - 1) * F.lit(float(q))
    low, high = F.floor(rank), F.ceil(rank)
    held = held.withColumns({"n": F.sum("_in_range").over(group),
                             "_before": F.coalesce(F.sum("_in_range").over(earlier), F.lit(0))})
    wanted = held.filter((F.col("_before") <= high) & (low < F.col("_before") + F.col("_in_range")))
    wanted = wanted.select(*[F.col(c).alias(f"_{c}") for c in keys],
                           F.col("_range").alias("_in"), "n", "_before")
    inside = (Window.partitionBy(*keys, "_range").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (ranges.filter(F.col("_c") > 0)
              .join(wanted, _same_keys(keys) & (F.col("_range") == F.col("_in")))
              .withColumn("_first", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0))))

    def at(place: Column) -> Column:
        here = (F.col("_first") <= place) & (place < F.col("_first") + F.col("_c"))
        return F.max(F.when(here, F.col("_v")))

    found = placed.groupBy(*keys, "n").agg(at(low).alias("_v0"), at(high).alias("_v1"))
    v0, v1 = F.col("_v0"), F.col("_v1")
    value = v0 if method == "element" else v0 + (v1 - v0) * (rank - low)
    values = found.select(*keys, "n", value.cast("double").alias("value"))
    if not keep_empty:
        return values
    empty = held.groupBy(*keys).agg(F.max("n").alias("n")).filter("n = 0")
    return values.unionByName(empty.withColumn("value", F.lit(None).cast("double")))


def _near_rank(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """As ``_value_counts`` without groups, but only with the values around the rank.

    Those below and above are one row each. A column's limits are guessed from a part of
    the rows; the counts are exact, and tell whether the rank is between them.
    """
    places = [f"_x{i}" for i in range(len(cols))]
    held = hand_over(df.select(*[
        F.expr(f"nullif(cast(`{c}` AS double), double('NaN'))").alias(p) for c, p in zip(cols, places)]), "columns")
    rows = max(held.count(), 1)
    some = held.sample(GUESS_ROWS / rows, seed=42) if rows > 2 * GUESS_ROWS else held
    off = 3 / SKETCH_ACCURACY + 30 / rows + (GUESS_SLACK if some is not held else 0)
    limits = some.agg(*[F.percentile_approx(p, [max(0.0, q - off), min(1.0, q + off)], SKETCH_ACCURACY).alias(p)
                        for p in places]).first()
    entries = []
    for c, p in zip(cols, places):
        low, high = (F.lit(x).cast("double") for x in limits[p] or (None, None))
        at = F.when(F.col(p) < low, 0).when(F.col(p) > high, 2).otherwise(1)
        entries.append(F.struct(F.lit(c).alias("column_name"), F.col(p).alias("_own"), at.alias("_range")))
    counts = hand_over(
        held.select(F.inline(F.array(*entries)))
        .groupBy("column_name", F.when(F.col("_range") == 1, F.col("_own")).alias("_v"), "_range")
        .agg(F.count("_own").alias("_c")), "values")
    # Three rows per column.
    found: dict[str, list[int]] = {c: [0, 0, 0] for c in cols}
    for row in counts.groupBy("column_name", "_range").agg(F.sum("_c").alias("n")).collect():
        found[row["column_name"]][row["_range"]] = row["n"]
    for below, near, above in found.values():
        rank = (below + near + above - 1) * float(q)
        if rank >= 0 and not below <= floor(rank) <= ceil(rank) < below + near:
            return _value_counts(held.toDF(*cols), cols, [])
    return counts


def _value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows (by..., column_name, _v, _c, _range): distinct values with counts, written in order.

    Equal values are merged in the tasks that read them. The merged rows are
    what the range limits are sampled from, so ``df`` itself is read once. A
    NULL stands for rows without a value and counts 0.
    """
    keys = [*by, "column_name"]
    entries = F.array(*[F.struct(
        F.lit(c).alias("column_name"),
        F.expr(f"nullif(cast(`{c}` AS double), double('NaN'))").alias("_v")) for c in cols])
    merged = (df.select(*by, F.inline(entries)).groupBy(*keys, "_v")
              .agg(F.count("_v").alias("_c")))
    order = [F.col(c).asc_nulls_first() for c in (*keys, "_v")]
    return hand_over(merged.repartitionByRange(*order)
                     .withColumn("_range", F.spark_partition_id()), "values")


def _same_keys(keys: Sequence[str]) -> Column:
    """Join condition key = _key, NULL being a key like any other."""
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return same


def one_row(quantiles: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Turn global (column_name, value) rows into one row with a column each."""
    return quantiles.agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"{prefix}{c}")
        for c in cols])


def _value_ranges(df: DataFrame, order: str, bits: int) -> DataFrame:
    """Add the range of the numeric or time column ``order``."""
    dtype = dict(df.dtypes)[order]
    as_number = F.col(order)
    if dtype == "timestamp_ntz":
        as_number = F.unix_micros(F.col(order).cast("timestamp"))
    elif dtype == "timestamp":
        as_number = F.unix_micros(order)
    elif dtype == "date":
        as_number = F.unix_date(order)
    number = as_number.cast("double")
    return split_ranges(df.withColumn("_order", number), "_order", bits, source=df.select(number.alias("_order")))


def lag_within(df: DataFrame, key: str, order: str, col: str, out: str, n: int = 1,
               tie_breaks: Sequence[str] = (), bits: int | None = None) -> DataFrame:
    """Value of ``col`` ``n`` rows earlier in the same ``key``, also for hot keys.

    A key's rows are split at global range limits; the first row of a range
    looks up the last row of the key's range before it. Rows must be totally
    ordered by ``order`` and ``tie_breaks`` within a key. With tie-breaks a key
    may have many rows of one ``order`` value, so limits are rows of the whole
    order, of any types, and each row's range is written with it. Without,
    ``order`` is a number or time whose limits come from a sketch.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if bits is None:
        bits = range_bits(df.select(key).count())
    if tie_breaks:
        ranged = hand_over(df.repartitionByRange(
            1 << bits, *[F.col(c).asc_nulls_first() for c in (order, *tie_breaks)])
            .withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        ranged = _value_ranges(df, order, bits)
    sort = [F.col(c).asc() for c in (order, *tie_breaks)]
    within = Window.partitionBy(key, "_range").orderBy(*sort)
    latest = Window.partitionBy("_key", "_tail_range").orderBy(F.desc("_at"))
    # The last n rows of each (key, range); Spark prunes to n before the shuffle.
    tails = (ranged.select(
        F.col(key).alias("_key"), F.col("_range").alias("_tail_range"), F.col(col).alias("_v"),
        F.struct(*[F.col(c) for c in (order, *tie_breaks)]).alias("_at"))
        .withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") <= n)
        .groupBy("_key", "_tail_range")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_tail")))
    # At most 2**bits rows per key; n ranges hold at least n rows.
    earlier = Window.partitionBy("_key").orderBy("_tail_range").rowsBetween(-n, -1)
    before = tails.select("_key", "_tail_range",
                          F.flatten(F.collect_list("_tail").over(earlier)).alias("_before"))
    placed = ranged.withColumns(
        {"_nth": F.row_number().over(within), "_local": F.lag(col, n).over(within)})
    joined = placed.join(before, F.col(key).eqNullSafe(F.col("_key"))
                         & (F.col("_range") == F.col("_tail_range")), "left")
    place = F.size("_before") - (n + 1 - F.col("_nth"))
    carried = F.get("_before", place.cast("int"))["_v"]
    return joined.withColumn(
        out, F.when(F.col("_nth") > n, F.col("_local")).otherwise(carried)).select(*df.columns, out)
