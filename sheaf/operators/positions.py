"""WIN1: contiguous 0-based positions over a declared order, without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task. Here the order is cut into ranges whose bounds
are constants, so that every evaluation cuts alike and nothing has to be stored:

1. the order keys of a bounded sample (the rows of the smallest key hash) give the bounds;
2. a second pass over the keys alone counts the rows of each range (one number a range comes to the driver);
3. each row is numbered within its range by a window over (range, keys) and gets the count of all ranges before added.

Only the last pass reads whole rows, and shuffles them once. A lost executor costs what it held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import col_or_lit, long_array

#: Sampled keys per range.
PER_RANGE = 50


def range_bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 ascending key tuples that cut ``keys`` into ranges of about one size."""
    names = keys.columns
    some = keys.distinct().orderBy(F.xxhash64(*names), *names).limit(PER_RANGE * ranges)
    rows = [tuple(r) for r in some.orderBy(*names).collect()]
    step = max(1, len(rows) // ranges)
    return rows[step::step][: ranges - 1]


def range_number(keys: Sequence[Column], types: Sequence, bounds: Sequence[tuple]) -> Column:
    """How many bounds are at or below a row's keys (nulls first): first among every k-th bound, then among k."""
    if not bounds:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(keys))]
    key = F.struct(*(k.alias(n) for k, n in zip(keys, names)))
    as_struct = lambda b: F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(b, types, names)))
    k = max(1, round(len(bounds) ** 0.5))
    coarse, all_bounds = F.array(*map(as_struct, bounds[k - 1 :: k])), F.array(*map(as_struct, bounds))
    below = lambda b: b <= key
    whole = F.size(F.filter(coarse, below)) * k
    return whole + F.size(F.filter(F.slice(all_bounds, whole + 1, F.lit(k)), below))


def with_position(df: DataFrame, order_by: Sequence, name: str = "idx", num_partitions: int | None = None,
                  start: tuple[str, Column] | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ascending ``order_by`` order, nulls first.

    ``start`` = (column name, weight) also adds the sum of the weights of all rows before: where the rows that
    each row will give begin, known before they are made. ``order_by`` should be unique for a reproducible
    numbering: ties get some consecutive numbers, and rows of one key stand in one range. ``df`` is evaluated three times, twice for its
    keys only; store it first if that is dear. The number of ranges is ``num_partitions`` or four a shuffle partition.
    """
    ranges = num_partitions or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [col_or_lit(c) for c in order_by]
    if start:
        df = df.withColumn(start[0], start[1].cast("long"))
    keys = df.select(*(c.alias(f"k{i}") for i, c in enumerate(cols)))
    types = [f.dataType for f in keys.schema]
    ranged = df.withColumn("_range", range_number(cols, types, range_bounds(keys, ranges)))
    sums = [F.count(F.lit(1)).alias("rows")] + ([F.coalesce(F.sum(start[0]), F.lit(0)).alias("weight")] if start else [])
    counts = {r["_range"]: r for r in ranged.groupBy("_range").agg(*sums).collect()}
    last = max(counts, default=0) + 1

    def offsets(what: str) -> Column:
        """What lies before a row's range, from a constant array."""
        before, total = [], 0
        for k in range(last):
            before.append(total)
            total += counts[k][what] if k in counts else 0
        return F.get(long_array(before), F.col("_range"))

    window = Window.partitionBy("_range").orderBy(*cols)
    out = ranged.withColumn(name, offsets("rows") + F.row_number().over(window) - 1)
    if start:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(start[0], offsets("weight") + F.coalesce(F.sum(start[0]).over(earlier), F.lit(0)))
    return out.drop("_range")
