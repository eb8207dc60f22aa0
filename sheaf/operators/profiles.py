"""JOB9 / AGG3 over stored shards: mergeable sketches of lengths and names.

A profile of a corpus that grows by shards need not read the old ones again: each shard keeps one row with its exact
count, sum and maximum, a KLL sketch of its lengths and an HLL sketch of its distinct values. Rows of any shards are merged
later by aggregation. Counts, sums and maxima stay exact; a merged quantile is off by at most ``rank_error`` in rank
(in 99 of 100 cases), a distinct count by a relative standard error of ``distinct_error``, however many shards there were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the KLL sketch (8 to 65,535), and the base-2 logarithm of the HLL sketch's size.
KLL, HLL = 800, 14


def rank_error(k: int = KLL) -> float:
    """The share of ranks that a KLL quantile of accuracy ``k`` is off by, at 99 % confidence."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = HLL) -> float:
    """The relative standard error of an HLL count."""
    return 1.04 / 2 ** (lg / 2)


def sketches(rows: DataFrame, shard: Column, length: Column, value: Column, k: int = KLL, lg: int = HLL) -> DataFrame:
    """(``shard``, ``n``, ``total``, ``most``, ``lengths``, ``names``), one row a shard; null lengths and values are left out."""
    return rows.select(shard.alias("shard"), length.cast("bigint").alias("length"), value.cast("string").alias("value")).groupBy("shard").agg(
        F.count("length").alias("n"), F.sum("length").alias("total"), F.max("length").alias("most"),
        F.kll_sketch_agg_bigint("length", k).alias("lengths"), F.hll_sketch_agg("value", lg).alias("names"))


def merged(shards: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row for all shards: ``n``, ``mean``, ``most`` (exact), ``distinct`` (estimated), and ``quantiles`` as (quantile, length) pairs.

    Shards without a length add nothing; without any shard the row holds 0 and nulls.
    """
    # an empty shard's sketch has no quantiles
    one = shards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"),
                     F.kll_merge_agg_bigint(F.when(F.col("n") > 0, F.col("lengths"))).alias("lengths"),
                     F.hll_sketch_estimate(F.hll_union_agg("names")).alias("distinct"))
    at = [F.struct(F.lit(q).alias("quantile"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias("length")) for q in quantiles]
    return one.select("n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"), "most", "distinct", F.array(*at).alias("quantiles"))
