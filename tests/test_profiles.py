"""Merged sketches against the exact figures."""

import random

from pyspark.sql import functions as F

from sheaf.operators import profiles as P


def test_merged_sketches_keep_their_bounds(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k % 23, int(rng.paretovariate(1.1)), f"n{rng.randint(0, 4000)}") for k in range(60_000)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "shard int, length long, name string")
    path = str(tmp_path / "shards")
    for part in (df.where("shard < 10"), df.where("shard >= 10")):
        P.sketches(part, F.col("shard"), F.col("length"), F.col("name")).write.mode("append").parquet(path)
    shards = spark.read.parquet(path)
    assert shards.count() == 24
    got = P.merged(shards, (0.1, 0.5, 0.9, 0.999)).first()
    lengths = sorted(x for _, x, _ in rows if x is not None)
    assert (got.n, got.most) == (60_000, lengths[-1]) and abs(got.mean - sum(lengths) / 60_000) < 1e-9
    for q, value in got.quantiles:
        below, upto = sum(x < value for x in lengths), sum(x <= value for x in lengths)
        assert below - P.rank_error() * 60_000 <= q * 60_000 <= upto + P.rank_error() * 60_000
    names = len({n for _, _, n in rows if n})
    assert abs(got.distinct - names) <= 4 * P.distinct_error() * names + 1


def test_no_shard_and_shards_without_lengths(spark):
    none = spark.createDataFrame([(1, None, None)], "shard int, length long, name string")
    for rows in (none, none.limit(0)):
        got = P.merged(P.sketches(rows, F.col("shard"), F.col("length"), F.col("name"))).first()
        assert got.n == 0 and got.mean is None and all(q.length is None for q in got.quantiles)
