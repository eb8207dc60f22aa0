"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a factor of ``STEP``, and is split by a hash of the
ids into blocks of about ``BLOCK`` vectors, so neither equal lengths nor equal vectors gather in one task.

1. Every query meets the blocks of the longest vectors. Its k-th best score there bounds its k-th best of all.
2. A query with bound b and length |q| needs |p| cos(q, p) >= b / |q|. For a block with longest vector l the local
   cosine threshold is t = b / (|q| l). Above 1 the block is skipped, before the join if that holds for all
   queries of a query block. From ``COORDINATE`` on, candidates are found by the query's largest
   coordinates: a vector of cosine t or more lies in a known range there. Below, vectors are taken from the
   longest down to length b / |q|.
3. Products of the remaining pairs are computed in whole numbers, at most k of a query leave a block, and the
   best k of all are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import written

BLOCK, QUERY_BLOCK, STEP, COORDINATE, FOCUS = 4096, 512, 1.05, 0.7, 3
#: Pruning compares rounded values; it spares what lies this close to a bound.
SLACK = 1e-9


def _matrix(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of one list<struct<id, v>>."""
    ids, v = np.asarray(items.field("id")), items.field("v")
    return ids, np.asarray(v.flatten()).reshape(len(ids), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point while no sum can pass 2**53."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def survivors(q: np.ndarray, bound: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, vector rows, scores) of all pairs that reach their query's bound, maybe in several parts."""
    q_length, length = np.sqrt((q.astype(float) ** 2).sum(axis=1)), np.sqrt((p.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    p, length = p[order], length[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(bound > 0, bound / q_length, -np.inf)  # a bound of 0 or less prunes nothing
        local = needed / length[0]
    alive = ~(local > 1 + SLACK)
    by_coordinate = alive & (local >= COORDINATE)
    if by_coordinate.any():
        unit = p / np.maximum(length, 1e-300)[:, None]
        sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in np.flatnonzero(by_coordinate):
            t, direction = min(1.0, local[i] * (1 - SLACK)), q[i] / q_length[i]
            rows = None
            for f in np.argsort(-np.abs(direction))[:FOCUS].tolist():
                if f not in sorted_by:
                    at = np.argsort(unit[:, f], kind="stable")
                    sorted_by[f] = at, unit[at, f]
                at, values = sorted_by[f]
                half = math.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2))) + SLACK
                lo, hi = direction[f] * t - half, direction[f] * t + half
                # beyond t the range widens towards the direction itself
                lo, hi = (lo, 1.0) if direction[f] >= t else (lo, hi)
                lo, hi = (-1.0, hi) if direction[f] <= -t else (lo, hi)
                found = at[np.searchsorted(values, lo - SLACK) : np.searchsorted(values, hi + SLACK, "right")]
                rows = found if rows is None else np.intersect1d(rows, found, assume_unique=True)
            score = products(q[i : i + 1], p[rows])[0]
            good = score >= bound[i]
            yield np.full(good.sum(), i), order[rows[good]], score[good]
    rest = np.flatnonzero(alive & ~by_coordinate)
    if len(rest):
        upto = np.searchsorted(-length, -needed[rest] * (1 - SLACK), "right")
        score = products(q[rest], p[: upto.max()])
        r, c = np.nonzero((score >= bound[rest][:, None]) & (np.arange(upto.max()) < upto[:, None]))
        yield rest[r], order[c], score[r, c]


def _meet(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, vectors in zip(batch.column("queries"), batch.column("vectors")):
                bound = np.asarray(queries.values.field("bound"))
                (q_id, q), (p_id, p) = _matrix(queries.values), _matrix(vectors.values)
                for i, j, score in survivors(q, bound, p):
                    other = q_id[i] != p_id[j]
                    i, j, score = i[other], j[other], score[other]
                    best = np.lexsort((p_id[j], -score, i))
                    i, j, score = i[best], j[best], score[best]
                    first = np.searchsorted(i, i)
                    top = np.arange(len(i)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[i[top]]), pa.array(p_id[j[top]]), pa.array(score[top])], schema=schema)

    return run


_LOWEST = -(1 << 62)
#: Copies of the blocks of longest vectors, which every query meets first.
SALTS = 64


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k best of all other vectors for ids divisible by ``every``.

    Components become floor(``scale`` * x); the score is their inner product; ties go to the smaller id. Vectors
    that are null or empty, or hold a null or non-finite component, take no part, nor do rows without id. Rows that
    repeat an id with an equal vector count once, those with different vectors are
    ranked together, so an id may come once for each; an id is not its own neighbour. Vectors of different
    dimensions do not meet. Fewer than k candidates are all returned; an empty table gives an empty one. Other
    columns are not looked at.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long"))).dropDuplicates()
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = written(rows.withColumn("length", F.sqrt(squares)).withColumn("dim", F.size("v")).withColumn("bin", F.when(F.col("length") > 0, F.floor(F.log(F.greatest("length", F.lit(1.0))) / math.log(STEP))).otherwise(-1).cast("int")), "vectors")
    # lengths of whole-number vectors lie between 1 and 2**63: at most about 900 bins of a dimension
    bins = rows.groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    spread = rows.join(F.broadcast(bins.select("dim", "bin", "blocks")), ["dim", "bin"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = spread.groupBy("dim", "bin", "block").agg(F.collect_list(F.struct("id", "v")).alias("vectors"), F.max("length").alias("longest"))
    blocks = written(blocks.withColumn("no", F.xxhash64("dim", "bin", "block")), "blocks")
    order = Window.partitionBy("dim").orderBy(F.col("bin").desc(), "block")
    known = blocks.select("dim", "bin", "block", "no", "longest", F.size("vectors").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = rows.where(F.col("id") % every == 0)
    parts = asked.count() // QUERY_BLOCK + 1

    def meet(bounded: DataFrame, against: DataFrame, salts: int = 1) -> DataFrame:
        """Candidates of all queries (``id``, ``v``, ``dim``, ``length``, ``bound``) among the blocks listed.

        Few blocks are copied ``salts`` times, so that the query blocks that all meet them are spread.
        """
        needed = F.when(F.col("bound") > 0, F.col("bound") / F.col("length")).otherwise(float("-inf"))
        packed = bounded.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts))).groupBy("dim", "part").agg(F.collect_list(F.struct("id", "v", "bound")).alias("queries"), F.min(needed).alias("needed"))
        sent = packed.join(against.select("dim", "no", "longest"), "dim").where(F.col("longest") * (1 + SLACK) >= F.col("needed"))
        sent = sent.select("no", F.pmod("part", F.lit(salts)).cast("int").alias("salt"), "queries")
        held = blocks.select("no", "vectors") if salts == 1 else blocks.select("no", "vectors").join(against.select("no"), "no", "left_semi")
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return sent.join(held, ["no", "salt"]).select("queries", "vectors").mapInArrow(_meet(k), "query_id long, vec_id long, score long")

    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = meet(asked.withColumn("bound", F.lit(_LOWEST)), known.where(F.col("before") < 4 * k + 1), salts=min(parts, SALTS))
    bounds = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = written(asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(_LOWEST))), "queries")
    return meet(bounded, known).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
