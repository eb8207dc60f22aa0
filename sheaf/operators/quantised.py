"""VEC4: a stored index of product-quantised vectors for approximate top-k by inner product.

Building: cells are k-means centroids; what a vector differs from its centroid by is cut into ``parts`` runs, each of which is
replaced by the nearest of ``words`` codewords, so a vector of doubles becomes one byte a part. Centroids and codewords are
fitted on a bounded sample (``sample`` rows of the smallest id hash); then every row is encoded, in tasks. Equal vectors
are encoded once, under the smallest id.

Searching: a query visits its ``probes`` best cells. There it meets codes only: a task reads its codes where they lie, decodes
a few thousand of one cell at once and multiplies them with the queries that visit it (for runs of two numbers a part that is less
work than adding up a table entry a part). The ``short`` best per query are fetched and scored exactly, and their
equal vectors are counted in. Cells are never truncated.

An index is a folder of Parquet tables that any session can open:

* ``centroids`` (``cell``, ``vector``) and ``codebooks`` (``part``, ``word``, ``vector``): bounded by the arguments;
* ``codes`` (``cell``, ``cid``, ``code``): one row a distinct vector, sorted by cell;
* ``vectors`` (``cid``, ``vector``) and ``members`` (``rep``, ``cid``): every distinct vector, every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.operators import vectors as V
from sheaf.session import stored


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of a bounded sample: distinct starts, an empty cluster starts anew at a random row."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[rng.integers(len(x), size=(~full).sum())]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = np.argmax(x[lo : lo + 4096] @ centres.T - half, axis=1)
    return out


@dataclass(frozen=True)
class Quantiser:
    """Centroids (cells x dimensions) and codewords (parts x words x dimensions of a part)."""

    centroids: np.ndarray
    books: np.ndarray

    @property
    def pad(self) -> int:
        """Zeros that fill the last part."""
        return self.books.shape[0] * self.books.shape[2] - self.centroids.shape[1]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """rows x parts x dimensions of a part."""
        return np.pad(x, ((0, 0), (0, self.pad))).reshape(len(x), self.books.shape[0], self.books.shape[2])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (rows x parts, one byte each)."""
        cells = _nearest(x, self.centroids)
        rest = self.cut(x - self.centroids[cells])
        return cells, np.stack([_nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, cell: int, code: np.ndarray) -> np.ndarray:
        """What codes of one cell stand for: its centroid and their codewords."""
        return self.centroids[cell] + self.books[np.arange(len(self.books)), code].reshape(len(code), -1)[:, : self.centroids.shape[1]]


def fit(sample: np.ndarray, cells: int, parts: int, words: int, seed: int) -> Quantiser:
    rng = np.random.default_rng(seed)
    centroids = _means(sample, cells, rng)
    wide = -(-sample.shape[1] // parts)
    rest = np.pad(sample - centroids[_nearest(sample, centroids)], ((0, 0), (0, parts * wide - sample.shape[1]))).reshape(len(sample), parts, wide)
    books = np.zeros((parts, words, wide))
    for p in range(parts):
        found = _means(rest[:, p], words, rng)
        books[p, : len(found)] = found
        books[p, len(found) :] = found[0]  # fewer distinct runs than words
    return Quantiser(centroids, books)


def _vector(name: str):
    return F.col(name).cast("array<double>")


def _coded(quantiser: Quantiser):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                cells, codes = quantiser.encode(V._stack(pdf["vector"]))
                yield pd.DataFrame({"cell": cells, "cid": pdf["cid"], "code": [c.tobytes() for c in codes]})

    return run


def build_index(corpus: DataFrame, path: str, cells: int = 128, parts: int = 32, words: int = 256, sample: int = 20_000, seed: int = 7,
                c_id: str = "cid", c_vec: str = "cvec") -> None:
    """Fit the quantiser and write the index of every row of ``corpus`` to ``path``, replacing what is there.

    Rows with a null id, a null vector or null components are left out. Ids are unique. Vectors have one length, which
    ``parts`` need not divide. ``words`` is at most 256. At least one row is needed.
    """
    if not 1 <= words <= 256:
        raise ValueError("words must lie between 1 and 256: a code is one byte a part")
    rows = corpus.select(F.col(c_id).cast("long").alias("cid"), _vector(c_vec).alias("vector"))
    rows = stored(rows, "index-input")  # a filter on vectors that are still to be made would make them twice
    rows = rows.where("cid IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x))")
    rows.withColumn("key", F.xxhash64("vector")).write.mode("overwrite").parquet(f"{path}/rows")
    rows = rows.sparkSession.read.parquet(f"{path}/rows")
    some = rows.orderBy(F.xxhash64("cid"), "cid").limit(sample).select("vector").toPandas()["vector"]
    if not len(some):
        raise ValueError("no vectors to index")
    quantiser = fit(V._stack(some), cells, parts, words, seed)
    _save(rows.sparkSession, quantiser, path)
    _add(rows, quantiser, path, "overwrite")


def _save(spark: SparkSession, quantiser: Quantiser, path: str) -> None:
    centroids = [(k, c.tolist()) for k, c in enumerate(quantiser.centroids)]
    spark.createDataFrame(centroids, "cell long, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    books = [(p, w, v.tolist()) for p, book in enumerate(quantiser.books) for w, v in enumerate(book)]
    spark.createDataFrame(books, "part int, word int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")


def _add(rows: DataFrame, quantiser: Quantiser, path: str, mode: str) -> None:
    # one row a vector: grouped by its hash and itself; the smallest id stands for all
    reps = rows.groupBy("key", "vector").agg(F.min("cid").alias("cid")).select("cid", "vector")
    reps.write.mode(mode).parquet(f"{path}/vectors")
    spark = rows.sparkSession
    reps = spark.read.parquet(f"{path}/vectors")
    reps.mapInPandas(_coded(quantiser), "cell long, cid long, code binary").repartitionByRange("cell", "cid").sortWithinPartitions("cell", "cid").write.mode(mode).parquet(f"{path}/codes")
    keys = reps.select(F.col("cid").alias("rep"), F.xxhash64("vector").alias("key"), F.col("vector").alias("same"))
    rows.join(keys, (rows["key"] == keys["key"]) & (rows["vector"] == keys["same"])).select("rep", "cid").write.mode(mode).parquet(f"{path}/members")


@dataclass(frozen=True)
class Index:
    quantiser: Quantiser
    codes: DataFrame
    vectors: DataFrame
    members: DataFrame


def open_index(spark: SparkSession, path: str) -> Index:
    """An index from storage; only the centroid and codeword tables are read now."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()["vector"]
    books = spark.read.parquet(f"{path}/codebooks").orderBy("part", "word").toPandas()
    shape = books["part"].max() + 1, books["word"].max() + 1, -1
    quantiser = Quantiser(V._stack(centroids), V._stack(books["vector"]).reshape(shape))
    return Index(quantiser, *(spark.read.parquet(f"{path}/{t}") for t in ("codes", "vectors", "members")))


def _code_rows(quantiser: Quantiser, probes: int):
    """``meeting`` for ``vectors.scanned``: what the codes of a cell stand for meets the queries that visit the cell."""

    def visits(x: np.ndarray) -> np.ndarray:
        half = (quantiser.centroids**2).sum(axis=1) / 2
        return np.argsort(half - x @ quantiser.centroids.T, axis=1, kind="stable")[:, :probes]

    def meeting(vectors: np.ndarray):
        visitors = V.in_cells(visits(vectors))

        def meet(nearest: V.Nearest, batch: pa.RecordBatch) -> None:
            cells, cid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "cid"))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(cid), -1)
            for cell, own in V.in_cells(cells[:, None]).items():
                if cell in visitors:
                    for lo in range(0, len(own), nearest.ROWS):
                        some = own[lo : lo + nearest.ROWS]
                        nearest.meet(quantiser.decode(cell, code[some]), cid[some], visitors[cell])

        return meet

    return meeting


def index_top_k(queries: DataFrame, index: Index, k: int, probes: int = 12, short: int = 40, q_id: str = "qid", q_vec: str = "qvec") -> DataFrame:
    """(``qid``, ``rank``, ``cid``, ``score``): about the k best rows per query; scores are exact.

    ``probes`` cells are visited by codes, ``short`` (at least k) vectors a query are scored. Equal vectors rank by id, as
    many as k of them. Queries without a vector get no rows; a query whose cells hold fewer than k rows gets fewer.
    """
    q = stored(queries.select(F.col(q_id).alias("qid"), _vector(q_vec).alias("qvec")).where("qvec IS NOT NULL"), "asked")
    near = V.scanned(q, index.codes, max(short, k), _code_rows(index.quantiser, probes)).select("qid", "cid")
    exact = near.join(index.vectors, "cid").join(q, "qid").select("qid", F.col("cid").alias("rep"), V.dot("qvec", "vector").alias("score"))
    best = V.rank_candidates(exact.withColumnRenamed("rep", "cid"), k, dedupe=False).select("qid", F.col("cid").alias("rep"), "score")
    first = Window.partitionBy("rep").orderBy("cid")
    members = index.members.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    return V.rank_candidates(best.join(members, "rep").select("qid", "cid", "score"), k, dedupe=False)
