"""VEC1: an encoder trained on the corpus: token vectors from a randomised SVD of a token co-occurrence table.

Counting is the work that grows with the corpus, and it is a Spark aggregation: pairs of tokens at most ``window`` apart
are counted over all texts, for the ``vocabulary`` tokens that most texts hold. The counts become positive pointwise mutual
information, a sparse symmetric matrix of vocabulary x vocabulary that stays in Spark. Its leading eigenspace is found by
multiplying it with a thin random matrix and, after orthogonalisation, a few times with the result: each product is one
job over the stored rows. Only matrices of vocabulary x (dimensions + ``extra``) ever reach the driver or a task, whatever the
corpus (20,000 x 400 doubles are 64 MB).

A text's vector is the mean of its tokens' vectors, each weighted by how few texts hold the token, at unit length. So texts with
different words of like use lie close, which a hashed bag of words cannot show.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.vectors import l2_normalize, tokens
from sheaf.rules.dialect import java_pattern
from sheaf.session import stored

#: A text that matches has a token (``vectors.tokens``).
TOKEN = r"[\p{L}\p{N}]"
#: Tokens that are summed up at once in a task, and tokens whose pairs are counted at once.
SLICE, PAIRS = 1 << 15, 1 << 18


def vocabulary_table(texts: DataFrame, text_col: str, size: int) -> DataFrame:
    """(``token``, ``place``, ``df``): the tokens in most texts, ties by token; ``size`` rows at most."""
    held = texts.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rows = held.orderBy(F.desc("df"), "token").limit(size).collect()
    return texts.sparkSession.createDataFrame([(r["token"], k, r["df"]) for k, r in enumerate(rows)], "token string, place int, df long")


def _pairs(names: pa.Array, window: int):
    """``mapInArrow`` over token lists: pairs of tokens of the vocabulary at most ``window`` apart, counted a slice of tokens at a time."""
    shared, size = SparkSession.active().sparkContext.broadcast(names), max(1, len(names))

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat = pc.fill_null(pc.index_in(lists.flatten(), value_set=shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            for lo in range(0, len(flat), PAIRS):  # a pair belongs to the slice of its first token
                own, of = flat[lo : lo + PAIRS + window], row[lo : lo + PAIRS + window]
                some = []
                for k in range(1, window + 1):
                    n = max(0, min(PAIRS, len(own) - k))
                    i, j = own[:n], own[k : k + n]
                    met = (i >= 0) & (j >= 0) & (of[:n] == of[k : k + n])
                    some.append(i[met] * size + j[met])
                pairs, n = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pairs // size).astype(np.int32)), pa.array((pairs % size).astype(np.int32)), pa.array(n.astype(np.int64))], names=["i", "j", "n"])

    return run


def co_occurrences(texts: DataFrame, text_col: str, names: pa.Array, window: int) -> DataFrame:
    """(``i``, ``j``, ``n``): how often two tokens of the vocabulary stand at most ``window`` apart, counted in both orders."""
    some = texts.select(tokens(F.col(text_col)).alias("tokens")).mapInArrow(_pairs(names, window), "i int, j int, n long")
    once = stored(some.groupBy("i", "j").agg(F.sum("n").alias("n")), "pairs")  # read in both orders
    return once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))


def _product(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """``matrix`` (``i``, ``j``, ``w``, dealt by i) times a thin matrix, in one job."""
    spark, n, k = matrix.sparkSession, *right.shape
    shared = spark.sparkContext.broadcast(right)

    def run(batches):
        thin, total, rows = shared.value, {}, 0
        for batch in batches:
            i, j, w = (np.asarray(batch.column(c)) for c in ("i", "j", "w"))
            for lo in range(0, len(i), SLICE):
                part = slice(lo, lo + SLICE)
                own, place = np.unique(i[part], return_inverse=True)
                order = np.argsort(place, kind="stable")
                begun = np.flatnonzero(np.diff(place[order], prepend=-1))
                sums = np.add.reduceat(thin[j[part][order]] * w[part][order, None], begun, axis=0)
                for row, s in zip(own.tolist(), sums):
                    total[row] = total[row] + s if row in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["i", "v"])

    out = np.zeros((n, k))
    sums = matrix.mapInArrow(run, "i int, v binary").toArrow()  # a row a token and task; all tasks run at once
    for i, v in zip(sums["i"].to_pylist(), sums["v"]):
        out[i] += np.frombuffer(v.as_buffer(), np.float64)
    shared.destroy()
    return out


@dataclass(frozen=True)
class Encoder:
    """Tokens, their vectors and weights; ``save`` and ``load`` keep them as a Parquet table."""

    names: pa.Array
    vectors: np.ndarray
    weights: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, k, float(w), v.tolist()) for k, (n, w, v) in enumerate(zip(self.names.to_pylist(), self.weights, self.vectors))]
        spark.createDataFrame(rows, "token string, place int, weight double, vector array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(path).orderBy("place").toPandas()
        vectors = np.stack(rows["vector"].to_numpy()) if len(rows) else np.zeros((0, 1))
        return Encoder(pa.array(rows["token"], pa.string()), vectors, rows["weight"].to_numpy(float))

    def __call__(self, text):
        """A Column: the vector of a text (zeros without a known token), not yet of unit length; see ``encode``."""
        shared = SparkSession.active().sparkContext.broadcast((self.names, self.vectors * self.weights[:, None]))
        dim = self.vectors.shape[1]

        @F.arrow_udf("array<double>")
        def run(lists: pa.Array) -> pa.Array:
            names, vectors = shared.value
            place = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, out = np.repeat(np.arange(len(lists)), size), np.zeros((len(lists), dim))
            row, place = row[place >= 0], place[place >= 0]
            for lo in range(0, len(row), SLICE):
                own, begun = np.unique(row[lo : lo + SLICE], return_index=True)
                out[own] += np.add.reduceat(vectors[place[lo : lo + SLICE]], begun, axis=0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

        return run(tokens(text))


def train(texts: DataFrame, text_col: str = "text", dimensions: int = 384, vocabulary: int = 20_000, window: int = 4, rounds: int = 2, extra: int = 16,
          power: float = 1.0, seed: int = 7) -> Encoder:
    """Token vectors from the texts of ``texts``.

    Each dimension counts as the ``power`` of its eigenvalue, so what many texts share weighs most. Fewer tokens than
    ``dimensions`` give vectors padded with zeros. Null and empty texts add nothing; without any token the
    encoder gives zeros. The result does not depend on how ``texts`` is partitioned but for rounding.
    """
    table = vocabulary_table(texts, text_col, vocabulary).orderBy("place").toPandas()
    names, n = pa.array(table["token"], pa.string()), len(table)
    if not n:
        return Encoder(names, np.zeros((0, dimensions)), np.zeros(0))
    counts = stored(co_occurrences(texts, text_col, names, window), "co-occurrences")
    own = np.zeros(n)
    for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():  # one number a token
        own[r["i"]] = r["n"]
    total = own.sum() or 1.0
    frequency = texts.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(own)], "k int, own double")
    i, j = (F.broadcast(frequency.select(F.col("k").alias(c), F.col("own").alias(f"n{c}"))) for c in "ij")  # one row a token of the vocabulary
    weight = F.log(F.col("n") * F.lit(float(total)) / (F.col("ni") * F.col("nj")))
    matrix = counts.join(i, "i").join(j, "j").select("i", "j", weight.alias("w")).where("w > 0").repartition("i")
    matrix = stored(matrix, "information")
    rng, k = np.random.default_rng(seed), min(n, dimensions + extra)
    thin = rng.standard_normal((n, k))
    for _ in range(rounds + 1):
        thin = np.linalg.qr(_product(matrix, thin))[0]
    # the matrix is symmetric: within the space found it is a small one
    small = thin.T @ _product(matrix, thin)
    values, inside = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[: min(k, dimensions)]
    vectors = (thin @ inside[:, best]) * np.maximum(values[best], 0) ** power
    vectors = np.pad(vectors, ((0, 0), (0, dimensions - vectors.shape[1])))
    texts_n = max(1, texts.where(F.lower(F.col(text_col)).rlike(java_pattern(TOKEN))).count())
    return Encoder(names, vectors, np.log1p(texts_n / table["df"].to_numpy(float)))


def encode(df: DataFrame, encoder: Encoder, text_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: the unit vector of each text; a null text, and one without a known token, has zeros."""
    raw = f"_{out_col}_raw"
    return df.withColumn(raw, encoder(F.coalesce(F.col(text_col), F.lit("")))).withColumn(out_col, l2_normalize(raw)).drop(raw)
