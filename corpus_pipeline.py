"""Corpus pipeline: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of ``docs``; the last returns one row per token piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import language, lines, minhash, mixing, packing
from sheaf.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose text is plausible in a language learned from the labelled ones.

    Without any labelled document there is nothing to tell by: all rows with a letter stay.
    """
    models = language.train(docs)
    if models is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return language.accepted_rows(docs, models)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier line; ``n_chars`` follows. What loses all its words goes."""
    out, text, cut = lines.without_lines(docs), F.col("kept_text"), F.col("n_removed") > 0
    size = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    out = out.where(~cut | text.rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*({"text": text.alias(c), "n_chars": size.alias(c)}.get(c, F.col("row")[c].alias(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id (five-word shingles, 0.8).

    A row is a document by the hash of its id and text: rows without id take part, after all with one; of rows that repeat
    both one stays. Null and blank texts are linked with nothing. An empty table gives an empty one.
    """
    key = F.xxhash64("doc_id", "text")
    found = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = docs.select(key.alias("_key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("_key")).alias("row"))
    kept = found.join(ids, "_key").groupBy("component_id").agg(F.min("row").alias("row")).select(F.col("row._key").alias("_key"))
    rows, repeated = docs.withColumn("_key", key), written(ids.groupBy("_key").count().where("count > 1").select("_key"), "repeated")
    if not repeated.isEmpty():  # only rows that come again are gathered by key; equal ones meet in their tasks first
        again = rows.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        rows = rows.join(repeated, "_key", "left_anti").unionByName(again)
    return rows.join(written(kept, "kept"), "_key", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted mix of the sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their places in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
