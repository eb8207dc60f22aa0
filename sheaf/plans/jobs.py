"""User-level jobs (JOB1-9): compositions of the operators with their sources and sinks.

Each job takes DataFrames or paths and returns the result DataFrame (and
writes it where the original wrote a file).  Paths should live on shared
storage; nothing is staged through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import augment as A
from sheaf.operators import docs as DOCS
from sheaf.operators import evaluate as EV
from sheaf.operators import generate as G
from sheaf.operators import postprocess as P
from sheaf.operators import prompts as PR
from sheaf.operators import requests as RQ
from sheaf.operators import training as TR
from sheaf.operators import vectors as V
from sheaf.operators.positions import with_position
from sheaf.rules import defaults as D
from sheaf.sources import readers as R


def instruction_set(entities: DataFrame, order_by: Sequence, out_path: str | None = None) -> DataFrame:
    """JOB1: entity rows -> templated instructions + neighbour comparisons (-> JSONL)."""
    rows = G.build_instruction_set(entities, order_by)
    records = rows.select("part", "entity_pos", "item", "instruction", "input", "output", "meta")
    if out_path:
        R.write_jsonl(records.orderBy("part", "entity_pos", "item").drop("part", "entity_pos", "item"), out_path)
    return records


def instruction_stats(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB1 report: AGG2 per name, AGG3 average."""
    return G.per_entity_counts(records), G.average_per_entity(records)


def augment_records(records: DataFrame, order_by: Sequence | None = None, out_path: str | None = None,
                    fix: bool = False) -> DataFrame:
    """JOB2: SET2 (original, rephrased, Q&A of all records, negatives) -> SRT2 (-> JSONL).

    ``order_by`` numbers the records (WIN1); without it they carry their ``rec_pos`` already.
    """
    positioned = with_position(records, order_by, "rec_pos") if order_by else records
    shuffled = A.seeded_shuffle(A.augment(positioned, fix=fix))
    if out_path:
        R.write_jsonl(shuffled.select("instruction", "input", "output", "meta"), out_path)
    return shuffled


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """AGG7: a row total gathered while the job runs (``observe``), no second pass."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def knowledge_base(records: DataFrame, order_by: Sequence | None = None, groups=D.DOC_CATEGORIES, dim: int = 64) -> DataFrame:
    """JOB3: WIN1 -> FLT1 -> PRJ7-8 -> CLS1 -> VEC1-2. Without ``order_by`` the records carry their ``line`` (``readers.numbered_lines``)."""
    docs = DOCS.build_documents(records, order_by=order_by, groups=groups, index_col=None if order_by else "line")
    return V.add_hashed_embedding(docs, "page_content", "embedding", dim=dim)


def store_knowledge_base(collection: DataFrame, path: str, mode: str = "append") -> int:
    """JOB3 -> SNK4: documents into the collection at ``path``; returns how many were indexed (AGG7).

    Ids come from the content, so the same input again adds nothing.
    """
    observed, obs = counted(collection, "indexed")
    R.write_collection(observed, path, mode)
    return obs.get["rows"]


def knowledge_base_files(spark: SparkSession, paths: Sequence[str], groups=D.DOC_CATEGORIES, dim: int = 64) -> DataFrame:
    """JOB3 from JSONL files, all but the first optional: documents are numbered in the order of files and lines."""
    return knowledge_base(R.numbered_lines(spark, paths), groups=groups, dim=dim)


def category_report(collection: DataFrame) -> DataFrame:
    """JOB3 report: AGG1."""
    return DOCS.category_counts(collection)


def probe(spark: SparkSession, collection: DataFrame, k: int = D.TOP_K, questions: DataFrame | None = None
          ) -> DataFrame:
    """VEC6: probe questions (SRC11 by default) against a collection, with previews (PRJ13)."""
    qs = questions if questions is not None else R.probe_queries(spark)
    qv = PR.encode(qs, "qid", "question", "qid", "qvec")
    cv = collection.select(F.col("doc_index").alias("cid"), F.col("embedding").alias("cvec"))
    hits = V.top_k(qv, cv, k)
    meta = collection.select(
        F.col("doc_index").alias("cid"), F.coalesce("millet_name", F.lit(D.PREVIEW_DEFAULT)).alias("millet_name"),
        F.coalesce("category", F.lit(D.PREVIEW_DEFAULT)).alias("category"), PR.preview(F.col("page_content")).alias("preview"))
    return hits.join(meta, "cid").select("qid", "rank", "cid", "score", "millet_name", "category", "preview")


def batch_prompts(requests: DataFrame, docs: DataFrame, k: int = D.TOP_K, vec_col: str | None = None) -> DataFrame:
    """JOB4: requests -> CLS3-4 routing -> top-k retrieval -> prompt text."""
    return PR.assemble_prompts(RQ.route_requests(requests), docs, k, vec_col=vec_col)


def batch_responses(generations: DataFrame) -> DataFrame:
    """JOB5: generated answers -> cleaned responses with citations, confidence and thinking."""
    return P.respond(generations)


def preference_set(spark: SparkSession, records: DataFrame, path: str) -> DataFrame:
    """JOB6: reuse an existing pair file (SRC7) or build PRF1-3 and write it once (SNK3)."""
    return R.read_or_build(spark, path, lambda: TR.preference_pairs(records).select("prompt", "chosen", "rejected"))


def sft_set(records: DataFrame) -> DataFrame:
    """JOB7: records + chat-template text column."""
    return TR.with_chat_text(records)


def evaluation(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB8 for finished pairs: per-pair scores and their summary."""
    scores = EV.score(pairs)
    return scores, EV.summary(scores)


def answer_evaluation(asked: DataFrame, gold: DataFrame, share: float = 0.2) -> DataFrame:
    """JOB8: asked questions linked to gold questions (SRC8), answers scored, unmatched rows reported."""
    return EV.evaluate_answers(asked, gold, share)


def length_report(texts: DataFrame) -> DataFrame:
    """JOB9."""
    return TR.length_profile(texts)
