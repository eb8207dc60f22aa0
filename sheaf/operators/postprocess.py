"""Batch post-processing of generated answers (TXT15-26, PRJ12, PRJ14, CLS8; JOB5).

Applied as DataFrame stages: each stage's output column is a separate
projection, and Catalyst does not inline a non-trivial expression that a
later stage reads several times, so the long rule folds run once per row.
All stages are narrow (no shuffle); the job is embarrassingly parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import route as R
from sheaf.functions import textclean as T
from sheaf.functions.text import ustrip
from sheaf.operators import textstages as S
from sheaf.operators.partitioning import spread
from sheaf.rules import defaults as D


def post_process(df: DataFrame, response: str = "response", question: str = "question",
                 is_complex: str = "is_complex") -> DataFrame:
    """TXT26: TXT16 -> TXT17 -> TXT18 -> TXT19 (+TXT20 audit) -> TXT21 -> TXT22 -> TXT23 -> TXT24.

    Adds ``answer``, ``thinking`` and ``leads_with_wrong``.
    """
    q = F.col(question)
    d = S.clean_leakage_stage(df, response, "_r")
    d = d.withColumn("_r", T.fix_ocr(T.correct_species(F.col("_r"))))
    d = d.withColumn("_rl", F.lower(F.col("_r"))).withColumn("_ql", F.lower(q))
    d = d.withColumn("leads_with_wrong", T.leads_with_wrong(F.col("_r"), q, F.col("_rl"), F.col("_ql")))
    d = d.withColumn("_r", T.validate_subject(F.col("_r"), q, F.col("_rl"), F.col("_ql")))
    d = S.filter_off_topic_stage(d, "_r", "_r", question)
    d = d.withColumn("_r", T.add_source_citation(F.col("_r")))
    split = F.col(is_complex) & ~R.is_recipe_question(q)
    d = d.withColumn("_split", split).withColumn("_rl", F.lower(F.col("_r")))
    d = d.withColumn("_idx", F.when(F.col("_split"), T.answer_split_index(F.col("_r"), F.col("_rl"))))
    d = d.withColumn("_tail", ustrip(F.col("_r").substr(F.col("_idx") + 1, F.lit(1 << 30))))
    ok = F.col("_idx").isNotNull() & (F.length(F.col("_tail")) > D.MIN_ANSWER_CHARS)
    d = d.withColumn("_think", F.when(ok, ustrip(F.col("_r").substr(F.lit(1), F.col("_idx")))))
    d = d.withColumn("_ans", F.when(ok, F.col("_tail")).otherwise(F.col("_r")))
    d = d.withColumn("_ans", F.when(F.col("_split"), T.strip_transition(F.col("_ans"))).otherwise(F.col("_ans")))
    return (d.withColumn("answer", T.tidy_answer(F.col("_ans")))
            .withColumn("thinking", T.tidy_thinking(F.col("_think")))
            .drop("_r", "_rl", "_ql", "_split", "_idx", "_tail", "_think", "_ans"))


def envelope(df: DataFrame, confidence: int = D.CONFIDENCE_CONSTANT) -> DataFrame:
    """TXT25 + PRJ12 + CLS8: response, citations (<= 3), constant confidence and its band."""
    d = df.withColumn("_p", T.parse_citations(F.col("answer")))
    return (d.withColumn("response", F.col("_p.main"))
            .withColumn("citations", F.col("_p.citations"))
            .withColumn("confidence", F.lit(confidence))
            .withColumn("confidence_band", R.confidence_band(F.lit(confidence)))
            .drop("_p"))


def respond(generations: DataFrame) -> DataFrame:
    """JOB5: ``request_id, question, mode, raw_response`` -> chat response rows.

    TXT15 (first clean-up) -> CLS3 routing -> TXT26 -> TXT25 envelope.
    """
    g = spread(generations).withColumn("_route", R.route(F.col("question"), F.col("mode")))
    g = g.withColumn("is_complex", F.col("_route.is_complex"))\
        .withColumn("complexity_type", F.when(F.col("_route.is_complex"), F.col("_route.complexity_type")))\
        .drop("_route")
    g = S.clean_response_stage(g, "raw_response", "cleaned")
    out = envelope(post_process(g, response="cleaned"))
    return out.select("request_id", "question", "response", "citations", "confidence", "confidence_band",
                      "thinking", "is_complex", "complexity_type", "leads_with_wrong")


def message_rows(responses: DataFrame, status: str = "status") -> DataFrame:
    """PRJ14: UI message rows; an errored request becomes the fixed error message with confidence 0."""
    err = F.col(status) == "error" if status in responses.columns else F.lit(False)
    return responses.select(
        F.col("request_id").cast("string").alias("id"), F.lit("ai").alias("type"),
        F.when(err, F.lit(D.ERROR_MESSAGE)).otherwise(F.col("response")).alias("content"),
        F.when(err, F.array().cast("array<string>")).otherwise(F.col("citations")).alias("citations"),
        F.when(err, F.lit(D.CONFIDENCE_ON_ERROR)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(err, F.lit(None).cast("string")).otherwise(F.col("thinking")).alias("thinking"),
        F.when(err, F.lit(False)).otherwise(F.coalesce(F.col("is_complex"), F.lit(False))).alias("isComplex"))
