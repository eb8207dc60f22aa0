"""JOB8: answers scored against gold answers: exact match, token F1, ROUGE-L.

``score`` takes finished pairs; ``evaluate_answers`` finds them by linking the questions (``operators.linkage``).
Token overlap is a multiset intersection computed relationally: tokens are
counted per (id, token) on each side (partial aggregation before the
shuffle) and joined on that key, so a long answer is never collected into
one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import ustrip
from sheaf.operators.linkage import link_questions, question_key, subsequence_length
from sheaf.operators.vectors import tokens
from sheaf.rules.dialect import java_pattern
from sheaf.session import stored


def _token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    toks = F.filter(F.split(F.lower(F.col(text_col)), java_pattern(r"\s+")), lambda t: t != "")
    return (df.select(F.col(id_col).alias("id"), F.explode(toks).alias("tok"))
            .groupBy("id", "tok").agg(F.count(F.lit(1)).alias("n")))


def score(pairs: DataFrame, id_col: str = "id", pred: str = "prediction", gold: str = "gold") -> DataFrame:
    """Per pair: ``exact_match`` (stripped equality) and whitespace-token ``f1``."""
    p = _token_counts(pairs, id_col, pred)
    g = _token_counts(pairs, id_col, gold)
    overlap = p.join(g, ["id", "tok"]).groupBy("id").agg(F.sum(F.least(p.n, g.n)).alias("overlap"))
    sizes = pairs.select(
        F.col(id_col).alias("id"),
        (ustrip(F.col(pred)) == ustrip(F.col(gold))).alias("exact_match"),
        F.size(F.filter(F.split(F.col(pred), java_pattern(r"\s+")), lambda t: t != "")).alias("n_pred"),
        F.size(F.filter(F.split(F.col(gold), java_pattern(r"\s+")), lambda t: t != "")).alias("n_gold"))
    j = sizes.join(overlap, "id", "left").withColumn("overlap", F.coalesce(F.col("overlap"), F.lit(0)))
    f1 = F.when((F.col("n_pred") + F.col("n_gold")) == 0, F.lit(1.0)).otherwise(
        2.0 * F.col("overlap") / (F.col("n_pred") + F.col("n_gold")))
    return j.select("id", "exact_match", "n_pred", "n_gold", "overlap", F.round(f1, 6).alias("f1"))


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("exact_match").cast("double")), 6)
                      .alias("exact_match"), F.round(F.avg("f1"), 6).alias("f1"))


def evaluate_answers(asked: DataFrame, gold: DataFrame, share: float = 0.2) -> DataFrame:
    """Every asked row scored against the gold answer of its question, and every gold row that nobody answered.

    ``asked`` and ``gold`` hold ``id``, ``question``, ``answer``; gold ids are unique. ``status`` is ``matched``,
    ``unknown`` (no gold question within ``share``, see ``link_questions``), ``unanswered`` (a gold row without an
    asked one) or ``repeated`` (a gold row whose question also stands under a smaller id, which represents it).
    Matched rows have the word edit ``distance`` of the questions, ``exact_match`` of the stripped answers, the
    word counts, the ``lcs`` of the answers' words and ``rouge_l``, its F-measure (1 if both answers are empty). A null
    answer is an empty one. Empty tables give the other side's rows, unmatched.
    """
    links = stored(link_questions(asked, gold, share), "question-links")  # plain rows on both sides: a question asked very often can be split
    left = asked.select(F.col("id").alias("asked_id"), F.coalesce(F.col("answer"), F.lit("")).alias("prediction"), question_key(F.col("question")).alias("key"))
    met = left.join(links, "key", "left")
    right = gold.select(F.col("id").alias("known_id"), F.coalesce(F.col("answer"), F.lit("")).alias("gold"))
    pairs = met.join(right, "known_id", "left").select("asked_id", "known_id", "distance", "prediction", "gold", tokens(F.col("prediction")).alias("p"), tokens(F.col("gold")).alias("g"))
    found = F.col("known_id").isNotNull()
    both = pairs.select(
        "asked_id", F.col("known_id").alias("gold_id"), F.when(found, "matched").otherwise("unknown").alias("status"), "distance",
        (ustrip(F.col("prediction")) == ustrip(F.col("gold"))).alias("exact_match"),
        F.when(found, F.size("p")).alias("n_pred"), F.when(found, F.size("g")).alias("n_gold"), F.when(found, subsequence_length("p", "g")).alias("lcs"))
    total = F.col("n_pred") + F.col("n_gold")
    both = both.withColumn("rouge_l", F.when(total == 0, 1.0).otherwise(F.round(2.0 * F.col("lcs") / total, 6)))

    used = links.select(F.col("known_id").alias("gold_id")).distinct()
    keys = gold.select(F.col("id").alias("gold_id"), question_key(F.col("question")).alias("key"))
    least = keys.where("key IS NOT NULL").groupBy("key").agg(F.min("gold_id").alias("gold_id")).select("gold_id", F.lit(True).alias("least"))
    alone = keys.join(used, "gold_id", "left_anti").join(least, "gold_id", "left")
    status = F.when(F.col("least") | F.col("key").isNull(), "unanswered").otherwise("repeated")
    none = [F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("distance", "exact_match", "n_pred", "n_gold", "lcs", "rouge_l")]
    return both.unionByName(alone.select(F.lit(None).cast(both.schema["asked_id"].dataType).alias("asked_id"), "gold_id", status.alias("status"), *none))
