"""Request routing and the topic dimension (FLT7, CLS3-5, CLS7, CLS9, PRJ14 welcome row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import route as R
from sheaf.functions.text import render, ustrip
from sheaf.rules import defaults as D

REQUEST_SCHEMA = "request_id string, message string, model_type string, mode string, context string"


def route_requests(requests: DataFrame) -> DataFrame:
    """FLT7 + CLS3/CLS4/CLS5/CLS7 for ``request_id, message, model_type, mode``."""
    kept = requests.where(F.coalesce(ustrip(F.col("message")), F.lit("")) != "")
    r = kept.withColumn("_r", R.route(F.col("message"), F.col("mode")))
    return r.select(
        "request_id", "message", "mode", "context",
        F.col("_r.is_complex").alias("is_complex"),
        F.col("_r.complexity_type").alias("complexity_type"),
        R.token_budget(F.col("mode"), F.col("_r.is_complex")).alias("max_tokens"),
        R.use_adapter(F.col("model_type")).alias("use_adapter"),
        R.is_recipe_question(F.col("message")).alias("is_recipe"))


def topic_dimension(spark: SparkSession) -> DataFrame:
    """CLS9: the topic catalogue as a small dimension table."""
    return spark.createDataFrame(D.TOPICS, "topic_id string, title string, description string, "
                                           "helper_text string, theme string")


def attach_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """CLS9 + PRJ14: topic columns and the welcome message per request context.

    The catalogue is a fixed 7-row table, a proven bound for a broadcast
    join; unknown contexts keep nulls and the default theme.
    """
    j = requests.join(F.broadcast(topics), requests.context == topics.topic_id, "left")
    ctx = F.coalesce(F.col("context"), F.lit(""))
    return j.select(
        "request_id", "context", "title", "description",
        F.coalesce(F.col("theme"), F.lit(D.DEFAULT_THEME)).alias("theme"),
        render(D.WELCOME_TEMPLATE, {"context": ctx, "context_lower": F.lower(ctx)}).alias("welcome"))
