"""Training-set preparation: preference pairs (PRF1-3), chat text (PRJ9), length profile (JOB9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import contains_any, once, render
from sheaf.rules import defaults as D
from sheaf.rules.dialect import java_pattern


#: A pair's prompt, lower-cased, holds one of these.
PREFERENCE_NEEDLES = [n for needles, _ in D.PREFERENCE_RULES for n in needles]


def corrupt_numbers(chosen: Column, pairs=D.NUMBER_CORRUPTIONS) -> Column:
    """PRF2: literal number swaps when any listed number occurs, else null."""
    swapped = chosen
    for a, b in pairs:
        swapped = F.replace(swapped, F.lit(a), F.lit(b))
    return F.when(contains_any(chosen, [a for a, _ in pairs]), swapped)


def rejected_text(instruction: Column, chosen: Column, rules=D.PREFERENCE_RULES, low: Column | None = None) -> Column:
    """PRF1: first matching rule on the lower-cased instruction (``low``); no fall-through once a branch is taken."""
    low = F.lower(instruction) if low is None else low
    out = None
    for needles, text in rules:
        value = corrupt_numbers(chosen) if text is None else F.lit(text)
        cond = contains_any(low, needles)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def preference_pairs(records: DataFrame) -> DataFrame:
    """PRF1-3 + FLT3: ``prompt, chosen, rejected`` rows where rejected is non-empty and differs."""
    rows = records.select(F.col("instruction").alias("prompt"), F.coalesce(F.col("output"), F.lit("")).alias("chosen"),
                          *[c for c in ("origin", "rec_pos", "sub") if c in records.columns])
    prompt = F.coalesce(F.col("prompt"), F.lit(""))
    low = once(rows, _low=F.lower(prompt))
    out = once(low, rejected=rejected_text(prompt, F.col("chosen"), low=F.col("_low")))
    out = out.select("prompt", "chosen", "rejected", *rows.columns[2:])
    return out.where(F.col("rejected").isNotNull() & (F.col("rejected") != "") & (F.col("rejected") != F.col("chosen")))


def chat_text(instruction: Column, output: Column, system: str = D.SFT_SYSTEM_PROMPT) -> Column:
    """PRJ9: chat-template text; ``input`` is ignored, as in the original."""
    return render(D.SFT_TEMPLATE, {"system": F.lit(system), "instruction": instruction, "output": output})


def with_chat_text(records: DataFrame) -> DataFrame:
    return records.withColumn("text", chat_text(F.col("instruction"), F.col("output")))


def whitespace_tokens(c: Column) -> Column:
    """``len(text.split())``."""
    return F.size(F.filter(F.split(c, java_pattern(r"\s+")), lambda t: t != ""))


#: Exact quantiles: the aggregate holds one count per distinct length.
LENGTH_QUANTILES = [("p50_tokens", 0.5), ("p90_tokens", 0.9), ("p99_tokens", 0.99)]


def length_profile(texts: DataFrame, limits: Sequence[int] = D.LENGTH_LIMITS, col: str = "text") -> DataFrame:
    """JOB9: token counts against each configured limit, one aggregation pass."""
    n = texts.select(whitespace_tokens(F.col(col)).alias("n_tokens"))
    lim = F.explode(F.array(*[F.lit(x) for x in limits])).alias("limit")
    return (n.select("n_tokens", lim).groupBy("limit").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count(F.when(F.col("n_tokens") > F.col("limit"), 1)).alias("n_over"),
        F.max("n_tokens").alias("max_tokens"),
        *[F.round(F.percentile("n_tokens", q), 6).alias(name) for name, q in LENGTH_QUANTILES],
        F.round(F.avg("n_tokens"), 6).alias("avg_tokens"))
        .withColumn("share_over", F.round(F.col("n_over") / F.col("n_texts"), 6)))
