"""Retrieval and prompt assembly (JOIN2, PRJ10, PRJ11, PRJ13, PRJ15, AGG6, JOB4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import render
from sheaf.operators import vectors as V
from sheaf.rules import defaults as D


def preview(text, n: int = D.PREVIEW_CHARS) -> Column:
    """PRJ13: first ``n`` characters with newlines turned into spaces."""
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def encode(df: DataFrame, id_col: str, text_col: str, out_id: str, out_vec: str, encoder=None) -> DataFrame:
    """VEC1 + VEC2 with a pluggable Column encoder (default: hashed bag of words)."""
    if encoder is None:
        return V.add_hashed_embedding(df.select(F.col(id_col).alias(out_id), F.col(text_col).alias("_text")),
                                      "_text", out_vec).drop("_text")
    return df.select(F.col(id_col).alias(out_id), V.l2_normalize(encoder(F.col(text_col))).alias(out_vec))


def context_blocks(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_index",
                   name_col: str = "millet_name", content_col: str = "page_content") -> DataFrame:
    """PRJ10 / AGG6: per query, ``About {name}:\\n{content}`` in rank order joined by a blank line.

    Each group holds at most k rows (the retrieved hits), so the ordered
    collect is bounded.
    """
    d = docs.select(F.col(doc_id).alias("cid"), F.coalesce(F.col(name_col), F.lit(D.CONTEXT_NAME_DEFAULT))
                    .alias("name"), F.col(content_col).alias("content"))
    item = render(D.CONTEXT_ITEM, {"millet_name": F.col("name"), "content": F.col("content")})
    j = hits.join(d, "cid").select("qid", F.struct("rank", item.alias("text")).alias("h"))
    return j.groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: x["text"]), D.CONTEXT_JOIN)
        .alias("context_text"), F.count(F.lit(1)).alias("n_docs"))


def build_prompt(question: Column, context: Column, use_thinking: Column) -> Column:
    """PRJ11: the thinking or the fast template around context and question."""
    f = {"context": F.coalesce(context, F.lit("")), "question": question}
    return F.when(use_thinking, render(D.PROMPT_THINKING, f)).otherwise(render(D.PROMPT_FAST, f))


def assemble_prompts(routed: DataFrame, docs: DataFrame, k: int = D.TOP_K, encoder=None,
                     doc_id: str = "doc_index", text_col: str = "page_content", vec_col: str | None = None) -> DataFrame:
    """JOB4: routed requests -> top-k documents -> context -> prompt (+ PRJ15 length).

    ``vec_col`` names the stored vectors of a collection; without it the documents are encoded here.
    """
    qv = encode(routed, "request_id", "message", "qid", "qvec", encoder)
    if vec_col:
        dv = docs.select(F.col(doc_id).alias("cid"), F.col(vec_col).alias("cvec"))
    else:
        dv = encode(docs, doc_id, text_col, "cid", "cvec", encoder)
    hits = V.top_k(qv, dv, k)
    ctx = context_blocks(hits, docs, doc_id)
    out = routed.join(ctx, routed.request_id == ctx.qid, "left")
    prompt = build_prompt(F.col("message"), F.col("context_text"), F.col("is_complex"))
    return out.select("request_id", "is_complex", "complexity_type", "max_tokens",
                      F.coalesce(F.col("n_docs"), F.lit(0)).alias("n_docs"), prompt.alias("prompt"),
                      F.length(prompt).alias("prompt_chars"))
