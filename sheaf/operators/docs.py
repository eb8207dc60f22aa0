"""Knowledge-base documents from instruction records (JOB3 without vectors).

Records are ``instruction, input, output: string; meta: map<string,string>``.
Steps: WIN1 position -> strip -> FLT1 (empty output dropped, its position
is still consumed) -> PRJ7 page text -> PRJ8 metadata defaults -> CLS1
category.  All narrow except the position step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import first_label, render, ustrip
from sheaf.operators.positions import with_position
from sheaf.rules import defaults as D


def meta_get(meta: Column, key: str, default: str) -> Column:
    """PRJ8: ``meta.get(key, default)`` - default only when the key is missing."""
    return F.when(F.map_contains_key(meta, key), F.element_at(meta, F.lit(key))).otherwise(F.lit(default))


def category(instruction: Column, groups: Sequence = D.DOC_CATEGORIES,
             default: str = D.DOC_CATEGORY_DEFAULT) -> Column:
    """CLS1: ordered keyword groups over the lower-cased instruction."""
    return first_label(F.lower(instruction), groups, default)


def page_content(instruction: Column, inp: Column, output: Column) -> Column:
    """PRJ7: question/context/answer text; the context line only for non-empty input."""
    f = {"instruction": instruction, "input": inp, "output": output}
    return F.when(inp != "", render(D.DOC_WITH_INPUT, f)).otherwise(render(D.DOC_WITHOUT_INPUT, f))


def build_documents(records: DataFrame, order_by: Sequence | None = None,
                    groups: Sequence = D.DOC_CATEGORIES, meta_defaults: Sequence = D.DOC_META_DEFAULTS,
                    index_col: str | None = None) -> DataFrame:
    """Instruction records -> documents with ``doc_index`` and metadata columns.

    ``index_col`` names an existing position column; otherwise positions are
    assigned over ``order_by`` (WIN1).
    """
    if index_col is None:
        records = with_position(records, order_by, "doc_index")
    else:
        records = records.withColumnRenamed(index_col, "doc_index")
    meta = F.col("meta")
    stripped = records.select(
        "doc_index",
        ustrip(F.coalesce(F.col("instruction"), F.lit(""))).alias("instruction"),
        ustrip(F.coalesce(F.col("input"), F.lit(""))).alias("input"),
        ustrip(F.coalesce(F.col("output"), F.lit(""))).alias("output"),
        meta.alias("meta"))
    kept = stripped.where(F.col("output") != "")
    cols = [F.col("doc_index"),
            page_content(F.col("instruction"), F.col("input"), F.col("output")).alias("page_content")]
    cols += [meta_get(meta, k, d).alias(k) for k, d in meta_defaults]
    cols += [F.col("instruction"), category(F.col("instruction"), groups).alias("category")]
    return kept.select(*cols)


def category_counts(docs: DataFrame) -> DataFrame:
    """AGG1: documents per category, sorted by category."""
    return docs.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("category")
