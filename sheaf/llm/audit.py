"""Interaction of document filters: what each would remove in every order, and its Shapley share.

The states of the subset lattice are the sets of filters already applied; an edge adds one filter. A forward
pass counts the orders that reach each state and a backward pass those that lead from it to the full set; an edge
lies on the product of the two. What an edge removes depends on its state only, so removals are counted once an
edge, not once an order: weighted by the paths through the edge they give a filter's sum over all orders (its Shapley
value times the number of orders), and any order's steps are read off its edges.

Documents come down to (part, failure mask) counts before anything is multiplied: at most 2^filters rows a part.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of one text: too few words, few distinct words, many capitals, symbols."""
    words = word_list(text)
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, conditions: Mapping[str, Column], repeats: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(``doc_id``, ``part``, ``mask``, ``n``): rows of equal id, part and text, with a bit for each filter failed.

    ``conditions`` are boolean columns of ``docs`` (null: passed); bit k belongs to the k-th. The filter ``repeats``
    takes the next bit: a text that also stands under a smaller id, anywhere in the table. A null text is an empty
    one, a null part the part ''. A row without id has no smaller id and is smaller than none: it passes ``repeats``.
    Rows that repeat an id with one text are told apart from no one: both are the first or neither.

    The smallest id of a text comes back by an equi-join on (id, text hash), not on the text alone, so that
    a text that many documents share is spread over all tasks.
    """
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions.values())]
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("h"),
    )
    if repeats is None:
        return rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    rows = written(rows, "failures").groupBy("doc_id", "part", "mask", "h").agg(F.count("*").alias("n"))
    first = rows.where("doc_id IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    mask = F.col("mask") + F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(1 << len(bits))
    return rows.join(first, ["doc_id", "h"], "left").select("doc_id", "part", mask.alias("mask"), "n")


def histogram(rows: DataFrame, labels: DataFrame, flags: Mapping[str, Column], id_col: str = "doc_id") -> DataFrame:
    """(``part``, ``mask``, ``n``, one count per flag): documents by failure mask, in total and with a label.

    An id that ``labels`` names more than once has a flag if any of its rows has; a null id has none.
    """
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("doc_id"))
    marks = written(marks.agg(*(F.max(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items())), "marks")
    counts = [F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in flags]
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *counts)


def path_counts(filters: int) -> dict[tuple[int, int], int]:
    """Orders through each edge (state, filter added), by a forward and a backward pass over the lattice."""
    full = (1 << filters) - 1
    forward, backward = {0: 1}, {full: 1}
    for state in range(1, full + 1):  # a subset has a smaller number than its supersets
        forward[state] = sum(forward[state ^ (1 << k)] for k in range(filters) if state >> k & 1)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | (1 << k)] for k in range(filters) if not state >> k & 1)
    return {(state, k): forward[state] * backward[state | (1 << k)] for state in range(full) for k in range(filters) if not state >> k & 1}


def edges(counts: DataFrame, filters: int, flags: tuple[str, ...]) -> DataFrame:
    """One row per part and edge: ``paths``, ``kept`` after it, ``removed`` by it, ``redundant``, ``unique_fails``, flags lost.

    The edges are a constant array, exploded beside the (few) histogram rows of a part and summed up again.
    """
    array = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(k).alias("filter"), F.lit(p).alias("paths")) for (s, k), p in path_counts(filters).items()))
    wide = counts.withColumn("edge", F.explode(array)).select("part", "mask", "n", *flags, "edge.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, before = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0
    total = lambda cond, what, name: F.sum(F.when(cond, F.col(what)).otherwise(0)).alias(name)
    return wide.groupBy("part", "state", "filter", "paths").agg(
        total(~before & ~fails, "n", "kept"), total(~before & fails, "n", "removed"), total(before & fails, "n", "redundant"),
        total(F.col("mask") == bit, "n", "unique_fails"), *(total(~before & fails, f, f"{f}_lost") for f in flags),
    )


def audit_orders(counts: DataFrame, letters: str, flags: tuple[str, ...]) -> DataFrame:
    """Every order's steps, read from the edges, beside the filter's ``shapley`` sum over all orders.

    ``counts``: see ``histogram``. One row per part, order of ``letters`` and step (from 1); zeros included. All
    orders are listed, so letters should be few; ``edges`` alone serves up to about 16. No rows: an empty table.
    """
    spark, lattice = counts.sparkSession, edges(counts, len(letters), flags)
    # 2^(n-1) edges of a filter in a part, so this grouping is bounded
    shares = lattice.groupBy("part", "filter").agg(
        F.sum(F.col("paths") * F.col("removed")).alias("shapley"), F.collect_list(F.struct("state", "kept", "removed", "redundant", "unique_fails", *(f"{f}_lost" for f in flags))).alias("edge")
    )
    lattice = shares.select("part", "filter", "shapley", F.inline("edge"))
    steps, numbers = [], range(len(letters))
    for order in permutations(numbers):
        state = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(letters[i] for i in order), step, state, k))
            state |= 1 << k
    orders = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    out = lattice.join(F.broadcast(orders), ["state", "filter"])  # a row per step of an order, whatever the data
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{f}_lost" for f in flags), "shapley")
