"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Each document has a fixed hash. A source takes ``floor(target / size)`` copies of all its documents and, for
the rest of its target, those documents whose hash lies below a threshold. The threshold is found without
sorting: words are summed by source and leading hash bits, the bucket in which the running sum passes the
rest is the boundary, and only that bucket is summed again by the next bits, until it holds one hash.
Thresholds are nested: a larger target takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the document hash, and bits that one histogram resolves (4096 buckets a source).
HASH_BITS, STEP_BITS = 60, 12


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the id's decimal digits; of the text where the id is null, so that such rows are told apart."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(``source``, ``source_size``, ``target``) from (``source``, ``size``) rows.

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes by weight.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is
    above. In one pass: a source is capped if the level of the sources with a larger size per weight exceeds
    its own, and running sums in the order of size per weight give all levels.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size")
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = per.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", left / share)
    # the first source whose cap reaches its level is not capped, nor is any after it
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    level = F.coalesce(free["level"], F.lit(float("inf")))
    return leveled.select("source", "source_size", F.least(level * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def thresholds(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """(``source``, ``cut``): documents (``source``, ``size``, ``hash``) with a hash below ``cut`` have ``rest`` words.

    The hash at the boundary is taken if that brings the sum nearer to ``rest``.
    """
    scope, found, bits = docs.withColumn("used", F.lit(0).cast("long")), None, HASH_BITS
    while True:
        bits -= STEP_BITS
        sums = scope.groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("used").alias("used")
        )
        upto = F.col("used") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).join(rest, sums["source"].eqNullSafe(rest["source"]), "inner").drop(rest["source"])
        edge = edge.where("upto > rest and upto - words <= rest").select("source", "bucket", "words", "low", "high", (F.col("upto") - F.col("words")).alias("used"), "rest")
        found = written(edge, "edges")
        if bits == 0 or found.where("low < high").isEmpty():
            break
        keys = found.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "used")
        scope = docs.withColumn("b", F.shiftright("hash", bits)).join(keys, F.col("source").eqNullSafe(F.col("s")) & (keys["b"] == F.shiftright("hash", bits))).select("source", "size", "hash", "used")
    near = F.col("used") * 2 + F.col("words") <= 2 * F.col("rest")
    return found.select("source", (F.col("low") + near.cast("long")).alias("cut"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(``source``, ``source_size``, ``target``, ``base``, ``cut``) from (``source``, ``size``, ``hash``) rows.

    A source takes ``base`` copies of all its documents and one more of those with a hash below ``cut``.
    """
    d = written(docs.select("source", "size", "hash"), "sizes")
    goal = targets(d.select("source", "size"), weights, most).withColumn("base", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
    goal = written(goal.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    cuts = thresholds(d, goal.select("source", "rest"))
    return goal.join(cuts, goal["source"].eqNullSafe(cuts["source"]), "left").select(goal["source"], "source_size", "target", "base", "cut")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def copies(size: Column, doc_hash: Column) -> Column:
    """How often the mix takes a document, given its source's ``base`` and ``cut``."""
    return F.when(size > 0, F.col("base") + F.coalesce(doc_hash < F.col("cut"), F.lit(False)).cast("long")).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(``doc_id``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``), one row per row of ``docs``.

    ``size`` counts the words of the text (null: 0), ``copies`` is how often the mix takes the document (0 to
    ``most``), ``taken`` = ``size`` * ``copies``. Documents are taken whole, so a source misses its target by at
    most half a document. The choice depends on ids and sizes alone (without an id, on the text): reruns agree,
    and rows that repeat an id are taken alike, as are equal texts without id. Null sources form one source. A document without words is taken no
    times; a source of such has target 0. An empty table gives an empty one.
    """
    d = written(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), document_hash(docs[id_col], docs[text_col]).alias("hash")), "sizes")
    by = plan(d, weights, most).withColumnRenamed("source", "s")
    out = d.join(by, d["source"].eqNullSafe(by["s"])).withColumn("copies", copies(F.col("size"), F.col("hash")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, each as often as it is taken; texts are not shuffled.

    Nulls, repeated rows and empty tables: see ``mix``. All columns are kept, whatever their names.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), document_hash(docs[id_col], docs[text_col]).alias("hash"))
    by = plan(rows, weights, most).withColumnRenamed("source", "s")
    taken = F.array_repeat(F.lit(True), copies(F.col("size"), F.col("hash")).cast("int"))
    return rows.join(by, rows["source"].eqNullSafe(by["s"])).select("row", F.explode(taken)).select("row.*")
