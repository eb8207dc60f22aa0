"""JOIN3 for large keyword tables: texts x ordered substring rules, the first rule that a text contains wins.

A ``when`` chain (``functions.text.first_label``) tests every rule on every text, which serves tens of rules. Here the
rules are a table of any size, and the test is an equi-join over an inverted index of grams (runs of q characters):

1. Every keyword is filed under one of its own grams, the one that the fewest texts hold by a table of counters of fixed
   size: each keyword picks it where it is read, so only (gram, rule) is written, once a keyword. Keywords of 2q characters
   or more use grams of 2q; one shorter than q is its own gram. Texts are cut at each length that occurs (the empty
   keyword is held by every text).
2. Texts are cut into their distinct grams. A table of fixed size says which gram hashes the keywords have at
   all; only grams that pass it are shuffled, as (text key, gram).
3. The join on the gram gives the few rules a text can contain; ``contains`` decides on the text itself, and
   ``min_by`` the priority takes the first.

Equal texts are looked up once. Index, texts and labels are stored before they are joined, so that both sides of each join
are plain shuffles and adaptive execution can split a hot gram or a text that very many rows share.

A large table of rules is taken in steps of ascending priority: the first about ``SAMPLED * FIRST`` rules, then ``GROWTH``
times as many, and so on. A text that holds a rule of one step has its label, as all later rules come after it; only
the others go on, and of the later rules only those are written whose grams occur in them. So neither the whole table of
rules nor all pairs of a text and a rule that it holds are ever written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import long_array
from sheaf.session import stored

#: Characters of a gram.
GRAM = 4
#: Bits of the table of gram hashes: 512 KB in the plan, whatever the number of keywords.
FILTER_BITS = 1 << 22
#: Counters of texts by gram hash, a constant array of the plan whatever the data.
COUNTERS = 1 << 17
#: The rules of one in so many keyword hashes tell where a step ends, at the so manieth of them; each later step has so many times as many rules.
SAMPLED, FIRST, GROWTH = 8192, 64, 8
#: Bits of each table of gram hashes of the texts that go on to a later step, and the lengths of those grams, in units of the gram size.
LEFT_BITS, LEFT_SIZES = 1 << 23, (1, 2, 3, 4)


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none in a shorter text. One linear scan: a look-ahead at every place."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def all_grams(text: Column, sizes: list[int]) -> Column:
    return F.concat(*(grams(text, s) for s in sizes))


def _bucket(gram: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(n))


def _counter(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(COUNTERS)).cast("int")


def _place(gram: Column, n: int) -> Column:
    return F.floor(_bucket(gram, n) / 64).cast("int")


def _bit(gram: Column, n: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (_bucket(gram, n) % 64).cast("int"))


def _passes(bits: list[int]):
    """Whether a gram's hash is in the table: a bit of a constant array of longs."""
    table, n = long_array(bits), 64 * len(bits)
    return lambda gram: F.get(table, _place(gram, n)).bitwiseAND(_bit(gram, n)) != 0


def _gram_bits(grams: DataFrame, n: int = FILTER_BITS) -> list[int]:
    """The table of the hashes of column ``gram`` as signed longs: at most ``n`` / 64 rows come to the driver."""
    gram, table = F.col("gram"), [0] * (n // 64)
    for r in grams.groupBy(_place(gram, n).alias("place")).agg(F.bit_or(_bit(gram, n)).alias("bits")).collect():
        table[r["place"]] = r["bits"]
    return table


def _gram_size(keyword: Column, q: int) -> Column:
    """Characters of the gram that files a keyword: twice ``q`` where it is so long (few other texts hold such a run), ``q``, or all of it."""
    n = F.length(keyword)
    return F.when(n >= 2 * q, 2 * q).otherwise(F.least(n, F.lit(q)))


def _text_counts(texts: DataFrame, sizes: list[int]) -> list[int]:
    """How many texts hold a gram of each hash: at most ``COUNTERS`` rows come to the driver. A shared hash only counts higher."""
    counts = [0] * COUNTERS
    places = F.explode(F.transform(all_grams(F.col("text"), sizes), _counter))
    for r in texts.select(places.alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["place"]] = r["n"]
    return counts


def _index(rules: DataFrame, texts: DataFrame, gram_size: int) -> tuple[DataFrame, list[int]]:
    """(``gram``, ``priority``, ``keyword``, ``label``) and the gram lengths in use; a keyword under the gram that fewest texts hold."""
    size = _gram_size(F.col("keyword"), gram_size)
    sizes = sorted(r["s"] for r in rules.select(size.alias("s")).distinct().collect())
    own = F.lit(None).cast("array<string>")
    for s in sizes:
        own = F.when(size == s, grams(F.col("keyword"), s)).otherwise(own)
    table = long_array(_text_counts(texts, sizes))
    rare = F.array_min(F.transform(own, lambda g: F.struct(F.get(table, _counter(g)).alias("texts"), g.alias("gram"))))
    # a keyword with a gram that no text holds is in no text: it is dropped where it is read
    filed = rules.select(rare.alias("rare"), "priority", "keyword", "label").where("rare.texts > 0")
    return filed.select("rare.gram", "priority", "keyword", "label").distinct(), sizes


def _best(texts: DataFrame, rules: DataFrame, gram_size: int) -> DataFrame:
    """(``_text_key``, ``_label``) of the texts that hold one of the stored ``rules``: the label of the first."""
    key = "_text_key"
    index, sizes = _index(rules, texts, gram_size)
    index = stored(index, "keyword-index")
    passes = _passes(_gram_bits(index))
    cut = texts.select(key, F.explode(F.filter(all_grams(F.col("text"), sizes), passes)).alias("gram"))
    possible = cut.join(index, "gram").drop("gram")
    held = texts.join(possible, key).where(F.contains("text", "keyword"))
    best = held.groupBy(key).agg(F.min_by("label", F.struct("priority", "keyword", F.coalesce("label", F.lit("")))).alias("_label"), F.lit(True).alias("_held"))
    return stored(best, "keyword-labels")


def _step_end(rules: DataFrame, sampled: int):
    """The priority up to which there are about ``sampled * FIRST`` rules; None if there are not so many. ``FIRST`` rows come to the driver.

    The condition is on the keyword alone, so the optimizer puts it below a ``distinct`` over keywords.
    """
    some = rules.where(F.pmod(F.xxhash64("keyword"), F.lit(sampled)) == 0).select("priority").orderBy("priority").limit(FIRST).collect()
    return some[-1]["priority"] if len(some) == FIRST else None


def _possible(rules: DataFrame, texts: DataFrame, gram_size: int) -> DataFrame:
    """``rules`` without those whose keyword has a gram that no text holds (a shared hash, or a gram not looked up, lets some pass).

    Keywords shorter than ``gram_size`` all pass; of others the runs of the largest of ``LEFT_SIZES`` times ``gram_size`` that fits are
    looked up, the first, the last, and of the longest runs one between: substrings at fixed places, which Spark compiles.
    """
    keyword = F.col("keyword")
    n, keep = F.length(keyword), F.lit(True)
    for size in (k * gram_size for k in LEFT_SIZES):
        passes = _passes(_gram_bits(texts.select(F.explode(grams(F.col("text"), size)).alias("gram")), LEFT_BITS))
        found = F.lit(True)
        between = [F.least(F.lit(1 + gram_size), n - size + 1)] if size == max(LEFT_SIZES) * gram_size else []
        for at in (F.lit(1), n - size + 1, *between):
            found = found & passes(keyword.substr(at, F.lit(size)))
        keep = F.when(n >= size, found).otherwise(keep)
    return rules.where(keep)


def first_labels(df: DataFrame, text_col: str, rules: DataFrame, out_col: str = "label", default: str | None = None, gram_size: int = GRAM) -> DataFrame:
    """``df`` with ``out_col``: the label of the first rule (by ``priority``) whose ``keyword`` the text contains.

    ``rules``: (``priority``, ``keyword``, ``label``); of equal priorities the smaller keyword, then the smaller label, comes
    first. Matching is by code points and case-sensitive; lower-case both sides where needed. A null text, and one that
    contains no keyword, gets ``default``; rules with a null keyword or priority never match; an empty rule
    table gives ``default`` throughout. Equal to ``functions.text.first_label`` with the rules in that order. More than some
    ``SAMPLED * FIRST`` rules are evaluated three times (store them first if that is dear).
    """
    rules = rules.select("priority", "keyword", "label").where("keyword IS NOT NULL AND priority IS NOT NULL")
    name, key, priority = F.col(text_col), "_text_key", F.col("priority")
    rows = df.withColumn(key, F.unhex(F.md5(name)))
    sampled = SAMPLED
    end = _step_end(rules, sampled)
    step = stored(rules if end is None else rules.where(priority <= F.lit(end)), "keyword-rules")
    if end is None and step.isEmpty():
        return df.withColumn(out_col, F.lit(default).cast("string"))
    left = stored(rows.where(name.isNotNull()).select(key, name.alias("text")).dropDuplicates([key]), "keyword-texts")
    best = _best(left, step, gram_size)
    labels = best
    while end is not None:
        left = stored(left.join(best, key, "left_anti"), "keyword-texts")
        if left.isEmpty():
            break
        rules = stored(_possible(rules.where(priority > F.lit(end)), left, gram_size), "keyword-rules")
        sampled *= GROWTH
        end = _step_end(rules, sampled)
        best = _best(left, rules if end is None else rules.where(priority <= F.lit(end)), gram_size)
        labels = labels.unionByName(best)
    out = rows.join(labels, key, "left").withColumn(out_col, F.when(F.col("_held"), F.col("_label")).otherwise(F.lit(default)))
    return out.drop(key, "_label", "_held")
