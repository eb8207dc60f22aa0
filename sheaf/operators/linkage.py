"""JOB8: record linkage of questions, so that given answers meet the gold answers they are scored against.

Two questions are linked if their word sequences (lower-cased runs of letters and digits) lie within
``floor(share * words of the longer one)`` word edits: insertions, deletions and replacements of whole words.
Equal questions are one class and are worked on once, however often they are asked.

Candidates come from an equi-join on rare words. Sequences n and m words long within d edits share at least
max(n, m) - d words, repeats counted; so, with the words of every question in one common order, they share
one of their first d + 1 (``share`` below 1/2, so a prefix never outgrows its question). The order is by
frequency, rarest first: hot words are nearly never joined on. Frequencies are counters of hashed words in a table of fixed size, which
a task holds as an array; a collision only makes a word look more frequent.

Most rows that meet in a word are far apart otherwise, so each carries a sketch of its words: bit ``k`` says whether an odd
number of them hash to ``k``. One edit turns at most two of its 128 bits, so a pair whose sketches differ in more than twice its
edits goes at once, before any words are fetched. Every candidate left is verified by its word edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.vectors import tokens
from sheaf.session import stored

#: Counters of hashed words (four megabytes in every task, whatever the data).
COUNTERS = 1 << 20
#: Bits of a sketch, in two halves.
SKETCH = 128


def question_key(question) -> Column:
    """The class of a question: equal for equal word sequences, null without a word."""
    words = tokens(question)
    return F.when(F.size(words) > 0, F.unhex(F.md5(F.array_join(words, " "))))


def word_edits(a: list[str], b: list[str]) -> int:
    """Word edit distance of two sequences, a column of the table at once as the bits of numbers (steps up, steps down)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full, last, distance = (1 << len(b)) - 1, 1 << len(b) - 1, len(b)
    up, down = full, 0
    for w in a:
        hit = places.get(w, 0)
        steady = hit | down
        level = (((hit & up) + up) ^ up) | hit
        right_up, right_down = (down | ~(level | up)) & full, up & level
        distance += (right_up & last > 0) - (right_down & last > 0)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = (right_down | ~(steady | right_up)) & full, right_up & steady
    return distance


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of ``b`` at once as the bits of one number."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    open_ = full  # a bit that is off: the subsequence grew at this word
    for w in a:
        hit = open_ & places.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(b) - open_.bit_count()


def _pairwise(fn):
    """An Arrow UDF of two word lists."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run


def edit_budget(share: float, n: Column) -> Column:
    """Edits allowed where the longer question has ``n`` words."""
    return F.floor(F.lit(share) * n + F.lit(1e-9))


def _prefixes(share: float, counters):
    """The first words of each question in the common order, as many as any partner calls for."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int32()), ("asked", pa.bool_()), ("known", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        for batch in batches:
            out: list[tuple] = []
            for key, asked, known, hashes in zip(*(batch.column(c).to_pylist() for c in ("key", "asked", "known", "hashes"))):
                n, seen, places, sketch = len(hashes), {}, [], 0
                for h in hashes:  # the second "the" of a question is a word of its own, after every first one in rarity
                    sketch ^= 1 << (h >> 24) % SKETCH
                    again = seen[h] = seen.get(h, -1) + 1
                    places.append((int(counts[h % COUNTERS]) >> again, h + again * 0x9E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF))
                longest = int(n / (1 - share) + 1e-9)
                prefix = int(share * longest + 1e-9) + 1
                low, high = (x - (x >> 63 << 64) for x in (sketch & (1 << 64) - 1, sketch >> 64))
                out += [(key, n, asked, known, low, high, w) for _, w in sorted(places)[:prefix]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def link_questions(asked: DataFrame, known: DataFrame, share: float = 0.2, asked_question: str = "question", known_id: str = "id",
                   known_question: str = "question") -> DataFrame:
    """(``key``, ``known_id``, ``distance``): the closest known question of every asked class that has one.

    ``key`` is ``question_key`` of the asked text. Of known questions at one distance, the one of the smallest id
    is taken; of known rows that ask the same, the one of the smallest id stands for all. Questions without
    a word and rows without id are linked with nothing. ``share`` must lie between 0 and 1/2.
    """
    if not 0 <= share < 0.5:
        raise ValueError("share must be at least 0 and less than 1/2")
    spark = asked.sparkSession

    def side(df, question, ident):
        words = tokens(F.col(question))
        return df.select(words.alias("words"), question_key(F.col(question)).alias("key"), ident.alias("known_id"), ident.isNull().alias("asked"))

    kind = known.schema[known_id].dataType
    both = side(asked, asked_question, F.lit(None).cast(kind)).unionByName(side(known.where(F.col(known_id).isNotNull()), known_question, F.col(known_id)))
    classes = both.where("key IS NOT NULL").groupBy("key").agg(F.first("words").alias("words"), F.min("known_id").alias("known_id"), F.max("asked").alias("asked"))
    classes = stored(classes, "question-classes").withColumn("known", F.col("known_id").isNotNull())
    same = classes.where("asked AND known").select("key", "known_id", F.lit(0).alias("distance"))

    hashes = F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 63) - 1)))
    hashed = classes.select("key", "asked", "known", hashes.alias("hashes"))
    counts = np.zeros(COUNTERS, np.int32)
    buckets = hashed.select(F.explode("hashes").alias("h")).groupBy((F.col("h") % COUNTERS).cast("int").alias("bucket")).count()
    buckets = buckets.select("bucket", F.least(F.col("count"), F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()  # a row a counter at most
    counts[np.asarray(buckets["bucket"])] = np.asarray(buckets["n"])
    counters = spark.sparkContext.broadcast(counts)
    prefixes = hashed.mapInArrow(_prefixes(share, counters), "key binary, n int, asked boolean, known boolean, low long, high long, word long")
    prefixes = stored(prefixes, "question-prefixes")  # read from both sides of the join
    left = prefixes.where("asked AND NOT known").select("word", "key", "n", "low", "high")
    right = prefixes.where("known").select("word", F.col("key").alias("known_key"), F.col("n").alias("m"), F.col("low").alias("known_low"), F.col("high").alias("known_high"))
    budget = edit_budget(share, F.greatest("n", "m"))
    turned = sum(F.bit_count(F.col(half).bitwiseXOR(F.col(f"known_{half}"))) for half in ("low", "high"))
    near = (F.abs(F.col("n") - F.col("m")) <= budget) & (turned <= 2 * budget)
    pairs = left.join(right, "word").where(near).select("key", "known_key").distinct()

    ask = classes.select("key", F.col("words").alias("left"))
    know = classes.select(F.col("key").alias("known_key"), F.col("words").alias("right"), "known_id")
    checked = pairs.join(ask, "key").join(know, "known_key").select("key", "known_id", _pairwise(word_edits)("left", "right").alias("distance"),
                                                                    F.greatest(F.size("left"), F.size("right")).alias("longer"))
    best = checked.where(F.col("distance") <= edit_budget(share, F.col("longer"))).groupBy("key").agg(F.min(F.struct("distance", "known_id")).alias("best"))
    return same.unionByName(best.select("key", "best.known_id", "best.distance"))


def subsequence_length(a, b) -> Column:
    """Length of the longest common subsequence of two word lists."""
    return _pairwise(common_subsequence)(a, b)
