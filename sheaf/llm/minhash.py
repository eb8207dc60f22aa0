"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle space gives two signature values, the smallest and the largest image of a
document's shingles, so a signature of 160 values takes 80 hash evaluations per shingle. Both ends agree
between two sets with a probability of their Jaccard similarity, and they are anti-correlated, so the
estimate varies less than that of 160 independent minima. Minima and maxima are banded apart: bands 0 to 15
hold minima, bands 16 to 31 maxima, five permutations each.

A pair of similarity 0.8 misses all 32 bands with a probability of (1 - 0.8**5)**32 = 3e-6.

Candidates are confirmed on whole shingle sets. Rows with equal sets are one class, so copies cost nothing.
In each band bucket every class is compared with the smallest class id, so a group of near copies costs a
comparison or few per row. Only classes of one bucket that this leaves in different components need more: they
get a longer sketch, the lowest bits of 2048 further minima and maxima, and a pair is compared if the sketches
agree as often as those of a pair of similarity 0.8 do, less five standard deviations (a miss in 3 million).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import doc_columns, list_column, slices, written
from sheaf.llm.components import components
from sheaf.llm.words import U64, WORD_BASE, Rolling, _constants, inverse, mix, powers, word_hashes, word_spans

PERMUTATIONS, BAND_ROWS, SKETCH = 80, 5, 1024
#: Shingles that meet all permutations at once; bounds the work area to 80 x 2048 x 8 bytes.
_BLOCK = 2048
_A = _constants(7001, PERMUTATIONS)[:, None] | U64(1)
_B = _constants(7002, PERMUTATIONS)[:, None]
_A2 = _constants(7003, SKETCH)[:, None] | U64(1)
_B2 = _constants(7004, SKETCH)[:, None]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles; fewer words make one shingle."""
    starts, ends, first = word_spans(offsets, data)
    words = word_hashes(data, starts, ends, lower=True)
    rolling = Rolling(words)
    grams = mix(rolling.run(np.arange(max(0, len(words) - size + 1)), size))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            yield np.unique(grams[lo : hi - size + 1])
        elif hi > lo:
            yield mix(rolling.run(np.array([lo]), hi - lo) + U64(hi - lo))
        else:
            yield grams[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Band keys of a non-empty set: 16 from minima, 16 from maxima."""
    low = high = None
    for k in range(0, len(shingles), _BLOCK):
        images = _A * shingles[k : k + _BLOCK]
        images += _B
        lo, hi = images.min(axis=1), images.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    both = np.concatenate([low, high]).reshape(-1, BAND_ROWS)
    keys = (mix(both) * powers(WORD_BASE, BAND_ROWS)[:BAND_ROWS]).sum(axis=1, dtype=U64)
    return mix(keys + np.arange(len(keys), dtype=U64) * U64(inverse(WORD_BASE)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """32 longs: the lowest bits of the mixed minima and maxima of a non-empty set under ``SKETCH`` permutations."""
    low = high = None
    for k in range(0, len(shingles), _BLOCK // 4):
        images = _A2 * shingles[k : k + _BLOCK // 4]
        images += _B2
        lo, hi = images.min(axis=1), images.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.packbits((mix(np.concatenate([low, high])) & U64(1)).astype(bool)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    for batch in batches:
        made = [sketch(np.asarray(x.values).view(np.uint64)) for x in batch.column("set")]
        flat, ends = np.concatenate(made) if made else np.empty(0, np.int64), np.arange(len(made) + 1) * (2 * SKETCH // 64)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), list_column(flat, ends, pa.int64())], schema=schema)


def differing_bits(percent: int) -> int:
    """Bits in which the sketches of two sets of that similarity differ, plus five standard deviations."""
    n, p = 2 * SKETCH, (1 - percent / 100) / 2
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5) + 1


def _signatures(size: int):
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id")
            for lo, hi, offsets, data in slices(batch.column("_text")):
                n, c1, c2, bands, ends = [], [], [], [], [0]
                for s in shingle_sets(offsets, data, size):
                    n.append(len(s))
                    c1.append(s.sum(dtype=U64))
                    c2.append(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
                    if len(s):
                        bands.append(signature(s))
                    ends.append(ends[-1] + (len(bands[-1]) if len(s) else 0))
                flat = np.concatenate(bands).view(np.int64) if bands else np.empty(0, np.int64)
                columns = [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(np.array(c1, U64).view(np.int64)), pa.array(np.array(c2, U64).view(np.int64)), list_column(flat, np.array(ends), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("rep", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("rep")
            for lo, hi, offsets, data in slices(batch.column("_text")):
                found = list(shingle_sets(offsets, data, size))
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), list_column(flat, ends, pa.int64())], schema=schema)

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole sets reach ``percent`` % Jaccard similarity."""
    one = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return met.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``), one row per row of ``docs``.

    Documents are linked if their sets of ``size``-word shingles (A-Z folded; fewer words: the whole sequence
    as one shingle) have a Jaccard similarity of at least ``percent`` / 100. ``component_id`` is the smallest
    id reachable over links, ``kept`` says that it is the row's own.

    Null or blank texts have no shingles and are linked with nothing. Rows that repeat an id with an equal
    text are in one component and all kept; an id is taken to stand for one text. A row without id joins the
    component of rows with an equal set that have one; else its component is null and it is kept. An empty
    table gives an empty one. Other columns of ``docs`` are not looked at.
    """
    d = doc_columns(docs, id_col, text_col)
    signed = written(d.select("_id", "_text").mapInArrow(_signatures(size), "_id long, n long, c1 long, c2 long, bands array<long>"), "minmax")
    classes = signed.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("_id").alias("rep"), F.first("bands").alias("bands")).where("rep is not null")
    members = written(classes.select("rep", "n", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("center"), F.max("rep").alias("last")).where("center.rep <> last")
    buckets = written(buckets.select("key", "center"), "centers")  # a plain table, so that a hot key's join can be split
    shared = written(members.join(buckets, "key"), "buckets")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  no other sizes can reach the similarity
    stars = written(
        shared.where((F.col("rep") != F.col("center.rep")) & alike(F.col("n"), F.col("center.n")))
        .select(F.col("center.rep").alias("a"), F.col("rep").alias("b")).distinct(),
        "stars",
    )
    wanted = shared.select("rep").distinct()
    sets = written(
        d.select(F.col("_id").alias("rep"), "_text").join(wanted, "rep").mapInArrow(_sets(size), "rep long, set array<long>").dropDuplicates(["rep"]),
        "sets",
    )
    links = written(confirmed(stars, sets, percent), "links")
    roots = components(links)
    placed = shared.join(roots, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "n", F.coalesce("root", "rep").alias("root"))
    mixed = written(placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key"), "mixed")
    open_ = written(placed.join(mixed, "key"), "open")
    sketches = sets.join(open_.select("rep").distinct(), "rep").mapInArrow(_sketches, "rep long, sketch array<long>")
    sketches = written(sketches.join(classes.select("rep", "bands"), "rep"), "sketches")
    open_ = open_.join(sketches, "rep")
    one = open_.select("key", "band", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("sketch").alias("sa"), F.col("bands").alias("ka"))
    two = open_.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("sketch").alias("sb"), F.col("bands").alias("kb"))
    differ = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(2 * SKETCH // 64)), F.lit(0))
    # a pair that shares several bands meets in the first of them only
    earlier = reduce(or_, ((F.col("band") > k) & (F.col("ka")[k] == F.col("kb")[k]) for k in range(2 * PERMUTATIONS // BAND_ROWS)))
    met = (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & alike(F.col("na"), F.col("nb")) & (differ <= differing_bits(percent)) & ~earlier
    rest = one.join(two, met)
    rest = rest.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = written(confirmed(written(rest, "rest"), sets, percent), "links")
    roots = components(links.unionByName(more))
    named = classes.select("c1", "c2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("root", "rep").alias("root"))
    out = signed.select("_id", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.coalesce("root", "_id")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, component.isNull()).alias("kept"))
