"""Exact removal of repeated word runs by level-wise doubling of repeated windows.

A window of ``length`` words (35) is judged by its words alone. The levels are a quarter, a half and all of
it: 9, 18, 35. Only windows that are repeated at one level are extended to the next, twice as long one:

* Level 9. Each 35-word window is represented by its 9-word window of the smallest hash, leftmost on ties
  (its anchor). The choice depends on the 35 words alone, so equal windows have equal anchors at equal
  places, and a window whose anchor occurs once is not repeated. Windows that follow one another share an
  anchor; such a run is one row, about one for 14 words.
* Level 18. Surviving anchors are extended to 18 words, to the right for windows that reach that far, else to
  the left.
* Level 35. A run whose whole context (all words of its windows) is repeated needs no more. For the other
  survivors the windows themselves are hashed (twice 64 bits) and counted.

Equal contexts are counted before windows are made, so a passage that a third of all documents share costs
one set of windows, not one for each copy. All counts are partial before a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import doc_columns, same_row, slices, utf8, written
from sheaf.llm.words import U64, WORD_BASE_2, Rolling, mix, windows, word_hashes, word_spans


def _minima(key: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by doubling."""
    step = 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    rest = width - step
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def anchors(offsets: np.ndarray, data: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """Runs of windows with one anchor: row, first window start, windows, anchor start (in words of the row), hashes."""
    base, half = (length + 3) // 4, (length + 1) // 2
    starts, ends, first = word_spans(offsets, data)
    at, rows = windows(first, length)
    if not len(at):
        return None
    rolling = Rolling(word_hashes(data, starts, ends))
    grams = mix(rolling.run(np.arange(len(starts) - base + 1), base))
    bits = U64(int(len(starts)).bit_length())
    key = grams >> bits << bits
    key |= np.arange(len(key), dtype=U64)
    anchor = (_minima(key, length - base + 1)[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    change = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(change, append=len(at))
    s, a, row = at[change], anchor[change], rows[change]
    place = ((a - s) << 20 | count).astype(U64)
    left, right = s <= a - half, s + count - 1 > a - half
    wide = np.where(left, a - (half - base), a)
    return {
        "row": row, "h": grams[a], "start": s - first[row], "count": count, "split": np.clip(a - half + 1 - s, 0, count),
        "left": np.where(left, mix(rolling.run(wide, half)), U64(0)), "right": np.where(right, mix(rolling.run(np.where(right, a, s), half)), U64(0)),
        "context": mix(rolling.run(s, count + length - 1) ^ mix(place)),
    }


def _anchor_rows(length: int):
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int32()), ("h", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("split", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in slices(batch.column("_text")):
                if found := anchors(offsets, data, length):
                    row = pa.array(found["row"])
                    columns = [batch.column("_id").slice(lo, hi - lo).take(row), batch.column("_h").slice(lo, hi - lo).take(row)]
                    columns += [pa.array(found[k].view(np.int64)) for k in ("h", "left", "right", "context")]
                    columns += [pa.array(found[k].astype(np.int32)) for k in ("start", "count", "split")]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _window_rows(length: int):
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int32()), ("start", pa.int32()), ("n", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in slices(batch.column("_text")):
                starts, ends, first = word_spans(offsets, data)
                words = word_hashes(data, starts, ends)
                runs = batch.column("runs").slice(lo, hi - lo)
                flat, per = runs.flatten(), np.asarray(runs.value_lengths().fill_null(0))
                s, m, n = (np.asarray(flat.field(k), np.int64) for k in ("start", "count", "n"))
                row = np.repeat(np.repeat(np.arange(hi - lo), per), m)
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(s, m)
                where = first[row] + at
                hashes = [pa.array(mix(h.run(where, length)).view(np.int64)) for h in (Rolling(words), Rolling(mix(words), WORD_BASE_2))]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(lo, hi - lo).take(take), batch.column("_h").slice(lo, hi - lo).take(take), pa.array(at.astype(np.int32)), pa.array(np.repeat(n, m)), *hashes], schema=schema)

    return run


def _removal(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("_text"))
            runs = batch.column("runs")
            flat, per = runs.flatten(), np.asarray(runs.value_lengths().fill_null(0))
            s, m = (np.asarray(flat.field(k), np.int64) for k in ("start", "count"))
            first = np.cumsum(per) - per
            n_words, n_removed, kept, size, begun = [], [], [], 0, 0
            for i, k in enumerate(per.tolist()):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n_words.append(len(words))
                if k:
                    own = slice(first[i], first[i] + k)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, s[own], 1)
                    np.add.at(cover, s[own] + m[own] + length - 1, -1)
                    words = list(compress(words, np.cumsum(cover)[:-1] == 0))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                size += len(kept[-1])
                if size >= 8 << 20 or i == len(per) - 1:  # so that the output is never much larger than one text
                    yield pa.RecordBatch.from_arrays([batch.column("_id").slice(begun, i + 1 - begun), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)
                    n_words, n_removed, kept, size, begun = [], [], [], 0, i + 1

    return run


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(``_id``, ``_h``, ``start``, ``count``): ``count`` windows from word ``start`` on occur elsewhere too. docs: see doc_columns."""
    key = "_id long, _h int"
    found = docs.mapInArrow(_anchor_rows(length), f"{key}, h long, left long, right long, context long, start int, count int, split int")
    # written first: a join of two plain tables can be split where one anchor holds many rows
    often = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "often")
    alive = written(found.join(often, "h"), "anchors")
    # level 9: runs by their whole context; only contexts that differ within an anchor need their windows compared
    place = ["_id", "_h", "start", "count", "split", "left", "right"]
    contexts = written(alive.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("r")), "contexts")
    whole = alive.join(contexts.where("n > 1").select("h", "context"), ["h", "context"]).select("_id", "_h", "start", "count")
    differ = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h")
    runs = contexts.join(differ, "h").select("n", "r.*")
    # level 18: the windows left of the split hold the anchor extended to the left, the others to the right
    half = runs.select(
        "_id", "_h", "n",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("left").alias("hash"), F.col("start"), F.col("split").alias("count")),
            F.struct(F.lit(1).alias("side"), F.col("right").alias("hash"), (F.col("start") + F.col("split")).alias("start"), (F.col("count") - F.col("split")).alias("count")),
        )).alias("p"),
    ).select("_id", "_h", "n", "p.*").where("count > 0")
    half = written(half, "halves")
    alive = half.join(half.groupBy("side", "hash").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("side", "hash"), ["side", "hash"])
    # level 35: the windows themselves
    per_doc = alive.groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "count", "n")).alias("runs"))  # one row a context, so no copies
    joined = per_doc.join(docs, same_row(per_doc, docs)).select(docs["_id"], docs["_h"], "_text", "runs")
    made = written(joined.mapInArrow(_window_rows(length), f"{key}, start int, n long, w1 long, w2 long"), "windows")
    again = made.groupBy("w1", "w2").agg(F.sum("n").alias("k")).where("k > 1").select("w1", "w2")
    single = made.where("n = 1").join(again, ["w1", "w2"]).select("_id", "_h", "start", F.lit(1).alias("count"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_removed``, ``kept_text``), one row per row of ``docs``.

    Words are runs of anything but U+0020 and U+0009 to U+000D, unchanged. Removed are all words that a window
    of ``length`` words covers whose words also start anywhere else, in the same document or another; windows
    are judged on the input. ``kept_text`` joins the rest by one space.

    Null and blank texts have no words. A repeated row is another occurrence, so all its windows go (from
    ``length`` words on), and rows without id are treated like others. An empty table gives an empty one. Other
    columns of ``docs`` are not looked at.
    """
    d = doc_columns(docs, id_col, text_col)
    found = repeated_runs(d, length)
    # repeated rows have the same runs: each is kept once, or every copy would get those of all copies
    per_doc = found.distinct().groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    joined = d.join(per_doc, same_row(d, per_doc), "left").select(d["_id"], "_text", "runs")
    return joined.mapInArrow(_removal(length), "doc_id long, n_words long, n_removed long, kept_text string")
