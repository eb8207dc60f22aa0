"""Line dedup by an exact set-similarity join.

A line is the set of its words. Two lines match if their Jaccard similarity is at least ``percent`` / 100 (80); a
line is removed if any earlier line (by document id, then place) matches it, judged on the input.

Words are ordered by rarity, then hash. Of two matching lines, the rarest n - ceil(0.8 n) + 1 words (the prefix)
share one. So a line is looked up by its prefix words only, and words that no other line has are not looked up
at all. Rarity comes from a table of 2**22 counters that words are hashed to: it only decides the order and
which words are certainly alone, so collisions cost work, not results, and its size is the same for any corpus.

Equal sets are one class with one first line. Classes that share a prefix word are compared if their sizes
allow it (length filter), if the places of the word leave enough words to share (positional filter), and if the
parities of their words, hashed to 128 bits, differ in no more bits than words may differ. What remains is
verified on whole word sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import long_array
from sheaf.llm.common import drop_written, list_column, slices, utf8, written
from sheaf.llm.words import U64, mix, word_hashes, word_spans

CELL_BITS, PART_BITS = 22, 16
#: Bytes of a word's hash in a set that is compared whole: two lines of 40 words are taken wrong once in 700 million pairs.
WORD_BYTES = 5
#: Bits of a word's place in a packed row; a later place counts as the last, which weakens the positional filter and is never wrong.
PLACE_BITS = 12
_LEVELS = 3  # counts up to this have a level of their own


def line_words(offsets: np.ndarray, data: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct words of all lines: line, word hash, level; then the first line of each row (one more than rows).

    Lines are numbered through the slice and come in order; a line's words come by level, then hash.
    """
    starts, ends, first = word_spans(offsets, data)
    words = word_hashes(data, starts, ends)
    feeds = np.flatnonzero(data == 10)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line = np.searchsorted(feeds, starts) + rows
    level = levels[words >> U64(64 - CELL_BITS)] if levels is not None else np.zeros(len(words), np.uint8)
    bits = max(1, int(len(feeds) + len(first)).bit_length())
    spare = 64 - bits - 8
    key = line.astype(U64) << U64(64 - bits) | level.astype(U64) << U64(spare) | words >> U64(64 - spare)
    order = np.argsort(key)
    line, words, level = line[order], words[order], level[order]
    new = np.ones(len(words), bool)
    new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
    first_line = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    return line[new], words[new], level[new], first_line


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for _, _, offsets, data in slices(batch.column("_text")):
            starts, ends, _ = word_spans(offsets, data)  # a word said twice in a line counts twice: that costs a look-up at most
            np.add.at(counts, (word_hashes(data, starts, ends) >> U64(64 - CELL_BITS)).astype(np.int64), 1)
    if counts.any():
        yield _packed(dict(enumerate(counts.reshape(-1, 1 << PART_BITS))))


def _packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], names=["part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
            x = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
            total[part] = total[part] + x if part in total else x
    if total:
        yield _packed(total)


def rarity(docs: DataFrame) -> np.ndarray:
    """A level for each of the 2**22 counters: the count up to 3, then growing with its logarithm, below 256.

    The counters of a task and all sums are of fixed size; 4 MB reach the driver, whatever the input.
    """
    kind = "part int, counts binary"
    parts = 1 << (CELL_BITS - PART_BITS)
    counts = np.zeros((parts, 1 << PART_BITS), np.int64)
    for row in docs.select("_text").mapInArrow(_cells, kind).repartition(parts, "part").mapInArrow(_summed, kind).collect():
        counts[row.part] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    grown = _LEVELS + np.floor(8 * np.log2(np.maximum(counts, _LEVELS) / _LEVELS) / 2)
    return np.where(counts <= _LEVELS, counts, np.minimum(grown + 1, 255)).astype(np.uint8).ravel()


def _least_common(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _line_rows(shared, percent: int):
    schema = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("c", pa.int64()), ("parity", pa.int64()), ("parity2", pa.int64()), ("words", pa.list_(pa.int32())), ("skip", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for lo, hi, offsets, data in slices(batch.column("_text")):
                line, words, level, first_line = line_words(offsets, data, levels)
                if not len(line):
                    continue
                begun = np.flatnonzero(np.diff(line, prepend=-1))
                n = np.diff(begun, append=len(line))
                place = np.arange(len(line)) - np.repeat(begun, n)
                asked = (place < np.repeat(n - _least_common(n, percent) + 1, n)) & (level >= 2)
                per = np.add.reduceat(asked.astype(np.int64), begun)
                some = per > 0  # words that are alone come first, so those asked for have consecutive places
                number = line[begun]
                row = np.searchsorted(first_line, number, "right") - 1
                take, ends = pa.array(row[some]), np.concatenate([[0], np.cumsum(per[some])])
                one = U64(1) << (words >> U64(57) & U64(63))
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(lo, hi - lo).take(take), batch.column("_h").slice(lo, hi - lo).take(take),
                    pa.array((number - first_line[row])[some].astype(np.int32)), pa.array(n[some].astype(np.int32)),
                    pa.array(np.add.reduceat(mix(words), begun)[some].view(np.int64)),
                    *(pa.array(np.bitwise_xor.reduceat(np.where(words >> U64(63) == half, one, U64(0)), begun)[some].view(np.int64)) for half in (0, 1)),
                    list_column((words[asked] >> U64(32)).astype(np.uint32).view(np.int32), ends, pa.int32()), pa.array(place[asked][ends[:-1]].astype(np.int32)),
                ], schema=schema)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            small = pa.array([None if not t.is_valid else press.compress(t.as_buffer()) for t in part.column(at).cast(pa.binary())], pa.binary())
            yield part.set_column(at, "_text", small)


def _unpack(small: pa.Array) -> pa.Array:
    opened = zstandard.ZstdDecompressor()
    return pa.array([None if not t.is_valid else opened.decompress(t.as_buffer()) for t in small], pa.binary()).cast(pa.string())


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` compressed (Zstandard), for shuffles of whole texts."""
    kind = ", ".join(f"`{f.name}` {'binary' if f.name == '_text' else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_pack, kind)


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word sets of the lines that a text is asked for, as the first ``WORD_BYTES`` bytes of each word's hash."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            for lo, hi, offsets, data in slices(_unpack(part.column("_text"))):
                line, words, _, first_line = line_words(offsets, data)
                lists = part.column("lines").slice(lo, hi - lo)
                flat, per = lists.flatten(), np.asarray(lists.value_lengths())
                number = np.repeat(first_line[:-1], per) + np.asarray(flat.field("line"), np.int64)
                begun, ended = (np.searchsorted(line, number, side) for side in ("left", "right"))
                n = ended - begun
                ends = np.concatenate([[0], np.cumsum(n)])
                own = words[np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(begun, n)] >> U64(64 - 8 * WORD_BYTES)
                short = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
                sets = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64) * WORD_BYTES), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([flat.field("u"), sets.cast(pa.binary())], names=["u", "set"])


#: Earlier rows that a row of one word is compared with, at each end of them; a word with more rows is finished later.
NEAR = 1024
#: Pairs of rows that are compared at once.
PAIRS = 1 << 17
#: Candidates of a row in a word that are verified, the closest ones; a row with more that matches none is finished later.
CLOSEST = 16


def _allowed(percent: int, n1, n2):
    """Words in which two matching sets of these sizes differ at most."""
    both = n1 + n2
    return both - 2 * -(-percent * both // (100 + percent))


def _passes(percent: int, n1, p1, i1, n2, p2, i2, q1=0, q2=0) -> tuple[np.ndarray, np.ndarray]:
    """Whether lines with a common prefix word may match, by sizes, places of the word and parities (p and q); bits that differ."""
    both = n1 + n2
    common = -(-percent * both // (100 + percent))
    bits = sum(np.bitwise_count(np.asarray(x, np.int64).view(np.uint64)).astype(np.int64) for x in (p1 ^ p2, q1 ^ q2))
    ok = (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(i1, i2) + np.minimum(n1 - i1, n2 - i2) >= common)
    return ok & (bits <= both - 2 * common), bits


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The fields of packed rows (see ``looked``)."""
    a, b, *parity = (np.asarray(batch.column(k)) for k in ("a", "b", "parity", "parity2"))
    return {"word": a >> 32, "n": a & 0xFFFFFFFF, "u": b >> PLACE_BITS, "place": b & ((1 << PLACE_BITS) - 1), "parity": parity[0], "parity2": parity[1]}


def _closest(percent: int):
    """(``b``, ``open``, ``a``): the candidates of each class in each word; open: 1 if there may be more, without ``a`` if none was met.

    One candidate is enough if it differs in a quarter of the bits that it may differ in; else the ``CLOSEST`` are taken.
    """
    schema = pa.schema([("b", pa.int64()), ("open", pa.int32()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, cut = None, False  # rows of the word that the last batch ended in; whether some of them are missing
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _unpacked(batch)
            old = 0
            if kept is not None and kept["word"][0] == now["word"][0]:
                old = len(kept["word"])
                now = {k: np.concatenate([kept[k], now[k]]) for k in now}
            else:
                cut = False
            begun = np.flatnonzero(np.diff(now["word"], prepend=now["word"][0] - 1))
            ends = np.append(begun[1:], len(now["word"]))
            u = now["u"]
            # a class whose words share a hash has several rows of it, one after the other: it does not meet itself
            rows = np.arange(len(u))
            own = np.maximum.accumulate(np.where(np.diff(u, prepend=u[0] - 1) != 0, rows, 0))
            own = np.maximum(own, np.repeat(begun, ends - begun))
            open_ = np.zeros(len(u), bool)
            if cut:
                open_[old : ends[0]] = True  # no match among the rows kept proves nothing
            at, match = _candidates(percent, now, begun, own, rows[old:], open_)
            alone = open_.copy()
            alone[at] = False
            alone = np.flatnonzero(alone)
            out, match = np.concatenate([at, alone]), np.concatenate([match, alone])
            yield pa.RecordBatch.from_arrays([pa.array(u[out]), pa.array(open_[out].astype(np.int32)), pa.array(u[match], mask=np.arange(len(out)) >= len(at))], schema=schema)
            last = slice(begun[-1], None)
            cut = cut and len(begun) == 1
            kept = {k: v[last] for k, v in now.items()}
            if len(kept["word"]) > 2 * NEAR:
                kept, cut = {k: np.concatenate([v[:NEAR], v[-NEAR:]]) for k, v in kept.items()}, True

    return run


def _candidates(percent: int, now, begun, own, rows, open_) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier row) of the candidates of ``rows``; marks rows that have more of them in ``open_``.

    begun: first row of each word; own: first row of a row's class in its word. Rows of one word and of sizes that can match lie
    together once sorted, so other pairs are not made; ``PAIRS`` pairs are held at once, or those of one row.
    """
    n, p, i, q = (now[k] for k in ("n", "parity", "place", "parity2"))
    word = np.repeat(np.arange(len(begun)), np.diff(begun, append=len(n))) << 32
    order = np.argsort(word | n, kind="stable")
    key = (word | n)[order]
    lo = np.searchsorted(key, word[rows] | _least_common(n[rows], percent))
    count = np.searchsorted(key, word[rows] | np.minimum(100 * n[rows] // percent, 0xFFFFFFFF), "right") - lo
    some = count > 1
    rows, lo, count = rows[some], lo[some], count[some]
    total = np.cumsum(count)
    cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, PAIRS), "right"))
    found = [(rows[:0], rows[:0])]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        each = count[a:b]
        y = np.repeat(rows[a:b], each)
        x = order[np.arange(len(y)) + np.repeat(lo[a:b] - (total[a:b] - total[a] + each[0] - each), each)]
        before = x < own[y]
        x, y = x[before], y[before]
        bits = np.bitwise_count((p[x] ^ p[y]).view(np.uint64)).astype(np.int64) + np.bitwise_count((q[x] ^ q[y]).view(np.uint64))
        likely = bits * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
        x, y = x[likely], y[likely]
        ok, bits = _passes(percent, n[x], p[x], i[x], n[y], p[y], i[y], q[x], q[y])
        x, y, bits = x[ok], y[ok], bits[ok]
        if not len(y):
            continue
        first = np.flatnonzero(np.diff(y, prepend=-1))
        many = np.diff(first, append=len(y))
        least = np.minimum.reduceat(bits << 32 | x, first)
        near, least = least & 0xFFFFFFFF, least >> 32
        row = y[first]
        sure = 4 * least <= _allowed(percent, n[near], n[row])
        found.append((row[sure], near[sure]))
        open_[row] |= many > np.where(sure, 1, CLOSEST)
        more = np.repeat(~sure, many)
        x, y, bits, many = x[more], y[more], bits[more], many[~sure]
        ranked = np.lexsort((x, bits, y))[np.arange(len(y)) - np.repeat(np.cumsum(many) - many, many) < CLOSEST]
        found.append((y[ranked], x[ranked]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _words40(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of a column of sets, one after the other, and how many each set has."""
    offsets, data = utf8(column)
    data = data[offsets[0] : offsets[-1]].reshape(-1, WORD_BYTES)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :WORD_BYTES] = data
    return out.view(np.uint64).ravel(), np.diff(offsets) // WORD_BYTES


def _alike(percent: int):
    """``b`` of the pairs of sets that are similar enough: words that both hold stand twice when both are sorted as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                (x, nx), (y, ny) = _words40(part.column("sa")), _words40(part.column("sb"))
                pair = np.arange(part.num_rows, dtype=np.uint64) << U64(8 * WORD_BYTES)
                both = np.sort(np.concatenate([x | np.repeat(pair, nx), y | np.repeat(pair, ny)]))
                twice = both[1:][both[1:] == both[:-1]] >> U64(8 * WORD_BYTES)
                common = np.bincount(twice.astype(np.int64), minlength=part.num_rows)
                ok = 100 * common >= percent * (nx + ny - common)
                yield pa.RecordBatch.from_arrays([part.column("b").filter(pa.array(ok))], names=["b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``b`` of the pairs (``a``, ``b``) of classes whose whole word sets (``u``, ``set``) are similar enough."""
    one, two = (sets.select(F.col("u").alias(k), F.col("set").alias(f"s{k}")) for k in ("a", "b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("b", "sa", "sb").mapInArrow(_alike(percent), "b long").distinct()


def looked(classes: DataFrame) -> DataFrame:
    """Packed rows of (prefix word, class): ``a`` = word and size, ``b`` = class number and place of the word, ``parity``, ``parity2``."""
    each = classes.select("u", "n", "parity", "parity2", "skip", F.posexplode("words").alias("k", "word"))
    place = F.least(F.col("skip") + F.col("k"), F.lit((1 << PLACE_BITS) - 1))
    return each.select(F.shiftleft(F.col("word").cast("bigint"), 32).bitwiseOR(F.col("n").cast("bigint")).alias("a"),
                       F.shiftleft("u", PLACE_BITS).bitwiseOR(place.cast("bigint")).alias("b"), "parity", "parity2")


#: Bits of a table of hashes that says what is certainly not among some keys: half a megabyte, whatever the input.
FILTER_BITS = 1 << 22


def _among(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every value of ``column`` in ``keys``, and for few others while they are few."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), (bucket(x) % 64).cast("int"))
    place = lambda x: F.floor(bucket(x) / 64).cast("int")
    table, key = [0] * (FILTER_BITS // 64), F.col(column)
    for r in keys.groupBy(place(key).alias("place")).agg(F.bit_or(bit(key)).alias("bits")).collect():
        table[r["place"]] = r["bits"]
    bits = long_array(table)
    return lambda x: F.get(bits, place(x)).bitwiseAND(bit(x)) != 0


def later_matches(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(``_id``, ``_h``, ``line``) of all lines that an earlier line matches. docs: ``_id``, ``_h`` (hash of the text), ``_text``.

    A line is removed for one earlier match, so not all of them are looked for. Rows of (prefix word, class of lines) are
    sorted by word, then place, and each class meets the earlier ones with the word: all, or for a word with thousands of
    classes the first and the last ``NEAR`` of them. The closest by parity are verified (see ``_closest``). Classes for which none
    of these is a match though more might be (further candidates, or rows of a word that were not met) then meet all earlier classes
    of their words; only words that they have are looked up again.

    Classes are numbered in the order of their first lines, so rows carry one number instead of (id, hash, line). Each
    table is deleted once its last reader has run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    kind = "_id long, _h long, line int, n int, c long, parity long, parity2 long, words array<int>, skip int"
    lines = written(docs.mapInArrow(_line_rows(shared, percent), kind), "lines")
    shared.destroy()
    # a set is known by the sum of its hashes, its parity and its size; the earliest line stands for it
    key, own = ["c", "parity", "n"], F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_h", "line")
    some = lines.groupBy(*key).agg(F.min(own).alias("first"), F.first("parity2").alias("parity2"), F.first("words").alias("words"), F.first("skip").alias("skip"))
    some = written(some, "sets")
    met = lines.select("_id", "_h", "line", *key).join(some.select(*key, "first"), key)
    at = F.col("first")
    same = F.col("_id").eqNullSafe(at["_id"]) & (F.col("_h") == at["_h"]) & (F.col("line") == at["line"])
    copies = written(met.where(~same).select("_id", "_h", "line"), "copies")
    drop_written(lines)
    order = [F.col(f"first.{c}") for c in ("known", "_id", "_h", "line")]
    classes = some.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("u", F.monotonically_increasing_id())
    classes = written(classes.select("u", "n", "parity", "parity2", "words", "skip", "first._id", "first._h", "first.line"), "classes")
    drop_written(some)

    word = F.shiftright("a", 32)
    dealt = looked(classes).repartition(word).sortWithinPartitions(word, "b")
    near = written(dealt.mapInArrow(_closest(percent), "b long, open int, a long").groupBy("b", "a").agg(F.max("open").alias("open")), "near")
    drop_written()
    likely = near.where("a is not null")

    def sets_of(pairs: DataFrame) -> DataFrame:
        """(``u``, ``set``): the word sets of all classes in ``pairs``, read from the texts of their first lines."""
        wanted = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct()
        key = [F.col("_id").isNotNull().alias("known"), F.coalesce("_id", F.lit(0)).alias("_id"), "_h"]
        names = ["known", "_id", "_h"]
        lists = classes.join(wanted, "u").select(*key, F.struct("line", "u").alias("x")).groupBy(*names).agg(F.collect_list("x").alias("lines"))
        lists = written(lists, "asked")
        # rows that repeat an id and a text are asked once; both sides are dealt by the same columns; texts that are certainly not asked stay
        texts = packed(docs.where(_among(lists, "_h")(F.col("_h")))).select(*key, "_text").dropDuplicates(names)
        return texts.join(lists, names).select("_text", "lines").mapInArrow(_wanted_sets, "u long, set binary")

    sets = written(sets_of(likely), "sets")
    drop_written()
    found = written(confirmed(likely, sets, percent), "found")
    undecided = written(near.where("open > 0").select("b").distinct().join(found, "b", "left_anti"), "undecided")
    drop_written(sets)

    late = found
    if not undecided.isEmpty():
        fields = ["u", "n", "low", "high", "words"]
        each = lambda some: some.withColumnsRenamed({"parity": "low", "parity2": "high"}).select(*fields, "skip", F.posexplode("words").alias("k", "word")).select(*fields, "word", (F.col("skip") + F.col("k")).alias("place"))
        two = written(each(classes.join(undecided.select(F.col("b").alias("u")), "u", "left_semi")), "open")
        one = each(classes).where(_among(two, "word")(F.col("word")))
        one, two_ = (x.select("word", *(F.col(c).alias(f"{c}{k}") for c in (*fields, "place"))) for k, x in ((1, one), (2, two)))
        common = F.ceil(F.lit(percent) * (F.col("n1") + F.col("n2")) / F.lit(100 + percent))
        differ = F.bit_count(F.col("low1").bitwiseXOR(F.col("low2"))) + F.bit_count(F.col("high1").bitwiseXOR(F.col("high2")))
        close = (
            (one["word"] == two_["word"]) & (F.col("u1") < F.col("u2")) & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
            & (F.least("place1", "place2") + F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) >= common)
            & (differ <= F.col("n1") + F.col("n2") - 2 * common)
            & (F.get(F.array_intersect("words1", "words2"), F.lit(0)) == one["word"])  # a pair meets in its first common word only
        )
        rest = one.join(two_, close).select(F.col("u1").alias("a"), F.col("u2").alias("b"))
        rest = written(rest.join(likely, ["a", "b"], "left_anti"), "pairs")
        drop_written(two)
        sets = written(sets_of(rest), "sets")
        drop_written()
        late = written(found.unionByName(confirmed(rest, sets, percent)), "late")
        drop_written(sets, rest)
    gone = late.withColumnRenamed("b", "u").join(classes, "u").select("_id", "_h", "line")
    out = written(copies.unionByName(gone), "gone")
    drop_written(classes, copies, near, found, undecided, *([] if late is found else [late]))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            n, gone, kept = [], [], []
            for text, out in zip(_unpack(part.column("_text")).to_pylist(), part.column("gone").to_pylist()):
                lines = text.split("\n") if text else []
                n.append(len(lines))
                drop = set(out or ())
                left = [x for k, x in enumerate(lines) if k not in drop] if drop else lines
                gone.append(n[-1] - len(left))
                kept.append("\n".join(left) if drop else text)
            columns = [part.column("row"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "kept_text", "n_lines", "n_removed"])


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(``row``, ``kept_text``, ``n_lines``, ``n_removed``), ``row`` being a struct of the columns of ``docs`` but the text.

    A text without removed lines is unchanged, so a null one is null.
    """
    text, ident = docs[text_col], docs[id_col].cast("long").alias("_id")
    gone = later_matches(docs.select(ident, F.xxhash64(text).alias("_h"), text.alias("_text")), percent)
    gone = written(gone.groupBy("_id", "_h").agg(F.collect_set("line").alias("gone")), "removed")
    others = F.struct(*(docs[c] for c in docs.columns if c != text_col))
    rows = packed(docs.select(others.alias("row"), ident, F.xxhash64(text).alias("_h"), text.alias("_text")))
    joined = rows.join(gone, rows["_id"].eqNullSafe(gone["_id"]) & (rows["_h"] == gone["_h"]), "left").select("row", "_text", "gone")
    return joined.mapInArrow(_removed, f"row {joined.schema['row'].dataType.simpleString()}, kept_text string, n_lines long, n_removed long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(``doc_id``, ``n_lines``, ``n_removed``, ``kept_text``), one row per row of ``docs``.

    Lines are what line feeds separate; words are runs of anything but U+0020 and U+0009 to U+000D, unchanged.
    Lines without words match nothing and stay. ``kept_text`` joins the lines that stay by line feeds.

    A null or empty text has no lines and stays empty. Rows of one id are told apart by the hash of their text and come
    in its order; rows that repeat an id and a text are one document: what stays of one stays of the other. Rows without id
    are documents like others, before all with one. An empty table gives an empty one. Other columns of ``docs``
    are not looked at.
    """
    out = without_lines(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), percent=percent)
    return out.select("row.doc_id", "n_lines", "n_removed", F.coalesce("kept_text", F.lit("")).alias("kept_text"))
