"""Tokenised documents packed into fixed-size sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths, as
each piece attends within itself). A piece goes to an open sequence that has room under every capacity:
the one whose residual vector would have the least weighted norm (``rule="norm"``, the tightest fit), or the
largest weighted dot product with the piece (``rule="dot"``). Pieces come in order of decreasing length.

Pieces are dealt by hash to groups of about ``GROUP`` pieces; each group is packed on its own. A group of that
size leaves about one sequence unfilled, so the loss does not grow in proportion with more groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written

GROUP = 20_000
#: Word ids that one worker remembers; beyond it the memory is emptied.
MEMO = 900_000
#: White space at an end of a text, two in a row, or any but a space and a line feed (all that Python's ``isspace`` holds).
_SPACE = r"\t\n\v\f\r\x1c-\x1f\x{85}\p{Z}"
_ODD_SPACE = rf"\A[{_SPACE}]|[{_SPACE}]\z|[{_SPACE}][{_SPACE}]|[\t\v\f\r\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a memory of words.

    The byte-level pre-tokenizer never joins what a single space or line feed between two other characters
    separates (the space goes with what follows, the line feed stands alone). So the parts between them are
    encoded once each, many at a time. Texts with any other white space, or with an added token of the tokenizer
    (``<|endoftext|>``) written out in them, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        space, line_feed = (self.model.encode(x, add_special_tokens=False).tokens[0] for x in (" ", "\n"))
        vocabulary = self.model.get_vocab()
        self.line_feed = np.array(vocabulary[line_feed], "<u4").tobytes()
        self.begins = {lead: np.zeros(max(vocabulary.values()) + 1, bool) for lead in (" ", "\n")}
        for token, k in vocabulary.items():
            self.begins[" "][k] = token.startswith(space)
            self.begins["\n"][k] = token == line_feed

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, memo: dict[str, bytes], words: set[str], lead: str) -> None:
        """Encode the words that are new, each after ``lead``, in one text: only a word's first token begins with it."""
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(words)
        if not new:
            return
        ids = np.array(self.model.encode_batch_fast([lead + lead.join(new)], add_special_tokens=False)[0].ids, "<u4")
        first = np.flatnonzero(self.begins[lead][ids])
        if len(first) != len(new):
            raise ValueError("words and tokens do not line up")
        skip, flat = 4 * (lead == "\n"), ids.tobytes()
        ends = [*(4 * first[1:]).tolist(), len(flat)]
        memo.update(zip(new, [flat[a + skip : b] for a, b in zip((4 * first).tolist(), ends)]))

    def whole(self, column: pa.Array) -> list[bool]:
        """Which texts are encoded whole: tested on the column at once, as most texts need no other look."""
        odd = pc.match_substring_regex(column, _ODD_SPACE)
        for name in self.added:
            odd = pc.or_(odd, pc.match_substring(column, name))
        return pc.or_(odd, pc.equal(column, "")).to_pylist()

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Token ids of texts, none of them null."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = column.to_pylist()
        split = [None if whole else [x.split(" ") for x in t.split("\n")] for t, whole in zip(texts, self.whole(column))]
        self.learn(self.plain, {x[0] for lines in split if lines for x in lines}, "\n")
        self.learn(self.spaced, {w for lines in split if lines for x in lines for w in x[1:]}, " ")
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        return [
            self.line_feed.join([b"".join([plain(x[0]), *map(spaced, x[1:])]) for x in lines]) if lines else self.encode([text])[0]
            for text, lines in zip(texts, split)
        ]


@cache
def word_tokens(tokenizer: str) -> WordTokens:
    """One for each worker process: tasks that follow one another share its memory of words."""
    return WordTokens(tokenizer_file(tokenizer))


def _cut(tokenizer: str, end: int, size: int, keep: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep)
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for batch in batches:
            texts = batch.column("_text")
            for lo in range(0, len(texts), 256):
                rows: list[tuple] = []
                encoded = tokens(pc.fill_null(texts.slice(lo, 256), ""))
                for doc, ids in zip(batch.column("_id").slice(lo, 256).to_pylist(), encoded):
                    ids += tail
                    n = len(ids) // 4
                    head = (n - 1) % size + 1  # the first piece takes the remainder
                    starts = [0, *range(head, n, size)]
                    for k, a in enumerate(starts):
                        part = ids[4 * a : 4 * (a + size if k else head)]
                        rows.append((doc, k, a, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if keep else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end: int = 2, size: int = 1024, ids: bool = False) -> DataFrame:
    """(``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``[, ``ids``]): token ids plus ``end``, cut into pieces.

    Documents of up to ``size`` tokens are one piece; longer ones are cut into pieces of ``size``, the first
    may be shorter. A null text is an empty one: its only token is ``end``.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).mapInArrow(_cut(tokenizer, end, size, ids), kind)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in any order of pieces."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights) / full**2
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room, names, n_open, n_all = np.empty((3, 64)), np.empty(64, np.int64), 0, 0
    least = int(lengths.min()) if len(lengths) else 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)
        if (need > full).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacity of a sequence")
        fits = np.flatnonzero((room[0, :n_open] >= size) & (room[1, :n_open] >= 1) & (room[2, :n_open] >= need[2]))
        if len(fits):
            if capacity.rule == "dot":
                k = int(fits[np.argmax((weights * need) @ room[:, fits])])
            else:
                k = int(fits[np.argmin(weights @ (room[:, fits] - need[:, None]) ** 2)])
        else:
            if n_open == room.shape[1]:
                room, names = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([names, np.empty_like(names)])
            k, n_open = n_open, n_open + 1
            room[:, k], names[k] = full, n_all
            n_all += 1
        where[i], offset[i] = names[k], capacity.tokens - room[0, k]
        room[:, k] -= need
        if room[0, k] < least or room[1, k] < 1 or room[2, k] < least * least:  # nothing fits any more
            n_open -= 1
            room[:, k], names[k] = room[:, n_open], names[n_open]
    return where, offset


def pack(parts: DataFrame, capacity: Capacity = Capacity(), columns: tuple[str, ...] = ("start", "ids_crc32")) -> DataFrame:
    """(``doc_id``, ``piece``, *columns, ``length``, ``sequence_id``, ``offset``): a place for every piece.

    ``offset`` counts the tokens before it in its sequence, without gaps. Sequence numbers are unique, not
    dense. Repeated rows are packed as often as they come; a null id is an id like others; an empty table
    gives an empty one. A piece that exceeds a capacity on its own raises an error.
    """
    names = ["doc_id", "piece", *columns, "length"]
    parts = written(parts.select(*names), "pieces")
    groups = parts.count() // GROUP + 1
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, `offset` long"

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        where, offset = best_fit(rows["length"].to_numpy(), capacity)
        return rows[names].assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    return dealt.groupBy("part").applyInPandas(fill, kind)
