"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a vocabulary holds a whitespace marker after another character, no merge crosses from a
character to the marker behind it, so a text is segmented chunk by chunk: a run of markers and what follows up
to the next one. A line feed that no longer piece holds is cut before as well. Each slice of texts is laid out as
one Arrow array of chunks, whose dictionary is the table of distinct ones: each is segmented once and its ids
are joined back to the chunks by position. A worker keeps the rows of the table for the slices that follow.

Texts stay where they lie: (document, position, chunk) rows joined with one table of the whole corpus would be
several times the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sheaf.llm.common import list_column, slices

MARK = "▁"
#: Chunks that one worker remembers; beyond it the table starts anew.
TABLE = 400_000
#: Bytes of text in a slice.
SLICE = 4 << 20


class ChunkTable:
    """Ids and decoded text of distinct chunks. A chunk is spaces and what follows, or a line feed and what follows."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.by_chunk = keeps_to_chunks(self.model, names)
        self.mark = self.model.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    def learn(self, chunks: list[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > TABLE:
            self.ids.clear()
            self.text.clear()
            new = chunks
        # the library puts a marker before what it encodes: a chunk goes without its first one, a line feed loses it after
        coded = self.model.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1)
        coded = [[self.mark] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(new, coded)]
        self.ids.update(zip(new, (np.array(ids, "<i4").tobytes() for ids in coded)))
        # decoding drops the marker in front again
        self.text.update((c, " " + text if c[0] == " " else text) for c, text in zip(new, self.model.decode(coded, num_threads=1)))

    def columns(self, chunks: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded text) of the rows that own ``chunks``; row k has those from first[k] to first[k + 1]."""
        table = chunks.dictionary_encode()
        distinct, place = table.dictionary.to_pylist(), table.indices.to_numpy()
        self.learn(distinct)
        parts = [self.ids[c] for c in distinct]
        size = np.array([len(p) // 4 for p in parts], np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(parts), "<i4")
        n = size[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(upto[-1]) + np.repeat(start[place] - upto[:-1], n)]
        said = pa.array([self.text[c] for c in distinct], pa.large_string()).take(table.indices)
        offsets, data = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1] if len(said) else np.zeros(1, np.int64), said.buffers()[2]
        ends = offsets[first]
        full = ends[1:] > ends[:-1]
        # the marker that begins every text is the library's own: its blank is not decoded
        texts = [str(data[a + 1 : b], "utf-8") if some else "" for a, b, some in zip(ends[:-1].tolist(), ends[1:].tolist(), full.tolist())]
        return list_column(ids, upto[first], pa.int32()), pa.array(texts, pa.string())


def keeps_to_chunks(model, names: list[str]) -> bool:
    """Whether segmenting chunk by chunk is exact: no piece crosses into a marker or holds a line feed, texts are taken as they are."""
    longer = [p for k, p in enumerate(names) if len(p) > 1 and not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in longer) or MARK not in names:
        return False
    kept = ["a  b", " a ", " 　Ａﬁé\t\r", "x\ny"]  # folded or trimmed by other normalisers
    first = all(model.encode(t) and model.id_to_piece(model.encode(t)[0]).startswith(MARK) for t in kept)
    return first and all(model.decode(model.encode(t)) == t for t in kept) and model.id_to_piece(model.encode("\n")[0]) == MARK


@cache
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def chunked(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All chunks of some texts, and the number of each row's first chunk (one more than rows).

    Every text that is not empty gets the blank in front that stands for the library's marker.
    """
    size = np.diff(offsets)
    full = size > 0
    begins = offsets[:-1][full] + np.arange(full.sum())
    rest = np.ones(len(data) + len(begins), bool)
    rest[begins] = False
    out = np.empty(len(rest), np.uint8)
    out[begins], out[rest] = 0x20, data
    blank = out == 0x20
    cut = out == 0x0A
    cut[1:] |= blank[1:] & ~blank[:-1]
    cut[begins] = True
    starts = np.append(np.flatnonzero(cut), len(out))
    chunks = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out))
    row_start = offsets + np.concatenate([[0], np.cumsum(full)])
    return chunks, np.searchsorted(starts[:-1], row_start)


def _encode(path: str, fields: list[pa.Field]):
    schema = pa.schema([*fields, ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("_text"), "")
            if table.by_chunk:
                texts = pc.replace_substring(texts, MARK, " ")  # the library reads a written marker as a blank
            for lo, hi, offsets, data in slices(texts, SLICE):
                if table.by_chunk:
                    ids, decoded = table.columns(*chunked(offsets, data))
                else:
                    whole = table.model.encode(texts.slice(lo, hi - lo).to_pylist(), num_threads=1)
                    ids, decoded = pa.array(whole, pa.list_(pa.int32())), pa.array([table.model.decode(x) for x in whole], pa.string())
                kept = [batch.column(f.name).slice(lo, hi - lo) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, pc.list_value_length(ids).cast(pa.int64()), ids, decoded], schema=schema)

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``ids``, ``decoded``): ids of every whole text as the library gives them, and their text.

    ``path``: a SentencePiece model that every worker can read. No begin or end ids, no sampling. A null text is
    an empty one: no ids, empty text. Rows are taken one by one, so repeated and null ids stay as they come; other
    columns are not read; an empty table gives an empty one. A model whose pieces cross markers, or that
    changes texts before it segments them, is applied to whole texts.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(_encode(path, [pa.field("doc_id", pa.int64())]), "doc_id long, n_tokens long, ids array<int>, decoded string")
