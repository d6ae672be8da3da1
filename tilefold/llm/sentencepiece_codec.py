"""SentencePiece encoding and decoding through a table of distinct marked chunks.

When no piece of the vocabulary holds a whitespace marker after another character, no
merge can cross from a word into the marker that follows it. A text then falls into
chunks, each a run of markers with the word behind it, that the library segments the same
alone as in place. Every distinct chunk of a slice is segmented once; the ids are joined
back by position with array arithmetic. A model with pieces that cross markers is refused.

Defined results: null and empty texts give no ids and an empty text; repeated rows give
repeated results; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import as_text, chunk_array, raw_bytes, slices

#: Distinct chunks that a worker keeps between slices; beyond it the table starts anew.
TABLE_CHUNKS = 400_000


class ChunkTable:
    """Distinct chunk -> ids, filled as chunks are met and bounded in size."""

    def __init__(self, encode_many, limit: int = TABLE_CHUNKS):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1, np.int64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The row of each chunk, after the missing ones are added."""
        index = self.index
        missing = [c for c in chunks if c not in index]
        if len(index) + len(missing) > self.limit:
            self.clear()
            index, missing = self.index, chunks
        for i in range(0, len(missing), 50_000):
            part = missing[i : i + 50_000]
            ids, lengths = self.encode_many(part)
            base, used = len(index), int(self.starts[-1])
            index.update(zip(part, range(base, base + len(part)), strict=True))
            if used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[:used], np.zeros(max(len(self.flat), 2 * len(ids)), np.int32)])
            self.flat[used : used + len(ids)] = ids
            self.starts = np.concatenate([self.starts, used + np.cumsum(lengths)])
        return np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one behind the other, and the number of each."""
        lengths = (self.starts[1:] - self.starts[:-1])[rows].astype(np.int32)
        ends = np.cumsum(lengths, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.starts[rows] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        return self.flat[at], lengths


def marked_chunks(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Codes into the distinct chunks, those chunks, and the first chunk of each text.

    A text is cut at each space that follows neither a space nor a literal U+2581; that space
    is left out, as the library puts a marker before what it encodes. An empty text has no chunk.
    """
    raw, offsets = raw_bytes(texts)
    space = raw == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    for k in np.flatnonzero(cut[3:] & (raw[2:-1] == 0x81)) + 3:
        cut[k] = raw[k - 3 : k].tobytes() != b"\xe2\x96\x81"
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[begins] = False
    cuts = np.flatnonzero(cut)
    # A chunk begins where a text does or behind a cut; both are moved by the cuts before them.
    removed = np.cumsum(cut, dtype=np.int64)
    at = np.concatenate([begins, cuts + 1])
    moved = np.concatenate([begins - removed[begins], cuts + 1 - removed[cuts]]) if len(at) else at
    # A cut at the very end of a text and the begin of the next share their place: the cut is first.
    owner = np.concatenate([np.searchsorted(offsets, begins, side="right") - 1, np.searchsorted(offsets, cuts, side="right") - 1])
    order = np.lexsort((at, owner))
    coded = chunk_array(raw[~cut], moved[order]).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, np.searchsorted(owner[order], np.arange(len(texts) + 1))


class Codec:
    """One worker's processor and chunk table."""

    def __init__(self, model: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        self.marker = self.sp.piece_to_id("▁")
        self.table = ChunkTable(self._encode_many)

    def _encode_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [i or [self.marker] for i in self.sp.encode(chunks, num_threads=1)]  # an empty chunk is a lone marker
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for i in ids for x in i), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first id of each text (one more than texts)."""
        codes, distinct, first = marked_chunks(texts)
        rows = self.table.rows(distinct.to_pylist())
        ids, lengths = self.table.gather(rows[codes])
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return ids, ends[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        values, at = ids.tolist(), first.tolist()
        return self.sp.decode([values[a:b] for a, b in zip(at, at[1:])], num_threads=1) if len(at) > 1 else []


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The worker's codec; it outlives a task, so tasks share the chunk table."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, "_text"):
            ids, first = own.encode(as_text(batch.column("_text")))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists, pa.array(own.decode(ids, first), pa.string())], ["_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)
