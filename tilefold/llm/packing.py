"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Documents are encoded once into blocks of ids, in a working table that is bucketed by block, with
the document frequency of every token id of each block; their sum over all documents (one number
for each vocabulary entry, a bounded table) gives the idf.

A first retrieval goes over the whole corpus and brings related documents together wherever they
are stored: each document looks up the pairs of its ``LOOKED_UP`` terms of most BM25 weight, and
its home is the pair of most weight that another document looks up too. The homes come back to the
blocks without moving these, and the documents are dealt by range of their homes, rarest term
first, so documents of one home, and then those of one term, are neighbours, whatever the number
of them (splitters come from at most ``SAMPLED`` of them).

The inverted index is sharded: a shard holds the documents of a stretch of that order, by their
whole texts, so it is built, searched and used up in one task. In a shard, the longest unused
document seeds a window; its BM25 neighbours (terms are token ids; an idf of 0 or less is left
out) follow by score, each time the best one that fits, and where none fits the best one is cut to
fill the window to its end. What a cut leaves stays in the index. Where a seed has no unused
neighbour, the next documents of the shard follow in its place. Windows of a document longer than
a window are cut off first.

What remains of a shard at last is shorter than a window and goes into sequences whose lengths
are powers of two, so no sequence needs padding.

Defined results: null and empty texts are documents of the end id alone; repeated rows are
packed each; an empty table gives no pieces; rows with null ids keep them; other columns are
left out. Sequence ids are unique, not dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, bucketed, scratch, slices, written
from .word_bpe import WordBpe, encoder

WINDOW = 4096
#: A shard takes documents up to so many, or so many tokens.
SHARD_DOCS, SHARD_TOKENS = 1024, 2_000_000
#: Bytes of the texts of a block, about; ids whose pairs are found at once, about. Both only bound memory.
BLOCK_BYTES, AT_ONCE = 4 << 20, 1 << 19
#: Terms of a document whose pairs are looked up in the whole corpus.
LOOKED_UP = 8
K1, B = 1.2, 0.75
#: Documents whose homes give the splitters, about.
SAMPLED = 200_000
#: Bits of a row's number that count inside its block.
_INDEX = 24


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    """The lists of 16-bit ids, without copies."""
    flat, at = np.asarray(lists.values), np.asarray(lists.offsets).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _block(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        return reader.read_next_batch()


def holders(flat: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """Of documents' 16-bit ids: how many documents hold each."""
    out, ends = np.zeros(vocabulary, np.int64), np.concatenate([[0], np.cumsum(lengths)])
    for a in range(0, len(lengths), 1 << 16):  # document and id fit in 32 bits
        z = min(a + (1 << 16), len(lengths))
        owner = np.repeat(np.arange(z - a, dtype=np.uint32), lengths[a:z])
        key = np.sort(owner << np.uint32(16) | flat[ends[a] : ends[z]])
        out += np.bincount(key[np.append(True, key[1:] != key[:-1])[: len(key)]] & np.uint32(0xFFFF), minlength=vocabulary)
    return out


def encoded_block(own: WordBpe, batch: pa.RecordBatch, end_id: int, number: int) -> pa.RecordBatch:
    """The row of one block."""
    vocabulary = own.library.get_vocab_size()
    ids, first = own.encode(as_text(batch.column("_text")))
    lengths = np.diff(first) + 1
    ends = np.cumsum(lengths)
    flat = np.full(int(ends[-1]), end_id, "<u2")
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    flat[inner] = ids
    held = holders(flat, lengths, vocabulary)
    rows = pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))], ["_id", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([batch.num_rows]), pa.array([len(flat)]), pa.array([held.astype("<i4").tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
        ["block", "docs", "tokens", "df", "data"],
    )


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A working table of blocks: number, number of documents and of ids, ``df`` (32-bit) and ``data`` (``_id`` and 16-bit ``ids`` of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, first_block = encoder(tokenizer), TaskContext.get().partitionId() << 20
        if own.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit in 16 bits")
        for number, batch in enumerate(slices(batches, "_text", BLOCK_BYTES)):
            yield encoded_block(own, batch, end_id, first_block + number)

    picked = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return bucketed(picked.mapInArrow(run, "block long, docs long, tokens long, df binary, data binary"), "ids", "block")


def document_frequencies(table: DataFrame, fan: int = 32) -> np.ndarray:
    """Documents that hold each token id, summed in a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("df").to_pylist():
                value = np.frombuffer(x, "<i8" if "wide" in batch.schema.names else "<i4").astype(np.int64)
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary()), pa.array([0], pa.int64())], ["df", "wide"])

    partial = table.select("df").mapInArrow(add, "df binary, wide long")
    rows = partial.repartition(fan).mapInArrow(add, "df binary, wide long").collect()  # ``fan`` rows
    return sum((np.frombuffer(r.df, "<i8") for r in rows), np.zeros(0, np.int64) if not rows else 0)


def term_weights(texts: list[np.ndarray], idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and BM25 weight of the postings of some documents, by term, then document."""
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    flat = np.concatenate(texts).astype(np.int64) if n else np.zeros(0, np.int64)
    flat_doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
    useful = idf[flat] > 0
    key = flat[useful] * n + flat_doc[useful]
    key, tf = np.unique(key.astype(np.uint32) if len(idf) * n < 1 << 32 else key, return_counts=True)
    key = key.astype(np.int64)
    term, doc = key // max(n, 1), key % max(n, 1)
    return term, doc, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(mean_length, 1)))


def lookups(texts: list[np.ndarray], idf: np.ndarray, mean_length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair and weight of what each document looks up; a document of one term looks up that."""
    term, doc, weight = term_weights(texts, idf, mean_length)
    rarity = np.empty(len(idf), np.int64)
    rarity[np.argsort(-idf, kind="stable")] = np.arange(len(idf))
    order = np.lexsort([term, -weight, doc])
    term, doc, weight = rarity[term[order]], doc[order], weight[order]
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = []
    for a in range(LOOKED_UP):
        for b in range(a + 1, LOOKED_UP):
            x = starts[:-1][starts[:-1] + b < starts[1:]]
            one, two = term[x + a], term[x + b]
            found.append((doc[x], np.minimum(one, two) << 16 | np.maximum(one, two), weight[x + a] + weight[x + b]))
    alone = starts[:-1][np.diff(starts) == 1]
    found.append((doc[alone], term[alone] << 16 | term[alone], weight[alone]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def homes(table: DataFrame, idf: np.ndarray, mean_length: float) -> DataFrame:
    """A working table of each ``row`` (block and index) with a useful term and its ``home``: the pair of most weight that another one looks up, or else its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                texts = _arrays(_block(data).column("ids"))
                ends, first = np.cumsum([0, *map(len, texts)]), 0
                while first < len(texts):  # some documents at a time, to bound the postings
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] + AT_ONCE, side="right")) - 1)
                    doc, pair, weight = lookups(texts[first:last], idf, mean_length)
                    order = np.lexsort([pair, -weight, doc])
                    best = np.zeros(len(doc), bool)
                    best[order] = np.append(True, doc[order][1:] != doc[order][:-1])[: len(doc)]
                    row = (block << _INDEX) + first + doc
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pair), pa.array(weight.astype(np.float32)), pa.array(best)], ["row", "pair", "weight", "best"])
                    first = last

    pairs = written(table.select("block", "data").mapInArrow(run, "row long, pair long, weight float, best boolean"), "pairs")
    # A pair that very many rows look up is counted before it is shuffled, and Spark can split the join's side that holds it.
    several = pairs.groupBy("pair").agg(F.min("row").alias("_least"), F.max("row").alias("_most")).where("_least < _most").select("pair", F.lit(True).alias("_several"))
    found = pairs.join(several.hint("merge"), "pair", "left").withColumn("shared", F.col("_several").isNotNull()).where("shared or best")
    best = F.max(F.struct("shared", "weight", "pair"))
    return written(found.groupBy("row").agg(best.alias("best")).select("row", F.col("best.pair").alias("home")), "homes", lasting=True)


def splitters(found: DataFrame, rows: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Homes and rows that cut the order of (home, row) into about equal parts."""
    every = max(1, rows // SAMPLED)
    some = found.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("home", "row").toArrow()
    home, row = (np.asarray(some.column(c)) for c in ("home", "row"))
    order = np.lexsort((row, home))
    at = order[(np.arange(1, parts) * len(order)) // parts] if len(order) else order
    return home[at], row[at]


def part_of(home: np.ndarray, row: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many cuts are not above each (home, row)."""
    merged = np.lexsort((np.append(np.zeros(len(cuts[0]), int), np.ones(len(home), int)), np.append(cuts[1], row), np.append(cuts[0], home)))
    out = np.empty(len(merged), np.int64)
    out[merged] = np.cumsum(merged < len(cuts[0]))
    return out[len(cuts[0]) :]


class Shard:
    """Documents' last stretches (shorter than a window) and an inverted index of their whole texts."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float, texts: list[np.ndarray] | None = None):
        self.tails = tails
        n = len(tails)
        term, self.doc, self.weight = term_weights(tails if texts is None else texts, idf, mean_length)
        self.list_start = np.searchsorted(term, np.arange(len(idf) + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        self.terms, self.terms_start = term[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for the terms of one."""
        terms = self.terms[self.terms_start[seed] : self.terms_start[seed + 1]]
        start, stop = self.list_start[terms], self.list_start[terms + 1]
        sizes = stop - start
        at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.tails))


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean_length: float, texts: list[np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that use every id of the tails once; ``texts`` are the whole documents.

    All but the last few are exactly one window long; those are powers of two.
    """
    shard = Shard(tails, idf, mean_length, texts)
    left = np.fromiter(map(len, tails), np.int64, len(tails))
    start = np.zeros(len(tails), np.int64)
    order, sequences = np.argsort(-left, kind="stable").tolist(), []
    total, at = int(left.sum()), 0
    while total >= WINDOW:
        while not left[order[at]]:
            at += 1
        seed = order[at]
        scores = shard.scores(seed)
        pieces, room = [(seed, int(start[seed]), int(left[seed]))], WINDOW - int(left[seed])
        start[seed], left[seed] = start[seed] + left[seed], 0
        unused = np.flatnonzero(left)
        unused = unused[np.argsort(-scores[unused], kind="stable")]
        for ranked in (unused[scores[unused] > 0], unused[scores[unused] <= 0]):  # neighbours, then the others
            while room and len(ranked):
                fitting = np.flatnonzero(left[ranked] <= room)
                i = int(fitting[0]) if len(fitting) else 0
                doc, take = int(ranked[i]), int(min(room, left[ranked[i]]))
                pieces.append((doc, int(start[doc]), take))
                start[doc] += take
                left[doc] -= take
                room -= take
                ranked = np.delete(ranked, i)
        sequences.append(pieces)
        total -= WINDOW
    rest = [(d, int(start[d]), int(left[d])) for d in np.flatnonzero(left).tolist()]
    size = WINDOW
    while total:
        size //= 2
        if total & size:
            pieces, room = [], size
            while room:
                doc, a, n = rest.pop(0)
                take = min(n, room)
                pieces.append((doc, a, take))
                room -= take
                if take < n:
                    rest.insert(0, (doc, a + take, n - take))
            sequences.append(pieces)
            total -= size
    return sequences


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: ``id_col``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    with scratch(docs.sparkSession):
        table = encoded(docs, tokenizer, end_id, id_col, text_col)
    df = document_frequencies(table)
    n_docs, n_tokens = table.agg(F.sum("docs"), F.sum("tokens")).first()
    n_docs = n_docs or 0
    mean_length = (n_tokens or 0) / max(n_docs, 1)
    idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        ids_of: list[np.ndarray] = []
        names_of: list = []
        arrow_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            whole = [[(i, a, WINDOW)] for i, x in enumerate(ids_of) for a in range(0, len(x) - WINDOW + 1, WINDOW)]
            cut = [len(x) // WINDOW * WINDOW for x in ids_of]
            kept = [i for i, x in enumerate(ids_of) if len(x) > cut[i]]
            packed = pack_shard([ids_of[i][cut[i] :] for i in kept], idf, mean_length, [ids_of[i] for i in kept])
            rows = []
            for pieces in whole + [[(kept[d], cut[kept[d]] + a, n) for d, a, n in s] for s in packed]:
                offset = 0
                for doc, a, n in pieces:
                    rows.append((names_of[doc], a, n, ids_of[doc][a : a + n].astype("<u4").tobytes(), len(ids_of[doc]), sequence, offset))
                    offset += n
                sequence += 1
            ids_of.clear()
            names_of.clear()
            for i in range(0, len(rows), 4096):
                columns = list(zip(*rows[i : i + 4096], strict=True))
                types = [arrow_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        tokens = 0
        for batch in batches:
            arrow_type = batch.column("_id").type
            for name, data in zip(batch.column("_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names_of.append(name)
                ids_of.append(np.frombuffer(data, "<u2"))
                tokens += len(ids_of[-1])
                if len(ids_of) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield from flush()
                    tokens = 0
        if ids_of:
            yield from flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch(docs.sparkSession):
        found = homes(table, idf, mean_length)
    cuts = splitters(found, n_docs, parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their part and their home (-1 without one)."""
        for batch in batches:
            for n in range(batch.num_rows):
                block, listed = batch.column("block")[n].as_py(), batch.column("homes")[n].values
                rows = _block(batch.column("data")[n].as_py())
                row, home = (block << _INDEX) + np.arange(rows.num_rows), np.full(rows.num_rows, -1, np.int64)
                if listed is not None:
                    home[np.asarray(listed.field("row")) - (block << _INDEX)] = np.asarray(listed.field("home"))
                ids = pa.array([x.tobytes() for x in _arrays(rows.column("ids"))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part_of(home, row, cuts).astype(np.int32)), pa.array(home), pa.array(row), rows.column("_id"), ids], ["part", "home", "row", "_id", "ids"])

    by_block = found.groupBy(F.shiftright("row", _INDEX).alias("block")).agg(F.collect_list(F.struct("row", "home")).alias("homes"))
    placed = table.select("block", "data").join(by_block.hint("merge"), "block", "left").mapInArrow(place, f"part int, home long, row long, _id {id_type}, ids binary")
    dealt = placed.repartitionById(parts, "part").sortWithinPartitions("home", "row").select("_id", "ids")
    out = dealt.mapInArrow(run, f"_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
