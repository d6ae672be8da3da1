"""Ranked lexical search by a two-level quantised index, exact in whole numbers.

``index`` cuts documents into blocks of some megabytes and stores for each block its terms and
their postings in two levels. The first has a byte for each posting: the document's share of the
term's impact, rounded up to a multiple of ``STEP``. The second has the exact number of
occurrences. Every document and every term is indexed, whatever is searched for later.

``search`` reads the first level and adds up bytes times term weights: an upper bound for each
document, and a lower one, a step less for each matching term. The k-th best lower bound of each
item is merged over all blocks. Then every document whose upper bound reaches it is rescored from
the second level in exact integers, and the best k of each item are merged. Items travel in
blocks of bounded size; they are broadcast while all of them are small, else they are copied to
shards that the index is dealt to.

An impact is (1000000000 * tf) div (1000 * tf + 8 * m) with m = 10 + (90 * n * N) div L, which is
below 1,000,000; a term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

Defined results: null texts have no terms; a row is a document, so repeated rows each count and
are listed each; documents without a term have no part in N. Documents with null ids are ranked
behind all others of their score. Each row of the items has a list of its own, also where ids
repeat or are null; items without terms or hits have no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, BLOCKS_OF_A_FILE, as_text, chunk_array, raw_bytes, scratch, slices, written

#: Impacts are rounded up to multiples of this: at most 245 steps, a byte.
STEP = 4096
#: UTF-8 bytes of the documents in one block of the index.
INDEX_BYTES = 4 << 20
#: UTF-8 bytes of the items in one block.
ITEM_BYTES = 1 << 20
#: Item blocks of this many bytes in all are broadcast; more are copied to shards.
BROADCAST_BYTES = 16 << 20
#: Tasks whose lists of an item are merged in the first step.
FAN = 256
#: Items whose lists a task holds before it passes them on.
HELD_ITEMS = 1 << 16

_TERM = np.zeros(256, dtype=bool)
_TERM[ord("0") : ord("9") + 1] = _TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = _TERM[0x80:] = True


def cut_terms(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Codes of all terms, the distinct terms, and the first term of each text (one more for the end)."""
    raw, offsets = raw_bytes(texts)
    raw = _LOWER[raw]
    inside = _TERM[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    begins = np.flatnonzero(inside & ~before)
    place = np.cumsum(inside, dtype=np.int32)
    coded = chunk_array(raw[inside], place[begins] - 1).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary, np.searchsorted(begins, offsets)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Exact impacts of postings: tf occurrences in documents of n terms."""
    if 90 * int(n.max(initial=0)) * documents < 2**63:
        m = 10 + (90 * n * documents) // terms
    else:
        m = np.array([min(10 + 90 * int(x) * documents // terms, 2**58) for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            raw, offsets = raw_bytes(as_text(batch.column(text_col)))
            inside = _TERM[raw]
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            first = offsets[:-1][offsets[:-1] < len(raw)]
            starts[first] = inside[first]
            n = np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "terms"])

    row = docs.select(text_col).mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


_INDEX = "documents long, ids binary, nulls binary, lengths binary, words array<string>, counts binary, docs binary, impacts binary, tf binary"


def index(docs: DataFrame, documents: int, terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents.

    ``words`` are its terms and ``counts`` their postings, which lie one term after the other in
    ``docs`` (numbers in the block), ``impacts`` (bytes, the first level) and ``tf`` (the second,
    with the documents' ``ids``, ``nulls`` of ids and ``lengths``).
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", INDEX_BYTES):
            codes, words, first = cut_terms(as_text(batch.column("_text")))
            lengths = np.diff(first)
            pairs, tf = np.unique(codes.astype(np.int64) * max(batch.num_rows, 1) + np.repeat(np.arange(batch.num_rows), lengths), return_counts=True)
            term, doc = pairs // max(batch.num_rows, 1), pairs % max(batch.num_rows, 1)
            steps = -(-impacts(tf.astype(np.int64), lengths[doc].astype(np.int64), documents, max(terms, 1)) // STEP)
            ids = batch.column("_id")
            row = [
                batch.num_rows, np.asarray(ids.fill_null(0), "<i8").tobytes(), np.asarray(ids.is_null().cast(pa.uint8())).tobytes(), lengths.astype("<i8").tobytes(), words,
                np.bincount(term, minlength=len(words)).astype("<i4").tobytes(), doc.astype("<i4").tobytes(), steps.astype(np.uint8).tobytes(), tf.astype("<i4").tobytes(),
            ]
            kinds = [pa.int64(), *[pa.binary()] * 3, pa.list_(pa.string()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], kind) for x, kind in zip(row, kinds, strict=True)], ["documents", "ids", "nulls", "lengths", "words", "counts", "docs", "impacts", "tf"])

    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return rows.mapInArrow(build, _INDEX)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items in blocks: ids and distinct terms of each (``words`` of the block, ``terms`` of its items one after the other)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", ITEM_BYTES):
            codes, words, first = cut_terms(as_text(batch.column("_text")))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            pairs = np.unique(owner * max(len(words), 1) + codes)
            sizes = np.bincount(pairs // max(len(words), 1), minlength=batch.num_rows)
            terms = pairs % max(len(words), 1)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("_id").to_pylist()], pa.list_(pa.int64())), pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([terms.astype("<i4").tobytes()], pa.binary())], ["item_ids", "item_words", "sizes", "terms"])

    rows = items.select(items[id_col].cast("long").alias("_id"), items[text_col].cast("string").alias("_text"))
    return rows.mapInArrow(cut, "item_ids array<long>, item_words array<string>, sizes binary, terms binary").withColumn("block", F.monotonically_increasing_id())


def _longs(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(data, kind)


class Block:
    """The postings of an index block that the terms of an item block have."""

    def __init__(self, row: dict, words: pa.Array, item_words: list[str]):
        counts = _longs(row["counts"]).astype(np.int64)
        ends = np.cumsum(counts)
        at = np.asarray(pc.index_in(pa.array(item_words, pa.string()), value_set=words).fill_null(-1))
        self.known = at >= 0
        self.size = np.where(self.known, counts[at], 0) if len(counts) else np.zeros(len(at), np.int64)
        self.start = np.where(self.known, (ends - counts)[at], 0) if len(counts) else np.zeros(len(at), np.int64)
        self.docs, self.documents = _longs(row["docs"]), row["documents"]
        self.steps = np.frombuffer(row["impacts"], np.uint8)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms' postings, and which of the terms each is of."""
        size = self.size[terms]
        of = np.repeat(np.arange(len(terms)), size)
        return np.repeat(self.start[terms] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), of

    def summed(self, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Exact sums of whole numbers for each document of the block."""
        if int(values.max(initial=0)) * max(len(values), 1) < 2**53:
            return np.bincount(docs, weights=values, minlength=self.documents).astype(np.int64)
        out = np.zeros(self.documents, np.int64)
        np.add.at(out, docs, values)
        return out

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with a bound above 0, and their upper and lower bounds."""
        at, of = self.postings(terms)
        docs, w = self.docs[at], weights[of]
        upper = self.summed(docs, w * self.steps[at] * STEP)
        slack = self.summed(docs, np.where(self.steps[at] > 0, w * (STEP - 1), 0))
        some = np.flatnonzero(upper)
        return some, upper[some], upper[some] - slack[some]


def _weights(df: list[int], documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df], np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array]]:
    """Each pair of an index block and an item block; terms stay in Arrow."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "words"]
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in names}, batch.column("words")[i].values


def frequencies(rows: DataFrame) -> DataFrame:
    """Documents that hold each term of the items: ``block``, ``place`` of the term in it, ``df``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _pairs(batches):
            counts = _longs(row["counts"]).astype(np.int64)
            at = np.asarray(pc.index_in(pa.array(row["item_words"], pa.string()), value_set=words).fill_null(-1))
            place = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(counts[at[place]])], ["block", "place", "n"])

    return rows.select("block", "item_words", "words", "counts").mapInArrow(count, "block long, place int, n long").groupBy("block", "place").agg(F.sum("n").alias("df"))


def best_lower_bounds(rows: DataFrame, documents: int, k: int) -> DataFrame:
    """(``block``, ``item``, ``low``): the k-th best lower bound of each item that has so many documents with a bound."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            names = [(b, i) for (b, i), low in held.items() for _ in low]
            if names:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in names], pa.int64()), pa.array([i for _, i in names], pa.int32()), pa.array(np.concatenate(list(held.values())))], ["block", "item", "low"])
            held.clear()

        for row, words in _pairs(batches):
            if len(held) > HELD_ITEMS:
                yield from out()
            block, weights, terms, first = Block(row, words, row["item_words"]), _weights(row["df"], documents), _longs(row["terms"]), 0
            for item, size in enumerate(_longs(row["sizes"])):
                _, _, low = block.bounds(terms[first : first + size], weights[terms[first : first + size]])
                first += size
                low = np.concatenate([held.get((row["block"], item), low[:0]), low])
                held[row["block"], item] = np.partition(low, len(low) - k)[-k:] if len(low) > k else low
        yield from out()

    lows = rows.select("block", "item_words", "sizes", "terms", "df", "documents", "words", "counts", "docs", "impacts").mapInArrow(bound, "block long, item int, low long")
    return merged(lows, ["block", "item"], [F.desc("low")], k).where(F.col("rank") == k).select("block", "item", "low")


def rescored(rows: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """Exact scores of all documents whose upper bound reaches the item's ``low``; of each task the best k of an item."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (b, item), (name, s, null, i) in held.items():
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array([b] * n, pa.int64()), pa.array([item] * n, pa.int32()), pa.array([name] * n, pa.int64()), pa.array(i, mask=null.astype(bool)), pa.array(s)], ["block", "item", "item_id", "doc_id", "score"])
            held.clear()

        for row, words in _pairs(batches):
            if len(held) > HELD_ITEMS:
                yield from out()
            block, weights, all_terms, first = Block(row, words, row["item_words"]), _weights(row["df"], documents), _longs(row["terms"]), 0
            ids, nulls, lengths, tf = _longs(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8), _longs(row["lengths"], "<i8"), _longs(row["tf"])
            wanted = np.zeros(block.documents, bool)
            for item, (size, low, name) in enumerate(zip(_longs(row["sizes"]), row["low"], row["item_ids"], strict=True)):
                own = all_terms[first : first + size]
                first += size
                some, upper, _ = block.bounds(own, weights[own])
                some = some[upper >= low]
                if not len(some):
                    continue
                wanted[some] = True
                at, of = block.postings(own)
                hit = wanted[block.docs[at]]
                at, of = at[hit], of[hit]
                doc = block.docs[at]
                score = block.summed(doc, weights[own][of] * impacts(tf[at].astype(np.int64), lengths[doc], documents, terms))[some]
                wanted[some] = False
                some, score = some[score > 0], score[score > 0]
                had = held.get((row["block"], item), (name, *(np.zeros(0, np.int64),) * 3))
                s, null, i = np.concatenate([had[1], score]), np.concatenate([had[2], nulls[some]]), np.concatenate([had[3], ids[some]])
                order = np.lexsort((i, null, -s))[:k]
                held[row["block"], item] = (name, s[order], null[order], i[order])
        yield from out()

    return rows.mapInArrow(exact, "block long, item int, item_id long, doc_id long, score long")


def merged(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k best rows of each key with their ``rank``, in two steps, so that no task meets the lists of all tasks."""
    part = F.floor(F.spark_partition_id() / FAN)
    first = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return first.where(F.col("rank") <= k).drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the k best documents of each item."""
    spark = docs.sparkSession
    with scratch(spark):
        documents, terms = totals(docs, text_col)
        stored = written(index(docs, documents, terms, id_col, text_col), "index", rows_of_a_file=BLOCKS_OF_A_FILE)
        blocks = written(item_blocks(items, item_col, item_text_col), "items")
        size, count = blocks.agg(F.sum(F.length("terms") + F.length("sizes") + F.aggregate("item_words", F.lit(0), lambda a, w: a + F.octet_length(w) + 4)), F.count("*")).first()
        small = (size or 0) <= BROADCAST_BYTES
        shards = 1 if small else max(1, math.ceil(math.sqrt(count)) * 8)
        stored = stored.withColumn("shard", F.pmod(F.xxhash64("docs", "ids"), F.lit(shards)))

        def paired(extra: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
            """Each index block with each item block, as far as ``columns`` of the index go."""
            copies = extra(blocks).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
            side = stored.select("shard", *columns)
            return side.join(F.broadcast(copies) if small else copies, "shard").drop("shard")

        df = written(frequencies(paired(lambda b: b.select("block", "item_words"), "words", "counts")), "frequencies")
        by_block = df.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", "df"))).alias("found"))  # as long as the block's terms
        listed = F.transform(F.sequence(F.lit(0), F.size("item_words") - 1), lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long")))
        blocks = written(blocks.join(by_block, "block").withColumn("df", listed).drop("found"), "items")
        lows = written(best_lower_bounds(paired(lambda b: b, "documents", "words", "counts", "docs", "impacts"), documents, k), "bounds")
        by_block = lows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("item", "low"))).alias("found"))
        reach = F.transform(F.sequence(F.lit(0), F.size("item_ids") - 1), lambda i: F.coalesce(F.element_at("found", i), F.lit(1).cast("long")))
        with_lows = lambda b: b.join(by_block, "block", "left").withColumn("low", F.coalesce(reach, F.transform("item_ids", lambda _: F.lit(1).cast("long")))).drop("found")
        scores = rescored(paired(with_lows, "documents", "words", "counts", "docs", "impacts", "ids", "nulls", "lengths", "tf"), documents, max(terms, 1), k)
        best = merged(scores, ["block", "item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        return written(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked", lasting=True)


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null),
n as materialized (select r, doc_id, len(t) as n, t from d where len(t) > 0),
s as materialized (select count(*) as docs, sum(n)::bigint as terms from n),
i as materialized (select row_number() over () as q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
p as materialized (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from (select r, doc_id, n, unnest(t) as term from n) where term in (select term from i) group by r, term),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from p, s group by term, docs),
c as (select q, item_id, r, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::bigint as score from i join p using (term) join w using (term), s group by q, item_id, r)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from c where score > 0) where rank <= 10
"""
