"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. Its elements are dealt to P
parts by a hash; the XOR of a part's elements is its parity sketch, and the sketches of two sets
differ in no more parts than their symmetric difference has elements. P is larger than the
largest difference d that two linked sets of a size band can have, so they agree in P - d parts
or more (pigeonhole). Sets near the end of a band are sketched for the next one too, where they
meet its sets.

1. Each part's key goes to its own place, where it is seen whether another set has it. A set of
   f parts that are not empty is linked with none unless f - d or more of them are shared, with d
   of its own size; most sets end here, though they share passages with many. (Where f <= d, empty
   parts count as well, behind all others.)
2. Of the keys of the others, all but the f - d - 1 commonest are enough for two linked sets to
   meet in one (the order of keys by count is the same for all sets). A bucket links every set
   with its smallest one only, so it costs no more rows than it has sets. Sets that such pairs
   connect are a cluster.
3. A cluster is dealt to blocks of bounded size, together with its few best connected sets. In a
   block, a longer parity sketch, whose Hamming distance bounds the difference from below, rejects
   most pairs before the sets are compared; pairs of one component are skipped.
4. Where a cluster of several blocks is in several components by then, all sets outside its
   largest component are compared with all sets of other components, block by block.

Equal sets are one node, found by a hash of the whole set.

Defined results: null and empty texts have empty sets and are linked with nothing; texts of
fewer words than a shingle are one shingle; equal sets are linked, whatever their texts or ids;
repeated rows are repeated; rows with a null id link others as any row does, and the smallest id
of a component leaves nulls out (null if it has no other); an empty table gives an empty table;
other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_A, MIX_C, as_text, cut_words, mix, scratch, slices, written
from .components import components

#: Size bands grow by this factor.
BAND = 1.4
#: Nodes of a block of the grid, about.
BLOCK = 192
#: Best connected sets of a cluster that go to each of its blocks.
HUBS = 8
#: Bits of the sketch that is compared before the sets.
SKETCH_BITS = 2048
#: Bytes of texts that a task handles at once, about.
SLICE = 2 << 20
#: A set is taken up to here by its band; no text is near it.
LARGEST = 1 << 30


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; linked where 100 * intersection >= ``percent`` * union."""

    width: int
    percent: int

    def linked(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    def largest_difference(self, n, m):
        """Of two linked sets of n and m elements."""
        return (n + m) * (100 - self.percent) // (100 + self.percent)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """First sizes of the bands, and the parts of each (0 where only equal sets are linked)."""
        first = [1]
        while first[-1] <= LARGEST:
            first.append(int(first[-1] * BAND) + 1)
        parts = []
        for low, high in zip(first, first[1:]):
            most = self.largest_difference(high - 1, high - 1)
            parts.append(most + 1 + spare_parts(most + 1, -(-self.percent * low // 100)) if most else 0)
        return np.array(first, np.int64), np.array(parts, np.int64)


def shingle_sets(texts: pa.StringArray, rule: Rule) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    cut = cut_words(texts, lower=True)
    h = cut.hashes()
    k = rule.width
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = rolled * MIX_A + mix(h[j : j + len(rolled)] + np.uint64(j))
    rolled = mix(rolled)
    out = []
    for a, b in zip(cut.first[:-1].tolist(), cut.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def spare_parts(needed: int, smallest: int) -> int:
    """Parts beyond those needed, so that sets of ``smallest`` elements rarely have more empty parts than that."""
    spare = 2
    for _ in range(16):
        empty = (needed + spare) * math.exp(-smallest / (needed + spare))
        spare = int(1.1 * empty + 3 * math.sqrt(empty)) + 2
    return spare


def part_keys(sets: list[np.ndarray], rule: Rule, bands: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the parts of all sets, in their band and in the next where they meet its sets: key, set and tag.

    A key is odd if its part is empty. The tag holds how many shared parts are too few to be linked,
    and whether it is the next band.
    """
    first, parts_of = bands
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.searchsorted(first, n, side="right") - 1
    out = []
    for up in (0, 1):
        b = np.maximum(band, 0) + up
        chosen = np.flatnonzero((n > 0) & (parts_of[b] > 0) & (not up or 100 * n >= rule.percent * first[b]))
        if not len(chosen):
            continue
        size, b = n[chosen], b[chosen]
        parts, seed = parts_of[b], mix((b + 1).astype(np.uint64))
        most = rule.largest_difference(size, np.minimum(first[b + 1] - 1, 100 * size // rule.percent))
        begin = np.concatenate([[0], np.cumsum(parts)])
        flat = np.concatenate([sets[i] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), size)
        at = (mix(flat ^ seed[owner]) % parts.astype(np.uint64)[owner]).astype(np.int64) + begin[owner]
        sketch = np.zeros(begin[-1], np.uint64)
        np.bitwise_xor.at(sketch, at, flat)
        filled = np.bincount(at, minlength=begin[-1]) > 0
        full = np.add.reduceat(filled.astype(np.int64), begin[:-1])
        every = full <= most  # then empty parts count too
        of = np.repeat(np.arange(len(chosen)), parts)
        number = (np.arange(begin[-1]) - begin[of]).astype(np.uint64)
        key = mix(mix(sketch * MIX_C + seed[of]) + number * MIX_A) >> np.uint64(1) << np.uint64(1) | (~filled).astype(np.uint64)
        tag = np.where(every, parts, full) - most - 1 << 1 | up
        sent = np.flatnonzero(filled | every[of])
        out.append((key[sent].view(np.int64), chosen[of[sent]], tag[of[sent]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    return np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)


def sized(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """``_id``, set size ``n`` and ``node`` (null for empty sets) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            sets = shingle_sets(as_text(batch.column("_text")), rule)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), pa.array(node_of(sets), mask=sizes == 0)], ["_id", "n", "node"])

    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return texts.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, n long, node long")


def keyed_parts(docs: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """``key``, ``node`` and ``tag`` of every part to be compared; a task sends a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = rule.bands(), set()
        for batch in slices(batches, "_text", SLICE):
            sets = shingle_sets(as_text(batch.column("_text")), rule)
            new = []
            for s, node in zip(sets, node_of(sets).tolist(), strict=True):
                if len(s) and node not in seen:
                    seen.add(node)
                    new.append(s)
            key, of, tag = part_keys(new, rule, bands)
            nodes = node_of(new)[of]
            for i in range(0, len(key), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(nodes[part]), pa.array(tag[part])], ["key", "node", "tag"])

    return docs.select(docs[text_col].alias("_text")).mapInArrow(run, "key long, node long, tag long")


def candidate_pairs(parts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, with the number of ``buckets`` that hold them: each node of a bucket with its smallest one."""
    own = Window.partitionBy("key")
    shared = parts.withColumn("lo", F.min("node").over(own)).withColumn("hi", F.max("node").over(own)).withColumn("count", F.count("*").over(own)).where("lo <> hi")
    rarest_first = F.array_sort(F.collect_set(F.struct(F.col("key").bitwiseAND(F.lit(1)).alias("empty"), "count", "key")))
    lists = shared.groupBy("node", "tag").agg(rarest_first.alias("keys")).withColumn("take", F.size("keys") - F.shiftright("tag", 1)).where("take > 0")
    chosen = lists.select("node", F.explode(F.slice("keys", F.lit(1), F.least(F.col("take"), F.size("keys")).cast("int"))).alias("k")).select("node", F.col("k.key").alias("key"))
    chosen = written(chosen, "prefixes")
    stars = chosen.withColumn("a", F.min("node").over(own)).where("a <> node")
    return written(stars.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("buckets")), "pairs")


def node_sets(docs: DataFrame, wanted: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """``node``, ``n`` and sorted ``elements`` of the nodes of ``wanted``."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with their nodes; a task sends a node once."""
        seen: set[int] = set()
        for batch in slices(batches, "_text", SLICE):
            nodes = node_of(shingle_sets(as_text(batch.column("_text")), rule))
            new = [i for i, x in enumerate(nodes.tolist()) if not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), batch.column("_text").take(pa.array(new, pa.int64()))], ["node", "_text"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", SLICE):
            sets = shingle_sets(as_text(batch.column("_text")), rule)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "n", "elements"])

    named = docs.select(docs[text_col].alias("_text")).where("_text is not null").mapInArrow(name, "node long, _text string")
    found = named.hint("merge").join(wanted, "node").groupBy("node").agg(F.min("_text").alias("_text"))
    return found.mapInArrow(collect, "node long, n long, elements binary")


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def common_elements(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def block_links(rows: pd.DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """Links that join components, between the ``left`` rows of a block and all its rows.

    Pairs are tried from each node on, unless they are of one component by then.
    """
    rows = rows.sort_values(["node", "left"], ascending=[True, False]).drop_duplicates("node").reset_index(drop=True)
    sets = [_set(e) for e in rows["elements"]]
    n = rows["n"].to_numpy()
    left = rows["left"].to_numpy()
    node = rows["node"].tolist()
    names = {r: i for i, r in enumerate(dict.fromkeys(rows["root"]))}
    root = np.array([names[r] for r in rows["root"]])
    bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    for i, s in enumerate(sets):
        bits[i] = np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    packed = np.packbits(bits, axis=1).view(np.uint64)
    links = []
    for i in np.flatnonzero(left).tolist():
        other = np.flatnonzero(~left | (np.arange(len(sets)) > i))
        lo, hi = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
        other = other[(root[other] != root[i]) & (100 * lo >= rule.percent * hi)]
        if not len(other):
            continue
        differ = np.bitwise_count(packed[other] ^ packed[i]).sum(axis=1)
        for j in other[differ * (100 + rule.percent) <= (n[other] + n[i]) * (100 - rule.percent)].tolist():
            if root[i] != root[j] and rule.linked(common_elements(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                links.append((node[i], node[j]))
                root[root == root[j]] = root[i]
    return links


def compared(rows: DataFrame, sets: DataFrame, rule: Rule, cell: Sequence[str]) -> DataFrame:
    """Links (a, b) found in each cell. ``rows``: the columns of a cell, node, root and whether it is on the ``left``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(group, rule), columns=["a", "b"]).astype("int64")

    return rows.join(sets.hint("merge"), "node").groupBy(*cell).applyInPandas(run, "a long, b long")


def blocks_of(count) -> F.Column:
    return F.ceil(count / F.lit(BLOCK))


def block_of(blocks: str) -> F.Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks))


def local_links(clusters: DataFrame, pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links inside the blocks of each cluster (node, cluster), its hubs being in all of its blocks."""
    sizes = clusters.groupBy("cluster").agg(blocks_of(F.count("*")).alias("blocks"))
    large = written(sizes.where("blocks > 1"), "large")
    placed = clusters.hint("merge").join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = placed.select("cluster", block_of("blocks").alias("block"), "node", F.col("node").alias("root"), F.lit(True).alias("left"))
    degree = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("buckets").alias("degree")).join(clusters, "node")
    best = Window.partitionBy("cluster", "salt").orderBy(F.desc("degree"), "node")
    some = degree.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HUBS)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "node"))
    hubs = some.join(large, "cluster").withColumn("rank", rank).where(F.col("rank") <= HUBS)
    hubs = hubs.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node", F.col("node").alias("root"), F.lit(True).alias("left"))
    return compared(rows.unionByName(written(hubs, "hubs")), sets, rule, ["cluster", "block"])


def grid_links(undecided: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between the components of a cluster. ``undecided``: node, cluster, root.

    Rows outside the largest component of a cluster meet all its rows: cells of (block of those, block of all).
    """
    by_root = undecided.groupBy("cluster", "root").count()
    sizes = by_root.groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("all"))
    sizes = sizes.select("cluster", F.col("top.root").alias("giant"), blocks_of(F.col("all")).alias("blocks"), blocks_of(F.col("all") - F.col("top.count")).alias("odd_blocks")).where("odd_blocks > 0")
    placed = undecided.hint("merge").join(written(sizes, "sizes"), "cluster")
    every = placed.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("odd_blocks") - 1)).alias("i"), block_of("blocks").alias("j"), "node", "root", F.lit(False).alias("left"))
    odd = placed.where("root <> giant").select("cluster", block_of("odd_blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "node", "root", F.lit(True).alias("left"))
    return compared(every.unionByName(odd), sets, rule, ["cluster", "i", "j"])


def labelled_rows(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row's ``_id``, ``n`` and ``node``, and every node's ``component_id`` and ``root``."""
    table = written(sized(docs, rule, id_col, text_col), "sized", lasting=True)
    nodes = table.where("node is not null").groupBy("node").agg(F.min("_id").alias("least"))
    pairs = candidate_pairs(keyed_parts(docs, rule, text_col))
    clusters = written(components(pairs.select("a", "b")).withColumnRenamed("root", "cluster"), "clusters")
    sets = written(node_sets(docs, clusters.select("node"), rule, text_col), "sets")
    links = written(local_links(clusters, pairs, sets, rule), "links")
    placed = written(clusters.join(components(links).hint("merge"), "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root")), "placed")
    several = placed.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("count")).where(F.col("lo") != F.col("hi")).where(F.col("count") > BLOCK).select("cluster")
    undecided = written(placed.hint("merge").join(several, "cluster"), "undecided")
    more = written(grid_links(undecided, sets, rule), "links")
    roots = components(links.unionByName(more))
    known = written(nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "known")
    final = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return table, written(known.hint("merge").join(final, "root").select("node", "root", "component_id"), "labels", lasting=True)


def link_documents(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every row."""
    with scratch(docs.sparkSession):
        table, labels = labelled_rows(docs, rule, id_col, text_col)
    out = table.hint("merge").join(labels, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last, then the smallest hash of
    the set), and of several rows of that id and set the one with the smallest text. Rows with empty sets all stay."""
    with scratch(docs.sparkSession):
        table, labels = labelled_rows(docs, rule, id_col, text_col)
        first = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "node"))
        winners = table.select("_id", "node").distinct().join(labels.hint("merge"), "node").groupBy("root").agg(first.alias("w"))
        winners = written(winners.select(F.col("w._id").alias("_id"), F.col("w.node").alias("_node"), F.lit(True).alias("_wins")), "winners", lasting=True)
    kept = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), kept.alias("_kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their nodes; a task sends an id with a text once, unless its set is empty."""
        seen: set[tuple] = set()
        for batch in slices(batches, "_text", SLICE):
            texts = as_text(batch.column("_text"))
            sets = shingle_sets(texts, rule)
            nodes, new = node_of(sets), []
            for i, (name, s, text) in enumerate(zip(batch.column("_id").to_pylist(), sets, texts, strict=True)):
                this = (name, xxhash.xxh3_64_intdigest(text.as_buffer() or b""))
                if not len(s) or this not in seen:
                    new.append(i)
                    seen.add(this)
            taken = batch.take(pa.array(new, pa.int64()))
            empty = np.array([not len(sets[i]) for i in new], bool)
            yield pa.RecordBatch.from_arrays([taken.column("_id"), pa.array(nodes[new], mask=empty), taken.column("_kept")], ["_id", "_node", "_kept"])

    named = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _node long, _kept {rows.schema['_kept'].dataType.simpleString()}")
    same = named["_id"].eqNullSafe(winners["_id"]) & (named["_node"] == winners["_node"])
    joined = named.hint("merge").join(winners, same, "left").where(named["_node"].isNull() | F.col("_wins")).select(named["_id"], named["_node"], "_kept")
    order = F.row_number().over(Window.partitionBy("_id", "_node").orderBy(F.col(f"_kept.`{text_col}`"), F.to_json("_kept")))
    numbered = joined.withColumn("_number", F.when(F.col("_node").isNull(), F.lit(1)).otherwise(order))
    return numbered.where("_number = 1").select("_kept.*")


#: DuckDB SQL of the query, for tables whose ids are neither null nor repeated.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
             else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
r(doc_id, node) as (select distinct a, a from e union select r.doc_id, e.b from r join e on r.node = e.a),
c as (select doc_id, min(node) as component_id from r group by doc_id)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id from s left join c using (doc_id)
"""
