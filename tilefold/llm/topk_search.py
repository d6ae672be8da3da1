"""Exact top-k inner-product search by tiled matrix products.

Candidates are packed into tiles of some thousand vectors, queries into blocks; blocks are
copied to every shard and tiles dealt over the shards, so a shard's join of both on the shard
number yields each pair of a tile and a block once. A pair is one matrix product, of which each
query keeps its best k; the lists of a task are merged as it goes on, those of shards in a tree.

Components become floor(1024 * x). Products are exact: in float64 while no sum can reach 2**53,
else in 64-bit integers (which wrap where a score exceeds a long; a component beyond a long is
clipped to one).

Defined results: vectors that are null or hold null, NaN or infinite components and rows with a
null id take no part; a shorter vector counts as filled up with zeros; each query row has its
own list, without candidates of its own id, and repeated candidate rows each count; ties go to
the smaller id; a query without candidates has no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE, BLOCK = 2048, 512
#: Shards for each square root of the number of tiles: copies of the queries and tasks grow alike.
SPREAD = 8
#: Shards whose lists one step of the tree merges.
FAN = 8
#: Query blocks whose lists a task holds at once.
HELD_BLOCKS = 128
SCALE = 1024


def integers(vectors: pa.ListArray) -> np.ndarray:
    """Rows of floor(1024 * x), filled up with zeros to the longest."""
    lengths = np.diff(np.asarray(vectors.offsets)).astype(np.int64)
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * SCALE)
    limit = 2.0**63
    whole = np.where(flat >= limit, np.iinfo(np.int64).max, np.where(flat < -limit, np.iinfo(np.int64).min, np.clip(flat, -limit, limit - 1024).astype(np.int64)))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(width, 1)
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row by (score descending, id): row numbers, scores, ids."""
    row, col = np.nonzero(valid)
    s, i = scores[row, col], ids[row, col]
    if scores.shape[1] > 4 * k:  # what is below a row's k-th best cannot be among them
        floor = np.iinfo(np.int64).min
        kth = np.partition(np.where(valid, scores, floor), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        near = s >= kth[row]
        row, s, i = row[near], s[near], i[near]
    order = np.lexsort((i, -s.astype(np.float64), row)) if np.abs(s.astype(np.float64)).max(initial=0) < 2.0**53 else np.lexsort((i, ~s, row))
    row, s, i = row[order], s[order], i[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], s[keep], i[keep]


def packed(vectors: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows of at most ``size`` vectors: ``ids`` and ``cells`` (64-bit integers) and their ``width``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                vectors = part.column("_v")
                cells = integers(vectors if isinstance(vectors, pa.ListArray) else vectors.cast(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column("_id"), "<i8").tobytes()], pa.binary()), pa.array([cells.astype("<i8").tobytes()], pa.binary()), pa.array([cells.shape[1]], pa.int64())], ["ids", "cells", "width"])

    rows = vectors.select(vectors[id_col].cast("long").alias("_id"), vectors[vector_col].cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & ~F.coalesce(bad, F.lit(False))).mapInArrow(pack, "ids binary, cells binary, width long")


def shard_count(rows: int) -> int:
    """Grows with the square root of the number of tiles, so that neither a shard nor the copies of the queries grow as fast as the input."""
    return max(1, math.ceil(SPREAD * math.sqrt(math.ceil(rows / TILE))))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best candidates of each query row."""

    def shaped(ids: bytes, cells: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
        names = np.frombuffer(ids, "<i8")
        return names, np.frombuffer(cells, "<i8").reshape(len(names), width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, (shard, names, row, s, i) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + row), pa.array([shard] * len(row), pa.int64()), pa.array(names[row]), pa.array(i), pa.array(s)], ["qkey", "shard", "query_id", "vec_id", "score"])
            held.clear()

        for batch in batches:
            for n in range(batch.num_rows):
                x = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                names, q = shaped(x["q_ids"], x["q_cells"], x["q_width"])
                ids, t = shaped(x["ids"], x["cells"], x["width"])
                key = x["block"]
                row, s, i = best(product(q, t), np.broadcast_to(ids, (len(names), len(ids))), names[:, None] != ids[None, :], k)
                if key in held:
                    row, s, i = (np.concatenate([a, b]) for a, b in zip(held[key][2:], (row, s, i), strict=True))
                    order = np.lexsort((i, ~s, row))
                    row, s, i = row[order], s[order], i[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(names)))[row] < k
                    row, s, i = row[keep], s[keep], i[keep]
                elif len(held) >= HELD_BLOCKS:
                    yield from out()
                held[key] = (x["shard"], names, row, s, i)
        yield from out()

    shards = shard_count(vectors.count())
    tiles = packed(vectors, TILE, id_col, vector_col).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)))
    blocks = packed(vectors.where(is_query), BLOCK, id_col, vector_col).select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("width").alias("q_width"))
    everywhere = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    lists = tiles.join(everywhere, "shard").mapInArrow(multiply, "qkey long, shard long, query_id long, vec_id long, score long")

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    while shards > FAN:
        lists = merged(lists.withColumn("shard", F.floor(F.col("shard") / FAN)), "qkey", "shard").select(*lists.columns)
        shards = math.ceil(shards / FAN)
    return merged(lists, "qkey").select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
      from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""
