"""Exact k-means in whole numbers with adaptive distance bounds (Drake and Hamerly).

Each vector carries an upper bound of the distance to its centroid, lower bounds of the distances
to its several next nearest centroids, and one lower bound for all the others. When centroids have
moved, the bounds are moved by as much. A vector whose upper bound lies below all lower bounds
keeps its centroid unseen. Else the distance to its own centroid is computed, then those to the
listed centroids whose bounds do not clear it; only where the nearest of these cannot be certified
against the remainder bound are all centroids scanned again. The number of listed centroids
shrinks to the longest prefix of a list that a round had to look at (an eighth of the centroids
at least).

Distances are exact integers; bounds are their roots in doubles, always rounded away from the
claim they make, and a claim needs a strict inequality, so ties go to the smaller centroid as in
a full scan. A round is one pass over the vectors, written as a table; partial sums of each task
are added up by Spark, and the driver sees k x dimensions numbers.

Defined results: vectors that are null, have another number of components than ``dims`` or hold
null, NaN or infinite components take no part. A component becomes floor(scale * x), clipped so
that no squared distance exceeds a long. Repeated rows are vectors of their own; of vectors with
equal ids (or none: those come last) the one with the smaller components is the first seed. Fewer
vectors than ``k`` are as many centroids; equal centroids are told apart by their numbers, of
which the smaller wins. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, recorded, scratch, written

#: Vectors that a task computes with at once.
ROWS = 8192
_GROW, _SHRINK = 1 + 1e-12, 1 - 1e-12
_STATE = "vec_id long, cells array<long>, cluster int, distance long, upper double, near array<int>, lower array<double>, rest double"
_SUMS = "cluster int, n long, deepest int, scans long, cells array<long>"


def limit_of(dims: int) -> int:
    """Largest component for which a squared distance fits a long."""
    return math.isqrt(2**62 // max(dims, 1)) // 2


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``cells`` of the vectors that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = float(limit_of(dims))
    cells = F.transform("v", lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(scale * x).cast("double"))).cast("long"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == dims)).where(~F.coalesce(bad, F.lit(False))).select("vec_id", cells.alias("cells"))


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first ``k`` vectors by the hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "cells").orderBy(F.asc_nulls_last("key"), "cells").limit(k).collect()
    return np.array([r.cells for r in rows], np.int64)


def matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return np.asarray(column.flatten(), dtype).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centers."""
    bound = float(np.abs(x).max(initial=0)) + float(np.abs(centers).max(initial=0))
    if x.shape[1] * bound * bound < 2.0**53:
        a, c = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centers], axis=1)


class Bounds:
    """What is known of the distances of some vectors: one row each."""

    def __init__(self, cluster: np.ndarray, distance: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.cluster, self.distance, self.upper, self.near, self.lower, self.rest = cluster, distance, upper, near, lower, rest

    @classmethod
    def scanned(cls, x: np.ndarray, centers: np.ndarray, listed: int) -> Bounds:
        """By all distances; the nearest ``listed`` + 1 centroids are kept in order."""
        d = squared(x, centers)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, 1)
        roots = np.sqrt(d.astype(np.float64)) * _SHRINK
        rest = roots[:, listed + 1] if d.shape[1] > listed + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].astype(np.int32), d[:, 0].copy(), np.sqrt(d[:, 0].astype(np.float64)) * _GROW, order[:, 1 : listed + 1].astype(np.int32), roots[:, 1 : listed + 1], rest)

    def moved(self, by: np.ndarray, listed: int) -> None:
        """Centroids went at most ``by`` away; the list is cut to ``listed``, what falls off joins the rest."""
        self.upper = (self.upper + by[self.cluster]) * _GROW
        self.lower = np.maximum(self.lower - by[self.near], 0) * _SHRINK
        self.rest = np.maximum(self.rest - by.max(initial=0), 0) * _SHRINK
        if self.near.shape[1] > listed:
            self.rest = np.minimum(self.rest, self.lower[:, listed:].min(1))
            self.near, self.lower = self.near[:, :listed], self.lower[:, :listed]

    def settle(self, x: np.ndarray, centers: np.ndarray) -> tuple[int, int]:
        """The nearest centroid of each vector; (longest prefix of a list looked at, distances computed)."""
        floor = np.minimum(self.lower.min(1, initial=np.inf), self.rest)
        rows = np.flatnonzero(~(self.upper < floor))
        if not len(rows):
            return 0, 0
        own = ((x[rows] - centers[self.cluster[rows]]) ** 2).sum(1)
        self.upper[rows] = np.sqrt(own.astype(np.float64)) * _GROW
        work = len(rows)
        rows = rows[~(self.upper[rows] < floor[rows])]
        deepest = 0
        if len(rows):
            best = ((x[rows] - centers[self.cluster[rows]]) ** 2).sum(1)
            for place in range(self.near.shape[1]):
                some = ~(self.upper[rows] < self.lower[rows, place])  # those that this centroid may be nearer to
                if not some.any():
                    continue
                at, deepest = rows[some], place + 1
                other = self.near[at, place].copy()
                d = ((x[at] - centers[other]) ** 2).sum(1)
                work += len(at)
                mine, had = self.cluster[at], best[some]
                wins = (d < had) | ((d == had) & (other < mine))
                self.near[at, place] = np.where(wins, mine, other)
                self.lower[at, place] = np.sqrt(np.where(wins, had, d).astype(np.float64)) * _SHRINK
                self.cluster[at] = np.where(wins, other, mine)
                best[some] = np.where(wins, d, had)
                self.upper[at] = np.sqrt(best[some].astype(np.float64)) * _GROW
            unsure = rows[~(self.upper[rows] < self.rest[rows])]
            if len(unsure):
                fresh = Bounds.scanned(x[unsure], centers, self.near.shape[1])
                for name in ("cluster", "upper", "near", "lower", "rest"):
                    getattr(self, name)[unsure] = getattr(fresh, name)
                work += len(unsure) * len(centers)
        return deepest, work


def assigned(rows: DataFrame, centers: np.ndarray, moves: np.ndarray | None, listed: int, exact: bool) -> DataFrame:
    """State rows after one assignment (``rows`` are state rows, or vectors if ``moves`` is None).

    A task adds one row for each cluster, without cells of its own: ``sums`` of its vectors,
    how deep lists were read and how many distances were computed. With ``exact``, distances are filled in.
    """
    names = ["vec_id", "cells", "cluster", "distance", "upper", "near", "lower", "rest"]
    k, dims = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                x = matrix(batch.column("cells"), np.int64, dims)
                if moves is None:
                    state = Bounds.scanned(x, centers, listed)
                    deepest, work = 0, len(x) * k
                else:
                    had = len(batch.column("near")[0])
                    parts = [np.array(batch.column(c)) for c in ("cluster", "distance", "upper")]
                    state = Bounds(*parts, matrix(batch.column("near"), np.int32, had).copy(), matrix(batch.column("lower"), np.float64, had).copy(), np.array(batch.column("rest")))
                    state.moved(moves, listed)
                    deepest, work = state.settle(x, centers)
                if exact:
                    state.distance = ((x - centers[state.cluster]) ** 2).sum(1)
                effort = np.zeros((len(x), 2), np.int64)
                effort[:1] = deepest, work
                columns = [batch.column("vec_id"), batch.column("cells"), pa.array(state.cluster), pa.array(state.distance), pa.array(state.upper), lists(state.near), lists(state.lower), pa.array(state.rest), pa.array(effort[:, 0].astype(np.int32)), pa.array(effort[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, [*names, "deepest", "scans"])

    return rows.mapInArrow(run, _STATE + ", deepest int, scans long")


def sums(state: DataFrame, dims: int) -> list:
    """For each cluster: ``n``, and the sum of each component as an exact whole number; at most clusters x dims rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x, cluster = matrix(batch.column("cells"), np.int64, dims), np.asarray(batch.column("cluster"))
            deep, scans = np.asarray(batch.column("deepest")), np.asarray(batch.column("scans"))
            for c in np.unique(cluster):
                of = cluster == c
                t = total.setdefault(int(c), [0, 0, 0, np.zeros(dims, np.int64)])
                t[0] += int(of.sum())
                t[1] = max(t[1], int(deep[of].max()))
                t[2] += int(scans[of].sum())
                t[3] += x[of].sum(0)
        if total:
            rows = list(total.items())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), *(pa.array([t[i] for _, t in rows], kind) for i, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))), lists(np.stack([t[3] for _, t in rows]))], ["cluster", "n", "deepest", "scans", "cells"])

    parts = state.select("cluster", "cells", "deepest", "scans").mapInArrow(add, _SUMS)
    spread = parts.select("cluster", "n", "deepest", "scans", F.posexplode("cells").alias("place", "cell"))
    return spread.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.max("deepest").alias("deepest"), F.sum("scans").alias("scans"), F.sum(F.col("cell").cast("decimal(38,0)")).alias("cell")).collect()


def cluster(vectors: DataFrame, k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", efforts: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, ``cells``, ``cluster``, ``distance`` of each vector; the final centroids).

    ``efforts`` is filled with the number of distances that each assignment computed.
    """
    spark: SparkSession = vectors.sparkSession
    with scratch(spark):
        kept = written(kept_vectors(vectors, dims, scale, id_col, vector_col), "vectors")
        centers = seeds(kept, k, seed)
        if not len(centers):
            return spark.createDataFrame([], "vec_id long, cells array<long>, cluster int, distance long"), np.zeros((0, dims), np.int64)
        least = min(max(1, math.ceil(len(centers) / 8)), len(centers) - 1)
        listed, moves, rows = min(max(1, math.ceil(len(centers) / 4)), len(centers) - 1), None, kept
        made: list[str] = []
        for turn in range(rounds + 1):
            state, now = assigned(rows, centers, moves, listed, turn == rounds), []
            if turn < rounds:
                with recorded(now):
                    rows = written(state, "clusters")
            else:
                rows = written(state, "clusters", lasting=True)
            delete(spark, made)
            made = now
            if efforts is not None or turn < rounds:
                found = sums(rows, dims)
                if efforts is not None:
                    efforts.append(sum(r.scans for r in found if r.place == 0))
            if turn < rounds:
                after = centers.copy()
                for r in found:
                    after[r.cluster, r.place] = int(r.cell) // r.n
                moves = np.sqrt(((after - centers) ** 2).sum(1).astype(np.float64)) * _GROW
                if turn:
                    listed = max(least, min(listed, max(r.deepest for r in found)))
                centers = after
    return rows.select("vec_id", "cells", "cluster", "distance"), centers


def digest(center: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, center.tolist())).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, sums of distances over the cluster and over all, and a hash of the centroid."""
    rows, centers = cluster(vectors, **options)
    spark = vectors.sparkSession
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    known = [(c, d, total, digest(centers[c])) for c, d in sorted(inertia.items())]  # a row for each cluster
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> str:
    top = limit_of(dims)
    parts = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: greatest(-{top}.0, least({top}.0, floor({scale} * x::double)))::bigint) as c
           from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select (row_number() over (order by sha256('{seed}:' || vec_id) nulls last, c) - 1)::int as cluster, c from v qualify cluster < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} as materialized (select r, any_value(vec_id) as vec_id, any_value(v) as v, min((d, cluster)) as best from
            (select v.r, v.vec_id, v.c as v, c.cluster, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.c[i] - c.c[i]) * (v.c[i] - c.c[i])))::bigint as d from v, c{t} c) group by r)""")
        if t < rounds:
            parts.append(f"""n{t} as (select cluster, list(x order by i) as c from
            (select best[2] as cluster, i, sum(v[i]) as s, count(*) as n, ((s - ((s % n) + n) % n) / n)::bigint as x from a{t}, range(1, {dims} + 1) q(i) group by 1, 2) group by cluster)""")
            parts.append(f"c{t + 1} as materialized (select cluster, coalesce(n.c, c.c) as c from c{t} c left join n{t} n using (cluster))")
    return f"""with {", ".join(parts)}
    select vec_id, best[2]::int as cluster, best[1]::bigint as distance, (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia, (sum(best[1]) over ())::bigint as inertia,
           sha256(array_to_string(c{rounds}.c, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c{rounds}.cluster = best[2]"""


ORACLE = _oracle()
