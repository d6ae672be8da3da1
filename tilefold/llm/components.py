"""Connected components of a table of links, by alternating large and small stars.

Every step is an aggregation with partial sums and an equi-join, sorted so that a hub's rows can
be split; no task sees a whole component and the driver sees two numbers for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, recorded, written

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node in edges (a, b) of longs.

    A working table holds the result; those of the rounds before are deleted.
    """
    spark, last = edges.sparkSession, []
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with recorded(last):
        edges = written(edges, "edges")
    before = _signature(edges)
    for _ in range(MAX_ROUNDS):
        # large star: each larger neighbour of a node is linked with the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours are linked with the smallest of those
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now: list[str] = []
        with recorded(now):
            edges = written(small.where("a <> b").distinct(), "edges")
        delete(spark, last)
        last, after = now, _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # At the end every node but a root has one edge, to its root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
