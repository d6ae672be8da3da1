"""Image relations derived from the star-schema tables, in Spark and, as CTEs, in DuckDB SQL.

Everything is integer or exactly rounded, so both engines agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a row of the mosaic image.
TILES_X = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def levels(embedding: Column) -> Column:
    """64 byte levels of an embedding."""
    return F.transform(embedding, lambda e: F.floor((e.cast("double") + 1.0) * 127.5).cast("int"))


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 colour tile for each embedding: image_id, cell, p, r, g, b."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("cell"), levels(F.col("embedding")).alias("lv"))
    exploded = rows.select("image_id", "cell", "lv", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return exploded.select("image_id", "cell", "p", F.get("lv", F.col("p")).alias("r"), F.get("lv", (F.col("p") + 21) % 64).alias("g"), F.get("lv", (F.col("p") + 42) % 64).alias("b"))


TILE_PIXELS = """
lv as (select label::bigint as image_id, vec_id as cell, list_transform(embedding, lambda e: floor((e::double + 1.0) * 127.5)::int) as lv from embeddings),
px as (select image_id, cell, p::int as p, lv[p + 1] as r, lv[(p + 21) % 64 + 1] as g, lv[(p + 42) % 64 + 1] as b from (select *, unnest(range(64)) as p from lv))"""


def mosaic_tiles(spark: SparkSession, sf_dir: str, rich: bool = False, **derived: Callable[[Column], Column]) -> DataFrame:
    """One image of 20 cells a row: cell, size, and the 64 two-bit values of its tile.

    ``rich`` gives many more distinct tiles. ``derived``: further columns by name, made of the tile.

    A tile depends on s % 30, cell % 4 and, if rich, cell % 61 alone, so the tiles of all these remainders (signs included)
    are made once and cells take theirs by a broadcast join. The narrow rows are dealt out first: a part file of a few
    megabytes, which would be two or three tasks, is gigabytes of tiles.
    """
    size = F.col("p_size") + 50 * (F.col("p_partkey") % 97) if rich else F.col("p_size").cast("long")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), "p_size", size.alias("s"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(n, spark.sparkContext.defaultParallelism), "cell")
    k, odd = F.col("_k"), F.col("_odd")

    def value(p: Column) -> Column:
        x, y = p % 8, F.floor(p / 8)
        fx = F.when(k.isin(1, 3), 7 - x).otherwise(x)
        fy = F.when(k >= 2, 7 - y).otherwise(y)
        v = (F.col("_s") % 3 + fx * (F.col("_s") % 2 + 1) + fy * (F.col("_s") % 5)) % 4
        return (F.when(p == odd, (v + 1) % 4).otherwise(v) if rich else v).cast("int")

    every = spark.range(-29, 30, 1, 4).withColumnRenamed("id", "_s").crossJoin(spark.range(-3, 4, 1, 1).withColumnRenamed("id", "_k"))
    every = every.crossJoin(spark.range(-60 if rich else 0, 61 if rich else 1, 1, 1).withColumnRenamed("id", "_odd"))
    if rich:  # the remainders of one cell have its sign
        every = every.where("_k * _odd >= 0")
    table = every.select("_s", "_k", "_odd", F.transform(F.sequence(F.lit(0), F.lit(63)), value).alias("tile"))
    table = table.select("*", *[f(F.col("tile")).alias(name) for name, f in derived.items()])
    keyed = rows.select("cell", "p_size", (F.col("s") % 30).alias("_s"), F.coalesce(F.col("cell") % 4, F.lit(0)).alias("_k"), (F.coalesce(F.col("cell") % 61, F.lit(0)) if rich else F.lit(0)).cast("long").alias("_odd"))
    unknown = F.array_repeat(F.lit(None).cast("int"), 64)  # of a cell without a size
    filled = {"tile": F.coalesce("tile", unknown), **{name: F.coalesce(name, f(unknown)) for name, f in derived.items()}}
    return keyed.join(F.broadcast(table), ["_s", "_k", "_odd"], "left").select("cell", "p_size", *[c.alias(name) for name, c in filled.items()])


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, p_size, p, x, y, v."""
    rows = mosaic_tiles(spark, sf_dir).select("cell", "p_size", F.posexplode("tile").alias("p", "v"))
    return rows.select("cell", "p_size", "p", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "v")


def _mosaic(size: str, value: str) -> str:
    return f"""
mz as (select p_partkey as cell, p_size, {size} as s, unnest(range(64)) as p from part),
mf as (select *, case when cell % 4 in (1, 3) then 7 - p % 8 else p % 8 end as fx, case when cell % 4 >= 2 then 7 - p // 8 else p // 8 end as fy from mz),
mv as (select *, (s % 3 + fx * (s % 2 + 1) + fy * (s % 5)) % 4 as v0 from mf),
mos as (select cell, p_size, p::int as p, (p % 8)::int as x, (p // 8)::int as y, ({value})::int as v from mv),
pat as (select cell, any_value(p_size) as p_size, string_agg(v::varchar, '' order by p) as k from mos group by cell)"""


MOSAIC = _mosaic("p_size", "v0")
RICH_MOSAIC = _mosaic("p_size + 50 * (p_partkey % 97)", "case when p = cell % 61 then (v0 + 1) % 4 else v0 end")


def pattern_key(tile: Column) -> Column:
    """A tile as a string of its values."""
    return F.array_join(tile.cast("array<string>"), "")


def gid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map cells with tile ids and flip bits: cell, gid, raw."""
    gid = F.col("o_custkey") % 1500 + 1
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), gid.alias("gid"), (gid + F.col("o_orderkey") % 8 * 536870912).alias("raw"))


def tilesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") * 20 + 1).alias("firstgid"))


GIDS = """
gids as (select o_orderkey as cell, o_custkey % 1500 + 1 as gid, o_custkey % 1500 + 1 + o_orderkey % 8 * 536870912 as raw from orders),
ts as (select s_suppkey as sid, s_suppkey * 20 + 1 as firstgid from supplier)"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte streams, one for each user: stream, i (dense order), v."""
    v = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "error", 0).otherwise(2)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("i"), v.alias("v"))


STREAMS = """
bytes as (select user_id as stream, event_id as i, case when event_type in ('click', 'view') then 1 when event_type = 'error' then 0 else 2 end as v from events)"""
