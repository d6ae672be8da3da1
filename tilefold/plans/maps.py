"""Queries of maps whose cells draw the pixels of tileset images."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..sources import maps, sinks
from .queries import mosaic, query

#: Maps that the orders are dealt to, and tiles of a tileset at most.
_MAPS, _TILES = 7, 20

_MAP_SQL = f"""with {bridge.MOSAIC},
c as (select *, raw & 268435455 as gid from (select o_custkey % {_MAPS} as path, o_orderkey as cell, (case when o_orderkey % 11 = 0 then 0 else o_custkey % 1500 + 1 + o_orderkey % 8 * 536870912 end)::bigint as raw from orders)),
ts as (select s_suppkey % {_MAPS} as path, s_suppkey as sid, s_suppkey * {_TILES} + 1 as firstgid from supplier),
ti as (select path, firstgid, id, k from (select *, unnest(range({_TILES})) as id from ts) join pat on pat.cell = (sid * {_TILES} + id) % 199 + 1 where id < {_TILES} - sid % 3 * 4),
a as (select c.*, firstgid, gid - firstgid as id from c asof left join ts on c.path = ts.path and c.gid >= ts.firstgid),
s as (select a.path, a.cell, raw, gid, k from a left join ti on ti.path = a.path and ti.firstgid = a.firstgid and ti.id = a.id and gid > 0),
u as (select *, case when (raw >> 31) & 1 = 1 then 7 - p % 8 else p % 8 end as x, case when (raw >> 30) & 1 = 1 then 7 - p // 8 else p // 8 end as y from (select *, unnest(range(64)) as p from s)),
o as (select path, cell, any_value(gid) as gid, string_agg(substr(k, (case when (raw >> 29) & 1 = 1 then x * 8 + y else y * 8 + x end + 1)::bigint, 1), '' order by p) as pixels from u group by path, cell)
select path, cell, case when gid = 0 then 'empty' when pixels is null then 'outside' else 'tile' end as state, case when gid = 0 then repeat('0', 64) else pixels end as pixels from o"""


@query("map_cells", _MAP_SQL)
def map_cells(spark, d):
    """Cells of several maps, drawn from the tilesets of each; empty cells and cells without a tile are kept."""
    gid = F.col("o_custkey") % 1500 + 1 + F.col("o_orderkey") % 8 * 536870912
    raw = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(gid).cast("long")
    cells = bridge.read(spark, d, "orders").select((F.col("o_custkey") % _MAPS).alias("path"), F.col("o_orderkey").alias("cell"), raw.alias("raw"))
    sets = bridge.read(spark, d, "supplier").select((F.col("s_suppkey") % _MAPS).alias("path"), F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") * _TILES + 1).alias("firstgid"))
    ids = sets.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_TILES - 1).cast("long")))).where(F.col("id") < _TILES - F.col("sid") % 3 * 4)
    images = mosaic(spark, d).select("cell", F.col("tile").alias("pixels"))
    tiles = ids.withColumn("cell", (F.col("sid") * _TILES + F.col("id")) % 199 + 1).join(images, "cell").select("path", "firstgid", "id", "pixels")
    rows = maps.drawn(maps.tiles_as_of(cells, sets.select("path", "firstgid")), tiles, F.lit(8), F.lit(8))
    return rows.select("path", "cell", "state", F.array_join(F.col("pixels").cast("array<string>"), "").alias("pixels"))


@query("png_file_parts")
def png_file_parts(spark, d):
    """The mosaic cut into images of 20 lines of 32 entries, as the parts of their PNG files: how long each is, and its checksum."""
    lines = 20
    rows = mosaic(spark, d).withColumn("image", F.floor(F.col("cell") / (bridge.TILES_X * lines)))
    name = F.concat(F.col("image").cast("string"), F.lit(".png")).alias("file")
    cells = rows.select(name, (F.col("cell") % (bridge.TILES_X * lines)).alias("cell"), F.transform("tile", lambda v: v + F.col("p_size") % 8 * 4).alias("pixels"))
    images = cells.groupBy("file").agg(F.ceil((F.max("cell") + 1) / bridge.TILES_X).cast("int").alias("tiles_y"))
    entries = images.select("file", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("entry"))
    palettes = entries.select("file", "entry", (F.col("entry") * 8).alias("r"), (255 - F.col("entry") * 8).alias("g"), (F.col("entry") % 4 * 64).alias("b"))
    parts = sinks.indexed_images(cells, palettes, images.select("file", F.lit(bridge.TILES_X).alias("tiles_x"), "tiles_y"), transparent_zero=True)
    return parts.select("file", "nth", F.length("data").alias("bytes"), F.crc32("data").alias("crc32"))
