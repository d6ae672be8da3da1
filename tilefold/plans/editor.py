"""Queries of the editor side: layouts, shown colours, options, names, references, seeded draws, sheets, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import bridge, model
from ..functions import codecs, color, draws, let
from ..operators import streams as stream_ops
from ..operators import tiles as tile_ops
from . import queries as base
from .queries import _FLIPS, _IDS, _RUNS, _SETS_SQL, mosaic, query

#: Palette layouts: name, colours of a palette, palettes, cells across a block, whether all palettes share colour 0.
LAYOUTS = (("gbc", 4, 8, 1, False), ("nes", 4, 4, 2, True), ("md", 16, 4, 1, True))
_LAYOUTS_SQL = "lay(layout, cols, n_rows, across, shared) as (values " + ", ".join(f"('{n}', {c}, {r}, {a}, {str(s).lower()})" for n, c, r, a, s in LAYOUTS) + ")"


def layouts(spark) -> DataFrame:
    """Three rows, so a join with them is a broadcast of constants."""
    return F.broadcast(spark.createDataFrame(list(LAYOUTS), "layout string, cols int, n_rows int, across int, shared boolean"))


def entries(spark, d) -> DataFrame:
    """The mosaic as indexed art of 32 entries: cell, p, entry."""
    return bridge.mosaic_pixels(spark, d).select("cell", "p_size", "p", (F.col("v") + F.col("p_size") % 8 * 4).cast("int").alias("entry"))


_ENTRIES = f"{bridge.MOSAIC}, ent as (select cell, p_size, p, (v + p_size % 8 * 4)::int as entry from mos)"

# ---- palettes and attributes ----


@query(
    "layout_switch",
    f"""with {_ENTRIES}, {_LAYOUTS_SQL}, b as (select layout, n_rows, (cell // 20 // across) * 20 + cell % 20 // across as block, entry // cols as palette, not (shared and entry % cols = 0) as votes from ent, lay),
    c as (select layout, block, palette, count(*) filter (votes and palette < n_rows) as n from b group by all)
    select layout, block, coalesce(arg_max(palette, n * 100 - palette) filter (n > 0), 0)::int as palette, count(*) filter (n > 0) > 1 as mixed from c group by layout, block""",
)
def layout_switch(spark, d):
    """The majority palette of every block under each layout.

    A shared colour 0 votes for none, entries beyond the layout's palettes neither; a block without votes has palette 0.
    """
    # distinct entries of a cell are counted before they meet the layouts
    counted = entries(spark, d).groupBy("cell", "entry").agg(F.count("*").alias("n"))
    rows = counted.crossJoin(layouts(spark))  # three constant rows
    block = F.floor(F.floor(F.col("cell") / 20) / F.col("across")) * 20 + F.floor(F.col("cell") % 20 / F.col("across"))
    palette = F.floor(F.col("entry") / F.col("cols")).cast("int")
    counts = ~(F.col("shared") & (F.col("entry") % F.col("cols") == 0)) & (palette < F.col("n_rows"))
    votes = rows.groupBy("layout", block.alias("block"), palette.alias("palette")).agg(F.sum(F.when(counts, F.col("n")).otherwise(0)).alias("n"))
    used = F.col("n") > 0
    best = F.max_by(F.when(used, F.col("palette")), F.when(used, F.struct("n", -F.col("palette"))))
    return votes.groupBy("layout", "block").agg(F.coalesce(best, F.lit(0)).alias("palette"), (F.count_if(used) > 1).alias("mixed"))


@query(
    "displayed_colors",
    f"with {bridge.MOSAIC}, {_SETS_SQL}, u as (select p_size % 4 as row, v, count(*) as n from mos group by all), s as (select pals.*, pr * 65536 + pg * 256 + pb as rgb from pals) select row::int as palette, v as idx, n as pixels, a.rgb::int as stored, b.rgb::int as shown from u join s a on a.p = row and a.i = v join s b on b.p = case when v = 0 then 0 else row end and b.i = v",
)
def displayed_colors(spark, d):
    """Each used palette entry as stored, and as shown where every palette shows colour 0 of the first."""
    table = F.array(*[F.array(*[F.lit(r << 16 | g << 8 | b) for r, g, b in p]) for p in model.PALETTES])
    used = bridge.mosaic_pixels(spark, d).groupBy((F.col("p_size") % 4).cast("int").alias("palette"), F.col("v").alias("idx")).agg(F.count("*").alias("pixels"))
    pick = lambda row: F.get(F.get(table, row), F.col("idx"))
    return used.select("palette", "idx", "pixels", pick(F.col("palette")).alias("stored"), pick(F.when(F.col("idx") == 0, 0).otherwise(F.col("palette"))).alias("shown"))


@query(
    "editor_validation",
    f"""with {_ENTRIES}, {_LAYOUTS_SQL}, m as (select cell // 20 as image_id, max(entry) as top, any_value(cell // 20 * 4 + 8) as h from ent group by 1),
    c as (select layout, image_id, top, case when h % 8 <> 0 then 'dimensions' when top >= cols * n_rows then 'color-index' end as code from m, lay) select layout, image_id, top, code from c where code is not null""",
)
def editor_validation(spark, d):
    """Images that a layout cannot hold: a height that is no multiple of 8, else an index beyond its colours."""
    image = F.floor(F.col("cell") / 20)
    top = entries(spark, d).groupBy(image.alias("image_id")).agg(F.max("entry").alias("top")).crossJoin(layouts(spark))
    code = F.when((F.col("image_id") * 4 + 8) % 8 != 0, "dimensions").when(F.col("top") >= F.col("cols") * F.col("n_rows"), "color-index")
    return top.withColumn("code", code).where("code is not null").select("layout", "image_id", "top", "code")


@query(
    "indexed_groups",
    f"""with {_ENTRIES}, g as (select (cell // 20) // 2 * 10 + cell % 20 // 2 as block, entry >> 2 as grp, (entry & 3) = 0 as zero from ent),
    b as (select block, coalesce(min(grp) filter (not zero), 0)::int as palette, count(distinct grp) filter (not zero) as groups, max(grp)::int as highest, coalesce(max(grp) filter (not zero), 0) as top from g group by block)
    select block, palette, groups, highest, unnest(case when groups > 1 and top >= 4 then ['palette-count', 'region-palettes'] when groups > 1 then ['region-palettes'] when top >= 4 then ['palette-count'] else [null] end) as code from b""",
)
def indexed_groups(spark, d):
    """Four-entry groups of indexed art in each block of 2x2 cells, where all groups share colour 0.

    The block's palette is its least group; several groups, and one beyond the fourth, are reported, a row for each.
    """
    block = F.floor(F.floor(F.col("cell") / 20) / 2) * 10 + F.floor((F.col("cell") % 20) / 2)
    rows = entries(spark, d).select(block.alias("block"), F.shiftright("entry", 2).alias("grp"), (F.col("entry") % 4 == 0).alias("zero")).distinct()
    own = F.when(~F.col("zero"), F.col("grp"))
    found = rows.groupBy("block").agg(F.coalesce(F.min(own), F.lit(0)).alias("palette"), F.count_distinct(own).alias("groups"), F.max("grp").alias("highest"), F.coalesce(F.max(own), F.lit(0)).alias("top"))
    codes = F.array_compact(F.array(F.when(F.col("top") >= 4, "palette-count"), F.when(F.col("groups") > 1, "region-palettes")))
    return found.select("block", "palette", "groups", "highest", F.explode_outer(codes).alias("code"))


_LUMA = "299 * r + 587 * g + 114 * b"


@query(
    "gb_palette_byte",
    f"""with {bridge.TILE_PIXELS}, e as (select cell, p // 16 as i, r, g, b, r * 65536 + g * 256 + b as key, {_LUMA} as l from px where p % 16 = 0 and cell % 5 <> p // 16),
    k as (select distinct cell, key, l from e), o as (select cell, key, row_number() over (partition by cell order by l desc, key) - 1 as place, count(*) over (partition by cell) as n from k),
    s as (select cell, i, case when n = 1 then 0 else (6 * place + n - 1) // (2 * (n - 1)) end as shade from e join o using (cell, key)),
    f as (select c.cell, c.i, coalesce(shade, 3) as shade from (select cell, unnest(range(4)) as i from lv) c left join s on s.cell = c.cell and s.i = c.i)
    select cell, sum(shade << (2 * i)::int)::int as bgp from f group by cell""",
)
def gb_palette_byte(spark, d):
    """The monochrome palette register of each tile's four entries: shades by brightness, 3 for an entry that is missing."""
    px = bridge.tile_pixels(spark, d).where("p % 16 = 0").withColumn("i", F.floor(F.col("p") / 16).cast("int"))
    there = F.col("cell") % 5 != F.col("i")
    key = F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    rows = px.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(there, F.struct((-color.luma(F.col("r"), F.col("g"), F.col("b"))).alias("l"), key.alias("key"))).alias("e")))), lambda x: x["e"]).alias("e"))
    known = F.array_distinct(F.array_sort(F.filter("e", lambda e: e.isNotNull())))
    return rows.withColumn("known", known).select("cell", palette_byte(F.col("e"), F.col("known")).alias("bgp"))


def palette_byte(listed: Column, known: Column) -> Column:
    """Shades spread over the distinct entries, halves rounded up, at two bits an entry."""
    n = F.size(known)
    shade = lambda e: F.when(e.isNull(), 3).when(n == 1, 0).otherwise(F.floor((6 * (F.array_position(known, e) - 1) + n - 1) / (2 * (n - 1))))
    weights = F.array(*[F.lit(1 << 2 * i) for i in range(4)])
    return F.aggregate(F.transform(listed, lambda e, i: (shade(e) * F.get(weights, i)).cast("int")), F.lit(0), lambda a, x: a + x)


@query(
    "shade_group_means",
    f"with {base._COL}, s as (select (({_LUMA} + 500) // 1000 // 64)::int as shade, r, g, b, n from col) select shade, sum(n)::bigint as pixels, ((2 * sum(r * n) + sum(n)) // (2 * sum(n)))::int as r, ((2 * sum(g * n) + sum(n)) // (2 * sum(n)))::int as g, ((2 * sum(b * n) + sum(n)) // (2 * sum(n)))::int as b from s group by shade",
)
def shade_group_means(spark, d):
    """Mean colour of four brightness groups, weighted by pixels, halves rounded up."""
    rows = base.colors(spark, d).withColumn("shade", F.floor(F.floor((color.luma(*base._rgb()) + 500) / 1000) / 64).cast("int"))
    total = F.sum("n")
    mean = lambda c: ((2 * F.sum(F.col(c) * F.col("n")) + total - (2 * F.sum(F.col(c) * F.col("n")) + total) % (2 * total)) / (2 * total)).cast("int")
    return rows.groupBy("shade").agg(total.alias("pixels"), *[mean(c).alias(c) for c in "rgb"])


_GROUPS = 4


def brightness_cuts(bins: Column) -> Column:
    """Where each of up to four brightness groups begins, by least squared error; ``bins``: array of (i, sw, s1, s2), the prefix
    sums of at most 256 bins, with a row of zeros first. Of equal errors the earliest beginning; a group that is not there begins at the end."""
    inf = F.lit(float("inf"))

    def error(a: Column, b: Column) -> Column:
        s1 = (b["s1"] - a["s1"]).cast("double")
        return (b["s2"] - a["s2"]).cast("double") - s1 * s1 / (b["sw"] - a["sw"]).cast("double")

    def with_group(best: Column) -> Column:
        def last(b: Column) -> Column:
            tried = F.transform(F.filter(bins, lambda a: a["i"] < b["i"]), lambda a: F.struct((F.get(best, a["i"].cast("int"))["total"] + error(a, b)).alias("total"), a["i"].cast("int").alias("start")))
            return F.coalesce(F.array_min(tried), F.struct(inf.alias("total"), F.lit(0).alias("start")))

        return F.transform(bins, last)

    n = F.size(bins) - 1
    none = F.transform(bins, lambda b: F.struct(F.when(b["i"] == 0, 0.0).otherwise(inf).alias("total"), F.lit(0).alias("start")))

    def cuts(known: list[Column]) -> Column:
        if len(known) <= _GROUPS:
            return let(with_group(known[-1]), lambda b: cuts([*known, b]))
        starts, at = [], n
        for g in range(_GROUPS, 1, -1):
            at = F.when(n >= g, F.get(known[g], at)["start"]).otherwise(n)
            starts.insert(0, at)
        return F.array(F.lit(0), *starts)

    return let(none, lambda b: cuts([b]))


@query(
    "gb_shade_groups",
    f"""with {base._COL}, l as (select ((299 * r + 587 * g + 114 * b + 500) // 1000)::int as bin, sum(n)::bigint as w from col group by 1),
    x as (select bin, row_number() over (order by bin) as i, sum(w) over (order by bin)::bigint as sw, sum(w * bin) over (order by bin)::bigint as s1, sum(w * bin * bin) over (order by bin)::bigint as s2 from l),
    z as (select i, sw, s1, s2 from x union all select 0, 0, 0, 0),
    e as (select a.i as i, b.i as j, (b.s2 - a.s2)::double - (b.s1 - a.s1)::double * (b.s1 - a.s1)::double / (b.sw - a.sw)::double as err from z a join z b on a.i < b.i),
    g1 as (select j, err as total from e where i = 0),
    g2 as (select e.j, min(total + err) as total, arg_min(e.i, (total + err, e.i)) as s from g1 join e on g1.j = e.i group by e.j),
    g3 as (select e.j, min(total + err) as total, arg_min(e.i, (total + err, e.i)) as s from g2 join e on g2.j = e.i group by e.j),
    g4 as (select e.j, min(total + err) as total, arg_min(e.i, (total + err, e.i)) as s from g3 join e on g3.j = e.i group by e.j),
    n as (select count(*) as n, least(4, count(*)) as k from l), c4 as (select n, k, case when n >= 4 then (select s from g4 where j = n) else n end as c4 from n),
    c3 as (select *, case when n >= 3 then (select s from g3 where j = c4) else n end as c3 from c4), c2 as (select *, case when n >= 2 then (select s from g2 where j = c3) else n end as c2 from c3),
    o as (select bin, k, k - 1 - (case when i > c2 then 1 else 0 end + case when i > c3 then 1 else 0 end + case when i > c4 then 1 else 0 end) as shade_group from x, c2)
    select bin, shade_group::int as shade_group, (case when k = 1 then 0 else (6 * shade_group + k - 1) // (2 * (k - 1)) end)::int as shade from o""",
)
def gb_shade_groups(spark, d):
    """The brightness group (0 the brightest) and shade of every bin of an image whose colours are too many."""
    bins = base.luma_bins(spark, d).withColumn("i", F.row_number().over(Window.orderBy("bin")).cast("long"))  # at most 256 bins
    sums = bins.select("i", "sw", "s1", "s2").unionByName(spark.sql("select 0L as i, 0L as sw, 0L as s1, 0L as s2"))
    packed = sums.agg(F.array_sort(F.collect_list(F.struct("i", "sw", "s1", "s2"))).alias("z"))
    found = packed.select(brightness_cuts(F.col("z")).alias("cuts"), F.least(F.lit(_GROUPS), F.size("z") - 1).alias("k"))
    group = F.col("k") - F.size(F.filter("cuts", lambda c: c < F.col("i")))
    rows = bins.crossJoin(F.broadcast(found)).select("bin", "k", group.cast("int").alias("shade_group"))  # one row of cuts
    shade = F.when(F.col("k") == 1, 0).otherwise(F.floor((6 * F.col("shade_group") + F.col("k") - 1) / (2 * (F.col("k") - 1))))
    return rows.select("bin", "shade_group", shade.cast("int").alias("shade"))


# ---- pixels ----


@query("rgba_words", f"with {bridge.TILE_PIXELS} select cell, p, r::bigint * 16777216 + g * 65536 + b * 256 + (r + g) % 256 as word from px")
def rgba_words(spark, d):
    return bridge.tile_pixels(spark, d).select("cell", "p", rgba_word(F.col("r"), F.col("g"), F.col("b"), (F.col("r") + F.col("g")) % 256).alias("word"))


def rgba_word(r: Column, g: Column, b: Column, a: Column) -> Column:
    """A colour as an unsigned 32-bit number."""
    return F.shiftleft(r.cast("long"), 24) + F.shiftleft(g, 16) + F.shiftleft(b, 8) + a


def training_pixels(pixels: DataFrame, mode: str, key: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Pixels that train palettes: ``opaque`` ones, those unlike the ``key`` colour, or ``all``."""
    if mode == "opaque":
        return pixels.where("a = 255")
    if mode == "key":
        r, g, b = key
        return pixels.where(~((F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b)))
    if mode != "all":
        raise ValueError(f"no mode {mode}")
    return pixels


_TRAIN = "select image_id, '{0}' as mode, count(*)::bigint as pixels, sum(r + g + b)::bigint as total from t {1} group by image_id"


@query("training_filter", f"with {bridge.TILE_PIXELS}, t as (select *, case when (r + g) % 4 = 0 then 254 else 255 end as a from px) " + " union all ".join(_TRAIN.format(m, w) for m, w in (("all", ""), ("opaque", "where a = 255"), ("key", "where not (r = 127 and g = 127 and b = 127)"))))
def training_filter(spark, d):
    px = bridge.tile_pixels(spark, d).withColumn("a", F.when((F.col("r") + F.col("g")) % 4 == 0, 254).otherwise(255))
    parts = [training_pixels(px, m, (127, 127, 127)).groupBy("image_id").agg(F.lit(m).alias("mode"), F.count("*").alias("pixels"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("total")) for m in ("all", "opaque", "key")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tileset_sheet", f"with {bridge.MOSAIC}, {_IDS} select (tile % 16 * 8 + x)::int as x, (tile // 16 * 8 + y)::int as y, v from ids join mos on mos.cell = ids.first_cell")
def tileset_sheet(spark, d):
    """The stored tiles as an image of 16 tiles a row."""
    rows = mosaic(spark, d)
    stored = tile_ops.first_seen_ids(rows).select("tile", F.col("first_cell").alias("cell")).join(rows.select("cell", F.col("tile").alias("pattern")), "cell")
    p = stored.select("tile", F.posexplode("pattern").alias("p", "v"))
    return p.select((F.col("tile") % 16 * 8 + F.col("p") % 8).cast("int").alias("x"), (F.floor(F.col("tile") / 16) * 8 + F.floor(F.col("p") / 8)).cast("int").alias("y"), "v")


# ---- options, names, references, draws ----


def clamped_option(text: Column, low: int, high: int, default: int) -> Column:
    """The whole number at the start of a text, or ``default`` without one, within [low, high]."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    value = F.when(number == "", float(default)).otherwise(number.cast("double"))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)).cast("long")


def clamped_decimal(text: Column, low: float, high: float, default: float) -> Column:
    """The decimal number at the start of a text, or ``default`` without one, within [low, high], with two places."""
    number = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    value = F.when(number == "", float(default)).otherwise(number.cast("double"))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)).cast("decimal(12,2)")


def at_least_one(text: Column, default: int) -> Column:
    """A whole text's number without its fraction, ``default`` where it is none or zero, and one where it is below."""
    number = F.floor(text.try_cast("double"))
    return F.greatest(F.lit(1).cast("long"), F.coalesce(F.nullif(number, F.lit(0).cast("long")), F.lit(default).cast("long")))


_DECIMAL = "case p_partkey % 4 when 0 then 'x1' when 1 then ' ' || (p_size / 16.0)::decimal(9,4) || 'px' when 2 then '-' || p_size || '.7' else '.' || (p_size % 100) end"


@query("option_decimals", f"select p_partkey as id, greatest(0.0, least(1.5, coalesce(try_cast(regexp_extract({_DECIMAL}, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))', 1) as double), 0.5)))::decimal(12,2) as value, greatest(1, coalesce(nullif(floor(try_cast({_DECIMAL} as double))::bigint, 0), 8))::bigint as rule from part")
def option_decimals(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, "x1").when(k % 4 == 1, F.concat(F.lit(" "), (size / 16.0).cast("decimal(9,4)").cast("string"), F.lit("px"))).when(k % 4 == 2, F.concat(F.lit("-"), size.cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit("."), (size % 100).cast("string")))
    return bridge.read(spark, d, "part").select(k.alias("id"), clamped_decimal(text, 0, 1.5, 0.5).alias("value"), at_least_one(text, 8).alias("rule"))


_OPTION = "case p_partkey % 4 when 0 then 'none' when 1 then ' ' || p_size || 'px' when 2 then '-' || p_size || '.7' else p_partkey::varchar end"


@query("option_clamps", f"select p_partkey as id, greatest(1, least(30, coalesce(try_cast(regexp_extract({_OPTION}, '^\\s*([+-]?[0-9]+)', 1) as bigint), 8)))::bigint as value from part")
def option_clamps(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, "none").when(k % 4 == 1, F.concat(F.lit(" "), size, F.lit("px"))).when(k % 4 == 2, F.concat(F.lit("-"), size, F.lit(".7"))).otherwise(k.cast("string"))
    return bridge.read(spark, d, "part").select(k.alias("id"), clamped_option(text, 1, 30, 8).alias("value"))


def export_name(source: Column, space: Column, edge: Column, palettes: Column, colors: Column, zero: Column) -> Column:
    """``source`` with the settings of its conversion, as a PNG's file name."""
    mark = F.when(space == "megadrive", "-MD").when(space == "nes", "-NES").otherwise("")
    return F.concat(source, mark, F.lit("-"), edge, F.lit("x"), edge, F.lit("-"), palettes, F.lit("p"), colors, F.lit("c-"), zero, F.lit(".png"))


def layer_name(map_name: Column, layer: Column, layers: Column) -> Column:
    """A map's name, with its layer's where it has several; what is no word sign or hyphen becomes one underscore."""
    return F.when(layers > 1, F.concat(map_name, F.lit("_"), F.regexp_replace(layer, r"[^\w-]+", "_"))).otherwise(map_name)


@query(
    "export_names",
    """with o as (select p_partkey as id, p_name, p_brand, case p_partkey % 3 when 0 then 'megadrive' when 1 then 'nes' else 'rgb' end as sp, p_size % 16 + 1 as pals, p_partkey % 32 + 1 as cols from part)
    select id, p_brand || case sp when 'megadrive' then '-MD' when 'nes' then '-NES' else '' end || '-8x8-' || pals || 'p' || cols || 'c-u.png' as file, case when id % 2 = 0 then p_brand || '_' || regexp_replace(p_name, '[^\\w-]+', '_', 'g') else p_brand end as layer_file, case when pals * cols > 256 then 'rgb' else 'indexed' end as format from o""",
)
def export_names(spark, d):
    """File names of conversions and layers; over 256 palette entries make a true-colour file."""
    k = F.col("p_partkey")
    rows = bridge.read(spark, d, "part").select(k.alias("id"), "p_name", "p_brand", F.when(k % 3 == 0, "megadrive").when(k % 3 == 1, "nes").otherwise("rgb").alias("space"), (F.col("p_size") % 16 + 1).alias("pals"), (k % 32 + 1).alias("cols"))
    file = export_name(F.col("p_brand"), F.col("space"), F.lit("8"), F.col("pals").cast("string"), F.col("cols").cast("string"), F.lit("u"))
    return rows.select("id", file.alias("file"), layer_name(F.col("p_brand"), F.col("p_name"), 2 - F.col("id") % 2).alias("layer_file"), F.when(F.col("pals") * F.col("cols") > 256, "rgb").otherwise("indexed").alias("format"))


def base_key(path: Column) -> Column:
    """What stands behind the last slash or backslash, in lower case."""
    return F.lower(F.element_at(F.split(path, r"[\\/]"), -1))


def resolved(references: DataFrame, files: DataFrame) -> DataFrame:
    """``references`` (ref_id, source) with the ``file`` (path) of the same base name, the first by path; null where none is there."""
    named = files.groupBy(base_key(F.col("path")).alias("name")).agg(F.min("path").alias("file"))
    return references.withColumn("name", base_key(F.col("source"))).join(named, "name", "left").select("ref_id", "source", "file", F.when(F.col("file").isNull(), "missing-file").alias("code"))


@query(
    "file_references",
    r"""with r as (select l_orderkey * 10 + l_linenumber as ref_id, '..\Maps/Set' || l_suppkey || '.TSX' as source from lineitem), f as (select 'dir/' || s_nationkey || '/set' || s_suppkey || '.tsx' as path from supplier where s_suppkey % 7 <> 3),
    n as (select lower(regexp_extract(path, '[^\\/]*$')) as name, min(path) as file from f group by 1)
    select ref_id, source, file, case when file is null then 'missing-file' end as code from r left join n on n.name = lower(regexp_extract(source, '[^\\/]*$'))""",
)
def file_references(spark, d):
    refs = bridge.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.concat(F.lit("..\\Maps/Set"), F.col("l_suppkey").cast("string"), F.lit(".TSX")).alias("source"))
    files = bridge.read(spark, d, "supplier").where("s_suppkey % 7 <> 3").select(F.concat(F.lit("dir/"), F.col("s_nationkey").cast("string"), F.lit("/set"), F.col("s_suppkey").cast("string"), F.lit(".tsx")).alias("path"))
    return resolved(refs, files)


_M = 1 << 32


@query(
    "seeded_draws",
    f"""with s as (select o_orderkey as n, ((o_custkey + (o_orderkey::hugeint + 1) * 1831565813) % {_M})::bigint as a from orders),
    t as (select n, a, ((xor(a, a >> 15)::hugeint * (a | 1)) % {_M})::bigint as t from s),
    u as (select n, xor(((t + (xor(t, t >> 7)::hugeint * (t | 61)) % {_M}) % {_M})::bigint, t) as t from t)
    select n, xor(t, t >> 14)::double / {_M}::double as value from u""",
)
def seeded_draws(spark, d):
    """Draw ``n`` of a seed's sequence, for each order; any draw is found by itself."""
    return bridge.read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), draws.draw(F.col("o_custkey"), F.col("o_orderkey")).alias("value"))


@query(
    "status_counts",
    f"with fl as ({_FLIPS}), e as (with {_ENTRIES} select max(entry) as top from ent) select count(*)::bigint as cells, (max(tile_id) + 1)::bigint as tiles, count(*) filter (flags & 1 = 1)::bigint as flipped_h, count(*) filter (flags & 2 = 2)::bigint as flipped_v, (select top from e)::int as top_entry from fl",
)
def status_counts(spark, d):
    """What a status line tells: cells, stored tiles, flips and the highest entry used."""
    found = tile_ops.with_flipped_ids(mosaic(spark, d))
    flag = lambda bit: F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) == bit)
    counts = found.agg(F.count("*").alias("cells"), (F.max("tile_id") + 1).alias("tiles"), flag(1).alias("flipped_h"), flag(2).alias("flipped_v"))
    top = mosaic(spark, d).agg(F.max(F.array_max("tile") + F.col("p_size") % 8 * 4).cast("int").alias("top_entry"))
    return counts.crossJoin(top)  # one row each


@query(
    "status_marks",
    f"""with {_ENTRIES}, b as (select (cell // 20) // 2 * 10 + cell % 20 // 2 as block, count(distinct entry >> 2) as groups from ent group by 1),
    m as (select cell, any_value(p_size) as p_size from ent group by cell)
    select (select count(*) from m where p_size % 7 = 0)::bigint as kept, (select count(*) from m where p_size % 5 = 0)::bigint as priority, (select count(*) from b where groups > 1)::bigint as mixed""",
)
def status_marks(spark, d):
    """Marks that a status line counts: cells kept, cells with priority, and blocks that mix palettes."""
    ent = entries(spark, d)
    cells = ent.where("p = 0").agg(F.count_if(F.col("p_size") % 7 == 0).alias("kept"), F.count_if(F.col("p_size") % 5 == 0).alias("priority"))
    block = F.floor(F.floor(F.col("cell") / 20) / 2) * 10 + F.floor((F.col("cell") % 20) / 2)
    groups = ent.groupBy(block.alias("block")).agg(F.count_distinct(F.shiftright("entry", 2)).alias("groups"))
    return cells.crossJoin(groups.agg(F.count_if(F.col("groups") > 1).alias("mixed")))  # one row each


# ---- byte streams ----


@query(
    "rle_nes_tokens",
    _RUNS.format(cap=255)
    + """, u as (select stream, v, count(*) as n from bytes group by all), w as (select s.stream, s.v, coalesce(u.n, 0) as n from (select distinct stream, unnest(range(256)) as v from bytes) s left join u on u.stream = s.stream and u.v = s.v),
    tag as (select stream, arg_min(v, n * 1000 + v) as tag from w group by stream),
    h as (select stream, start, n, tag, lpad(lower(to_hex(v)), 2, '0') || case when v = tag then '01' else '' end as lit, lpad(lower(to_hex(tag)), 2, '0') as th from runs join tag using (stream))
    select stream, start::bigint as start, lit || case when n = 2 then lit when n > 2 then th || lpad(lower(to_hex(n - 1)), 2, '0') else '' end as bytes from h
    union all select stream, -1, lpad(lower(to_hex(tag)), 2, '0') from tag
    union all select stream, max(start + n), max(th) || '00' from h group by stream""",
)
def rle_nes_tokens(spark, d):
    return stream_ops.tagged_tokens(bridge.streams(spark, d))


def _packed(codec: str):
    def run(spark, d):
        listed = bridge.streams(spark, d).groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
        raw = listed.select("stream", F.unhex(F.array_join(F.transform("v", lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("raw"))
        return raw.select("stream", F.lower(F.hex("raw")).alias("raw"), F.lower(F.hex(codecs.encode_column(F.col("raw"), codec))).alias("packed"))

    return run


query("lz_gb_streams")(_packed("gb"))
query("zx0_streams")(_packed("zx0"))
