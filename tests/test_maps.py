"""Maps with their files: references, tilesets, images, flips, diagnostics."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefold.sources import maps as m
from tilefold.sources import png

H, V, D = 0x80000000, 0x40000000, 0x20000000


def tileset_png(palette=b"\x00\x00\x00\xff\xff\xff", spacing=0):
    """Two tiles of 8x8: pixel values 0-63 and 64-127; with spacing, a margin of 3 and gaps."""
    rows = np.zeros((8 + 6 * bool(spacing), 16 + (6 + spacing) * bool(spacing)), np.uint8)
    top = 3 * bool(spacing)
    for t in range(2):
        left = top + t * (8 + spacing)
        rows[top : top + 8, left : left + 8] = np.arange(64).reshape(8, 8) + 64 * t
    full = palette + bytes(3 * 128 - len(palette))
    return png.encode(png.IndexedImage(rows.shape[1], rows.shape[0], full, None, rows))


INLINE = [{"firstgid": 1, "image": "art\\Tiles.PNG", "tilewidth": 8, "tileheight": 8, "columns": 2, "tilecount": 2}]


def tmj(layers, tilesets=INLINE, **more):
    return json.dumps({"width": 2, "height": 2, "tilewidth": 8, "tileheight": 8, "tilesets": tilesets, "layers": layers} | more).encode()


def layer(*gids, name="BG"):
    return {"type": "tilelayer", "name": name, "data": list(gids)}


def load(spark, map_, *others, name="map.tmj", image=None):
    rows = [("b", f"x/{name}", map_), ("b", "y/tiles.png", image or tileset_png()), ("b", "x/readme.txt", b"?"), *[("b", p, c) for p, c in others]]
    return m.load(spark.createDataFrame(rows, "bundle string, path string, content binary"))


def pixels(loaded, nth=0):
    cells = {r.cell: r for r in m.flatten(loaded)[0].where(f"nth = {nth}").collect()}
    out = np.zeros((16, 16), int)
    for c, r in cells.items():
        out[c // 2 * 8 : c // 2 * 8 + 8, c % 2 * 8 : c % 2 * 8 + 8] = np.array(r.pixels).reshape(8, 8)
    return out


def codes(loaded):
    assert loaded["maps"].count() == 0 and loaded["layers"].count() == 0
    return [(r.code, r.detail) for r in loaded["diagnostics"].collect()]


def test_flips(spark):
    at = pixels(load(spark, tmj([layer(1, 2 | H, 1 | V, 1 | D)])))
    assert at[2, 3] == 2 * 8 + 3 and at[2, 8 + 3] == 64 + 2 * 8 + 4 and at[8 + 2, 3] == 5 * 8 + 3 and at[8 + 2, 8 + 3] == 3 * 8 + 2
    turned = pixels(load(spark, tmj([layer(1 | H | D, 1 | V | D, 1 | H | V, 1 | H | V | D)])))
    tile = np.arange(64).reshape(8, 8)
    for cell, flags in enumerate((H | D, V | D, H | V, H | V | D)):
        expected = [[(lambda u, v: tile[(u, v) if flags & D else (v, u)])(7 - x if flags & H else x, 7 - y if flags & V else y) for x in range(8)] for y in range(8)]
        assert (turned[cell // 2 * 8 :, cell % 2 * 8 :][:8, :8] == expected).all()


def test_base64_groups_and_empty_cells(spark):
    data = base64.b64encode(zlib.compress(struct.pack("<4I", 2, 0, 0, 1))).decode()
    inner = {"type": "tilelayer", "name": "BG", "encoding": "base64", "compression": "zlib", "data": data}
    loaded = load(spark, tmj([{"type": "group", "name": "World", "layers": [inner]}, layer(0, 0, 0, 0, name="Top")]))
    assert [(r.layer, r.gids) for r in loaded["layers"].orderBy("nth").collect()] == [("World/BG", [2, 0, 0, 1]), ("Top", [0, 0, 0, 0])]
    at = pixels(loaded)
    assert at[0, 0] == 64 and at[8, 8] == 0 and at[15, 15] == 63 and not at[:8, 8:].any() and not pixels(loaded, 1).any()


def test_external_tilesets(spark):
    refs = [{"firstgid": 1, "source": "sets/Tiles.tsj"}]
    tsj = json.dumps({k: v for k, v in INLINE[0].items() if k != "firstgid"}).encode()
    assert pixels(load(spark, tmj([layer(2, 0, 0, 0)], refs), ("z/tiles.tsj", tsj)))[0, 0] == 64
    assert codes(load(spark, tmj([layer(2, 0, 0, 0)], refs))) == [("missing-file", "Tiles.tsj")]
    tsx = b'<tileset tilewidth="8" tileheight="8" margin="3" spacing="2"><image source="tiles.png"/></tileset>'
    xml = b'<map width="2" height="2" tilewidth="8" tileheight="8"><tileset firstgid="5" source="t.tsx"/><layer name="L"><data encoding="csv">5,6,\n0,5</data></layer></map>'
    at = pixels(load(spark, xml, ("z/t.tsx", tsx), name="map.tmx", image=tileset_png(spacing=2)))
    assert at[0, 0] == 0 and at[0, 8] == 64 and at[15, 15] == 63


@pytest.mark.parametrize(
    "tilesets,more,expected",
    [
        ([INLINE[0] | {"tilewidth": 16, "tileheight": 16}], {}, [("tile-size", "16x16")]),
        ([INLINE[0] | {"image": None}], {}, [("image-collection", None)]),
        ([INLINE[0] | {"image": "other.png"}], {}, [("missing-file", "other.png")]),
        ([], {}, [("no-tilesets", None)]),
        (INLINE, {"infinite": True}, [("unreadable", "infinite maps are not read")]),
        ([INLINE[0], INLINE[0] | {"firstgid": 3, "image": "second.png"}], {}, [("palette", None)]),
        ([INLINE[0] | {"image": "bad.png"}], {}, None),
    ],
)
def test_diagnostics(spark, tilesets, more, expected):
    found = codes(load(spark, tmj([layer(1, 0, 0, 0)], tilesets, **more), ("q/second.png", tileset_png(b"\x01\x02\x03")), ("q/bad.png", b"no image")))
    assert found == expected if expected is not None else [c for c, _ in found] == ["unreadable"]


def test_outside(spark):
    """Ids below the first tileset, beyond the image, and flags above the id's bits."""
    loaded = load(spark, tmj([layer(1, 5, 9, 6 | 0x10000000)], [INLINE[0] | {"firstgid": 5}]))
    cells, outside = m.flatten(loaded)
    assert [(r.cell, r.state, r.pixels and r.pixels[0]) for r in cells.orderBy("cell").collect()] == [(0, "outside", None), (1, "tile", 0), (2, "outside", None), (3, "tile", 64)]
    assert sorted((r.gid, r.cells) for r in outside.collect()) == [(1, 1), (9, 1)]


def test_many_bundles(spark):
    """A map only sees the files of its own bundle; an empty table gives empty relations."""
    rows = [(b, p, c) for b in ("one", "two") for p, c in (("m.tmj", tmj([layer(2, 1, 0, 0)])), ("tiles.png", tileset_png()))] + [("three", "three.tmj", tmj([layer(1, 1, 1, 1)]))]
    files = spark.createDataFrame([(b, f"{b}/{p}", c) for b, p, c in rows], "bundle string, path string, content binary")
    loaded = m.load(files)
    assert [(r.path, r.code) for r in loaded["diagnostics"].collect()] == [("three/three.tmj", "missing-file")]
    assert m.flatten(loaded)[0].count() == 8
    none = m.load(files.limit(0))
    assert all(x.count() == 0 for x in none.values()) and all(x.count() == 0 for x in m.flatten(none))


def test_main_files_and_chosen_layers(spark):
    rows = [("a", "a/x.png"), ("a", "a/Z.TMJ"), ("a", "a/q.tmx"), ("b", "b/z.png"), ("b", "b/a.png"), ("b", "b/0.txt"), ("c", "c/n.txt")]
    files = spark.createDataFrame([(b, p, b"") for b, p in rows], "bundle string, path string, content binary")
    assert sorted(map(tuple, m.main_files(files).collect())) == [("a", "a/Z.TMJ", "map"), ("b", "b/a.png", "image"), ("c", "c/n.txt", "other")]
    layers = spark.createDataFrame([("one", 0, "L", [1]), ("two", 0, "A", [2]), ("two", 1, "B", [3]), ("two", 2, "B", [4])], "path string, nth int, layer string, gids array<bigint>")
    names = spark.createDataFrame([("two", "B"), ("one", "other")], "path string, layer string")
    assert sorted((r.path, r.nth) for r in m.chosen_layers(layers, names).collect()) == [("one", 0), ("two", 1)]
    assert [(r.path, r.nth) for r in m.chosen_layers(layers).collect()] == [("one", 0)]


def test_tilesets_in_stretches(spark, monkeypatch):
    """Tilesets of any number, met stretch by stretch and not gathered by map, broadcast or not."""
    monkeypatch.setattr(m, "STRETCH", 8)
    firsts = {"a": [3, 4, 11, 40, 41], "b": [1]}
    raws = [None, 0, 1, 2, 3, 5, 8, 10, 11, 12, 39, 40, 41, 90, 40 | 1 << 31, 41 | 7 << 29, 5 | 1 << 29]
    cells = spark.createDataFrame([(p, i, r) for p in ("a", "b", "c", None) for i, r in enumerate(raws * 2)], "path string, cell int, raw long")
    sets = spark.createDataFrame([(p, f) for p, all_ in firsts.items() for f in all_ + all_[:1]], "path string, firstgid long")
    tiles = spark.createDataFrame([(p, f, i, [f, i, 2, 3]) for p, all_ in firsts.items() for f in all_ for i in range(3)], "path string, firstgid long, id long, pixels array<int>")
    for limit in (m.BROADCAST_BYTES, 0):
        monkeypatch.setattr(m, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(m.tile_ops, "BROADCAST_BYTES", limit)
        rows = m.drawn(m.tiles_as_of(cells, sets), tiles, F.lit(2), F.lit(2)).collect()
        assert len(rows) == cells.count()
        for r in rows:
            gid = None if r.raw is None else r.raw & (1 << 28) - 1
            first = max((f for f in firsts.get(r.path, []) if gid and f <= gid), default=None)
            assert (r.gid, r.firstgid, r.id) == (gid, first, None if first is None else gid - first)
            if first is None or gid - first > 2:
                assert (r.state, r.pixels) == (("empty", [0] * 4) if gid == 0 else ("outside", None))
                continue
            t, turned = [first, gid - first, 2, 3], []
            for y in range(2):
                for x in range(2):
                    u, v = 1 - x if r.raw >> 31 & 1 else x, 1 - y if r.raw >> 30 & 1 else y
                    turned.append(t[u * 2 + v] if r.raw >> 29 & 1 else t[v * 2 + u])
            assert (r.state, r.pixels) == ("tile", turned)
