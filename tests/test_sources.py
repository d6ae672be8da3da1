import base64
import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from tilefold.sources import png, text, tiled


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + bytes(4)  # checksums are not looked at


def test_paeth_of_two_bits():
    raw = bytes([0, 0b00011011, 0b01000000, 4, 0b11100100 & 0xFF, 0])
    first = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 2, 2, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(12))
    image = png.decode(first + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    assert image.indexes[0].tolist() == [0, 1, 2, 3, 1]


def test_every_filter():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (5, 9)).astype(np.uint8)
    lines, above = b"", np.zeros(9, np.int64)
    for y, row in enumerate(pixels.astype(np.int64)):
        left, corner = np.append(0, row[:-1]), np.append(0, above[:-1])
        base = left + above - corner
        near = np.select([(abs(base - left) <= abs(base - above)) & (abs(base - left) <= abs(base - corner)), abs(base - above) <= abs(base - corner)], [left, above], corner)
        guess = [0 * row, left, above, (left + above) // 2, near][y]
        lines += bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 5, 8, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(768)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (png.decode(data).indexes == pixels).all()


def test_png_files(spark, tmp_path):
    image = png.IndexedImage(3, 2, bytes([1, 2, 3, 4, 5, 6]), bytes([0]), np.array([[0, 1, 1], [1, 0, 5]], np.uint8))
    (tmp_path / "a.png").write_bytes(png.encode(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = png.read(spark, str(tmp_path)).orderBy("path").collect()
    assert rows[0].error is None and rows[1].error is not None
    px = png.pixels(png.read(spark, str(tmp_path))).orderBy("y", "x").collect()
    assert [(r.idx, r.r, r.g, r.b, r.a) for r in px][:2] == [(0, 1, 2, 3, 0), (1, 4, 5, 6, 255)]
    assert (px[-1].idx, px[-1].r, px[-1].a) == (5, 0, 255)
    with pytest.raises(ValueError):
        png.encode(png.IndexedImage(1, 1, b"", None, np.zeros((1, 1), np.uint8)))


GIDS = [1, 2, 0, 0x80000001]
WORDS = struct.pack("<4I", *GIDS)


@pytest.mark.parametrize(
    ("data", "extra"),
    [
        (GIDS, {}),
        (base64.b64encode(WORDS).decode(), {"encoding": "base64"}),
        (base64.b64encode(zlib.compress(WORDS)).decode(), {"encoding": "base64", "compression": "zlib"}),
        (base64.b64encode(gzip.compress(WORDS)).decode(), {"encoding": "base64", "compression": "gzip"}),
    ],
)
def test_json_maps(data, extra):
    doc = {"width": 2, "height": 2, "tilewidth": 8, "tileheight": 8, "tilesets": [{"firstgid": 5}, {"firstgid": 1}]}
    doc["layers"] = [{"type": "group", "name": "g", "layers": [{"type": "tilelayer", "name": "x", "data": data, **extra}]}]
    m = tiled.parse(json.dumps(doc).encode())
    assert m.layers == [("g/x", GIDS)] and [t["firstgid"] for t in m.tilesets] == [1, 5]


def test_xml_maps(spark):
    xml = '<map width="2" height="2" tilewidth="8" tileheight="8"><tileset firstgid="1"><image source="A\\b.PNG"/></tileset><group name="g"><layer name="l"><data encoding="csv">1, 2,\n0,2147483649</data></layer></group></map>'
    files = spark.createDataFrame([("m", bytearray(xml.encode())), ("bad", bytearray(b"<map"))], "path string, content binary")
    rows = {r.path: r for r in tiled.layers(files).collect()}
    assert rows["m"].layer == "g/l" and rows["m"].gids == GIDS and rows["bad"].error
    assert tiled.base_name(tiled.tilesets(files).first().image) == "b.png"


def test_bad_maps():
    with pytest.raises(ValueError):
        tiled.decode_gids([1], 2)
    with pytest.raises(ValueError):
        tiled.decode_gids("AAAA", 1, "base64", "zstd")
    with pytest.raises(ValueError):
        tiled.parse(b'{"infinite": true}')


def test_text_outputs():
    data, width, height = text.pack_nes([3] * 9, 3, 3)
    assert (data.hex(), width, height) == ("ff330f03", 2, 2)
    assert text.pack_mmc5([0, 1, 2, 3]).hex() == "004080c0"
    assert text.pack_gbc([1, 7], [0, 1]).hex() == "0187"
    assert text.label_of("1 map.tmx") == "_1_map_tmx_attr"
    assert "\t.byte $ff,$33\n\t.byte $0f,$03\n" in text.nes_text(data, 2, 2, "asm-byte", "l", "f")
    assert text.nes_text(data, 2, 2, "c", "l", "f").endswith("const unsigned char l[4]={\n\t0xff,0x33,\n\t0x0f,0x03\n};\n")
    for kind in ("c", "c-rle", "c-gb", "c-zx0", "asm-gbdk", "asm-rgbds"):
        assert "l" in text.gbc_text(data, 2, kind, "l", "f")
    with pytest.raises(ValueError):
        text.gbc_text(data, 2, "x", "l", "f")


def test_text_lines(spark):
    """Every line of the formats, as the consoles' tools read them."""
    about, declare = "4 GBC BG attributes (2x2 tiles), from f", "Declare it where it's used: extern const unsigned char"
    data = bytes([0, 1, 2, 255])
    assert text.gbc_text(data, 2, "asm-gbdk", "l", "f") == f"; {about}\n; Declare it in C: extern const unsigned char l[4];\n\t.module l\n\t.area _CODE\n_l::\n\t.db 0x00,0x01\n\t.db 0x02,0xff\n"
    assert text.gbc_text(data, 2, "asm-rgbds", "l", "f") == f"; {about}\nl:\n\tdb $00,$01\n\tdb $02,$ff\n"
    assert text.gbc_text(data, 2, "c", "l", "f") == f"// {about}\n// {declare} l[4];\nconst unsigned char l[4]={{\n\t0x00,0x01,\n\t0x02,0xff\n}};\n"
    packed = text.gbc_text(bytes(40), 4, "c-rle", "l", "f").split("\n")
    assert packed[:4] == ["// 40 GBC BG attributes (4x10 tiles), GBDK RLE packed to 3, from f", "// Unpack with rle_init() then rle_decompress() (gbdk/rledecompress.h)", f"// {declare} l_rle[3];", "const unsigned char l_rle[3]={"]
    nes = text.nes_text(bytes(4), 2, 2, "c-rle", "l", "f").split("\n")
    assert nes[0].startswith("// 4 attribute bytes (2x2), NESlib RLE packed to ") and nes[1].startswith(f"// {declare} l_rle[")
    rows = spark.createDataFrame([("l", "f", 2, bytearray(data))], "label string, source string, width int, data binary")
    assert text.text_files(rows, text.GBC_FORMATS["asm-rgbds"], "bytes").first().text == "; 4 bytes, from f\nl:\n\tdb $00,$01\n\tdb $02,$ff\n"


def test_edit_stream(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from tilefold.streaming.edits import latest_edits

    source = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("block"), (F.col("event_id") % 4).alias("row"))
    source.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    job = latest_edits(stream).writeStream.outputMode("complete").format("memory").queryName("edits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(spark.table("edits").collect()) == sorted(latest_edits(source).collect())
