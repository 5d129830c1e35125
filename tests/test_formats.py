"""Codecs: round trips, hand-made bytes, refusals, and the Spark readers over real files."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import containers, mvt, png, readers, sinks, tiff

GT = [8.0, 0.25, 0.0, 50.0, 0.0, -0.25]


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16, np.int16])
@pytest.mark.parametrize("big", [True, False])
def test_tiff_round_trip(dtype, big):
    a = np.random.default_rng(1).integers(0, 200, (50, 70)).astype(dtype)
    a[16:32, 16:32] = 0
    raw = tiff.write_tiled(a, 16, GT, "0", (a[::4, ::4],), big=big, scale=(0.5, -150.0))
    h = tiff.read_header(raw)
    assert h.size == (70, 50) and h.overviews == 1 and h.geotransform == GT and h.text(42113) == "0"
    np.testing.assert_array_equal(tiff.read_window(raw, h, 0, 0, 70, 50), a)
    np.testing.assert_array_equal(tiff.read_window(raw, h, 13, 7, 20, 30), a[7:37, 13:33])


def lzw_encode(data):
    out, bits, table, width = 0, 0, {bytes([i]): i for i in range(256)}, 9
    codes = []

    def put(code):
        codes.append((code, width))

    put(256)
    size, cur = 258, b""
    for b in data:
        nxt = cur + bytes([b])
        if nxt in table:
            cur = nxt
            continue
        put(table[cur])
        table[nxt] = size
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
        if size > 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        cur = bytes([b])
    if cur:
        put(table[cur])
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
    put(257)
    for c, w in codes:
        out, bits = (out << w) | c, bits + w
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def test_lzw_and_packbits():
    assert tiff.lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80])) == bytes([0xAA] * 3 + [0x80, 0, 0x2A] + [0xAA] * 4)


def test_lzw_of_long_data():
    rng = np.random.default_rng(8)
    for data in (rng.integers(0, 4, 40000).astype(np.uint8).tobytes(), rng.integers(0, 256, 9000).astype(np.uint8).tobytes(), b"a" * 5000):
        assert tiff.lzw_decode(lzw_encode(data)) == data


def test_predictors():
    row = np.array([[1, 255, 2, 0]], np.uint8)
    np.testing.assert_array_equal(tiff.undo_predictor(row, 2), [[1, 0, 2, 2]])
    a = np.array([[1.5, -2.25, 1e9], [0.0, 3.0, -7.5]], np.float32)
    planes = np.ascontiguousarray(a.astype(">f4").view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1)).reshape(2, 12)
    raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    np.testing.assert_array_equal(tiff.undo_float_predictor(raw, 3, 2, 4), a)


@pytest.mark.parametrize("raw", [b"", b"II", b"II*\0\xff\xff\xff\xff", b"PK\3\4aaaaaaa", b"MM\0\x2a\0\0\0\x08\0\x01"])
def test_bad_tiff_is_refused(raw):
    with pytest.raises(tiff.TiffError):
        tiff.read_header(raw)
    assert readers.header_facts(raw)["ok"] is False


def test_unsupported_codec_is_named():
    with pytest.raises(tiff.TiffError, match="webp"):
        tiff.inflate(b"", 50001)


@pytest.mark.parametrize("bits", [1, 8, 16])
def test_coverage_round_trip(bits):
    a = np.random.default_rng(2).integers(0, {1: 2, 8: 256, 16: 60000}[bits], (40, 50)).astype(np.uint16 if bits == 16 else np.uint8)
    a[:16, :16] = 0
    raw = containers.write_coverage(a, 16, bits)
    side = json.dumps({"dimensions": {"width": 50, "height": 40}, "geotransform": GT, "tile_size": 16, "output_format": {1: "1BIT_LOS", 8: "8BIT", 16: "16BIT"}[bits]})
    c = containers.read_coverage(raw, side)
    assert (0, 0) not in c.index
    got = c.window(0, 0, 50, 40)
    if bits == 16:
        got = np.where(got == 0xFFFF, 0, got)
    np.testing.assert_array_equal(got, a)
    with pytest.raises(containers.FormatError):
        containers.read_coverage(raw[:-1], side)


def test_flat_one_bit_rows_are_padded():
    a = np.random.default_rng(3).integers(0, 2, (5, 40)).astype(np.uint8)
    padded = np.zeros((5, 64), np.uint8)
    padded[:, :40] = a
    np.testing.assert_array_equal(containers.flat_rows(np.packbits(padded, axis=1).tobytes(), 40, 5, 1), a)


def test_elevation_round_trip_and_refusals():
    a = np.arange(-50, 50, dtype=np.int16).reshape(10, 10)
    a[0, 0] = -9999
    raw = containers.write_elevation(a, 47.5, 8.0, 0.001)
    t = containers.read_elevation(raw)
    assert len(raw) == 44 + 256 * 10 and t.base == -49 and t.pixel_deg == 0.001
    np.testing.assert_array_equal(t.cells, a)
    assert containers.read_elevation(raw[:24] + struct.pack("<dd", 0.5, 0.5) + raw[40:]).pixel_deg == 0.05
    for bad in (raw[:43], raw[:4] + b"\2\0" + raw[6:], raw[:-300], b"XXXX" + raw[4:]):
        with pytest.raises(containers.FormatError):
            containers.read_elevation(bad)


def test_visibility_round_trip():
    offsets, ids = np.concatenate([[0], np.cumsum([2, 0, 1, 3])]), [1, 2, 9, 4, 5, 6]
    meta, tiles = containers.read_visibility(containers.write_visibility({(1, 0): (offsets, ids)}, 2, 4, 2, GT))
    assert meta["master_width"] == 4
    np.testing.assert_array_equal(tiles[1, 0][0], offsets)
    np.testing.assert_array_equal(tiles[1, 0][1], ids)


def test_png_and_codes():
    rgb = np.random.default_rng(5).integers(0, 256, (8, 8, 3)).astype(np.uint8)
    np.testing.assert_array_equal(png.decode(png.encode(rgb)), rgb)
    assert png.metres(np.array([[[128, 0, 0]]], np.uint8), "terrarium")[0, 0] == 0
    with pytest.raises(png.PngError, match="WebP"):
        png.decode(b"RIFF....WEBP")


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    want = np.random.default_rng(6).integers(0, 256, (1, 12)).astype(np.int64)
    above = np.random.default_rng(7).integers(0, 256, 12).astype(np.int64)
    row = np.zeros(12, np.int64)
    for i in range(12):
        a, b, c = (want[0, i - 3], above[i], above[i - 3]) if i >= 3 else (0, above[i], 0)
        p = a + b - c
        guess = {1: a, 2: b, 3: (a + b) // 2, 4: a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c}[kind]
        row[i] = (want[0, i] - guess) % 256
    np.testing.assert_array_equal(png._unfilter(kind, row.astype(np.uint8), above.astype(np.uint8), 3), want[0].astype(np.uint8))


def test_vector_tile_buildings_and_forests():
    outer = [(0, 0), (100, 0), (100, 100), (0, 100)]
    hole = [(20, 20), (20, 40), (40, 40), (40, 20)]
    raw = mvt.encode_layer("building", [({"render_height": 12.5, "name": "a"}, [outer, hole]), ({}, [[(0, 0), (5, 0)]])])
    got = mvt.buildings(gzip.compress(raw), 14, 8500, 5700)
    assert len(got) == 1 and got[0][0]["render_height"] == [12.5] and len(got[0][2]) == 1
    west = 8500 / 2**14 * 360 - 180
    assert got[0][1][0][0] == pytest.approx(west)
    woods = mvt.encode_layer("landcover", [({"class": "wood"}, [outer]), ({"class": "grass"}, [outer])])
    assert [k for k, _ in mvt.forests(woods, 14, 1, 1)] == ["wood"]


def test_readers_over_files(spark, tmp_path):
    a = np.zeros((20, 20), np.uint8)
    a[3, 4] = 7
    (tmp_path / "a.bit").write_bytes(containers.write_coverage(a, 16, 8))
    (tmp_path / "a.json").write_text(json.dumps({"dimensions": {"width": 20, "height": 20}, "geotransform": GT, "tile_size": 16, "output_format": "8BIT"}))
    (tmp_path / "b.bit").write_bytes(b"broken")
    (tmp_path / "c.tif").write_bytes(tiff.write_tiled(a, 16, GT, "0"))
    (tmp_path / "d.abt").write_bytes(containers.write_elevation(np.full((4, 4), 9, np.int16), 1, 2, 0.001))
    cover = readers.coverage_cells(spark, str(tmp_path)).collect()
    assert [(r["x"], r["y"], r["v"]) for r in cover if r["error"] is None] == [(4, 3, 7)]
    assert sum(r["error"] is not None for r in cover) == 1
    assert [(r["x"], r["y"], r["v"]) for r in readers.tiff_cells(spark, str(tmp_path)).collect()] == [(4, 3, 7)]
    assert readers.elevation_cells(spark, str(tmp_path)).where("v = 9").count() == 16
    (tmp_path / "list.txt").write_text("﻿b\r\n\n# no\na\nb\n")
    assert [r["entry"] for r in readers.path_list(spark, str(tmp_path / "list.txt")).collect()] == ["b", "# no", "a", "b"]


def test_tiles_written_from_cells(spark):
    cells = spark.createDataFrame([(1, 47.5, 8.0, 2, 1, 33)], "tile int, ul_lat double, ul_lon double, x int, y int, v int")
    t = containers.read_elevation(bytes(sinks.elevation_tiles(cells, 4, 0.001).first()["payload"]))
    assert t.cells[1, 2] == 33 and (t.cells == -9999).sum() == 15
    ids = spark.createDataFrame([(0, 0, [1, 2]), (1, 1, [9])], "x long, y long, ids array<long>")
    v = sinks.visibility_tiles(ids, 2).first()
    assert v["offsets"] == [0, 2, 2, 2, 3] and v["ids"] == [1, 2, 9]


def test_buildings_as_rows_and_geojson(spark):
    raw = mvt.encode_layer("building", [({"height": "9 m"}, [[(0, 0), (10, 0), (10, 10)]])])
    tiles = spark.createDataFrame([(14, 8500, 5700, bytearray(raw)), (14, 1, 1, bytearray(b"\x1a\xff"))], "z int, x int, y int, content binary")
    got = readers.building_rows(tiles)
    assert got.where("error is not null").count() == 1
    r = got.where("error is null").select("tags", sinks.geojson_feature(F.col("ext"), F.lit(9.0)).alias("g")).first()
    assert r["tags"] == {"height": "9 m"} and len(json.loads(r["g"])["geometry"]["coordinates"][0]) == 4


@pytest.mark.parametrize("width", [0, 2, 16])
def test_flatgeobuf_round_trip_and_box(width):
    from gridloom.sources import flatgeobuf

    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [({"height": f"{i} m", "k": "v"}, square(float(i), float(i % 7), 0.5), [square(i + 0.1, i % 7 + 0.1, 0.1)] if i % 3 == 0 else [], 400.0 + i if i % 2 else None) for i in range(37)]
    raw = flatgeobuf.write(shapes, width)
    assert flatgeobuf.read(raw) == shapes
    box = (10.2, 0.0, 20.1, 4.0)
    inside = [s for s in shapes if s[1][0][0] <= box[2] and s[1][1][0] >= box[0] and s[1][0][1] <= box[3] and s[1][2][1] >= box[1]]
    assert flatgeobuf.read(raw, box) == inside and 0 < len(inside) < 37
    assert flatgeobuf.read(raw, (100, 100, 101, 101)) == []
    with pytest.raises(flatgeobuf.FormatError):
        flatgeobuf.read(b"GeoJSON!" + raw[8:])
    with pytest.raises(flatgeobuf.FormatError):
        flatgeobuf.read(raw[:-3])


def test_flatgeobuf_files_as_rows(spark, tmp_path):
    from gridloom.sources import flatgeobuf

    ring = [(8.0, 47.0), (8.1, 47.0), (8.1, 47.1)]
    (tmp_path / "a.fgb").write_bytes(flatgeobuf.write([({"levels": "3"}, ring, [], 512.5), ({}, [(x + 5, y) for x, y in ring], [], None)]))
    (tmp_path / "b.fgb").write_bytes(b"nothing")
    got = readers.flatgeobuf_rows(spark, str(tmp_path), (7.9, 46.9, 8.2, 47.2)).collect()
    good = [r for r in got if r["error"] is None]
    assert len(got) == 2 and len(good) == 1 and good[0]["top"] == 512.5 and good[0]["tags"] == {"levels": "3"} and len(good[0]["ext"]) == 3
