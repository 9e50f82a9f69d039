"""Geometry, tile messages, archives, metadata and the command line."""

import gzip
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilesieve import cli
from tilesieve.functions import geometry as G
from tilesieve.operators import tiles
from tilesieve.operators.metadata import apply_overrides
from tilesieve.plans import queries as Q
from tilesieve.sources import mvt, pmtiles

SF = "/root/testdata/sf0.001"
SQUARE = G.from_geojson({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]})


def geo(kind, coordinates):
    return G.from_geojson({"type": kind, "coordinates": coordinates})


@pytest.mark.parametrize(
    "other,hit",
    [
        (geo("Point", [1, 1]), True),
        (geo("Point", [0, 5]), True),
        (geo("Point", [5, 5]), False),
        (geo("Point", [4, 5]), True),
        (geo("MultiPoint", [[20, 20], [10, 10]]), True),
        (geo("MultiPoint", []), False),
        (geo("LineString", [[-5, 5], [15, 5]]), True),
        (geo("LineString", [[4.5, 4.5], [5.5, 5.5]]), False),
        (geo("LineString", [[1, 1], [2, 2]]), True),
        (geo("LineString", [[-5, 0], [-1, 20]]), False),
        (geo("MultiLineString", [[[20, 20], [30, 30]], [[10, -5], [10, 15]]]), True),
        (geo("Polygon", [[[-5, -5], [20, -5], [20, 20], [-5, 20], [-5, -5]]]), True),
        (geo("Polygon", [[[4.5, 4.5], [5.5, 4.5], [5.5, 5.5], [4.5, 4.5]]]), False),
        (geo("Polygon", [[[1, 1], [2, 1], [2, 2], [1, 1]]]), True),
        (geo("MultiPolygon", [[[[10, 10], [12, 10], [12, 12], [10, 10]]]]), True),
    ],
)
def test_intersections(other, hit):
    assert G.intersects(SQUARE, other) is hit and G.intersects(other, SQUARE) is hit


def test_box_index_equals_scan():
    rng = np.random.default_rng(3)
    boxes = [None if k % 9 == 0 else (*(a := rng.integers(0, 50, 2).tolist()), a[0] + k % 7, a[1] + k % 5) for k in range(300)]
    index = G.BoxIndex(boxes)
    for _ in range(100):
        x, y = rng.integers(0, 55, 2).tolist()
        q = (x, y, x + 4, y + 3)
        assert index.meeting(q) == [k for k, b in enumerate(boxes) if G.boxes_meet(b, q)]
    assert G.BoxIndex([]).meeting((0, 0, 1, 1)) == []


def test_projection_and_poles():
    g = G.to_tile(G.from_geojson(Q.WORLD), 3, 2, 5, 4096)
    assert np.isfinite(g.vertices()).all() and G.intersects(g, G.Geometry(points=np.array([[100.0, 100.0]])))
    w, s, e, n = G.tile_bounds(5, 20, 9)
    corners = G.to_tile(geo("MultiPoint", [[w, n], [e, s]]), 5, 20, 9, 4096).points
    assert corners == pytest.approx(np.array([[0, 0], [4096, 4096]]), abs=1e-6)


def test_tile_ids():
    assert [pmtiles.tile_id(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (12, 3423, 1763))] == [0, 1, 2, 3, 4, 19078479]
    for i in range(1400):
        assert pmtiles.tile_id(*pmtiles.tile_zxy(i)) == i


def test_tile_ids_as_columns(spark):
    rng = random.Random(1)
    keys = [(z, rng.randrange(2**z), rng.randrange(2**z)) for z in range(16) for _ in range(8)]
    df = spark.createDataFrame(keys, "z int, x int, y int")
    for r in df.select("*", pmtiles.zxy_columns(F.col("z"), F.col("x"), F.col("y")).alias("i")).collect():
        assert r.i == pmtiles.tile_id(r.z, r.x, r.y)


def sample_layers():
    values = {"s": ("string_value", "é"), "f": ("float_value", 1.5), "d": ("double_value", 5.0), "i": ("int_value", -7), "u": ("uint_value", 2**64 - 1), "z": ("sint_value", -(2**63)), "b": ("bool_value", True), "n": None, "i5": ("int_value", 5), "u5": ("uint_value", 5)}
    line = mvt.commands([[(0, 0), (100, 50), (200, -20)]], mvt.LINESTRING)
    ring = mvt.commands([[(0, 0), (100, 0), (100, 100), (0, 100)], [(20, 20), (20, 40), (40, 40)]], mvt.POLYGON)
    feats = [mvt.Feature(values, mvt.POINT, mvt.commands([[(5, 5), (9, 9)]], mvt.POINT), 7), mvt.Feature({}, mvt.LINESTRING, line), mvt.Feature({"s": ("string_value", "é")}, mvt.POLYGON, ring, 2**64 - 1)]
    return [mvt.Layer("first", feats, 4096, 2), mvt.Layer("empty", [], None, 1)]


def test_messages_round_trip():
    layers = sample_layers()
    again = mvt.decode(mvt.encode(layers))
    assert again == layers
    shape = mvt.geometry(mvt.POLYGON, layers[0].features[2].geometry)
    assert len(shape.polygons) == 1 and len(shape.polygons[0]) == 2
    assert mvt.geometry(mvt.POINT, layers[0].features[0].geometry).points.tolist() == [[5, 5], [9, 9]]


def test_dictionary_rules():
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    layer = field(1, b"l") + field(3, b"k") + field(3, b"unused") + field(4, field(1, b"a")) + field(4, field(1, b"b")) + field(2, field(2, bytes([0, 0, 0, 1, 0])))
    (got,) = mvt.decode(field(3, layer))
    assert got.features[0].tags == {"k": ("string_value", "b")}  # the last of a name, and no odd index
    assert b"unused" not in mvt.encode([got])
    for bad in (field(3, field(1, b"l") + field(2, field(2, bytes([0, 0])))), b"\x1a\x05abc", b"\xff" * 11):
        with pytest.raises(mvt.TileError):
            mvt.decode(bad)
    nan = float("nan")
    twice = mvt.Layer("x", [mvt.Feature({"a": ("double_value", nan), "b": ("double_value", nan), "c": ("double_value", 1.0), "d": ("double_value", 1.0)})])
    assert mvt.encode([twice]).count(b"\x22\x09\x19") == 3
    for commands in ([mvt.LINE_TO | 1 << 3, 0, 0], [mvt.MOVE_TO | 2 << 3, 0, 0], [3 | 1 << 3]):
        with pytest.raises(mvt.TileError):
            mvt.geometry(mvt.LINESTRING, commands)


def test_directories_round_trip():
    rng = random.Random(3)
    entries, at, offset = [], 0, 0
    for _ in range(20_000):
        run, size = rng.choice([1, 1, 1, 5]), rng.randrange(1, 900)
        entries.append(pmtiles.Entry(at, offset, size, run))
        at += run + rng.choice([0, 0, 3])
        offset += size
    assert pmtiles.parse_directory(pmtiles.pack_directory(entries)) == entries
    root, leaves = pmtiles._directories(entries, pmtiles.GZIP)
    assert leaves and len(root) <= pmtiles.ROOT_BYTES - pmtiles.HEADER_BYTES


def test_archives(spark, tmp_path):
    path = f"{tmp_path}/a.pmtiles"
    data = {i: (b"same" if 100 <= i < 200 else os.urandom(20)) for i in range(5000)}
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in data.items()], "tile_id long, data binary").repartition(7)
    header = pmtiles.Header(max_zoom=6, min_lon=-12.5, max_lat=33.25, center_zoom=3)
    pmtiles.write_archive(df, path, header, '{"name": "x"}')
    got = pmtiles.read_archive(spark, path, partitionbytes=20_000)
    assert {r.tile_id: bytes(r.data) for r in got.collect()} == data and got.rdd.getNumPartitions() > 3
    assert [(r.z, r.x, r.y) for r in got.orderBy("tile_id").limit(50).collect()] == [pmtiles.tile_zxy(i) for i in range(50)]
    back = pmtiles.read_header(path)
    assert (back.max_zoom, back.min_lon, back.max_lat, back.center_zoom, back.counts[0]) == (6, -12.5, 33.25, 3, 5000)
    assert back.counts[1] < 5000 and json.loads(pmtiles.read_metadata(path)) == {"name": "x"}
    row = pmtiles.header_frame(spark, path).first()
    assert (row.tile_type, row.max_zoom, row.metadata) == (1, 6, '{"name": "x"}')
    assert [p for p in os.listdir(tmp_path)] == ["a.pmtiles"]
    with pytest.raises(pmtiles.ArchiveError):
        pmtiles.Header.parse(b"nothing" * 30)
    assert gzip.decompress(pmtiles.compress(b"x", pmtiles.GZIP)) == b"x"
    with pytest.raises(pmtiles.ArchiveError):
        pmtiles.compress(b"x", pmtiles.BROTLI)


def test_empty_archive(spark, tmp_path):
    pmtiles.write_archive(spark.createDataFrame([], "tile_id long, data binary"), f"{tmp_path}/e.pmtiles", pmtiles.Header())
    assert pmtiles.read_archive(spark, f"{tmp_path}/e.pmtiles").count() == 0


RULES = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "geometry": Q.WORLD, "properties": {"layers": {"first": {"feature": ["==", ["type"], "LineString"], "tag": ["in", ["key"], ["literal", ["d", "u"]]]}}}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {"layers": {"*": {"feature": True}}}},
    ],
}


def test_command(spark, tmp_path):
    source, target, rules = (f"{tmp_path}/{n}" for n in ("in.pmtiles", "out.pmtiles", "f.geojson"))
    data = mvt.encode(sample_layers())
    df = spark.createDataFrame([(i, bytearray(data)) for i in range(1, 5)], "tile_id long, data binary")
    pmtiles.write_archive(df, source, pmtiles.Header(max_zoom=1), '{"name": "old", "vector_layers": [1]}')
    with open(rules, "w") as f:
        json.dump(RULES, f)
    for bad in ((f"{tmp_path}/none", target, None), (source, target, f"{tmp_path}/none"), (source, f"{tmp_path}/out.zip", None)):
        with pytest.raises(cli.InputError):
            cli.convert(spark, *bad)
    assert not os.path.exists(target)
    assert cli.convert(spark, source, target, rules, name="new", attribution="me") == 4
    assert json.loads(pmtiles.read_metadata(target)) == {"name": "new", "vector_layers": [1], "attribution": "me"}
    for r in pmtiles.read_archive(spark, target).collect():
        first, empty = mvt.decode(bytes(r.data))
        assert empty == mvt.Layer("empty", [], None, 1) and (first.name, first.extent, first.version) == ("first", 4096, 2)
        kinds = [f.kind for f in first.features]
        assert mvt.LINESTRING not in kinds and kinds[0] == mvt.POINT
        assert set(first.features[0].tags) == {"s", "f", "i", "z", "b", "n", "i5", "u5"}
    assert cli.convert(spark, source, f"{tmp_path}/same.pmtiles") == 4
    assert [mvt.decode(bytes(r.data)) for r in pmtiles.read_archive(spark, f"{tmp_path}/same.pmtiles").collect()] == [sample_layers()] * 4
    a = cli.arguments().parse_args(["a", "b", "-f", "c", "-n", "d", "-N", "e", "-A", "f"])
    assert (a.input, a.output, a.filter, a.name, a.description, a.attribution) == tuple("abcdef")


def test_masks_by_tile():
    rules = Q.collection(({"type": "Polygon", "coordinates": [[[1, 1], [20, 1], [20, 20], [1, 20], [1, 1]]]}, {"*": {"feature": True}}))
    point = lambda x, y: mvt.Feature({}, mvt.POINT, mvt.commands([[(x, y)]], mvt.POINT))
    at = lambda lon, lat, z=3, x=4, y=3: tuple(int(v) for v in G.to_tile(geo("Point", [lon, lat]), z, x, y, 4096).points[0].round())
    layer = mvt.Layer("l", [point(*at(10, 10)), point(*at(30, 30)), point(*at(-3, 10))])
    assert tiles.masks_of([layer], 3, 4, 3, rules) == [[[0], [], []]]
    assert tiles.masks_of([mvt.Layer("l", [point(0, 0)])], 3, 0, 0, rules) == [[[]]]
    # in the tile's buffer, features are tested against the whole mask
    assert tiles.masks_of([mvt.Layer("l", [point(*at(10, 10, 5, 17, 15))])], 5, 17, 15, rules) == [[[0]]]


def test_tile_error_names_the_tile(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, bytearray(b"\x1a\x05abc"))], "tile_id long, z int, x int, y int, data binary")
    with pytest.raises(Exception, match="tile 0/0/0"):
        tiles.filter_tiles(df).collect()


@pytest.mark.parametrize(
    "base,given,want",
    [('{"a": 1, "name": "x"}', {}, {"a": 1, "name": "x"}), ('{"a": 1}', {"name": "n", "description": "d", "attribution": "t"}, {"a": 1, "name": "n", "description": "d", "attribution": "t"}), ("not json", {"name": "n"}, {"name": "n"}), ("[1]", {}, {}), ("", {}, {})],
)
def test_metadata(base, given, want):
    assert json.loads(apply_overrides(base, **given)) == want


def test_features_of_tiles(spark):
    rows = tiles.features(tiles.decode_tiles(Q.event_tiles(spark, SF)))
    assert rows.count() == 1000 and rows.select("geometry_type").distinct().first()[0] == "Point"
    assert math.isclose(rows.select(F.sum(F.try_element_at("tags", F.lit("value"))["double_value"])).first()[0], Q.features(spark, SF).agg(F.sum("value")).first()[0])
