"""Tiles of any size are decoded, filtered and encoded in parts of a bounded size."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilesieve.functions import geometry as G
from tilesieve.operators import tiles
from tilesieve.plans import queries as Q
from tilesieve.sources import mvt, pmtiles

SF = "/root/testdata/sf0.001"
N = 2 * tiles.PART + 500
BIG = 2**64 - 1


def point(k):
    tags = {"n": ("sint_value", -k), "s": ("string_value", f"é{k % 7}"), "d": ("double_value", k % 3 / 2), "u": ("uint_value", BIG - k), "none": None}
    return mvt.Feature(dict(list(tags.items())[: k % 6]), mvt.POINT, mvt.commands([[(k % 4096, k % 977)]], mvt.POINT), None if k % 11 == 0 else k)


def layers():
    line = mvt.Feature({}, mvt.LINESTRING, mvt.commands([[(0, 0), (9, 9)]], mvt.LINESTRING), BIG)
    return [mvt.Layer("none", [], None, 1), mvt.Layer("many", [point(k) for k in range(N)], 4096, 2), mvt.Layer("last", [line, point(1), line], 512, 2)]


def table(spark, data):
    return spark.createDataFrame([(5, 2, 0, 0, bytearray(data)), (6, 2, 0, 1, bytearray()), (7, 2, 1, 1, bytearray(data))], "tile_id long, z int, x int, y int, data binary").repartitionByRange(1, "tile_id")


def test_a_row_has_a_part(spark):
    decoded = tiles.decode_tiles(table(spark, mvt.encode(layers())))
    sizes = [(r.tile_id, r.part, r.n) for r in decoded.select("tile_id", "part", F.expr("aggregate(layers, 0, (a, l) -> a + size(l.features))").alias("n")).collect()]
    assert sizes == [(5, 0, tiles.PART), (5, 1, tiles.PART), (5, 2, 503), (6, 0, 0), (7, 0, tiles.PART), (7, 1, tiles.PART), (7, 2, 503)]
    rows = tiles.features(decoded).where("tile_id = 5").select("layer_no", "layer", "feature_no", "id", "tags").collect()
    assert [(r.layer_no, r.layer, r.feature_no) for r in rows] == [(1, "many", k) for k in range(N)] + [(2, "last", k) for k in range(3)]
    assert [r.id for r in rows[:30]] == [None if k % 11 == 0 else k for k in range(30)] and rows[4].tags["u"].uint_value == BIG - 4


def test_parts_are_one_message_again(spark):
    data = mvt.encode(layers())
    assert [bytes(r.data) for r in tiles.filter_tiles(table(spark, data)).collect()] == [data, b"", data]
    rules = Q.collection((Q.WORLD, {"many": {"feature": ["==", ["tag", "s"], "é3"], "tag": ["==", ["key"], "s"]}}))
    want = layers()
    want[1].features = [mvt.Feature({k: v for k, v in f.tags.items() if k != "s"}, f.kind, f.geometry, f.id) for k, f in enumerate(want[1].features) if k % 6 < 2 or k % 7 != 3]
    assert [bytes(r.data) for r in tiles.filter_tiles(table(spark, data), rules).collect()] == [mvt.encode(want), b"", mvt.encode(want)]


def test_reading_at_once_equals_field_by_field():
    (layer,) = mvt.layers_of(mvt.encode(layers()[1:2]))
    raw = [layer.data[a:b] for a, b in zip(layer.starts, layer.ends)]
    at_once = mvt._features(raw)
    assert all(np.array_equal(a, b) for a, b in zip(at_once, mvt._features_singly(raw)))
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    head = field(1, b"l") + field(3, b"k") + field(3, b"j") + field(3, b"k") + field(4, field(1, b"a")) + field(4, field(1, b"b"))
    # repeats of a name, an odd index, numbers one by one, fields that are not the format's
    for body in (field(2, bytes([0, 0, 1, 0, 2, 1, 0])), bytes([16, 0, 16, 0, 16, 1, 16, 0, 16, 2, 16, 1]), field(2, bytes([0, 0, 1, 0])) + field(2, bytes([2, 1])), field(9, b"\xff\xff") + field(2, bytes([0, 0, 1, 0, 2, 1]))):
        message = field(3, head + field(2, body + bytes([8, 3, 24, 1])))
        (got,) = mvt.layers_of(message)
        c = got.read(0, 1)
        assert [(got.keys[k], got.values[v][1]) for k, v in zip(c.keys, c.values)] == [("k", "b"), ("j", "a")] == [(k, v[1]) for k, v in mvt.decode(message)[0].features[0].tags.items()]
    for bad in (field(2, bytes([9, 0])), b"\x12\x7f\x00", b"\x08" + b"\xff" * 11, b"\x12\x02\x00\x80"):
        with pytest.raises(mvt.TileError):
            [x.read(0, len(x)) for x in mvt.layers_of(field(3, head + field(2, bad)))]


def test_floats_of_the_same_value_are_one_entry(spark):
    nan = float("nan")
    tags = {"a": ("double_value", nan), "b": ("double_value", nan), "c": ("double_value", -0.0), "d": ("double_value", 0.0), "e": ("float_value", 1.5), "f": ("double_value", 1.5)}
    data = mvt.encode([mvt.Layer("x", [mvt.Feature(tags, mvt.POINT, mvt.commands([[(1, 1)]], mvt.POINT))])])
    assert bytes(tiles.filter_tiles(table(spark, data)).first().data) == data


def test_points_together_as_alone():
    rng = np.random.default_rng(4)
    holed, two = G.from_geojson(Q.HOLED), G.from_geojson(Q.TWO)
    mixed = G.from_geojson({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 3]}, {"type": "LineString", "coordinates": [[-20, -20], [20, 20]]}, Q.KITE]})
    points = np.concatenate([rng.integers(-25, 26, (300, 2)) * 8.0, [[-40.0, 0.0], [3.0, 3.0], [-150.0, -60.0]]])
    for g in (holed, two, mixed, G.from_geojson(Q.KITE), G.Geometry()):
        assert G.points_meet(points, g).tolist() == [G.intersects(G.Geometry(points=p[None]), g) for p in points]


def test_events_are_not_gathered(spark):
    plan = Q.event_tiles(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan
    ids = [r.tile_id for r in Q.event_tiles(spark, SF).select("tile_id").collect()]
    assert ids == sorted(set(ids))


def test_archives_pass_tiles_in_bounded_batches(tmp_path):
    path, size, n = f"{tmp_path}/a.pmtiles", 1 << 20, 24
    source = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([os.urandom(size)], pa.binary())], names=["tile_id", "data"]) for k in range(n)]
    writer = pmtiles.Writer({"path": path, "header": '{"tile_compression": 1}'}, True)
    tracemalloc.start()
    segment = writer.write(iter(source))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * size and len(segment.entries) == n
    writer.commit([segment])
    reader = pmtiles.Reader({"path": path})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == n and max(b.nbytes for b in batches) <= pmtiles.BATCH_BYTES + 2 * size


def test_a_repeated_tile_is_stored_once(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([b"a", b"b", b"a", b"a"], pa.binary())], names=["tile_id", "data"])
    entries = pmtiles.Writer({"path": f"{tmp_path}/b.pmtiles", "header": '{"tile_compression": 1}'}, True).write(iter([batch])).entries
    assert entries == [pmtiles.Entry(0, 0, 1, 1), pmtiles.Entry(1, 1, 1, 1), pmtiles.Entry(2, 0, 1, 2)]
