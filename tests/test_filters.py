"""Filter documents, rule resolution, and filters over tables and streams."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilesieve.functions import values as V
from tilesieve.operators import filtering
from tilesieve.plans import queries as Q
from tilesieve.plans.filters import FilterCollection, FilterError
from tilesieve.streaming.filtering import filter_stream, write_stream

SF = "/root/testdata/sf0.001"


def doc(geometry, layers, **about):
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": geometry, "properties": {"layers": layers, **about}}]}


def test_documents():
    c = FilterCollection.from_json(json.dumps(doc(Q.WORLD, {"*": {"feature": ["ends-with", ["tag", "state"], "closed"]}, "berths": {"tag": ["regex-match", ["key"], "^x_"], "feature": None}}, id="x", description="y", name="ignored")))
    (f,) = c.filters
    assert (f.id, f.description) == ("x", "y") and c.layers() == ["*", "berths"]
    assert f.layers["berths"].feature is None and f.layers["berths"].tag is not None


@pytest.mark.parametrize(
    "bad",
    [{}, {"type": "FeatureCollection"}, {"type": "F", "features": [{}]}, doc(Q.WORLD, None), doc(None, {}), doc(Q.WORLD, {}, id=5), doc({"type": "Circle", "coordinates": []}, {}), doc(Q.WORLD, {"*": {"feature": ["nope"]}}), doc(Q.WORLD, {"*": 5})],
)
def test_bad_documents(bad):
    with pytest.raises(ValueError):
        FilterCollection.from_json(json.dumps(bad))
    assert issubclass(FilterError, ValueError)


def test_no_filters_drop_nothing(spark):
    v = Q.view(spark, SF)
    assert v.drop_features().count() == v.df.count()


def test_empty_and_line_masks(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 1.0, 1.0), (3, "a", 1.0, 0.5)], "id long, layer string, lon double, lat double")
    keep = lambda g: sorted(r.id for r in filtering.PointFeatures(df, Q.collection((g, {"*": {"feature": True}})), "layer", "lon", "lat", {}).drop_features().collect())
    assert keep({"type": "MultiPoint", "coordinates": []}) == [1, 2, 3]
    assert keep({"type": "Point", "coordinates": [0, 0]}) == [2, 3]
    assert keep({"type": "LineString", "coordinates": [[-1, -1], [2, 2]]}) == [3]
    assert keep({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": [[[0.5, 0.5], [1, 0.5], [1, 0.7], [0.5, 0.5]]]}]}) == [1]


def test_many_edges_fold_alike(spark):
    import math

    ring = [[50 * math.cos(2 * math.pi * k / 200), 30 * math.sin(2 * math.pi * k / 200)] for k in range(200)]
    g = {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}
    from tilesieve.functions.geometry import from_geojson, in_polygon

    rows = Q.view(spark, SF, (g, {"*": {"feature": True}})).drop_features().select("event_id").collect()
    rings = from_geojson(g).polygons[0]
    want = {r.event_id for r in Q.features(spark, SF).collect() if not in_polygon((r.lon, r.lat), rings)}
    assert {r.event_id for r in rows} == want and len(want) < 1000


def test_tags_in_a_map(spark):
    kept = Q.tag_drop_names(spark, SF).groupBy("key").count().collect()
    assert {r.key for r in kept} == {"label", "label.de", "label.fr", "lang"}


def _normal(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({Q.ORACLES[name]})").fetchall()
    assert _normal(df.select(*cols).collect()) == _normal(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "layer", "key", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streams(spark, tmp_path):
    src = Q.features(spark, SF)
    src.write.parquet(f"{tmp_path}/in")
    rules = Q.collection((Q.RECT, {"*": {"feature": ["<", ["tag", "k"], 50]}}))
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = write_stream(filter_stream(stream, rules, "event_type", "lon", "lat", Q.KINDS), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.event_id for r in filtering.PointFeatures(src, rules, "event_type", "lon", "lat", Q.KINDS).drop_features().collect()}
    with pytest.raises(ValueError):
        filter_stream(src, rules, "event_type", "lon", "lat", Q.KINDS)


def test_text_of_floats(spark):
    vals = [0.0, 5.0, -0.5, 1e7, 12345678.9, 1e21, 1.5e-7, 123456789012.25, 1e16, -2.5e-10, float("inf"), float("nan")]
    want = ["0", "5", "-0.5", "10000000", "12345678.9", "1000000000000000000000", "0.00000015", "123456789012.25", "10000000000000000", "-0.00000000025", "inf", "NaN"]
    rows = spark.createDataFrame(list(enumerate(vals)), "i int, x double").select("i", V.float_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == want


def test_points_at_edges_whatever_the_number_of_edges(spark):
    """One formula tells inside from outside: in one expression, in a fold over edges, and for tiles."""
    import math
    import random

    from tilesieve.functions.geometry import from_geojson, in_polygon
    from tilesieve.operators.spatial import INLINE_EDGES, point_in

    rng = random.Random(4)
    for n in (INLINE_EDGES - 1, INLINE_EDGES, INLINE_EDGES + 1):
        ring = [[30 * math.cos(2 * math.pi * k / n) * rng.uniform(0.7, 1), 30 * math.sin(2 * math.pi * k / n)] for k in range(n)]
        points = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            for _ in range(12):
                f = rng.random()
                x, y = ax + f * (bx - ax), ay + f * (by - ay)
                points += [(x, y), (math.nextafter(x, 99), y), (math.nextafter(x, -99), y)]
        shape = from_geojson({"type": "Polygon", "coordinates": [[*ring, ring[0]]]})
        df = spark.createDataFrame(points, "x double, y double")
        got = [r.hit for r in df.select(point_in(shape, F.col("x"), F.col("y")).alias("hit")).collect()]
        assert got == [in_polygon(p, shape.polygons[0]) for p in points]
        if n <= INLINE_EDGES:
            import tilesieve.operators.spatial as spatial

            spatial.INLINE_EDGES, kept = 0, spatial.INLINE_EDGES
            try:
                assert got == [r.hit for r in df.select(point_in(shape, F.col("x"), F.col("y")).alias("hit")).collect()]
            finally:
                spatial.INLINE_EDGES = kept
