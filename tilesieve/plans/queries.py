"""The registered queries of the filter engine, each with the SQL that it must equal.

They bind the engine's data model to the relational tables: a row of `events` is a point feature of
the layer `event_type`, with tags in typed columns; every third row has no tag `opt_k`, every fourth
no tag `opt_name`.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilesieve.functions import values as V
from tilesieve.operators import filtering, spatial, tiles
from tilesieve.operators.metadata import apply_overrides
from tilesieve.plans.filters import FilterCollection
from tilesieve.sources import mvt, pmtiles

Query = Callable[[SparkSession, str], DataFrame]

KINDS = {"event_type": V.STR, "user_id": V.INT, "value": V.FLOAT, "k": V.INT, "big": V.BOOL, "opt_k": V.INT, "opt_name": V.STR}

WORLD = {"type": "Polygon", "coordinates": [[[-181, -91], [181, -91], [181, 91], [-181, 91], [-181, -91]]]}
RECT = {"type": "Polygon", "coordinates": [[[-60.005, -30.005], [90.005, -30.005], [90.005, 45.005], [-60.005, 45.005], [-60.005, -30.005]]]}
KITE = {"type": "Polygon", "coordinates": [[[-100, 0], [0.5, 60.25], [120, 10], [10.75, -70.5], [-100, 0]]]}
HOLED = {"type": "Polygon", "coordinates": [[[-150, -60], [150, -60], [150, 60], [-150, 60], [-150, -60]], [[-40, -20], [40, -20], [40, 20], [-40, 20], [-40, -20]]]}
TWO = {"type": "MultiPolygon", "coordinates": [[[[-170, 5], [-90, 5], [-90, 80], [-170, 80], [-170, 5]]], [[[20, -80], [160, -80], [160, -10], [20, -10], [20, -80]]]]}

#: The feature view in SQL; the same arithmetic is in `features`.
EV = """WITH base AS (
  SELECT event_id, event_type, user_id, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k,
         ((event_id * 37) % 36000) / 100 - 180 AS lon, ((event_id * 53) % 17000) / 100 - 85 AS lat FROM events
), ev AS (
  SELECT *, value > 250 AS big, CASE WHEN event_id % 3 <> 0 THEN k END AS opt_k,
         CASE WHEN event_id % 4 <> 0 THEN 'n' || CAST(k AS VARCHAR) END AS opt_name FROM base
) """


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).cast("long")
    point = {"lon": (F.col("event_id") * 37) % 36000 / 100 - 180, "lat": (F.col("event_id") * 53) % 17000 / 100 - 85}
    e = e.select("event_id", "event_type", "user_id", "value", k.alias("k"), *(c.alias(n) for n, c in point.items()))
    return e.withColumns({"big": F.col("value") > 250, "opt_k": F.when(F.col("event_id") % 3 != 0, F.col("k")), "opt_name": F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("n"), F.col("k").cast("string")))})


def collection(*masks: tuple[dict, dict]) -> FilterCollection:
    """(geometry, rules by layer) pairs as a filter document, read as any other."""
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"layers": layers}} for g, layers in masks]}
    return FilterCollection.from_json(json.dumps(doc))


def view(spark: SparkSession, sf_dir: str, *masks: tuple[dict, dict]) -> filtering.PointFeatures:
    return filtering.PointFeatures(features(spark, sf_dir), collection(*masks), "event_type", "lon", "lat", KINDS)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _drop(name: str, sql_condition: str, *masks: tuple[dict, dict]) -> None:
    """Registers a query for the features that stay, with the SQL condition under which one goes."""
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, *masks).drop_features().select("event_id", "event_type", "user_id")
    ORACLES[name] = EV + f"SELECT event_id, event_type, user_id FROM ev WHERE NOT ({sql_condition})"


def _rule(name: str, expression: Any, sql_condition: str) -> None:
    _drop(name, sql_condition, (WORLD, {"*": {"feature": expression}}))


T = lambda name: ["tag", name]

for _name, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("gt", ">", ">"), ("le", "<=", "<="), ("ge", ">=", ">=")):
    _rule(f"cmp_{_name}", [_op, T("k"), 50], f"k {_sql} 50")
    _rule(f"cmp_{_name}_string", [_op, T("event_type"), "purchase"], f"event_type {_sql} 'purchase'")
_rule("cmp_missing_tag_lt", ["<", T("opt_k"), 40], "opt_k IS NULL OR opt_k < 40")
_rule("cmp_missing_tag_ne", ["!=", T("opt_k"), 40], "opt_k IS NULL OR opt_k <> 40")
_rule("cmp_missing_tag_ge", [">=", T("opt_k"), 40], "opt_k IS NOT NULL AND opt_k >= 40")
_rule("cmp_missing_both", ["==", T("opt_k"), T("nowhere")], "opt_k IS NULL")
_rule("cmp_mixed_text_eq", ["==", T("k"), "5"], "CAST(k AS VARCHAR) = '5'")
_rule("cmp_mixed_text_lt", ["<", T("k"), "3"], "CAST(k AS VARCHAR) < '3'")
_rule("cmp_mixed_bool_text", ["==", T("big"), "true"], "big")
_rule("cmp_bool", ["<", T("big"), True], "NOT big")
_rule("cmp_int_float", [">", T("value"), 250], "value > 250.0")
_rule("cmp_float_literal", ["<=", T("k"), 24.5], "CAST(k AS DOUBLE) <= 24.5")
_rule("cmp_two_tags", ["<", T("k"), T("value")], "CAST(k AS DOUBLE) < value")
_rule("logic_any", ["any", ["==", T("event_type"), "click"], [">", T("k"), 80]], "event_type = 'click' OR k > 80")
_rule("logic_all", ["all", ["==", T("event_type"), "click"], [">", T("k"), 20]], "event_type = 'click' AND k > 20")
_rule("logic_none", ["none", ["==", T("event_type"), "click"], [">", T("k"), 20]], "NOT (event_type = 'click' OR k > 20)")
_rule("logic_not", ["not", [">", T("k"), 20]], "NOT k > 20")
_rule("logic_bang", ["!", ["in", T("event_type"), ["literal", ["view", "error"]]]], "event_type NOT IN ('view', 'error')")
_rule("logic_empty", ["any", ["all", ["none"], ["==", T("k"), 7]], ["any"]], "k = 7")
_rule("in_strings", ["in", T("event_type"), ["literal", ["error", "signup"]]], "event_type IN ('error', 'signup')")
_rule("in_ints", ["in", T("k"), ["literal", [1, 2, 3, 5, 8, 13, 21, 34, 55]]], "k IN (1, 2, 3, 5, 8, 13, 21, 34, 55)")
_rule("in_with_null", ["in", T("opt_name"), ["literal", [None, "n4"]]], "opt_name IS NULL OR opt_name = 'n4'")
_rule("in_no_coercion", ["in", T("k"), ["literal", ["1", 1.0, True, 2]]], "k = 2")
_rule("starts_with", ["starts-with", T("event_type"), "p"], "starts_with(event_type, 'p')")
_rule("ends_with", ["ends-with", T("event_type"), "k"], "suffix(event_type, 'k')")
_rule("starts_with_null_text", ["starts-with", T("opt_name"), "nu"], "starts_with(coalesce(opt_name, 'null'), 'nu')")
_rule("ends_with_number_text", ["ends-with", T("user_id"), "7"], "suffix(CAST(user_id AS VARCHAR), '7')")
_rule("regex_match", ["regex-match", T("opt_name"), "^n[1-4]"], "regexp_matches(coalesce(opt_name, 'null'), '^n[1-4]')")
_rule("regex_match_unanchored", ["regex-match", T("user_id"), "1.*2$"], "regexp_matches(CAST(user_id AS VARCHAR), '1.*2$')")
_rule("regex_capture_in", ["in", ["regex-capture", T("event_type"), "^(.)(.*?)(r*)$", 3], ["literal", ["", "rr"]]], "regexp_matches(event_type, '^(.)(.*?)(r*)$') AND regexp_extract(event_type, '^(.)(.*?)(r*)$', 3) IN ('', 'rr')")
_rule("regex_capture_root", ["regex-capture", T("opt_name"), "^n([0-9]*)5$", 1], "regexp_matches(coalesce(opt_name, 'null'), '^n([0-9]*)5$') AND regexp_extract(coalesce(opt_name, 'null'), '^n([0-9]*)5$', 1) <> ''")
_rule("regex_capture_optional", ["==", ["regex-capture", T("opt_name"), "^n(1)?", 1], None], "NOT starts_with(coalesce(opt_name, 'null'), 'n1')")
_rule("boolean_cast", ["boolean", T("opt_k")], "opt_k IS NOT NULL AND opt_k <> 0")
_rule("boolean_bool", ["boolean", T("big")], "big")
_rule("literal_rule", ["literal", ""], "FALSE")
_rule("literal_scalar", True, "TRUE")
_rule("type_filter", ["all", ["==", ["type"], "Point"], ["<", T("k"), 10]], "k < 10")
_rule("key_outside_tags", ["==", ["key"], None], "TRUE")
_rule("tag_lookup", ["==", T("user_id"), T("k")], "user_id = k")
_rule("regex_unicode_class", ["regex-match", T("event_type"), r"^[[:^digit:]]\p{Ll}{4}$"], r"regexp_matches(event_type, '^[^0-9]\p{Ll}{4}$')")
_rule("regex_capture_optional_class", ["==", ["regex-capture", T("event_type"), r"^(\p{L}{5})?\p{L}*$", 1], None], "length(event_type) < 5")
_drop("layer_specific", "event_type = 'click' AND k > 30", (WORLD, {"click": {"feature": [">", T("k"), 30]}}))
_drop("wildcard_fallback", "CASE WHEN event_type = 'click' THEN k > 30 ELSE k > 60 END", (WORLD, {"click": {"feature": [">", T("k"), 30]}, "*": {"feature": [">", T("k"), 60]}}))
_drop("slot_fallback", "k > 60", (WORLD, {"click": {"tag": True}, "*": {"feature": [">", T("k"), 60]}}))
_drop("multi_filter_or", "(event_type = 'view' AND k < 10) OR k > 90", (WORLD, {"view": {"feature": ["<", T("k"), 10]}}), (WORLD, {"*": {"feature": [">", T("k"), 90]}}))


def _inside(edges: list[list[float]]) -> str:
    """SQL for a point strictly inside or on an edge of a ring, by counting crossings."""
    ring = list(zip(edges, edges[1:]))
    crossings = " + ".join(f"CASE WHEN lat >= {min(a[1], b[1])} AND lat < {max(a[1], b[1])} AND lon < (lat - {a[1]}) * CAST({(b[0] - a[0]) / (b[1] - a[1])!r} AS DOUBLE) + {a[0]} THEN 1 ELSE 0 END" for a, b in ring if a[1] != b[1])
    on = " OR ".join(f"(({b[0]} - {a[0]}) * (lat - {a[1]}) = ({b[1]} - {a[1]}) * (lon - {a[0]}) AND lon BETWEEN {min(a[0], b[0])} AND {max(a[0], b[0])} AND lat BETWEEN {min(a[1], b[1])} AND {max(a[1], b[1])})" for a, b in ring)
    return f"(({crossings}) % 2 = 1 OR {on})"


_drop("mask_rect", "lon BETWEEN -60.005 AND 90.005 AND lat BETWEEN -30.005 AND 45.005", (RECT, {"*": {"feature": True}}))
_drop("mask_polygon", _inside(KITE["coordinates"][0]), (KITE, {"*": {"feature": True}}))
_drop("mask_hole", "lon BETWEEN -150 AND 150 AND lat BETWEEN -60 AND 60 AND NOT (lon > -40 AND lon < 40 AND lat > -20 AND lat < 20)", (HOLED, {"*": {"feature": True}}))
_drop("mask_multi", "(lon BETWEEN -170 AND -90 AND lat BETWEEN 5 AND 80) OR (lon BETWEEN 20 AND 160 AND lat BETWEEN -80 AND -10)", (TWO, {"*": {"feature": True}}))
_drop("mask_and_rule", "lon BETWEEN -60.005 AND 90.005 AND lat BETWEEN -30.005 AND 45.005 AND k < 50", (RECT, {"*": {"feature": ["<", T("k"), 50]}}))


def _pairs(where: str, drop: str) -> str:
    """SQL for the (key, value) rows of the features that stay, without dropped tags."""
    listed = " UNION ALL ".join(f"SELECT event_id, event_type, opt_k, k, lon, lat, '{c}' AS key, {text} AS value FROM ev" for c, text in (("event_type", "event_type"), ("user_id", "CAST(user_id AS VARCHAR)"), ("k", "CAST(k AS VARCHAR)"), ("big", "CASE WHEN big THEN 'true' ELSE 'false' END"), ("opt_k", "CAST(opt_k AS VARCHAR)"), ("opt_name", "opt_name")))
    return EV + f"SELECT event_id, key, value FROM ({listed}) WHERE value IS NOT NULL AND NOT ({where}) AND NOT ({drop})"


def _tags(name: str, where: str, drop: str, *masks: tuple[dict, dict]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = view(spark, sf_dir, *masks)
        v.kinds = {k: kind for k, kind in KINDS.items() if k != "value"}  # no text of floats in results
        return v.tag_rows(["event_id"])

    QUERIES[name] = run
    ORACLES[name] = _pairs(where, drop)


_tags("key_rule", "FALSE", "key = 'k' OR starts_with(key, 'opt_')", (WORLD, {"*": {"tag": ["any", ["==", ["key"], "k"], ["starts-with", ["key"], "opt_"]]}}))
_tags("tag_drop_sees_original", "FALSE", "key IN ('k', 'opt_k') AND opt_k IS NOT NULL AND opt_k > 20", (WORLD, {"*": {"tag": ["all", ["in", ["key"], ["literal", ["k", "opt_k"]]], [">", T("opt_k"), 20]]}}))
_tags("feature_and_tag", "event_type = 'error'", "event_type = 'click' AND key = 'user_id' OR lon BETWEEN -60.005 AND 90.005 AND lat BETWEEN -30.005 AND 45.005 AND key = 'big'", (WORLD, {"error": {"feature": True}, "click": {"tag": ["==", ["key"], "user_id"]}}), (RECT, {"*": {"tag": ["==", ["key"], "big"]}}))

#: Drops old labels, and labels but for the plain one and those in two languages: there the group takes no part, and null is a member.
NAMES = ["any", ["starts-with", ["key"], "old:label:"], ["all", ["regex-match", ["key"], "^label"], ["none", ["in", ["regex-capture", ["key"], r"^label(?:\.(.*))?$", 1], ["literal", [None, "de", "fr"]]]]]]


@register(
    "tag_drop_names",
    "WITH t AS (SELECT doc_id, 'label.' || lang AS key, source AS value FROM documents UNION ALL SELECT doc_id, 'label', source FROM documents UNION ALL SELECT doc_id, 'old:label:' || lang, source FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents) "
    "SELECT doc_id, key, value FROM t WHERE NOT (starts_with(key, 'old:label:') OR (starts_with(key, 'label.') AND substr(key, 7) NOT IN ('de', 'fr')))",
)
def tag_drop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: F.struct(*((F.col(c) if n == "string_value" else F.lit(None)).cast(kind).alias(n) for n, kind in (x.split(":") for x in V.MVT_VALUE[7:-1].replace("decimal(20,0)", "decimal").split(","))))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    names = F.map_from_arrays(F.array(F.concat(F.lit("label."), F.col("lang")), F.lit("label"), F.concat(F.lit("old:label:"), F.col("lang")), F.lit("lang")), F.array(value("source"), value("source"), value("source"), value("lang")))
    table = d.select("doc_id", F.lit("places").alias("layer"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), names.alias("tags"))
    kept = filtering.PointFeatures(table, collection((WORLD, {"*": {"tag": NAMES}})), "layer", "lon", "lat", tags_col="tags").drop_tags()
    return kept.select("doc_id", F.explode("tags").alias("key", "v")).select("doc_id", "key", F.col("v.string_value").alias("value"))


@register("feature_drop_anti", EV + ", m AS (SELECT DISTINCT event_type AS layer, floor(lon / 30) * 30 AS west, floor(lat / 15) * 15 AS south FROM ev WHERE event_id % 97 = 0) SELECT event_id, event_type, user_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.layer = ev.event_type AND lon >= west AND lon <= west + 12 AND lat >= south AND lat <= south + 8)")
def feature_drop_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    m = f.where(F.col("event_id") % 97 == 0).select(F.col("event_type").alias("layer"), (F.floor(F.col("lon") / 30) * 30).cast("double").alias("west"), (F.floor(F.col("lat") / 15) * 15).cast("double").alias("south")).distinct()
    masks = m.withColumns({"east": F.col("west") + 12, "north": F.col("south") + 8})
    return filtering.anti_join(f, masks, "event_type", "lon", "lat").select("event_id", "event_type", "user_id")


TILE = "CAST(greatest(0, least(63, floor((lon + 180) / 360 * 64))) AS INTEGER) AS x, CAST(greatest(0, least(63, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 64))) AS INTEGER) AS y"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = spatial.tile_of(F.col("lon"), F.col("lat"), 6)
    return features(spark, sf_dir).withColumns({"z": F.lit(6), "x": x, "y": y})


@register("tile_assign", EV + f"SELECT event_id, CAST(6 AS INTEGER) AS z, {TILE} FROM ev")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("event_id", "z", "x", "y")


@register("coord_format", EV + f", t AS (SELECT event_id, {TILE} FROM ev) SELECT event_id, '6/' || x || '/' || y AS tile FROM t")
def coord_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("event_id", spatial.tile_key(F.col("z"), F.col("x"), F.col("y")).alias("tile"))


@register("tile_bounds", EV + f", t AS (SELECT DISTINCT {TILE} FROM ev) SELECT x, y, round(x / 64 * 360 - 180, 6) AS west, round(degrees(atan((exp(pi() * (1 - 2 * (y + 1) / 64)) - exp(-pi() * (1 - 2 * (y + 1) / 64))) / 2)), 6) AS south FROM t")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _assigned(spark, sf_dir).select("z", "x", "y").distinct()
    b = spatial.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return t.select("x", "y", *(F.round(b[k], 6).alias(k) for k in ("west", "south")))


@register("bbox_gate", EV + f", t AS (SELECT DISTINCT {TILE} FROM ev) SELECT x, y FROM t WHERE x / 64 * 360 - 180 <= 90.005 AND (x + 1) / 64 * 360 - 180 >= -60.005 AND degrees(atan((exp(pi() * (1 - 2 * (y + 1) / 64)) - exp(-pi() * (1 - 2 * (y + 1) / 64))) / 2)) <= 45.005 AND degrees(atan((exp(pi() * (1 - 2 * y / 64)) - exp(-pi() * (1 - 2 * y / 64))) / 2)) >= -30.005")
def bbox_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _assigned(spark, sf_dir).select("z", "x", "y").distinct()
    return t.where(spatial.boxes_meet(spatial.tile_bounds(F.col("z"), F.col("x"), F.col("y")), (-60.005, -30.005, 90.005, 45.005))).select("x", "y")


@register("geom_type_project", EV + "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Point' WHEN 1 THEN 'Point' WHEN 2 THEN 'LineString' WHEN 3 THEN 'LineString' WHEN 4 THEN 'Polygon' WHEN 5 THEN 'Polygon' ELSE 'Unknown' END AS kind FROM ev")
def geom_type_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")))
    return features(spark, sf_dir).select("event_id", filtering.geometry_type(F.get(kinds, (F.col("event_id") % 7).cast("int"))).alias("kind"))


@register("dict_rebuild", EV + "SELECT event_type AS layer, 'k' AS key, CAST(k AS VARCHAR) AS value, count(*) AS uses FROM ev WHERE k >= 20 GROUP BY ALL UNION ALL SELECT event_type, 'opt_name', opt_name, count(*) FROM ev WHERE k >= 20 AND opt_name IS NOT NULL GROUP BY ALL")
def dict_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, (WORLD, {"*": {"feature": ["<", T("k"), 20]}}))
    tags = F.map_filter(F.map_from_arrays(F.array(F.lit("k"), F.lit("opt_name")), F.array(F.col("k").cast("string"), F.col("opt_name"))), lambda _, x: x.isNotNull())
    return tiles.repack(v.drop_features().select(F.col("event_type").alias("layer"), tags.alias("tags")))


@register("tile_count", EV + f", t AS (SELECT event_id, {TILE} FROM ev) SELECT x, y, count(*) AS features FROM t GROUP BY x, y")
def tile_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("features"))


HILBERT = f"""{EV.replace("WITH base", "WITH RECURSIVE base")}, t AS (SELECT DISTINCT {TILE} FROM ev),
h AS (SELECT x AS x0, y AS y0, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(32 AS BIGINT) AS s, CAST(0 AS BIGINT) AS d FROM t
UNION ALL SELECT x0, y0,
  CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN 63 - y ELSE y END ELSE x END,
  CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN 63 - x ELSE x END ELSE y END,
  s // 2, d + s * s * xor(3 * CAST((x & s) > 0 AS BIGINT), CAST((y & s) > 0 AS BIGINT)) FROM h WHERE s > 0)
SELECT x0 AS x, y0 AS y, d + 1365 AS tile_id FROM h WHERE s = 0"""


@register("tile_sort", HILBERT)
def tile_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _assigned(spark, sf_dir).select("z", "x", "y").distinct()
    return t.select("x", "y", pmtiles.zxy_columns(F.col("z"), F.col("x"), F.col("y")).alias("tile_id")).orderBy("tile_id")


@register("rle_expand", "SELECT o_orderkey * 10 + i AS tile_id, o_orderkey FROM (SELECT o_orderkey, unnest(generate_series(0, o_orderkey % 5)) AS i FROM orders)")
def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 10).alias("tile_id"), (F.col("o_orderkey") % 5 + 1).alias("run_length"), "o_orderkey")
    return pmtiles.expand_runs(o).select("tile_id", "o_orderkey")


def event_tiles(spark: SparkSession, sf_dir: str, z: int = 4) -> DataFrame:
    """The events as vector tiles (tile_id, z, x, y, data): points in layers by type, with all of their tags.

    Rows are dealt and sorted as they are in the table and encoded as they come; partitions hold ascending, disjoint ranges of ids.
    """
    x, y = spatial.tile_of(F.col("lon"), F.col("lat"), z)
    fx, fy = spatial.tile_coordinates(F.col("lon"), F.col("lat"), z)
    f = features(spark, sf_dir).withColumns({"x": x, "y": y, "px": F.round((fx - x) * mvt.EXTENT).cast("long"), "py": F.round((fy - y) * mvt.EXTENT).cast("long")})
    ids = F.lit([pmtiles.tile_id(z, i, j) for i in range(2**z) for j in range(2**z)])  # a fold over bits for each event would take longer than the rest
    f = f.withColumn("tile_id", F.get(ids, F.col("x") * 2**z + F.col("y")).cast("long")).repartitionByRange("tile_id").sortWithinPartitions("tile_id", "event_type", "event_id")
    zig = lambda c: F.when(c >= 0, c * 2).otherwise(-c * 2 - 1)
    kinds = dict(p.split(":") for p in V.MVT_VALUE[7:-1].replace("decimal(20,0)", "decimal").split(","))
    value = lambda slot, c: F.struct(*((F.col(c) if n == slot else F.lit(None)).cast(kind if kind != "decimal" else "decimal(20,0)").alias(n) for n, kind in kinds.items()))
    tag = lambda slot, c: F.struct(F.lit(c).alias("key"), value(slot, c).alias("value"))
    slots = {"event_type": "string_value", "user_id": "uint_value", "value": "double_value", "k": "sint_value", "big": "bool_value", "opt_k": "int_value", "opt_name": "string_value"}
    tags = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), tag(s, c)) for c, s in slots.items()))))
    shape = F.array(F.lit(mvt.MOVE_TO | 1 << 3).cast("long"), zig(F.col("px")), zig(F.col("py")))
    return tiles.encode_features(f.select("tile_id", F.lit(z).alias("z"), "x", "y", F.col("event_type").alias("layer"), F.col("event_id").cast("decimal(20,0)").alias("id"), F.lit(mvt.POINT).alias("kind"), shape.alias("geometry"), tags.alias("tags")))


def _ids(filtered: DataFrame) -> DataFrame:
    rows = tiles.features(tiles.decode_tiles(filtered))
    tag = lambda name, slot: F.try_element_at("tags", F.lit(name))[slot]
    return rows.select(F.col("id").cast("long").alias("event_id"), "layer", tag("k", "sint_value").alias("k"), tag("user_id", "uint_value").cast("long").alias("user_id"), tag("opt_name", "string_value").alias("opt_name"))


@register("mvt_roundtrip", EV + "SELECT event_id, event_type AS layer, k, user_id, opt_name FROM ev")
def mvt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(event_tiles(spark, sf_dir))


@register("tile_identity", ORACLES["mvt_roundtrip"])
def tile_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without filters tiles are only encoded anew."""
    return _ids(tiles.filter_tiles(event_tiles(spark, sf_dir)))


@register(
    "empty_layers_stay",
    EV + "SELECT layer, count(*) AS n_tiles, CAST(sum(n) AS BIGINT) AS n_features, count(*) FILTER (WHERE n = 0) AS n_empty FROM (SELECT event_type AS layer, count(*) FILTER (WHERE NOT (event_type = 'view' OR event_type = 'click' AND k >= 20)) AS n FROM ev "
    "GROUP BY event_type, greatest(0, least(15, floor((lon + 180) / 360 * 16))), greatest(0, least(15, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16)))) GROUP BY layer",
)
def empty_layers_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and tiles of which no feature stays are kept."""
    rules = collection((WORLD, {"view": {"feature": True}, "click": {"feature": [">=", T("k"), 20]}}))
    kept = tiles.decode_tiles(tiles.filter_tiles(event_tiles(spark, sf_dir), rules)).select("tile_id", "layer_no", F.posexplode("layers").alias("at", "l"))
    whole = kept.groupBy("tile_id", (F.col("layer_no") + F.col("at")).alias("no"), F.col("l.name").alias("layer")).agg(F.sum(F.size("l.features")).alias("n"))
    n = F.col("n")
    return whole.groupBy("layer").agg(F.count("*").alias("n_tiles"), F.sum(n).alias("n_features"), F.count_if(n == 0).alias("n_empty"))


TILE_RULES = ((RECT, {"*": {"feature": ["in", T("event_type"), ["literal", ["click", "error"]]], "tag": ["==", ["key"], "opt_name"]}}), (WORLD, {"view": {"feature": ["<", T("k"), 50], "tag": ["all", ["==", ["key"], "user_id"], [">", T("value"), 100]]}}))


@register(
    "tile_filter",
    EV + "SELECT event_id, event_type AS layer, k, CASE WHEN NOT (event_type = 'view' AND value > 100) THEN user_id END AS user_id, "
    "CASE WHEN NOT (lon BETWEEN -60.005 AND 90.005 AND lat BETWEEN -30.005 AND 45.005) THEN opt_name END AS opt_name "
    "FROM ev WHERE NOT (event_type IN ('click', 'error') AND lon BETWEEN -60.005 AND 90.005 AND lat BETWEEN -30.005 AND 45.005) AND NOT (event_type = 'view' AND k < 50)",
)
def tile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(tiles.filter_tiles(event_tiles(spark, sf_dir), collection(*TILE_RULES)))


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and executors share, where one is named. Archives are files: it must be mounted."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    if "://" in top.removeprefix("file://"):
        raise ValueError(f"archives need a folder in the file system, not {top}")
    path = f"{top.removeprefix('file://')}/archives-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


@register("pmtiles_roundtrip", ORACLES["tile_filter"])
def pmtiles_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _shared_folder(spark)
    header = pmtiles.Header(min_zoom=4, max_zoom=4)
    pmtiles.write_archive(event_tiles(spark, sf_dir), f"{top}/in.pmtiles", header, apply_overrides("{}", name="events"), ordered=True)
    pmtiles.write_archive(tiles.filter_tiles(pmtiles.read_archive(spark, f"{top}/in.pmtiles"), collection(*TILE_RULES)), f"{top}/out.pmtiles", pmtiles.read_header(f"{top}/in.pmtiles"), pmtiles.read_metadata(f"{top}/in.pmtiles"), ordered=True)
    return _ids(pmtiles.read_archive(spark, f"{top}/out.pmtiles"))


@register(
    "archive_header",
    "SELECT CAST(1 AS INTEGER) AS tile_type, CAST(2 AS INTEGER) AS tile_compression, CAST(4 AS INTEGER) AS min_zoom, CAST(4 AS INTEGER) AS max_zoom, -10.5::DOUBLE AS min_lon, -20.25::DOUBLE AS min_lat, 30.125::DOUBLE AS max_lon, 40.0::DOUBLE AS max_lat, 'events' AS name, 'all of them' AS description, n_tiles, n_entries "
    "FROM (SELECT count(*) AS n_tiles, count(*) AS n_entries FROM (" + EV + "SELECT DISTINCT greatest(0, least(15, floor((lon + 180) / 360 * 16))), greatest(0, least(15, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16))) FROM ev))",
)
def archive_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, metadata and directory of an archive, as they are read back."""
    path = f"{_shared_folder(spark)}/in.pmtiles"
    header = pmtiles.Header(min_zoom=4, max_zoom=4, min_lon=-10.5, min_lat=-20.25, max_lon=30.125, max_lat=40.0)
    pmtiles.write_archive(event_tiles(spark, sf_dir), path, header, apply_overrides('{"name": "old"}', name="events", description="all of them"), ordered=True)
    entries = pmtiles.read_entries(path)
    found = pmtiles.header_frame(spark, path).select("tile_type", "tile_compression", "min_zoom", "max_zoom", "min_lon", "min_lat", "max_lon", "max_lat", F.from_json("metadata", "name string, description string").alias("m"))
    counts = F.lit(sum(e.run_length for e in entries)).cast("long").alias("n_tiles"), F.lit(len(entries)).cast("long").alias("n_entries")
    return found.select(*found.columns[:-1], "m.*", *counts)


@register("metadata_override", "SELECT 'new' AS name, 'kept' AS description, CAST(1 AS BIGINT) AS extra")
def metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = apply_overrides('{"name": "old", "description": "kept", "extra": 1}', name="new")
    return spark.createDataFrame([(doc,)], "doc string").select(F.from_json("doc", "name string, description string, extra long").alias("d")).select("d.*")


@register("flagship", _pairs("lon BETWEEN -60.005 AND 90.005 AND lat BETWEEN -30.005 AND 45.005 AND event_type IN ('error', 'signup') OR " + _inside(KITE["coordinates"][0]) + " AND event_type = 'click' AND k < 30", "starts_with(key, 'opt_')").replace("SELECT event_id, key, value", "SELECT event_id, event_type AS layer, key, value"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks and a rule for tags: the tags that stay of the features that stay."""
    v = view(spark, sf_dir, (RECT, {"*": {"feature": ["in", T("event_type"), ["literal", ["error", "signup"]]]}}), (KITE, {"click": {"feature": ["<", T("k"), 30]}}), (WORLD, {"*": {"tag": ["starts-with", ["key"], "opt_"]}}))
    v.kinds = {k: kind for k, kind in KINDS.items() if k != "value"}
    return v.tag_rows(["event_id", "event_type"]).withColumnRenamed("event_type", "layer")
