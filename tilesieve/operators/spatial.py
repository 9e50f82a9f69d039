"""Tiles and masks as Columns: tile numbers, bounds, projection, boxes, and points in polygons."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilesieve.functions.geometry import Box, Geometry, closed, slope

#: Polygons of at most so many edges become one expression; larger ones a fold over an array of edges.
INLINE_EDGES = 64


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """west, south, east and north of a tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda row: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * row / n))))
    return {"west": x / n * 360 - 180, "south": lat(y + 1), "east": (x + 1) / n * 360 - 180, "north": lat(y)}


def tile_of(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point."""
    n = 2**z
    x, y = tile_coordinates(lon, lat, z)
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    return inside(x), inside(y)


def tile_coordinates(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Fractional column and row of a point in the grid of zoom z."""
    n = float(2**z)
    phi = F.radians(F.greatest(F.lit(-89.9999999), F.least(F.lit(89.9999999), lat)))
    return (lon + 180) / 360 * n, (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n


def tile_key(z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", z, x, y)


def boxes_meet(a: dict[str, Column], b: Box) -> Column:
    """Whether a rectangle of Columns (west, south, east, north) meets a constant box; borders count."""
    w, s, e, n = b
    return (a["west"] <= e) & (a["east"] >= w) & (a["south"] <= n) & (a["north"] >= s)


def _edges(g: Geometry) -> list[list[tuple[float, float, float, float]]]:
    return [[(*map(float, p), *map(float, q)) for r in rings for p, q in zip(closed(r), closed(r)[1:])] for rings in g.polygons]


def _on_edge(x: Column, y: Column, ax, ay, bx, by) -> Column:
    least, most = (min, max) if isinstance(ax, float) else (F.least, F.greatest)
    return ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (x >= least(ax, bx)) & (x <= most(ax, bx)) & (y >= least(ay, by)) & (y <= most(ay, by))


def _crosses(x: Column, y: Column, ax, ay, bx, by) -> Column:
    """Whether a ray to the east crosses the edge."""
    if ay == by:
        return F.lit(False)
    return (y >= min(ay, by)) & (y < max(ay, by)) & (x < (y - ay) * slope(ax, ay, bx, by) + ax)


def point_in(g: Geometry, x: Column, y: Column) -> Column | None:
    """Whether a point (Columns that are not NULL) meets a constant geometry; None if that is empty.

    The box is tested first; polygons count by the even-odd rule, edges included.
    """
    box = g.box()
    if box is None:
        return None
    gate = (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
    hits: list[Column] = [(x == px) & (y == py) for px, py in g.points.tolist()]
    hits += [_on_edge(x, y, *s) for s in Geometry(lines=g.lines).segments().tolist()]
    for edges in _edges(g):
        if len(edges) <= INLINE_EDGES:
            odd = functools.reduce(operator.add, [_crosses(x, y, *e).cast("int") for e in edges], F.lit(0)) % 2 == 1
            hits.append(odd | functools.reduce(operator.or_, [_on_edge(x, y, *e) for e in edges], F.lit(False)))
        else:
            # the same arithmetic as in one expression, so that a polygon's size decides nothing
            named = ("ax", "ay", "bx", "by", "low", "high", "slope")
            whole = [(*e, min(e[1], e[3]), max(e[1], e[3]), slope(*e)) for e in edges]
            listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(named, e))) for e in whole))
            ends = lambda e: (e["ax"], e["ay"], e["bx"], e["by"])
            count = F.aggregate(listed, F.lit(0), lambda acc, e: acc + ((y >= e["low"]) & (y < e["high"]) & (x < (y - e["ay"]) * e["slope"] + e["ax"])).cast("int"))
            hits.append((count % 2 == 1) | F.exists(listed, lambda e: _on_edge(x, y, *ends(e))))
    return gate & functools.reduce(operator.or_, hits) if hits else None
