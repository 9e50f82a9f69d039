"""Planar geometry: reading, bounding boxes, Web Mercator tiles and exact intersection tests.

Tests include boundaries: a point on an edge, touching edges and shared corners all intersect.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np

#: Fixed value: stands for infinity in projected coordinates, so that products with it stay numbers.
FAR = 1e12

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Geometry:
    """Points (n x 2), lines (each n x 2) and polygons (each a list of rings, the outer one first)."""

    points: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    lines: tuple[np.ndarray, ...] = ()
    polygons: tuple[tuple[np.ndarray, ...], ...] = ()

    def vertices(self) -> np.ndarray:
        parts = [self.points, *self.lines, *(r for p in self.polygons for r in p)]
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    def box(self) -> Box | None:
        """West, south, east, north; None for an empty geometry."""
        v = self.vertices()
        return (*v.min(axis=0).tolist(), *v.max(axis=0).tolist()) if len(v) else None

    def map(self, f: Callable[[np.ndarray], np.ndarray]) -> "Geometry":
        return Geometry(f(self.points), tuple(map(f, self.lines)), tuple(tuple(map(f, p)) for p in self.polygons))

    def segments(self) -> np.ndarray:
        """All edges, n x 4."""
        runs = [*self.lines, *(closed(r) for p in self.polygons for r in p)]
        parts = [np.hstack([r[:-1], r[1:]]) for r in runs if len(r) > 1]
        return np.concatenate(parts) if parts else np.zeros((0, 4))


def closed(ring: np.ndarray) -> np.ndarray:
    return ring if not len(ring) or (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def _array(coords: Any) -> np.ndarray:
    out = np.array([p[:2] for p in coords], dtype=float).reshape(-1, 2)
    if not np.isfinite(out).all():
        raise ValueError("coordinates must be finite")
    return out


def from_geojson(doc: dict) -> Geometry:
    """Any GeoJSON geometry, collections included; raises ValueError for anything else."""
    try:
        kind = doc["type"]
        if kind == "GeometryCollection":
            parts = [from_geojson(g) for g in doc["geometries"]]
            return Geometry(np.concatenate([np.zeros((0, 2)), *(p.points for p in parts)]), tuple(x for p in parts for x in p.lines), tuple(x for p in parts for x in p.polygons))
        c = doc["coordinates"]
        if kind == "Point":
            return Geometry(points=_array([c] if c else []))
        if kind == "MultiPoint":
            return Geometry(points=_array(c))
        if kind == "LineString":
            return Geometry(lines=(_array(c),))
        if kind == "MultiLineString":
            return Geometry(lines=tuple(map(_array, c)))
        if kind == "Polygon":
            return Geometry(polygons=(tuple(map(_array, c)),) if c else ())
        if kind == "MultiPolygon":
            return Geometry(polygons=tuple(tuple(map(_array, p)) for p in c))
    except (KeyError, TypeError, IndexError) as e:
        raise ValueError(f"not a GeoJSON geometry: {e!r}") from None
    raise ValueError(f"unknown geometry type {kind!r}")


def box_geometry(box: Box) -> Geometry:
    w, s, e, n = box
    return Geometry(polygons=((np.array([[w, s], [e, s], [e, n], [w, n], [w, s]], dtype=float),),))


def boxes_meet(a: Box | None, b: Box | None) -> bool:
    return a is not None and b is not None and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


class BoxIndex:
    """Boxes by number, sorted by their western edge; a search looks at those alone that begin early enough.

    Empty geometries have no box and are never found.
    """

    def __init__(self, boxes: Sequence[Box | None]):
        known = [(k, b) for k, b in enumerate(boxes) if b is not None]
        order = sorted(known, key=lambda kb: kb[1][0])
        self.numbers = np.array([k for k, _ in order], dtype=np.int64)
        self.boxes = np.array([b for _, b in order], dtype=float).reshape(-1, 4)

    def meeting(self, box: Box) -> list[int]:
        """Numbers of the boxes that meet a box, borders included, in order."""
        n = int(np.searchsorted(self.boxes[:, 0], box[2], side="right"))
        b = self.boxes[:n]
        hit = (b[:, 2] >= box[0]) & (b[:, 1] <= box[3]) & (b[:, 3] >= box[1])
        return sorted(self.numbers[:n][hit].tolist())


def tile_bounds(z: int, x: int, y: int) -> Box:
    """The tile's rectangle in degrees."""
    n = 2.0**z
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def to_tile(g: Geometry, z: int, x: int, y: int, extent: int) -> Geometry:
    """Degrees to the tile's own coordinates, vertex by vertex; the poles are far, but not infinitely so."""
    n = 2.0**z

    def project(v: np.ndarray) -> np.ndarray:
        if not len(v):
            return v
        phi = np.radians(v[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            merc = np.log(np.tan(phi) + 1 / np.cos(phi))
        merc = np.where(v[:, 1] <= -90, -np.inf, np.where(v[:, 1] >= 90, np.inf, merc))
        rows = ((1 - merc / math.pi) / 2 * n - y) * extent
        cols = ((v[:, 0] + 180) / 360 * n - x) * extent
        return np.clip(np.column_stack([cols, rows]), -FAR, FAR)

    return g.map(project)


def _orient(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _on_segments(p: np.ndarray, s: np.ndarray) -> bool:
    """Whether any of the points lies on any of the segments."""
    if not len(p) or not len(s):
        return False
    px, py = p[:, 0, None], p[:, 1, None]
    ax, ay, bx, by = s.T
    inside = (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))
    return bool((inside & (_orient(ax, ay, bx, by, px, py) == 0)).any())


def _segments_meet(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    for k in range(0, len(a), 256):  # bounded blocks of the pairs
        ax, ay, bx, by = (a[k : k + 256, i, None] for i in range(4))
        cx, cy, dx, dy = b.T
        near = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
        if not near.any():
            continue
        split = (_orient(ax, ay, bx, by, cx, cy) * _orient(ax, ay, bx, by, dx, dy) <= 0) & (_orient(cx, cy, dx, dy, ax, ay) * _orient(cx, cy, dx, dy, bx, by) <= 0)
        if (near & split).any():
            return True
    return False


def slope(ax: float, ay: float, bx: float, by: float) -> float:
    """Change of x with y along an edge; 0 for a level one, which no ray crosses. Whatever tells inside from outside uses this."""
    return 0.0 if ay == by else (bx - ax) / (by - ay)


def in_polygon(p: Sequence[float], rings: Iterable[np.ndarray]) -> bool:
    """Inside by the even-odd rule over all rings, or on an edge."""
    x, y = p
    odd = False
    for ring in rings:
        r = closed(ring)
        if len(r) < 2:
            continue
        ax, ay, bx, by = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        if _on_segments(np.array([[x, y]]), np.hstack([r[:-1], r[1:]])):
            return True
        spans = (ay > y) != (by > y)
        at = (y - ay) * np.array([slope(*e) for e in zip(ax.tolist(), ay.tolist(), bx.tolist(), by.tolist())]) + ax
        odd ^= bool((spans & (x < at)).sum() % 2)
    return odd


def points_meet(p: np.ndarray, g: Geometry) -> np.ndarray:
    """For each of many points what `intersects` says of it alone, by the same arithmetic."""
    out = np.zeros(len(p), bool)
    box = g.box()
    if box is None:
        return out
    near = np.flatnonzero((p[:, 0] >= box[0]) & (p[:, 0] <= box[2]) & (p[:, 1] >= box[1]) & (p[:, 1] <= box[3]))
    segments = g.segments()
    step = max(1, (1 << 18) // max(1, len(segments), len(g.points)))
    for k in range(0, len(near), step):
        w = near[k : k + step]
        x, y = p[w, 0, None], p[w, 1, None]
        hit = np.zeros(len(w), bool)
        if len(g.points):
            hit |= ((x == g.points[:, 0]) & (y == g.points[:, 1])).any(axis=1)
        if len(segments):
            ax, ay, bx, by = segments.T
            inside = (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
            hit |= (inside & (_orient(ax, ay, bx, by, x, y) == 0)).any(axis=1)
        for rings in g.polygons:
            odd = np.zeros(len(w), bool)
            for ring in rings:
                r = closed(ring)
                if len(r) < 2:
                    continue
                ax, ay, bx, by = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
                at = (y - ay) * np.array([slope(*e) for e in zip(ax.tolist(), ay.tolist(), bx.tolist(), by.tolist())]) + ax
                odd ^= (((ay > y) != (by > y)) & (x < at)).sum(axis=1) % 2 == 1
            hit |= odd
        out[w] = hit
    return out


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether two geometries have a point in common."""
    if not boxes_meet(a.box(), b.box()):
        return False
    if len(a.points) and len(b.points) and (a.points[:, None, :] == b.points[None, :, :]).all(axis=2).any():
        return True
    sa, sb = a.segments(), b.segments()
    if _on_segments(a.points, sb) or _on_segments(b.points, sa) or _segments_meet(sa, sb):
        return True
    # no edges meet: one part can still lie inside a polygon as a whole
    for one, other in ((a, b), (b, a)):
        firsts = [*one.points, *(r[0] for r in one.lines if len(r)), *(p[0][0] for p in one.polygons if p and len(p[0]))]
        for rings in other.polygons:
            if any(in_polygon(p, rings) for p in firsts):
                return True
    return False
