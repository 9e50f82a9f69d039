"""Filter documents: GeoJSON feature collections whose features are masks with rules for layers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilesieve.functions.geometry import BoxIndex, Geometry, from_geojson
from tilesieve.plans.expressions import rule as compiled
from tilesieve.plans.expressions import Context, Node, parse

#: Fixed value: the layer name that stands for every layer.
ANY_LAYER = "*"


class FilterError(ValueError):
    """A filter document that can't be read."""


@dataclass(frozen=True)
class LayerRule:
    """Checked expressions of a layer: features for which `feature` holds go, tags for which `tag` holds too."""

    feature: Node | None = None
    tag: Node | None = None


@dataclass(frozen=True)
class Filter:
    """A mask with its rules by layer name."""

    geometry: Geometry
    layers: dict[str, LayerRule] = field(default_factory=dict)
    id: str | None = None
    description: str | None = None

    def rule(self, slot: str, layer: Column, context: Context) -> Column | None:
        """Whether the rule of a feature's layer holds; None if no layer has this slot.

        A layer without the slot falls back to the rule for any layer, slot by slot.
        """
        own = {name: compiled(node, context) for name, r in self.layers.items() if name != ANY_LAYER and (node := getattr(r, slot)) is not None}
        general = getattr(self.layers.get(ANY_LAYER, LayerRule()), slot)
        default = F.lit(False) if general is None else compiled(general, context)
        if not own:
            return None if general is None else default
        out: Column | None = None
        for name, hit in own.items():
            out = F.when(layer == name, hit) if out is None else out.when(layer == name, hit)
        return out.otherwise(default)


def _get(doc: Any, name: str, kind: type | tuple[type, ...], where: str, optional: bool = False) -> Any:
    x = doc.get(name) if isinstance(doc, dict) else None
    if x is None and optional:
        return None
    if not isinstance(x, kind):
        raise FilterError(f"{where}: {name!r} is missing or of the wrong type")
    return x


@dataclass(frozen=True)
class FilterCollection:
    """The filters of a document, in order."""

    filters: tuple[Filter, ...]

    @classmethod
    def from_json(cls, doc: dict | str | bytes, extensions: bool = False) -> "FilterCollection":
        """Reads and checks a whole document; the first error ends it."""
        if isinstance(doc, (str, bytes)):
            doc = json.loads(doc)
        _get(doc, "type", str, "document")
        out = []
        for k, item in enumerate(_get(doc, "features", list, "document")):
            where = f"feature {k}"
            _get(item, "type", str, where)
            about = _get(item, "properties", dict, where)
            layers = {}
            for name, rule in _get(about, "layers", dict, where).items():
                if not isinstance(rule, dict):
                    raise FilterError(f"{where}: layer {name!r} must be an object")
                layers[name] = LayerRule(*(None if rule.get(slot) is None else parse(rule[slot], extensions) for slot in ("feature", "tag")))
            geometry = from_geojson(_get(item, "geometry", dict, where))
            out.append(Filter(geometry, layers, _get(about, "id", str, where, optional=True), _get(about, "description", str, where, optional=True)))
        return cls(tuple(out))

    @classmethod
    def from_file(cls, path: str, extensions: bool = False) -> "FilterCollection":
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read(), extensions)

    def drop_feature(self, layer: Column, context: Context, within: Callable[[int, Filter], Column | None]) -> Column:
        """Whether any filter whose mask a feature meets drops it; within gives that test, None for never."""
        return self._any("feature", layer, context, within)

    def drop_tag(self, layer: Column, context: Context, within: Callable[[int, Filter], Column | None]) -> Column:
        """Whether any filter whose mask the feature meets drops the tag of the context's key."""
        return self._any("tag", layer, context, within)

    def _any(self, slot: str, layer: Column, context: Context, within: Callable[[int, Filter], Column | None]) -> Column:
        out: Column | None = None
        for k, f in enumerate(self.filters):
            rule = f.rule(slot, layer, context)
            where = None if rule is None else within(k, f)
            if where is not None:
                out = where & rule if out is None else out | where & rule
        return F.lit(False) if out is None else out

    @cached_property
    def index(self) -> BoxIndex:
        """The masks' boxes."""
        return BoxIndex([f.geometry.box() for f in self.filters])

    def layers(self) -> Sequence[str]:
        return sorted({name for f in self.filters for name in f.layers})
