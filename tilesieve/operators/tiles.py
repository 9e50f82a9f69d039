"""Filtering of vector tiles: decode, match masks, drop features and tags, encode.

Nothing is shuffled between decoding and encoding: a decoded tile is one row, or several parts of a
bounded size one after the other, with an array of layers with arrays of features, in which rules are
evaluated by Spark's array and map functions. Python decodes and encodes messages as flat arrays and
tests which masks a feature's geometry meets. Of a large tile its message alone is in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesieve.functions.geometry import Geometry, box_geometry, boxes_meet, intersects, points_meet, tile_bounds, to_tile
from tilesieve.functions.values import MVT_VALUE, SLOTS
from tilesieve.plans.expressions import Context
from tilesieve.plans.filters import Filter, FilterCollection
from tilesieve.sources import mvt

#: Geometry types as filters name them.
KINDS = {mvt.POINT: "Point", mvt.LINESTRING: "LineString", mvt.POLYGON: "Polygon"}

FEATURE = f"struct<id:decimal(20,0),kind:int,geometry:array<bigint>,tags:map<string,{MVT_VALUE}>,masks:array<int>>"
LAYERS = f"array<struct<name:string,version:int,extent:int,features:array<{FEATURE}>>>"

_VALUE = pa.struct([("string_value", pa.string()), ("float_value", pa.float32()), ("double_value", pa.float64()), ("int_value", pa.int64()), ("uint_value", pa.decimal128(20, 0)), ("sint_value", pa.int64()), ("bool_value", pa.bool_())])
_FEATURE = pa.struct([("id", pa.decimal128(20, 0)), ("kind", pa.int32()), ("geometry", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), _VALUE)), ("masks", pa.list_(pa.int32()))])
_LAYERS = pa.list_(pa.struct([("name", pa.string()), ("version", pa.int32()), ("extent", pa.int32()), ("features", pa.list_(_FEATURE))]))


#: Features of a part of a tile: what a row between decoding and encoding holds at most.
PART = 2048

#: Bytes that go to or from a Python worker at once; a row that is longer is a batch of its own. Results don't depend on it.
BATCH_BYTES = 4 << 20


def _in_python(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of at most BATCH_BYTES; Spark's own bound of 64 MB is held by each worker. Rows are computed later, so the session keeps the setting."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def _decimals(numbers: np.ndarray, there: np.ndarray) -> pa.Array:
    """Unsigned numbers as decimal(20,0), missing where they are not there."""
    wide = np.zeros((len(numbers), 2), "<u8")
    wide[:, 0] = numbers
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(numbers), [pa.py_buffer(np.packbits(there, bitorder="little")), pa.py_buffer(wide)])


def _unsigned(column: pa.Array) -> np.ndarray:
    """What _decimals made, missing ones as 0."""
    held = column.buffers()[1]
    wide = np.frombuffer(held, "<u8").reshape(-1, 2)[column.offset : column.offset + len(column), 0] if held else np.zeros(len(column), "<u8")
    return np.where(_there(column), wide, np.uint64(0))


def _there(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _parts(array: pa.ListArray | pa.MapArray) -> np.ndarray:
    """The bounds of a list array's entries in its values."""
    return array.offsets.to_numpy().astype(np.int64)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(mvt.starts_of(counts).astype(np.int32))


def _struct(arrays: list[pa.Array], kind: pa.StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays(arrays, fields=[kind.field(k) for k in range(kind.num_fields)])


def _value_table(values: list[mvt.Tag | None]) -> pa.StructArray:
    """A layer's table of values as structs of slots."""
    held: dict[str, tuple[list[int], list]] = {f.name: ([], []) for f in _VALUE}
    for k, tag in enumerate(values):
        if tag is not None:
            held[tag[0]][0].append(k)
            held[tag[0]][1].append(tag[1])
    slots = []
    for f in _VALUE:
        where, found = held[f.name]
        if f.name == "uint_value":
            numbers, there = np.zeros(len(values), np.uint64), np.zeros(len(values), bool)
            numbers[where], there[where] = np.array(found, np.uint64), True
            slots.append(_decimals(numbers, there))
        elif where:
            at = np.full(len(values), -1)
            at[where] = np.arange(len(where))
            slots.append(pa.array(found, f.type).take(pa.array(at, mask=at < 0)))
        else:
            slots.append(pa.nulls(len(values), f.type))
    return _struct(slots, _VALUE)


class _Masks:
    """The masks of the filters that count for a tile."""

    def __init__(self, z: int, x: int, y: int, filters: FilterCollection | None):
        bounds = tile_bounds(z, x, y)
        square = box_geometry(bounds)
        self.tile = z, x, y
        self.near = [(k, filters.filters[k]) for k in filters.index.meeting(bounds) if intersects(filters.filters[k].geometry, square)] if filters else []
        self.projected: dict[int, list] = {}

    def of_layer(self, extent: int | None) -> list[tuple[int, Geometry]]:
        """Those of which the projected box meets the square of a layer, in tile coordinates."""
        extent = mvt.EXTENT if extent is None else extent
        if extent not in self.projected:
            there = [(k, to_tile(f.geometry, *self.tile, extent)) for k, f in self.near]
            self.projected[extent] = [(k, g) for k, g in there if boxes_meet(g.box(), (0.0, 0.0, float(extent), float(extent)))]
        return self.projected[extent]

    def met(self, c: mvt.Columns, extent: int | None) -> pa.ListArray:
        """For each feature, the numbers of the filters whose masks it meets; single points are tested together."""
        masks = self.of_layer(extent)
        hits = np.zeros((len(c.ids), len(masks)), bool)
        first, count = c.geometry_at[:-1], np.diff(c.geometry_at)
        single = (c.kinds == mvt.POINT) & (count == 3)
        single[single] = c.geometry[first[single]] == (mvt.MOVE_TO | 1 << 3)
        for k in np.flatnonzero(~single).tolist():
            shape = mvt.geometry(int(c.kinds[k]), c.geometry[first[k] : first[k] + count[k]].tolist())  # a malformed geometry is an error, mask or not
            hits[k] = [intersects(shape, g) for _, g in masks]
        if masks and single.any():
            half = lambda n: (n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)
            points = np.column_stack([half(c.geometry[first[single] + d]) for d in (1, 2)]).astype(float)
            for j, (_, g) in enumerate(masks):
                hits[single, j] = points_meet(points, g)
        numbers = np.array([k for k, _ in masks], np.int32)
        return pa.ListArray.from_arrays(_offsets(hits.sum(axis=1)), pa.array(numbers[np.nonzero(hits)[1]], pa.int32()))


def masks_of(layers: list[mvt.Layer], z: int, x: int, y: int, filters: FilterCollection | None) -> list[list[list[int]]]:
    """For each layer and feature, the numbers of the filters whose masks it meets.

    A filter counts for a tile if its mask meets the tile's rectangle in degrees, and for a layer if
    the projected mask's box meets the layer's square; then features are tested in tile coordinates.
    """
    near = _Masks(z, x, y, filters)
    out = []
    for layer in layers:
        shapes = [mvt.geometry(f.kind, f.geometry) for f in layer.features]
        out.append([[k for k, g in near.of_layer(layer.extent) if intersects(s, g)] for s in shapes])
    return out


class _Decoded:
    """Rows of decoded parts, until they are enough for a batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.layers: list[tuple] = []
        self.features: list[pa.Array] = []
        self.size = 0

    def add_layer(self, layer: mvt.LayerMessage, table: pa.StructArray, keys: pa.Array, c: mvt.Columns, masks: pa.ListArray) -> None:
        items = table.take(pa.array(c.values))
        tags = pa.MapArray.from_arrays(_offsets(np.diff(c.tags_at)), keys.take(pa.array(c.keys)), items)
        shapes = pa.ListArray.from_arrays(_offsets(np.diff(c.geometry_at)), pa.array(c.geometry.view(np.int64)))
        self.features.append(_struct([_decimals(c.ids, c.has_id), pa.array(c.kinds.astype(np.int64)).cast(pa.int32()), shapes, tags.cast(_FEATURE.field("tags").type), masks], _FEATURE))
        self.layers.append((layer.name, layer.version, layer.extent, len(c.ids)))
        self.size += len(c.ids)

    def add_row(self, *row: int) -> None:
        """(tile_id, z, x, y, part, layer_no, feature_no) of the layers added since the row before."""
        self.rows.append((*row, len(self.layers)))

    def batch(self) -> pa.RecordBatch:
        *columns, ends = zip(*self.rows)
        names, versions, extents, counts = zip(*self.layers) if self.layers else ((), (), (), ())
        features = pa.concat_arrays(self.features) if self.features else pa.array([], _FEATURE)
        listed = pa.ListArray.from_arrays(_offsets(np.array(counts, np.int64)), features)
        layers = _struct([pa.array(names, pa.string()), pa.array(versions, pa.int32()), pa.array(extents, pa.int32()), listed], _LAYERS.value_type)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        own = [pa.array(v, k) for v, k in zip(columns, kinds)]
        out = [*own[:4], pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), layers), *own[4:]]
        self.__init__()
        return pa.RecordBatch.from_arrays(out, names=["tile_id", "z", "x", "y", "layers", "part", "layer_no", "feature_no"])


def _decode(rows: Iterator[tuple[int, int, int, int, bytes | memoryview]], filters: FilterCollection | None) -> Iterator[pa.RecordBatch]:
    out = _Decoded()
    for i, z, x, y, data in rows:
        try:
            masks = _Masks(z, x, y, filters)
            part = layer_no = feature_no = held = 0
            for n, layer in enumerate(mvt.layers_of(data)):
                table, keys = _value_table(layer.values), pa.array(layer.keys, pa.string())
                at = 0
                while True:
                    if held == PART:
                        out.add_row(i, z, x, y, part, layer_no, feature_no)
                        part, layer_no, feature_no, held = part + 1, n, at, 0
                        if out.size >= PART:
                            yield out.batch()
                    end = min(len(layer), at + PART - held)
                    c = layer.read(at, end)
                    out.add_layer(layer, table, keys, c, masks.met(c, layer.extent))
                    held, at = held + end - at, end
                    if at == len(layer):
                        break
        except ValueError as e:
            raise mvt.TileError(f"tile {z}/{x}/{y}: {e}") from None
        out.add_row(i, z, x, y, part, layer_no, feature_no)
        if out.size >= PART or len(out.rows) >= PART:
            yield out.batch()
    if out.rows:
        yield out.batch()


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, memoryview]]:
    """The tiles of batches; messages are not copied."""
    for batch in batches:
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            yield *row, memoryview(batch.column(4)[k].as_buffer() or b"").cast("B")


def decode_tiles(tiles: DataFrame, filters: FilterCollection | None = None) -> DataFrame:
    """tiles (tile_id, z, x, y, data) to (tile_id, z, x, y, layers, part, layer_no, feature_no), features with the masks that they meet.

    A tile of more than PART features is several rows one after the other, its parts from 0 on. The first
    layer of a row is the tile's layer layer_no from its feature feature_no on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode(_messages(batches), filters)

    return _in_python(tiles.select("tile_id", "z", "x", "y", "data"), run, f"tile_id long, z int, x int, y int, layers {LAYERS}, part int, layer_no int, feature_no long")


def filter_layers(layers: Column, filters: FilterCollection) -> Column:
    """The layers without the features and tags that filters drop; empty layers stay."""

    def kept(layer: Column) -> Column:
        def context(f: Column, key: Column | None = None) -> Context:
            kind = F.when(f["kind"] == mvt.POINT, "Point").when(f["kind"] == mvt.LINESTRING, "LineString").when(f["kind"] == mvt.POLYGON, "Polygon").otherwise("Unknown")
            return Context.of_map(f["tags"], key, kind)

        def within(f: Column):
            def test(k: int, _: Filter) -> Column:
                return F.array_contains(f["masks"], k)

            return test

        stay = F.filter(layer["features"], lambda f: ~filters.drop_feature(layer["name"], context(f), within(f)))
        return F.transform(stay, lambda f: f.withField("tags", F.map_filter(f["tags"], lambda k, _: ~filters.drop_tag(layer["name"], context(f, k), within(f)))))

    return F.transform(layers, lambda layer: layer.withField("features", kept(layer)))


def _marks(tags: pa.StructArray) -> tuple[np.ndarray, list[tuple[object, mvt.Tag | None]]]:
    """For each tag the number of its value, and the values in order of first use, each with what tells it from others.

    The bits tell floats apart, zeros aside; a NaN equals no other value, itself included.
    """
    code = np.full(len(tags), -1)
    base, values = 0, []
    for slot in SLOTS:
        child = tags.field(slot)
        w = np.flatnonzero(_there(child) & (code < 0))
        if not len(w):
            continue
        held = child.take(pa.array(w))
        if slot in ("float_value", "double_value"):
            numbers = held.to_numpy(zero_copy_only=False)
            bits = np.where(numbers == 0, numbers.dtype.type(0), numbers).view(np.int32 if slot == "float_value" else np.int64)
            nan = np.isnan(numbers)
            coded = pa.array(bits).dictionary_encode()
            own = coded.indices.to_numpy().astype(np.int64)
            first = _first_uses(own, len(coded.dictionary))
            marks = list(zip(((slot, b) for b in coded.dictionary.to_pylist()), ((slot, v) for v in numbers[first].tolist())))
            own[nan] = len(marks) + np.arange(int(nan.sum()))
            marks += [(object(), (slot, v)) for v in numbers[nan].tolist()]
        else:
            coded = (pa.array(_unsigned(held)) if slot == "uint_value" else held).dictionary_encode()
            own = coded.indices.to_numpy().astype(np.int64)
            marks = [((slot, v), (slot, v)) for v in coded.dictionary.to_pylist()]
        code[w] = base + own
        base += len(marks)
        values += marks
    if (code < 0).any():
        code[code < 0] = base
        values.append((None, None))
    first = _first_uses(code, len(values))
    order = np.argsort(first, kind="stable")
    order = order[first[order] < len(code)]
    rank = np.zeros(len(values), np.int64)
    rank[order] = np.arange(len(order))
    return rank[code], [values[k] for k in order.tolist()]


def _first_uses(code: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes stands first; len(code) if nowhere."""
    first = np.full(n, len(code))
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first


class _Features:
    """Columns (id, kind, geometry, tags) of features, of which runs go to the writer of a layer."""

    def __init__(self, ids: pa.Array, kinds: pa.Array, shapes: pa.ListArray, tags: pa.MapArray):
        self.ids, self.has_id = _unsigned(ids), _there(ids)
        self.kinds = kinds.fill_null(0).to_numpy()
        self.geometry, self.geometry_at = shapes.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), _parts(shapes)
        self.keys, self.values, self.tags_at = tags.keys, tags.items, _parts(tags)

    def write(self, to: mvt.LayerWriter, a: int, b: int) -> None:
        for k in range(a, b, PART):
            self._write(to, k, min(b, k + PART))

    def _write(self, to: mvt.LayerWriter, a: int, b: int) -> None:
        first, last = int(self.tags_at[a]), int(self.tags_at[b])
        names = self.keys.slice(first, last - first).dictionary_encode()
        code, values = _marks(self.values.slice(first, last - first))
        keys, there = to.places(names.dictionary.to_pylist(), values)
        shape = self.geometry_at[a : b + 1]
        to.add(
            mvt.Columns(
                self.ids[a:b], self.has_id[a:b], self.kinds[a:b], self.geometry[shape[0] : shape[-1]], shape - shape[0],
                keys[names.indices.to_numpy()], there[code], self.tags_at[a : b + 1] - first,
            )
        )


class _Encoded:
    """Messages of tiles of which features come in order; one tile is open at a time."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0
        self.tile: tuple | None = None
        self.layer: mvt.LayerWriter | None = None
        self.name: object = None
        self.layers: list[bytes] = []

    def open_layer(self, mark: object, name: str, version: int, extent: int | None) -> mvt.LayerWriter:
        """The writer of the open tile's layer that is known by mark; the layer before it is done."""
        if self.layer is None or self.name != mark:
            self.close_layer()
            self.layer, self.name = mvt.LayerWriter(name, version, extent), mark
        return self.layer

    def close_layer(self) -> None:
        if self.layer is not None:
            self.layers.append(self.layer.message())
            self.layer = None

    def open_tile(self, tile: tuple) -> None:
        self.close_tile()
        self.tile = tile

    def close_tile(self) -> None:
        self.close_layer()
        if self.tile is not None:
            data = self.layers[0] if len(self.layers) == 1 else b"".join(self.layers)
            self.layers = []
            self.rows.append((*self.tile, data))
            self.size += len(data)
            self.tile = None

    def batches(self, least: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
        if self.rows and (self.size >= least or len(self.rows) >= PART):
            columns = [pa.array(v, k) for v, k in zip(zip(*self.rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, names=["tile_id", "z", "x", "y", "data"])


def _encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Encoded()
    for batch in batches:
        column = batch.column(4)
        layers = column.values
        lists = layers.field("features")
        rows = lists.values
        features = _Features(*(rows.field(c) for c in ("id", "kind", "geometry", "tags")))
        about = list(zip(*(layers.field(c).to_pylist() for c in ("name", "version", "extent"))))
        tiles, own = _parts(column).tolist(), _parts(lists).tolist()
        for k, (i, z, x, y, part, layer_no) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)))):
            if part == 0:
                out.open_tile((i, z, x, y))
                yield from out.batches()
            for n in range(tiles[k], tiles[k + 1]):
                features.write(out.open_layer(layer_no + n - tiles[k], *about[n]), own[n], own[n + 1])
    out.close_tile()
    yield from out.batches(0)


def encode_tiles(tiles: DataFrame) -> DataFrame:
    """(tile_id, z, x, y, layers) back to (tile_id, z, x, y, data); the parts of a tile, where there are any, as decode_tiles has them."""
    own = ["part", "layer_no"] if "part" in tiles.columns else [F.lit(0).alias("part"), F.lit(0).alias("layer_no")]
    return _in_python(tiles.select("tile_id", "z", "x", "y", "layers", *own), _encode_parts, "tile_id long, z int, x int, y int, data binary")


def encode_features(rows: DataFrame, version: int = 2, extent: int = mvt.EXTENT) -> DataFrame:
    """Tiles (tile_id, z, x, y, data) of features (tile_id, z, x, y, layer, id, kind, geometry, tags).

    A partition has the whole of each of its tiles, and features in order of tiles and layers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Encoded()
        for batch in batches:
            if not batch.num_rows:
                continue
            features = _Features(*batch.columns[5:9])
            ids, names = batch.column(0).to_numpy(), batch.column(4).dictionary_encode()
            code = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                tile = tuple(batch.column(c)[a].as_py() for c in range(4))
                if tile != out.tile:
                    out.open_tile(tile)
                    yield from out.batches()
                name = names.dictionary[code[a]].as_py()
                features.write(out.open_layer(name, name, version, extent), a, b)
        out.close_tile()
        yield from out.batches(0)

    return _in_python(rows.select("tile_id", "z", "x", "y", "layer", "id", "kind", "geometry", "tags"), run, "tile_id long, z int, x int, y int, data binary")


def filter_tiles(tiles: DataFrame, filters: FilterCollection | None = None) -> DataFrame:
    """tiles (tile_id, z, x, y, data) filtered and encoded anew; without filters only unused table entries go."""
    if filters is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _encode_parts(_decode(_messages(batches), None))

        return _in_python(tiles.select("tile_id", "z", "x", "y", "data"), run, "tile_id long, z int, x int, y int, data binary")
    decoded = decode_tiles(tiles, filters)
    return encode_tiles(decoded.withColumn("layers", filter_layers(F.col("layers"), filters)))


def features(decoded: DataFrame) -> DataFrame:
    """A row for each feature: tile_id, z, x, y, layer_no, layer, extent, feature_no, id, geometry_type, geometry, tags, masks."""
    rows = decoded.select("tile_id", "z", "x", "y", F.col("layer_no").alias("_n"), F.col("feature_no").alias("_k"), F.posexplode("layers").alias("_at", "_l"))
    before = F.when(F.col("_at") == 0, F.col("_k")).otherwise(0)
    rows = rows.select("tile_id", "z", "x", "y", (F.col("_n") + F.col("_at")).alias("layer_no"), F.col("_l.name").alias("layer"), F.coalesce("_l.extent", F.lit(mvt.EXTENT)).alias("extent"), before.alias("_before"), F.posexplode("_l.features").alias("_no", "_f"))
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in KINDS.items() for v in pair)), F.col("_f.kind")), F.lit("Unknown"))
    number = (F.col("_before") + F.col("_no")).cast("int").alias("feature_no")
    return rows.select("tile_id", "z", "x", "y", "layer_no", "layer", "extent", number, "_f.id", kind.alias("geometry_type"), "_f.geometry", F.col("_f.tags").alias("tags"), "_f.masks")


def repack(df: DataFrame) -> DataFrame:
    """Dictionary tables of a feature table (layer, tags): each layer's distinct keys and values, as its encoded tiles hold them."""
    pairs = df.select("layer", F.explode("tags").alias("key", "value"))
    return pairs.groupBy("layer", "key", "value").agg(F.count("*").alias("uses"))
