"""Mapbox Vector Tile 2.1 messages: bytes to layers and back."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from tilesieve.functions.geometry import Geometry

#: Fixed values of the format: geometry types, commands, and the extent that a layer has by default.
UNKNOWN, POINT, LINESTRING, POLYGON = 0, 1, 2, 3
MOVE_TO, LINE_TO, CLOSE_PATH = 1, 2, 7
EXTENT = 4096

#: A tag's value: its slot and what the slot holds.
Tag = tuple[str, str | float | int | bool]

#: Fixed values of the format: field numbers of a value's slots.
SLOT_FIELDS = {1: "string_value", 2: "float_value", 3: "double_value", 4: "int_value", 5: "uint_value", 6: "sint_value", 7: "bool_value"}


class TileError(ValueError):
    """A tile that can't be decoded."""


@dataclass
class Feature:
    """tags: name to value, of a name's repeats the last. A value without any slot is None."""

    tags: dict[str, Tag | None]
    kind: int = UNKNOWN
    geometry: list[int] = field(default_factory=list)
    id: int | None = None


@dataclass
class Layer:
    name: str
    features: list[Feature] = field(default_factory=list)
    extent: int | None = None
    version: int = 1


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data):
            raise TileError("the message ends within a number")
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            raise TileError("a number is too long")


def _fields(data: memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(field number, wire type, number or bytes) of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise TileError(f"unknown wire type {wire}")
            if at + size > len(data):
                raise TileError("the message ends within a field")
            value = data[at : at + size]
            at += size
        yield number, wire, value


def _packed(wire: int, value: int | memoryview) -> list[int]:
    if wire == 0:
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def zigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def unzigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _value(data: memoryview) -> Tag | None:
    """The set slot that comes first in the order of precedence, for a message that sets several."""
    slots: dict[str, Tag] = {}
    for number, _, v in _fields(data):
        name = SLOT_FIELDS.get(number)
        if name == "string_value":
            slots[name] = (name, bytes(v).decode())
        elif name == "float_value":
            slots[name] = (name, struct.unpack("<f", v)[0])
        elif name == "double_value":
            slots[name] = (name, struct.unpack("<d", v)[0])
        elif name == "int_value":
            slots[name] = (name, _signed(v))
        elif name == "uint_value":
            slots[name] = (name, v)
        elif name == "sint_value":
            slots[name] = (name, zigzag(v))
        elif name == "bool_value":
            slots[name] = (name, bool(v))
    for name in ("string_value", "int_value", "uint_value", "sint_value", "float_value", "double_value", "bool_value"):
        if name in slots:
            return slots[name]
    return None


def decode(data: bytes) -> list[Layer]:
    """The layers of a tile. An odd last tag index is ignored; an index beyond the tables is an error."""
    layers = []
    try:
        for number, _, message in _fields(memoryview(data)):
            if number == 3:
                layers.append(_layer(message))
    except (UnicodeDecodeError, struct.error, TypeError) as e:
        raise TileError(str(e)) from None
    return layers


def _layer(message: memoryview) -> Layer:
    layer, keys, values, raw = Layer(""), [], [], []
    for number, _, v in _fields(message):
        if number == 1:
            layer.name = bytes(v).decode()
        elif number == 2:
            raw.append(v)
        elif number == 3:
            keys.append(bytes(v).decode())
        elif number == 4:
            values.append(_value(v))
        elif number == 5:
            layer.extent = v
        elif number == 15:
            layer.version = v
    for message in raw:
        f, tags = Feature({}), []
        for number, wire, v in _fields(message):
            if number == 1:
                f.id = v
            elif number == 2:
                tags += _packed(wire, v)
            elif number == 3:
                f.kind = v
            elif number == 4:
                f.geometry += _packed(wire, v)
        for k, v in zip(tags[::2], tags[1::2]):
            if k >= len(keys) or v >= len(values):
                raise TileError(f"a tag of layer {layer.name!r} is beyond its tables")
            f.tags[keys[k]] = values[v]
        layer.features.append(f)
    return layer


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(number: int, data: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(data)) + data


def _varfield(number: int, n: int) -> bytes:
    return _number(number << 3) + _number(n & 0xFFFFFFFFFFFFFFFF)


def _encode_value(tag: Tag | None) -> bytes:
    if tag is None:
        return b""
    slot, v = tag
    if slot == "string_value":
        return _bytes(1, v.encode())
    if slot == "float_value":
        return _number(2 << 3 | 5) + struct.pack("<f", v)
    if slot == "double_value":
        return _number(3 << 3 | 1) + struct.pack("<d", v)
    number = {name: n for n, name in SLOT_FIELDS.items()}[slot]
    return _varfield(number, unzigzag(v) if slot == "sint_value" else int(v))


def encode(layers: list[Layer]) -> bytes:
    """A tile of layers. Tables hold what tags refer to, in order of first use; values of different slots stay apart."""
    out = []
    for layer in layers:
        keys: dict[str, int] = {}
        values: dict[object, int] = {}
        listed: list[Tag | None] = []
        body = []
        for f in layer.features:
            refs = []
            for name, tag in f.tags.items():
                refs.append(keys.setdefault(name, len(keys)))
                # the bits tell floats apart; a NaN equals no other value, itself included
                mark: object = tag if tag is None or not isinstance(tag[1], float) else (tag[0], struct.pack("<d", tag[1]) if tag[1] == tag[1] else object())
                if tag is not None and isinstance(tag[1], float) and tag[1] == 0:
                    mark = (tag[0], 0.0)
                if mark not in values:
                    values[mark] = len(listed)
                    listed.append(tag)
                refs.append(values[mark])
            message = b"" if f.id is None else _varfield(1, f.id)
            message += _bytes(2, b"".join(map(_number, refs))) if refs else b""
            message += _varfield(3, f.kind) if f.kind else b""
            message += _bytes(4, b"".join(map(_number, f.geometry))) if f.geometry else b""
            body.append(_bytes(2, message))
        head = _bytes(1, layer.name.encode())
        tables = b"".join(_bytes(3, k.encode()) for k in keys) + b"".join(_bytes(4, _encode_value(v)) for v in listed)
        tail = (b"" if layer.extent is None else _varfield(5, layer.extent)) + _varfield(15, layer.version)
        out.append(_bytes(3, head + b"".join(body) + tables + tail))
    return b"".join(out)


@dataclass
class Columns:
    """Features of one layer as flat arrays, of which entry k has the numbers from at[k] up to at[k + 1].

    keys and values are places in the layer's tables, one each for a tag.
    """

    ids: np.ndarray
    has_id: np.ndarray
    kinds: np.ndarray
    geometry: np.ndarray
    geometry_at: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    tags_at: np.ndarray


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for each k, counts[k] numbers of it."""
    return np.repeat(first - starts_of(counts)[:-1], counts) + np.arange(int(counts.sum()))


def sizes_of(numbers: np.ndarray) -> np.ndarray:
    """The bytes that each number takes."""
    out = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        more = numbers >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        out += more
    return out


def write_numbers(numbers: np.ndarray) -> bytes:
    """Numbers (uint64) one after the other."""
    sizes = sizes_of(numbers)
    at = starts_of(sizes)[:-1]
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        w = np.flatnonzero(sizes > k)
        out[at[w] + k] = (numbers[w] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | (sizes[w] > k + 1).astype(np.uint8) << 7
    return out.tobytes()


class LayerMessage:
    """A layer of which the tables are read; its features are read by ranges."""

    def __init__(self, data: bytes):
        self.name, self.extent, self.version = "", None, 1
        self.keys: list[str] = []
        self.values: list[Tag | None] = []
        self.data = data
        starts, ends = array("q"), array("q")
        at, size = 0, len(data)
        while at < size:
            key, at = (data[at], at + 1) if data[at] < 0x80 else _varint(data, at)
            number, wire = key >> 3, key & 7
            if (number in (1, 2, 3, 4) and wire != 2) or (number in (5, 15) and wire != 0):
                raise TileError(f"field {number} of a layer has wire type {wire}")
            if wire in (0, 2):
                v, at = (data[at], at + 1) if at < size and data[at] < 0x80 else _varint(data, at)
                end = at + v if wire == 2 else at
            elif wire in (1, 5):
                end = at + (8 if wire == 1 else 4)
            else:
                raise TileError(f"unknown wire type {wire}")
            if end > size:
                raise TileError("the message ends within a field")
            if number == 2:
                starts.append(at)
                ends.append(end)
            elif number == 4:
                self.values.append(_short_value(data[at:end]))
            elif number == 3:
                self.keys.append(data[at:end].decode())
            elif number == 1:
                self.name = data[at:end].decode()
            elif number == 5:
                self.extent = v
            elif number == 15:
                self.version = v
            at = end
        self.starts, self.ends = np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int64)
        first: dict[str, int] = {}
        #: a name that the table has twice is one name
        self._same = np.array([first.setdefault(k, i) for i, k in enumerate(self.keys)], np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def read(self, a: int, b: int) -> Columns:
        """The features from a up to b. An odd last tag index is ignored; an index beyond the tables is an error."""
        raw = [self.data[i:j] for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]
        found = _features(raw)
        if found is None:
            found = _features_singly(raw)
        ids, has_id, kinds, geometry, geometry_at, refs, refs_at = found
        counts = np.diff(refs_at) // 2
        at = spread(refs_at[:-1], counts * 2)
        keys, values = refs[at[::2]], refs[at[1::2]]
        if len(keys) and (keys.max() >= len(self.keys) or values.max() >= len(self.values)):
            raise TileError(f"a tag of layer {self.name!r} is beyond its tables")
        keys, values, tags_at = self._same[keys.astype(np.int64)] if len(keys) else keys.astype(np.int64), values.astype(np.int64), starts_of(counts)
        owner = np.repeat(np.arange(len(raw)), counts)
        # of a name's repeats in a feature the place is the first one's and the value the last one's
        order = np.lexsort((keys, owner))
        again = np.zeros(len(order), bool)
        again[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        if again.any():
            heads = np.flatnonzero(~again)
            tails = np.append(heads[1:], len(order)) - 1
            values[order[heads]] = values[order[tails]]
            stay = np.zeros(len(order), bool)
            stay[order[heads]] = True
            keys, values, tags_at = keys[stay], values[stay], starts_of(np.bincount(owner[stay], minlength=len(raw)))
        return Columns(ids, has_id, kinds, geometry, geometry_at, keys, values, tags_at)


def layers_of(data: bytes | memoryview) -> Iterator[LayerMessage]:
    """The layers of a tile, one at a time."""
    try:
        for number, _, message in _fields(memoryview(data)):
            if number == 3:
                yield LayerMessage(bytes(message))
    except (UnicodeDecodeError, struct.error, TypeError) as e:
        raise TileError(str(e)) from None


def _short_value(data: bytes) -> Tag | None:
    if len(data) == 9 and data[0] == 0x19:
        return "double_value", _DOUBLE.unpack_from(data, 1)[0]
    if len(data) > 1 and data[0] == 0x0A and data[1] == len(data) - 2 and data[1] < 0x80:
        return "string_value", data[2:].decode()
    return _value(memoryview(data))


_DOUBLE = struct.Struct("<d")


def _features_singly(raw: list[bytes]) -> tuple:
    """Features field by field: any order, repeats and wire types."""
    ids, has_id, kinds, shapes, refs = [], [], [], [], []
    try:
        for message in raw:
            i, kind, shape, tags = None, UNKNOWN, [], []
            for number, wire, v in _fields(memoryview(message)):
                if number == 1:
                    i = v
                elif number == 2:
                    tags += _packed(wire, v)
                elif number == 3:
                    kind = v
                elif number == 4:
                    shape += _packed(wire, v)
            ids.append(i or 0)
            has_id.append(i is not None)
            kinds.append(kind)
            shapes.append(shape)
            refs.append(tags)
        flat = lambda lists: (np.array([v for x in lists for v in x], np.uint64), starts_of(np.array([len(x) for x in lists], np.int64)))
        return np.array(ids, np.uint64), np.array(has_id, bool), np.array(kinds, np.uint64), *flat(shapes), *flat(refs)
    except (struct.error, TypeError) as e:
        raise TileError(str(e)) from None


def _features(raw: list[bytes]) -> tuple | None:
    """Features all at once, or None unless each field is a number or a packed list of the format's own, once."""
    n = len(raw)
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw], dtype=np.int64)
    at = end - np.array([len(r) for r in raw], np.int64)
    last = np.flatnonzero(data < 0x80)
    full = end > at
    if len(data) and (data[end[full] - 1] >= 0x80).any():
        return None
    begin = np.concatenate([np.zeros(min(1, len(last)), np.int64), last[:-1] + 1])
    size = last - begin + 1
    if size.max(initial=0) > 10:
        return None
    numbers = (data[begin] & 0x7F).astype(np.uint64)
    for k in range(1, int(size.max(initial=0))):
        w = np.flatnonzero(size > k)
        numbers[w] |= (data[begin[w] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    place = np.cumsum(data < 0x80) - 1  # which number ends at a byte
    ids, has_id, kinds = np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, np.uint64)
    lists = {key: (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)) for key in (18, 34)}
    going = np.flatnonzero(full)
    while len(going):
        p = at[going]
        key = data[p]
        if (~np.isin(key, (8, 18, 24, 34))).any() or (p + 1 >= end[going]).any():
            return None
        t = place[p] + 1
        v, after = numbers[t], last[t] + 1
        if (after > end[going]).any():
            return None
        w = key == 8
        ids[going[w]], has_id[going[w]] = v[w], True
        w = key == 24
        kinds[going[w]] = v[w]
        for k, (first, count, seen) in lists.items():
            w = np.flatnonzero(key == k)
            who = going[w]
            if seen[who].any() or (v[w] > (end[who] - after[w]).astype(np.uint64)).any():
                return None
            seen[who] = True
            stop = after[w] + v[w].astype(np.int64)
            some = stop > after[w]
            if (data[stop[some] - 1] >= 0x80).any():
                return None
            first[who[some]] = t[w][some] + 1
            count[who[some]] = place[stop[some] - 1] - t[w][some]
            after[w] = stop
        at[going] = after
        going = going[after < end[going]]
    taken = lambda first, count, _: (numbers[spread(first, count)], starts_of(count))
    return ids, has_id, kinds, *taken(*lists[34]), *taken(*lists[18])


class LayerWriter:
    """A layer's message, made of runs of features. Tables hold what tags refer to, in order of first use."""

    def __init__(self, name: str, version: int, extent: int | None):
        self.name, self.version, self.extent = name, version, extent
        self.keys: dict[str, int] = {}
        self.values: dict[object, int] = {}
        self.body, self.table = bytearray(), bytearray()

    def places(self, keys: list[str], values: list[tuple[object, Tag | None]]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tables of names and of (mark, tag), tags of one mark being the same value."""
        own = [self.keys.setdefault(k, len(self.keys)) for k in keys]
        there = []
        for mark, tag in values:
            k = self.values.get(mark)
            if k is None:
                k = self.values[mark] = len(self.values)
                self.table += _bytes(4, _encode_value(tag))
            there.append(k)
        return np.array(own, np.uint64), np.array(there, np.uint64)

    def add(self, c: Columns) -> None:
        n = len(c.ids)
        refs = np.empty(2 * len(c.keys), np.uint64)
        refs[::2], refs[1::2] = c.keys, c.values
        refs_at = c.tags_at * 2
        kinds, ids = c.kinds.astype(np.uint64), c.ids.astype(np.uint64)
        bytes_of = lambda numbers, at: np.diff(starts_of(sizes_of(numbers))[at]).astype(np.uint64)
        tags, shapes = bytes_of(refs, refs_at), bytes_of(c.geometry, c.geometry_at)
        one = lambda numbers, there: np.where(there, 1 + sizes_of(numbers), 0)
        listed = lambda sizes: one(sizes, sizes > 0) + sizes.astype(np.int64)
        whole = one(ids, c.has_id) + listed(tags) + one(kinds, kinds > 0) + listed(shapes)
        n_refs, n_shape = np.diff(refs_at), np.diff(c.geometry_at)
        at_tags = 2 + 2 * c.has_id.astype(np.int64)
        at_kind = at_tags + np.where(n_refs > 0, 2 + n_refs, 0)
        at_shape = at_kind + 2 * (kinds > 0)
        start = starts_of(at_shape + np.where(n_shape > 0, 2 + n_shape, 0))
        out, at = np.empty(int(start[-1]), np.uint64), start[:-1]

        def put(where: np.ndarray, there: np.ndarray, key: int, numbers: np.ndarray) -> None:
            out[where[there]], out[where[there] + 1] = key, numbers[there]

        put(at, np.ones(n, bool), 2 << 3 | 2, whole)
        put(at + 2, c.has_id, 1 << 3, ids)
        put(at + at_tags, n_refs > 0, 2 << 3 | 2, tags)
        out[spread(at + at_tags + 2, n_refs)] = refs
        put(at + at_kind, kinds > 0, 3 << 3, kinds)
        put(at + at_shape, n_shape > 0, 4 << 3 | 2, shapes)
        out[spread(at + at_shape + 2, n_shape)] = c.geometry
        self.body += write_numbers(out)

    def message(self) -> bytes:
        """The layer as a field of a tile."""
        head = _bytes(1, self.name.encode())
        tail = b"".join(_bytes(3, k.encode()) for k in self.keys) + bytes(self.table) + (b"" if self.extent is None else _varfield(5, self.extent)) + _varfield(15, self.version)
        return b"".join((_number(3 << 3 | 2), _number(len(head) + len(self.body) + len(tail)), head, self.body, tail))


def _paths(commands: list[int]) -> list[tuple[list[tuple[int, int]], bool]]:
    """The paths of a geometry: vertices, and whether the path was closed."""
    at, x, y = 0, 0, 0
    out: list[tuple[list[tuple[int, int]], bool]] = []
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command in (MOVE_TO, LINE_TO):
            if at + 2 * count > len(commands):
                raise TileError("a geometry ends within a command")
            for _ in range(count):
                x += zigzag(commands[at])
                y += zigzag(commands[at + 1])
                at += 2
                if command == MOVE_TO:
                    out.append(([(x, y)], False))
                elif not out:
                    raise TileError("a geometry begins without a move")
                else:
                    out[-1][0].append((x, y))
        elif command == CLOSE_PATH:
            if not out:
                raise TileError("a geometry begins without a move")
            out[-1] = (out[-1][0], True)
        else:
            raise TileError(f"unknown geometry command {command}")
    return out


def geometry(kind: int, commands: list[int]) -> Geometry:
    """The geometry in tile coordinates. Rings with the winding of the first one begin polygons; others are holes."""
    paths = [np.array(v, dtype=float) for v, _ in _paths(commands)]
    if kind == POINT:
        return Geometry(points=np.concatenate(paths) if paths else np.zeros((0, 2)))
    if kind == LINESTRING:
        return Geometry(lines=tuple(paths))
    if kind != POLYGON:
        raise TileError(f"unknown geometry type {kind}")
    polygons: list[list[np.ndarray]] = []
    first = 0.0
    for ring in paths:
        x, y = ring[:, 0], ring[:, 1]
        area = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())
        if area == 0:
            continue
        first = first or area
        if polygons and area * first < 0:
            polygons[-1].append(ring)
        else:
            polygons.append([ring])
    return Geometry(polygons=tuple(map(tuple, polygons)))


def commands(paths: list[list[tuple[int, int]]], kind: int) -> list[int]:
    """Geometry commands of points (one path), lines or rings (without their closing vertex)."""
    out, x, y = [], 0, 0
    for path in paths:
        first = len(path) if kind == POINT else 1
        for k, (px, py) in enumerate(path):
            if k == 0:
                out.append(MOVE_TO | first << 3)
            elif k == first:
                out.append(LINE_TO | (len(path) - 1) << 3)
            out += [unzigzag(px - x), unzigzag(py - y)]
            x, y = px, py
        if kind == POLYGON:
            out.append(CLOSE_PATH | 1 << 3)
    return out
