"""PMTiles version 3 archives as a Spark source and sink.

`spark.read.format("pmtiles").load(path)` gives (tile_id, z, x, y, data) with data uncompressed; the
archive's directories are read once on the driver, and tasks read ranges of tile ids by seeks.
`df.write.format("pmtiles")` takes (tile_id, data): each task writes a segment beside the archive,
and the commit joins the segments in order of their tiles.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format.
MAGIC, VERSION, HEADER_BYTES, ROOT_BYTES = b"PMTiles", 3, 127, 16_384
UNKNOWN, NONE, GZIP, BROTLI, ZSTD = 0, 1, 2, 3, 4
MVT = 1

SCHEMA = "tile_id long, z int, x int, y int, data binary"

#: Bytes and tiles of a batch that is read; a tile that is larger is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

#: Entries of a leaf directory; with no more in all, there is the root alone.
LEAF_ENTRIES = 4096


class ArchiveError(ValueError):
    """An archive that can't be read or written."""


@dataclass(frozen=True)
class Header:
    """What an archive's header says besides the places of its sections."""

    tile_type: int = MVT
    tile_compression: int = GZIP
    internal_compression: int = GZIP
    min_zoom: int = 0
    max_zoom: int = 0
    min_lon: float = -180.0
    min_lat: float = -85.0
    max_lon: float = 180.0
    max_lat: float = 85.0
    center_zoom: int = 0
    center_lon: float = 0.0
    center_lat: float = 0.0
    clustered: bool = True
    sections: tuple[int, ...] = (0,) * 8
    counts: tuple[int, ...] = (0,) * 3

    @classmethod
    def parse(cls, data: bytes) -> "Header":
        if len(data) < HEADER_BYTES or data[:7] != MAGIC:
            raise ArchiveError("not a PMTiles archive")
        if data[7] != VERSION:
            raise ArchiveError(f"PMTiles version {data[7]} is not supported")
        u = struct.unpack_from("<11Q", data, 8)
        clustered, internal, tile, kind, z0, z1, w, s, e, n, cz, clon, clat = struct.unpack_from("<6B4iB2i", data, 96)
        deg = lambda v: v / 1e7
        return cls(kind, tile, internal, z0, z1, deg(w), deg(s), deg(e), deg(n), cz, deg(clon), deg(clat), bool(clustered), u[:8], u[8:])

    def pack(self) -> bytes:
        fix = lambda v: round(v * 1e7)
        return (
            MAGIC
            + bytes([VERSION])
            + struct.pack("<11Q", *self.sections, *self.counts)
            + struct.pack("<6B4iB2i", self.clustered, self.internal_compression, self.tile_compression, self.tile_type, self.min_zoom, self.max_zoom, *map(fix, (self.min_lon, self.min_lat, self.max_lon, self.max_lat)), self.center_zoom, *map(fix, (self.center_lon, self.center_lat)))
        )


def compress(data: bytes, how: int) -> bytes:
    if how == GZIP:
        return gzip.compress(data, 6, mtime=0)
    if how == NONE:
        return data
    raise ArchiveError(f"Unsupported tile compression {how}")


def decompress(data: bytes, how: int) -> bytes:
    if how == GZIP:
        return gzip.decompress(data)
    if how in (NONE, UNKNOWN):
        return data
    if how == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ArchiveError(f"Unsupported compression {how}")


def tile_id(z: int, x: int, y: int) -> int:
    """Place of a tile along the Hilbert curves of all zooms."""
    out, s = 0, 1 << z >> 1
    n = 1 << z
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        out += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return (4**z - 1) // 3 + out


def tile_zxy(i: int) -> tuple[int, int, int]:
    """The tile at a place; the inverse of tile_id."""
    z = ((3 * i + 1).bit_length() - 1) // 2
    d = i - (4**z - 1) // 3
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = 1 & d // 2
        ry = 1 & (d ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        d //= 4
        s *= 2
    return z, x, y


@dataclass(frozen=True)
class Entry:
    """run_length tiles from tile_id on have the same content; 0 stands for a leaf directory."""

    tile_id: int
    offset: int
    length: int
    run_length: int


def _varints(data: bytes) -> Iterator[int]:
    out = shift = 0
    for b in data:
        out |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            yield out
            out = shift = 0


def parse_directory(data: bytes) -> list[Entry]:
    it = _varints(data)
    n = next(it)
    ids, last = [], 0
    for _ in range(n):
        last += next(it)
        ids.append(last)
    runs = [next(it) for _ in range(n)]
    lengths = [next(it) for _ in range(n)]
    offsets: list[int] = []
    for k in range(n):
        v = next(it)
        offsets.append(offsets[-1] + lengths[k - 1] if v == 0 and k else v - 1)
    return [Entry(*e) for e in zip(ids, offsets, lengths, runs)]


def pack_directory(entries: list[Entry]) -> bytes:
    out = bytearray()

    def put(n: int) -> None:
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)

    put(len(entries))
    last = 0
    for e in entries:
        put(e.tile_id - last)
        last = e.tile_id
    for e in entries:
        put(e.run_length)
    for e in entries:
        put(e.length)
    for k, e in enumerate(entries):
        put(0 if k and e.offset == entries[k - 1].offset + entries[k - 1].length else e.offset + 1)
    return bytes(out)


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        return Header.parse(f.read(HEADER_BYTES))


def read_metadata(path: str) -> str:
    h = read_header(path)
    with open(path, "rb") as f:
        f.seek(h.sections[2])
        return decompress(f.read(h.sections[3]), h.internal_compression).decode() if h.sections[3] else ""


def read_entries(path: str) -> list[Entry]:
    """All tile entries of an archive, leaf directories included, in order."""
    h = read_header(path)
    with open(path, "rb") as f:

        def walk(offset: int, length: int) -> Iterator[Entry]:
            f.seek(offset)
            for e in parse_directory(decompress(f.read(length), h.internal_compression)):
                if e.run_length:
                    yield e
                else:
                    yield from walk(h.sections[4] + e.offset, e.length)

        return list(walk(h.sections[0], h.sections[1]))


def header_frame(spark: SparkSession, path: str) -> DataFrame:
    """The header and the metadata of an archive, as one row."""
    h = read_header(path)
    names = ("tile_type", "tile_compression", "min_zoom", "max_zoom", "min_lon", "min_lat", "max_lon", "max_lat", "center_zoom", "center_lon", "center_lat")
    row = tuple(getattr(h, n) for n in names) + (read_metadata(path),)
    return spark.createDataFrame([row], ", ".join(f"{n} {'double' if n.endswith(('lon', 'lat')) else 'int'}" for n in names) + ", metadata string")


def expand_runs(entries: DataFrame) -> DataFrame:
    """Directory entries (tile_id, run_length, ...), one row for each tile."""
    return entries.where("run_length > 0").withColumn("tile_id", F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)))


@dataclass
class Range(InputPartition):
    """Entries that one task reads."""

    def __init__(self, entries: list[Entry]):
        super().__init__(None)
        self.entries = entries


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.header = read_header(self.path)

    def partitions(self) -> list[InputPartition]:
        out: list[list[Entry]] = [[]]
        size = 0
        for e in read_entries(self.path):
            tiles = e.run_length
            if out[-1] and size + e.length * tiles > self.bytes:
                out.append([])
                size = 0
            out[-1].append(e)
            size += e.length * tiles
        return [Range(x) for x in out]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        with open(self.path, "rb") as f:
            for e in partition.entries:
                f.seek(self.header.sections[6] + e.offset)
                data = decompress(f.read(e.length), self.header.tile_compression)
                for i in range(e.tile_id, e.tile_id + e.run_length):
                    rows.append((i, *tile_zxy(i), data))
                    size += len(data)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"tile_id": pa.int64(), "z": pa.int32(), "x": pa.int32(), "y": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds.values())], names=list(kinds))


@dataclass
class Segment(WriterCommitMessage):
    """A task's part of the tile data, and its entries."""

    path: str
    entries: list[Entry]


class Writer(DataSourceArrowWriter):
    """Tiles must be range-partitioned and sorted by tile_id, as write_archive does."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        if not self.path.endswith(".pmtiles"):
            raise ArchiveError("the output must end in .pmtiles")
        if os.path.exists(self.path) and not overwrite:
            raise ArchiveError(f"{self.path} exists")
        self.header = Header(**json.loads(options.get("header", "{}")))
        if self.header.tile_compression not in (NONE, GZIP):
            raise ArchiveError(f"Unsupported tile compression {self.header.tile_compression}")
        self.metadata = options.get("metadata", "{}")
        self.staging = f"{self.path}.{uuid.uuid4().hex}.parts"
        self.compressed = options.get("compressed", "false") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        os.makedirs(self.staging, exist_ok=True)
        path = f"{self.staging}/{uuid.uuid4().hex}"
        entries: list[Entry] = []
        seen: dict[bytes, int] = {}  # by digest: contents themselves would be as large as the archive
        at = 0
        with open(path, "wb") as f:
            for number, data in ((i.as_py(), d.as_py()) for batch in iterator for i, d in zip(batch.column("tile_id"), batch.column("data"))):
                data = data if self.compressed else compress(data, self.header.tile_compression)
                mark = hashlib.blake2b(data, digest_size=32).digest()
                if mark in seen:
                    offset = seen[mark]
                else:
                    offset, at = at, at + len(data)
                    f.write(data)
                    if len(seen) > 1000:
                        seen.clear()
                    seen[mark] = offset
                last = entries[-1] if entries else None
                if last and last.offset == offset and last.tile_id + last.run_length == number:
                    entries[-1] = replace(last, run_length=last.run_length + 1)
                else:
                    entries.append(Entry(number, offset, len(data), 1))
        return Segment(path, entries)

    def commit(self, messages: list[Segment | None]) -> None:
        parts = sorted((m for m in messages if m and m.entries), key=lambda m: m.entries[0].tile_id)
        entries: list[Entry] = []
        base = 0
        for m in parts:
            if entries and m.entries[0].tile_id <= entries[-1].tile_id:
                raise ArchiveError("tiles are not in order, or a tile is there twice")
            entries += [replace(e, offset=e.offset + base) for e in m.entries]
            base += os.path.getsize(m.path)
        root, leaves = _directories(entries, self.header.internal_compression)
        meta = compress(self.metadata.encode(), self.header.internal_compression)
        sizes = (len(root), len(meta), len(leaves), base)
        starts = [HEADER_BYTES + sum(sizes[:k]) for k in range(4)]
        tiles = sum(e.run_length for e in entries)
        header = replace(self.header, clustered=True, sections=tuple(v for pair in zip(starts, sizes) for v in pair), counts=(tiles, len(entries), len({e.offset for e in entries})))
        draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        with open(draft, "wb") as out:
            for part in (header.pack(), root, meta, leaves):
                out.write(part)
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        os.replace(draft, self.path)  # an existing archive goes only now that the new one is whole
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Segment | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _directories(entries: list[Entry], how: int) -> tuple[bytes, bytes]:
    """Root directory and leaf directories; the root must fit in the archive's first 16 KiB."""
    root = compress(pack_directory(entries), how)
    if len(entries) <= LEAF_ENTRIES and len(root) <= ROOT_BYTES - HEADER_BYTES:
        return root, b""
    per_leaf = LEAF_ENTRIES
    while True:
        leaves, pointers = io.BytesIO(), []
        for k in range(0, len(entries), per_leaf):
            leaf = compress(pack_directory(entries[k : k + per_leaf]), how)
            pointers.append(Entry(entries[k].tile_id, leaves.tell(), len(leaf), 0))
            leaves.write(leaf)
        root = compress(pack_directory(pointers), how)
        if len(root) <= ROOT_BYTES - HEADER_BYTES:
            return root, leaves.getvalue()
        per_leaf *= 2


class PMTilesSource(DataSource):
    """The `pmtiles` format; register it with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> Reader:
        return Reader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read_archive(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The tiles of an archive; tasks read about 32 MiB each, or less where that leaves cores idle."""
    spark.dataSource.register(PMTilesSource)
    size = read_header(path).sections[7] // (3 * spark.sparkContext.defaultParallelism)
    options.setdefault("partitionbytes", max(1 << 16, min(32 << 20, size)))
    return spark.read.format("pmtiles").options(**options).load(path)


def write_archive(tiles: DataFrame, path: str, header: Header, metadata: str = "{}", compressed: bool = False, overwrite: bool = True, ordered: bool = False) -> None:
    """tiles (tile_id, data) in one archive, in order of their ids.

    compressed: data is as the archive stores it. ordered: partitions hold ascending, disjoint ranges
    of ids already, as those of a filtered archive do; then nothing is shuffled. The commit checks it.
    """
    tiles.sparkSession.dataSource.register(PMTilesSource)
    keys = ("tile_type", "tile_compression", "internal_compression", "min_zoom", "max_zoom", "min_lon", "min_lat", "max_lon", "max_lat", "center_zoom", "center_lon", "center_lat")
    told = json.dumps({k: getattr(header, k) for k in keys})
    rows = tiles.select("tile_id", "data")
    rows = rows if ordered else rows.repartitionByRange("tile_id").sortWithinPartitions("tile_id")
    rows.write.format("pmtiles").mode("overwrite" if overwrite else "append").option("header", told).option("metadata", metadata).option("compressed", str(compressed).lower()).save(path)


def zxy_columns(z: Column, x: Column, y: Column) -> Column:
    """tile_id of tile numbers, as an expression: one fold over the bits of x and y."""
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    power = lambda k: F.pow(F.lit(2.0), k).cast("long")
    n = power(z)

    def step(acc: Column, k: Column) -> Column:
        s = power(k)
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        fx = F.when((ry == 0) & (rx == 1), n - 1 - acc["x"]).otherwise(acc["x"])
        fy = F.when((ry == 0) & (rx == 1), n - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct((acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)).alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    bits = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    below = ((F.pow(F.lit(4.0), z) - 1) / 3).cast("long")
    return below + F.aggregate(bits, start, step)["d"]
