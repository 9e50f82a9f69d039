"""Command line: an archive in, filters, an archive out."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tilesieve.operators.metadata import apply_overrides
from tilesieve.operators.tiles import filter_tiles
from tilesieve.plans.filters import FilterCollection
from tilesieve.sources import pmtiles


class InputError(ValueError):
    """Arguments that can't be served; nothing has been written then."""


def convert(spark: SparkSession, source: str, target: str, filters: str | None = None, name: str | None = None, description: str | None = None, attribution: str | None = None, extensions: bool = False) -> int:
    """Filters an archive into a new one and returns its number of tiles. All inputs are checked before anything is written."""
    if not os.path.exists(source):
        raise InputError(f"there is no archive at {source}")
    if filters is not None and not os.path.exists(filters):
        raise InputError(f"there is no filter document at {filters}")
    if not target.endswith(".pmtiles"):
        raise InputError(f"the name of an archive ends in .pmtiles, not so {target}")
    rules = None if filters is None else FilterCollection.from_file(filters, extensions)
    header = pmtiles.read_header(source)
    if header.tile_type != pmtiles.MVT:
        raise InputError(f"{source} holds no vector tiles")
    if header.tile_compression not in (pmtiles.NONE, pmtiles.GZIP):
        raise pmtiles.ArchiveError(f"tiles of compression {header.tile_compression} can't be read")
    metadata = apply_overrides(pmtiles.read_metadata(source), name, description, attribution)
    tiles = pmtiles.read_archive(spark, source)
    pmtiles.write_archive(filter_tiles(tiles, rules), target, header, metadata, ordered=True)
    return sum(e.run_length for e in pmtiles.read_entries(target))


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilesieve", description="Filter the vector tiles of a PMTiles archive.")
    p.add_argument("input", help="archive to read")
    p.add_argument("output", help="archive to write")
    p.add_argument("-f", "--filter", help="GeoJSON document with the filters")
    p.add_argument("-n", "--name", help="name for the metadata")
    p.add_argument("-N", "--description", help="description for the metadata")
    p.add_argument("-A", "--attribution", help="attribution for the metadata")
    p.add_argument("--extensions", action="store_true", help="also accept the operators not-in and string")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("tilesieve").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    try:
        n = convert(spark, a.input, a.output, a.filter, a.name, a.description, a.attribution, a.extensions)
    finally:
        spark.stop()
    print(f"Wrote {n} tiles to {a.output}")
    return 0


