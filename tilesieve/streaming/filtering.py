"""Filters over streams: rules look at one row at a time, so a stream needs neither state nor watermark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tilesieve.operators.filtering import PointFeatures
from tilesieve.plans.filters import FilterCollection


def filter_stream(stream: DataFrame, filters: FilterCollection, layer: str, lon: str, lat: str, kinds: Mapping[str, str]) -> DataFrame:
    """The features of a stream that no filter drops."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return PointFeatures(stream, filters, layer, lon, lat, kinds).drop_features()


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a filtered stream to Parquet files, exactly once."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start(path)
