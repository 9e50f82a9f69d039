"""Filters over feature tables: whole features and single tags are dropped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesieve.functions import values as V
from tilesieve.operators.spatial import point_in
from tilesieve.plans.expressions import Context
from tilesieve.plans.filters import Filter, FilterCollection


def geometry_type(kind: Column) -> Column:
    """Point, LineString or Polygon, for single and multiple geometries; Unknown for all else."""
    return F.when(kind.isin("Point", "MultiPoint"), "Point").when(kind.isin("LineString", "MultiLineString"), "LineString").when(kind.isin("Polygon", "MultiPolygon"), "Polygon").otherwise("Unknown")


def _within(x: Column, y: Column):
    def test(_: int, f: Filter) -> Column | None:
        return point_in(f.geometry, x, y)

    return test


class PointFeatures:
    """A table of point features: a layer name, coordinates in degrees, and tags in typed columns or in a map.

    kinds gives the tag columns and their kinds (`values.STR` and so on); tags_col names a map column
    from names to tile values instead.
    """

    def __init__(self, df: DataFrame, filters: FilterCollection, layer: str, lon: str, lat: str, kinds: Mapping[str, str] | None = None, tags_col: str | None = None):
        self.df, self.filters, self.layer, self.kinds, self.tags_col = df, filters, F.col(f"`{layer}`"), kinds or {}, tags_col
        self.within = _within(F.col(f"`{lon}`"), F.col(f"`{lat}`"))

    def context(self, key: Column | None = None) -> Context:
        kind = F.lit("Point")
        return Context.of_map(F.col(f"`{self.tags_col}`"), key, kind) if self.tags_col else Context.of_columns(self.kinds, key, kind)

    def dropped(self) -> Column:
        """Whether a feature goes; never NULL."""
        return self.filters.drop_feature(self.layer, self.context(), self.within)

    def drop_features(self) -> DataFrame:
        return self.df.where(~self.dropped())

    def drop_tags(self) -> DataFrame:
        """With tags in a map: the features that stay, with the tags that stay. Rules see all original tags."""
        tags = F.col(f"`{self.tags_col}`")
        kept = F.map_filter(tags, lambda k, _: ~self.filters.drop_tag(self.layer, self.context(k), self.within))
        return self.drop_features().withColumn(self.tags_col, kept)

    def tag_rows(self, keep: list[str]) -> DataFrame:
        """With tags in columns: a row (keep..., key, value as text) for each tag that stays of each feature that stays."""
        pairs = F.array(*(F.struct(F.lit(name).alias("key"), F.when(F.col(f"`{name}`").isNotNull(), V.text(V.of_column(F.col(f"`{name}`"), kind))).alias("value")) for name, kind in self.kinds.items()))
        rows = self.drop_features().withColumn("_pair", F.explode(pairs)).where(F.col("_pair.value").isNotNull()).withColumn("_key", F.col("_pair.key"))
        rows = rows.where(~self.filters.drop_tag(self.layer, self.context(F.col("_key")), self.within))
        return rows.select(*keep, F.col("_key").alias("key"), F.col("_pair.value").alias("value"))


def anti_join(features: DataFrame, masks: DataFrame, layer: str, lon: str, lat: str) -> DataFrame:
    """Features that no rectangle mask of their layer covers.

    masks: layer (`*` for any), west, south, east, north. With many masks, cells of a degree make the
    join an equi-join: a mask is listed under each cell that it touches, a feature under its own.
    """
    cells = masks.withColumn("_cx", F.explode(F.sequence(F.floor("west").cast("int"), F.floor("east").cast("int")))).withColumn("_cy", F.explode(F.sequence(F.floor("south").cast("int"), F.floor("north").cast("int"))))
    m = cells.select(F.col("layer").alias("_layer"), "west", "south", "east", "north", "_cx", "_cy")
    x, y = F.col(f"`{lon}`"), F.col(f"`{lat}`")
    hit = (F.floor(x).cast("int") == F.col("_cx")) & (F.floor(y).cast("int") == F.col("_cy")) & ((F.col("_layer") == "*") | (F.col("_layer") == F.col(f"`{layer}`")))
    hit = hit & (x >= F.col("west")) & (x <= F.col("east")) & (y >= F.col("south")) & (y <= F.col("north"))
    return features.join(m, hit, "left_anti")
