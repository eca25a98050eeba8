"""Scenes and their weeks, from tags, origins and the owner's own choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlore.functions.config import Tuning


def scenes(tags: DataFrame, tag_map: DataFrame, families: DataFrame, origins: DataFrame, origin_map: DataFrame, overrides: DataFrame, blocked: DataFrame, t: Tuning = Tuning()) -> DataFrame:
    """(artist_id, scene, weight) (P31): tag weights by family above a floor; the origin for artists without; an override in place of all."""
    seen = F.broadcast(families.filter("not hidden").select("scene"))  # the hand-made list of families, a row for each scene
    tagged = tags.join(blocked.select("artist_id", "tag"), ["artist_id", "tag"], "left_anti").join(tag_map, "tag").join(seen, "scene", "left_semi").groupBy("artist_id", "scene").agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= t.scene_floor)
    chosen = overrides.join(seen, "scene", "left_semi").select("artist_id", "scene", F.lit(9.0).alias("weight"))
    tagged = tagged.join(chosen, "artist_id", "left_anti")
    placed = origins.join(origin_map, "country").join(seen, "scene", "left_semi").join(tagged, "artist_id", "left_anti").join(chosen, "artist_id", "left_anti").select("artist_id", "scene", F.lit(0.5).alias("weight"))
    return tagged.unionByName(placed).unionByName(chosen)


def sky(code) -> object:
    """WMO weather codes in six kinds (F208)."""
    return F.when(code.isNull(), None).when(code <= 1, "clear").when(code <= 3, "cloud").when(code <= 48, "fog").when((code >= 71) & (code <= 77) | code.isin(85, 86), "snow").when(code >= 95, "storm").otherwise("rain")
