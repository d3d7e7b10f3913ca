"""Points of a song: which old ones go, and what replaces them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize_xml_text
from ..schemas import POI


def is_replaceable_poi(kind: Column, num: Column) -> Column:
    """Cues and loops that were set by number; grid points and number 0 stay. Numbers are compared as text."""
    return F.coalesce(kind.isin("cue", "loop"), F.lit(False)) & (F.coalesce(num, F.lit("0")) != "0")


def surviving(pois: Column) -> Column:
    """The array less its replaceable points, in document order."""
    return F.filter(F.coalesce(pois, F.array().cast(f"array<{POI}>")), lambda p: ~is_replaceable_poi(p["_Type"], p["_Num"]))


def removed_count(pois: Column) -> Column:
    return F.size(F.filter(F.coalesce(pois, F.array().cast(f"array<{POI}>")), lambda p: is_replaceable_poi(p["_Type"], p["_Num"])))


def color_comment(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, comment): the track's colours, sorted, with spaces between."""
    colors = F.array_join(F.array_sort(F.collect_set("color")), " ")
    return points.groupBy(*keys).agg(sanitize_xml_text(colors).alias("comment"))


def collected_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_pois, comment) of tracks (keys, points), as `points_of_tracks` makes them."""
    text = lambda c: c.cast("string")
    poi = lambda p: F.struct(
        p["name"].alias("_Name"), p["at"].alias("_Pos"), p["num"].alias("_Num"), p["code"].alias("_Color"),
        F.when(p["looped"], "loop").otherwise("cue").alias("_Type"), text(p["beats"]).alias("_Size"), text(p["slot"]).alias("_Slot"),
    )
    colors = F.array_join(F.array_sort(F.array_distinct(F.transform("points", lambda p: p["color"]))), " ")
    return points.select(*keys, F.transform("points", poi).alias("new_pois"), sanitize_xml_text(colors).alias("comment"))


def replace_pois(old: Column, new: Column) -> Column:
    """Old points that stay, then the new ones. Doing it twice changes nothing: all that is made is replaceable."""
    return F.concat(surviving(old), F.coalesce(new, F.array().cast(f"array<{POI}>")))
