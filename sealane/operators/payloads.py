"""What a map draws of a detection's track: segments, their colours, its bounds; and links by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knots under which a stretch counts as slow, and seconds after which it is a guess over a silence.
SLOW_KN, SILENT_S = 5.0, 1800.0


def track_segments(track: Column) -> Column:
    """array<struct<from, to, seconds, sog, kind>> of neighbouring fixes of a track (array<struct<ts,lon,lat,sog,cog>> in order).

    A stretch takes the later fix's speed, 0 where it has none.  Its kind is ``silent`` over a long silence, ``slow``,
    ``under_way``, or ``unknown`` without a speed.  Tracks of fewer than two fixes have none; a null track is null.
    """

    def pair(a: Column, b: Column) -> Column:
        gap = (F.unix_micros(b["ts"]) - F.unix_micros(a["ts"])) / F.lit(1e6)
        kind = F.when(gap > SILENT_S, "silent").when(b["sog"] < SLOW_KN, "slow").when(b["sog"].isNotNull(), "under_way").otherwise("unknown")
        place = lambda p, name: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")).alias(name)
        return F.struct(place(a, "from"), place(b, "to"), gap.alias("seconds"), F.coalesce(b["sog"], F.lit(0.0)).alias("sog"), kind.alias("kind"))

    whole = F.zip_with(F.slice(track, 1, F.greatest(F.lit(0), F.size(track) - 1)), F.slice(track, 2, F.greatest(F.lit(0), F.size(track) - 1)), pair)
    return F.when(F.size(track) >= 2, whole).when(track.isNotNull(), F.slice(whole, 1, 0))


def track_bounds(track: Column) -> Column:
    """struct<west, south, east, north> of a track's fixes; null for one without places.

    A track that is more than half a turn wide is taken over the antimeridian: its west is then
    larger than its east.
    """
    lon, lat = (F.filter(track.getField(c), lambda x: x.isNotNull()) for c in ("lon", "lat"))
    over = F.array_max(lon) - F.array_min(lon) > 180
    west = F.when(over, F.array_min(F.filter(lon, lambda x: x >= 0))).otherwise(F.array_min(lon))
    east = F.when(over, F.array_max(F.filter(lon, lambda x: x < 0))).otherwise(F.array_max(lon))
    bounds = F.struct(west.alias("west"), F.array_min(lat).alias("south"), east.alias("east"), F.array_max(lat).alias("north"))
    return F.when((F.size(lon) > 0) & (F.size(lat) > 0), bounds)


def grouped_links(links: Column) -> Column:
    """map<group, array<struct<label, url>>> of links (array<struct<group, label, url, ...>>), each group in the order of its links."""
    groups = F.array_distinct(F.transform(links, lambda x: x["group"]))
    entry = lambda g: F.struct(g.alias("key"), F.transform(F.filter(links, lambda x: x["group"] == g), lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"))).alias("value"))
    return F.map_from_entries(F.transform(groups, entry))


def facets(detections: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): how many detections have each value of each column, in one pass."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return detections.select(values.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n")).where("value IS NOT NULL")


def chosen(detections: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Detections that have one of the wanted values of each column; an empty list wants all."""
    for column, values in wanted.items():
        if values:
            detections = detections.where(F.col(column).isin(values))
    return detections
