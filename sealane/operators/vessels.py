"""Vessel views: latest fix, identity dossier, and who is over a cable now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealane.functions import identity
from sealane.operators.corridors import CORRIDOR_M, corridor_join, nearest_route, small

LATEST = ["lat", "lon", "sog", "cog", "heading", "nav_status"]
WATCHLIST = 200


def latest_positions(positions: DataFrame) -> DataFrame:
    """(mmsi, ts, ...): each column's last value that is not null, column by column."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in LATEST if c in positions.columns]
    return positions.groupBy("mmsi").agg(F.max("ts").alias("ts"), *last)


def _values(c: str) -> Column:
    text = F.trim(F.col(c))
    return F.array_sort(F.collect_set(F.when(~text.isin("", "nan", "None"), text)))


def _last(c: str) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_seq")))


def number_or_none(c: Column) -> Column:
    value = c.try_cast("double")
    return F.round(F.when(~F.isnan(value) & (value != 0), value), 2)


def dossiers(static: DataFrame, places: DataFrame | None = None, mids: DataFrame | None = None) -> DataFrame:
    """One row for each mmsi of ``static`` (arrival order in _seq) with all it has said of itself.

    The name, callsign and IMO number shown are the first of the sorted values, the destination the
    last.  ``places`` (mmsi, lat, lon) adds a place to the links.
    """
    rows = static.groupBy("mmsi").agg(
        _values("name").alias("names"), _values("callsign").alias("callsigns"), _values("imo").alias("imos"), _values("ship_type").alias("ship_types"), _values("destination").alias("destinations"),
        _last("cargo_type").alias("cargo_type"), number_or_none(_last("length")).alias("length_m"), number_or_none(_last("width")).alias("width_m"), number_or_none(_last("draught")).alias("draught_m"), _last("eta").alias("eta"),
    )
    rows = identity.decode_mmsi(rows, mids)
    first = lambda c: F.get(F.col(c), F.lit(0))
    rows = rows.withColumns({"name": first("names"), "callsign": first("callsigns"), "imo": first("imos"), "ship_type": first("ship_types"), "destination": F.try_element_at("destinations", F.lit(-1))})
    churn = F.filter(F.array(*[F.when(F.size(many) > 1, F.lit(label)) for label, many in (("name", "names"), ("callsign", "callsigns"), ("imo", "imos"))]), lambda x: x.isNotNull())
    rows = rows.withColumns({"identity_churn": churn, "imo_present": identity.imo_present(F.col("imo")), "imo_valid": identity.imo_valid(F.col("imo"))})
    rows = rows.withColumn("integrity_notes", identity.integrity_notes(F.col("flag_from_mid"), F.col("low_transparency_registry"), F.col("imo"), F.col("identity_churn")))
    if places is not None:
        rows = rows.join(places.select("mmsi", "lat", "lon"), "mmsi", "left")
    lat, lon = (F.col("lat"), F.col("lon")) if places is not None else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    return rows.withColumn("pivots", identity.pivots(F.col("mmsi"), F.col("imo"), F.col("name"), lat, lon))


def vessel_layer(positions: DataFrame, routes: DataFrame, reach_m: float = CORRIDOR_M) -> DataFrame:
    """Latest fix of each vessel with the nearest route and the routes whose corridor it is in."""
    latest = latest_positions(positions).persist()
    named = routes.select("route_idx", "name", "positional_class")
    hits = corridor_join(latest, routes, reach_m, ["mmsi"]).join(small(named), "route_idx")
    inside = hits.groupBy("mmsi").agg(F.array_sort(F.collect_set("name")).alias("cables"), F.array_sort(F.collect_set("positional_class")).alias("cable_positional_class"))
    near = nearest_route(latest, routes, ["mmsi"]).join(small(named.select("route_idx", F.col("name").alias("nearest_cable"))), "route_idx").select("mmsi", "nearest_cable", F.col("nearest_m").cast("long").alias("nearest_m"))
    out = latest.join(near, "mmsi", "left").join(inside, "mmsi", "left")
    out = out.withColumns({"in_corridor": F.col("cables").isNotNull(), "sog": F.round("sog", 1), "cog": F.round("cog", 1)})
    return out.withColumn("colour", F.when(F.col("in_corridor") & (F.coalesce("sog", F.lit(99.0)) < 2), "stopped_in_corridor").when(F.col("in_corridor"), "in_corridor").otherwise("other"))


def watchlist(layer: DataFrame, most: int | None = None) -> DataFrame:
    """Vessels in a corridor, slowest first, then nearest."""
    out = layer.where("in_corridor").orderBy(F.coalesce("sog", F.lit(99.0)), F.coalesce("nearest_m", F.lit(0)), "mmsi")
    return out if most is None else out.limit(most)
