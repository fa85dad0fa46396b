"""Track logic: legs, segments, slow runs and their statistics.

Every window here is partitioned by mmsi first, so that one shuffle on mmsi serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealane.functions.geo import haversine_m

GAP_S = 1800
MAX_KN = 60.0
SLOW_SOG = (0.3, 5.0)


def seconds(c: Column) -> Column:
    return F.unix_micros(c) / F.lit(1e6)


def legs(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds dt_s, leg_m and leg_kn from the previous fix; leg_kn is null where no time has passed."""
    w = W.partitionBy(*(keys or ["mmsi"])).orderBy("ts")
    out = positions.withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "dt_s": seconds(F.col("ts")) - seconds(F.lag("ts").over(w))})
    out = out.withColumn("leg_m", haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).drop("_lat", "_lon")
    return out.withColumn("leg_kn", F.when(F.col("dt_s") > 0, F.col("leg_m") / 1852 / (F.col("dt_s") / 3600)))


def impossible(max_kn: float = MAX_KN) -> Column:
    return F.coalesce(F.col("leg_kn") > max_kn, F.lit(False))


def clean_segments(positions: DataFrame, max_kn: float = MAX_KN) -> DataFrame:
    """Adds clean_seg, which grows at every impossible leg, and the leg columns."""
    so_far = W.partitionBy("mmsi").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return legs(positions).withColumn("clean_seg", F.sum(impossible(max_kn).cast("int")).over(so_far).cast("long"))


def time_segments(fixes: DataFrame, keys: list[str], name: str = "time_seg", gap_s: float = GAP_S) -> DataFrame:
    """Adds a number that grows where more than ``gap_s`` has passed since the previous row."""
    w = W.partitionBy(*keys).orderBy("ts")
    late = F.coalesce(seconds(F.col("ts")) - seconds(F.lag("ts").over(w)) > gap_s, F.lit(False))
    return fixes.withColumn("_late", late.cast("int")).withColumn(name, F.sum("_late").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_late")


def slow_runs(segments: DataFrame, least: int = 3, band: tuple[float, float] = SLOW_SOG) -> DataFrame:
    """Fixes of maximal slow stretches inside time segments, with a run number; short runs go."""
    keys = ["mmsi", "clean_seg", "time_seg"]
    slow = F.coalesce(F.col("sog").between(*band), F.lit(False))
    so_far = W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    marked = segments.withColumn("_slow", slow).withColumn("run", F.sum((~F.col("_slow")).cast("int")).over(so_far).cast("long"))
    counted = marked.where("_slow").withColumn("_n", F.count("*").over(W.partitionBy(*keys, "run")))
    return counted.where(F.col("_n") >= least).drop("_n", "_slow")


def stability(cog: str = "cog") -> Column:
    """Length of the mean course vector, from at least three valid courses."""
    valid = F.when(F.col(cog) < 360, F.radians(F.col(cog)))
    length = F.sqrt(F.pow(F.avg(F.cos(valid)), 2) + F.pow(F.avg(F.sin(valid)), 2))
    return F.when(F.count(valid) >= 3, F.least(F.lit(1.0), length))


def track_stats(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of each group; leg lengths are taken between the group's own fixes."""
    w = W.partitionBy(*keys).orderBy("ts")
    inner = fixes.withColumn("_m", haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    return inner.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("duration_s"), F.coalesce(F.sum("_m"), F.lit(0.0)).alias("distance_m"),
        F.avg("sog").alias("mean_sog"), F.median("sog").alias("median_sog"), F.max("sog").alias("max_sog"),
        stability().alias("cog_stability"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.array_sort(F.collect_set("nav_status")).alias("nav_statuses"),
    )


def transit_baseline(positions: DataFrame) -> DataFrame:
    """(mmsi, baseline): the 75th percentile of speeds over 1 kn, or the largest speed if under four."""
    moving = F.when(F.col("sog") > 1.0, F.col("sog"))
    return positions.groupBy("mmsi").agg(F.when(F.count(moving) >= 4, F.percentile(moving, 0.75)).otherwise(F.max("sog")).alias("baseline"))


def stationarity(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spread_m, net_m, path_m, drift_ratio, verdict) of each group."""
    group, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("ts")
    inner = fixes.withColumns({
        "_far": haversine_m(F.avg("lat").over(group), F.avg("lon").over(group), F.col("lat"), F.col("lon")),
        "_m": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")),
    })
    here = F.struct("lat", "lon")
    out = inner.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_far").alias("spread_m"), F.min_by(here, "ts").alias("_a"), F.max_by(here, "ts").alias("_b"), F.coalesce(F.sum("_m"), F.lit(0.0)).alias("path_m"))
    out = out.withColumn("net_m", haversine_m(F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon")))
    out = out.withColumn("drift_ratio", F.when(F.col("path_m") > 1, F.col("net_m") / F.col("path_m")).otherwise(F.lit(0.0)))
    verdict = F.when((F.col("_n") < 2) | (F.col("spread_m") < 60), "BERTHED").when(F.col("drift_ratio") < 0.25, "HOLDING_STATION").when(F.col("net_m") > 500, "MAKING_GROUND").otherwise("MANOEUVRING")
    return out.withColumn("verdict", verdict).drop("_n", "_a", "_b")


def track_payload(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track): the fixes in order as [lon, lat, ts, sog, cog]."""
    point = F.struct("ts", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.round("sog", 1).alias("sog"), F.round("cog", 1).alias("cog"))
    return fixes.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("track"))


def surroundings(fixes: DataFrame, keys: list[str], before: int = 6, after: int = 5) -> DataFrame:
    """Adds the fixes around each row, ``before`` to ``after`` it, as ``around``."""
    w = W.partitionBy(*keys).orderBy("ts").rowsBetween(-before, after)
    return fixes.withColumn("around", F.collect_list(F.struct("ts", "lon", "lat", "sog", "cog")).over(w))
