"""Track quality: impossible legs and identities that several hulls share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealane.operators.extent import far_apart
from sealane.operators.tracks import MAX_KN, clean_segments, impossible

LEAST_BAD_LEGS = 4
LEAST_SEPARATION_M = 200_000.0


def track_quality(positions: DataFrame, segmented: DataFrame | None = None, max_kn: float = MAX_KN) -> DataFrame:
    """(mmsi, verdict, n_positions, n_impossible_legs, max_implied_kn, n_segments, usable).

    Separations between segments are only looked at for tracks with LEAST_BAD_LEGS or more bad legs:
    others cannot be collisions.
    """
    segmented = clean_segments(positions, max_kn) if segmented is None else segmented
    counts = segmented.groupBy("mmsi").agg(
        F.count("*").alias("n_positions"), F.sum(impossible(max_kn).cast("long")).alias("n_impossible_legs"), F.max("leg_kn").alias("max_implied_kn"), (F.max("clean_seg") + 1).alias("n_segments")
    )
    bad = counts.where(F.col("n_impossible_legs") >= LEAST_BAD_LEGS).select("mmsi")
    centres = segmented.join(bad, "mmsi", "left_semi").groupBy("mmsi", "clean_seg").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    out = counts.join(far_apart(centres.select("mmsi", "lat", "lon"), ["mmsi"], LEAST_SEPARATION_M), "mmsi", "left")
    shared = (F.col("n_impossible_legs") >= LEAST_BAD_LEGS) & F.coalesce("apart", F.lit(False))
    verdict = F.when(F.col("n_impossible_legs") == 0, "CLEAN").when(shared, "PROBABLE_MMSI_COLLISION").otherwise("SUSPECT_DECODE")
    return out.select("mmsi", verdict.alias("verdict"), "n_positions", "n_impossible_legs", "max_implied_kn", "n_segments", (verdict != "PROBABLE_MMSI_COLLISION").alias("usable"))


def usable(positions: DataFrame, quality: DataFrame) -> DataFrame:
    """Positions of tracks that behaviour can be read from: two fixes or more, no shared identity."""
    return positions.join(quality.where("usable AND n_positions >= 2").select("mmsi"), "mmsi", "left_semi")
