"""Ship tracks made from the ``events`` table: its entities and order, re-timed and placed by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealane.functions.geo import densify

ROUTE_LON, ROUTE_LAT = 24.80, (59.60, 60.10)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical positions in eight roles (user_id mod 8): two kinds of drag, loiter, survey, gap,
    transit, a shared identity and a berth."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    d = lambda x: F.lit(float(x))
    n, role, u, leg, k = (F.col(c) for c in ("n", "role", "u", "leg", "k"))
    e = e.withColumns({"n": F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1, "role": F.pmod("user_id", F.lit(8)), "u": F.col("value") - F.floor("value")})
    e = e.withColumns({"leg": F.expr("n div 8"), "k": F.pmod(n, F.lit(8))})

    def by_role(*values):
        out = F.when(role == 0, values[0])
        for r, v in enumerate(values[1:], 1):
            out = out.when(role == r, v)
        return out

    lat = by_role(d(59.85), d(59.85), d(59.62) + F.pmod("user_id", F.lit(150)) * d(0.003) + (u - d(0.5)) * d(0.002), d(59.80) + leg * d(0.012), d(59.85), d(59.85), F.when(n % 2 == 0, d(59.8)).otherwise(d(35.9)), d(59.70) + (u - d(0.5)) * d(0.0004))
    lon = by_role(
        F.when(n < 24, d(24.70) - (d(24) - n) * d(0.0265)).otherwise(d(24.70) + (n - d(24)) * d(0.00486)), d(24.70) + n * d(0.00486), d(24.80) + (d(0.5) - u) * d(0.002),
        d(24.765) + F.when(leg % 2 == 0, k.cast("double")).otherwise(d(7) - k) * d(0.00928), F.when(n < 30, d(24.79) - (d(30) - n) * d(0.0221)).otherwise(d(24.95) + (n - d(30)) * d(0.0221)),
        d(24.30) + n * d(0.0298), F.when(n % 2 == 0, d(24.8)).otherwise(d(14.5)), d(24.801) + (u - d(0.5)) * d(0.0004),
    )
    sog = by_role(F.when(n < 24, d(12)).otherwise(d(2.2)), d(2.2), d(0.4), d(4.2), d(10), d(13.5), d(8), d(0.1))
    east, wander = d(90) + (u - d(0.5)), F.pmod(F.floor(F.col("value") * 7), F.lit(360)).cast("double")
    cog = by_role(east, east, wander, F.when(leg % 2 == 0, d(90)).otherwise(d(270)), east, east, east, wander)
    seconds = F.lit(1704067200) + F.lit(240) * n + F.when((role == 4) & (n >= 30), 25200).otherwise(0)
    return e.select(
        F.timestamp_seconds(seconds).alias("ts"), (F.lit(230000000) + F.col("user_id")).cast("long").alias("mmsi"), lat.alias("lat"), lon.alias("lon"), sog.alias("sog"), cog.alias("cog"),
        F.lit(None).cast("double").alias("heading"), F.when(role == 7, "Moored").otherwise("Under way using engine").alias("nav_status"), F.lit("events").alias("source"),
    )


def meridian(spark: SparkSession, positional_class: str = "CHARTED") -> DataFrame:
    line = F.array(*[F.struct(F.lit(ROUTE_LON).alias("lon"), F.lit(lat).alias("lat")) for lat in ROUTE_LAT])
    return spark.range(1).select(F.lit(0).cast("long").alias("route_idx"), F.lit("t1").alias("cable_id"), F.lit("Test cable").alias("name"), F.lit(positional_class).alias("positional_class"), F.lit("fixture").alias("source"), densify(line).alias("line"))
