"""Places where vessels normally stop: learned grid cells and seeded points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealane.functions.geo import cell, haversine_m
from sealane.operators.corridors import cells_near, cells_of_points

STOPPED_SOG = 1.0
LEARN_VESSELS = 4
PORT_M, LANDING_M = 4_000.0, 2_500.0
EXPORTED_PER_CELL = 40


def stopped_cells(positions: DataFrame) -> DataFrame:
    """(cell_y, cell_x, mmsi), distinct: who stopped in which cell."""
    stopped = positions.where(F.coalesce("sog", F.lit(99.0)) <= STOPPED_SOG)
    return stopped.select(cell(F.col("lat")).alias("cell_y"), cell(F.col("lon")).alias("cell_x"), "mmsi").distinct()


def merged(state: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if state is None else state.unionByName(new).distinct()


def learned_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_y", "cell_x").agg(F.count_distinct("mmsi").alias("vessels"))


def learned_near(points: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, vessels): the most vessels learned in one of the nine cells around each point."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = points.select(*key, cell(F.col("lat")).alias("y"), cell(F.col("lon")).alias("x")).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    around = around.select(*key, (F.col("y") + F.col("dy")).alias("cell_y"), (F.col("x") + F.col("dx")).alias("cell_x"))
    return around.join(learned_cells(cells), ["cell_y", "cell_x"]).groupBy(*key).agg(F.max("vessels").alias("vessels"))


def seeded_near(points: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """(key, label): the nearest seed point whose radius holds the point; seeds(lat, lon, radius_m, label)."""
    reach = float(seeds.agg(F.max("radius_m")).first()[0] or 1.0)
    boxes = seeds.select(F.monotonically_increasing_id().alias("route_idx"), *[F.col(c).alias(f"{c}{k}") for k in (1, 2) for c in ("lat", "lon")], F.col("radius_m"), F.col("label"))
    near = cells_near(boxes, reach).drop("route_idx").withColumnRenamed("cell_row", "_r").withColumnRenamed("cell_col", "_c")
    placed = cells_of_points(points.select(*key, "lat", "lon"), reach)
    pairs = placed.join(near, (placed["cell_row"] == near["_r"]) & (placed["cell_col"] == near["_c"]))
    pairs = pairs.withColumn("_m", haversine_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"))).where("_m <= radius_m")
    return pairs.groupBy(*key).agg(F.min_by("label", F.struct("_m", "label")).alias("label"), F.min("_m").alias("away_m"))


def why_normal(points: DataFrame, key: list[str], cells: DataFrame | None, seeds: DataFrame | None) -> DataFrame:
    """(key, reason) of the points at which stopping is normal."""
    reasons = []
    if seeds is not None:
        reasons.append(seeded_near(points, seeds, key).select(*key, F.lit(1).alias("_rank"), F.format_string("Within %.1f km of %s. Vessels stop here routinely.", F.col("away_m") / 1000, "label").alias("reason")))
    if cells is not None:
        near = learned_near(points, cells, key).where(F.col("vessels") >= LEARN_VESSELS)
        reasons.append(near.select(*key, F.lit(0).alias("_rank"), F.format_string("%d distinct vessels have been observed stationary in this cell.", "vessels").alias("reason")))
    if not reasons:
        return points.select(*key, F.lit("").alias("reason")).limit(0)
    whole = reasons[0] if len(reasons) == 1 else reasons[0].unionByName(reasons[1])
    return whole.groupBy(*key).agg(F.min_by("reason", "_rank").alias("reason"))


def stats(cells: DataFrame, n_seeds: Column | int = 0) -> DataFrame:
    seeds = n_seeds if isinstance(n_seeds, Column) else F.lit(n_seeds)
    return learned_cells(cells).agg(F.count("*").alias("cells_tracked"), F.count_if(F.col("vessels") >= LEARN_VESSELS).alias("cells_suppressing")).withColumn("seed_points", seeds)


def exported(cells: DataFrame) -> DataFrame:
    """(cell, vessels): each cell's smallest identities, as the state file keeps them."""
    key = F.concat_ws(":", "cell_y", "cell_x").alias("cell")
    return cells.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("mmsi")), 1, EXPORTED_PER_CELL).alias("vessels"))
