"""The canonical tables and how any feed is brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIONS = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("mmsi", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "sog", "cog", "heading")], *[T.StructField(c, T.StringType()) for c in ("nav_status", "source")]])
STATIC = T.StructType([T.StructField("mmsi", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("imo", "callsign", "name", "ship_type", "cargo_type", "destination", "eta", "source")], *[T.StructField(c, T.DoubleType()) for c in ("length", "width", "draught")]])
FAULTS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("fault_id", "start", "end", "kind", "asset", "detail", "source_label", "source_url")], *[T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "radius_km")]])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: values that do not convert are null, NaN is null, extra
    columns go, missing ones are null.  Rows without an mmsi go."""
    out = []
    for field in schema:
        if field.name not in df.columns:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.TimestampType) and dict(df.dtypes)[field.name].startswith("timestamp"):
            value = F.col(field.name).cast("timestamp")
        else:
            value = F.col(field.name).try_cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(field.name))
    df = df.select(*out)
    return df.where("mmsi IS NOT NULL") if "mmsi" in df.columns else df


def last_values(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(mmsi, columns): each column's last value that is not null, in the order of ``order``."""
    return rows.groupBy("mmsi").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
