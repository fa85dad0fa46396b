"""Cable routes from GeoJSON: display layers and charted files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.functions.ais import loose_float
from sealane.functions.geo import densify
from sealane.operators.order import numbered

_GEOJSON = "features array<struct<properties:struct<id:string,name:string,OBJNAM:string,owners:string,rfs:string,length:string>,geometry:struct<type:string,coordinates:string>>>"
_POINT = "array<double>"


def _lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, feature, part, properties, line): each line of LineString and MultiLineString features."""
    reader = spark.read.schema(_GEOJSON).option("multiLine", True)
    f = (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)
    f = f.select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("feature", "f")).select("file", "feature", "f.properties", "f.geometry.type", "f.geometry.coordinates")
    one, many = F.array(F.from_json("coordinates", f"array<{_POINT}>")), F.from_json("coordinates", f"array<array<{_POINT}>>")
    parts = f.select("file", "feature", "properties", F.posexplode(F.when(F.col("type") == "LineString", one).when(F.col("type") == "MultiLineString", many)).alias("part", "xy"))
    line = F.transform("xy", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return parts.select("file", "feature", "part", "properties", line.alias("line")).where(F.size("line") >= 2)


def _in_box(line, bbox):
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return (F.array_min(lon) <= bbox[2]) & (F.array_max(lon) >= bbox[0]) & (F.array_min(lat) <= bbox[3]) & (F.array_max(lat) >= bbox[1])


def _routes(lines: DataFrame, cable_id, name, positional_class: str, source: str, step_m: float) -> DataFrame:
    p = F.col("properties")
    return lines.select(cable_id.alias("cable_id"), name.alias("name"), F.lit(positional_class).alias("positional_class"), F.lit(source).alias("source"), densify(F.col("line"), step_m).alias("line"), F.col("line").alias("display_line"), p["owners"].alias("owners"), p["rfs"].alias("rfs"), loose_float(p["length"]).alias("length_km"))


def display_routes(spark: SparkSession, path: str, source: str, bbox=None, step_m: float = 2000.0) -> DataFrame:
    """Cartographic routes: a system's first line keeps its id, others get ``:part``."""
    lines = _lines(spark, path)
    if bbox:
        lines = lines.where(_in_box("line", bbox))
    cid = F.coalesce(F.col("properties.id"), F.col("feature").cast("string"))
    return _routes(lines, F.when(F.col("part") == 0, cid).otherwise(F.concat_ws(":", cid, "part")), F.coalesce("properties.name", cid), "DISPLAY", source, step_m)


def charted_routes(spark: SparkSession, path: str, label: str, prefix: str = "enc", bbox=None, step_m: float = 2000.0, positional_class: str = "CHARTED") -> DataFrame:
    """Routes of surveyed or local files; ids are prefix:label:feature:part."""
    lines = _lines(spark, path)
    if bbox:
        lines = lines.where(_in_box("line", bbox))
    cid = F.concat(F.lit(f"{prefix}:{label}:"), F.concat_ws(":", "feature", "part"))
    return _routes(lines, cid, F.coalesce("properties.OBJNAM", "properties.name", F.lit(label)), positional_class, label, step_m)


_SIDECAR = "positional_class string, source string, stated_accuracy_m double"


def folder_routes(spark: SparkSession, folder: str, bbox=None, step_m: float = 2000.0) -> DataFrame:
    """Routes of all GeoJSON files of a folder, each with what the sidecar beside it says.

    ``name.meta.json`` states the class, source and accuracy of ``name.geojson`` or ``name.json``.
    Without one, or where it cannot be read or says anything else than CHARTED, geometry is DISPLAY:
    to take a drawing for a survey would be the worse mistake.  Files are told apart by their
    metadata, so sidecars are never read as routes.
    """
    stem = lambda c, ending: F.regexp_replace(c, ending, "")
    lines = _lines(spark, folder, "*json").where(~F.col("file").endswith(".meta.json") & F.col("file").rlike(r"\.(geo)?json$"))
    if bbox:
        lines = lines.where(_in_box("line", bbox))
    side = spark.read.schema(_SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(folder)
    side = side.select(stem(F.col("_metadata.file_name"), r"\.meta\.json$").alias("stem"), F.upper("positional_class").alias("said"), F.col("source").alias("label"), "stated_accuracy_m").dropDuplicates(["stem"])
    known = lines.withColumn("stem", stem(F.col("file"), r"\.(geo)?json$")).join(side, "stem", "left")
    klass = F.when(F.col("said") == "CHARTED", "CHARTED").otherwise("DISPLAY")
    label = F.coalesce("label", F.concat(F.lit("local:"), F.col("file")))
    cid = F.concat_ws(":", F.when(klass == "CHARTED", "enc").otherwise("geo"), label, "feature", "part")
    p = F.col("properties")
    return known.select(cid.alias("cable_id"), F.coalesce(p["OBJNAM"], p["name"], label).alias("name"), klass.alias("positional_class"), label.alias("source"), densify(F.col("line"), step_m).alias("line"), F.col("line").alias("display_line"), p["owners"].alias("owners"), p["rfs"].alias("rfs"), loose_float(p["length"]).alias("length_km"), "stated_accuracy_m")


def with_metadata(routes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Owners, year and length of each route's system from ``metadata`` (id, owners, rfs, length), where it has them.

    A route's system is its id up to the first colon that marks a part.  Of several rows of one id
    the first by their values counts; routes without a row keep what they have.
    """
    meta = metadata.groupBy(F.col("id").alias("_system")).agg(F.min(F.struct("owners", "rfs", "length")).alias("_meta"))
    out = routes.withColumn("_system", F.regexp_replace("cable_id", r":\d+$", "")).join(meta, "_system", "left")
    found = {"owners": F.coalesce("_meta.owners", "owners"), "rfs": F.coalesce("_meta.rfs", "rfs"), "length_km": F.coalesce(loose_float(F.col("_meta.length")), "length_km")}
    return out.withColumns(found).select(*routes.columns)


def landing_points(spark: SparkSession, path: str, bbox=None) -> DataFrame:
    """(lon, lat, name, properties as JSON) of Point features; inside a box, edges included."""
    schema = "features array<struct<geometry:struct<coordinates:array<double>>,properties:string>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select(F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get_json_object("f.properties", "$.name").alias("name"), F.col("f.properties").alias("properties"))
    f = f.where("lon IS NOT NULL AND lat IS NOT NULL")
    return f.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])) if bbox else f


def assembled(*parts: DataFrame) -> DataFrame:
    """One route table with route_idx, in the order given."""
    whole = None
    for k, part in enumerate(parts):
        part = part.withColumn("_k", F.lit(k))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return numbered(whole, {"k": F.col("_k"), "cable_id": F.col("cable_id")}, "route_idx", first=0).drop("_k")
