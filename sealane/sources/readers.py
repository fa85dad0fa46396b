"""Scans of landed feeds: snapshots, stream messages, daily files, faults, events and the archive.

Network collection happens outside Spark; what it lands is read here, with schemas given so that
nothing is inferred, and with filters on columns that reach the scan.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.csv as csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sealane.functions import ais
from sealane.functions.geo import bbox_contains
from sealane.sources.feed import store
from sealane.sources.schema import FAULTS, POSITIONS, STATIC, conform, empty, last_values

Bbox = tuple[float, float, float, float]
WORLD: Bbox = (-180.0, -90.0, 180.0, 90.0)
STATIC_TEXT = ["imo", "callsign", "name", "ship_type", "cargo_type", "destination", "eta"]

_SNAPSHOT = "features array<struct<mmsi:bigint,geometry:struct<coordinates:array<double>>,properties:struct<sog:double,cog:double,heading:double,navStat:int,timestampExternal:double,timestamp:double,time:double>>>"
_VESSELS = "mmsi bigint, name string, callSign string, imo bigint, destination string, eta bigint, draught double, shipType int, referencePointA double, referencePointB double, referencePointC double, referencePointD double"
_MESSAGE = (
    "MessageType string, MetaData struct<MMSI:bigint,ShipName:string,latitude:double,longitude:double,time_utc:string>,"
    " Message struct<PositionReport:struct<UserID:bigint,Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:double,NavigationalStatus:int>,"
    "ShipStaticData:struct<UserID:bigint,Name:string,CallSign:string,ImoNumber:bigint,Destination:string,MaximumStaticDraught:double,Type:int,Dimension:struct<A:double,B:double,C:double,D:double>,Eta:struct<Month:int,Day:int,Hour:int,Minute:int>>>"
)


def snapshot_positions(spark: SparkSession, path: str, bbox: Bbox = WORLD, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Positions of a landed GeoJSON snapshot; bounds are inclusive."""
    f = spark.read.schema(_SNAPSHOT).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.mmsi", F.col("f.geometry.coordinates").alias("xy"), "f.properties.*")
    out = f.select(
        ais.first_epoch(F.col("timestampExternal"), F.col("timestamp"), F.col("time")).alias("ts"), "mmsi", F.get("xy", F.lit(1)).alias("lat"), F.get("xy", F.lit(0)).alias("lon"), ais.below(F.col("sog"), ais.SOG_NONE).alias("sog"),
        ais.below(F.col("cog"), ais.COG_NONE).alias("cog"), ais.below(F.col("heading"), ais.HEADING_NONE).alias("heading"), ais.nav_status(F.col("navStat")).alias("nav_status"), F.lit("snapshot").alias("source"),
    )
    return conform(between(out.where(bbox_contains(F.col("lon"), F.col("lat"), bbox)), start, end), POSITIONS)


def snapshot_static(spark: SparkSession, path: str) -> DataFrame:
    v = spark.read.schema(_VESSELS).json(path, multiLine=True)
    out = v.select(
        "mmsi", F.when(F.col("imo") != 0, F.col("imo").cast("string")).alias("imo"), ais.clean_text(F.col("callSign")).alias("callsign"), ais.clean_text(F.col("name")).alias("name"), ais.ship_type(F.col("shipType")).alias("ship_type"),
        ais.cargo_hazard(F.col("shipType")).alias("cargo_type"), ais.clean_text(F.col("destination")).alias("destination"), F.col("eta").cast("string").alias("eta"), F.lit("snapshot").alias("source"),
        ais.dimension(F.col("referencePointA"), F.col("referencePointB")).alias("length"), ais.dimension(F.col("referencePointC"), F.col("referencePointD")).alias("width"), (F.col("draught") / 10).alias("draught"),
    )
    return conform(out, STATIC)


def messages(raw: DataFrame) -> DataFrame:
    """Stream messages (column value: JSON text) as structs; broken ones are null and go."""
    return raw.select(F.from_json("value", _MESSAGE).alias("m")).where("m.MessageType IS NOT NULL").select("m.*")


def stream_positions(parsed: DataFrame) -> DataFrame:
    """Works on a batch and on a stream; coordinates fall back to the envelope's."""
    p, meta = F.col("Message.PositionReport"), F.col("MetaData")
    rows = parsed.where("MessageType = 'PositionReport'").select(
        F.coalesce(ais.go_time(meta["time_utc"]), F.current_timestamp()).alias("ts"), F.coalesce(meta["MMSI"], p["UserID"]).alias("mmsi"), F.coalesce(p["Latitude"], meta["latitude"]).alias("lat"), F.coalesce(p["Longitude"], meta["longitude"]).alias("lon"),
        ais.below(p["Sog"], ais.SOG_NONE).alias("sog"), ais.below(p["Cog"], ais.COG_NONE).alias("cog"), ais.below(p["TrueHeading"], ais.HEADING_NONE).alias("heading"), ais.nav_status(p["NavigationalStatus"], ais.STREAM_NAV_STATUS).alias("nav_status"), F.lit("stream").alias("source"),
    )
    rows = conform(rows.where(bbox_contains(F.col("lon"), F.col("lat"), WORLD)), POSITIONS)
    return rows if rows.isStreaming else rows.dropDuplicates(["mmsi", "ts"])


def stream_static(parsed: DataFrame) -> DataFrame:
    s, meta = F.col("Message.ShipStaticData"), F.col("MetaData")
    eta = F.when(s["Eta"]["Month"] > 0, F.format_string("%02d-%02d %02d:%02d", s["Eta"]["Month"], s["Eta"]["Day"], s["Eta"]["Hour"], s["Eta"]["Minute"]))
    rows = parsed.where("MessageType = 'ShipStaticData'").select(
        F.coalesce(meta["MMSI"], s["UserID"]).alias("mmsi"), F.when(s["ImoNumber"] != 0, s["ImoNumber"].cast("string")).alias("imo"), ais.clean_text(s["CallSign"]).alias("callsign"), F.coalesce(ais.clean_text(s["Name"]), ais.clean_text(meta["ShipName"])).alias("name"),
        ais.ship_type(s["Type"]).alias("ship_type"), ais.cargo_hazard(s["Type"]).alias("cargo_type"), ais.clean_text(s["Destination"]).alias("destination"), eta.alias("eta"), F.lit("stream").alias("source"),
        ais.dimension(s["Dimension"]["A"], s["Dimension"]["B"]).alias("length"), ais.dimension(s["Dimension"]["C"], s["Dimension"]["D"]).alias("width"), F.when(s["MaximumStaticDraught"] != 0, s["MaximumStaticDraught"]).alias("draught"), ais.go_time(meta["time_utc"]).alias("_at"),
    )
    return last_values(rows, "_at", [*STATIC_TEXT, "source", "length", "width", "draught"])


DAILY = "`# Timestamp` string, `Type of mobile` string, MMSI string, Latitude double, Longitude double, `Navigational status` string, SOG double, COG double, Heading double, IMO string, Callsign string, Name string, `Ship type` string, `Cargo type` string, Width double, Length double, Draught double, Destination string, ETA string"


def daily_rows(spark: SparkSession, path: str, bbox: Bbox = WORLD) -> DataFrame:
    """Rows of unzipped daily CSV files (with this header order) of class A and B mobiles in an area."""
    return _daily(spark.read.schema(DAILY).csv(path, header=True), bbox)


def _daily(raw: DataFrame, bbox: Bbox) -> DataFrame:
    rows = raw.where(bbox_contains(F.col("Longitude"), F.col("Latitude"), bbox) & F.col("Type of mobile").startswith("Class"))
    return rows.withColumns({"ts": F.try_to_timestamp("# Timestamp", F.lit("dd/MM/yyyy HH:mm:ss")), "mmsi": F.col("MMSI").try_cast("long")})


#: Bytes of a daily file that are decompressed and parsed at a time.
BLOCK = 8 << 20


def zipped_daily_rows(spark: SparkSession, path: str, bbox: Bbox = WORLD) -> DataFrame:
    """The same from zip archives of a day each, whatever the order of their columns.

    An archive is a task's work: its first CSV file is decompressed as it is read, a block at a time,
    so memory does not follow its size.  Columns go by the names in the header; absent ones are null
    and others are never parsed.  Numbers that are none are null.  Archives without a CSV have no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(DAILY)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, place = store(uri)
                with fs.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
                    member = next((n for n in archive.namelist() if n.lower().endswith(".csv")), None)
                    if member is None or not archive.getinfo(member).file_size:
                        continue
                    options = csv.ConvertOptions(include_columns=list(kinds), include_missing_columns=True, column_types=dict.fromkeys(kinds, pa.string()), strings_can_be_null=True)
                    with archive.open(member) as text:
                        yield from csv.open_csv(text, read_options=csv.ReadOptions(block_size=BLOCK), convert_options=options)

    # Of binary files only the paths are asked for, so none of them is read here; each is a partition's worth by its size.
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    text = paths.repartition(max(1, paths.count()), "path").mapInArrow(run, ", ".join(f"`{c}` string" for c in kinds))
    return _daily(text.select(*[F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in kinds.items()]), bbox)


def daily_positions(rows: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    out = rows.select("ts", "mmsi", F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.col("SOG").alias("sog"), F.col("COG").alias("cog"), F.col("Heading").alias("heading"), F.col("Navigational status").alias("nav_status"), F.lit("daily").alias("source"))
    return conform(between(out, start, end), POSITIONS)


def daily_static(rows: DataFrame) -> DataFrame:
    """Last known value of each column in arrival order; placeholders are null."""
    text = lambda c: F.when(~F.trim(c).isin("", "Unknown", "Undefined"), c)
    out = rows.select("mmsi", *[text(F.col(a)).alias(b) for a, b in (("IMO", "imo"), ("Callsign", "callsign"), ("Name", "name"), ("Ship type", "ship_type"), ("Cargo type", "cargo_type"), ("Destination", "destination"), ("ETA", "eta"))], F.col("Length").alias("length"), F.col("Width").alias("width"), F.col("Draught").alias("draught"), F.monotonically_increasing_id().alias("_at"))
    return conform(last_values(out, "_at", [*STATIC_TEXT, "length", "width", "draught"]).withColumn("source", F.lit("daily")), STATIC)


def between(rows: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start))
    return rows if end is None else rows.where(F.col("ts") <= F.lit(end))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """A list of faults or {"faults": [...]}; entries without an id or readable times go."""
    item = FAULTS.simpleString()
    text = spark.read.text(path, wholetext=True)
    listed, wrapped = F.from_json("value", f"array<{item}>"), F.from_json("value", f"struct<faults:array<{item}>>")["faults"]
    is_list = F.ltrim(F.col("value")).startswith("[")
    rows = text.select(F.explode(F.when(is_list, listed).otherwise(wrapped)).alias("f")).select("f.*")
    rows = rows.withColumns({"start": ais.parse_iso(F.col("start")), "end": ais.parse_iso(F.col("end")), "radius_km": F.coalesce("radius_km", F.lit(150.0))})
    return rows.where("fault_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")


_EVENTS = "entries array<struct<id:string,start:string,end:string,position:struct<lat:double,lon:double>,vessel:struct<ssvid:string,mmsi:string,name:string,flag:string>,gap:struct<durationHours:double>,durationHours:double>>"


def external_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed event pages of one kind (GAP, LOITERING, ENCOUNTER)."""
    e = spark.read.schema(_EVENTS).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    when = lambda c: F.try_to_timestamp(F.substring(F.regexp_replace(c, "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return e.select(F.col("id").alias("event_id"), F.lit(kind).alias("kind"), F.coalesce("vessel.ssvid", "vessel.mmsi").alias("ssvid"), F.col("position.lat").alias("lat"), F.col("position.lon").alias("lon"), when(F.col("start")).alias("start"), when(F.col("end")).alias("end"), F.coalesce("gap.durationHours", "durationHours").alias("hours"))


def archive_positions(spark: SparkSession, path: str, since: datetime) -> DataFrame:
    """Archived positions from ``since`` on; day folders before the day before it are not listed."""
    first_day = (since - timedelta(days=1)).date()
    rows = spark.read.parquet(path).where((F.col("date") >= F.lit(first_day)) & (F.col("ts") >= F.lit(since)))
    return rows.drop("date").dropDuplicates(["mmsi", "ts"])


def newest_files(spark: SparkSession, path: str, most: int) -> list[str]:
    """Paths of the ``most`` newest Parquet files of a folder by name, which begins with their time; only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return sorted(r.path for r in files.orderBy(F.col("path").desc()).limit(most).collect())


#: Files of vessel data that a run reads, the newest ones.
STATIC_FILES = 200


def archive_static(spark: SparkSession, path: str, most: int = STATIC_FILES) -> DataFrame:
    """Distinct vessel data of the newest files; the others are not opened.  A folder without files has no rows."""
    newest = newest_files(spark, path, most)
    rows = spark.read.schema(STATIC).parquet(*newest) if newest else empty(spark, STATIC)
    return rows.dropDuplicates(["mmsi", "name", "imo", "callsign", "destination"])


_ALERTS = "data array<struct<time:string,datasource:string,level:string>>"
#: Hours that an alert stands for, and kilometres around nowhere in particular that it may bear on.
ALERT_HOURS, ALERT_KM = 6, 400.0


def outage_alerts(spark: SparkSession, path: str, country: str, label: str = "", url: str = "") -> DataFrame:
    """Landed connectivity alerts of a country as faults without a place: weak evidence for any cable.

    Alerts without a readable time are left out.
    """
    a = spark.read.schema(_ALERTS).json(path, multiLine=True).select(F.explode("data").alias("a")).select("a.*")
    a = a.withColumn("start", F.timestamp_seconds(F.col("time").try_cast("long"))).where("start IS NOT NULL")
    text = lambda c: F.coalesce(c, F.lit(""))
    return a.select(
        F.concat_ws(":", F.lit("outage"), F.lit(country), "time", text("datasource")).alias("fault_id"), "start", (F.col("start") + F.expr(f"INTERVAL {ALERT_HOURS} HOURS")).alias("end"), F.lit("passive_outage").alias("kind"),
        F.lit(f"{country}: connectivity of the country").alias("asset"), F.concat(F.lit("alert of "), text("datasource"), F.lit(", level "), text("level")).alias("detail"),
        F.lit(label).alias("source_label"), F.lit(url).alias("source_url"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(ALERT_KM).alias("radius_km"),
    )


def first_values(static: DataFrame, order: str) -> DataFrame:
    """(mmsi, name, ship_type, imo, destination, callsign): each column's first non-empty value."""
    named = ["name", "ship_type", "imo", "destination", "callsign"]
    valid = lambda c: F.col(c).isNotNull() & ~F.trim(F.col(c)).isin("", "nan", "<NA>", "None")
    return static.groupBy("mmsi").agg(*[F.min_by(F.col(c), F.when(valid(c), F.col(order))).alias(c) for c in named])


def with_arrival(rows: DataFrame, *order: str) -> DataFrame:
    """Adds _seq, the arrival order within each mmsi."""
    return rows.withColumn("_seq", F.row_number().over(W.partitionBy("mmsi").orderBy(*order)))
