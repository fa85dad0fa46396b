"""A landed feed as a Spark data source: read as a table with pruned files, or as a stream of bounded batches.

A collector lands envelopes (ts, mmsi, value), a batch at a time, as JSON lines under
``data/batch=N``.  When a batch's files are complete, a Spark job counts each file's rows and the
range of its times and identities, and commits these as ``index/batch=N``; a batch is there for
readers once its index is.  The index is a row a file, so planning on the driver reads no data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.json as pj
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME = "sealane_feed"
ENVELOPE = "ts timestamp, mmsi bigint, value string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ROWS_A_FILE = 100_000
ROWS_A_BATCH = 200_000

_LINE = pa.schema([("t", pa.int64()), ("mmsi", pa.int64()), ("value", pa.string())])
_OUT = pa.schema([("ts", pa.timestamp("us", "UTC")), ("mmsi", pa.int64()), ("value", pa.string())])


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's place in it; a bare path is a local one."""
    if not re.match(r"\w+:", uri):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _names(uri: str, suffix: str = "") -> list[str]:
    fs, path = store(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.endswith(suffix) and not x.base_name.startswith("."))


def _batches(folder: str) -> list[int]:
    """Numbers of the batches whose index is committed."""
    found = (n for n in _names(f"{folder}/index") if n.startswith("batch="))
    return [int(n[6:]) for n in found if "_SUCCESS" in _names(f"{folder}/index/{n}")]


def _landing(spark: SparkSession, folder: str) -> int:
    """A number above those of all batches so far, complete or not."""
    return 1 + max((int(n[6:]) for n in _names(f"{folder}/data") if n.startswith("batch=")), default=0)


def land(rows: DataFrame, folder: str, rows_a_file: int = ROWS_A_FILE) -> int:
    """Land ``rows`` (ts, mmsi, value) as the next batch and return its number.

    One collector lands at a time.  A landing that ends early leaves files without an index, which
    nobody reads.  An empty table lands an empty batch.
    """
    spark, n = rows.sparkSession, _landing(rows.sparkSession, folder)
    data, index = f"{folder}/data/batch={n}", f"{folder}/index/batch={n}"
    line = F.to_json(F.struct(F.unix_micros("ts").alias("t"), "mmsi", "value"), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.option("maxRecordsPerFile", rows_a_file).text(data)
    landed = spark.read.schema("t bigint, mmsi bigint, value string").json(data).select("t", "mmsi", F.col("_metadata.file_name").alias("file"))
    files = landed.groupBy("file").agg(F.count("*").alias("rows"), *[f(c).alias(f"{name}_{c}") for c in ("t", "mmsi") for name, f in (("min", F.min), ("max", F.max))])
    files.coalesce(1).write.json(index)
    return n


@dataclass(frozen=True)
class Landed:
    """What the index says of a file."""

    batch: int
    file: str
    rows: int
    low: dict[str, int | None]
    high: dict[str, int | None]


def index_of(folder: str, batch: int) -> list[Landed]:
    """Files of a batch in the order in which they are read."""
    out = []
    for name in _names(f"{folder}/index/batch={batch}", ".json"):
        fs, path = store(f"{folder}/index/batch={batch}/{name}")
        with fs.open_input_stream(path) as file:
            if data := file.read():
                out += pj.read_json(pa.py_buffer(data)).to_pylist()
    found = [Landed(batch, r["file"], r["rows"], {c: r.get(f"min_{c}") for c in ("t", "mmsi")}, {c: r.get(f"max_{c}") for c in ("t", "mmsi")}) for r in out]
    return sorted(found, key=lambda x: x.file)


@dataclass
class Part(InputPartition):
    """Rows ``first`` up to ``last`` (exclusive) of a landed file."""

    batch: int
    file: str
    first: int
    last: int


#: A condition: which of the index's columns, and the lowest and highest value that meet it.
Bound = tuple[str, int | None, int | None]


def _micros(value: datetime) -> int:
    value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    delta = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def bound_of(condition: Filter) -> Bound | None:
    """Comparisons of ts or mmsi with a value as bounds; None for what the source does not apply itself."""
    column = {("ts",): "t", ("mmsi",): "mmsi"}.get(getattr(condition, "attribute", None))
    value = getattr(condition, "value", None)
    if column is None or isinstance(condition, In) or value is None:
        return None
    value = _micros(value) if isinstance(value, datetime) else value
    if not isinstance(value, int):
        return None
    if isinstance(condition, EqualTo):
        return column, value, value
    if isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
        return column, value + isinstance(condition, GreaterThan), None
    if isinstance(condition, (LessThan, LessThanOrEqual)):
        return column, None, value - isinstance(condition, LessThan)
    return None


def _may_hold(file: Landed, bounds: list[Bound]) -> bool:
    """Whether a file can have a row within all bounds; a file without any value of a column has none."""
    for column, low, high in bounds:
        first, last = file.low[column], file.high[column]
        if first is None or (low is not None and last < low) or (high is not None and first > high):
            return False
    return True


def _rows(folder: str, part: Part, bounds: list[Bound]) -> Iterator[pa.RecordBatch]:
    fs, path = store(f"{folder}/data/batch={part.batch}/{part.file}")
    with fs.open_input_stream(path) as file:  # decompresses by the name's ending
        table = pj.read_json(file, parse_options=pj.ParseOptions(explicit_schema=_LINE, unexpected_field_behavior="ignore"))
    table = table.slice(part.first, part.last - part.first)
    for column, low, high in bounds:
        if low is not None:
            table = table.filter(pc.greater_equal(table[column], low))
        if high is not None:
            table = table.filter(pc.less_equal(table[column], high))
    ts = table["t"].cast(pa.timestamp("us", "UTC"))
    yield from pa.table([ts, table["mmsi"], table["value"]], schema=_OUT).to_batches()


class FeedReader(DataSourceReader):
    """All complete batches: a partition a file, of those files only that the index does not rule out."""

    def __init__(self, options: dict) -> None:
        self.folder, self.bounds = options["path"], []
        for name, low in (("start", True), ("end", False)):
            if options.get(name):
                t = _micros(datetime.fromisoformat(options[name]))
                self.bounds.append(("t", t if low else None, None if low else t))

    def partitions(self) -> list[Part]:
        files = [f for b in _batches(self.folder) for f in index_of(self.folder, b)]
        return [Part(f.batch, f.file, 0, f.rows) for f in files if _may_hold(f, self.bounds)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Part):  # without partitions Spark asks for one that is none
            yield from _rows(self.folder, partition, self.bounds)


class PushingReader(FeedReader):
    """The same, with comparisons of ts and mmsi taken from the plan; Spark refuses it unless pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]):
        for condition in filters:
            bound = bound_of(condition)
            if bound is None:
                yield condition
            else:
                self.bounds.append(bound)


class FeedStream(DataSourceStreamReader):
    """Batches of at most ``rowsPerBatch`` rows, in the order of landing.

    An offset is the place of the next row: batch, file in it and row in that.  Spark logs offsets
    before it reads, and reads between two logged ones again after a failure; a file may be split
    between batches.  After a restart Spark plans the last logged batch anew, which tells the place
    to go on from.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.limit = options["path"], int(options.get("rowsPerBatch", ROWS_A_BATCH))
        if self.limit < 1:
            raise ValueError("rowsPerBatch must be 1 at least")
        self.place: dict | None = None

    def initialOffset(self) -> dict:
        return {"batch": 0, "file": 0, "row": 0}

    def latestOffset(self) -> dict:
        place, left = self.place or self.initialOffset(), self.limit
        for b in _batches(self.folder):
            if b < place["batch"]:
                continue
            files = index_of(self.folder, b)
            first = place["file"] if b == place["batch"] else 0
            for k in range(first, len(files)):
                row = place["row"] if (b, k) == (place["batch"], place["file"]) else 0
                take = min(left, files[k].rows - row)
                left -= take
                place = {"batch": b, "file": k, "row": row + take}
                if not left:
                    break
            if not left:
                break
        self.place = place
        return place

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.place = end
        out = []
        for b in _batches(self.folder):
            if not start["batch"] <= b <= end["batch"]:
                continue
            for k, file in enumerate(index_of(self.folder, b)):
                here = (b, k)
                if not (start["batch"], start["file"]) <= here <= (end["batch"], end["file"]):
                    continue
                first = start["row"] if here == (start["batch"], start["file"]) else 0
                last = end["row"] if here == (end["batch"], end["file"]) else file.rows
                if first < last:
                    out.append(Part(b, file.file, first, last))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.folder, partition, [])


class FeedSource(DataSource):
    """``format("sealane_feed")``; options path, and start and end (ISO times, inclusive) or rowsPerBatch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ENVELOPE

    def reader(self, schema: StructType) -> FeedReader:
        return (PushingReader if self.options.get("pushdown") == "true" else FeedReader)(self.options)

    def streamReader(self, schema: StructType) -> FeedStream:
        return FeedStream(self.options)


def read_feed(spark: SparkSession, folder: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Envelopes of all complete batches; the bounds are inclusive and choose files by the index first.

    Comparisons of ts and mmsi in later filters reach the index too where
    the session has :data:`PUSHDOWN` set.
    """
    spark.dataSource.register(FeedSource)
    reader = spark.read.format(NAME).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    for name, value in (("start", start), ("end", end)):
        if value is not None:
            reader = reader.option(name, (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).isoformat())
    return reader.load(folder)


def stream_feed(spark: SparkSession, folder: str, rows_a_batch: int = ROWS_A_BATCH) -> DataFrame:
    """Envelopes as a stream, at most ``rows_a_batch`` rows a batch."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format(NAME).option("rowsPerBatch", rows_a_batch).load(folder)
