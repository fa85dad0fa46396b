"""Sources of positions and vessel data by name, and one table of all that a run is set to use."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.functions.geo import bbox_contains
from sealane.sources import feed, readers
from sealane.sources.readers import WORLD, Bbox
from sealane.sources.schema import POSITIONS, STATIC, conform, empty

#: (session, where it is landed, start, end, box) to canonical rows.
Scan = Callable[[SparkSession, str, datetime | None, datetime | None, Bbox], DataFrame]


@dataclass(frozen=True)
class Source:
    """A kind of feed: its two scans, and whether it only hears vessels near the coast."""

    name: str
    positions: Scan
    static: Scan
    terrestrial_only: bool = True


def _snapshot(spark: SparkSession, path: str, start: datetime | None, end: datetime | None, bbox: Bbox) -> DataFrame:
    return readers.snapshot_positions(spark, f"{path}/locations", bbox, start, end)


def _stream(spark: SparkSession, path: str, start: datetime | None, end: datetime | None, bbox: Bbox) -> DataFrame:
    rows = readers.stream_positions(readers.messages(feed.read_feed(spark, path, start, end)))
    return readers.between(rows.where(bbox_contains(F.col("lon"), F.col("lat"), bbox)), start, end)


def _daily(spark: SparkSession, path: str, start: datetime | None, end: datetime | None, bbox: Bbox) -> DataFrame:
    return readers.daily_positions(readers.daily_rows(spark, path, bbox), start, end)


SNAPSHOT = Source("snapshot", _snapshot, lambda spark, path, start, end, bbox: readers.snapshot_static(spark, f"{path}/vessels"))
STREAM = Source("stream", _stream, lambda spark, path, start, end, bbox: readers.stream_static(readers.messages(feed.read_feed(spark, path, start, end))))
ZIPPED = Source("zipped", lambda spark, path, start, end, bbox: readers.daily_positions(readers.zipped_daily_rows(spark, path, bbox), start, end), lambda spark, path, start, end, bbox: readers.daily_static(readers.zipped_daily_rows(spark, path, bbox)))
DAILY = Source("daily", _daily, lambda spark, path, start, end, bbox: readers.daily_static(readers.daily_rows(spark, path, bbox)))
SOURCES = {s.name: s for s in (SNAPSHOT, STREAM, DAILY, ZIPPED)}


def chosen(names: Iterable[str], known: dict[str, Source] | None = None) -> list[Source]:
    """Sources of these names, each once; a name that nobody knows is warned of and left out."""
    known, out = SOURCES if known is None else known, []
    for name in dict.fromkeys(names):
        if name in known:
            out.append(known[name])
        else:
            warnings.warn(f"no source is called {name!r}; it is left out", stacklevel=2)
    return out


def collected(spark: SparkSession, places: dict[str, str], start: datetime | None = None, end: datetime | None = None, bbox: Bbox = WORLD, known: dict[str, Source] | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, static) of all sources of ``places`` (name to where it is landed), one below the other.

    Rows of several sources stay apart by their ``source``; without a source both tables are empty.
    """
    sources = chosen(places, known)
    union = lambda frames, schema: reduce(DataFrame.unionByName, [conform(f, schema) for f in frames]) if frames else empty(spark, schema)
    return (
        union([s.positions(spark, places[s.name], start, end, bbox) for s in sources], POSITIONS),
        union([s.static(spark, places[s.name], start, end, bbox) for s in sources], STATIC),
    )
