"""Column functions that decode and clean ship reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Navigation status labels by code, as the snapshot feed has them.
NAV_STATUS = {
    0: "Under way using engine", 1: "At anchor", 2: "Not under command", 3: "Restricted manoeuvrability",
    4: "Constrained by draught", 5: "Moored", 6: "Aground", 7: "Engaged in fishing", 8: "Under way sailing",
    9: "Reserved (HSC)", 10: "Reserved (WIG)", 11: "Towing astern", 12: "Pushing ahead or towing alongside", 13: "Reserved",
    14: "AIS-SART / MOB / EPIRB", 15: "Undefined",
}
# The stream feed has no labels for the reserved codes and a shorter one for 12.
STREAM_NAV_STATUS = {k: v for k, v in NAV_STATUS.items() if k not in (9, 10, 13)} | {12: "Pushing ahead"}
# Ship types by tens digit, and hazard classes of cargo types by units digit.
SHIP_TYPE = {2: "WIG", 3: "Special craft", 4: "High-speed craft", 5: "Special craft", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other"}
CARGO_HAZARD = {1: "Category A (hazardous)", 2: "Category B", 3: "Category C", 4: "Category D"}

SOG_NONE, COG_NONE, HEADING_NONE = 102.3, 360.0, 511.0


def number(c: Column) -> Column:
    """NaN as null: aggregates and comparisons then skip it."""
    return F.when(~F.isnan(c), c)


def below(c: Column, sentinel: float) -> Column:
    return F.when(~F.isnan(c) & (c < sentinel), c)


def clean_text(c: Column) -> Column:
    """Without outer blanks, then @ padding, then blanks; empty is null."""
    stripped = F.trim(F.regexp_replace(F.trim(c), "^@+|@+$", ""))
    return F.when(stripped != "", stripped)


def nav_status(code: Column, table: dict[int, str] | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in (table or NAV_STATUS).items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(pairs, code.cast("int")), F.format_string("Unknown (%d)", code.cast("int"))))


def ship_type(code: Column) -> Column:
    tens = F.floor(code / 10).cast("int")
    pairs = F.create_map(*[F.lit(x) for pair in SHIP_TYPE.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(pairs, tens), F.format_string("Type %d", code.cast("int"))))


def cargo_hazard(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in CARGO_HAZARD.items() for x in pair])
    return F.when(F.floor(code / 10).isin(7, 8), F.try_element_at(pairs, F.pmod(code, F.lit(10)).cast("int")))


def dimension(a: Column, b: Column) -> Column:
    """The sum of two reference distances, null where it is zero."""
    total = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.when(total != 0, total.cast("double"))


def epoch(value: Column) -> Column:
    """A number of milliseconds or seconds since 1970, told apart by size; null if neither."""
    return F.when(value > 1e11, F.timestamp_millis(value.cast("long"))).when(value > 1e8, F.timestamp_seconds(value.cast("long")))


def first_epoch(*values: Column) -> Column:
    return F.coalesce(*[epoch(v) for v in values])


def go_time(c: Column) -> Column:
    """Times as ``2024-01-01 10:00:00.123456789 +0000 UTC``; a missing offset is UTC; else null."""
    pattern = r"^\s*(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:\.(\d+))?\s*([+-]\d\d:?\d\d)?"
    part = lambda k: F.regexp_extract(c, pattern, k)
    micros = F.rpad(F.substring(part(3), 1, 6), 6, "0")
    offset = F.when(part(4) == "", F.lit("+0000")).otherwise(F.regexp_replace(part(4), ":", ""))
    return F.when(part(1) != "", F.try_to_timestamp(F.concat_ws(" ", part(1), F.concat(part(2), F.lit("."), micros), offset), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS Z")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def loose_float(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, ",", "")), r"\s+")[0].try_cast("double")


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)
