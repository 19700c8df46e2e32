"""Parsers for upstream text.  Malformed input yields null (or a reason), never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Textual visibilities in statute miles.
VISIBILITY_TEXT = {"10+": 10.0, "M1/4": 0.0, "1/4": 0.25, "1/2": 0.5, "3/4": 0.75}

# Severity rungs, highest first, with their ranks.
SEVERITY_RANKS = {"Extreme": 4, "Severe": 3, "Moderate": 2, "Minor": 1, "Unknown": 0}
URGENCIES = ("Immediate", "Expected", "Future", "Past", "Unknown")
CERTAINTIES = ("Observed", "Likely", "Possible", "Unlikely", "Unknown")

# Warning phenomenon codes by severity; every other code is Moderate.
PHENOMENA_SEVERITY = {
    "Extreme": ("TO", "EW", "HU", "SS"),
    "Severe": ("SV", "FF", "FA", "MA", "TR", "SQ", "DS"),
}
DEFAULT_PHENOMENON_SEVERITY = "Moderate"

# Fixed value: shape of an object-store key of one radar file.
FILE_KEY_PATTERN = (
    r"^CONUS/([A-Za-z0-9]+)_(\d{2}(?:\.\d{2})?)/\d{8}/"
    r"MRMS_([A-Za-z0-9]+)_(\d{2}(?:\.\d{2})?)_(\d{8})-(\d{6})\.grib2(?:\.gz)?$"
)


def _double(text: Column) -> Column:
    return text.try_cast("double")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY_RANKS.items():
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank


def severity_of(phenomenon: Column) -> Column:
    code = F.upper(F.coalesce(phenomenon, F.lit("")))
    out = F.lit(DEFAULT_PHENOMENON_SEVERITY)
    for severity, codes in PHENOMENA_SEVERITY.items():
        out = F.when(code.isin(*codes), F.lit(severity)).otherwise(out)
    return out


def wind_direction(number: Column, text: Column | None = None) -> Column:
    """Degrees from a JSON number; any JSON string (``VRB``) means no direction.

    ``number`` is the field parsed as a number, hence null for quoted text.
    """
    out = number.try_cast("int")
    return out if text is None else F.when(text.isNotNull() & number.isNull(), F.lit(None)).otherwise(out)


def visibility_sm(number: Column, text: Column) -> Column:
    """Statute miles: a JSON number as it is, a known quoted form, else null."""
    mapped = F.lit(None).cast("double")
    for form, miles in VISIBILITY_TEXT.items():
        mapped = F.when(text == form, F.lit(miles)).otherwise(mapped)
    return F.coalesce(number.cast("double"), mapped)


def parse_utc(text: Column) -> Column:
    """ISO-8601 time; ``Z`` or an offset is honoured, a naive time is UTC, anything else null.

    The session time zone must be UTC.
    """
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$")
    return F.when(iso, text.try_cast("timestamp"))


def parse_polygon(text: Column) -> Column:
    """STRUCT<ring, error_reason> from ``lng,lat,lng,lat,…``."""
    parts = F.filter(F.split(text, ","), lambda p: F.trim(p) != "")
    numbers = F.transform(parts, lambda p: _double(F.trim(p)))
    n = F.size(numbers)
    ring = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), (n / 2).cast("int") - 1)),
        lambda i: F.struct(F.get(numbers, i * 2).alias("lng"), F.get(numbers, i * 2 + 1).alias("lat")),
    )
    in_range = F.forall(ring, lambda v: v["lng"].between(-180.0, 180.0) & v["lat"].between(-90.0, 90.0))
    reason = (
        F.when(text.isNull(), F.lit(None))
        .when(n % 2 != 0, F.lit("odd_value_count"))
        .when(F.exists(numbers, lambda v: v.isNull()), F.lit("not_numeric"))
        .when(n < 6, F.lit("too_few_vertices"))
        .when(~in_range, F.lit("out_of_range"))
    )
    return F.struct(
        F.when(reason.isNull() & text.isNotNull(), ring).alias("ring"),
        reason.cast("string").alias("error_reason"),
    )


def parse_bbox(text: Column) -> Column:
    """STRUCT<min_lng,min_lat,max_lng,max_lat,error_reason>; boxes over the antimeridian are rejected."""
    numbers = F.transform(F.split(text, ","), lambda p: _double(F.trim(p)))
    min_lng, min_lat, max_lng, max_lat = (F.get(numbers, F.lit(i)) for i in range(4))
    reason = (
        F.when(text.isNull(), F.lit(None))
        .when(F.size(numbers) != 4, F.lit("wrong_value_count"))
        .when(F.exists(numbers, lambda v: v.isNull()), F.lit("not_numeric"))
        .otherwise(box_problem(min_lng, min_lat, max_lng, max_lat))
    )
    ok = reason.isNull() & text.isNotNull()
    return F.struct(
        F.when(ok, min_lng).alias("min_lng"),
        F.when(ok, min_lat).alias("min_lat"),
        F.when(ok, max_lng).alias("max_lng"),
        F.when(ok, max_lat).alias("max_lat"),
        reason.cast("string").alias("error_reason"),
    )


def parse_point(text: Column) -> Column:
    """STRUCT<lat,lng,error_reason> from ``lat,lng``."""
    numbers = F.transform(F.split(text, ","), lambda p: _double(F.trim(p)))
    lat, lng = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    reason = (
        F.when(text.isNull(), F.lit(None))
        .when(F.size(numbers) != 2, F.lit("wrong_value_count"))
        .when(F.exists(numbers, lambda v: v.isNull()), F.lit("not_numeric"))
        .otherwise(latlng_problem(lat, lng))
    )
    ok = reason.isNull() & text.isNotNull()
    return F.struct(
        F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng"), reason.cast("string").alias("error_reason")
    )


def latlng_problem(lat: Column, lng: Column) -> Column:
    """Reason a coordinate is invalid, or null."""
    return F.when(~F.coalesce(lat.between(-90.0, 90.0), F.lit(False)), F.lit("latitude_out_of_range")).when(
        ~F.coalesce(lng.between(-180.0, 180.0), F.lit(False)), F.lit("longitude_out_of_range")
    )


def box_problem(min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column) -> Column:
    """Reason a box is invalid, or null."""
    return (
        F.when(latlng_problem(min_lat, min_lng).isNotNull(), F.lit("corner_out_of_range"))
        .when(latlng_problem(max_lat, max_lng).isNotNull(), F.lit("corner_out_of_range"))
        .when(min_lat > max_lat, F.lit("latitudes_reversed"))
        .when(min_lng > max_lng, F.lit("crosses_antimeridian"))
    )


def parse_codes(text: Column) -> Column:
    """Upper-cased codes of a comma-separated list, blanks dropped."""
    trimmed = F.transform(F.split(text, ","), lambda p: F.upper(F.trim(p)))
    return F.coalesce(F.filter(trimmed, lambda p: p != ""), F.array().cast("array<string>"))


def parse_dims(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def parse_shape(text: Column) -> Column:
    return F.from_json(text, "array<int>")


def grid_key(file_key: Column) -> Column:
    """File key without its ``.grib2`` / ``.gz`` suffixes; dots inside the name stay."""
    return F.regexp_replace(file_key, r"(\.grib2)?(\.gz)?$", "")
