"""Upstream JSON: alert features, archived warnings, station reports.

Each reader takes a frame with one JSON document per row (``payload``) and returns typed
rows.  Fields are read with declared types; what the upstream types loosely (numbers or
text) is read as raw JSON so that the difference stays visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.geo import PARTS_TYPE
from stormframe.functions.parsing import (
    CERTAINTIES,
    SEVERITY_RANKS,
    URGENCIES,
    parse_utc,
    severity_of,
    visibility_sm,
    wind_direction,
)

_ALERT_TEXT = ("id", "event", "headline", "description", "instruction", "senderName", "areaDesc")
_ALERT_TIMES = ("effective", "onset", "expires", "ends")
_ALERT_FIELDS = ",".join(f"{c}:string" for c in (*_ALERT_TEXT, "severity", "urgency", "certainty", *_ALERT_TIMES))
ALERT_PAYLOAD = f"struct<type:string,features:array<struct<properties:struct<{_ALERT_FIELDS}>,geometry:string>>>"

_WARNING_FIELDS = ",".join(
    f"{c}:string"
    for c in (
        "product_id", "phenomena", "event_label", "wfo", "utc_polygon_begin", "utc_polygon_end", "utc_issue", "utc_expire", "locations",
    )
)
WARNING_PAYLOAD = f"struct<features:array<struct<properties:struct<{_WARNING_FIELDS}>,geometry:string>>>"

STATION_RECORD = (
    "struct<icaoId:string,reportTime:string,lat:double,lon:double,rawOb:string,temp:double,dewp:double,"
    "wspd:double,wgst:double,altim:double,fltcat:string>"
)

_POSITION = "array<double>"
_RING = f"array<{_POSITION}>"


# --- geometry ------------------------------------------------------------------------------


def _polygon_rings(coordinates: Column) -> Column:
    return F.transform(
        coordinates,
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat"))),
    )


# Coordinates stay text until the type tells how deep they nest.
GEOMETRY_TYPE = "struct<type:string,coordinates:string,geometries:array<string>>"


def read_geometry(text: Column) -> Column:
    """The outer level of a GeoJSON geometry; keep it in a column, it is used several times."""
    return F.from_json(text, GEOMETRY_TYPE)


def _simple_parts(geometry: Column) -> Column:
    single = F.array(_polygon_rings(F.from_json(geometry["coordinates"], f"array<{_RING}>")))
    several = F.transform(F.from_json(geometry["coordinates"], f"array<array<{_RING}>>"), lambda c: _polygon_rings(c))
    kind = geometry["type"]
    return F.when(kind == "Polygon", single).when(kind == "MultiPolygon", several).cast(PARTS_TYPE)


def geometry_parts(geometry: Column) -> Column:
    """Polygons of ``read_geometry``; collections contribute the polygons they hold, one level deep."""
    members = F.transform(geometry["geometries"], lambda g: _simple_parts(read_geometry(g)))
    collected = F.flatten(F.filter(members, lambda p: p.isNotNull()))
    return F.when(geometry["type"] == "GeometryCollection", collected).otherwise(_simple_parts(geometry))


# --- alerts ----------------------------------------------------------------------------------


def _one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*allowed)


def read_alert_features(payloads: DataFrame) -> DataFrame:
    """Rows of a FeatureCollection with ``error_reason`` (null when usable).

    Text is trimmed.  An unknown severity, urgency or certainty or a malformed time rejects the
    feature; an absent one reads Unknown.
    """
    parsed = payloads.select(F.from_json("payload", ALERT_PAYLOAD).alias("p"))
    features = parsed.where(F.col("p.type") == "FeatureCollection").select(F.explode("p.features").alias("f"))
    features = features.withColumn("_g", read_geometry(F.col("f.geometry")))
    p = F.col("f.properties")
    text = {c: F.trim(p[c]) for c in _ALERT_TEXT}
    times = {c: parse_utc(F.trim(p[c])) for c in _ALERT_TIMES}
    rungs = {"severity": tuple(SEVERITY_RANKS), "urgency": URGENCIES, "certainty": CERTAINTIES}
    reason = (
        F.when(p.isNull(), F.lit("no_properties"))
        .when(text["id"].isNull() | text["event"].isNull(), F.lit("missing_field"))
    )
    for name, allowed in rungs.items():
        reason = reason.when(~_one_of(F.trim(p[name]), allowed), F.lit(f"unknown_{name}"))
    for name in _ALERT_TIMES:
        reason = reason.when(p[name].isNotNull() & times[name].isNull(), F.lit(f"bad_{name}"))
    return features.select(
        text["id"].alias("id"),
        text["event"].alias("event"),
        text["headline"].alias("headline"),
        text["description"].alias("description"),
        text["instruction"].alias("instruction"),
        *[F.coalesce(F.trim(p[c]), F.lit("Unknown")).alias(c) for c in rungs],
        text["senderName"].alias("sender_name"),
        text["areaDesc"].alias("area_desc"),
        *[times[c].alias(c) for c in _ALERT_TIMES],
        F.col("f.geometry").alias("geometry"),
        geometry_parts(F.col("_g")).alias("parts"),
        reason.alias("error_reason"),
    )


def normalise_warnings(payloads: DataFrame) -> DataFrame:
    """Archived warnings in the shape of alerts; polygon times come before issue times.

    Features without an id are dropped.
    """
    parsed = payloads.select(F.from_json("payload", WARNING_PAYLOAD).alias("p"))
    features = parsed.select(F.explode("p.features").alias("f")).withColumn("_g", read_geometry(F.col("f.geometry")))
    p = F.col("f.properties")

    def present(c: Column) -> Column:
        return F.when(c != "", c)

    phenomena = F.upper(F.coalesce(p["phenomena"], F.lit("")))
    label = F.coalesce(present(p["event_label"]), present(phenomena), F.lit("Unknown event"))
    onset = parse_utc(F.coalesce(present(p["utc_polygon_begin"]), p["utc_issue"]))
    ends = parse_utc(F.coalesce(present(p["utc_polygon_end"]), p["utc_expire"]))
    return features.where(p["product_id"].isNotNull()).select(
        p["product_id"].alias("id"),
        label.alias("event"),
        label.alias("headline"),
        severity_of(p["phenomena"]).alias("severity"),
        F.lit("Immediate").alias("urgency"),
        F.lit("Observed").alias("certainty"),
        F.concat(F.lit("NWS "), present(p["wfo"])).alias("sender_name"),
        F.when(F.trim(p["locations"]) != "", p["locations"]).alias("area_desc"),
        onset.alias("effective"),
        onset.alias("onset"),
        ends.alias("expires"),
        ends.alias("ends"),
        F.col("f.geometry").alias("geometry"),
        geometry_parts(F.col("_g")).alias("parts"),
    )


_GEOJSON_LIST = (
    ("id", "id"), ("event", "event"), ("headline", "headline"), ("severity", "severity"), ("urgency", "urgency"),
    ("certainty", "certainty"), ("sender_name", "senderName"), ("area_desc", "areaDesc"), ("effective", "effective"),
    ("onset", "onset"), ("expires", "expires"), ("ends", "ends"),
)
_GEOJSON_DETAIL = (("description", "description"), ("instruction", "instruction"))


def iso_utc(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parts_to_geojson(parts: Column) -> Column:
    """GeoJSON text of the polygons, rings closed."""

    def ring(r: Column) -> Column:
        closed = F.concat(r, F.slice(r, 1, 1))
        return F.transform(closed, lambda v: F.array(v["lng"], v["lat"]))

    rings = F.transform(parts, lambda part: F.transform(part, ring))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(rings, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))
    return F.when(parts.isNull(), F.lit(None).cast("string")).when(F.size(parts) == 1, one).otherwise(many)


def alerts_to_geojson(alerts: DataFrame, detail: bool = False) -> DataFrame:
    """``id`` and ``feature`` (JSON text); only the detail form carries the long prose."""
    fields = _GEOJSON_LIST + (_GEOJSON_DETAIL if detail else ())
    types = dict(alerts.dtypes)

    def value(c: str) -> Column:
        return iso_utc(F.col(c)) if types[c] == "timestamp" else F.col(c)

    properties = F.struct(*[value(c).alias(name) for c, name in fields if c in types])
    shape = parts_to_geojson(F.col("parts")) if "parts" in types else F.lit(None).cast("string")
    body = F.to_json(properties, {"ignoreNullFields": "false"})
    # The geometry is JSON already, so the feature is put together around it.
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), body, F.lit("}")
    )
    return alerts.select("id", feature.alias("feature"))


# --- stations ---------------------------------------------------------------------------------


def _json_number(payload: Column, field: str) -> Column:
    """The field where it is a JSON number, null where it is quoted."""
    raw = F.regexp_extract(payload, rf'"{field}"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1)
    return F.when(raw != "", raw).try_cast("double")


def read_station_records(payloads: DataFrame) -> DataFrame:
    """Observations from one record per row; records without id, time, place or raw text are dropped."""
    record = F.from_json("payload", STATION_RECORD)
    rows = payloads.select("payload", record.alias("r"))
    at = parse_utc(F.col("r.reportTime"))
    visible = _json_number(F.col("payload"), "visib")
    direction = _json_number(F.col("payload"), "wdir")
    typed = rows.select(
        F.col("r.icaoId").alias("station_id"),
        at.alias("observation_time"),
        F.col("r.lat").alias("latitude"),
        F.col("r.lon").alias("longitude"),
        F.col("r.rawOb").alias("raw_text"),
        F.col("r.temp").alias("temp_c"),
        F.col("r.dewp").alias("dewpoint_c"),
        F.col("r.wspd").alias("wind_speed_kt"),
        wind_direction(direction).alias("wind_direction_deg"),
        F.col("r.wgst").alias("wind_gust_kt"),
        visibility_sm(visible, F.get_json_object("payload", "$.visib")).alias("visibility_sm"),
        F.col("r.altim").alias("altimeter_hpa"),
        F.col("r.fltcat").alias("flight_category"),
    )
    return typed.where(
        (F.col("station_id") != "")
        & (F.col("raw_text") != "")
        & F.col("observation_time").isNotNull()
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    )
