"""Alert predicates, orders, counts and push payloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.geo import parts_bounds, parts_contain_point, parts_intersect_box
from stormframe.functions.parsing import SEVERITY_RANKS, severity_rank
from stormframe.operators.catalog import CATALOG_LIMIT, CATALOG_MAX, newest

LIST_COLUMNS = (
    "id",
    "event",
    "headline",
    "severity",
    "urgency",
    "certainty",
    "sender_name",
    "area_desc",
    "effective",
    "onset",
    "expires",
    "ends",
)
PUSH_MIN_SEVERITY = "Severe"


def _instant(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def with_bounds(alerts: DataFrame) -> DataFrame:
    """Store the geometry bounds as columns, so that file skipping and box tests can use them."""
    bounds = alerts.withColumn("_b", parts_bounds(F.col("parts")))
    return bounds.select(*alerts.columns, "_b.*")


def active_alerts(df: DataFrame, now: datetime | Column) -> DataFrame:
    """No expiry, or an expiry strictly after ``now``."""
    return df.where(F.col("expires").isNull() | (F.col("expires") > _instant(now)))


def is_active_at(df: DataFrame, t: datetime | Column) -> Column:
    """In force at ``t``: onset (else effective) to ends (else expires), both included, open where missing."""
    at = _instant(t)

    def first_present(names: tuple[str, str]) -> Column:
        present = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("timestamp")

    start, end = first_present(("onset", "effective")), first_present(("ends", "expires"))
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def active_at(df: DataFrame, t: datetime | Column) -> DataFrame:
    return df.where(is_active_at(df, t))


#: Width of the narrowest time bucket in seconds, and buckets of the widest that the instants may span.
NARROWEST, WIDE_BUCKETS = 3600, 64


def active_at_instants(alerts: DataFrame, instants: DataFrame, at: str = "at") -> DataFrame:
    """Every instant with each alert in force then, ends included and open where missing.

    An interval index: an alert is listed in the buckets it meets of the narrowest width, doubling
    from an hour, that is no shorter than it - one or two, or up to 65 of the widest width - and an
    instant in its bucket of every width.  Open ends reach to the first and last instant.
    """
    range_ = instants.agg(F.min(F.unix_timestamp(at)).alias("low"), F.max(F.unix_timestamp(at)).alias("high")).first()
    if range_["low"] is None:
        return alerts.join(instants, F.lit(False))
    low, high = range_["low"], range_["high"]
    levels = 0
    while (high - low) >= WIDE_BUCKETS * NARROWEST << levels:
        levels += 1

    def edge(names: tuple[str, str], open_: int) -> Column:
        present = [F.unix_timestamp(n) for n in names if n in alerts.columns]
        return F.coalesce(*present, F.lit(open_).cast("long"))

    start, end = F.greatest(edge(("onset", "effective"), low), F.lit(low)), F.least(edge(("ends", "expires"), high), F.lit(high))
    level = F.lit(levels)
    for k in reversed(range(levels)):
        level = F.when(F.col("_end") - F.col("_start") <= NARROWEST << k, k).otherwise(level)
    width = F.element_at(F.array(*[F.lit(NARROWEST << k).cast("long") for k in range(levels + 1)]), F.col("_level") + 1)
    listed = (
        alerts.withColumns({"_start": start, "_end": end})
        .where(F.col("_start") <= F.col("_end"))
        .withColumn("_level", level)
        .withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))))
    )
    seen = instants.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(levels + 1)])))
    seen = seen.withColumn("_bucket", F.floor(F.unix_timestamp(at) / width))
    return seen.join(listed, ["_level", "_bucket"]).where(is_active_at(listed, F.col(at))).drop("_level", "_bucket", "_start", "_end")


def severity_at_least(df: DataFrame, severity: str, column: str = "severity") -> DataFrame:
    """Rows whose severity is one of the known rungs at or above the given one."""
    floor = SEVERITY_RANKS.get(severity, 0)
    return df.where(F.col(column).isin(*[name for name, rank in SEVERITY_RANKS.items() if rank >= floor]))


def push_eligible(df: DataFrame, min_severity: str = PUSH_MIN_SEVERITY) -> DataFrame:
    return df.where(severity_rank(F.col("severity")) >= SEVERITY_RANKS.get(min_severity, 0))


def _bounds_overlap(min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> Column:
    return (
        (F.col("min_lng") <= max_lng)
        & (F.col("max_lng") >= min_lng)
        & (F.col("min_lat") <= max_lat)
        & (F.col("max_lat") >= min_lat)
    )


def geom_intersects_bbox(df: DataFrame, min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> DataFrame:
    """Geometry meets the box: bounds first (pushed to the scan), then the exact test."""
    return df.where(_bounds_overlap(min_lng, min_lat, max_lng, max_lat)).where(
        parts_intersect_box(F.col("parts"), min_lng, min_lat, max_lng, max_lat)
    )


def geom_contains_point(df: DataFrame, lat: float, lng: float) -> DataFrame:
    """Geometry contains the point, boundary included."""
    return df.where(_bounds_overlap(lng, lat, lng, lat)).where(parts_contain_point(F.col("parts"), lng, lat))


def project_alert_list(df: DataFrame) -> DataFrame:
    """List columns only; the long prose is never read."""
    return df.select(*[c for c in LIST_COLUMNS if c in df.columns])


def rank_alerts(df: DataFrame, n: int = CATALOG_LIMIT, max_n: int = CATALOG_MAX) -> DataFrame:
    """Most severe first, then earliest expiry (none last), then id."""
    return df.orderBy(
        severity_rank(F.col("severity")).desc(), F.col("expires").asc_nulls_last(), F.col("id").asc()
    ).limit(min(max(n, 1), max_n))


def recent_feed(events: DataFrame, n: int, severity: str | None = None, ts: str = "created_at") -> DataFrame:
    """Newest ``n`` events, optionally of a minimum severity."""
    return newest(severity_at_least(events, severity) if severity else events, ts, n, n, key="id")


def severity_counts(df: DataFrame, t: datetime | Column) -> DataFrame:
    """Alerts in force at ``t`` per rung, zero where there are none; ``mappable`` have a geometry."""
    spark = df.sparkSession
    rungs = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("severity"), F.lit(v).alias("rank")) for k, v in SEVERITY_RANKS.items()])).alias("r")
    ).select("r.*")
    geometry = next((c for c in ("parts", "geometry") if c in df.columns), None)
    mappable = F.col(geometry).isNotNull() if geometry else F.lit(False)
    counted = (
        active_at(df, t)
        .groupBy("severity")
        .agg(F.count("*").alias("active"), F.count_if(mappable).alias("mappable"))
    )
    return (
        rungs.join(counted, "severity", "left")
        .select(
            "severity",
            "rank",
            F.coalesce("active", F.lit(0)).cast("long").alias("active"),
            F.coalesce("mappable", F.lit(0)).cast("long").alias("mappable"),
        )
        .orderBy(F.col("rank").desc())
    )


def stats(alerts: DataFrame, files: DataFrame, grids: DataFrame, now: datetime | Column) -> DataFrame:
    """One-row freshness snapshot; one scan per table, three one-row frames crossed."""
    at = _instant(now)
    alert_row = alerts.agg(
        F.count("*").alias("alerts_total"),
        F.count_if(F.col("expires").isNull() | (F.col("expires") > at)).alias("alerts_active"),
        F.max("expires").alias("latest_alert_expires"),
    )
    file_row = files.agg(F.count("*").alias("files"), F.max("valid_at").alias("latest_valid_at"))
    made_at = "materialised_at" if "materialised_at" in grids.columns else "valid_at"
    grid_row = grids.agg(F.count("*").alias("grids"), F.max(made_at).alias("latest_grid_at"))
    return (
        alert_row.crossJoin(file_row)
        .crossJoin(grid_row)
        .withColumn("files_pending", F.col("files") - F.col("grids"))
    )


def push_payload(matches: DataFrame, base_url: str) -> DataFrame:
    """Payload per (alert, device) match: body is the headline, else the area, else a fixed text."""
    body = F.coalesce(
        F.when(F.col("headline") != "", F.col("headline")),
        F.when(F.col("area_desc") != "", F.col("area_desc")),
        F.lit("Tap for details."),
    )
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    payload = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.col("event").alias("title"), body.alias("body")).alias("alert"),
                F.lit("default").alias("sound"),
                F.lit(1).alias("mutable-content"),
                F.lit("time-sensitive").alias("interruption-level"),
            ).alias("aps"),
            F.col("id").alias("alert_id"),
            F.lit(base_url).alias("base_url"),
            F.when(located, F.col("latitude")).alias("lat"),
            F.when(located, F.col("longitude")).alias("lng"),
        ),
        {"ignoreNullFields": "true"},
    )
    return matches.select("id", "token", body.alias("body"), payload.alias("payload"))


def prune_devices(devices: DataFrame, dead: DataFrame) -> DataFrame:
    """Devices without the tokens reported dead."""
    return devices.join(dead.select("token"), "token", "left_anti")
