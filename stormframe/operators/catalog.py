"""Catalog reads: filters, lists, lookups, frame selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.operators.ordering import DEFAULT_CHUNK_SECONDS, row_positions, time_chunk

# Default and largest page sizes.
CATALOG_LIMIT, CATALOG_MAX = 100, 500
DELIVERY_LIMIT, DELIVERY_MAX = 50, 200
MATERIALISE_BATCH = 16


def _instant(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _equal(df: DataFrame, **wanted: object) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def _within(df: DataFrame, column: str, since: datetime | Column | None, until: datetime | Column | None) -> DataFrame:
    if since is not None:
        df = df.where(F.col(column) >= _instant(since))
    if until is not None:
        df = df.where(F.col(column) < _instant(until))
    return df


# --- filters --------------------------------------------------------------------


def filter_catalog(
    df: DataFrame,
    product: str | None = None,
    level: str | None = None,
    since: datetime | Column | None = None,
    until: datetime | Column | None = None,
) -> DataFrame:
    """Files or grids of a product and level with ``since <= valid_at < until``."""
    return _within(_equal(df, product=product, level=level), "valid_at", since, until)


def filter_nowcasts(
    df: DataFrame,
    product: str | None = None,
    level: str | None = None,
    algorithm: str | None = None,
    horizon: int | None = None,
    since: datetime | Column | None = None,
    until: datetime | Column | None = None,
) -> DataFrame:
    return filter_catalog(_equal(df, algorithm=algorithm, horizon=horizon), product, level, since, until)


def filter_observations(
    df: DataFrame,
    station_id: str | None = None,
    since: datetime | Column | None = None,
    until: datetime | Column | None = None,
    bbox: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Station reports by id (any letter case), time ``[since, until)`` and box."""
    out = _equal(df, station_id=station_id.upper() if station_id else None)
    out = _within(out, "observation_time", since, until)
    return in_bbox(out, *bbox) if bbox else out


def in_bbox(
    df: DataFrame,
    min_lng: float,
    min_lat: float,
    max_lng: float,
    max_lat: float,
    lng: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Points in a box, edges included."""
    check_bbox(min_lng, min_lat, max_lng, max_lat)
    return df.where(F.col(lat).between(min_lat, max_lat) & F.col(lng).between(min_lng, max_lng))


def check_latlng(lat: float, lng: float) -> None:
    if not -90.0 <= lat <= 90.0:
        raise ValueError(f"latitude {lat} is outside [-90, 90]")
    if not -180.0 <= lng <= 180.0:
        raise ValueError(f"longitude {lng} is outside [-180, 180]")


def check_bbox(min_lng: float, min_lat: float, max_lng: float, max_lat: float) -> None:
    check_latlng(min_lat, min_lng)
    check_latlng(max_lat, max_lng)
    if min_lat > max_lat:
        raise ValueError("min latitude exceeds max latitude")
    if min_lng > max_lng:
        raise ValueError("a box over the antimeridian is not supported")


def check_window(start: datetime, end: datetime) -> None:
    if start >= end:
        raise ValueError("a time window must end after it starts")


def active_rules(rules: DataFrame, product: str, level: str) -> DataFrame:
    """Active rules whose config names the product and level."""
    return rules.where(
        (F.col("status") == "active") & (F.col("config.product") == product) & (F.col("config.level") == level)
    )


def subscriptions_for(subscriptions: DataFrame, event: str) -> DataFrame:
    """Active subscriptions that opted in to an event."""
    return subscriptions.where((F.col("status") == "active") & F.array_contains("events", event))


def by_key(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(column) == key)


def days_touched(since: datetime, until: datetime) -> list[str]:
    """UTC days (``YYYYMMDD`` prefixes) that a ``[since, until)`` window touches."""
    check_window(since, until)
    last = (until - timedelta(microseconds=1)).date()
    span = (last - since.date()).days
    return [(since.date() + timedelta(days=k)).strftime("%Y%m%d") for k in range(span + 1)]


def scan_days(df: DataFrame, since: Column, until: Column, date_column: str = "valid_date") -> DataFrame:
    """Partition filter for the days of a ``[since, until)`` window."""
    return df.where(F.col(date_column).between(F.to_date(since), F.to_date(until - F.expr("interval 1 microsecond"))))


# --- ordered lists -----------------------------------------------------------------


def newest(df: DataFrame, ts: str, n: int = CATALOG_LIMIT, max_n: int = CATALOG_MAX, key: str = "file_key") -> DataFrame:
    """Newest first, the page clamped to ``[1, max_n]``; ties by key so the page is stable."""
    return df.orderBy(F.col(ts).desc(), F.col(key).asc()).limit(min(max(n, 1), max_n))


def _listed(df: DataFrame, limit: int, max_n: int, **wanted: object) -> DataFrame:
    return newest(_equal(df, **wanted), "created_at", limit, max_n, key="id")


def list_rules(
    rules: DataFrame, subscription_id: str | None = None, status: str | None = None, limit: int = CATALOG_LIMIT
) -> DataFrame:
    return _listed(rules, limit, CATALOG_MAX, subscription_id=subscription_id, status=status)


def list_subscriptions(subscriptions: DataFrame, status: str | None = None, limit: int = CATALOG_LIMIT) -> DataFrame:
    return _listed(subscriptions, limit, CATALOG_MAX, status=status)


def list_deliveries(deliveries: DataFrame, subscription_id: str, limit: int = DELIVERY_LIMIT) -> DataFrame:
    return _listed(deliveries, limit, DELIVERY_MAX, subscription_id=subscription_id)


def latest_per(df: DataFrame, by: Sequence[str], ts: str, key: str) -> DataFrame:
    """Latest row per group; a map-side aggregate, so a hot group costs one row per task."""
    payload = [c for c in df.columns if c not in by]
    latest = df.groupBy(*by).agg(F.max_by(F.struct(*payload), F.struct(ts, key)).alias("_row"))
    return latest.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in df.columns])


def recent_frames(
    grids: DataFrame,
    n: int,
    at_or_before: datetime | Column | None = None,
    by: Sequence[str] = ("product", "level"),
) -> DataFrame:
    """Last ``n`` frames of each group up to an instant, oldest first; none for ``n <= 0``.

    The rank filter becomes a per-task group limit before the shuffle.
    """
    frames = grids if at_or_before is None else grids.where(F.col("valid_at") <= _instant(at_or_before))
    order = Window.partitionBy(*by).orderBy(F.col("valid_at").desc(), F.col("file_key").desc())
    return (
        frames.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= max(n, 0))
        .drop("_rank")
        .orderBy(*by, "valid_at", "file_key")
    )


def frame_history(
    grids: DataFrame,
    n: int,
    by: Sequence[str] = ("product", "level"),
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Each frame with its history: itself and the ``n - 1`` before it, oldest first.

    Adds ``history`` (``ARRAY<STRUCT<file_key,n_rows,n_cols>>``).  Every frame is offered to
    the ``n`` frames that look back on it, so no task needs the group in order.
    """
    keep = max(n, 1)
    frames = row_positions(grids, by, ["valid_at", "file_key"], time_chunk(F.col("valid_at"), chunk_seconds))
    offered = frames.select(
        *by,
        F.explode(F.sequence(F.lit(0), F.lit(keep - 1))).alias("_ago"),
        "position",
        F.struct("file_key", "n_rows", "n_cols").alias("_frame"),
    ).withColumn("position", F.col("position") + F.col("_ago"))
    histories = offered.groupBy(*by, "position").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_ago")).alias("k"), F.col("_frame").alias("f")))).alias("_h")
    )
    return (
        frames.join(histories, [*by, "position"])
        .withColumn("history", F.transform("_h", lambda h: h["f"]))
        .drop("position", "_h")
    )


def replay_frames(grids: DataFrame, since: datetime | Column, until: datetime | Column) -> DataFrame:
    """Frames of a window, oldest first."""
    return filter_catalog(grids, since=since, until=until).orderBy("valid_at", "file_key")


def loop_frames(grids: DataFrame, now: datetime | Column, minutes: int = 60) -> DataFrame:
    """Frames of the last hour, oldest first."""
    cutoff = _instant(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return grids.where(F.col("valid_at") >= cutoff).orderBy("valid_at", "file_key")


# --- catalog joins ---------------------------------------------------------------------


def grids_with_files(grids: DataFrame, files: DataFrame) -> DataFrame:
    """Grid rows with size and etag of their file."""
    extra = [c for c in files.columns if c not in grids.columns]
    return grids.join(files.select("file_key", *extra), "file_key")


def unmaterialised(files: DataFrame, grids: DataFrame) -> DataFrame:
    """Files that have no grid yet."""
    return files.join(grids.select("file_key"), "file_key", "left_anti")


def unmaterialised_files(files: DataFrame, grids: DataFrame, n: int = MATERIALISE_BATCH) -> DataFrame:
    """The ``n`` newest files without a grid; a work queue, so no page size applies and ``n <= 0`` asks for nothing."""
    return unmaterialised(files, grids).orderBy(F.col("valid_at").desc(), "file_key").limit(max(n, 0))


def pending_counts(files: DataFrame, grids: DataFrame) -> DataFrame:
    """Files without a grid per product and level."""
    return unmaterialised(files, grids).groupBy("product", "level").agg(F.count("*").alias("pending"))




def catalog_totals(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Number of entries, total bytes and latest time."""
    return df.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"),
        F.max("valid_at").alias("latest_valid_at"),
    )


def merge_dedupe(frames: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Union of chunked results; the row of the earliest chunk wins.

    Rows within a chunk that share a key are told apart by their content, so the outcome
    does not depend on scheduling.
    """
    tagged = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("_source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    payload = [c for c in frames[0].columns if c != key]
    firsts = tagged.groupBy(key).agg(F.min_by(F.struct(*payload), F.struct("_source", *payload)).alias("_row"))
    return firsts.select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in frames[0].columns])


def merge_listings(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of day listings, chronological."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged.orderBy("valid_at", "file_key")
