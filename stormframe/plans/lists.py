"""Catalog, alert and feed queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.functions import parsing
from stormframe.functions.values import PREDICATES, predicate_holds
from stormframe.operators import alerts as al
from stormframe.operators import catalog as cat
from stormframe.operators import changes, joins, ordering
from stormframe.plans.derived import Tables, text
from stormframe.plans.registry import big, epoch, micros, query, rounded
from stormframe.sources import catalog as files_at_rest
from stormframe.sources import events as messages
from stormframe.sources import feeds

T0 = datetime(2024, 1, 1, tzinfo=UTC)
NOW = datetime(1998, 6, 1, tzinfo=UTC)


def at(hour: int, minute: int = 0) -> datetime:
    return datetime(2024, 1, 1, hour, minute, tzinfo=UTC)


# --- listings ------------------------------------------------------------------------


_KEY = """CASE WHEN vec_id % 31 = 3 THEN 'CONUS/P' || (vec_id % 2) || '_00.50/notes.txt'
               WHEN vec_id % 37 = 5 THEN 'CONUS/P' || (vec_id % 2) || '_00.50/20240101/MRMS_Other_00.50_' || strftime(make_timestamp(valid_epoch * 1000000), '%Y%m%d-%H%M%S') || '.grib2.gz'
               ELSE 'CONUS/P' || (vec_id % 2) || '_00.50/' || strftime(make_timestamp(valid_epoch * 1000000), '%Y%m%d') || '/MRMS_P' || (vec_id % 2) || '_00.50_'
                    || strftime(make_timestamp(valid_epoch * 1000000), '%Y%m%d-%H%M%S') || '.grib2.gz' END"""


def _listing(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    product = text("P", v % 2)
    stamp = F.date_format("valid_at", "yyyyMMdd-HHmmss")
    good = F.concat(F.lit("CONUS/"), product, F.lit("_00.50/"), F.date_format("valid_at", "yyyyMMdd"), F.lit("/MRMS_"), product, F.lit("_00.50_"), stamp, F.lit(".grib2.gz"))
    key = (
        F.when(v % 31 == 3, F.concat(F.lit("CONUS/"), product, F.lit("_00.50/notes.txt")))
        .when(v % 37 == 5, F.concat(F.lit("CONUS/"), product, F.lit("_00.50/20240101/MRMS_Other_00.50_"), stamp, F.lit(".grib2.gz")))
        .otherwise(good)
    )
    return t.files().select(key.alias("key"), F.col("size_bytes").alias("size"), F.concat(F.lit('"tag'), v.cast("string"), F.lit('"')).alias("etag"))


@query(
    "file_catalog",
    f"""SELECT {_KEY} AS file_key, product, level, valid_epoch, size_bytes, 'tag' || vec_id AS etag
        FROM files WHERE vec_id % 31 <> 3 AND vec_id % 37 <> 5""",
    ("files",),
)
def file_catalog(t: Tables) -> DataFrame:
    rows = files_at_rest.usable(files_at_rest.read_file_catalog(_listing(t)))
    return rows.select("file_key", "product", "level", epoch("valid_at", "valid_epoch"), "size_bytes", "etag")


@query("file_catalog_skipped", "SELECT count(*) FILTER (WHERE vec_id % 31 = 3 OR vec_id % 37 = 5) AS skipped FROM files", ("files",))
def file_catalog_skipped(t: Tables) -> DataFrame:
    return files_at_rest.skipped(files_at_rest.read_file_catalog(_listing(t)))


@query(
    "grid_keys",
    f"SELECT {_KEY} AS file_key, regexp_replace(regexp_replace({_KEY}, '[.]gz$', ''), '[.]grib2$', '') AS grid_key FROM files",
    ("files",),
)
def grid_keys(t: Tables) -> DataFrame:
    return _listing(t).select(F.col("key").alias("file_key"), parsing.grid_key(F.col("key")).alias("grid_key"))


@query(
    "day_scan",
    "SELECT event_id, epoch_us(ts) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-03 22:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'",
)
def day_scan(t: Tables) -> DataFrame:
    since, until = datetime(2024, 1, 3, 22, tzinfo=UTC), datetime(2024, 1, 6, tzinfo=UTC)
    days = cat.days_touched(since, until)
    dated = t.base("events").withColumn("valid_date", F.to_date("ts")).withColumnRenamed("ts", "valid_at")
    pruned = cat.scan_days(dated, F.lit(since), F.lit(until)).where(F.date_format("valid_date", "yyyyMMdd").isin(*days))
    return cat.filter_catalog(pruned, since=since, until=until).select("event_id", micros("valid_at", "ts"))


@query(
    "filter_catalog",
    "SELECT file_key, valid_epoch, size_bytes FROM files WHERE product = 'P1' AND level = '00.50' AND valid_epoch >= 1704067200 + 3600 AND valid_epoch < 1704067200 + 7200",
    ("files",),
)
def filter_catalog(t: Tables) -> DataFrame:
    rows = cat.filter_catalog(t.files(), "P1", "00.50", at(1), at(2))
    return rows.select("file_key", epoch("valid_at", "valid_epoch"), "size_bytes")


@query(
    "newest_grids",
    "SELECT file_key, valid_epoch FROM grids WHERE product = 'P0' ORDER BY valid_epoch DESC, file_key LIMIT 25",
    ("grids",),
)
def newest_grids(t: Tables) -> DataFrame:
    return cat.newest(cat.filter_catalog(t.grids(), "P0"), "valid_at", 25).select("file_key", epoch("valid_at", "valid_epoch"))


@query(
    "recent_frames",
    """SELECT file_key, product, valid_epoch FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY valid_epoch DESC, file_key DESC) AS rn
       FROM grids WHERE valid_epoch <= 1704067200 + 18000) WHERE rn <= 8""",
    ("grids",),
)
def recent_frames(t: Tables) -> DataFrame:
    return cat.recent_frames(t.grids(), 8, at(5)).select("file_key", "product", epoch("valid_at", "valid_epoch"))


@query(
    "latest_observation_per_station",
    """SELECT station, arg_max(event_id, (ts, event_id)) AS event_id, epoch_us(max(ts)) AS ts
       FROM (SELECT *, 'K' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') AS station FROM events) GROUP BY station""",
)
def latest_observation(t: Tables) -> DataFrame:
    rows = t.base("events").withColumn("station", text("K", F.lpad((F.col("user_id") % 100).cast("string"), 3, "0")))
    return cat.latest_per(rows.select("station", "event_id", "ts"), ["station"], "ts", "event_id").select("station", "event_id", micros("ts"))


@query(
    "replay_frames",
    "SELECT file_key, valid_epoch FROM grids WHERE valid_epoch >= 1704067200 + 7200 AND valid_epoch < 1704067200 + 14400",
    ("grids",),
)
def replay_frames(t: Tables) -> DataFrame:
    return cat.replay_frames(t.grids(), at(2), at(4)).select("file_key", epoch("valid_at", "valid_epoch"))


@query("loop_frames", "SELECT file_key, valid_epoch FROM grids WHERE valid_epoch >= 1704067200 + 25200", ("grids",))
def loop_frames(t: Tables) -> DataFrame:
    return cat.loop_frames(t.grids(), at(8)).select("file_key", epoch("valid_at", "valid_epoch"))


@query(
    "grids_with_files",
    "SELECT g.file_key, g.product, f.size_bytes, g.valid_epoch FROM grids g JOIN files f ON f.file_key = g.file_key",
    ("grids", "files"),
)
def grids_with_files(t: Tables) -> DataFrame:
    joined = cat.grids_with_files(t.grids(), t.files().select("file_key", "size_bytes"))
    return joined.select("file_key", "product", "size_bytes", epoch("valid_at", "valid_epoch"))


@query(
    "unmaterialised_files",
    "SELECT file_key, valid_epoch FROM files WHERE vec_id % 10 = 9 ORDER BY valid_epoch DESC, file_key LIMIT 16",
    ("files",),
)
def unmaterialised_files(t: Tables) -> DataFrame:
    return cat.unmaterialised_files(t.files(), t.grids()).select("file_key", epoch("valid_at", "valid_epoch"))


@query("pending_counts", "SELECT product, level, count(*) AS pending FROM files WHERE vec_id % 10 = 9 GROUP BY product, level", ("files",))
def pending_counts(t: Tables) -> DataFrame:
    return cat.pending_counts(t.files(), t.grids())


@query(
    "catalog_totals",
    "SELECT count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, max(valid_epoch) AS latest_valid_epoch FROM files",
    ("files",),
)
def catalog_totals(t: Tables) -> DataFrame:
    return cat.catalog_totals(t.files()).select("entries", "total_bytes", epoch("latest_valid_at", "latest_valid_epoch"))


@query("lookup_by_key", "SELECT id, severity, epoch_us(expires) AS expires FROM alerts WHERE id = 'A101'", ("alerts",))
def lookup_by_key(t: Tables) -> DataFrame:
    return cat.by_key(t.alerts(), "A101").select("id", "severity", micros("expires"))


@query(
    "asof_join",
    """SELECT p.point_id, g.file_key, p.at_epoch - g.valid_epoch AS age FROM points p ASOF LEFT JOIN grids g
       ON p.product = g.product AND p.at_epoch >= g.valid_epoch""",
    ("points", "grids"),
)
def asof_join(t: Tables) -> DataFrame:
    frames = t.grids().select("product", "file_key", "valid_at")
    joined = ordering.asof_join(t.points().select("point_id", "product", "at_time"), frames, ["product"], "at_time", "valid_at", "file_key")
    return joined.select("point_id", "file_key", (F.unix_timestamp("at_time") - F.unix_timestamp("valid_at")).alias("age"))


@query(
    "asof_join_tolerance",
    """SELECT p.point_id, CASE WHEN p.at_epoch - g.valid_epoch <= 90 THEN g.file_key END AS file_key FROM points p ASOF LEFT JOIN grids g
       ON p.product = g.product AND p.at_epoch >= g.valid_epoch""",
    ("points", "grids"),
)
def asof_join_tolerance(t: Tables) -> DataFrame:
    frames = t.grids().select("product", "file_key", "valid_at")
    probes = t.points().select("point_id", "product", "at_time")
    joined = ordering.asof_join(probes, frames, ["product"], "at_time", "valid_at", "file_key", tolerance_seconds=90)
    return joined.select("point_id", "file_key")


# --- alerts ------------------------------------------------------------------------------


@query("active_alerts", "SELECT id, severity FROM alerts WHERE expires IS NULL OR expires > TIMESTAMP '1998-06-01'", ("alerts",))
def active_alerts(t: Tables) -> DataFrame:
    return al.active_alerts(t.alerts(), NOW).select("id", "severity")


@query(
    "alerts_active_at",
    "SELECT id FROM alerts WHERE onset <= TIMESTAMP '1998-06-01' AND (expires IS NULL OR expires >= TIMESTAMP '1998-06-01')",
    ("alerts",),
)
def alerts_active_at(t: Tables) -> DataFrame:
    return al.active_at(t.alerts(), NOW).select("id")


@query(
    "alerts_active_at_instants",
    """SELECT epoch(moment)::BIGINT AS at_epoch, count(*) AS n_active, CAST(sum(CAST(substr(id, 2) AS BIGINT)) AS BIGINT) AS ids
       FROM (SELECT DISTINCT l_shipdate AS moment FROM lineitem)
       JOIN alerts ON (onset IS NULL OR onset <= moment) AND (expires IS NULL OR expires >= moment) GROUP BY moment""",
    ("alerts",),
)
def alerts_active_at_instants(t: Tables) -> DataFrame:
    instants = t.base("lineitem").select(F.col("l_shipdate").alias("at")).distinct()
    active = al.active_at_instants(t.alerts().select("id", "onset", "expires"), instants)
    return active.groupBy(epoch("at", "at_epoch")).agg(F.count("*").alias("n_active"), F.sum(F.substring("id", 2, 20).cast("long")).alias("ids"))


@query("severity_at_least", "SELECT id, severity, rank FROM alerts WHERE rank >= 3", ("alerts",))
def severity_at_least(t: Tables) -> DataFrame:
    rows = al.severity_at_least(t.alerts(), "Severe")
    return rows.select("id", "severity", parsing.severity_rank(F.col("severity")).cast("long").alias("rank"))


_TRIANGLE_BOX = """mapped AND greatest(min_lng, {x0}) <= least(max_lng, {x1}) AND greatest(min_lat, {y0}) <= least(max_lat, {y1})
    AND (NOT triangle OR (greatest(min_lng, {x0}) - min_lng) * (max_lat - min_lat) + (greatest(min_lat, {y0}) - min_lat) * (max_lng - min_lng)
         <= (max_lng - min_lng) * (max_lat - min_lat))"""


@query(
    "alerts_in_bbox",
    f"SELECT id FROM alerts WHERE {_TRIANGLE_BOX.format(x0='-101.25', x1='-98.5', y0='30.5', y1='33.75')}",
    ("alerts",),
)
def alerts_in_bbox(t: Tables) -> DataFrame:
    return al.geom_intersects_bbox(t.alerts(), -101.25, 30.5, -98.5, 33.75).select("id")


@query(
    "alerts_at_point",
    f"SELECT id FROM alerts WHERE {_TRIANGLE_BOX.format(x0='-99.5', x1='-99.5', y0='31.5', y1='31.5')}",
    ("alerts",),
)
def alerts_at_point(t: Tables) -> DataFrame:
    return al.geom_contains_point(t.alerts(), 31.5, -99.5).select("id")


@query(
    "alert_list_projection",
    "SELECT id, event, headline, severity, area_desc, epoch_us(onset) AS onset, epoch_us(expires) AS expires FROM alerts",
    ("alerts",),
)
def alert_list_projection(t: Tables) -> DataFrame:
    rows = al.project_alert_list(t.alerts())
    return rows.select("id", "event", "headline", "severity", "area_desc", micros("onset"), micros("expires"))


@query(
    "rank_alerts",
    """SELECT id, severity, epoch_us(expires) AS expires FROM alerts WHERE expires IS NULL OR expires > TIMESTAMP '1998-06-01'
       ORDER BY rank DESC, expires ASC NULLS LAST, id LIMIT 100""",
    ("alerts",),
)
def rank_alerts(t: Tables) -> DataFrame:
    return al.rank_alerts(al.active_alerts(t.alerts(), NOW)).select("id", "severity", micros("expires"))


@query(
    "recent_feed",
    "SELECT id, severity FROM alerts WHERE rank >= 2 ORDER BY onset DESC, id LIMIT 50",
    ("alerts",),
)
def recent_feed(t: Tables) -> DataFrame:
    return al.recent_feed(t.alerts(), 50, "Moderate", ts="onset").select("id", "severity")


@query(
    "severity_counts",
    """SELECT s.severity, s.rank, count(a.id) AS active, count(a.id) FILTER (WHERE a.mapped) AS mappable
       FROM (VALUES ('Extreme', 4), ('Severe', 3), ('Moderate', 2), ('Minor', 1), ('Unknown', 0)) AS s(severity, rank)
       LEFT JOIN alerts a ON a.severity = s.severity AND a.onset <= TIMESTAMP '1998-06-01'
            AND (a.expires IS NULL OR a.expires >= TIMESTAMP '1998-06-01') GROUP BY s.severity, s.rank""",
    ("alerts",),
)
def severity_counts(t: Tables) -> DataFrame:
    return al.severity_counts(t.alerts(), NOW).select("severity", big("rank"), "active", "mappable")


@query(
    "freshness_stats",
    """SELECT (SELECT count(*) FROM alerts) AS alerts_total,
              (SELECT count(*) FROM alerts WHERE expires IS NULL OR expires > TIMESTAMP '1998-06-01') AS alerts_active,
              (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM grids) AS grids,
              (SELECT count(*) FROM files WHERE vec_id % 10 = 9) AS files_pending,
              (SELECT max(valid_epoch) FROM files) AS latest_valid_epoch,
              (SELECT epoch_us(max(expires)) FROM alerts) AS latest_alert_expires""",
    ("alerts", "files", "grids"),
)
def freshness_stats(t: Tables) -> DataFrame:
    row = al.stats(t.alerts(), t.files(), t.grids(), NOW)
    return row.select(
        "alerts_total", "alerts_active", "files", "grids", "files_pending", epoch("latest_valid_at", "latest_valid_epoch"),
        micros("latest_alert_expires"),
    )


_INSIDE = """a.mapped AND d.latitude IS NOT NULL AND d.longitude BETWEEN a.min_lng AND a.max_lng AND d.latitude BETWEEN a.min_lat AND a.max_lat
    AND (NOT a.triangle OR (d.longitude - a.min_lng) * (a.max_lat - a.min_lat) + (d.latitude - a.min_lat) * (a.max_lng - a.min_lng)
         <= (a.max_lng - a.min_lng) * (a.max_lat - a.min_lat))"""


@query("points_in_polygons", f"SELECT a.id, d.token FROM alerts a JOIN devices d ON {_INSIDE} WHERE a.rank >= 3", ("alerts", "devices"))
def points_in_polygons(t: Tables) -> DataFrame:
    return joins.points_in_polygons(t.devices(), al.push_eligible(t.alerts())).select("id", "token")


@query(
    "push_payloads",
    f"""SELECT a.id, d.token, coalesce(a.headline, a.area_desc, 'Tap for details.') AS body, a.event AS title, d.latitude AS lat, d.longitude AS lng
        FROM alerts a JOIN devices d ON {_INSIDE} WHERE a.rank >= 3""",
    ("alerts", "devices"),
)
def push_payloads(t: Tables) -> DataFrame:
    matches = joins.points_in_polygons(t.devices(), al.push_eligible(t.alerts()))
    made = al.push_payload(matches, "https://example.org")
    # A payload is read once, not once for each field.
    read = F.from_json("payload", "aps struct<alert: struct<body: string, title: string>>, lat double, lng double")
    return made.withColumn("_read", read).select("id", "token", "_read.aps.alert.body", "_read.aps.alert.title", "_read.lat", "_read.lng")


@query(
    "prune_devices",
    "SELECT token FROM devices WHERE token NOT IN (SELECT 'dev-' || o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ("devices",),
)
def prune_devices(t: Tables) -> DataFrame:
    dead = t.base("orders").where("o_orderstatus = 'P'").select(text("dev-", F.col("o_custkey")).alias("token"))
    return al.prune_devices(t.devices(), dead).select("token")


# --- feeds -----------------------------------------------------------------------------------


def _alert_documents(t: Tables, historical: bool = False) -> DataFrame:
    """One FeatureCollection per order, some of them damaged in known ways."""
    a = t.alerts().withColumn("k", F.substring("id", 2, 20).cast("long"))
    ring = F.transform(F.col("parts")[0][0], lambda v: F.array(v["lng"], v["lat"]))
    shape = F.when(
        F.col("parts").isNotNull(),
        F.when(
            F.col("k") % 2 == 0, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
        ).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")))),
    )
    stamp = F.date_format("onset", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if historical:
        codes = F.array(*[F.lit(c) for c in ("TO", "SV", "FF", "ZZ", "hu")])
        properties = F.struct(
            F.when(F.col("k") % 19 != 0, F.col("id")).alias("product_id"),
            F.get(codes, (F.col("k") % 5).cast("int")).alias("phenomena"),
            F.when(F.col("k") % 7 != 0, F.col("event")).alias("event_label"),
            F.when(F.col("k") % 3 != 0, F.lit("FWD")).alias("wfo"),
            F.when(F.col("k") % 2 == 0, stamp).alias("utc_polygon_begin"),
            F.lit("2000-01-01T00:00:00Z").alias("utc_issue"),
            F.lit("2001-01-01T00:00:00Z").alias("utc_expire"),
            F.when(F.col("k") % 4 == 0, F.lit("  ")).otherwise(F.col("area_desc")).alias("locations"),
        )
    else:
        properties = F.struct(
            F.concat(F.lit(" "), F.col("id")).alias("id"),
            F.when(F.col("k") % 17 != 0, F.col("event")).alias("event"),
            F.col("headline"),
            F.when(F.col("k") % 13 == 0, F.lit("Huge")).when(F.col("k") % 7 != 0, F.col("severity")).alias("severity"),
            F.lit("Expected").alias("urgency"),
            F.col("area_desc").alias("areaDesc"),
            F.when(F.col("k") % 29 == 0, F.lit("soon")).otherwise(stamp).alias("onset"),
        )
    body = F.to_json(properties)
    document = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")),
        F.lit(',"properties":'), body, F.lit("}]}"),
    )
    return a.select(document.alias("payload"))


@query(
    "alert_features",
    """SELECT id, event, headline, CASE WHEN k % 7 = 0 THEN 'Unknown' ELSE severity END AS severity, area_desc, epoch_us(onset) AS onset,
              mapped, CASE WHEN NOT mapped THEN NULL WHEN triangle THEN 3 ELSE 4 END AS vertices,
              CASE WHEN mapped THEN min_lng END AS min_lng, CASE WHEN mapped THEN max_lat END AS max_lat
       FROM alerts WHERE k % 17 <> 0 AND k % 13 <> 0 AND k % 29 <> 0""",
    ("alerts",),
)
def alert_features(t: Tables) -> DataFrame:
    rows = feeds.read_alert_features(_alert_documents(t)).where("error_reason IS NULL")
    bounded = al.with_bounds(rows)
    return bounded.select(
        "id", "event", "headline", "severity", "area_desc", micros("onset"), F.col("parts").isNotNull().alias("mapped"),
        F.when(F.col("parts").isNotNull(), F.size(F.col("parts")[0][0])).cast("long").alias("vertices"), "min_lng", "max_lat",
    )


@query(
    "alert_features_rejected",
    """SELECT CASE WHEN k % 17 = 0 THEN 'missing_field' WHEN k % 13 = 0 THEN 'unknown_severity' ELSE 'bad_onset' END AS error_reason, count(*) AS n_rows
       FROM alerts WHERE k % 17 = 0 OR k % 13 = 0 OR k % 29 = 0 GROUP BY 1""",
    ("alerts",),
)
def alert_features_rejected(t: Tables) -> DataFrame:
    rows = feeds.read_alert_features(_alert_documents(t)).where("error_reason IS NOT NULL")
    return rows.groupBy("error_reason").agg(F.count("*").alias("n_rows"))


@query(
    "historical_warnings",
    """SELECT id, CASE WHEN k % 7 <> 0 THEN event ELSE ['TO', 'SV', 'FF', 'ZZ', 'HU'][k % 5 + 1] END AS event,
              ['Extreme', 'Severe', 'Severe', 'Moderate', 'Extreme'][k % 5 + 1] AS severity,
              CASE WHEN k % 3 <> 0 THEN 'NWS FWD' END AS sender_name, CASE WHEN k % 4 <> 0 THEN area_desc END AS area_desc,
              epoch_us(CASE WHEN k % 2 = 0 THEN onset ELSE TIMESTAMP '2000-01-01' END) AS onset,
              epoch_us(TIMESTAMP '2001-01-01') AS ends
       FROM alerts WHERE k % 19 <> 0""",
    ("alerts",),
)
def historical_warnings(t: Tables) -> DataFrame:
    rows = feeds.normalise_warnings(_alert_documents(t, historical=True))
    return rows.select("id", "event", "severity", "sender_name", "area_desc", micros("onset"), micros("ends"))


@query(
    "merge_chunked_warnings",
    "SELECT id, CASE WHEN k % 3 <> 0 THEN 'first' WHEN k % 2 = 0 THEN 'second' ELSE 'third' END AS chunk FROM alerts",
    ("alerts",),
)
def merge_chunked_warnings(t: Tables) -> DataFrame:
    a = t.alerts().select("id", F.substring("id", 2, 20).cast("long").alias("k"))
    chunks = [
        a.where("k % 3 <> 0").withColumn("chunk", F.lit("first")),
        a.where("k % 2 = 0").withColumn("chunk", F.lit("second")),
        a.withColumn("chunk", F.lit("third")),
    ]
    return cat.merge_dedupe(chunks).select("id", "chunk")


@query("merge_listings", "SELECT file_key, valid_epoch FROM files", ("files",))
def merge_listings(t: Tables) -> DataFrame:
    halves = [t.files().where(F.col("vec_id") % 2 == r).drop("vec_id") for r in (0, 1)]
    return cat.merge_listings(halves).select("file_key", epoch("valid_at", "valid_epoch"))


_OBSERVATIONS = """(SELECT event_id, 'K' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') AS station_id, epoch_us(date_trunc('second', ts)) AS observation_time,
    25 + user_id % 20 AS latitude, -120 + user_id % 50 AS longitude, value / 10 AS temp_c,
    CASE WHEN event_type <> 'error' THEN (event_id * 10) % 360 END AS wind_direction_deg,
    CASE event_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 WHEN 4 THEN 0.75 WHEN 6 THEN 7 END AS visibility_sm
    FROM events WHERE event_id % 29 <> 0)"""


@query(
    "station_records",
    f"""SELECT event_id, station_id, observation_time, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
               round(temp_c, 6) AS temp_c, CAST(wind_direction_deg AS BIGINT) AS wind_direction_deg, CAST(visibility_sm AS DOUBLE) AS visibility_sm
        FROM {_OBSERVATIONS}""",
)
def station_records(t: Tables) -> DataFrame:
    rows = feeds.read_station_records(t.observations())
    return rows.select(
        F.substring("raw_text", 7, 20).cast("long").alias("event_id"), "station_id", micros("observation_time"), "latitude", "longitude",
        rounded("temp_c"), big("wind_direction_deg"), "visibility_sm",
    )


@query(
    "filter_observations",
    f"""SELECT event_id, observation_time FROM {_OBSERVATIONS} WHERE station_id = 'K012' AND observation_time >= epoch_us(TIMESTAMP '2024-01-05')
        AND observation_time < epoch_us(TIMESTAMP '2024-01-20') AND latitude BETWEEN 25 AND 40 AND longitude BETWEEN -120 AND -80""",
)
def filter_observations(t: Tables) -> DataFrame:
    rows = feeds.read_station_records(t.observations())
    kept = cat.filter_observations(
        rows, "k012", datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC), (-120.0, 25.0, -80.0, 40.0)
    )
    return kept.select(F.substring("raw_text", 7, 20).cast("long").alias("event_id"), micros("observation_time"))


@query(
    "validate_observations",
    """SELECT CASE WHEN value < 20 THEN 'wind_speed_kt_range' END AS first_violation, count(*) AS n_rows FROM events GROUP BY 1""",
)
def validate_observations(t: Tables) -> DataFrame:
    rows = t.base("events").select((F.col("value") - 20).alias("wind_speed_kt"), (F.col("event_id") % 361).alias("wind_direction_deg"))
    valid, bad = changes.validate(rows, changes.range_checks(changes.OBSERVATION_RANGES, rows))
    both = valid.select(F.lit(None).cast("string").alias("first_violation")).unionByName(
        bad.select(F.col("violations")[0].alias("first_violation"))
    )
    return both.groupBy("first_violation").agg(F.count("*").alias("n_rows"))


@query(
    "event_messages",
    """SELECT file_key, product, level, valid_epoch, size_bytes, 'tag' || vec_id AS etag, vec_id % 25 = 7 AS is_bad
       FROM files WHERE vec_id % 25 <> 7 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true FROM files WHERE vec_id % 25 = 7""",
    ("files",),
)
def event_messages(t: Tables) -> DataFrame:
    sent = messages.to_event_json(t.files().withColumn("etag", text("tag", F.col("vec_id"))), "mrms.files.new")
    damaged = sent.select(F.when(F.col("vec_id") % 25 == 7, F.lit('{"key": 12, ')).otherwise(F.col("value")).alias("value"))
    back = messages.read_events(damaged, "mrms.files.new")
    return back.select("file_key", "product", "level", epoch("valid_at", "valid_epoch"), "size_bytes", "etag", "is_bad")


@query(
    "alert_geojson",
    """SELECT id, 'Feature' AS type, severity, headline, strftime(onset, '%Y-%m-%dT%H:%M:%SZ') AS onset,
              CASE WHEN mapped THEN 'Polygon' END AS geometry_type, CASE WHEN mapped THEN min_lng END AS first_lng,
              CASE WHEN mapped THEN CASE WHEN triangle THEN 4 ELSE 5 END END AS positions
       FROM alerts""",
    ("alerts",),
)
def alert_geojson(t: Tables) -> DataFrame:
    made = feeds.alerts_to_geojson(t.alerts())

    def field(path: str):
        return F.get_json_object("feature", path)

    positions = F.from_json(field("$.geometry.coordinates"), "array<array<array<double>>>")
    return made.select(
        "id", field("$.type").alias("type"), field("$.properties.severity").alias("severity"), field("$.properties.headline").alias("headline"),
        field("$.properties.onset").alias("onset"), field("$.geometry.type").alias("geometry_type"), positions[0][0][0].alias("first_lng"),
        F.when(positions.isNotNull(), F.size(positions[0])).cast("long").alias("positions"),
    )


# --- parsers over text made from the tables ----------------------------------------------------


@query(
    "parse_polygon_text",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'odd_value_count' WHEN 2 THEN 'not_numeric' WHEN 3 THEN 'too_few_vertices'
              WHEN 4 THEN 'out_of_range' END AS error_reason, CASE WHEN c_custkey % 6 IN (0, 5) THEN 3 END AS vertices,
              CASE WHEN c_custkey % 6 IN (0, 5) THEN CAST(c_custkey % 90 AS DOUBLE) END AS first_lng FROM customer""",
)
def parse_polygon_text(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    x = (k % 90).cast("string")
    good = F.concat(x, F.lit(", 10,20,30,40.5,50"))
    cases = (
        F.when(k % 6 == 1, F.concat(x, F.lit(",10,20,30,40")))
        .when(k % 6 == 2, F.concat(x, F.lit(",ten,20,30,40,50")))
        .when(k % 6 == 3, F.concat(x, F.lit(",10,20,30")))
        .when(k % 6 == 4, F.concat(x, F.lit(",95,20,30,40,50")))
        .otherwise(good)
    )
    parsed = t.base("customer").select("c_custkey", parsing.parse_polygon(cases).alias("p"))
    return parsed.select(
        "c_custkey", "p.error_reason", F.when(F.col("p.ring").isNotNull(), F.size("p.ring")).cast("long").alias("vertices"),
        F.col("p.ring")[0]["lng"].alias("first_lng"),
    )


@query(
    "parse_bbox_and_point",
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 'wrong_value_count' WHEN 2 THEN 'not_numeric' WHEN 3 THEN 'crosses_antimeridian'
              WHEN 4 THEN 'latitudes_reversed' END AS box_reason, CASE WHEN s_suppkey % 5 = 0 THEN -100.5::DOUBLE END AS min_lng,
              CASE WHEN s_suppkey % 4 = 3 THEN 'latitude_out_of_range' END AS point_reason,
              CASE WHEN s_suppkey % 4 <> 3 THEN 31.25::DOUBLE END AS lat FROM supplier""",
)
def parse_bbox_and_point(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    box = (
        F.when(k % 5 == 1, F.lit("1,2,3")).when(k % 5 == 2, F.lit("1,2,x,4")).when(k % 5 == 3, F.lit("170,10,-170,20"))
        .when(k % 5 == 4, F.lit("10,20,30,5")).otherwise(F.lit("-100.5, 30,-99,31"))
    )
    point = F.when(k % 4 == 3, F.lit("91,10")).otherwise(F.lit("31.25, -99"))
    parsed = t.base("supplier").select("s_suppkey", parsing.parse_bbox(box).alias("b"), parsing.parse_point(point).alias("p"))
    return parsed.select("s_suppkey", F.col("b.error_reason").alias("box_reason"), "b.min_lng", F.col("p.error_reason").alias("point_reason"), "p.lat")


@query(
    "parse_codes_dims_times",
    """SELECT o_orderkey, 'FWD|' || 'X' || (o_orderkey % 7) AS codes, 2 AS n_dims, 8 + o_orderkey % 3 AS n_rows,
              CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(o_orderdate) - 7200000000 ELSE epoch_us(o_orderdate) END AS at_us
       FROM orders""",
)
def parse_codes_dims_times(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = (
        F.when(k % 4 == 0, F.concat(day, F.lit("Z"))).when(k % 4 == 1, day).when(k % 4 == 2, F.concat(day, F.lit("+02:00"))).otherwise(F.lit("yesterday"))
    )
    return t.base("orders").select(
        "o_orderkey",
        F.concat_ws("|", parsing.parse_codes(F.concat(F.lit(" fwd, ,x"), (k % 7).cast("string")))).alias("codes"),
        F.size(parsing.parse_dims(F.lit('["latitude","longitude"]'))).cast("long").alias("n_dims"),
        parsing.parse_shape(F.concat(F.lit("["), (F.lit(8) + k % 3).cast("string"), F.lit(",8]")))[0].cast("long").alias("n_rows"),
        F.unix_micros(parsing.parse_utc(stamp)).alias("at_us"),
    )


@query(
    "predicates",
    """SELECT op, count(*) FILTER (WHERE CASE WHEN isnan(v) THEN op = '!=' WHEN op = '>' THEN v > 50 WHEN op = '>=' THEN v >= 50 WHEN op = '<' THEN v < 50
              WHEN op = '<=' THEN v <= 50 WHEN op = '==' THEN v = 50 ELSE v <> 50 END) AS held
       FROM (SELECT CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(event_id % 100 AS DOUBLE) END AS v FROM events),
            (VALUES ('>'), ('>='), ('<'), ('<='), ('=='), ('!=')) AS o(op) GROUP BY op""",
)
def predicates(t: Tables) -> DataFrame:
    e = F.col("event_id")
    value = F.when(e % 11 == 0, F.lit(float("nan"))).otherwise((e % 100).cast("double"))
    ops = F.explode(F.array(*[F.lit(o) for o in PREDICATES]))
    rows = t.base("events").select(value.alias("v"), ops.alias("op"))
    return rows.groupBy("op").agg(F.count_if(predicate_holds(F.col("v"), F.col("op"), 50.0)).alias("held"))


@query(
    "phenomena_severity",
    """SELECT o_orderkey, ['Extreme', 'Severe', 'Moderate', 'Extreme', 'Severe', 'Moderate'][o_orderkey % 6 + 1] AS severity FROM orders""",
)
def phenomena_severity(t: Tables) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("TO", "sv", "XX", "EW", "FF", "")])
    return t.base("orders").select("o_orderkey", parsing.severity_of(F.get(codes, (F.col("o_orderkey") % 6).cast("int"))).alias("severity"))


@query(
    "coordinate_checks",
    """SELECT c_custkey, CASE WHEN c_acctbal < -90 OR c_acctbal > 90 THEN 'latitude_out_of_range' END AS reason FROM customer""",
)
def coordinate_checks(t: Tables) -> DataFrame:
    return t.base("customer").select("c_custkey", parsing.latlng_problem(F.col("c_acctbal"), (F.col("c_custkey") % 180).cast("double")).alias("reason"))
