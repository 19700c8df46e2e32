"""Grid reads: points, polygons, resampling, smoothing, tiles."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.functions import geo
from stormframe.functions.color import reflectivity_rgba
from stormframe.functions.parsing import parse_polygon
from stormframe.functions.scores import member_mean
from stormframe.operators import grid, tiles
from stormframe.operators.catalog import frame_history
from stormframe.operators.forecast import lagged_ensemble, member_blocks
from stormframe.plans.derived import LEVEL, Tables
from stormframe.plans.registry import big, epoch, query, rounded
from stormframe.session import scratch_folder
from stormframe.sources import catalog as stored


def axes(t: Tables) -> DataFrame:
    return grid.grid_axes(t.blocks(), t.grids())


@query(
    "grid_cells",
    """SELECT file_key, row_i, col_i, lat, lng, isnan(value) AS missing,
              round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value FROM cells""",
    ("cells",),
)
def grid_cells(t: Tables) -> DataFrame:
    cells = grid.explode_cells(t.blocks())
    return cells.select(
        "file_key", big("row_i"), big("col_i"), "lat", "lng", F.isnan("value").alias("missing"), rounded("value")
    )


@query(
    "grid_pack_roundtrip",
    """SELECT file_key, row_i, col_i, lat, lng, isnan(value) AS missing,
              round(CASE WHEN isnan(value) THEN NULL ELSE CAST(CAST(value AS FLOAT) AS DOUBLE) END, 4) + 0 AS value FROM cells""",
    ("cells",),
)
def grid_pack_roundtrip(t: Tables) -> DataFrame:
    packed = grid.pack_blocks(grid.explode_cells(t.blocks()), height=3, width=5)
    cells = grid.explode_cells(packed)
    value = F.when(~F.isnan("value"), F.round("value", 4)).alias("value")
    return cells.select("file_key", big("row_i"), big("col_i"), "lat", "lng", F.isnan("value").alias("missing"), value)


@query(
    "grid_axes",
    """SELECT 'square-' || product AS axis_key, axis, idx, coord FROM (SELECT DISTINCT product FROM grids),
              (SELECT 'lat' AS axis, CAST(i AS BIGINT) AS idx, 30.0::DOUBLE + i * 0.25::DOUBLE AS coord FROM range(8) t(i)
               UNION ALL SELECT 'lng', CAST(i AS BIGINT), -100.0::DOUBLE + i * 0.25::DOUBLE FROM range(8) t(i))""",
    ("grids",),
)
def grid_axes(t: Tables) -> DataFrame:
    return axes(t).select("axis_key", "axis", big("idx"), "coord")


_NEAREST = """
    least(7, greatest(0, floor((latitude - 30.0::DOUBLE) / 0.25::DOUBLE + 0.5::DOUBLE))) AS r,
    least(7, greatest(0, floor((signed_lng + 100.0::DOUBLE) / 0.25::DOUBLE + 0.5::DOUBLE))) AS c"""
_INSIDE = "abs(latitude - (30.0::DOUBLE + r * 0.25::DOUBLE)) <= 0.125::DOUBLE AND abs(signed_lng - (-100.0::DOUBLE + c * 0.25::DOUBLE)) <= 0.125::DOUBLE"


@query(
    "sample_points",
    f"""SELECT p.point_id, p.frame AS file_key, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value,
               isnan(value) AS missing, x.lat AS matched_lat, x.lng AS matched_lng,
               CASE WHEN x.file_key IS NULL THEN 'out_of_domain' END AS error_reason
        FROM (SELECT *, {_NEAREST} FROM points) p
        LEFT JOIN cells x ON x.file_key = p.frame AND x.row_i = p.r AND x.col_i = p.c AND {_INSIDE}""",
    ("points", "cells"),
)
def sample_points(t: Tables) -> DataFrame:
    probes = t.points().withColumnRenamed("frame", "file_key")
    read = grid.sample_points(probes, t.grids(), t.blocks(), axes(t), tolerance=0.125)
    return read.select(
        "point_id", "file_key", rounded("value"), F.isnan("value").alias("missing"), "matched_lat", "matched_lng", "error_reason"
    ).withColumn("missing", F.when(F.col("matched_lat").isNotNull(), F.col("missing")))


@query(
    "sample_points_asof",
    f"""SELECT p.point_id, p.file_key, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value,
               x.lat AS matched_lat, x.lng AS matched_lng,
               CASE WHEN p.file_key IS NULL THEN 'no_grid' WHEN x.file_key IS NULL THEN 'out_of_domain' END AS error_reason
        FROM (SELECT q.*, g.file_key, {_NEAREST} FROM points q ASOF LEFT JOIN grids g
              ON q.product = g.product AND q.at_epoch >= g.valid_epoch) p
        LEFT JOIN cells x ON x.file_key = p.file_key AND x.row_i = p.r AND x.col_i = p.c AND {_INSIDE}""",
    ("points", "grids", "cells"),
)
def sample_points_asof(t: Tables) -> DataFrame:
    probes = t.points().drop("frame")
    read = grid.sample_points_asof(probes, t.grids(), t.blocks(), axes(t), tolerance=0.125)
    return read.select("point_id", "file_key", rounded("value"), "matched_lat", "matched_lng", "error_reason")


@query(
    "longitude_convention",
    """SELECT point_id, round(CASE WHEN g > 180 THEN g - 360 ELSE g END, 6) AS signed_lng,
              round(CASE WHEN point_id % 2 = 0 AND g < 0 THEN g + 360 ELSE g END, 6) AS grid_lng
       FROM (SELECT point_id, CASE WHEN point_id % 5 = 0 THEN signed_lng + 360 ELSE signed_lng END AS g FROM points)""",
    ("points",),
)
def longitude_convention(t: Tables) -> DataFrame:
    lng = F.col("longitude")
    edge = F.when(F.col("point_id") % 2 == 0, F.lit(359.75)).otherwise(F.lit(-98.25))
    return t.points().select(
        "point_id", rounded("signed_lng", geo.to_signed_lng(lng)), rounded("grid_lng", geo.to_grid_lng(lng, edge))
    )


@query(
    "reduce_polygons",
    """SELECT r.rule_id, w.file_key, r.reducer,
              round(CASE WHEN r.reducer = 'count_ge' AND r.count_threshold IS NULL OR isnan(p.value) THEN NULL ELSE p.value END, 6) + 0 AS value,
              coalesce(p.cell_count, 0) AS cell_count, 3 AS vertex_count, w.bbox_min_lat, w.bbox_min_lng, w.bbox_max_lat, w.bbox_max_lng,
              CASE WHEN r.reducer = 'count_ge' AND r.count_threshold IS NULL THEN 'missing_threshold'
                   WHEN p.cell_count IS NULL THEN 'out_of_domain' END AS error_reason
       FROM (SELECT r.rule_id, c.file_key, min(c.lat) AS bbox_min_lat, min(c.lng) AS bbox_min_lng, max(c.lat) AS bbox_max_lat,
                    max(c.lng) AS bbox_max_lng
             FROM rules r JOIN cells c ON c.product = r.product AND c.lat BETWEEN r.y0 AND r.y0 + r.h AND c.lng BETWEEN r.x0 AND r.x0 + r.w
             WHERE NOT r.is_point AND r.status = 'active' GROUP BY r.rule_id, c.file_key) w
       JOIN rules r ON r.rule_id = w.rule_id LEFT JOIN polygon_reads p ON p.rule_id = w.rule_id AND p.file_key = w.file_key""",
    ("rules", "cells", "polygon_reads"),
)
def reduce_polygons(t: Tables) -> DataFrame:
    polygons = t.rules().where((F.col("config.type") == "polygon") & (F.col("status") == "active")).select(
        F.col("rule_id").alias("polygon_id"), parse_polygon(F.col("config.polygon"))["ring"].alias("ring"),
        F.col("config.reducer").alias("reducer"), F.col("config.count_threshold").alias("threshold"),
        F.col("config.product").alias("product"), F.col("config.level").alias("level"),
    )
    read = grid.reduce_polygons(polygons, t.blocks())
    return read.select(
        F.col("polygon_id").alias("rule_id"), "file_key", "reducer", rounded("value"), big("cell_count"), big("vertex_count"),
        "bbox_min_lat", "bbox_min_lng", "bbox_max_lat", "bbox_max_lng", "error_reason",
    )


# A fixed pentagon over the grid, for the unrolled ray cast.
PENTAGON = ((-99.8, 30.1), (-98.9, 30.05), (-98.4, 30.9), (-99.1, 31.6), (-99.9, 31.2))


@query(
    "literal_ring_mask",
    """SELECT file_key, count(*) AS inside, round(sum(CASE WHEN isnan(value) THEN 0 ELSE value END), 4) + 0 AS total FROM (
         SELECT c.vec_id, c.idx, any_value(c.file_key) AS file_key, any_value(c.value) AS value
         FROM cells c, (VALUES (-99.8::DOUBLE, 30.1::DOUBLE, -99.9::DOUBLE, 31.2::DOUBLE), (-98.9::DOUBLE, 30.05::DOUBLE, -99.8::DOUBLE, 30.1::DOUBLE),
                        (-98.4::DOUBLE, 30.9::DOUBLE, -98.9::DOUBLE, 30.05::DOUBLE), (-99.1::DOUBLE, 31.6::DOUBLE, -98.4::DOUBLE, 30.9::DOUBLE),
                        (-99.9::DOUBLE, 31.2::DOUBLE, -99.1::DOUBLE, 31.6::DOUBLE)) AS e(xi, yi, xj, yj)
         WHERE (yi > lat) <> (yj > lat) AND (xj - xi) * (lat - yi) / (yj - yi) + xi > lng
         GROUP BY c.vec_id, c.idx HAVING count(*) % 2 = 1) GROUP BY file_key""",
    ("cells",),
)
def literal_ring_mask(t: Tables) -> DataFrame:
    cells = grid.explode_cells(t.blocks(), extra=())
    kept = cells.where(geo.point_in_ring(F.col("lng"), F.col("lat"), geo.literal_ring(PENTAGON)))
    total = F.sum(F.when(F.isnan("value"), 0.0).otherwise(F.col("value")))
    return kept.groupBy("file_key").agg(F.count("*").alias("inside"), F.round(total, 4).alias("total"))


@query(
    "clip_to_bbox",
    """SELECT file_key, row_i, col_i, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value FROM cells
       WHERE lat BETWEEN 30.25 AND 31.1 AND lng BETWEEN -99.5 AND -98.7""",
    ("cells",),
)
def clip_to_bbox(t: Tables) -> DataFrame:
    cells = grid.clip_to_bbox(t.blocks(), -99.5, 30.25, -98.7, 31.1)
    return cells.select("file_key", big("row_i"), big("col_i"), rounded("value"))


_TARGETS = """(SELECT point_id, frame, (latitude - 30.0::DOUBLE) / 0.25::DOUBLE AS fr, (signed_lng + 100.0::DOUBLE) / 0.25::DOUBLE AS fc FROM points)"""


def _targets(t: Tables) -> DataFrame:
    return t.points().select(
        "point_id", F.col("frame").alias("file_key"), "latitude", geo.to_signed_lng(F.col("longitude")).alias("longitude")
    )


@query(
    "resample_nearest",
    f"""SELECT p.point_id, round(CASE WHEN isnan(c.value) THEN NULL ELSE c.value END, 6) + 0 AS value
        FROM {_TARGETS} p JOIN grids g ON g.file_key = p.frame
        LEFT JOIN cells c ON c.file_key = p.frame AND c.row_i = round_even(p.fr, 0) AND c.col_i = round_even(p.fc, 0)""",
    ("points", "grids", "cells"),
)
def resample_nearest(t: Tables) -> DataFrame:
    return grid.resample_nearest(_targets(t), t.grids(), t.blocks()).select("point_id", rounded("value"))


@query(
    "resample_bilinear",
    f"""SELECT p.point_id, round(CASE WHEN isnan(v) THEN NULL ELSE v END, 6) + 0 AS value
        FROM {_TARGETS} p LEFT JOIN (
            SELECT q.point_id, sum(c.value * CASE WHEN c.row_i = floor(q.fr) THEN 1 - (q.fr - floor(q.fr)) ELSE q.fr - floor(q.fr) END
                                           * CASE WHEN c.col_i = floor(q.fc) THEN 1 - (q.fc - floor(q.fc)) ELSE q.fc - floor(q.fc) END) AS v
            FROM {_TARGETS} q JOIN cells c ON c.file_key = q.frame AND c.row_i BETWEEN floor(q.fr) AND floor(q.fr) + 1
                 AND c.col_i BETWEEN floor(q.fc) AND floor(q.fc) + 1
            GROUP BY q.point_id HAVING count(*) = 4 AND NOT bool_or(isnan(c.value))) b ON b.point_id = p.point_id""",
    ("points", "cells"),
)
def resample_bilinear(t: Tables) -> DataFrame:
    return grid.resample_bilinear(_targets(t), t.grids(), t.blocks(), key="point_id").select("point_id", rounded("value"))


# The kernel has radius 3; indices past the rim read the edge cell.
_SMOOTHED = """smooth AS MATERIALIZED (
    SELECT a.file_key, a.row_i, a.col_i, CASE WHEN isnan(any_value(a.value)) THEN CAST('NaN' AS DOUBLE)
           ELSE sum(w * CASE WHEN isnan(b.value) THEN 0 ELSE b.value END) / sum(w * CASE WHEN isnan(b.value) THEN 0 ELSE 1 END) END AS value
    FROM cells a, (SELECT dr, dc, exp(-(dr * dr + dc * dc) / (2 * 0.49::DOUBLE)) AS w
                   FROM range(-3, 4) x(dr), range(-3, 4) y(dc)) k
    JOIN cells b ON b.file_key = a.file_key AND b.row_i = least(7, greatest(0, a.row_i + dr))
         AND b.col_i = least(7, greatest(0, a.col_i + dc))
    GROUP BY a.file_key, a.row_i, a.col_i)"""


@query(
    "smooth_grid",
    f"""SELECT file_key, row_i, col_i, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value
        FROM (WITH {_SMOOTHED} SELECT * FROM smooth)""",
    ("cells",),
)
def smooth_grid(t: Tables) -> DataFrame:
    cells = grid.explode_cells(grid.smooth_blocks(t.blocks(), t.grids()))
    return cells.select("file_key", big("row_i"), big("col_i"), rounded("value"))


@query(
    "tile_assignment",
    """SELECT token, z, CAST(floor((longitude + 180) / 360 * 2 ** z) AS BIGINT) AS x,
              CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 2 ** z) AS BIGINT) AS y
       FROM devices, (VALUES (2), (5), (8)) AS t(z) WHERE latitude IS NOT NULL""",
    ("devices",),
)
def tile_assignment(t: Tables) -> DataFrame:
    zoomed = t.devices().where(F.col("latitude").isNotNull()).withColumn("z", F.explode(F.array(F.lit(2), F.lit(5), F.lit(8))))
    z = F.col("z")
    return zoomed.select(
        "token", big("z"), geo.tile_x(F.col("longitude"), z).cast("long").alias("x"), geo.tile_y(F.col("latitude"), z).cast("long").alias("y")
    )


_LAT = "degrees(atan(sinh(pi() * (1 - 2 * {y} / 2 ** z))))"


@query(
    "tiles_over_alerts",
    f"""SELECT z, x, y, count(*) AS n_alerts, round(any_value(x / 2 ** z * 360 - 180), 6) AS lng_min, round(any_value((x + 1) / 2 ** z * 360 - 180), 6) AS lng_max,
               round(any_value({_LAT.format(y='(y + 1)')}), 6) AS lat_min, round(any_value({_LAT.format(y='y')}), 6) AS lat_max
        FROM (SELECT z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (
            SELECT z, CAST(floor((min_lng + 180) / 360 * 2 ** z) AS BIGINT) AS x0, CAST(floor((max_lng + 180) / 360 * 2 ** z) AS BIGINT) AS x1,
                   CAST(floor((1 - ln(tan(radians(max_lat)) + 1 / cos(radians(max_lat))) / pi()) / 2 * 2 ** z) AS BIGINT) AS y0,
                   CAST(floor((1 - ln(tan(radians(min_lat)) + 1 / cos(radians(min_lat))) / pi()) / 2 * 2 ** z) AS BIGINT) AS y1
            FROM alerts, (VALUES (2), (4), (6)) AS t(z) WHERE mapped)))
        GROUP BY z, x, y""",
    ("alerts",),
)
def tiles_over_alerts(t: Tables) -> DataFrame:
    boxes = t.alerts().where(F.col("min_lng").isNotNull()).select("min_lng", "min_lat", "max_lng", "max_lat")
    # A triangle's bounds are those of its box.
    counted = tiles.tiles_over(boxes, (2, 4, 6)).groupBy("z", "x", "y").agg(F.count("*").alias("n_alerts"))
    bounded = tiles.with_tile_bounds(counted)
    return bounded.select(
        big("z"), big("x"), big("y"), "n_alerts", *[rounded(c) for c in ("lng_min", "lng_max", "lat_min", "lat_max")]
    )


@query(
    "tile_pixel_centres",
    """SELECT x, y, count(*) AS pixels, round(sum(longitude), 4) AS longitudes, round(sum(latitude), 4) AS latitudes,
              round(sum(longitude * px + latitude * py), 2) AS moments, round(min(latitude), 6) AS south, round(max(longitude), 6) AS east
       FROM (SELECT x, y, px, py, (x * 256 + px + 0.5::DOUBLE) / (64 * 256) * 360 - 180 AS longitude,
                    degrees(atan(sinh(pi() * (1 - 2 * (y * 256 + py + 0.5::DOUBLE) / (64 * 256))))) AS latitude
             FROM (SELECT DISTINCT CAST(floor((longitude + 180) / 360 * 64) AS BIGINT) AS x,
                          CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 64) AS BIGINT) AS y
                   FROM devices WHERE latitude IS NOT NULL), range(256) a(px), range(256) b(py)) GROUP BY x, y""",
    ("devices",),
)
def tile_pixel_centres(t: Tables) -> DataFrame:
    placed = t.devices().where(F.col("latitude").isNotNull())
    used = placed.select(
        F.lit(6).alias("z"), geo.tile_x(F.col("longitude"), 6).alias("x"), geo.tile_y(F.col("latitude"), 6).alias("y")
    ).distinct()
    lng, lat = F.col("longitude"), F.col("latitude")
    per_tile = tiles.tile_pixels(used).groupBy(big("x"), big("y")).agg(
        F.count("*").alias("pixels"), F.round(F.sum(lng), 4).alias("longitudes"), F.round(F.sum(lat), 4).alias("latitudes"),
        F.round(F.sum(lng * F.col("px") + lat * F.col("py")), 2).alias("moments"), F.round(F.min(lat), 6).alias("south"), F.round(F.max(lng), 6).alias("east"),
    )
    return per_tile


@query(
    "clip_to_tile",
    """SELECT file_key, row_i, col_i, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value FROM cells, (
         SELECT 28 / 128.0::DOUBLE * 360 - 180 AS w, 29 / 128.0::DOUBLE * 360 - 180 AS e,
                degrees(atan(sinh(pi() * (1 - 2 * 53 / 128.0::DOUBLE)))) AS s, degrees(atan(sinh(pi() * (1 - 2 * 52 / 128.0::DOUBLE)))) AS n)
       WHERE col_i BETWEEN ceil((w + 100) / 0.25::DOUBLE) - 8 AND floor((e + 100) / 0.25::DOUBLE) + 8
         AND row_i BETWEEN ceil((s - 30) / 0.25::DOUBLE) - 8 AND floor((n - 30) / 0.25::DOUBLE) + 8""",
    ("cells",),
)
def clip_to_tile(t: Tables) -> DataFrame:
    cells = tiles.clip_to_tile(t.blocks(), t.grids(), 7, 28, 52)
    return cells.select("file_key", big("row_i"), big("col_i"), rounded("value"))


_STOPS = "(5, 4, 233, 231), (10, 1, 159, 244), (15, 3, 0, 244), (20, 2, 253, 2), (25, 1, 197, 1), (30, 0, 142, 0), (35, 253, 248, 2), (40, 229, 188, 0), (45, 253, 149, 0), (50, 253, 0, 0), (55, 212, 0, 0), (60, 188, 0, 0), (65, 248, 0, 253), (70, 152, 84, 198)"
_STOP_TABLE = f"""(SELECT lo, coalesce(lead(lo) OVER o, 1e9) AS hi, r, g, b, coalesce(lead(r) OVER o, r) AS r2, coalesce(lead(g) OVER o, g) AS g2,
                  coalesce(lead(b) OVER o, b) AS b2 FROM (SELECT lo::DOUBLE AS lo, r, g, b FROM (VALUES {_STOPS}) AS s(lo, r, g, b)) WINDOW o AS (ORDER BY lo))"""


def _shade(a: str, b: str, v: str = "v") -> str:
    return f"CAST(coalesce(floor({a} + ({b} - {a}) * (({v} - lo) / (hi - lo))), 0) AS BIGINT)"


_ALPHA = "CAST(CASE WHEN lo IS NULL THEN 0 ELSE floor(90 + 125 * least(1, greatest(0, (v - 5) / 20))) END AS BIGINT)"


@query(
    "reflectivity_colours",
    f"""SELECT file_key, row_i, col_i, {_shade('r', 'r2')} AS r, {_shade('g', 'g2')} AS g, {_shade('b', 'b2')} AS b, {_ALPHA} AS a
        FROM (SELECT *, value AS v FROM cells) LEFT JOIN {_STOP_TABLE} ON NOT isnan(v) AND v >= lo AND v < hi""",
    ("cells",),
)
def reflectivity_colours(t: Tables) -> DataFrame:
    cells = grid.explode_cells(t.blocks(), extra=())
    painted = cells.withColumn("c", reflectivity_rgba(F.col("value")))
    return painted.select("file_key", big("row_i"), big("col_i"), *[F.col(f"c.{k}").cast("long").alias(k) for k in "rgba"])


def _pyramid_sql(zooms: dict[int, str], size: int) -> str:
    """Every pixel of every tile over the default box, sampled by the rule of its zoom."""
    coarse = ", ".join(f"({z})" for z, kind in zooms.items() if kind == "nearest")
    fine = {kind: ", ".join(f"({z})" for z, k in zooms.items() if k == kind) for kind in ("plain", "smooth")}

    def pixels(values: str) -> str:
        return f"""SELECT z, wx, wy, ((wx + 0.5::DOUBLE) / (2 ** z * {size}) * 360 - 180 + 100) / 0.25::DOUBLE AS fc,
                          (degrees(atan(sinh(pi() * (1 - 2 * ((wy + 0.5::DOUBLE) / (2 ** z * {size})))))) - 30) / 0.25::DOUBLE AS fr
                   FROM (VALUES {values}) t(z),
                        LATERAL (SELECT unnest(range(CAST(floor(79 / 360.0::DOUBLE * 2 ** z * {size}) AS BIGINT), CAST(ceil(83 / 360.0::DOUBLE * 2 ** z * {size}) AS BIGINT))) AS wx),
                        LATERAL (SELECT unnest(range(CAST(floor(0.405::DOUBLE * 2 ** z * {size}) AS BIGINT), CAST(ceil(0.42::DOUBLE * 2 ** z * {size}) AS BIGINT))) AS wy)"""

    def blended(values: str, source: str) -> str:
        return f"""SELECT p.z, p.wx, p.wy, a.file_key,
                   a.value * (1 - (fr - floor(fr))) * (1 - (fc - floor(fc))) + b.value * (1 - (fr - floor(fr))) * (fc - floor(fc))
                   + c.value * (fr - floor(fr)) * (1 - (fc - floor(fc))) + d.value * (fr - floor(fr)) * (fc - floor(fc)) AS v
            FROM ({pixels(values)}) p JOIN {source} a ON a.row_i = floor(fr) AND a.col_i = floor(fc)
            JOIN {source} b ON b.file_key = a.file_key AND b.row_i = a.row_i AND b.col_i = a.col_i + 1
            JOIN {source} c ON c.file_key = a.file_key AND c.row_i = a.row_i + 1 AND c.col_i = a.col_i
            JOIN {source} d ON d.file_key = a.file_key AND d.row_i = a.row_i + 1 AND d.col_i = a.col_i + 1"""

    parts = [
        f"SELECT p.z, p.wx, p.wy, a.file_key, a.value AS v FROM ({pixels(coarse)}) p JOIN cells a ON a.row_i = round_even(fr, 0) AND a.col_i = round_even(fc, 0)",
        blended(fine["plain"], "cells"),
        blended(fine["smooth"], "smooth"),
    ]
    sampled = " UNION ALL ".join(parts)
    rgba = f"{_shade('r', 'r2')} * 16777216 + {_shade('g', 'g2')} * 65536 + {_shade('b', 'b2')} * 256 + {_ALPHA}"
    return f"""SELECT file_key, z, x, y, count(*) AS visible, max(alpha) AS max_alpha, CAST(sum(rgba) AS BIGINT) AS rgba_sum,
                      CAST(sum(pixel) AS BIGINT) AS pixel_sum
        FROM (SELECT file_key, CAST(z AS BIGINT) AS z, wx // {size} AS x, wy // {size} AS y, (wy % {size}) * {size} + wx % {size} AS pixel,
                     {rgba} AS rgba, {_ALPHA} AS alpha
              FROM (WITH {_SMOOTHED} {sampled}) LEFT JOIN {_STOP_TABLE} ON NOT isnan(v) AND v >= lo AND v < hi)
        WHERE alpha > 0 GROUP BY file_key, z, x, y"""


@query("tile_pyramid", _pyramid_sql({2: "nearest", 3: "nearest", 4: "plain", 5: "smooth", 6: "smooth"}, 256), ("cells",))
def tile_pyramid(t: Tables) -> DataFrame:
    made = tiles.build_tile_pyramid(t.blocks(), t.grids())

    def total(field: str):
        return F.aggregate("pixels", F.lit(0).cast("long"), lambda s, p: s + p[field].cast("long"))

    return made.select(
        "file_key", big("z"), big("x"), big("y"), "visible", big("max_alpha"), total("rgba").alias("rgba_sum"), total("pixel").alias("pixel_sum")
    )


@query(
    "pending_tiles",
    """SELECT file_key, z, CAST(floor(81 / 360.0::DOUBLE * 2 ** z) AS BIGINT) AS x FROM grids, (VALUES (2), (3), (4), (5), (6)) t(z)
       WHERE (vec_id + z) % 3 <> 0""",
    ("grids",),
)
def pending_tiles(t: Tables) -> DataFrame:
    frames = t.grids().join(t.files().select("file_key", "vec_id"), "file_key")
    wanted = frames.select(
        "file_key", "vec_id", F.explode(F.array(*[F.lit(z) for z in tiles.PYRAMID_ZOOMS])).alias("z")
    ).select("file_key", "vec_id", "z", geo.tile_x(F.lit(-99.0), F.col("z")).alias("x"), geo.tile_y(F.lit(31.0), F.col("z")).alias("y"))
    done = wanted.where((F.col("vec_id") + F.col("z")) % 3 == 0)
    return tiles.pending_tiles(wanted, done).select("file_key", big("z"), big("x"))


@query(
    "member_mean",
    """SELECT h.source_file_key, c.row_i, c.col_i, count(*) AS members,
              round(avg(c.value) FILTER (WHERE NOT isnan(c.value)), 6) + 0 AS value
       FROM history h JOIN cells c ON c.file_key = h.member_key GROUP BY h.source_file_key, c.row_i, c.col_i""",
    ("history", "cells"),
)
def ensemble_mean(t: Tables) -> DataFrame:
    issued = lagged_ensemble(t.grids(), horizons=(10,))
    stacks = member_blocks(issued, t.blocks()).join(issued.select("forecast_key", "source_file_key"), "forecast_key")
    at = F.col("pos")
    per_cell = F.transform("members", lambda m: F.get(m, at))
    cells = stacks.select("source_file_key", "block_row", "block_col", "members", F.posexplode(F.get("members", F.lit(0))).alias("pos", "_v"))
    unpacked = cells.select(
        "source_file_key",
        (F.col("block_row") * 4 + F.floor(at / 4)).alias("row_i"),
        (F.col("block_col") * 4 + at % 4).alias("col_i"),
        per_cell.alias("m"),
    )
    return unpacked.select(
        "source_file_key", big("row_i"), big("col_i"), F.size("m").cast("long").alias("members"), rounded("value", member_mean(F.col("m")))
    )


@query(
    "frame_history",
    "SELECT source_file_key AS file_key, string_agg(member_key, ',' ORDER BY ago DESC) AS members FROM history GROUP BY source_file_key",
    ("history",),
)
def history(t: Tables) -> DataFrame:
    return frame_history(t.grids(), 8).select("file_key", F.concat_ws(",", F.transform("history", lambda h: h["file_key"])).alias("members"))


@query(
    "grid_store_window",
    """SELECT file_key, row_i, col_i, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value FROM cells
       WHERE product = 'P1' AND valid_epoch >= 1704067200 + 3600 AND valid_epoch < 1704067200 + 10800""",
    ("cells",),
)
def grid_store_window(t: Tables) -> DataFrame:
    """Blocks written to the store by day, then a product and time window read back as cells."""
    folder = scratch_folder(t.spark, "grid-store")
    stored.write_blocks(t.blocks(), folder)
    window = {"since": datetime(2024, 1, 1, 1, tzinfo=UTC), "until": datetime(2024, 1, 1, 3, tzinfo=UTC)}
    cells = stored.read_grid_cells(t.spark, folder, product="P1", level=LEVEL, **window)
    return cells.select("file_key", big("row_i"), big("col_i"), rounded("value"))


@query(
    "grid_locators",
    """SELECT file_key, product, valid_epoch, '["latitude","longitude"]' AS dims, '[8,8]' AS shape, 'float32' AS dtype, 256 AS nbytes FROM grids""",
    ("grids",),
)
def grid_locators(t: Tables) -> DataFrame:
    rows = stored.grid_locators(t.blocks())
    return rows.select("file_key", "product", epoch("valid_at", "valid_epoch"), "dims", "shape", "dtype", "nbytes")
