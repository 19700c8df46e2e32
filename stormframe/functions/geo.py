"""Longitude conventions, ring tests and Web-Mercator arithmetic as columns.

A ring is ``ARRAY<STRUCT<lng DOUBLE, lat DOUBLE>>`` closed implicitly; a geometry is
``parts``: an array of polygons, each an array of rings (outer ring first, then holes).
Grid masks use the strict ray cast; alert geometries also accept their boundary.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<lng:double,lat:double>>"
PARTS_TYPE = f"array<array<{RING_TYPE}>>"

# Fixed values of the tiling scheme.
MAX_LATITUDE = 85.0511287798066
TILE_LATITUDE_CLAMP = 85.0511
TILE_SIZE = 256


def _num(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


# --- longitudes ---------------------------------------------------------------


def to_signed_lng(lng: Column) -> Column:
    return F.when(lng > 180.0, lng - 360.0).otherwise(lng)


def to_grid_lng(lng: Column, grid_max_lng: Column) -> Column:
    """Shift a negative request only where the grid itself runs past 180."""
    return F.when((grid_max_lng > 180.0) & (lng < 0.0), lng + 360.0).otherwise(lng)


# --- rings ----------------------------------------------------------------------


def ring_edges(ring: Column) -> Column:
    """Array of STRUCT<p,q>: each vertex with the one before it, the first with the last."""
    previous = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    return F.zip_with(ring, previous, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _crosses(p: Column, q: Column, y: Column) -> Column:
    return (p["lat"] > y) != (q["lat"] > y)


def _edge_x(p: Column, q: Column, y: Column) -> Column:
    # Multiply before dividing: the rounding decides cells that lie on a slanted edge.
    return F.try_divide((q["lng"] - p["lng"]) * (y - p["lat"]), q["lat"] - p["lat"]) + p["lng"]


def scanline_crossings(edges: Column, lat: Column) -> Column:
    """Longitudes at which the edges of a ring cross a parallel.

    One array serves every cell of a grid row, so the edge walk is paid per row
    rather than per cell.
    """
    crossing = F.filter(edges, lambda e: _crosses(e["p"], e["q"], lat))
    return F.transform(crossing, lambda e: _edge_x(e["p"], e["q"], lat))


def inside_scanline(crossings: Column, lng: Column) -> Column:
    """Odd number of crossings strictly to the right of ``lng``."""
    return F.size(F.filter(crossings, lambda x: x > lng)) % 2 == 1


def point_in_ring(lng: Column | float, lat: Column | float, ring: Column) -> Column:
    """Strict even-odd ray cast."""
    return inside_scanline(scanline_crossings(ring_edges(ring), _num(lat)), _num(lng))


def literal_ring(vertices: Sequence[tuple[float, float]]) -> Column:
    """A ring of known vertices."""
    return F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in vertices])


def _turn(p: Column, q: Column, x: Column, y: Column) -> Column:
    """Sign tells the side of line pq on which (x, y) lies."""
    return (q["lng"] - p["lng"]) * (y - p["lat"]) - (q["lat"] - p["lat"]) * (x - p["lng"])


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    p, q = e["p"], e["q"]
    return (
        x.between(F.least(p["lng"], q["lng"]), F.greatest(p["lng"], q["lng"]))
        & y.between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"]))
        & (_turn(p, q, x, y) == 0.0)
    )


def parts_edges(parts: Column) -> Column:
    """Edges of each polygon, rings run together: a point is inside on an odd count over all of them.

    Worked out once per geometry, before it is joined with many points.
    """
    return F.transform(parts, lambda part: F.flatten(F.transform(part, lambda ring: ring_edges(ring))))


def edges_contain_point(edges: Column, lng: Column | float, lat: Column | float) -> Column:
    """Point in any polygon of ``parts_edges`` (holes excluded), the boundary counting as inside."""
    x, y = _num(lng), _num(lat)

    def inside(part: Column) -> Column:
        odd = F.size(F.filter(part, lambda e: _crosses(e["p"], e["q"], y) & (_edge_x(e["p"], e["q"], y) > x))) % 2 == 1
        return odd | F.exists(part, lambda e: _on_edge(e, x, y))

    return F.coalesce(F.exists(edges, inside), F.lit(False))


def parts_contain_point(parts: Column, lng: Column | float, lat: Column | float) -> Column:
    """Point in any polygon (holes excluded), the boundary counting as inside."""
    return edges_contain_point(parts_edges(parts), lng, lat)


def parts_intersect_box(
    parts: Column,
    min_lng: Column | float,
    min_lat: Column | float,
    max_lng: Column | float,
    max_lat: Column | float,
) -> Column:
    """An edge meets the box, or the box lies inside a polygon."""
    x0, y0, x1, y1 = _num(min_lng), _num(min_lat), _num(max_lng), _num(max_lat)

    def edge_meets_box(e: Column) -> Column:
        p, q = e["p"], e["q"]
        overlaps = (
            (F.least(p["lng"], q["lng"]) <= x1)
            & (F.greatest(p["lng"], q["lng"]) >= x0)
            & (F.least(p["lat"], q["lat"]) <= y1)
            & (F.greatest(p["lat"], q["lat"]) >= y0)
        )
        sides = [_turn(p, q, x, y) for x in (x0, x1) for y in (y0, y1)]
        return overlaps & (F.least(*sides) <= 0.0) & (F.greatest(*sides) >= 0.0)

    edges = parts_edges(parts)
    touches = F.exists(edges, lambda part: F.exists(part, edge_meets_box))
    return F.coalesce(touches | edges_contain_point(edges, x0, y0), F.lit(False))


def parts_bounds(parts: Column) -> Column:
    """STRUCT<min_lng,min_lat,max_lng,max_lat>; null for a missing geometry."""
    vertices = F.flatten(F.flatten(parts))
    lngs = F.transform(vertices, lambda v: v["lng"])
    lats = F.transform(vertices, lambda v: v["lat"])
    return F.struct(
        F.array_min(lngs).alias("min_lng"),
        F.array_min(lats).alias("min_lat"),
        F.array_max(lngs).alias("max_lng"),
        F.array_max(lats).alias("max_lat"),
    )


# --- tiles ------------------------------------------------------------------------


def tiles_per_axis(z: Column | int) -> Column:
    return F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))


def mercator_lat(y_fraction: Column) -> Column:
    """Latitude of a position measured from the north edge, 0..1."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * y_fraction))))


def mercator_fraction(lat: Column) -> Column:
    """Inverse of ``mercator_lat`` with latitude clamped to the square."""
    rad = F.radians(F.greatest(F.lit(-TILE_LATITUDE_CLAMP), F.least(F.lit(TILE_LATITUDE_CLAMP), lat)))
    return (F.lit(1.0) - F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)) / F.lit(2.0)


def tile_x(lng: Column, z: Column | int) -> Column:
    n = tiles_per_axis(z)
    return F.greatest(F.lit(0.0), F.least(n - 1.0, F.floor((lng + 180.0) / 360.0 * n).cast("double"))).cast("int")


def tile_y(lat: Column, z: Column | int) -> Column:
    n = tiles_per_axis(z)
    return F.greatest(F.lit(0.0), F.least(n - 1.0, F.floor(mercator_fraction(lat) * n).cast("double"))).cast("int")


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """STRUCT<lng_min,lng_max,lat_min,lat_max>; null where the tile is off the grid of its zoom."""
    n = tiles_per_axis(z)
    valid = (x >= 0) & (x < n) & (y >= 0) & (y < n)
    return F.when(
        valid,
        F.struct(
            (x / n * 360.0 - 180.0).alias("lng_min"),
            ((x + 1) / n * 360.0 - 180.0).alias("lng_max"),
            mercator_lat((y + 1) / n).alias("lat_min"),
            mercator_lat(y / n).alias("lat_max"),
        ),
    )
