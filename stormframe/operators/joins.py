"""Joins Spark has no single operator for, rewritten as equi-joins.

None of them broadcasts by hint: AQE turns the small side into a broadcast once its
measured size allows, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from stormframe.functions.geo import edges_contain_point, parts_edges

MATCH_WINDOW_SECONDS = 60
COVER_DEGREES = 1.0


def hot_rows(left: DataFrame, on: Sequence[str]) -> list[Row]:
    """The rows of ``hot_keys``."""
    counts = left.groupBy(*on).agg(F.count("*").alias("_n")).persist()
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(1, total // (2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col("_n") / share).cast("int").alias("_salts")
    rows = counts.where(F.col("_n") > share).select(*on, salts).collect()
    counts.unpersist()
    return rows


def hot_keys(left: DataFrame, on: Sequence[str], rows: list[Row] | None = None) -> DataFrame:
    """Keys that hold more than half a shuffle partition's share of the rows, and ``_salts``, how many times that.

    Counted over all rows; there are at most twice as many such keys as shuffle partitions.
    """
    rows = hot_rows(left, on) if rows is None else rows
    return left.sparkSession.createDataFrame(rows, left.select(*on, F.lit(0).alias("_salts")).schema)


def spread_sides(
    left: DataFrame, right: DataFrame, on: Sequence[str], salts: int | DataFrame, by: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a ``_salt``: left rows have one, right rows all those of their key.

    ``salts``: the same number for every key, or a frame of ``hot_keys``; other keys have one then.
    """
    if isinstance(salts, int):
        mine, theirs, many = left, right, F.lit(salts)
    else:
        # As many rows as hot keys, whose number is bounded.
        mine, theirs = (side.join(F.broadcast(salts), list(on), "left") for side in (left, right))
        many = F.coalesce("_salts", F.lit(1))
    spread = mine.withColumn("_salt", F.pmod(F.xxhash64(*(by or left.columns)), many.cast("long")).cast("int"))
    listed = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
    return spread.select(*left.columns, "_salt"), listed.select(*right.columns, "_salt")


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], salts: int | None = None, by: Sequence[str] | None = None
) -> DataFrame:
    """Inner equi-join on keys with very few values (event types, products).

    Left rows of a hot key are spread over salts by the columns ``by`` (all of them if not given) and
    its right rows listed once per salt, so no key is confined to one task.  The salts follow the
    counted rows of each key, or are ``salts`` for every key where counting is not worth a pass.
    """
    spread, listed = spread_sides(left, right, on, hot_keys(left, on) if salts is None else salts, by)
    return spread.join(listed, [*on, "_salt"]).drop("_salt")


#: Rows that are met together as an array, rows of a key that stay in one part, and parts that the other side is dealt to.
PACK, PART_ROWS, SPREAD = 32, 4096, 32


def meet_packs(
    left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], order: Sequence[str], packs: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Left rows with the right rows of their key, at most ``PACK`` of them at a time.

    ``packs`` names arrays and the right columns that they hold, all in the same order.  Keys may be few
    and hold any number of rows on either side: right rows are dealt to parts of about ``PART_ROWS`` by
    ``order``, left rows, by ``by``, to as many as make ``SPREAD`` pieces of a key in all.  ``right`` is read
    twice.  What little is shuffled stays in all its partitions, as pairs are far more than it.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # As many rows as parts are full, so their number is bounded.
    full = right.groupBy(*on).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")).where(F.col("_parts") > 1)

    def with_parts(side: DataFrame) -> DataFrame:
        counted = side.join(F.broadcast(full), list(on), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        return counted.withColumn("_salts", F.ceil(F.lit(SPREAD) / F.col("_parts")).cast("int"))

    mine = with_parts(left).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_salts").cast("long")).cast("int"))
    mine = mine.withColumn("_in", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    theirs = with_parts(right).withColumn("_in", F.pmod(F.xxhash64(*order), F.col("_parts").cast("long")).cast("int"))
    counted_off = F.row_number().over(Window.partitionBy(*on, "_in").orderBy(*order)) - 1
    packed = theirs.withColumn("_pack", F.floor(counted_off / PACK)).groupBy(*on, "_in", "_salts", "_pack")
    listed = packed.agg(*[F.collect_list(F.struct(*columns)).alias(name) for name, columns in packs.items()])
    listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    key = [*on, "_in", "_salt"]
    met = mine.select(*left.columns, "_in", "_salt").repartition(partitions, *key).join(listed.select(*key, *packs).repartition(partitions, *key), key)
    return met.select(*left.columns, *packs)


def match_forecasts(
    nowcasts: DataFrame,
    observations: DataFrame,
    seconds: int = MATCH_WINDOW_SECONDS,
    by: Sequence[str] = ("product", "level"),
) -> DataFrame:
    """Forecast and observation pairs with ``|Δvalid_at| <= seconds``, many to many.

    Forecasts are listed under the time bucket of their validity and its two neighbours;
    an observation is listed once, so each pair meets exactly once.
    Observation columns are ``observation_file_key`` and ``observation_valid_at`` (plus
    ``observation_n_rows`` / ``observation_n_cols`` where the catalog has them).
    """
    micros = seconds * 1_000_000
    width = max(micros, 1)
    bucket = F.floor(F.unix_micros("valid_at") / width)
    left = nowcasts.withColumn(
        "_bucket", F.explode(F.array(*[bucket + d for d in (-1, 0, 1)]))
    )
    shape = [F.col(c).alias(f"observation_{c}") for c in ("n_rows", "n_cols") if c in observations.columns]
    right = observations.select(
        *by,
        F.col("file_key").alias("observation_file_key"),
        F.col("valid_at").alias("observation_valid_at"),
        *shape,
        bucket.alias("_bucket"),
    )
    gap = F.abs(F.unix_micros("valid_at") - F.unix_micros("observation_valid_at"))
    return left.join(right, [*by, "_bucket"]).where(gap <= micros).drop("_bucket")


def same_shape(pairs: DataFrame) -> DataFrame:
    """Pairs whose grids have equal dimensions; the others cannot be scored."""
    return pairs.where(
        (F.col("n_rows") == F.col("observation_n_rows")) & (F.col("n_cols") == F.col("observation_n_cols"))
    )


def align_cells(forecast: DataFrame, observation: DataFrame) -> DataFrame:
    """Cells of a forecast and an observation on the same ``pair_id``, row and column.

    Both sides are cell tables; the block form used by the verification job is in ``verify``.
    """
    right = observation.select("pair_id", "row_i", "col_i", F.col("value").alias("observed"))
    left = forecast.select("pair_id", "row_i", "col_i", F.col("value").alias("forecast"))
    return left.join(right, ["pair_id", "row_i", "col_i"])


#: How often a cover square may be cut in four, and the least points for which one is.
COVER_DEPTH = 6
LEAST_POINTS = 4096


@dataclass(frozen=True)
class Cover:
    """Squares of ``degrees``, cut in four where points are many; ``parts`` has the parts that the fullest last squares are dealt to.

    Every cut square, and every square dealt to parts, holds more than ``most`` points, so there
    are at most ``COVER_DEPTH`` times as many of them as ``most`` goes into the points.
    """

    degrees: float
    cut: frozenset[int]
    parts: dict[int, int]

    def side(self, depth: int) -> float:
        return self.degrees / 2**depth

    def key(self, x: Column, y: Column, depth: int | Column) -> Column:
        """A square's number, from its column, row and depth."""
        return ((x.cast("long") + F.lit(1 << 27)) * F.lit(1 << 28) + y.cast("long") + F.lit(1 << 27)) * F.lit(8) + depth

    def at(self, lng: Column, lat: Column, depth: int) -> Column:
        return self.key(F.floor(lng / self.side(depth)), F.floor(lat / self.side(depth)), depth)

    def is_cut(self, key: Column) -> Column:
        return key.isin(*self.cut) if self.cut else F.lit(False)

    def square(self, lng: Column, lat: Column) -> Column:
        """The uncut square of a point."""
        out = self.at(lng, lat, COVER_DEPTH)
        for depth in reversed(range(COVER_DEPTH)):
            key = self.at(lng, lat, depth)
            out = F.when(self.is_cut(key), out).otherwise(key)
        return out

    def dealt(self, key: Column) -> Column:
        """How many parts a square's points are dealt to."""
        out = F.lit(1)
        for n in sorted(set(self.parts.values())):
            out = F.when(key.isin(*[k for k, m in self.parts.items() if m == n]), n).otherwise(out)
        return out


def measured_cover(points: DataFrame, lng: Column, lat: Column, degrees: float = COVER_DEGREES, most: int | None = None) -> Cover:
    """A cover whose squares hold about ``most`` points (a quarter of a shuffle partition's share), from counts of all points."""
    whole = Cover(degrees, frozenset(), {})
    last = [F.floor(v / whole.side(COVER_DEPTH)).alias(n) for v, n in ((lng, "x"), (lat, "y"))]
    counts = points.select(*last).groupBy("x", "y").agg(F.count("*").alias("n")).persist()
    if most is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
        most = max(LEAST_POINTS, total // (4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut: set[int] = set()
    for depth in range(COVER_DEPTH):
        up = 2 ** (COVER_DEPTH - depth)
        key = whole.key(F.floor(F.col("x") / up), F.floor(F.col("y") / up), depth)
        full = counts.groupBy(key.alias("k")).agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
        cut |= {r["k"] for r in full}
        if not full:
            break
    heavy = counts.where(F.col("n") > most).select(whole.key(F.col("x"), F.col("y"), COVER_DEPTH).alias("k"), "n").collect()
    counts.unpersist()
    # Powers of two, so that few numbers of parts occur.
    return Cover(degrees, frozenset(cut), {r["k"]: 1 << (-(-r["n"] // most) - 1).bit_length() for r in heavy})


def _rim_meets(edges: str, left: Column, bottom: Column, side: float) -> Column:
    """Whether the bounds of any edge touch a square."""

    def touches(e: Column) -> Column:
        across = (F.greatest(e["p"]["lng"], e["q"]["lng"]) >= left) & (F.least(e["p"]["lng"], e["q"]["lng"]) <= left + side)
        return across & (F.greatest(e["p"]["lat"], e["q"]["lat"]) >= bottom) & (F.least(e["p"]["lat"], e["q"]["lat"]) <= bottom + side)

    return F.exists(edges, lambda part: F.exists(part, touches))


def _cover_polygons(polygons: DataFrame, cover: Cover) -> DataFrame:
    """Polygons under the uncut squares they meet; ``_inside`` where a square needs no edge test.

    A square that no edge's bounds touch lies wholly inside or outside, which its corner tells.
    """
    rows = polygons.where(F.col("parts").isNotNull() & F.col("min_lng").isNotNull()).withColumn("_edges", parts_edges(F.col("parts")))

    def squares(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cover.degrees), F.floor(F.col(high) / cover.degrees)))

    rows = rows.withColumn("_x", squares("min_lng", "max_lng")).withColumn("_y", squares("min_lat", "max_lat")).withColumn("_inside", F.lit(False))
    found: DataFrame | None = None
    for depth in range(COVER_DEPTH + 1):
        side = cover.side(depth)
        left, bottom = F.col("_x") * side, F.col("_y") * side

        rim = ~F.col("_inside") & _rim_meets("_edges", left, bottom, side)
        within = F.col("_inside") | edges_contain_point(F.col("_edges"), left, bottom)
        rows = rows.withColumn("_rim", rim).where(F.col("_rim") | within).withColumn("_inside", ~F.col("_rim")).drop("_rim")
        rows = rows.withColumn("_square", cover.key(F.col("_x"), F.col("_y"), depth))
        uncut = rows.where(~cover.is_cut(F.col("_square"))) if depth < COVER_DEPTH else rows
        found = uncut if found is None else found.unionByName(uncut)
        if depth == COVER_DEPTH or not any(k % 8 == depth for k in cover.cut):
            break
        quarters = F.explode(F.array(*[F.struct((F.col("_x") * 2 + i).alias("x"), (F.col("_y") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)]))
        rows = rows.where(cover.is_cut(F.col("_square"))).withColumn("_q", quarters)
        rows = rows.withColumns({"_x": F.col("_q.x"), "_y": F.col("_q.y")}).drop("_q", "_square")
    return found.drop("_x", "_y")


#: Points of one square that meet a polygon together, and edges that are tested at once.
POINTS_TOGETHER, EDGES_TOGETHER = 64, 1 << 20


def _hits(edges: pa.Array, lngs: pa.Array, lats: pa.Array, west: pa.Array, south: pa.Array, east: pa.Array, north: pa.Array) -> pa.Array:
    """Per polygon and pack of points: the places in the pack of the points inside, boundary included; null for no pack.

    All pairs of a batch are tested together, first by bounds and then edge by edge; an edge without
    a coordinate counts for nothing.
    """
    per_pack = lngs.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(lngs)), per_pack)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_pack) - per_pack, per_pack)
    x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in (lngs, lats))
    w, s, e, n = (v.to_numpy(zero_copy_only=False)[row] for v in (west, south, east, north))
    kept = np.flatnonzero((x >= w) & (x <= e) & (y >= s) & (y <= n))
    row, place, x, y = row[kept], place[kept], x[kept], y[kept]
    parts = edges.flatten()
    rings = parts.flatten()
    p, q = rings.field("p"), rings.field("q")
    px, py, qx, qy = (v.field(c).to_numpy(zero_copy_only=False) for v in (p, q) for c in ("lng", "lat"))
    edges_of = parts.value_lengths().fill_null(0).to_numpy()
    part = np.repeat(np.arange(len(parts)), edges_of)
    parts_of = edges.value_lengths().fill_null(0).to_numpy()
    first = np.concatenate([[0], np.cumsum(edges_of)])[np.concatenate([[0], np.cumsum(parts_of)])]
    tests = np.diff(first)[row]
    so_far = np.cumsum(tests)
    found = np.zeros(len(row), bool)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(so_far, so_far[at] - tests[at] + EDGES_TOGETHER, "right")))
        many = tests[at:end]
        pair = np.repeat(np.arange(at, end), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[row[at:end]], many)
        ax, ay, bx, by, u, v = px[k], py[k], qx[k], qy[k], x[pair], y[pair]
        crosses = (ay > v) != (by > v)
        c = np.flatnonzero(crosses)
        crosses[c] = (bx[c] - ax[c]) * (v[c] - ay[c]) / (by[c] - ay[c]) + ax[c] > u[c]
        near = (u >= np.minimum(ax, bx)) & (u <= np.maximum(ax, bx)) & (v >= np.minimum(ay, by)) & (v <= np.maximum(ay, by))
        c = np.flatnonzero(near)
        found[pair[c[(bx[c] - ax[c]) * (v[c] - ay[c]) - (by[c] - ay[c]) * (u[c] - ax[c]) == 0.0]]] = True
        if len(pair):
            start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (part[k[1:]] != part[k[:-1]])]))
            found[pair[start[np.logical_xor.reduceat(crosses, start)]]] = True
        at = end
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=len(lngs)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[found].astype(np.int32)), mask=lngs.is_null())


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    lng: str = "longitude",
    lat: str = "latitude",
    cover: Cover | None = None,
) -> DataFrame:
    """Point and polygon pairs, boundary included; missing coordinates or geometry never match.

    A polygon is listed under every square of ``cover`` that it meets, a point under its own, so a pair
    meets once.  Without a cover, one is measured on the points: squares with many points are cut in
    four, again and again, and what is still too full at the last depth is dealt to parts.  A polygon
    meets the points of a square a pack at a time, and packs of squares that need an edge test are
    tested as arrays.
    """
    located = points.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())
    if cover is None:
        cover = measured_cover(located, F.col(lng), F.col(lat))
    covered = _cover_polygons(polygons, cover)
    placed = located.select(F.struct(*points.columns).alias("_point"), cover.square(F.col(lng), F.col(lat)).alias("_square"))
    if cover.parts:
        # Equal rows are told apart, or a part could hold any number of them.
        dealt = F.xxhash64("_point", F.monotonically_increasing_id())
        placed = placed.withColumn("_deal", F.pmod(dealt, cover.dealt(F.col("_square")).cast("long")))
        covered = covered.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), cover.dealt(F.col("_square")).cast("long") - 1)))
    on = ["_square", *(["_deal"] if cover.parts else [])]
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(POINTS_TOGETHER))
    packs = placed.groupBy(*on).agg(F.collect_list("_point").alias("_all")).select(
        *on, F.explode(F.transform(starts, lambda i: F.slice("_all", i, POINTS_TOGETHER))).alias("_points")
    )
    met = packs.join(covered, on).drop(*on)
    tested = [F.when(~F.col("_inside"), c) for c in (F.col("_edges"), F.col("_points")[lng].cast("array<double>"), F.col("_points")[lat].cast("array<double>"))]
    hits = F.arrow_udf(_hits, "array<int>")(*tested, *[F.col(c).cast("double") for c in ("min_lng", "min_lat", "max_lng", "max_lat")])
    every = F.sequence(F.lit(0), F.size("_points") - 1)
    at = F.explode(F.when(F.col("_inside"), every).otherwise(F.col("_hits"))).alias("_at")
    found = met.withColumn("_hits", hits).select("_points", *polygons.columns, at).withColumn("_point", F.get("_points", F.col("_at")))
    return found.select(*[F.col("_point")[c].alias(c) for c in points.columns], *polygons.columns)


def due_rules(rules: DataFrame, subscriptions: DataFrame | None = None) -> DataFrame:
    """Active rules, with their active subscription if given, beside the product and level of their grids."""
    active = rules.where(F.col("status") == "active").select(
        "rule_id", "subscription_id", "config", F.col("config.product").alias("product"), F.col("config.level").alias("level")
    )
    if subscriptions is None:
        return active
    live = subscriptions.where(F.col("status") == "active").select(F.col("id").alias("subscription_id"))
    return active.join(live, "subscription_id", "left_semi")


def rules_for_grids(rules: DataFrame, grids: DataFrame, subscriptions: DataFrame | None = None) -> DataFrame:
    """Active rules on the grids of their product and level, with their active subscription if given."""
    return spread_join(grids, due_rules(rules, subscriptions), ["product", "level"], by=["file_key"])


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every event with each active subscription that opted in to its type.

    ``events`` has ``event_type``; the result adds ``subscription_id``.
    """
    wanted = (
        subscriptions.where(F.col("status") == "active")
        .select(F.col("id").alias("subscription_id"), F.explode(F.array_distinct("events")).alias("event_type"))
    )
    return spread_join(events, wanted, ["event_type"])


def cascade(
    doomed: DataFrame, grids: DataFrame, nowcasts: DataFrame, verifications: DataFrame
) -> dict[str, DataFrame]:
    """Rows that fall with the files in ``doomed`` (``file_key``).

    A verification falls with its nowcast or with its observation.
    """
    keys = doomed.select("file_key").distinct()
    lost_grids = grids.join(keys, "file_key", "left_semi")
    lost_nowcasts = nowcasts.join(keys.withColumnRenamed("file_key", "source_file_key"), "source_file_key", "left_semi")
    by_nowcast = verifications.join(lost_nowcasts.select("nowcast_id"), "nowcast_id", "left_semi")
    by_observation = verifications.join(
        keys.withColumnRenamed("file_key", "observation_file_key"), "observation_file_key", "left_semi"
    )
    lost = by_nowcast.select("nowcast_id", "observation_file_key").union(
        by_observation.select("nowcast_id", "observation_file_key")
    )
    lost_verifications = verifications.join(lost.distinct(), ["nowcast_id", "observation_file_key"], "left_semi")
    return {"grids": lost_grids, "nowcasts": lost_nowcasts, "verifications": lost_verifications}
