"""Motion between frames by block matching on a pyramid of means, without a fixed reach.

A block is first matched among means over squares of 8, 4 and then 2 cells, as far as it keeps four
of them a side, and last among cells.  The first level looks three of its cells around, each finer
one starts where the coarser one ended and looks one around; while the best shift lies on the rim of
the window, the window grows by one.  A task sees
the rectangle that the window may come from, cut out of the earlier frames' blocks; only blocks whose
window outgrows it are searched again, in a rectangle twice as wide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.operators.catalog import frame_history
from stormframe.operators.grid import BLOCK_ID, lay_rectangles
from stormframe.operators.ordering import DEFAULT_CHUNK_SECONDS
from stormframe.session import scratch_folder

#: Sides of the squares whose means are matched, coarse to fine.
FACTORS = (8, 4, 2, 1)
#: Means a side that a block needs on a level.
LEAST_SIDE = 4
#: How far a block's first window goes around standing still, in cells of its first level.
FIRST_WINDOW = 3
#: How far around its start a window may grow before more of the earlier frames is fetched.
FIRST_REACH = 4
#: Cells and tried shifts that a task holds at once, for as many blocks as have so many.
MOST_CELLS = 1 << 20
#: Digits of summed squares below which two shifts count as equally good.
DIGITS = 6

_PLACE = ("row0", "col0", "height", "width")
_SHAPE = ("n_rows", "n_cols", "block_height", "block_width")
_KEY = ("source_file_key", "block_row", "block_col")


def _means(values: np.ndarray, factor: int) -> np.ndarray:
    """Means over squares of ``factor`` cells of many equal blocks; squares on the rim may be cut."""
    n, height, width = values.shape
    pad = ((0, 0), (0, -height % factor), (0, -width % factor))
    padded = np.pad(values, pad, constant_values=np.nan)
    squares = padded.reshape(n, padded.shape[1] // factor, factor, padded.shape[2] // factor, factor)
    return np.nanmean(squares, axis=(2, 4))


def coarse_blocks(blocks: DataFrame, factor: int) -> DataFrame:
    """``blocks`` (BLOCK_ID, place, values) at a level of the pyramid, their place in units of ``factor`` cells."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            offsets = values.offsets.to_numpy() - values.offsets[0].as_py()
            cells = values.flatten().to_numpy(zero_copy_only=False)
            place = {c: batch.column(c).to_numpy() for c in _PLACE}
            sides = np.stack([place["height"], place["width"]], axis=1)
            means: list[np.ndarray] = [np.zeros(0)] * len(batch)
            for h, w in np.unique(sides, axis=0):
                rows = np.flatnonzero((sides == (h, w)).all(axis=1))
                stack = cells[offsets[rows][:, None] + np.arange(h * w)].reshape(len(rows), h, w)
                for i, mean in zip(rows, _means(stack, factor), strict=True):
                    means[i] = mean.ravel()
            columns = [batch.column(c) for c in BLOCK_ID] + [pa.array(-(-place[c] // factor), pa.int32()) for c in _PLACE]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(means, pa.list_(pa.float64()))], names=batch.schema.names)

    rows = blocks.select(*BLOCK_ID, *_PLACE, "values")
    return rows if factor == 1 else rows.mapInArrow(shrink, rows.schema)


class _Search:
    """Shifts of many blocks tried in one level, over all frame steps of their sources."""

    def __init__(self, place: pa.StructArray, strips: pa.ListArray, steps: int, reach: int) -> None:
        self.p = {f.name: place.field(f.name).to_numpy(zero_copy_only=False).astype(np.int64) for f in place.type}
        self.steps, self.reach = steps, reach
        n = len(place)
        pieces, row = strips.flatten(), np.repeat(np.arange(n), strips.value_lengths().to_numpy())
        rectangle = row * steps + pieces.field("step").to_numpy()
        now = pieces.field("now").to_numpy(zero_copy_only=False).astype(bool)

        def laid(mine: np.ndarray, *sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return lay_rectangles(pieces.filter(pa.array(mine)), rectangle[mine], *(np.repeat(s, steps) for s in sides))

        p = self.p
        self.now, self.now_at = laid(now, p["row0"], p["col0"], p["height"], p["width"])
        self.before, self.before_at = laid(~now, p["top"], p["left"], p["bottom"] - p["top"], p["right"] - p["left"])
        self.first = np.where(p["begun"] > 0, 1, FIRST_WINDOW)

    def _errors(self, rows: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Squared differences of equally large blocks and where each shift, counted from their centres, has them come from.

        Past the rim the edge is repeated.
        """
        p = {c: v[rows] for c, v in self.p.items()}
        height, width = int(p["height"][0]), int(p["width"][0])
        frame = rows[:, None] * self.steps + np.arange(self.steps)
        now = self.now[self.now_at[frame][:, :, None] + np.arange(height * width)]
        before_at = self.before_at[frame][:, :, None]
        across = (p["right"] - p["left"])[:, None]

        def line(axis: str, length: int, by: int, first: str) -> np.ndarray:
            cells = p[f"{axis}0"][:, None] + np.arange(length) - (p[f"c_{axis}"] + by)[:, None]
            return np.clip(cells, 0, p[f"n_{axis}s"][:, None] - 1) - p[first][:, None]

        r = {by: line("row", height, by, "top") * across for by in np.unique(shifts[:, 0]).tolist()}
        c = {by: line("col", width, by, "left") for by in np.unique(shifts[:, 1]).tolist()}
        out = np.empty((len(rows), len(shifts)))
        for k, (a, b) in enumerate(shifts.tolist()):
            cells = (r[a][:, :, None] + c[b][:, None, :]).reshape(len(rows), 1, -1)
            out[:, k] = ((now - self.before[before_at + cells]) ** 2).sum(axis=2).sum(axis=1)
        return np.round(out, DIGITS)

    def _best_of(self, rows: np.ndarray, radius: int) -> np.ndarray:
        """(shift of rows, of columns, whether the search left the rectangle) of equally large blocks that begin alike."""
        reach, side = self.reach, 2 * self.reach + 1
        p = {c: self.p[c][rows] for c in ("c_row", "c_col", "n_rows", "n_cols")}
        around = np.arange(-reach, reach + 1)
        dr, dc = (np.broadcast_to(x, (len(rows), side, side)) for x in ((p["c_row"][:, None] + around)[:, :, None], (p["c_col"][:, None] + around)[:, None, :]))
        most_r, most_c = p["n_rows"] - 1, p["n_cols"] - 1
        allowed = (np.abs(dr) <= most_r[:, None, None]) & (np.abs(dc) <= most_c[:, None, None])
        far = np.maximum(np.abs(around)[:, None], np.abs(around)[None, :])
        errors = np.full((len(rows), side, side), np.inf)
        out = np.empty((len(rows), 3), np.int64)
        going, tried = np.arange(len(rows)), -1
        while len(going):
            new = np.argwhere((far > tried) & (far <= radius))
            errors[going[:, None], new[:, 0], new[:, 1]] = self._errors(rows[going], new - reach)
            tried = radius
            window = slice(reach - radius, reach + radius + 1)
            r, c, ok, e = (x[going, window, window].reshape(len(going), -1) for x in (dr, dc, allowed, errors))
            first = np.argmax(ok, axis=1)
            each = np.arange(len(going))
            unknown = np.isnan(e[each, first])
            e = np.where(ok & ~np.isnan(e), e, np.inf)
            tied = e == e.min(axis=1, keepdims=True)
            length = np.where(tied & ok, r**2 + c**2, np.iinfo(np.int64).max)
            # Of the shortest, the first is the least; a window that begins with a missing cell stays there.
            pick = np.where(unknown, first, np.argmin(length, axis=1))
            r, c = r[each, pick], c[each, pick]
            r0, c0, most = p["c_row"][going], p["c_col"][going], (most_r[going], most_c[going])
            whole = (r0 - radius <= -most[0]) & (r0 + radius >= most[0]) & (c0 - radius <= -most[1]) & (c0 + radius >= most[1])
            settled = whole | (np.maximum(np.abs(r - r0), np.abs(c - c0)) < radius)
            ended = settled | (radius == reach)
            out[going[ended]] = np.stack([r, c, ~settled], axis=1)[ended]
            going = going[~ended]
            radius += 1
        return out

    def best(self) -> np.ndarray:
        """Per block the shift of least error in the first window that holds it inside, and whether the search left the rectangle."""
        out = np.zeros((len(self.first), 3), np.int64)
        kinds = np.stack([self.p["height"], self.p["width"], self.first], axis=1)
        for height, width, radius in np.unique(kinds, axis=0).tolist():
            rows = np.flatnonzero((kinds == (height, width, radius)).all(axis=1))
            size = max(1, MOST_CELLS // max(height * width * self.steps, (2 * self.reach + 1) ** 2))
            for some in np.split(rows, range(size, len(rows), size)):
                out[some] = self._best_of(some, radius)
        return out


def _searched(asked: DataFrame, steps: DataFrame, level: DataFrame, factor: int, lookback: int, reach: int) -> DataFrame:
    """``asked`` with the shift found on a level in ``d_row``, ``d_col`` (cells), and ``wider`` where the rectangle was too small."""
    units = {c: F.ceil(F.col(c) / factor).cast("int") for c in (*_PLACE, "n_rows", "n_cols")}
    unit_block = {c: (F.col(c) / factor).cast("int") for c in ("block_height", "block_width")}
    centre = {f"c_{a}": F.rint(F.col(f"d_{a}") / factor).cast("int") for a in ("row", "col")}
    place = asked.select(*_KEY, "begun", *[c.alias(n) for n, c in {**units, **unit_block, **centre}.items()])

    def edge(start: str, shift: str, n: str, length: str | None) -> Column:
        first = F.col(start) - F.col(shift) - reach
        if length is None:
            return F.least(F.greatest(first, F.lit(0)), F.col(n) - 1)
        return F.least(F.greatest(first + F.col(length) + 2 * reach, F.lit(1)), F.col(n))

    place = place.withColumns(
        {
            "top": edge("row0", "c_row", "n_rows", None),
            "bottom": edge("row0", "c_row", "n_rows", "height"),
            "left": edge("col0", "c_col", "n_cols", None),
            "right": edge("col0", "c_col", "n_cols", "width"),
        }
    )
    moves = place.join(steps, "source_file_key")

    def touched(low: str, high: str, block: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / F.col(block)).cast("int"), F.floor((F.col(high) - 1) / F.col(block)).cast("int")))

    names = ("file_key", "block_row", "block_col", *_PLACE, "values")
    sources = level.select(*[F.col(c).alias(f"_{c}") for c in names])
    reads = moves.withColumn("_block_row", touched("top", "bottom", "block_height")).withColumn("_block_col", touched("left", "right", "block_width"))
    first_row, last_row = F.greatest("top", "_row0"), F.least(F.col("bottom"), F.col("_row0") + F.col("_height"))
    first_col, last_col = F.greatest("left", "_col0"), F.least(F.col("right"), F.col("_col0") + F.col("_width"))
    cut = F.flatten(
        F.transform(
            F.sequence(first_row, last_row - 1),
            lambda r: F.slice("_values", (r - F.col("_row0")) * F.col("_width") + first_col - F.col("_col0") + 1, last_col - first_col),
        )
    )

    def strip(now: bool, top: Column, left: Column, width: Column, cells: Column) -> Column:
        parts = {"step": F.col("step"), "now": F.lit(now), "top": top.cast("int"), "left": left.cast("int"), "width": width.cast("int")}
        return F.struct(*[c.alias(n) for n, c in parts.items()], cells.alias("cells")).alias("_strip")

    earlier = reads.withColumn("_file_key", F.col("earlier")).join(sources, ["_file_key", "_block_row", "_block_col"])
    earlier = earlier.select(*_KEY, strip(False, first_row, first_col, last_col - first_col, cut))
    own = [F.col(f"_{c}") == F.col(c) for c in ("block_row", "block_col")]
    later = moves.join(sources, [F.col("later") == F.col("_file_key"), *own])
    later = later.select(*_KEY, strip(True, F.col("row0"), F.col("col0"), F.col("width"), F.col("_values")))
    gathered = earlier.unionByName(later).groupBy(*_KEY).agg(F.collect_list("_strip").alias("_strips"))

    @F.arrow_udf("struct<d_row int, d_col int, wider boolean>")
    def search(strips: pa.Array, places: pa.Array) -> pa.Array:
        found = _Search(places, strips, lookback - 1, reach).best()
        columns = [pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1], pa.int32()), pa.array(found[:, 2] > 0)]
        return pa.StructArray.from_arrays(columns, ["d_row", "d_col", "wider"])

    inside = [c for c in place.columns if c not in _KEY]
    met = gathered.join(place.select(*_KEY, F.struct(*inside).alias("_place")), list(_KEY))
    best = met.select(*_KEY, search("_strips", "_place").alias("_m"))
    kept = [c for c in asked.columns if c not in (*_KEY, "d_row", "d_col", "begun", "wider")]
    moved = [(F.col(f"_m.d_{a}") * factor).alias(f"d_{a}") for a in ("row", "col")]
    return asked.select(*_KEY, *kept).join(best, list(_KEY)).select(*_KEY, *kept, *moved, F.lit(True).alias("begun"), F.col("_m.wider").alias("wider"))


def block_motion(
    grids: DataFrame,
    blocks: DataFrame,
    lookback: int,
    prepared: Column,
    factors: Sequence[int] = FACTORS,
    first_reach: int = FIRST_REACH,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Cells moved per frame step (``d_row``, ``d_col``) of each block of a frame with ``lookback - 1`` frames of equal shape before it.

    ``prepared`` is the array of cells to compare, without missing ones.  Shifts are within the
    frame; equally good ones go to the shortest, then the least.
    """
    spark = grids.sparkSession
    folder = scratch_folder(spark, "motion")
    history = frame_history(grids, lookback, chunk_seconds=chunk_seconds)
    alike = F.forall("history", lambda f: (f["n_rows"] == F.col("n_rows")) & (f["n_cols"] == F.col("n_cols")))
    sources = history.where((F.size("history") == lookback) & alike)
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(lookback - 2)),
        lambda i: F.struct(i.alias("step"), F.get("history", i)["file_key"].alias("earlier"), F.get("history", i + 1)["file_key"].alias("later")),
    )
    steps = sources.select(F.col("file_key").alias("source_file_key"), F.explode(pairs).alias("_p")).select("source_file_key", "_p.*")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    steps = stored(steps, "steps")
    floored = blocks.select(*BLOCK_ID, *_PLACE, prepared.alias("values"))
    asked = (
        sources.select("file_key", *_SHAPE)
        .join(floored.select(*BLOCK_ID, *_PLACE), "file_key")
        .withColumnRenamed("file_key", "source_file_key")
        .select(*_KEY, *_PLACE, *_SHAPE, F.lit(0).alias("d_row"), F.lit(0).alias("d_col"), F.lit(False).alias("begun"))
    )
    smallest = F.least("block_height", "block_width")
    for factor in factors:
        fits = (F.col("block_height") % factor == 0) & (F.col("block_width") % factor == 0) & (smallest >= factor * LEAST_SIDE) | F.lit(factor == 1)
        waiting, done, reach = asked.where(fits), asked.where(~fits), first_reach
        if waiting.isEmpty():
            continue
        level = coarse_blocks(floored, factor)
        if factor > 1:
            # Read once more per step and round, and far smaller than the blocks.
            level = stored(level, f"means-{factor}")
        while True:
            found = stored(_searched(waiting, steps, level, factor, lookback, reach), f"level-{factor}-{reach}")
            done = done.unionByName(found.where("NOT wider").select(*asked.columns))
            waiting = found.where("wider").drop("wider")
            if waiting.isEmpty():
                break
            # Start again from where the level began, not from the rim.
            begin = asked.select(*_KEY, "d_row", "d_col", "begun")
            waiting = waiting.drop("d_row", "d_col", "begun").join(begin, list(_KEY)).select(*asked.columns)
            reach *= 2
        asked = done
    return asked.select(*_KEY, "d_row", "d_col")
