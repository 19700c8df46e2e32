"""Nowcasts: persistence, lagged ensemble, advection, and the plug-in interface.

A nowcast row names its field by reference where it can: ``members`` lists the source files
whose grids, unchanged, are the ensemble members (one entry means deterministic).  Blocks are
only copied by ``advection_blocks`` and by user forecasters, which make new values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.values import finite
from stormframe.operators import motion
from stormframe.operators.catalog import frame_history
from stormframe.operators.grid import BLOCK_ID, lay_pieces
from stormframe.operators.ordering import DEFAULT_CHUNK_SECONDS

# Lead times in minutes, ensemble size, motion settings.
HORIZONS = (10, 30, 60)
ENSEMBLE_SIZE = 8
LOOKBACK = 3
STEP_MINUTES = 2.0
FLOOR_DBZ = 5.0
FLOOR_SLACK = 1e-6

PERSISTENCE, LAGGED, ADVECTION = "persistence", "lagged-ensemble", "advection"


class Forecaster(Protocol):
    """A forecasting method: frames in, nowcast rows out."""

    algorithm: str
    history_depth: int

    def forecast(self, grids: DataFrame, horizons: Sequence[int]) -> DataFrame: ...


def forecast_key(algorithm: Column | str, source: Column) -> Column:
    """Identity of a field shared by all lead times of a source frame."""
    name = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    return F.sha2(F.concat_ws("|", name, source), 256)


def nowcast_id(algorithm: Column, source: Column, horizon: Column) -> Column:
    return F.sha2(F.concat_ws("|", algorithm, source, horizon.cast("string")), 256)


def _issue(frames: DataFrame, algorithm: str, horizons: Sequence[int], ensemble: bool) -> DataFrame:
    """One row per frame and lead time."""
    if any(h <= 0 for h in horizons):
        raise ValueError("lead times must be positive")
    rows = frames.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    return rows.select(
        nowcast_id(F.lit(algorithm), F.col("file_key"), F.col("horizon")).alias("nowcast_id"),
        forecast_key(algorithm, F.col("file_key")).alias("forecast_key"),
        F.col("file_key").alias("source_file_key"),
        "product",
        "level",
        F.lit(algorithm).alias("algorithm"),
        "horizon",
        (F.col("valid_at") + F.make_dt_interval(mins=F.col("horizon"))).alias("valid_at"),
        "n_rows",
        "n_cols",
        "members",
        (F.size("members") if ensemble else F.lit(None)).cast("int").alias("ensemble_size"),
    )


def persistence(grids: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Each frame carried unchanged to every lead time."""
    return _issue(grids.withColumn("members", F.array("file_key")), PERSISTENCE, horizons, ensemble=False)


def lagged_ensemble(
    grids: DataFrame,
    size: int = ENSEMBLE_SIZE,
    horizons: Sequence[int] = HORIZONS,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Members are the frame and up to ``size - 1`` before it, oldest first.

    Thin history gives fewer members; a frame of another shape in it leaves only the current one.
    """
    if size < 1:
        raise ValueError("an ensemble needs at least one member")
    return ensemble_of_history(frame_history(grids, size, chunk_seconds=chunk_seconds), horizons)


def ensemble_of_history(frames: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """The lagged ensemble of frames that carry their ``history`` already, oldest first."""
    alike = F.forall("history", lambda f: (f["n_rows"] == F.col("n_rows")) & (f["n_cols"] == F.col("n_cols")))
    members = F.when(alike, F.transform("history", lambda f: f["file_key"])).otherwise(F.array("file_key"))
    return _issue(frames.withColumn("members", members), LAGGED, horizons, ensemble=True)


# --- member stacks -----------------------------------------------------------------------


def member_blocks(nowcasts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``members``, arrays of cells, per forecast_key and block, oldest member first.

    A field is stacked once however many lead times use it.  Single-member fields need no
    grouping; a stack gathers one entry per member.
    """
    fields = nowcasts.select("forecast_key", "members").dropDuplicates(["forecast_key"])
    packed = blocks.select(*BLOCK_ID, F.col("values").alias("_v"))
    # A frame's blocks are many: rows learn the places first and meet the cells block by block.
    places = blocks.select(*BLOCK_ID)
    single = (
        fields.where(F.size("members") == 1)
        .select("forecast_key", F.col("members")[0].alias("file_key"))
        .join(places, "file_key")
        .join(packed, list(BLOCK_ID))
        .select("forecast_key", "block_row", "block_col", F.array("_v").alias("members"))
    )
    several = (
        fields.where(F.size("members") > 1)
        .select("forecast_key", F.posexplode("members").alias("_pos", "file_key"))
        .join(places, "file_key")
        .join(packed, list(BLOCK_ID))
        .groupBy("forecast_key", "block_row", "block_col")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_v"))).alias("_stack"))
        .select("forecast_key", "block_row", "block_col", F.transform("_stack", lambda e: e["_v"]).alias("members"))
    )
    return single.unionByName(several)


# --- advection ------------------------------------------------------------------------------


def with_floor(value: Column, floor: float = FLOOR_DBZ) -> Column:
    """Missing and weak cells become the floor before motion is measured."""
    return F.when(finite(value) & (value >= floor), value).otherwise(F.lit(floor))


def without_floor(value: Column, floor: float = FLOOR_DBZ) -> Column:
    """Cells at the floor become missing again in the forecast."""
    return F.when(F.isnan(value) | (value <= floor + FLOOR_SLACK), F.lit(float("nan"))).otherwise(value)


def lead_steps(horizon: Column, step_minutes: float = STEP_MINUTES) -> Column:
    return F.greatest(F.lit(1), F.bround(horizon / F.lit(step_minutes)).cast("int"))


def block_motion(
    grids: DataFrame, blocks: DataFrame, lookback: int = LOOKBACK, chunk_seconds: int = DEFAULT_CHUNK_SECONDS
) -> DataFrame:
    """Cells moved per frame step (``d_row``, ``d_col``) of each block over the last ``lookback`` frames, as far as they went.

    Only frames with a full history of equal shape appear.
    """
    cells = F.transform("values", lambda v: with_floor(v.cast("double")))
    return motion.block_motion(grids, blocks, lookback, cells, chunk_seconds=chunk_seconds)


def advection(grids: DataFrame, moved: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Nowcast rows: advected where motion is known, else carried like persistence.

    Advected rows have a ``forecast_key`` of their own per lead time and no ``members``.
    """
    moving = moved.select(F.col("source_file_key").alias("file_key")).distinct().withColumn("_moving", F.lit(True))
    rows = _issue(grids.withColumn("members", F.array("file_key")), ADVECTION, horizons, ensemble=False)
    known = rows.join(moving.withColumnRenamed("file_key", "source_file_key"), "source_file_key", "left")
    is_moving = F.coalesce("_moving", F.lit(False))
    return known.select(
        "nowcast_id",
        F.when(is_moving, F.col("nowcast_id")).otherwise(F.col("forecast_key")).alias("forecast_key"),
        *[c for c in rows.columns if c not in ("nowcast_id", "forecast_key", "members")],
        F.when(~is_moving, F.col("members")).alias("members"),
    )


def advection_blocks(
    nowcasts: DataFrame, moved: DataFrame, grids: DataFrame, blocks: DataFrame, step_minutes: float = STEP_MINUTES
) -> DataFrame:
    """Blocks of the advected nowcasts: every cell comes from where its block's motion says it was.

    A destination block reads a rectangle of the source frame moved upstream; it lies over a
    few source blocks, whose cells are sent to it.  Cells from outside the frame are missing.
    """
    shape = grids.select(F.col("file_key").alias("source_file_key"), "block_height", "block_width")
    moving = nowcasts.where(F.col("members").isNull()).select(
        "forecast_key", "source_file_key", lead_steps(F.col("horizon"), step_minutes).alias("_steps")
    )
    own = ("row0", "col0", "height", "width")
    places = blocks.select(F.col("file_key").alias("source_file_key"), "block_row", "block_col", *own)
    wanted = (
        moving.join(moved, "source_file_key")
        .join(places, ["source_file_key", "block_row", "block_col"])
        .join(shape, "source_file_key")
        .withColumn("_top", F.col("row0") - F.col("_steps") * F.col("d_row"))
        .withColumn("_left", F.col("col0") - F.col("_steps") * F.col("d_col"))
    )
    first_row, last_row = (
        F.floor(v / F.col("block_height")).cast("int") for v in (F.col("_top"), F.col("_top") + F.col("height") - 1)
    )
    first_col, last_col = (
        F.floor(v / F.col("block_width")).cast("int") for v in (F.col("_left"), F.col("_left") + F.col("width") - 1)
    )
    reads = wanted.withColumn("_from_row", F.explode(F.sequence(first_row, last_row))).withColumn(
        "_from_col", F.explode(F.sequence(first_col, last_col))
    )
    source = blocks.select(
        F.col("file_key").alias("source_file_key"),
        F.col("block_row").alias("_from_row"),
        F.col("block_col").alias("_from_col"),
        F.struct(
            F.col("row0").alias("top"),
            F.col("col0").alias("left"),
            "width",
            F.transform("values", lambda v: with_floor(v.cast("double"))).alias("cells"),
        ).alias("_piece"),
    )
    # A rectangle meets at most four blocks of its own size; blocks travel packed.
    gathered = (
        reads.join(source, ["source_file_key", "_from_row", "_from_col"], "left")
        .groupBy("forecast_key", "block_row", "block_col", "_top", "_left", "height", "width")
        .agg(F.collect_list("_piece").alias("_pieces"))
    )

    @F.arrow_udf("array<double>")
    def assemble(pieces: pa.Array, place: pa.Array) -> pa.Array:
        fields = [
            lay_pieces(pieces[i].values, p["top"], p["left"], p["height"], p["width"]).ravel()
            for i, p in enumerate(place.to_pylist())
        ]
        return pa.array(fields, pa.list_(pa.float64()))

    place = F.struct(F.col("_top").alias("top"), F.col("_left").alias("left"), "height", "width")
    cells = F.transform(assemble("_pieces", place), lambda v: without_floor(v))
    return gathered.select("forecast_key", "block_row", "block_col", F.array(cells).alias("members"))


# --- plug-ins -------------------------------------------------------------------------------


def apply_forecaster(stacks: DataFrame, fn, algorithm: str) -> DataFrame:
    """Run ``fn(members: ndarray[M, cells]) -> ndarray[cells]`` on every stack of ``member_blocks``.

    Blocks are independent, so no grouping is needed: Spark's partitions are the work units.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                [np.asarray(fn(np.stack([m.values.to_numpy(zero_copy_only=False).astype(np.float64) for m in stack.values])), dtype=np.float64)]
                for stack in batch.column("members")
            ]
            members = pa.array(made, pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], members], names=batch.schema.names)

    columns = ["forecast_key", "block_row", "block_col", "members"]
    schema = "forecast_key string, block_row int, block_col int, members array<array<double>>"
    return stacks.select(*columns).mapInArrow(each, schema).withColumn("algorithm", F.lit(algorithm))
