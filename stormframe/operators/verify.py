"""Scoring of forecasts against what was later observed.

Forecast fields and observations meet as packed blocks.  A kernel folds
them into partial sums per (pair, probability bin), so what is shuffled
after the joins is a dozen rows per pair and task however large the grids are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.scores import (
    BIN_COUNT,
    DEFAULT_THRESHOLD,
    bin_edges,
    exceedance_probability,
    fair_crps,
    members_complete,
    probability_bin,
)
from stormframe.functions.values import finite, ratio
from stormframe.operators.forecast import member_blocks
from stormframe.operators.joins import MATCH_WINDOW_SECONDS, match_forecasts, same_shape

PAIR = ("nowcast_id", "observation_file_key")
_SUMS = (
    "n", "abs_error", "error", "squared_error", "hits", "misses", "false_alarms", "correct_negatives",
    "prob_n", "observed_events", "probability", "brier", "crps",
)


def _or_zero(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(0.0))


def cell_terms(forecast: Column, observed: Column, threshold: float | None) -> list[Column]:
    """Per-cell terms of the deterministic scores; a cell counts only if both sides are finite."""
    valid = finite(forecast) & finite(observed)
    gap = forecast - observed
    terms = [
        F.when(valid, 1).otherwise(0).cast("long").alias("n"),
        _or_zero(valid, F.abs(gap)).alias("abs_error"),
        _or_zero(valid, gap).alias("error"),
        _or_zero(valid, gap * gap).alias("squared_error"),
    ]
    if threshold is None:
        return terms + [F.lit(0).cast("long").alias(c) for c in _SUMS[4:8]]
    # Only reached for valid cells, so no NaN guard is needed.
    said, seen = forecast >= threshold, observed >= threshold
    for name, f_event, o_event in (
        ("hits", said, seen), ("misses", ~said, seen), ("false_alarms", said, ~seen), ("correct_negatives", ~said, ~seen),
    ):
        terms.append(F.when(valid & f_event & o_event, 1).otherwise(0).cast("long").alias(name))
    return terms


def score_deterministic(aligned: DataFrame, threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """MAE, bias, RMSE and contingency counts per ``pair_id`` of aligned cells; zeros where no cell is valid."""
    terms = aligned.select("pair_id", *cell_terms(F.col("forecast"), F.col("observed"), threshold))
    sums = terms.groupBy("pair_id").agg(*[F.sum(c).alias(c) for c in _SUMS[:8]])
    return sums.select("pair_id", *_means(threshold))


def _means(threshold: float | None) -> list[Column]:
    def mean(name: str) -> Column:
        return F.coalesce(ratio(F.col(name), F.col("n")), F.lit(0.0))

    scored = F.lit(None if threshold is None else float(threshold)).cast("double")
    counts = [
        (F.col(c) if threshold is not None else F.lit(None).cast("long")).alias(c)
        for c in ("hits", "misses", "false_alarms", "correct_negatives")
    ]
    return [
        F.col("n").alias("sample_count"),
        mean("abs_error").alias("mae"),
        mean("error").alias("bias"),
        F.sqrt(mean("squared_error")).alias("rmse"),
        scored.alias("threshold_dbz"),
        *counts,
    ]


def score_probabilistic(aligned: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Brier score, fair CRPS and reliability bins per ``pair_id`` of cells with ``members``, of any number."""
    members, observed = F.col("members"), F.col("observed")
    usable = finite(observed) & members_complete(members)
    stage = aligned.select(
        "pair_id",
        F.size(members).alias("_size"),
        (observed >= threshold).alias("_event"),
        F.when(usable, exceedance_probability(members, threshold)).alias("_p"),
        F.when(usable, fair_crps(F.sort_array(members), observed)).alias("_crps"),
    )
    p, counted = F.col("_p"), F.col("_p").isNotNull()
    event = F.when(F.col("_event"), 1.0).otherwise(0.0)
    terms = stage.select(
        "pair_id",
        "_size",
        F.when(counted, probability_bin(p)).alias("_bin"),
        F.when(counted, 1).otherwise(0).cast("long").alias("prob_n"),
        F.when(counted & F.col("_event"), 1).otherwise(0).cast("long").alias("observed_events"),
        _or_zero(counted, p).alias("probability"),
        _or_zero(counted, (p - event) * (p - event)).alias("brier"),
        _or_zero(counted, F.col("_crps")).alias("crps"),
    )
    sums = terms.groupBy("pair_id", "_bin").agg(F.max("_size").alias("_size"), *[F.sum(c).alias(c) for c in _SUMS[8:]])
    merged = _merge_bins(sums, ["pair_id"], _SUMS[8:], F.max("_size").cast("int").alias("ensemble_size"))
    return merged.select("pair_id", "ensemble_size", *_probability_scores())


def _merge_bins(per_bin: DataFrame, keys: list[str], sums: tuple[str, ...], *more: Column) -> DataFrame:
    """Sums over the bins of a key, and the bins as an array."""
    return per_bin.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "prob_n", "observed_events", "probability"))).alias("_bins"),
        *more,
    )


#: Cells of members that are held as arrays at a time.
_CELLS_TOGETHER = 2_000_000


def _block_sums(members: np.ndarray, observed: np.ndarray, ensemble: np.ndarray, threshold: float | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(block, bin, sums) of equal blocks: ``members`` is [block, member, cell], ``observed`` [block, cell].

    One entry per block and bin that has cells; bin -1 holds those without a probability.
    """
    there = ~np.isnan(members)
    with np.errstate(all="ignore"):
        forecast = np.where(there, members, 0.0).sum(1) / there.sum(1)
        gap = forecast - observed
    valid = np.isfinite(forecast) & np.isfinite(observed)
    gap = np.where(valid, gap, 0.0)
    limit = DEFAULT_THRESHOLD if threshold is None else threshold
    said, seen = forecast >= limit, observed >= limit
    counted = ensemble[:, None] & np.isfinite(observed) & np.isfinite(members).all(1)
    size = members.shape[1]
    p = np.where(counted, (members >= limit).sum(1) / size, 0.0)
    bins = np.where(counted, np.searchsorted(np.array(bin_edges(BIN_COUNT)), p, "right") - 1, -1)
    crps = np.zeros(observed.shape)
    if counted.any():
        at, cell = np.nonzero(counted)
        ordered, y = np.sort(members[at, :, cell], axis=1), observed[counted]
        crps[counted] = np.abs(ordered - y[:, None]).mean(1)
        if size > 1:
            weight = 2.0 * np.arange(1, size + 1) - size - 1.0
            crps[counted] -= (weight * ordered).sum(1) / (size * (size - 1))
    some = threshold is not None
    cells = (
        valid, np.abs(gap), gap, gap * gap, some & valid & said & seen, some & valid & ~said & seen, some & valid & said & ~seen,
        some & valid & ~said & ~seen, counted, counted & seen, p, np.where(counted, (p - seen) ** 2, 0.0), crps,
    )
    slots = BIN_COUNT + 1
    slot = (np.arange(len(observed))[:, None] * slots + bins + 1).ravel()
    used = np.flatnonzero(np.bincount(slot, minlength=len(observed) * slots))
    sums = [np.bincount(slot, np.broadcast_to(c, observed.shape).ravel(), len(observed) * slots)[used] for c in cells]
    return used // slots, used % slots - 1, sums


def _fold(meeting: DataFrame, threshold: float | None) -> DataFrame:
    """Blocks of members and observations to a few rows of sums each, before any shuffle; equal blocks of a batch together."""
    names = [*PAIR, "_bin", *_SUMS]
    whole = {"n", "hits", "misses", "false_alarms", "correct_negatives", "prob_n", "observed_events"}
    kinds = [pa.int64() if c in whole else pa.float64() for c in _SUMS]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, seen = batch.column("members"), batch.column("_observed")
            stack = members.flatten()
            member_at = members.offsets.to_numpy() - members.offsets[0].as_py()
            cell_at = stack.offsets.to_numpy() - stack.offsets[0].as_py()
            seen_at = seen.offsets.to_numpy() - seen.offsets[0].as_py()
            cells, observed = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (stack, seen))
            ensemble = batch.column("_ensemble").to_numpy(zero_copy_only=False).astype(bool)
            shapes = np.stack([np.diff(member_at), np.diff(seen_at)], axis=1)
            for size, n in np.unique(shapes, axis=0):
                if size == 0 or n == 0:
                    continue
                rows = np.flatnonzero((shapes == (size, n)).all(axis=1))
                # A row's members lie one after the other, and so do their cells.
                for part in np.array_split(rows, max(1, len(rows) * size * n // _CELLS_TOGETHER)):
                    said = cells[cell_at[member_at[part]][:, None] + np.arange(size * n)].reshape(len(part), size, n)
                    block, bin_, sums = _block_sums(said, observed[seen_at[part][:, None] + np.arange(n)], ensemble[part], threshold)
                    ids = [batch.column(c).take(pa.array(part[block])) for c in PAIR]
                    columns = [pa.array(np.rint(c).astype(np.int64) if t == pa.int64() else c, t) for c, t in zip(sums, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(bin_, pa.int32(), mask=bin_ < 0), *columns], names=names)

    sums = ", ".join(f"{c} {'bigint' if c in whole else 'double'}" for c in _SUMS)
    return meeting.select(*PAIR, "_ensemble", "members", "_observed").mapInArrow(each, f"nowcast_id string, observation_file_key string, _bin int, {sums}")


def _dense_bins(bins: Column) -> Column:
    """Ten bins in order, the empty ones with zeros."""
    lowers = F.array(*[F.lit(e) for e in bin_edges(BIN_COUNT)])

    def one(lower: Column, i: Column) -> Column:
        hit = F.get(F.filter(bins, lambda b: b["_bin"] == i), F.lit(0))
        return F.struct(
            lower.alias("lower"),
            F.coalesce(hit["prob_n"], F.lit(0)).cast("long").alias("count"),
            F.coalesce(hit["observed_events"], F.lit(0)).cast("long").alias("observed"),
            F.coalesce(F.try_divide(hit["probability"], hit["prob_n"]), F.lit(0.0)).alias("mean_prob"),
        )

    return F.transform(lowers, one)


def _probability_scores() -> list[Column]:
    def mean(name: str) -> Column:
        return F.coalesce(ratio(F.col(name), F.col("prob_n")), F.lit(0.0))

    some = F.col("prob_n") > 0
    return [
        F.col("prob_n").alias("prob_sample_count"),
        mean("brier").alias("brier_score"),
        mean("crps").alias("crps"),
        F.when(some, _dense_bins(F.col("_bins"))).otherwise(F.slice(_dense_bins(F.col("_bins")), 1, 0)).alias("reliability_bins"),
    ]


def _is_ensemble(size: str) -> Column:
    """One member is no ensemble: it has no probability to score."""
    return F.coalesce(F.col(size) > 1, F.lit(False))


def verify(
    nowcasts: DataFrame,
    observations: DataFrame,
    blocks: DataFrame,
    fields: DataFrame | None = None,
    threshold: float | None = DEFAULT_THRESHOLD,
    seconds: int = MATCH_WINDOW_SECONDS,
) -> DataFrame:
    """Match, align and score every forecast that an observed grid falls due for.

    ``fields`` holds blocks of forecasts that are not references to observed grids (see
    ``advection_blocks``).  One row per (nowcast, observation) of equal shape, also where no
    cell could be compared.
    """
    pairs = same_shape(match_forecasts(nowcasts, observations, seconds)).select(
        *PAIR, "forecast_key", "product", "level", "algorithm", "horizon", "ensemble_size",
        F.col("observation_valid_at").alias("valid_at"),
    )
    # Only fields that fell due are stacked.
    due = nowcasts.where(F.col("members").isNotNull()).join(
        pairs.select("forecast_key").distinct(), "forecast_key", "left_semi"
    )
    stacks = member_blocks(due, blocks)
    if fields is not None:
        stacks = stacks.unionByName(fields.select(*stacks.columns))
    # Pairs learn their blocks' places first, so that heavy rows meet block by block.
    places = blocks.select(F.col("file_key").alias("observation_file_key"), "block_row", "block_col")
    seen = blocks.select(F.col("file_key").alias("observation_file_key"), "block_row", "block_col", F.col("values").alias("_observed"))
    meeting = (
        pairs.select(*PAIR, "forecast_key", _is_ensemble("ensemble_size").alias("_ensemble"))
        .join(places, "observation_file_key")
        .join(stacks, ["forecast_key", "block_row", "block_col"])
        .join(seen, ["observation_file_key", "block_row", "block_col"])
    )
    per_bin = _fold(meeting, threshold).groupBy(*PAIR, "_bin").agg(*[F.sum(c).alias(c) for c in _SUMS])
    sums = _merge_bins(per_bin, list(PAIR), _SUMS)
    scored = sums.select(*PAIR, *_means(threshold), *_probability_scores())
    joined = pairs.drop("forecast_key").join(scored, list(PAIR), "left")
    ensemble = _is_ensemble("ensemble_size")
    zero = {"sample_count": 0, "mae": 0.0, "bias": 0.0, "rmse": 0.0}
    return joined.select(
        *PAIR, "product", "level", "algorithm", "horizon", "valid_at",
        *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zero.items()],
        F.lit(threshold).cast("double").alias("threshold_dbz"),
        *[
            (F.coalesce(c, F.lit(0)) if threshold is not None else F.col(c)).cast("long").alias(c)
            for c in ("hits", "misses", "false_alarms", "correct_negatives")
        ],
        "ensemble_size",
        F.when(ensemble, F.coalesce("brier_score", F.lit(0.0))).alias("brier_score"),
        F.when(ensemble, F.coalesce("crps", F.lit(0.0))).alias("crps"),
        F.when(ensemble, F.col("reliability_bins")).alias("reliability_bins"),
    )
