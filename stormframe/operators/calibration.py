"""Roll-ups of verification rows: matrices, series, reliability, skill, headline."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.functions.scores import BIN_COUNT, csi, far, pod
from stormframe.functions.values import finite, ratio

GROUP = ("algorithm", "horizon")
BASELINE = "persistence"
# Metrics of the matrix, which of them improve downwards, percent cap, bucket bounds.
METRICS = {"mae": "mae_mean", "pod": "pod", "far": "far", "csi": "csi", "brier": "brier_mean", "crps": "crps_mean"}
LOWER_IS_BETTER = ("mae", "far", "brier", "crps")
PERCENT_CAP = 999.0
BUCKET_SECONDS = 3600


def _selected(df: DataFrame, since, product, level, algorithm) -> DataFrame:
    if since is not None:
        df = df.where(F.col("verified_at") >= (since if isinstance(since, Column) else F.lit(since)))
    for name, wanted in (("product", product), ("level", level), ("algorithm", algorithm)):
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    return df


def pod_far_csi(df: DataFrame) -> DataFrame:
    """Add POD, FAR and CSI of the summed counts; null on a zero denominator."""
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return df.withColumns({"pod": pod(h, m), "far": far(h, f), "csi": csi(h, m, f)})


def series_aggregates() -> list[Column]:
    n = F.col("sample_count")

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)

    def weighted(name: str) -> Column:
        return F.coalesce(ratio(F.sum(F.col(name) * n), F.sum(n)), F.lit(0.0)).alias(f"{name}_mean")

    def only_value(name: str) -> Column:
        # One distinct value exactly when the extremes agree: no distinct expansion needed.
        low, high = F.min(name), F.max(name)
        return F.when(low == high, high).alias(name)

    scored = F.sum(F.when(F.col("brier_score").isNotNull(), n).otherwise(0))
    return [
        F.count("*").alias("verification_count"),
        total(n, "sample_count"),
        weighted("mae"),
        weighted("bias"),
        weighted("rmse"),
        *[total(F.col(c), c) for c in ("hits", "misses", "false_alarms", "correct_negatives")],
        only_value("threshold_dbz"),
        only_value("ensemble_size"),
        F.coalesce(scored, F.lit(0)).cast("long").alias("brier_sample_count"),
        ratio(F.sum(F.col("brier_score") * n), scored).alias("brier_mean"),
        ratio(F.sum(F.col("crps") * n), scored).alias("crps_mean"),
    ]


def calibration(
    df: DataFrame,
    since: datetime | Column | None = None,
    product: str | None = None,
    level: str | None = None,
    algorithm: str | None = None,
) -> DataFrame:
    """Sample-weighted scores per algorithm and lead time, in key order."""
    chosen = _selected(df, since, product, level, algorithm)
    return pod_far_csi(chosen.groupBy(*GROUP).agg(*series_aggregates())).orderBy(*GROUP)


def bucket_start(time: Column, seconds: int) -> Column:
    """Epoch second at which the bucket of a time starts."""
    if seconds <= 0:
        raise ValueError("bucket width must be positive")
    return (F.floor(F.unix_timestamp(time) / seconds) * seconds).cast("long")


def calibration_series(
    df: DataFrame,
    since: datetime | Column | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
    product: str | None = None,
    level: str | None = None,
    algorithm: str | None = None,
) -> DataFrame:
    """The same per time bucket (``bucket_epoch``)."""
    chosen = _selected(df, since, product, level, algorithm)
    bucket = bucket_start(F.col("verified_at"), bucket_seconds).alias("bucket_epoch")
    return pod_far_csi(chosen.groupBy(*GROUP, bucket).agg(*series_aggregates())).orderBy(*GROUP, "bucket_epoch")


#: Width of the stored partial sums, and what wider buckets may be made of them.
ROLLUP_SECONDS = 300
WIDEST_SECONDS = 86400
ROLLUP_KEY = ("product", "level", *GROUP, "bucket_epoch")

_ROLLED = ("mae", "bias", "rmse")
_COUNTED = ("hits", "misses", "false_alarms", "correct_negatives")
_SUMMED = ("verification_count", "sample_count", *[f"{c}_sum" for c in _ROLLED], *_COUNTED, "scored_count", "brier_sum", "crps_sum")


def calibration_rollup(verifications: DataFrame) -> DataFrame:
    """Partial sums per product, level, algorithm, lead time and 300 seconds, from which all wider series follow."""
    n, scored = F.col("sample_count"), F.col("brier_score").isNotNull()
    cells = verifications.withColumn("bucket_epoch", bucket_start(F.col("verified_at"), ROLLUP_SECONDS)).groupBy(*ROLLUP_KEY)
    return cells.agg(
        F.count("*").alias("verification_count"),
        F.sum(n).alias("sample_count"),
        *[F.sum(F.col(c) * n).alias(f"{c}_sum") for c in _ROLLED],
        *[F.sum(c).alias(c) for c in _COUNTED],
        F.sum(F.when(scored, n).otherwise(0)).alias("scored_count"),
        F.sum(F.col("brier_score") * n).alias("brier_sum"),
        F.sum(F.col("crps") * n).alias("crps_sum"),
        *_extremes(merged=False),
    )


def _extremes(merged: bool) -> list[Column]:
    edges = (("low", F.min), ("high", F.max))
    return [f(f"{edge}_{c}" if merged else c).alias(f"{edge}_{c}") for c in ("threshold_dbz", "ensemble_size") for edge, f in edges]


def merge_rollups(rollups: DataFrame, bucket: Column | str = "bucket_epoch", key: Sequence[str] = ROLLUP_KEY[:-1]) -> DataFrame:
    """Cells of one key and bucket as one; sums of sums, extremes of extremes."""
    at = F.col(bucket) if isinstance(bucket, str) else bucket
    return rollups.groupBy(*key, at.alias("bucket_epoch")).agg(*[F.sum(c).alias(c) for c in _SUMMED], *_extremes(merged=True))


def series_of_rollup(
    rollup: DataFrame,
    bucket_seconds: int = BUCKET_SECONDS,
    since: datetime | None = None,
    product: str | None = None,
    level: str | None = None,
    algorithm: str | None = None,
) -> DataFrame:
    """``calibration_series`` of the verifications behind a roll-up, without reading them.

    Widths are whole multiples of 300 seconds up to a day; ``since`` falls on such a boundary.
    """
    if bucket_seconds % ROLLUP_SECONDS or not ROLLUP_SECONDS <= bucket_seconds <= WIDEST_SECONDS:
        raise ValueError(f"bucket width must be a multiple of {ROLLUP_SECONDS} up to {WIDEST_SECONDS} seconds")
    if since is not None and since.timestamp() % ROLLUP_SECONDS:
        raise ValueError(f"a roll-up starts on whole {ROLLUP_SECONDS} seconds")
    chosen = rollup
    for name, wanted in (("product", product), ("level", level), ("algorithm", algorithm)):
        chosen = chosen if wanted is None else chosen.where(F.col(name) == wanted)
    if since is not None:
        chosen = chosen.where(F.col("bucket_epoch") >= int(since.timestamp()))
    wide = (F.floor(F.col("bucket_epoch") / bucket_seconds) * bucket_seconds).cast("long")
    merged = merge_rollups(chosen, wide, GROUP)
    n, scored = F.col("sample_count"), F.col("scored_count")

    def only(name: str) -> Column:
        return F.when(F.col(f"low_{name}") == F.col(f"high_{name}"), F.col(f"high_{name}")).alias(name)

    series = merged.select(
        *GROUP,
        "bucket_epoch",
        "verification_count",
        F.coalesce(n, F.lit(0)).cast("long").alias("sample_count"),
        *[F.coalesce(ratio(F.col(f"{c}_sum"), n), F.lit(0.0)).alias(f"{c}_mean") for c in _ROLLED],
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTED],
        only("threshold_dbz"),
        only("ensemble_size"),
        F.coalesce(scored, F.lit(0)).cast("long").alias("brier_sample_count"),
        ratio(F.col("brier_sum"), scored).alias("brier_mean"),
        ratio(F.col("crps_sum"), scored).alias("crps_mean"),
    )
    return pod_far_csi(series).orderBy(*GROUP, "bucket_epoch")


def nested_series(series: DataFrame) -> DataFrame:
    """One row per algorithm and lead time with its points in order; a bucket is one point."""
    points = [c for c in series.columns if c not in GROUP]
    return series.groupBy(*GROUP).agg(
        F.sort_array(F.collect_list(F.struct("bucket_epoch", *[c for c in points if c != "bucket_epoch"]))).alias("points")
    )


def calibration_reliability(
    df: DataFrame,
    since: datetime | Column | None = None,
    product: str | None = None,
    level: str | None = None,
    algorithm: str | None = None,
    n_bins: int = BIN_COUNT,
) -> DataFrame:
    """Histograms summed bin by bin: one row per algorithm, lead time and bin.

    Short histograms are padded, long ones cut; a group appears once it has any histogram.
    """
    chosen = _selected(df, since, product, level, algorithm).where(F.col("reliability_bins").isNotNull())
    # Ten literal entries keep every bin present without a join back.
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin"),
                F.coalesce(F.get("reliability_bins", F.lit(i))["count"], F.lit(0)).alias("count"),
                F.coalesce(F.get("reliability_bins", F.lit(i))["observed"], F.lit(0)).alias("observed"),
                F.coalesce(F.get("reliability_bins", F.lit(i))["mean_prob"], F.lit(0.0)).alias("mean_prob"),
            )
            for i in range(n_bins)
        ]
    )
    rows = chosen.select(*GROUP, F.explode(entries).alias("e")).select(*GROUP, "e.*")
    summed = rows.groupBy(*GROUP, "bin").agg(
        F.sum("count").cast("long").alias("count"),
        F.sum("observed").cast("long").alias("observed"),
        F.sum(F.col("mean_prob") * F.col("count")).alias("_weighted"),
    )
    return summed.select(
        *GROUP,
        "bin",
        (F.col("bin") / n_bins).alias("lower"),
        "count",
        "observed",
        F.coalesce(ratio(F.col("_weighted"), F.col("count")), F.lit(0.0)).alias("mean_prob"),
        ratio(F.col("observed"), F.col("count")).alias("observed_frequency"),
    ).orderBy(*GROUP, "bin")


def bin_share(reliability: DataFrame) -> DataFrame:
    """Share of each bin in its diagram; diagrams without cells and empty bins are left out."""
    whole = Window.partitionBy(*GROUP)
    return (
        reliability.withColumn("share", ratio(F.col("count"), F.sum("count").over(whole)))
        .where(F.col("count") > 0)
    )


def unpivot_metrics(calib: DataFrame) -> DataFrame:
    """One row per algorithm, lead time and metric."""
    wide = calib.select(*GROUP, *[F.col(source).cast("double").alias(name) for name, source in METRICS.items()])
    return wide.unpivot(list(GROUP), list(METRICS), "metric", "value")


def skill_vs_baseline(calib: DataFrame, metrics: Sequence[str] | None = None, baseline: str = BASELINE) -> DataFrame:
    """Improvement of each algorithm on the baseline at the same lead time, per metric.

    Null where either side is missing or not finite, or where the baseline is zero.
    """
    rows = unpivot_metrics(calib).where(F.col("metric").isin(*(metrics or METRICS)))
    base = rows.where(F.col("algorithm") == baseline).select("horizon", "metric", F.col("value").alias("baseline_value"))
    v, b = F.col("value"), F.col("baseline_value")
    delta = F.when(F.col("metric").isin(*LOWER_IS_BETTER), b - v).otherwise(v - b)
    usable = finite(v) & finite(b) & (b != 0.0)
    return (
        rows.where(F.col("algorithm") != baseline)
        .join(base, ["horizon", "metric"])
        .where(b.isNotNull())
        .select(
            *GROUP,
            "metric",
            "value",
            "baseline_value",
            F.when(usable, F.abs(delta)).alias("magnitude"),
            F.when(usable, F.least(F.lit(PERCENT_CAP), ratio(F.abs(delta), F.abs(b)) * 100.0)).alias("percent"),
            F.when(usable, delta > 0.0).alias("better"),
        )
    )


def worst_by_metric(calib: DataFrame) -> DataFrame:
    """Largest value per metric, at least zero."""
    return unpivot_metrics(calib).groupBy("metric").agg(
        F.greatest(F.lit(0.0), F.coalesce(F.max("value"), F.lit(0.0))).alias("worst_value")
    )


def verification_totals(calib: DataFrame) -> DataFrame:
    return calib.agg(
        F.coalesce(F.sum("sample_count"), F.lit(0)).cast("long").alias("sample_count"),
        F.coalesce(F.sum("verification_count"), F.lit(0)).cast("long").alias("verification_count"),
    )


def headline(calib: DataFrame) -> DataFrame:
    """The row to show first: ensemble at 30 minutes, any ensemble, baseline at 30, any at 30, shortest lead."""
    ensemble = F.col("brier_mean").isNotNull()
    at_30, is_base = F.col("horizon") == 30, F.col("algorithm") == BASELINE
    priority = (
        F.when(ensemble & at_30 & ~is_base, 1).when(ensemble, 2).when(is_base & at_30, 3).when(at_30, 4).otherwise(5)
    )
    kind = F.when(ensemble, F.lit("brier")).otherwise(F.lit("mae"))
    chosen = calib.agg(
        F.min_by(
            F.struct(*GROUP, kind.alias("kind"), F.coalesce("brier_mean", "mae_mean").alias("value"), "ensemble_size"),
            F.struct(priority.alias("p"), "horizon", "algorithm"),
        ).alias("h")
    )
    return chosen.where(F.col("h").isNotNull()).select("h.*")


def display_order(calib: DataFrame) -> DataFrame:
    """Baseline first, then by name, then by lead time."""
    return calib.orderBy((F.col("algorithm") != BASELINE).asc(), F.col("algorithm").asc(), F.col("horizon").asc())


def series_runs(points: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Unbroken runs of finite points (``start``, ``end``, ``length``), the longest marked; earliest on ties.

    ``points`` is an aggregated series - one row per bucket - so a series is bounded by its buckets.
    """
    present = finite(F.col(value))
    running = Window.partitionBy(*by).orderBy(order)
    marked = points.withColumn("_run", F.sum(F.when(present, 0).otherwise(1)).over(running)).where(present)
    runs = marked.groupBy(*by, "_run").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")
    )
    best = Window.partitionBy(*by).orderBy(F.col("length").desc(), F.col("start").asc())
    return runs.withColumn("is_longest", F.row_number().over(best) == 1).drop("_run")
