"""Calibration roll-ups and their displays."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.operators import calibration as cal
from stormframe.plans.derived import Tables
from stormframe.plans.registry import big, query, rounded
from stormframe.session import scratch_folder

# Means of two-digit values over 64 or 128 rows end in an exact half; both engines round it
# the same way once it is moved off the edge.
NUDGE = 1e-9
SINCE = datetime(1996, 1, 1, tzinfo=UTC)
_KEYS = ("algorithm", "horizon")
_COUNTS = ("verification_count", "sample_count", "hits", "misses", "false_alarms", "correct_negatives", "brier_sample_count")
_MEANS = ("mae_mean", "bias_mean", "rmse_mean", "brier_mean", "crps_mean", "pod", "far", "csi")


def _tidy(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "algorithm", big("horizon"), *[big(c) for c in (*extra, *_COUNTS)], "threshold_dbz", big("ensemble_size"),
        *[rounded(c, F.col(c) + NUDGE) for c in _MEANS],
    )


_SUMS_SQL = """
    algorithm, horizon, {extra}
    count(*) AS verification_count, CAST(sum(sample_count) AS BIGINT) AS sample_count, CAST(sum(hits) AS BIGINT) AS hits,
    CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(false_alarms) AS BIGINT) AS false_alarms,
    CAST(sum(correct_negatives) AS BIGINT) AS correct_negatives,
    CAST(coalesce(sum(sample_count) FILTER (WHERE brier_score IS NOT NULL), 0) AS BIGINT) AS brier_sample_count,
    CASE WHEN count(DISTINCT threshold_dbz) = 1 THEN max(threshold_dbz) END AS threshold_dbz,
    CASE WHEN count(DISTINCT ensemble_size) = 1 THEN CAST(max(ensemble_size) AS BIGINT) END AS ensemble_size,
    round(coalesce(sum(mae * sample_count) / nullif(sum(sample_count), 0), 0) + 1e-9, 6) + 0 AS mae_mean,
    round(coalesce(sum(bias * sample_count) / nullif(sum(sample_count), 0), 0) + 1e-9, 6) + 0 AS bias_mean,
    round(coalesce(sum(rmse * sample_count) / nullif(sum(sample_count), 0), 0) + 1e-9, 6) + 0 AS rmse_mean,
    round(sum(brier_score * sample_count) / nullif(sum(sample_count) FILTER (WHERE brier_score IS NOT NULL), 0) + 1e-9, 6) AS brier_mean,
    round(sum(crps * sample_count) / nullif(sum(sample_count) FILTER (WHERE brier_score IS NOT NULL), 0) + 1e-9, 6) AS crps_mean,
    round(sum(hits) / nullif(sum(hits) + sum(misses), 0) + 1e-9, 6) AS pod,
    round(sum(false_alarms) / nullif(sum(hits) + sum(false_alarms), 0) + 1e-9, 6) AS far,
    round(sum(hits) / nullif(sum(hits) + sum(misses) + sum(false_alarms), 0) + 1e-9, 6) AS csi"""


@query(
    "calibration_matrix",
    f"SELECT {_SUMS_SQL.format(extra='')} FROM verifications WHERE verified_at >= TIMESTAMP '1996-01-01' GROUP BY algorithm, horizon",
    ("verifications",),
)
def calibration_matrix(t: Tables) -> DataFrame:
    return _tidy(cal.calibration(t.verifications(), SINCE))


@query(
    "calibration_series",
    f"""SELECT {_SUMS_SQL.format(extra="CAST(epoch_us(verified_at) // 86400000000 * 86400 AS BIGINT) AS bucket_epoch,")}
        FROM verifications WHERE verified_at >= TIMESTAMP '1996-01-01' AND product = 'P1'
        GROUP BY algorithm, horizon, bucket_epoch""",
    ("verifications",),
)
def calibration_series(t: Tables) -> DataFrame:
    return _tidy(cal.calibration_series(t.verifications(), SINCE, 86400, product="P1"), "bucket_epoch")


@query(
    "calibration_series_of_rollup",
    " UNION ALL ".join(
        f"""SELECT {w} AS width, s.* FROM (SELECT {_SUMS_SQL.format(extra=f"CAST(epoch_us(verified_at) // {w}000000 * {w} AS BIGINT) AS bucket_epoch,")}
        FROM verifications WHERE verified_at >= TIMESTAMP '1996-01-01' AND product = 'P1' GROUP BY algorithm, horizon, bucket_epoch) s"""
        for w in (300, 43200, 86400)
    ),
    ("verifications",),
)
def calibration_series_of_rollup(t: Tables) -> DataFrame:
    """Series of three widths from partial sums stored for two halves of the verifications."""
    v = t.verifications()
    path = scratch_folder(t.spark, "rollup")
    for part in (v.where("horizon = 10 OR hits % 2 = 0"), v.where("NOT (horizon = 10 OR hits % 2 = 0)")):
        cal.calibration_rollup(part).write.mode("append").parquet(path)
    stored = t.spark.read.parquet(path)
    out = None
    for width in (300, 43200, 86400):
        series = _tidy(cal.series_of_rollup(stored, width, SINCE, product="P1"), "bucket_epoch").withColumn("width", F.lit(width))
        out = series if out is None else out.unionByName(series)
    return out


@query(
    "calibration_series_nested",
    """SELECT algorithm, horizon, count(*) AS points, min(bucket) AS first_bucket, max(bucket) AS last_bucket,
              string_agg(CAST(n AS VARCHAR), ',' ORDER BY bucket) AS counts
       FROM (SELECT algorithm, horizon, CAST(epoch_us(verified_at) // 86400000000 * 86400 AS BIGINT) AS bucket, count(*) AS n
             FROM verifications GROUP BY ALL) GROUP BY algorithm, horizon""",
    ("verifications",),
)
def calibration_series_nested(t: Tables) -> DataFrame:
    nested = cal.nested_series(cal.calibration_series(t.verifications(), None, 86400))
    p = F.col("points")
    return nested.select(
        "algorithm", big("horizon"), F.size(p).cast("long").alias("points"), p[0]["bucket_epoch"].alias("first_bucket"),
        F.element_at(p, -1)["bucket_epoch"].alias("last_bucket"),
        F.concat_ws(",", F.transform(p, lambda x: x["verification_count"].cast("string"))).alias("counts"),
    )


@query(
    "calibration_reliability",
    """SELECT algorithm, horizon, bin, round(lower, 6) AS lower, "count", observed,
              round(CASE WHEN "count" > 0 THEN lower + 0.05::DOUBLE ELSE 0 END, 6) AS mean_prob,
              round(observed / nullif("count", 0), 6) AS observed_frequency FROM reliability""",
    ("reliability",),
)
def calibration_reliability(t: Tables) -> DataFrame:
    rel = cal.calibration_reliability(t.verifications())
    return rel.select(
        "algorithm", big("horizon"), big("bin"), rounded("lower"), "count", "observed", rounded("mean_prob"),
        rounded("observed_frequency"),
    )


@query(
    "reliability_bin_share",
    """SELECT algorithm, horizon, bin, "count", round("count" / sum("count") OVER (PARTITION BY algorithm, horizon), 6) AS share
       FROM reliability WHERE "count" > 0""",
    ("reliability",),
)
def reliability_bin_share(t: Tables) -> DataFrame:
    share = cal.bin_share(cal.calibration_reliability(t.verifications()))
    return share.select("algorithm", big("horizon"), big("bin"), "count", rounded("share"))


@query(
    "skill_vs_baseline",
    """SELECT v.algorithm, v.horizon, v.metric, round(v.value, 6) AS value, round(b.value, 6) AS baseline_value,
              round(CASE WHEN ok THEN abs(delta) END, 6) AS magnitude,
              round(CASE WHEN ok THEN least(999, abs(delta) / abs(b.value) * 100) END, 6) AS percent,
              CASE WHEN ok THEN delta > 0 END AS better
       FROM metric_rows v JOIN metric_rows b ON b.algorithm = 'persistence' AND b.horizon = v.horizon AND b.metric = v.metric,
            LATERAL (SELECT CASE WHEN v.metric IN ('pod', 'csi') THEN v.value - b.value ELSE b.value - v.value END AS delta,
                            v.value IS NOT NULL AND b.value IS NOT NULL AND b.value <> 0 AS ok)
       WHERE v.algorithm <> 'persistence' AND b.value IS NOT NULL""",
    ("metric_rows",),
)
def skill_vs_baseline(t: Tables) -> DataFrame:
    skill = cal.skill_vs_baseline(cal.calibration(t.verifications()))
    return skill.select(
        "algorithm", big("horizon"), "metric", rounded("value"), rounded("baseline_value"), rounded("magnitude"),
        rounded("percent"), "better",
    )


@query(
    "metric_unpivot",
    "SELECT algorithm, horizon, metric, round(value, 6) AS value FROM metric_rows",
    ("metric_rows",),
)
def metric_unpivot(t: Tables) -> DataFrame:
    return cal.unpivot_metrics(cal.calibration(t.verifications())).select("algorithm", big("horizon"), "metric", rounded("value"))


@query(
    "worst_by_metric",
    "SELECT metric, round(greatest(0, coalesce(max(value), 0)), 6) AS worst_value FROM metric_rows GROUP BY metric",
    ("metric_rows",),
)
def worst_by_metric(t: Tables) -> DataFrame:
    return cal.worst_by_metric(cal.calibration(t.verifications())).select("metric", rounded("worst_value"))


@query(
    "verification_totals",
    "SELECT CAST(sum(sample_count) AS BIGINT) AS sample_count, count(*) AS verification_count FROM verifications",
    ("verifications",),
)
def verification_totals(t: Tables) -> DataFrame:
    return cal.verification_totals(cal.calibration(t.verifications()))


@query(
    "headline_score",
    """SELECT algorithm, horizon, CASE WHEN brier_mean IS NOT NULL THEN 'brier' ELSE 'mae' END AS kind,
              round(coalesce(brier_mean, mae_mean), 6) AS value
       FROM calib ORDER BY CASE WHEN brier_mean IS NOT NULL AND horizon = 30 AND algorithm <> 'persistence' THEN 1
                                WHEN brier_mean IS NOT NULL THEN 2 WHEN algorithm = 'persistence' AND horizon = 30 THEN 3
                                WHEN horizon = 30 THEN 4 ELSE 5 END, horizon, algorithm LIMIT 1""",
    ("calib",),
)
def headline_score(t: Tables) -> DataFrame:
    return cal.headline(cal.calibration(t.verifications())).select("algorithm", big("horizon"), "kind", rounded("value"))


@query(
    "calibration_display_order",
    """SELECT row_number() OVER (ORDER BY algorithm <> 'persistence', algorithm, horizon) AS place, algorithm, horizon,
              sample_count FROM calib""",
    ("calib",),
)
def calibration_display_order(t: Tables) -> DataFrame:
    ordered = cal.display_order(cal.calibration(t.verifications()))
    return _numbered(ordered)


def _numbered(ordered: DataFrame) -> DataFrame:
    """Place of each row; the matrix has one row per algorithm and lead time, so one array holds it."""
    listed = ordered.agg(
        F.sort_array(
            F.collect_list(
                F.struct((F.col("algorithm") != cal.BASELINE).alias("later"), "algorithm", "horizon", "sample_count")
            )
        ).alias("rows")
    )
    return listed.select(F.posexplode("rows").alias("pos", "r")).select(
        (F.col("pos") + 1).cast("long").alias("place"), "r.algorithm", F.col("r.horizon").cast("long").alias("horizon"), "r.sample_count"
    )


@query(
    "series_runs",
    """SELECT algorithm, horizon, start, "end", length,
              row_number() OVER (PARTITION BY algorithm, horizon ORDER BY length DESC, start) = 1 AS is_longest
       FROM (SELECT algorithm, horizon, run, min(bucket) AS start, max(bucket) AS "end", count(*) AS length
             FROM (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY algorithm, horizon ORDER BY bucket) AS run
                   FROM (SELECT algorithm, horizon, CAST(epoch_us(verified_at) // 604800000000 * 604800 AS BIGINT) AS bucket,
                                CASE WHEN sum(hits) % 3 <> 0 THEN 1 END AS v
                         FROM verifications GROUP BY algorithm, horizon, bucket))
             WHERE v IS NOT NULL GROUP BY algorithm, horizon, run)""",
    ("verifications",),
)
def series_runs(t: Tables) -> DataFrame:
    series = cal.calibration_series(t.verifications(), None, 604800)
    gappy = series.withColumn("shown", F.when(F.col("hits") % 3 != 0, F.col("mae_mean")))
    runs = cal.series_runs(gappy, _KEYS, "bucket_epoch", "shown")
    return runs.select("algorithm", big("horizon"), "start", "end", "length", "is_longest")
