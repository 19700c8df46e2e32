import math
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, make_grid
from stormframe.functions import scores
from stormframe.operators import calibration, forecast, verify

NAN = float("nan")


def score(spark, forecast_values, observed, threshold=35.0):
    rows = [(1, f, o) for f, o in zip(forecast_values, observed, strict=True)]
    aligned = spark.createDataFrame(rows, "pair_id int, forecast double, observed double")
    return verify.score_deterministic(aligned, threshold).first()


def test_perfect_and_biased(spark):
    perfect = score(spark, [10.0, 40.0], [10.0, 40.0])
    assert (perfect.mae, perfect.bias, perfect.rmse, perfect.sample_count) == (0.0, 0.0, 0.0, 2)
    assert (perfect.hits, perfect.correct_negatives) == (1, 1)
    signed = score(spark, [1.0, 2.0, 3.0, 4.0], [0.0, 4.0, 6.0, 0.0])
    assert signed.mae == pytest.approx(2.5) and signed.bias == pytest.approx(0.0)
    assert signed.rmse == pytest.approx(math.sqrt(7.5))


def test_only_finite_pairs_count(spark):
    row = score(spark, [40.0, NAN, 40.0, float("inf"), None], [10.0, 40.0, NAN, 40.0, 40.0])
    assert (row.sample_count, row.false_alarms, row.hits, row.misses) == (1, 1, 0, 0)
    empty = score(spark, [NAN], [1.0])
    assert (empty.sample_count, empty.mae, empty.rmse) == (0, 0.0, 0.0)


def test_no_threshold_skips_contingency(spark):
    row = score(spark, [40.0], [40.0], threshold=None)
    assert row.hits is None and row.threshold_dbz is None and row.mae == 0.0


def ensemble(spark, cells):
    aligned = spark.createDataFrame([(1, m, o) for m, o in cells], "pair_id int, members array<double>, observed double")
    return verify.score_probabilistic(aligned).first()


def test_four_members(spark):
    row = ensemble(spark, [([40.0, 40.0, 10.0, 10.0], 40.0)] * 9)
    assert row.brier_score == pytest.approx(0.25) and row.crps == pytest.approx(5.0)
    assert row.prob_sample_count == 9 and row.ensemble_size == 4
    assert [b["count"] for b in row.reliability_bins] == [0, 0, 0, 0, 0, 9, 0, 0, 0, 0]
    assert row.reliability_bins[5]["observed"] == 9 and row.reliability_bins[5]["mean_prob"] == pytest.approx(0.5)


def test_crps_small_ensembles(spark):
    assert ensemble(spark, [([3.0], 5.0), ([9.0], 8.0)]).crps == pytest.approx(1.5)  # one member: mean absolute error
    assert ensemble(spark, [([0.0, 2.0], 1.0)]).crps == pytest.approx(0.0)


def test_incomplete_members_drop_the_cell(spark):
    row = ensemble(spark, [([40.0, NAN], 40.0), ([40.0, 40.0], NAN)])
    assert row.prob_sample_count == 0 and row.brier_score == 0.0 and row.reliability_bins == []


def test_crps_matches_pairwise_definition(spark):
    members, observed = [3.0, 11.0, -2.0, 7.5, 7.5], 4.0
    m = len(members)
    want = sum(abs(x - observed) for x in members) / m - sum(abs(a - b) for a in members for b in members) / (2 * m * (m - 1))
    assert ensemble(spark, [(members, observed)]).crps == pytest.approx(want)


def test_bin_edges(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    bins = [r.b for r in df.select("p", scores.probability_bin(F.col("p")).alias("b")).collect()]
    assert bins == [0, 1, 2, 2, 4, 5, 5, 6, 8, 9, 9]


def test_member_mean_keeps_infinity_and_skips_missing(spark):
    df = spark.createDataFrame([([1.0, NAN, 3.0],), ([NAN, NAN],), ([float("inf"), 1.0],)], "m array<double>")
    got = [r[0] for r in df.select(scores.member_mean(F.col("m"))).collect()]
    assert got == [2.0, None, float("inf")]


def test_verification_of_an_ensemble_grid(spark):
    lats, lngs = [29.5, 29.76, 30.0], [-96.0, -95.37, -95.0]
    frames = {f"f{i}": [v] * 9 for i, v in enumerate((40.0, 40.0, 10.0, 10.0))}
    grids, blocks, _ = make_grid(spark, lats, lngs, frames, block=2)
    grids2, blocks2, _ = make_grid(spark, lats, lngs, {f"g{i}": [40.0] * 9 for i in range(10)}, block=2)
    issued = forecast.lagged_ensemble(grids, horizons=(10,)).where("source_file_key = 'f3'")
    seen = grids2.where(F.col("file_key") == "g8")
    rows = verify.verify(issued, seen, blocks.unionByName(blocks2)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.sample_count, row.ensemble_size) == (9, 4)
    assert row.bias == pytest.approx(-15.0) and row.brier_score == pytest.approx(0.25) and row.crps == pytest.approx(5.0)
    assert row.hits + row.misses + row.false_alarms + row.correct_negatives == row.sample_count
    assert sum(b["count"] for b in row.reliability_bins) == 9


def test_shape_mismatch_is_not_scored(spark):
    grids, blocks, _ = make_grid(spark, [1, 2], [3, 4], {"a": [1] * 4})
    other, other_blocks, _ = make_grid(spark, [1, 2, 3], [3, 4], {"b": [1] * 6})
    later = other.withColumn("valid_at", F.lit(START) + F.expr("interval 10 minutes"))
    assert verify.verify(forecast.persistence(grids, (10,)), later, blocks.unionByName(other_blocks)).count() == 0


def test_empty_pair_is_kept_with_zeros(spark):
    grids, blocks, _ = make_grid(spark, [1, 2], [3, 4], {f"f{i}": [NAN] * 4 for i in range(6)})
    rows = verify.verify(forecast.persistence(grids, (10,)), grids, blocks).collect()
    assert [(r.sample_count, r.mae, r.hits, r.brier_score) for r in rows] == [(0, 0.0, 0, None)]


VERIFICATION = (
    "algorithm string, horizon int, product string, level string, sample_count bigint, mae double, bias double, rmse double, "
    "threshold_dbz double, hits bigint, misses bigint, false_alarms bigint, correct_negatives bigint, ensemble_size int, "
    "brier_score double, crps double, verified_at timestamp"
)


def test_calibration_weights_and_mixed_thresholds(spark):
    rows = [
        ("x", 10, "P", "L", 10, 1.0, 1.0, 1.0, 35.0, 0, 0, 0, 5, None, None, None, START),
        ("x", 10, "P", "L", 30, 3.0, -1.0, 3.0, 40.0, 0, 0, 0, 5, 8, 0.2, 1.0, START),
        ("y", 10, "P", "L", 0, 9.0, 9.0, 9.0, None, 1, 1, 2, 0, None, None, None, START),
    ]
    x, y = calibration.calibration(spark.createDataFrame(rows, VERIFICATION)).collect()
    assert x.mae_mean == pytest.approx(2.5) and x.bias_mean == pytest.approx(-0.5)
    assert x.threshold_dbz is None and x.ensemble_size == 8 and x.brier_sample_count == 30
    assert x.brier_mean == pytest.approx(0.2) and x.pod is None and x.far is None and x.csi is None
    assert y.mae_mean == 0.0 and (y.pod, y.far, y.csi) == (0.5, pytest.approx(2 / 3), 0.25) and y.brier_mean is None


def test_skill_cap_and_zero_baseline(spark):
    base = {"pod": None, "far": 0.0, "csi": 0.5, "brier_mean": None, "crps_mean": 0.001}
    rows = [("persistence", 10, 2.0, *base.values()), ("new", 10, 1.0, None, 0.5, 0.75, 0.1, 5.0)]
    calib = spark.createDataFrame(rows, "algorithm string, horizon int, mae_mean double, pod double, far double, csi double, brier_mean double, crps_mean double")
    got = {r.metric: r for r in calibration.skill_vs_baseline(calib).collect()}
    assert set(got) == {"mae", "far", "csi", "crps"}
    assert got["mae"].percent == pytest.approx(50.0) and got["mae"].better
    assert got["csi"].percent == pytest.approx(50.0) and got["csi"].better
    assert got["crps"].percent == 999.0 and not got["crps"].better
    assert got["far"].percent is None


def test_bucket_width_must_be_positive():
    with pytest.raises(ValueError):
        calibration.bucket_start(None, 0)


def test_longest_run_is_the_earliest_on_ties(spark):
    points = [("s", i, v) for i, v in enumerate([1.0, 2.0, None, 3.0, 4.0, NAN, 5.0])]
    runs = calibration.series_runs(spark.createDataFrame(points, "s string, b int, v double"), ["s"], "b", "v").collect()
    assert sorted((r.start, r.end, r.length, r.is_longest) for r in runs) == [(0, 1, 2, True), (3, 4, 2, False), (6, 6, 1, False)]


@pytest.mark.parametrize("size", [2, 9, 20])
def test_ensembles_of_any_size_are_scored_whole(spark, size):
    rng = np.random.default_rng(size)
    fields = {f"f{i:02d}": rng.uniform(0, 60, 4).round(1).tolist() for i in range(size + 5)}
    grids, blocks, _ = make_grid(spark, [1, 2], [3, 4], fields)
    issued = forecast.lagged_ensemble(grids, size, (10,))
    rows = verify.verify(issued, grids, blocks).join(issued.select("nowcast_id", "members"), "nowcast_id").where(F.size("members") == size).collect()
    assert rows
    for r in rows:
        m, y = np.array([fields[k] for k in r.members], dtype=np.float32).astype(float), np.array(fields[r.observation_file_key], dtype=np.float32).astype(float)
        p = (m >= 35).mean(0)
        spread = np.abs(m[:, None] - m[None]).sum((0, 1)) / (2 * size * (size - 1))
        assert r.ensemble_size == size and r.brier_score == pytest.approx(((p - (y >= 35)) ** 2).mean())
        assert r.crps == pytest.approx((np.abs(m - y).mean(0) - spread).mean())
        assert r.mae == pytest.approx(np.abs(m.mean(0) - y).mean()) and sum(b["count"] for b in r.reliability_bins) == 4
    aligned = spark.createDataFrame([(1, m[:, k].tolist(), float(y[k])) for k in range(4)], "pair_id int, members array<double>, observed double")
    again = verify.score_probabilistic(aligned).first()
    assert (again.ensemble_size, again.brier_score, again.crps) == (size, pytest.approx(r.brier_score), pytest.approx(r.crps))


def test_one_member_is_no_ensemble(spark):
    grids, blocks, _ = make_grid(spark, [1, 2], [3, 4], {f"f{i}": [40] * 4 for i in range(9)})
    rows = verify.verify(forecast.lagged_ensemble(grids, 1, (10,)), grids, blocks).collect()
    assert rows and all(r.ensemble_size == 1 and r.brier_score is None and r.crps is None and r.reliability_bins is None for r in rows)


def verification_rows(rng, n, since=0):
    rows = []
    for _ in range(n):
        ensemble = rng.random() < 0.4
        rows.append((
            rng.choice(["persistence", "advection"]), rng.choice([10, 30]), rng.choice("PQ"), "L", START + timedelta(seconds=since + rng.randrange(90_000)),
            rng.choice([0, 3, 50]), rng.uniform(0, 5), rng.uniform(-2, 2), rng.uniform(0, 9), *[rng.randrange(9) for _ in range(4)],
            rng.choice([35.0, 35.0, None, 40.0]), 8 if ensemble else None, rng.random() if ensemble else None, rng.random() if ensemble else None,
        ))
    return rows


VERIFICATIONS = (
    "algorithm string, horizon int, product string, level string, verified_at timestamp, sample_count bigint, mae double, bias double, rmse double, hits bigint, "
    "misses bigint, false_alarms bigint, correct_negatives bigint, threshold_dbz double, ensemble_size int, brier_score double, crps double"
)


def test_series_of_a_rollup_equal_the_direct_ones_and_late_rows_add_to_their_cell(spark):
    rng = random.Random(8)
    first, late = verification_rows(rng, 400), verification_rows(rng, 40)
    whole = spark.createDataFrame([*first, *late], VERIFICATIONS)
    parts = [calibration.calibration_rollup(spark.createDataFrame(rows, VERIFICATIONS)) for rows in (first, late)]
    rollup = calibration.merge_rollups(parts[0].unionByName(parts[1]))
    assert rollup.count() == rollup.select(*calibration.ROLLUP_KEY).distinct().count()
    since = START + timedelta(hours=3)
    for width in (300, 3600, 86400):
        for choice in ({}, {"product": "P"}, {"since": since, "algorithm": "advection"}):
            want = calibration.calibration_series(whole, bucket_seconds=width, **choice).collect()
            for source in (rollup, parts[0].unionByName(parts[1])):
                got = calibration.series_of_rollup(source, width, **choice)
                assert len(want) > 0
                for g, w in zip(got.collect(), want, strict=True):
                    assert g.asDict().keys() == w.asDict().keys()
                    assert all(g[c] == (w[c] if not isinstance(w[c], float) else pytest.approx(w[c])) for c in w.asDict())
    for width in (0, 200, 450, 172800):
        with pytest.raises(ValueError):
            calibration.series_of_rollup(rollup, width)
    with pytest.raises(ValueError):
        calibration.series_of_rollup(rollup, 300, since=START + timedelta(seconds=7))
