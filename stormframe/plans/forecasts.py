"""Nowcasts and their verification."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.operators import forecast, joins, verify
from stormframe.operators.catalog import filter_nowcasts as filter_catalog_nowcasts
from stormframe.operators.grid import explode_cells
from stormframe.plans.derived import Tables
from stormframe.plans.registry import big, epoch, query, rounded


@query(
    "persistence_nowcasts",
    "SELECT file_key AS source_file_key, CAST(h AS BIGINT) AS horizon, valid_epoch + h * 60 AS valid_epoch, 1 AS members FROM grids, (VALUES (10), (30), (60)) t(h)",
    ("grids",),
)
def persistence_nowcasts(t: Tables) -> DataFrame:
    rows = forecast.persistence(t.grids())
    return rows.select("source_file_key", big("horizon"), epoch("valid_at", "valid_epoch"), F.size("members").cast("long").alias("members"))


@query(
    "lagged_ensemble_nowcasts",
    """SELECT source_file_key, CAST(h AS BIGINT) AS horizon, count(*) AS ensemble_size, string_agg(member_key, ',' ORDER BY ago DESC) AS members
       FROM history, (VALUES (10), (30), (60)) t(h) GROUP BY source_file_key, h""",
    ("history",),
)
def lagged_ensemble_nowcasts(t: Tables) -> DataFrame:
    rows = forecast.lagged_ensemble(t.grids())
    return rows.select("source_file_key", big("horizon"), big("ensemble_size"), F.concat_ws(",", "members").alias("members"))


@query(
    "filter_nowcasts",
    """SELECT file_key AS source_file_key, valid_epoch + 1800 AS valid_epoch FROM grids WHERE product = 'P1'
       AND valid_epoch + 1800 >= 1704067200 + 7200 AND valid_epoch + 1800 < 1704067200 + 14400""",
    ("grids",),
)
def filter_nowcasts(t: Tables) -> DataFrame:
    both = forecast.persistence(t.grids()).unionByName(forecast.lagged_ensemble(t.grids()))
    start = datetime(2024, 1, 1, tzinfo=UTC)
    kept = filter_catalog_nowcasts(
        both, "P1", "00.50", "persistence", 30, start + timedelta(hours=2), start + timedelta(hours=4)
    )
    return kept.select("source_file_key", epoch("valid_at", "valid_epoch"))


@query(
    "match_forecasts",
    "SELECT source_file_key, horizon, observation_file_key, observation_epoch FROM pairs",
    ("pairs",),
)
def match_forecasts(t: Tables) -> DataFrame:
    pairs = joins.match_forecasts(forecast.persistence(t.grids()), t.grids())
    return pairs.select("source_file_key", big("horizon"), "observation_file_key", epoch("observation_valid_at", "observation_epoch"))


@query(
    "align_cells",
    """SELECT p.source_file_key, p.observation_file_key, count(*) AS n_cells,
              count(*) FILTER (WHERE NOT isnan(f.value) AND NOT isnan(o.value)) AS n_valid
       FROM pairs p JOIN cells f ON f.file_key = p.source_file_key JOIN cells o ON o.file_key = p.observation_file_key AND o.idx = f.idx
       GROUP BY p.source_file_key, p.observation_file_key""",
    ("pairs", "cells"),
)
def align_cells(t: Tables) -> DataFrame:
    aligned = _aligned(t)
    both = ~F.isnan("forecast") & ~F.isnan("observed")
    return (
        aligned.groupBy("pair_id")
        .agg(F.count("*").alias("n_cells"), F.count_if(both).alias("n_valid"))
        .select(F.col("pair_id.source_file_key"), F.col("pair_id.observation_file_key"), "n_cells", "n_valid")
    )


def _aligned(t: Tables) -> DataFrame:
    """Persistence cells beside the cells they are due at; each pair of frames has one lead time."""
    pairs = joins.match_forecasts(forecast.persistence(t.grids()), t.grids())
    pair_id = F.struct("source_file_key", "observation_file_key").alias("pair_id")
    cells = explode_cells(t.blocks(), extra=())

    def side(key: str) -> DataFrame:
        return pairs.select(pair_id, F.col(key).alias("file_key")).join(cells, "file_key").select("pair_id", "row_i", "col_i", "value")

    return joins.align_cells(side("source_file_key"), side("observation_file_key"))


_DETERMINISTIC = """
    SELECT p.source_file_key, p.horizon, p.observation_file_key, count(d) AS sample_count,
           round(coalesce(avg(abs(d)), 0), 6) AS mae, round(coalesce(avg(d), 0), 6) + 0 AS bias, round(coalesce(sqrt(avg(d * d)), 0), 6) AS rmse,
           count(*) FILTER (WHERE d IS NOT NULL AND f >= 35 AND o >= 35) AS hits, count(*) FILTER (WHERE d IS NOT NULL AND f < 35 AND o >= 35) AS misses,
           count(*) FILTER (WHERE d IS NOT NULL AND f >= 35 AND o < 35) AS false_alarms,
           count(*) FILTER (WHERE d IS NOT NULL AND f < 35 AND o < 35) AS correct_negatives
    FROM (SELECT p.*, f.value AS f, o.value AS o, CASE WHEN NOT isnan(f.value) AND NOT isnan(o.value) THEN f.value - o.value END AS d
          FROM pairs p JOIN {fields} f ON f.file_key = p.source_file_key JOIN cells o ON o.file_key = p.observation_file_key AND o.idx = f.idx) p
    GROUP BY p.source_file_key, p.horizon, p.observation_file_key"""


def _scores(rows: DataFrame, *extra: object) -> DataFrame:
    return rows.select(
        "source_file_key", big("horizon"), "observation_file_key", "sample_count", rounded("mae"), rounded("bias"), rounded("rmse"),
        "hits", "misses", "false_alarms", "correct_negatives", *extra,
    )


def _verified(nowcasts: DataFrame, t: Tables, fields: DataFrame | None = None) -> DataFrame:
    rows = verify.verify(nowcasts, t.grids(), t.blocks(), fields)
    return rows.join(nowcasts.select("nowcast_id", "source_file_key"), "nowcast_id")


@query("verify_persistence", _DETERMINISTIC.format(fields="cells"), ("pairs", "cells"))
def verify_persistence(t: Tables) -> DataFrame:
    return _scores(_verified(forecast.persistence(t.grids()), t))


@query(
    "score_deterministic",
    f"SELECT source_file_key, observation_file_key, sample_count, mae, bias, rmse, hits FROM ({_DETERMINISTIC.format(fields='cells')})",
    ("pairs", "cells"),
)
def score_deterministic(t: Tables) -> DataFrame:
    scored = verify.score_deterministic(_aligned(t))
    return scored.select(
        "pair_id.source_file_key", "pair_id.observation_file_key", "sample_count", rounded("mae"), rounded("bias"), rounded("rmse"), "hits"
    )


# The oracle states CRPS by its definition, over all pairs of members.
_ENSEMBLE = """
    WITH stacks AS MATERIALIZED (
        SELECT h.source_file_key, c.idx, list(c.value ORDER BY h.ago DESC) AS m, bool_and(NOT isnan(c.value)) AS whole,
               avg(c.value) FILTER (WHERE NOT isnan(c.value)) AS f,
               avg(CASE WHEN NOT isnan(c.value) AND c.value >= 35 THEN 1.0::DOUBLE ELSE 0 END) AS p, count(*) AS n
        FROM history h JOIN cells c ON c.file_key = h.member_key GROUP BY h.source_file_key, c.idx),
    spread AS MATERIALIZED (
        SELECT source_file_key, idx, CASE WHEN max(n) > 1 THEN sum(abs(a - b)) / (2 * max(n) * (max(n) - 1)) ELSE 0 END AS spread
        FROM (SELECT source_file_key, idx, n, a, unnest(m) AS b FROM (SELECT source_file_key, idx, n, m, unnest(m) AS a FROM stacks WHERE whole))
        GROUP BY source_file_key, idx),
    scored AS MATERIALIZED (
        SELECT q.source_file_key, q.horizon, q.observation_file_key, s.n, o.value AS o, s.f,
               CASE WHEN s.f IS NOT NULL AND NOT isnan(o.value) THEN s.f - o.value END AS d,
               CASE WHEN s.whole AND s.n > 1 AND NOT isnan(o.value) THEN s.p END AS p,
               list_avg(list_transform(s.m, lambda x: abs(x - o.value))) - x.spread AS crps
        FROM pairs q JOIN stacks s ON s.source_file_key = q.source_file_key
        JOIN cells o ON o.file_key = q.observation_file_key AND o.idx = s.idx
        LEFT JOIN spread x ON x.source_file_key = s.source_file_key AND x.idx = s.idx)"""


@query(
    "verify_lagged_ensemble",
    f"""SELECT * FROM ({_ENSEMBLE}
        SELECT source_file_key, horizon, observation_file_key, count(d) AS sample_count, round(coalesce(avg(abs(d)), 0), 6) AS mae,
               round(coalesce(avg(d), 0), 6) + 0 AS bias, round(coalesce(sqrt(avg(d * d)), 0), 6) AS rmse,
               count(*) FILTER (WHERE d IS NOT NULL AND f >= 35 AND o >= 35) AS hits, count(*) FILTER (WHERE d IS NOT NULL AND f < 35 AND o >= 35) AS misses,
               count(*) FILTER (WHERE d IS NOT NULL AND f >= 35 AND o < 35) AS false_alarms,
               count(*) FILTER (WHERE d IS NOT NULL AND f < 35 AND o < 35) AS correct_negatives,
               max(n) AS ensemble_size,
               CASE WHEN max(n) > 1 THEN round(coalesce(avg((p - CASE WHEN o >= 35 THEN 1 ELSE 0 END) ** 2) FILTER (WHERE p IS NOT NULL), 0), 12) END AS brier_score,
               CASE WHEN max(n) > 1 THEN round(coalesce(avg(crps) FILTER (WHERE p IS NOT NULL), 0), 6) + 0 END AS crps
        FROM scored GROUP BY source_file_key, horizon, observation_file_key)""",
    ("history", "pairs", "cells"),
)
def verify_lagged_ensemble(t: Tables) -> DataFrame:
    rows = _verified(forecast.lagged_ensemble(t.grids()), t)
    # Brier means are dyadic, so six digits would round exact halves.
    return _scores(rows, big("ensemble_size"), F.round("brier_score", 12).alias("brier_score"), rounded("crps"))


@query(
    "reliability_bins",
    f"""SELECT * FROM ({_ENSEMBLE}
        SELECT source_file_key, horizon, observation_file_key, CAST(bin AS BIGINT) AS bin, count(*) AS "count",
               count(*) FILTER (WHERE o >= 35) AS observed, round(avg(p), 6) AS mean_prob
        FROM (SELECT *, (p >= 0.1::DOUBLE)::INT + (p >= 0.2::DOUBLE)::INT + (p >= 0.30000000000000004::DOUBLE)::INT + (p >= 0.4::DOUBLE)::INT
                        + (p >= 0.5::DOUBLE)::INT + (p >= 0.6000000000000001::DOUBLE)::INT + (p >= 0.7000000000000001::DOUBLE)::INT
                        + (p >= 0.8::DOUBLE)::INT + (p >= 0.9::DOUBLE)::INT AS bin FROM scored WHERE p IS NOT NULL)
        GROUP BY source_file_key, horizon, observation_file_key, bin)""",
    ("history", "pairs", "cells"),
)
def reliability_bins(t: Tables) -> DataFrame:
    rows = _verified(forecast.lagged_ensemble(t.grids()), t)
    bins = rows.select("source_file_key", big("horizon"), "observation_file_key", F.posexplode("reliability_bins").alias("bin", "b"))
    return bins.where("b.count > 0").select(
        "source_file_key", "horizon", "observation_file_key", big("bin"), "b.count", "b.observed", rounded("mean_prob", F.col("b.mean_prob"))
    )


# Shifts within the frame, read past the rim by repeating it.  Blocks of 4 x 4 have one level; its
# window grows from three cells until it holds the best shift inside, or all shifts.
_MOTION = """
    WITH frames AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY product ORDER BY valid_epoch, file_key) AS rn FROM grids),
    steps AS MATERIALIZED (
        SELECT s.file_key AS source_file_key, a.file_key AS earlier, b.file_key AS later FROM frames s
        JOIN frames b ON b.product = s.product AND b.rn IN (s.rn, s.rn - 1) JOIN frames a ON a.product = s.product AND a.rn = b.rn - 1
        WHERE s.rn >= 3),
    floored AS MATERIALIZED (
        SELECT file_key, row_i, col_i, CASE WHEN NOT isnan(value) AND value >= 5 THEN value ELSE 5.0::DOUBLE END AS v FROM cells),
    errors AS MATERIALIZED (
        SELECT s.earlier, s.later, n.row_i // 4 AS br, n.col_i // 4 AS bc, dr, dc, sum((n.v - e.v) ** 2) AS err
        FROM (SELECT DISTINCT earlier, later FROM steps) s JOIN floored n ON n.file_key = s.later, range(-7, 8) x(dr), range(-7, 8) y(dc)
        JOIN floored e ON e.file_key = s.earlier AND e.row_i = least(7, greatest(0, n.row_i - dr)) AND e.col_i = least(7, greatest(0, n.col_i - dc))
        GROUP BY ALL),
    tried AS MATERIALIZED (
        SELECT source_file_key, br, bc, w, dr, dc, row_number() OVER (PARTITION BY source_file_key, br, bc, w ORDER BY err, dr * dr + dc * dc, dr, dc) AS place
        FROM (SELECT s.source_file_key, br, bc, dr, dc, round(sum(err), 6) AS err FROM steps s JOIN errors e USING (earlier, later) GROUP BY ALL),
             range(3, 8) t(w) WHERE greatest(abs(dr), abs(dc)) <= w),
    motion AS MATERIALIZED (
        SELECT source_file_key, br, bc, arg_min(dr, w) AS dr, arg_min(dc, w) AS dc FROM tried
        WHERE place = 1 AND (w = 7 OR greatest(abs(dr), abs(dc)) < w) GROUP BY ALL)"""


@query(
    "block_motion",
    f"SELECT * FROM ({_MOTION} SELECT source_file_key, br AS block_row, bc AS block_col, dr AS d_row, dc AS d_col FROM motion)",
    ("grids", "cells"),
)
def block_motion(t: Tables) -> DataFrame:
    rows = forecast.block_motion(t.grids(), t.blocks())
    return rows.select("source_file_key", big("block_row"), big("block_col"), big("d_row"), big("d_col"))


def _advected(t: Tables) -> tuple[DataFrame, DataFrame]:
    motion = forecast.block_motion(t.grids(), t.blocks())
    nowcasts = forecast.advection(t.grids(), motion)
    return nowcasts, forecast.advection_blocks(nowcasts, motion, t.grids(), t.blocks())


_ADVECTED = f"""{_MOTION}, moved AS MATERIALIZED (
        SELECT m.source_file_key, h AS horizon, p.row_i, p.col_i, CASE WHEN f.v > 5 + 1e-6 THEN f.v END AS v
        FROM motion m, (VALUES (10), (30), (60)) t(h) JOIN (SELECT i // 8 AS row_i, i % 8 AS col_i FROM range(64) r(i)) p
             ON p.row_i // 4 = m.br AND p.col_i // 4 = m.bc
        LEFT JOIN floored f ON f.file_key = m.source_file_key AND f.row_i = p.row_i - m.dr * (h // 2) AND f.col_i = p.col_i - m.dc * (h // 2))"""


@query(
    "advection_cells",
    f"""SELECT * FROM ({_ADVECTED} SELECT source_file_key, CAST(horizon AS BIGINT) AS horizon, CAST(row_i // 4 AS BIGINT) AS block_row,
               CAST(col_i // 4 AS BIGINT) AS block_col, count(v) AS echoes, round(coalesce(sum(v), 0), 4) + 0 AS total
        FROM moved GROUP BY source_file_key, horizon, row_i // 4, col_i // 4)""",
    ("grids", "cells"),
)
def advection_cells(t: Tables) -> DataFrame:
    nowcasts, fields = _advected(t)
    cells = fields.join(nowcasts.select("forecast_key", "source_file_key", "horizon"), "forecast_key").select(
        "source_file_key", big("horizon"), big("block_row"), big("block_col"), F.explode(F.col("members")[0]).alias("v")
    )
    echo = ~F.isnan("v")
    return cells.groupBy("source_file_key", "horizon", "block_row", "block_col").agg(
        F.count_if(echo).alias("echoes"), F.round(F.coalesce(F.sum(F.when(echo, F.col("v"))), F.lit(0.0)), 4).alias("total")
    )


@query(
    "verify_advection",
    f"""SELECT * FROM ({_ADVECTED}, fields AS MATERIALIZED (
            SELECT source_file_key, horizon, row_i, col_i, v FROM moved
            UNION ALL SELECT c.file_key, h, c.row_i, c.col_i, CASE WHEN NOT isnan(c.value) THEN c.value END FROM cells c, (VALUES (10), (30), (60)) t(h)
            WHERE c.file_key IN (SELECT file_key FROM frames WHERE rn < 3))
        SELECT q.source_file_key, q.horizon, q.observation_file_key, count(d) AS sample_count, round(coalesce(avg(abs(d)), 0), 6) AS mae,
               round(coalesce(avg(d), 0), 6) + 0 AS bias, round(coalesce(sqrt(avg(d * d)), 0), 6) AS rmse,
               count(*) FILTER (WHERE d IS NOT NULL AND f >= 35 AND o >= 35) AS hits, count(*) FILTER (WHERE d IS NOT NULL AND f < 35 AND o >= 35) AS misses,
               count(*) FILTER (WHERE d IS NOT NULL AND f >= 35 AND o < 35) AS false_alarms,
               count(*) FILTER (WHERE d IS NOT NULL AND f < 35 AND o < 35) AS correct_negatives
        FROM (SELECT p.*, f.v AS f, o.value AS o, CASE WHEN NOT isnan(o.value) THEN f.v - o.value END AS d
              FROM pairs p JOIN fields f ON f.source_file_key = p.source_file_key AND f.horizon = p.horizon
              JOIN cells o ON o.file_key = p.observation_file_key AND o.row_i = f.row_i AND o.col_i = f.col_i) q
        GROUP BY q.source_file_key, q.horizon, q.observation_file_key)""",
    ("grids", "cells", "pairs"),
)
def verify_advection(t: Tables) -> DataFrame:
    nowcasts, fields = _advected(t)
    return _scores(_verified(nowcasts, t, fields))


def _median(members):
    return np.median(members, axis=0)


@query(
    "plugin_median_forecaster",
    """SELECT source_file_key, CAST(idx // 32 AS BIGINT) AS block_row, CAST((idx % 8) // 4 AS BIGINT) AS block_col,
              count(m) AS n_finite, round(coalesce(sum(m), 0), 4) + 0 AS total
       FROM (SELECT h.source_file_key, c.idx, CASE WHEN NOT bool_or(isnan(c.value)) THEN median(c.value) END AS m
             FROM history h JOIN cells c ON c.file_key = h.member_key GROUP BY h.source_file_key, c.idx)
       GROUP BY source_file_key, idx // 32, (idx % 8) // 4""",
    ("history", "cells"),
)
def plugin_median_forecaster(t: Tables) -> DataFrame:
    issued = forecast.lagged_ensemble(t.grids(), horizons=(10,))
    made = forecast.apply_forecaster(forecast.member_blocks(issued, t.blocks()), _median, "median")
    cells = made.join(issued.select("forecast_key", "source_file_key"), "forecast_key").select(
        "source_file_key", big("block_row"), big("block_col"), F.explode(F.col("members")[0]).alias("v")
    )
    known = ~F.isnan("v")
    return cells.groupBy("source_file_key", "block_row", "block_col").agg(
        F.count_if(known).alias("n_finite"), F.round(F.coalesce(F.sum(F.when(known, F.col("v"))), F.lit(0.0)), 4).alias("total")
    )
