"""The derivations of ``derived`` in SQL, and the glue that puts them before a query."""

from __future__ import annotations

# name: (tables it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "files": ((), """
        SELECT vec_id, 'frame-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS file_key, 'P' || (vec_id % 2) AS product,
               '00.50' AS level, 1704067200 + (vec_id // 2) * 120 AS valid_epoch,
               CAST(1000 + label * 10 AS BIGINT) AS size_bytes, embedding
        FROM embeddings"""),
    "grids": (("files",), "SELECT * FROM files WHERE vec_id % 10 <> 9"),
    "cells": (("grids",), """
        SELECT vec_id, file_key, product, level, valid_epoch, CAST(i AS BIGINT) AS idx, CAST(i // 8 AS BIGINT) AS row_i,
               CAST(i % 8 AS BIGINT) AS col_i, 30.0::DOUBLE + (i // 8) * 0.25::DOUBLE AS lat, -100.0::DOUBLE + (i % 8) * 0.25::DOUBLE AS lng,
               CASE WHEN (vec_id * 7 + i) % 41 = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE 20.0::DOUBLE + 120.0::DOUBLE * CAST(embedding[i + 1] AS DOUBLE) END AS value
        FROM grids, range(64) AS t(i)"""),
    "points": ((), """
        SELECT event_id AS point_id, 'P' || (event_id % 3) AS product,
               1704067200 - 300 + (event_id * 37) % (n * 60 + 10000) AS at_epoch,
               'frame-' || lpad(CAST(event_id % n AS VARCHAR), 6, '0') AS frame,
               29.875::DOUBLE + (user_id % 130) / 64.0::DOUBLE AS latitude,
               -100.125::DOUBLE + (event_id % 140) / 64.0::DOUBLE AS signed_lng
        FROM events, (SELECT max(vec_id) + 1 AS n FROM embeddings)"""),
    "alerts": ((), """
        SELECT o_orderkey AS k, 'A' || o_orderkey AS id, 'Storm ' || o_orderstatus AS event,
               CASE WHEN o_orderkey % 5 <> 0 THEN 'Headline ' || o_orderkey END AS headline,
               CASE WHEN o_orderkey % 10 <> 0 THEN 'Area ' || o_custkey END AS area_desc,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Extreme' WHEN '2' THEN 'Severe' WHEN '3' THEN 'Moderate'
                    WHEN '4' THEN 'Minor' ELSE 'Unknown' END AS severity,
               5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank,
               o_orderdate AS onset,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS expires,
               o_orderkey % 23 <> 0 AS mapped, o_orderkey % 3 = 1 AS triangle,
               -120.0::DOUBLE + o_custkey % 50 AS min_lng, 25.0::DOUBLE + o_orderkey % 20 AS min_lat,
               -120.0::DOUBLE + o_custkey % 50 + 1 + (o_orderkey % 4) * 0.5::DOUBLE AS max_lng,
               25.0::DOUBLE + o_orderkey % 20 + 1 + (o_custkey % 3) * 0.5::DOUBLE AS max_lat
        FROM orders"""),
    "devices": ((), """
        SELECT 'dev-' || c_custkey AS token, CASE WHEN c_custkey % 17 <> 0 THEN 25.5::DOUBLE + c_custkey % 24 END AS latitude,
               CASE WHEN c_custkey % 17 <> 0 THEN -123.5::DOUBLE + c_custkey % 58 END AS longitude
        FROM customer"""),
    "rules": ((), """
        SELECT p_partkey AS k, 'R' || p_partkey AS rule_id, 'S' || (p_partkey % 100) AS subscription_id,
               CASE WHEN p_partkey % 13 = 0 THEN 'paused' ELSE 'active' END AS status,
               (p_partkey // 8) % 2 = 0 AS is_point, 'P' || (p_partkey % 8) AS product,
               29.96875::DOUBLE + (p_partkey % 70) * 0.03125::DOUBLE AS lat, -100.0::DOUBLE + (p_partkey % 64) * 0.03125::DOUBLE AS lng,
               -100.0625::DOUBLE + (p_partkey % 5) * 0.25::DOUBLE AS x0, 29.9375::DOUBLE + (p_partkey % 3) * 0.25::DOUBLE AS y0,
               0.5::DOUBLE + (p_partkey % 4) * 0.25::DOUBLE AS w, 0.5::DOUBLE + (p_partkey % 6) * 0.25::DOUBLE AS h,
               ['max', 'mean', 'min', 'count_ge'][(p_partkey // 16) % 4 + 1] AS reducer,
               ['>', '>=', '<', '<=', '==', '!='][(p_partkey // 3) % 6 + 1] AS op,
               CASE WHEN (p_partkey // 8) % 2 <> 0 AND (p_partkey // 16) % 4 = 3 THEN CAST(p_partkey % 9 AS DOUBLE)
                    ELSE 10.0::DOUBLE + p_partkey % 30 END AS threshold,
               CASE WHEN p_partkey % 11 <> 0 THEN 25.0::DOUBLE END AS count_threshold,
               p_partkey % 2 = 0 AS currently_firing, 1704067200 + p_partkey AS created_epoch
        FROM part"""),
    "rule_cells": (("rules",), """
        SELECT rule_id, row_i, col_i FROM (
            SELECT rule_id, row_i, col_i,
                   sum(CASE WHEN (py > lat) <> (qy > lat) AND (qx - px) * (lat - py) / (qy - py) + px > lng THEN 1 ELSE 0 END) AS crossings
            FROM (
                SELECT rule_id, x0 AS px, y0 AS py, x0 + w / 2 AS qx, y0 + h AS qy FROM rules WHERE NOT is_point
                UNION ALL SELECT rule_id, x0 + w, y0, x0, y0 FROM rules WHERE NOT is_point
                UNION ALL SELECT rule_id, x0 + w / 2, y0 + h, x0 + w, y0 FROM rules WHERE NOT is_point
            ) AS edges,
            (SELECT CAST(i // 8 AS BIGINT) AS row_i, CAST(i % 8 AS BIGINT) AS col_i,
                    30.0::DOUBLE + (i // 8) * 0.25::DOUBLE AS lat, -100.0::DOUBLE + (i % 8) * 0.25::DOUBLE AS lng
             FROM range(64) AS t(i)) AS centres
            WHERE py <> qy GROUP BY rule_id, row_i, col_i)
        WHERE crossings % 2 = 1"""),
    "polygon_reads": (("rules", "rule_cells", "cells"), """
        SELECT r.rule_id, c.file_key, min(c.valid_epoch) AS valid_epoch, any_value(r.reducer) AS reducer, count(*) AS cell_count,
               CASE any_value(r.reducer)
                    WHEN 'max' THEN max(c.value) WHEN 'mean' THEN avg(c.value)
                    WHEN 'min' THEN CASE WHEN bool_or(isnan(c.value)) THEN CAST('NaN' AS DOUBLE) ELSE min(c.value) END
                    ELSE CAST(count(*) FILTER (WHERE NOT isnan(c.value) AND c.value >= r.count_threshold) AS DOUBLE) END AS value
        FROM rules r JOIN cells c ON r.product = c.product JOIN rule_cells m
             ON m.rule_id = r.rule_id AND m.row_i = c.row_i AND m.col_i = c.col_i
        WHERE NOT r.is_point AND r.status = 'active'
        GROUP BY r.rule_id, c.file_key"""),
    "evals": (("rules", "grids", "cells", "polygon_reads"), """
        SELECT rule_id, file_key, valid_epoch, value, error_reason,
               CASE WHEN error_reason IS NOT NULL OR value IS NULL THEN false
                    WHEN isnan(value) THEN op = '!='
                    WHEN op = '>' THEN value > threshold WHEN op = '>=' THEN value >= threshold
                    WHEN op = '<' THEN value < threshold WHEN op = '<=' THEN value <= threshold
                    WHEN op = '==' THEN value = threshold ELSE value <> threshold END AS satisfied
        FROM (
            SELECT d.rule_id, d.file_key, d.valid_epoch, d.op, d.threshold,
                   CASE WHEN d.far THEN NULL ELSE c.value END AS value,
                   CASE WHEN d.far THEN 'out_of_domain' END AS error_reason
            FROM (
                SELECT r.*, g.file_key, g.valid_epoch,
                       least(7, greatest(0, floor((r.lat - 30.0::DOUBLE) / 0.25::DOUBLE + 0.5::DOUBLE))) AS row_i,
                       least(7, greatest(0, floor((r.lng + 100.0::DOUBLE) / 0.25::DOUBLE + 0.5::DOUBLE))) AS col_i,
                       abs(r.lat - (30.0::DOUBLE + least(7, greatest(0, floor((r.lat - 30.0::DOUBLE) / 0.25::DOUBLE + 0.5::DOUBLE))) * 0.25::DOUBLE)) > 0.05::DOUBLE
                       OR abs(r.lng - (-100.0::DOUBLE + least(7, greatest(0, floor((r.lng + 100.0::DOUBLE) / 0.25::DOUBLE + 0.5::DOUBLE))) * 0.25::DOUBLE)) > 0.05::DOUBLE AS far
                FROM rules r JOIN grids g ON r.product = g.product WHERE r.is_point AND r.status = 'active'
            ) d LEFT JOIN cells c ON c.file_key = d.file_key AND c.row_i = d.row_i AND c.col_i = d.col_i
            UNION ALL
            SELECT r.rule_id, g.file_key, g.valid_epoch, r.op, r.threshold,
                   CASE WHEN r.reducer = 'count_ge' AND r.count_threshold IS NULL THEN NULL ELSE p.value END,
                   CASE WHEN p.rule_id IS NULL AND NOT (r.reducer = 'count_ge' AND r.count_threshold IS NULL) THEN 'out_of_domain'
                        WHEN r.reducer = 'count_ge' AND r.count_threshold IS NULL THEN 'missing_threshold' END
            FROM rules r JOIN grids g ON r.product = g.product LEFT JOIN polygon_reads p
                 ON p.rule_id = r.rule_id AND p.file_key = g.file_key
            WHERE NOT r.is_point AND r.status = 'active')"""),
    "subscriptions": ((), """
        SELECT 'S' || s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS status,
               ['alerts.nws.new', 'mrms.files.new', 'mrms.grids.new', 'nowcast.grids.new']
                   [s_suppkey % 4 + 1 : s_suppkey % 4 + s_suppkey % 3 + 1] AS events,
               1704067200 + s_suppkey % 10 AS created_epoch
        FROM supplier"""),
    "deliveries": ((), """
        SELECT 'D' || o_orderkey AS id, 'S' || (o_custkey % 100) AS subscription_id,
               CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'retrying' END AS status,
               o_orderdate AS created_at
        FROM orders"""),
    "attempts": ((), """
        SELECT 'D' || (o_orderkey // 4) AS delivery_id, o_orderkey % 4 + 1 AS attempt,
               [NULL, 200, 404, 503, 301][o_custkey % 5 + 1] AS response_status
        FROM orders"""),
    "messages": ((), """
        SELECT event_id, ['alerts.nws.new', 'mrms.files.new', 'mrms.grids.new', 'nowcast.grids.new'][event_id % 4 + 1] AS event_type
        FROM events"""),
    "verifications": ((), """
        SELECT CASE l_returnflag WHEN 'A' THEN 'persistence' WHEN 'N' THEN 'advection' ELSE 'lagged-ensemble' END AS algorithm,
               CAST([10, 30, 60][l_linenumber % 3 + 1] AS BIGINT) AS horizon, 'P' || (l_suppkey % 2) AS product,
               CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS sample_count,
               l_discount * 100 AS mae, (l_tax - 0.04::DOUBLE) * 100 AS bias, l_discount * 120 AS rmse,
               CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_linenumber = 7 THEN 40.0::DOUBLE ELSE 35.0::DOUBLE END AS threshold_dbz,
               CAST(l_linenumber AS BIGINT) AS hits, l_partkey % 5 AS misses, l_suppkey % 4 AS false_alarms,
               l_partkey % 7 AS correct_negatives,
               CASE WHEN l_returnflag = 'R' THEN 8 END AS ensemble_size,
               CASE WHEN l_returnflag = 'R' THEN l_discount END AS brier_score,
               CASE WHEN l_returnflag = 'R' THEN l_tax * 10 END AS crps,
               CASE WHEN l_partkey % 17 = 0 THEN 8 WHEN l_partkey % 19 = 0 THEN 12 ELSE 10 END AS n_bins,
               l_partkey, l_suppkey, l_shipdate AS verified_at
        FROM lineitem"""),
    "calib": (("verifications",), """
        SELECT algorithm, horizon, count(*) AS verification_count, CAST(sum(sample_count) AS BIGINT) AS sample_count,
               CASE WHEN sum(sample_count) > 0 THEN sum(mae * sample_count) / sum(sample_count) ELSE 0 END AS mae_mean,
               CASE WHEN sum(sample_count) > 0 THEN sum(bias * sample_count) / sum(sample_count) ELSE 0 END AS bias_mean,
               CASE WHEN sum(sample_count) > 0 THEN sum(rmse * sample_count) / sum(sample_count) ELSE 0 END AS rmse_mean,
               CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses,
               CAST(sum(false_alarms) AS BIGINT) AS false_alarms, CAST(sum(correct_negatives) AS BIGINT) AS correct_negatives,
               CASE WHEN count(DISTINCT threshold_dbz) = 1 THEN max(threshold_dbz) END AS threshold_dbz,
               CASE WHEN count(DISTINCT ensemble_size) = 1 THEN CAST(max(ensemble_size) AS BIGINT) END AS ensemble_size,
               CAST(coalesce(sum(sample_count) FILTER (WHERE brier_score IS NOT NULL), 0) AS BIGINT) AS brier_sample_count,
               sum(brier_score * sample_count) / nullif(sum(sample_count) FILTER (WHERE brier_score IS NOT NULL), 0) AS brier_mean,
               sum(crps * sample_count) / nullif(sum(sample_count) FILTER (WHERE brier_score IS NOT NULL), 0) AS crps_mean,
               sum(hits) / nullif(sum(hits) + sum(misses), 0) AS pod,
               sum(false_alarms) / nullif(sum(hits) + sum(false_alarms), 0) AS far,
               sum(hits) / nullif(sum(hits) + sum(misses) + sum(false_alarms), 0) AS csi
        FROM verifications GROUP BY algorithm, horizon"""),
    "metric_rows": (("calib",), """
        SELECT algorithm, horizon, 'mae' AS metric, CAST(mae_mean AS DOUBLE) AS value FROM calib
        UNION ALL SELECT algorithm, horizon, 'pod', pod FROM calib UNION ALL SELECT algorithm, horizon, 'far', far FROM calib
        UNION ALL SELECT algorithm, horizon, 'csi', csi FROM calib UNION ALL SELECT algorithm, horizon, 'brier', brier_mean FROM calib
        UNION ALL SELECT algorithm, horizon, 'crps', crps_mean FROM calib"""),
    "reliability": (("verifications",), """
        SELECT algorithm, horizon, CAST(i AS BIGINT) AS bin, i / 10.0::DOUBLE AS lower,
               CAST(sum(CASE WHEN i < n_bins THEN (l_partkey + i) % 4 ELSE 0 END) AS BIGINT) AS "count",
               CAST(sum(CASE WHEN i < n_bins THEN least((l_partkey + i) % 4, (l_suppkey + i) % 3) ELSE 0 END) AS BIGINT) AS observed
        FROM verifications, range(10) AS t(i) WHERE ensemble_size IS NOT NULL
        GROUP BY algorithm, horizon, i"""),
    # Forecast rows and the grids within a minute of their validity.
    "pairs": (("grids",), """
        SELECT s.file_key AS source_file_key, s.product, CAST(h AS BIGINT) AS horizon, s.valid_epoch + h * 60 AS due_epoch,
               o.file_key AS observation_file_key, o.valid_epoch AS observation_epoch
        FROM grids s CROSS JOIN (VALUES (10), (30), (60)) AS t(h) JOIN grids o
             ON o.product = s.product AND abs(o.valid_epoch - (s.valid_epoch + h * 60)) <= 60"""),
    "history": (("grids",), """
        SELECT s.file_key AS source_file_key, m.file_key AS member_key, s.rn - m.rn AS ago
        FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY valid_epoch, file_key) AS rn FROM grids) s
        JOIN (SELECT *, row_number() OVER (PARTITION BY product ORDER BY valid_epoch, file_key) AS rn FROM grids) m
          ON m.product = s.product AND m.rn BETWEEN s.rn - 7 AND s.rn"""),
}


def with_tables(body: str, *tables: str) -> str:
    """``body`` preceded by the derived tables it names and whatever those need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in CTES[name][0]:
            add(needed)
        order.append(name)

    for name in tables:
        add(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()
