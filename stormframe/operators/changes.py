"""Change-aware upserts, retention and row checks.

The target of an upsert is joined to its batch on the keys; what comes out is the new table
with an ``action`` per row, to be written by the caller.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.operators.joins import cascade

INSERTED, UPDATED, UNCHANGED, KEPT = "inserted", "updated", "unchanged", "kept"


def latest_of_batch(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    payload = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_r"))
    return last.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in batch.columns])


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    mutable: Sequence[str],
    now: datetime | Column,
    batch_order: Sequence[str] | None = None,
    only_changed: bool = True,
) -> DataFrame:
    """Target after the batch: its columns and ``action`` (inserted, updated, unchanged, kept).

    ``updated_at`` moves only where a mutable column really differs (null-safe), or on every
    match when ``only_changed`` is off.  A key repeated in the batch counts once, by its last row.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    incoming = latest_of_batch(batch, keys, batch_order or [c for c in batch.columns if c not in keys])
    new = incoming.select(*keys, F.struct(*[c for c in batch.columns if c not in keys]).alias("_new"))
    old_columns = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*old_columns).alias("_old"))
    joined = old.join(new, list(keys), "full_outer")
    o, n = F.col("_old"), F.col("_new")
    differs = reduce(lambda a, b: a | b, [~o[c].eqNullSafe(n[c]) for c in mutable]) if only_changed else F.lit(True)
    action = (
        F.when(n.isNull(), F.lit(KEPT)).when(o.isNull(), F.lit(INSERTED)).when(differs, F.lit(UPDATED)).otherwise(F.lit(UNCHANGED))
    )
    rows = joined.withColumn("action", action)
    written = F.col("action").isin(INSERTED, UPDATED)

    def column(c: str) -> Column:
        if c == "updated_at":
            return F.when(written, at).otherwise(o[c]).alias(c)
        if c in mutable:
            return F.when(written, n[c]).otherwise(o[c]).alias(c)
        fresh = n[c] if c in batch.columns else (at if c in ("created_at", "discovered_at") else F.lit(None))
        return F.when(F.col("action") == INSERTED, fresh).otherwise(o[c]).alias(c)

    return rows.select(*[F.col(c) if c in keys else column(c) for c in target.columns], "action")


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n_rows"))


def new_keys(actions: DataFrame) -> DataFrame:
    """Rows whose key was seen for the first time."""
    return actions.where(F.col("action") == INSERTED).drop("action")


def patch(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the non-null columns of their change applied; other columns stay."""
    given = [c for c in changes.columns if c != key]
    patches = changes.select(key, F.struct(*given).alias("_patch"))
    out = df.join(patches, key, "left")
    return out.select(
        *[F.coalesce(F.col("_patch")[c], F.col(c)).alias(c) if c in given else F.col(c) for c in df.columns]
    )


# --- retention ---------------------------------------------------------------------------


def _before(now: datetime | Column, **span: int) -> Column:
    at = now if isinstance(now, Column) else F.lit(now)
    return at - F.make_dt_interval(**{k: F.lit(v) for k, v in span.items()})


def expired_files(files: DataFrame, hours: int, now: datetime | Column) -> DataFrame:
    if hours <= 0:
        raise ValueError("retention must be positive")
    return files.where(F.col("valid_at") < _before(now, hours=hours))


def prune_files(tables: Mapping[str, DataFrame], hours: int, now: datetime | Column) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, dropped) per table for files older than ``hours`` and everything derived from them.

    ``tables``: files, grids, nowcasts, verifications.
    """
    doomed = expired_files(tables["files"], hours, now)
    lost = {"files": doomed, **cascade(doomed, tables["grids"], tables["nowcasts"], tables["verifications"])}
    keys = {"files": ["file_key"], "grids": ["file_key"], "nowcasts": ["nowcast_id"],
            "verifications": ["nowcast_id", "observation_file_key"]}
    return {
        name: (tables[name].join(gone.select(*keys[name]).distinct(), keys[name], "left_anti"), gone)
        for name, gone in lost.items()
    }


def prune_alerts(alerts: DataFrame, days: int, now: datetime | Column) -> DataFrame:
    """Alerts not expired for ``days`` or more; no expiry means kept."""
    if days <= 0:
        raise ValueError("retention must be positive")
    return alerts.where(F.col("expires").isNull() | (F.col("expires") >= _before(now, days=days)))


def doomed_paths(doomed: DataFrame, grids: DataFrame, nowcasts: DataFrame, path: str = "path") -> DataFrame:
    """Distinct stored paths of the doomed files, observations before nowcasts."""
    keys = doomed.select("file_key").distinct()
    observed = grids.join(keys, "file_key", "left_semi").select(F.col(path).alias("path"), F.lit(0).alias("source"))
    forecast = nowcasts.join(keys.withColumnRenamed("file_key", "source_file_key"), "source_file_key", "left_semi")
    both = observed.unionByName(forecast.select(F.col(path).alias("path"), F.lit(1).alias("source")))
    return both.groupBy("path").agg(F.min("source").alias("source")).orderBy("source", "path")


def prune_summary(batches: DataFrame) -> DataFrame:
    """Totals of per-batch counters (every numeric column but the batch number)."""
    counters = [f.name for f in batches.schema.fields if f.name != "batch" and f.dataType.typeName() in ("integer", "long")]
    return batches.agg(F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters])


# --- row checks ------------------------------------------------------------------------------


def with_violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add ``violations``: names of the checks a row breaks.  As in SQL, an unknown check passes."""
    named = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in checks.items()]
    return df.withColumn("violations", F.array_compact(F.array(*named)))


def validate(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``violations``)."""
    checked = with_violations(df, checks)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def _in_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    c = F.col(column)
    if low is not None and high is not None:
        return c.between(low, high)
    return c >= low if low is not None else c <= high


# Table constraints.
OBSERVATION_RANGES = {
    "wind_speed_kt": (0, None),
    "wind_gust_kt": (0, None),
    "visibility_sm": (0, None),
    "wind_direction_deg": (0, 360),
}
NOWCAST_RANGES = {"horizon": (1, None), "ensemble_size": (1, None)}
VERIFICATION_RANGES = {
    "sample_count": (0, None),
    "hits": (0, None),
    "misses": (0, None),
    "false_alarms": (0, None),
    "correct_negatives": (0, None),
    "ensemble_size": (1, None),
}
DEVICE_RANGES = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0)}


def range_checks(ranges: Mapping[str, tuple], df: DataFrame) -> dict[str, Column]:
    return {f"{c}_range": _in_range(c, low, high) for c, (low, high) in ranges.items() if c in df.columns}
