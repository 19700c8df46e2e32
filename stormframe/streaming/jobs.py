"""Streaming jobs.

Stateful steps are keyed and bounded by a watermark; what needs exact history reads the
target table inside ``foreachBatch``.  Writes are keyed by batch id, so a replayed batch
replaces its own output; what replaces earlier rows is read by key, the latest batch first.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stormframe.functions.scores import DEFAULT_THRESHOLD
from stormframe.operators.calibration import GROUP, pod_far_csi, series_aggregates
from stormframe.operators.catalog import filter_catalog, frame_history, newest, unmaterialised_files
from stormframe.operators.forecast import HORIZONS, persistence
from stormframe.operators.joins import MATCH_WINDOW_SECONDS, match_forecasts
from stormframe.operators.verify import verify
from stormframe.session import scratch_folder
from stormframe.streaming.state import frame_histories

#: A stored nowcast lies under the hour it falls due; a batch names at most so many hours one by one.
DUE_KEYS = 2000
HOUR = 3600

BatchFn = Callable[[DataFrame, int], None]


def run_available(stream: DataFrame, each: BatchFn, checkpoint: str, mode: str = "append", waits: bool = False) -> StreamingQuery:
    """Process what has arrived and stop.

    A stream that ``waits`` by the clock always asks for another batch; it gets none without input.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(not waits and before == "true").lower())
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> BatchFn:
    """Write each micro-batch under ``batch=<id>``; a replay overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(
    spark: SparkSession,
    stream: DataFrame,
    name: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
    key: Sequence[str] | None = None,
    waits: bool = False,
) -> DataFrame:
    """Run a stream to the end of its input into a scratch table and return the table.

    With ``key``, later batches replace the rows of their keys, as update mode means them to.
    """
    folder = scratch_folder(spark, name)
    run_available(stream, batch_writer(f"{folder}/out", transform), f"{folder}/checkpoint", mode, waits).awaitTermination()
    table = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return table if key is None else latest_rows(table, key)


def latest_rows(table: DataFrame, key: Sequence[str], batch: str = "batch") -> DataFrame:
    """The row of each key that the last batch holding it wrote; batches carry one row per key."""
    rest = [c for c in table.columns if c not in (*key, batch)]
    if not rest:
        return table.select(*key).distinct()
    last = table.groupBy(*key).agg(F.max_by(F.struct(*rest), batch).alias("_r"))
    return last.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def first_seen(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """One row per new key within the watermark; repeats are silent.

    Keys are forgotten past the delay; ``only_unknown`` makes the result exact.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def only_unknown(known: Callable[[], DataFrame], key: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Batch step that drops the keys the target table already holds."""

    def step(batch: DataFrame) -> DataFrame:
        return batch.join(known().select(*key), list(key), "left_anti")

    return step


def nowcast_stream(
    stream: DataFrame,
    forecast: Callable[[DataFrame, Sequence[int]], DataFrame] = persistence,
    horizons: Sequence[int] = HORIZONS,
    history: int = 1,
    stored: DataFrame | None = None,
    grids: Callable[[], DataFrame] | None = None,
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """A grid stream and the batch step that turns new grids into nowcast rows.

    With a ``history`` of more than one frame, ``forecast`` gets frames that carry it
    (``ensemble_of_history``), from the stream's state; ``stored`` frames seed it.  The table behind
    ``grids`` is read only for frames that come after names before them were forgotten.
    """
    if history <= 1:
        return stream, lambda batch: forecast(batch, horizons)

    def step(batch: DataFrame) -> DataFrame:
        known = batch.where("exact")
        if grids is not None:
            late = batch.where("NOT exact")
            groups = [(r["product"], r["level"], r["upto"]) for r in late.groupBy("product", "level").agg(F.max("valid_at").alias("upto")).collect()]
            for product, level, upto in groups:
                table = filter_catalog(grids(), product, level).where(F.col("valid_at") <= F.lit(upto))
                whole = table.unionByName(late.join(table, "file_key", "left_anti").where((F.col("product") == product) & (F.col("level") == level)), allowMissingColumns=True)
                again = frame_history(whole.select("file_key", "product", "level", "valid_at", "n_rows", "n_cols"), history)
                known = known.unionByName(again.join(late.select("file_key"), "file_key", "left_semi").withColumn("exact", F.lit(True)))
        else:
            known = batch
        return forecast(known, horizons)

    return frame_histories(stream, history, stored), step


def write_nowcasts(nowcasts: DataFrame, path: str, mode: str = "append") -> None:
    """Store nowcast rows under product, level and the day and hour they fall due."""
    hour = F.date_format("valid_at", "HH")
    due = nowcasts.withColumns({"due_day": F.date_format("valid_at", "yyyy-MM-dd"), "due_hour": hour})
    due.write.mode(mode).partitionBy("product", "level", "due_day", "due_hour").parquet(path)


def due_nowcasts(spark: SparkSession, path: str, schema: str, seconds: int = MATCH_WINDOW_SECONDS) -> Callable[[DataFrame], DataFrame]:
    """For a batch of grids, the stored nowcasts that may fall due with it.

    The batch's few products, levels and hours become filters on partition columns, so only their
    folders are listed and read, whatever the table holds.  A batch over more than ``DUE_KEYS``
    hours is given the range of days of each product and level instead.
    """

    def of(batch: DataFrame) -> DataFrame:
        at = F.unix_timestamp("valid_at")
        hours = F.sequence(F.floor((at - seconds) / HOUR), F.floor((at + seconds) / HOUR))
        keys = batch.select("product", "level", F.explode(hours).alias("hour")).distinct()
        found = keys.limit(DUE_KEYS + 1).collect()
        table = spark.read.schema(schema).parquet(path)
        wanted: list[Column] = []
        if len(found) > DUE_KEYS:
            day = F.date_format(F.timestamp_seconds(F.col("hour") * HOUR), "yyyy-MM-dd")
            for r in keys.groupBy("product", "level").agg(F.min(day).alias("first"), F.max(day).alias("last")).collect():
                wanted.append(_in_group(r) & F.col("due_day").between(r["first"], r["last"]))
        else:
            days: dict[tuple, list[str]] = {}
            for r in found:
                moment = datetime.fromtimestamp(r["hour"] * HOUR, UTC)
                days.setdefault((r["product"], r["level"], f"{moment:%Y-%m-%d}"), []).append(f"{moment:%H}")
            for (product, level, day), names in sorted(days.items()):
                wanted.append(_in_group({"product": product, "level": level}) & (F.col("due_day") == day) & F.col("due_hour").isin(names))
        return table.where(functools.reduce(operator.or_, wanted, F.lit(False)))

    return of


def _in_group(row: Mapping[str, str]) -> Column:
    return (F.col("product") == row["product"]) & (F.col("level") == row["level"])


def verify_stream(
    nowcasts: DataFrame,
    observations: DataFrame,
    seconds: int = MATCH_WINDOW_SECONDS,
    delay: str = "2 hours",
    by: Sequence[str] = ("product", "level"),
) -> DataFrame:
    """Stream-stream interval join of forecasts and the grids that verify them.

    Either side may come first, so forecasts that arrive after their observation are matched
    too while the watermark allows.
    """
    seen = observations.withWatermark("valid_at", delay)
    said = nowcasts.withWatermark("valid_at", delay)
    bucket = F.floor(F.unix_timestamp("valid_at") / max(seconds, 1))
    left = said.withColumn("_bucket", F.explode(F.array(*[bucket + d for d in (-1, 0, 1)])))
    right = seen.select(
        *[F.col(c).alias(f"_o_{c}") for c in by],
        F.col("file_key").alias("observation_file_key"),
        F.col("valid_at").alias("observation_valid_at"),
        bucket.alias("_o_bucket"),
    )
    within = F.expr(
        f"observation_valid_at >= valid_at - interval {seconds} seconds"
        f" and observation_valid_at <= valid_at + interval {seconds} seconds"
    )
    same = F.col("_bucket") == F.col("_o_bucket")
    for c in by:
        same = same & (F.col(c) == F.col(f"_o_{c}"))
    return left.join(right, same & within).drop("_bucket", "_o_bucket", *[f"_o_{c}" for c in by])


def verify_batch(nowcasts: Callable[[DataFrame], DataFrame], seconds: int = MATCH_WINDOW_SECONDS) -> Callable[[DataFrame], DataFrame]:
    """Batch step: each new grid against the forecasts stored so far; ``nowcasts`` gives those that a batch may meet."""
    return lambda batch: match_forecasts(nowcasts(batch), batch, seconds)


def score_batch(
    nowcasts: Callable[[DataFrame], DataFrame],
    blocks: Callable[[], DataFrame],
    threshold: float | None = DEFAULT_THRESHOLD,
    seconds: int = MATCH_WINDOW_SECONDS,
) -> Callable[[DataFrame], DataFrame]:
    """Batch step: score the stored forecasts that the new grids fall due for; keyed by forecast and observation."""
    return lambda batch: verify(nowcasts(batch), batch, blocks(), None, threshold, seconds)


_RULE_OUT = "rule_id string, file_key string, valid_at timestamp, value double, satisfied boolean, fired boolean, late boolean"


#: State of a bucket: its rules, and of each whether it fires and the time of its latest evaluation, in microseconds.
_RULES_HELD = "rules array<string>, firing array<boolean>, upto array<long>"
#: Buckets that rules are dealt to.
RULE_BUCKETS = 512


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {rule: (firing, upto) for rule, firing, upto in zip(*state.get, strict=True)} if state.exists else {}
    rows = pd.concat(list(batches))
    rows = rows.assign(_rule=pd.factorize(rows["rule_id"], use_na_sentinel=False)[0]).sort_values(["_rule", "valid_at", "file_key"], ignore_index=True)
    rule, time = rows["_rule"].to_numpy(), rows["valid_at"]
    starts = np.flatnonzero(np.diff(rule, prepend=-1))
    names = [None if pd.isna(name) else name for name in rows["rule_id"].iloc[starts]]
    known = [held.get(name) for name in names]
    firing = np.array([seed if k is None else k[0] for k, seed in zip(known, rows["seed"].iloc[starts], strict=True)], bool)
    upto = pd.to_datetime(pd.Series([None if k is None else k[1] for k in known], dtype="Int64"), unit="us").astype(time.dtype)
    late = (time < upto.to_numpy()[rule]).to_numpy()
    due = np.flatnonzero(~late)
    current = rows["satisfied"].to_numpy()[due].astype(bool)
    before = np.concatenate([[False], current[:-1]])
    first = np.flatnonzero(np.diff(rule[due], prepend=-1))
    before[first] = firing[rule[due[first]]]
    fired = np.zeros(len(rows), bool)
    fired[due] = current & ~before
    # What a rule is left in: its last evaluation that was not late, and the time of its latest one.
    last = np.flatnonzero(np.diff(rule[due], append=-1))
    newest = time.groupby(rule).max()
    for i, fires in zip(rule[due[last]], current[last], strict=True):
        at = newest[i]
        held[names[i]] = (bool(fires), None if pd.isna(at) else at.value // 1000)
    state.update(([*held], [f for f, _ in held.values()], [u for _, u in held.values()]))
    yield rows.assign(fired=fired, late=late)[["rule_id", "file_key", "valid_at", "value", "satisfied", "fired", "late"]]


def rule_stream(evals: DataFrame, state: DataFrame | None = None, buckets: int = RULE_BUCKETS) -> DataFrame:
    """Edge-triggered firing with a boolean and a time of state per rule.

    A rule's first evaluation is compared with ``state`` (rule_id, currently_firing), what is stored
    from earlier runs.  An evaluation older than one that an earlier batch brought is ``late``: it is
    reported, but neither fires nor changes the state.  Rules are dealt to ``buckets`` by a hash of their
    id and judged together, as a call for each would cost far more than the judging; a bucket holds
    its rules' evaluations of a batch, so very many rules want more of them.
    """
    slim = evals.select("rule_id", "file_key", "valid_at", "value", "satisfied", F.pmod(F.xxhash64("rule_id"), F.lit(buckets)).alias("bucket"))
    if state is None:
        seeded = slim.withColumn("seed", F.lit(False))
    else:
        seeded = slim.join(state.select("rule_id", F.coalesce("currently_firing", F.lit(False)).alias("seed")), "rule_id", "left")
    return seeded.withColumn("seed", F.coalesce("seed", F.lit(False))).groupBy("bucket").applyInPandasWithState(
        _advance, _RULE_OUT, _RULES_HELD, "append", GroupStateTimeout.NoTimeout
    )


def conflate(batch: DataFrame, by: Sequence[str], arrival: str) -> DataFrame:
    """Newest row per group by arrival, and how many it superseded.

    Over a stream, in update mode, the newest row and the count are the state of a group: a batch's
    rows are what holds after it, and earlier batches are not read again.
    """
    payload = [c for c in batch.columns if c not in by]
    newest_row = batch.groupBy(*by).agg(
        F.max_by(F.struct(*payload), F.struct(arrival, *payload)).alias("_r"), (F.count("*") - 1).alias("superseded")
    )
    return newest_row.select(*by, *[F.col("_r")[c].alias(c) for c in payload], "superseded")


def merge_conflated(parts: DataFrame, by: Sequence[str], arrival: str) -> DataFrame:
    """What ``conflate`` gave for several batches, as if it had seen them as one."""
    payload = [c for c in parts.columns if c not in (*by, "superseded", "batch")]
    newest_row = parts.groupBy(*by).agg(
        F.max_by(F.struct(*payload), F.struct(arrival, *payload)).alias("_r"), (F.sum("superseded") + F.count("*") - 1).alias("superseded")
    )
    return newest_row.select(*by, *[F.col("_r")[c].alias(c) for c in payload], "superseded")


def materialise_pending(
    files: Callable[[], DataFrame], grids: Callable[[], DataFrame], n: int
) -> Callable[[DataFrame], DataFrame]:
    """Batch step: any event asks for the ``n`` newest pending files.  Keyed by file, as later batches may ask again."""

    def step(batch: DataFrame) -> DataFrame:
        pending = unmaterialised_files(files(), grids(), n)
        return pending if not batch.isEmpty() else pending.limit(0)

    return step


def calibration_series_stream(verifications: DataFrame, bucket_seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Running weighted scores per algorithm, lead time and tumbling bucket, the columns of the batch series."""
    bucket = F.window("verified_at", f"{bucket_seconds} seconds")
    summed = verifications.withWatermark("verified_at", delay).groupBy(*GROUP, bucket.alias("bucket")).agg(*series_aggregates())
    return pod_far_csi(summed.withColumn("bucket_epoch", F.unix_timestamp("bucket.start"))).drop("bucket")


def recent_feed_batch(path: str, n: int, ts: str = "created_at", key: str = "id") -> BatchFn:
    """Keep the newest ``n`` events seen so far in a small table, versioned by batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = newest(batch, ts, n, n, key)
        if batch_id > 0:
            top = newest(spark.read.parquet(f"{path}/v={batch_id - 1}").unionByName(top), ts, n, n, key)
        top.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return each
