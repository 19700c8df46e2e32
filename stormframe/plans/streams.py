"""Streaming jobs over the provided tables read as streams, checked against their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.operators import calibration as cal
from stormframe.operators.forecast import ENSEMBLE_SIZE, ensemble_of_history, persistence
from stormframe.plans.actions import _FIRED, _stored_evals
from stormframe.plans.derived import CADENCE, EPOCH0, Tables
from stormframe.plans.forecasts import _DETERMINISTIC
from stormframe.plans.registry import big, epoch, query, rounded
from stormframe.session import scratch_folder
from stormframe.sources import events as messages
from stormframe.streaming import jobs, state


#: The event time by which each streamed table arrives, and in how many pieces.
ARRIVAL = {"events": "ts", "embeddings": "vec_id", "lineitem": "l_shipdate", "orders": "o_orderdate"}
ARRIVALS = 3
#: Files of a piece.
WRITERS = 4


def arrivals(table: DataFrame, order: Column, folder: str) -> DataFrame:
    """A stream over ``table`` that brings a third of the range of ``order`` with each micro-batch."""
    low, high = table.agg(F.min(order), F.max(order)).first()
    piece = F.least(F.lit(ARRIVALS - 1), F.floor((order - low) * ARRIVALS / max(high - low, 1)))
    for k in range(ARRIVALS):
        table.where(piece == k).repartition(WRITERS).write.parquet(f"{folder}/{k}")
    read = table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", WRITERS)
    return read.option("recursiveFileLookup", "true").parquet(folder)


class StreamTables(Tables):
    """The same derivations over streaming reads; a table arrives in ``ARRIVALS`` pieces, one micro-batch each."""

    def base(self, name: str, heavy: bool = False) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        folder = scratch_folder(self.spark, f"arrivals-{name}")
        at = F.col(ARRIVAL[name])
        order = at.cast("timestamp").cast("double") if dict(table.dtypes)[ARRIVAL[name]] not in ("bigint", "int") else at.cast("double")
        stream = arrivals(table, order, folder)
        naive = [f.name for f in table.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream


def _streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


@query(
    "stream_first_seen",
    "SELECT DISTINCT user_id, event_type FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
)
def first_seen(t: Tables) -> DataFrame:
    key = ["user_id", "event_type"]
    fresh = jobs.first_seen(_streams(t).base("events"), key, "ts", "60 days")

    def known() -> DataFrame:
        return t.base("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))

    return jobs.drain(t.spark, fresh, "first-seen", jobs.only_unknown(known, ["user_id"])).select(*key)


@query(
    "stream_nowcasts",
    "SELECT file_key AS source_file_key, CAST(h AS BIGINT) AS horizon, valid_epoch + h * 60 AS valid_epoch FROM grids, (VALUES (10), (30), (60)) t(h)",
    ("grids",),
)
def nowcasts(t: Tables) -> DataFrame:
    stream, step = jobs.nowcast_stream(_streams(t).grids())
    made = jobs.drain(t.spark, stream, "nowcasts", step)
    return made.select("source_file_key", big("horizon"), epoch("valid_at", "valid_epoch"))


_LAGGED = """SELECT source_file_key, CAST(h AS BIGINT) AS horizon, count(*) AS ensemble_size, string_agg(member_key, ',' ORDER BY ago DESC) AS members
       FROM history, (VALUES (10), (30), (60)) t(h) GROUP BY source_file_key, h"""


def _lagged(t: Tables, grids: DataFrame) -> DataFrame:
    stream, step = jobs.nowcast_stream(grids, ensemble_of_history, history=ENSEMBLE_SIZE)
    made = jobs.drain(t.spark, stream, "lagged", step)
    return made.select("source_file_key", big("horizon"), big("ensemble_size"), F.concat_ws(",", "members").alias("members"))


@query("stream_lagged_nowcasts", _LAGGED, ("history",))
def lagged_nowcasts(t: Tables) -> DataFrame:
    """Ensembles of new frames, whose members arrived in earlier batches."""
    return _lagged(t, _streams(t).grids())


@query("stream_hourly_nowcasts", _LAGGED, ("history",))
def hourly_nowcasts(t: Tables) -> DataFrame:
    """Frames an hour apart, and a gap of a day after every sixteenth: the same members, however old."""
    since = (F.unix_timestamp("valid_at") - EPOCH0) / CADENCE
    slow = F.timestamp_seconds(EPOCH0 + since * 3600 + F.floor(since / 16) * 86400)
    return _lagged(t, _streams(t).grids().withColumn("valid_at", slow))


def _due(t: Tables) -> Callable[[DataFrame], DataFrame]:
    """Persistence of all grids as a stored table, of which a batch reads the hours it needs."""
    folder = scratch_folder(t.spark, "nowcasts")
    said = persistence(t.grids())
    jobs.write_nowcasts(said, folder)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in said.schema.fields)
    return jobs.due_nowcasts(t.spark, folder, f"{columns}, due_day string, due_hour string")


@query(
    "stream_verify_scores",
    f"SELECT source_file_key, horizon, observation_file_key, sample_count, mae, hits FROM ({_DETERMINISTIC.format(fields='cells')})",
    ("pairs", "cells"),
)
def verify_scores(t: Tables) -> DataFrame:
    """Scores of stored forecasts as their observations arrive, one row per forecast and observation."""
    said = persistence(t.grids())
    step = jobs.score_batch(_due(t), t.blocks)
    scores = jobs.drain(t.spark, _streams(t).grids(), "scores", step, key=["nowcast_id", "observation_file_key"])
    named = scores.drop("horizon").join(said.select("nowcast_id", "source_file_key", "horizon"), "nowcast_id")
    return named.select("source_file_key", big("horizon"), "observation_file_key", "sample_count", rounded("mae"), "hits")


@query("stream_verify_pairs", "SELECT source_file_key, horizon, observation_file_key FROM pairs", ("pairs",))
def verify_pairs(t: Tables) -> DataFrame:
    said = persistence(_streams(t).grids())
    pairs = jobs.verify_stream(said, _streams(t).grids())
    return jobs.drain(t.spark, pairs, "pairs").select("source_file_key", big("horizon"), "observation_file_key")


@query("stream_verify_new_grids", "SELECT source_file_key, horizon, observation_file_key FROM pairs", ("pairs",))
def verify_new_grids(t: Tables) -> DataFrame:
    step = jobs.verify_batch(_due(t))
    pairs = jobs.drain(t.spark, _streams(t).grids(), "verified", step)
    return pairs.select("source_file_key", big("horizon"), "observation_file_key")


@query("stream_rule_firing", f"SELECT rule_id, file_key, satisfied, fired FROM {_FIRED}", ("evals", "rules"))
def rule_firing(t: Tables) -> DataFrame:
    """Evaluations arrive in order of time, in several batches; the first of a rule meets its stored state."""
    folder = scratch_folder(t.spark, "evaluations")
    stream = arrivals(_stored_evals(t), F.unix_timestamp("valid_at"), folder)
    return jobs.drain(t.spark, jobs.rule_stream(stream, t.rules()), "firing").select("rule_id", "file_key", "satisfied", "fired")


@query(
    "stream_conflate_newest",
    "SELECT product, level, arg_max(file_key, (valid_epoch, file_key)) AS file_key, count(*) - 1 AS superseded FROM grids GROUP BY product, level",
    ("grids",),
)
def conflate_newest(t: Tables) -> DataFrame:
    slim = _streams(t).grids().select("product", "level", "valid_at", "file_key")
    key = ["product", "level"]
    return jobs.drain(t.spark, jobs.conflate(slim, key, "valid_at"), "conflated", mode="update", key=key).select(*key, "file_key", "superseded")


@query(
    "stream_materialise_pending",
    "SELECT file_key FROM files WHERE vec_id % 10 = 9 ORDER BY valid_epoch DESC, file_key LIMIT 16",
    ("files",),
)
def materialise_pending(t: Tables) -> DataFrame:
    step = jobs.materialise_pending(lambda: t.files().drop("vec_id"), t.grids, 16)
    return jobs.drain(t.spark, _streams(t).files(), "pending", step, key=["file_key"]).select("file_key")


@query(
    "stream_calibration_series",
    """SELECT algorithm, horizon, CAST(epoch_us(verified_at) // 86400000000 * 86400 AS BIGINT) AS bucket_epoch, count(*) AS verification_count,
              CAST(sum(sample_count) AS BIGINT) AS sample_count,
              round(coalesce(sum(mae * sample_count) / nullif(sum(sample_count), 0), 0), 6) + 0 AS mae_mean, CAST(sum(hits) AS BIGINT) AS hits
       FROM verifications GROUP BY ALL""",
    ("verifications",),
)
def calibration_series(t: Tables) -> DataFrame:
    running = jobs.calibration_series_stream(_streams(t).verifications(), 86400)
    out = jobs.drain(t.spark, running, "series", mode="update", key=["algorithm", "horizon", "bucket_epoch"])
    return out.select("algorithm", big("horizon"), "bucket_epoch", "verification_count", "sample_count", rounded("mae_mean"), "hits")


@query(
    "stream_events_quarantine",
    "SELECT vec_id % 25 = 7 AS is_bad, count(*) AS n_rows FROM files GROUP BY 1",
    ("files",),
)
def events_quarantine(t: Tables) -> DataFrame:
    sent = messages.to_event_json(_streams(t).files(), "mrms.files.new")
    damaged = sent.select(F.when(F.col("vec_id") % 25 == 7, F.lit('{"product":')).otherwise(F.col("value")).alias("value"))
    read = jobs.drain(t.spark, messages.read_events(damaged, "mrms.files.new"), "events")
    return read.groupBy("is_bad").agg(F.count("*").alias("n_rows"))


@query("stream_recent_feed", "SELECT id FROM alerts ORDER BY onset DESC, id LIMIT 50", ("alerts",))
def recent_feed(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "feed")
    slim = _streams(t).alerts().select("id", F.col("onset").alias("created_at"), "severity")
    done = jobs.run_available(slim, jobs.recent_feed_batch(f"{folder}/out", 50), f"{folder}/checkpoint")
    done.awaitTermination()
    last = done.lastProgress.batchId
    return t.spark.read.parquet(f"{folder}/out/v={last}").select("id")


@query(
    "stream_series_matches_batch",
    "SELECT count(*) AS buckets FROM (SELECT DISTINCT algorithm, horizon, epoch_us(verified_at) // 86400000000 FROM verifications)",
    ("verifications",),
)
def series_matches_batch(t: Tables) -> DataFrame:
    """Buckets on which the streaming and the batch series agree."""
    streamed = jobs.drain(t.spark, jobs.calibration_series_stream(_streams(t).verifications(), 86400), "twin", mode="update", key=["algorithm", "horizon", "bucket_epoch"])
    batch = cal.calibration_series(t.verifications(), None, 86400)
    keys = ["algorithm", "horizon", "bucket_epoch", "verification_count", "sample_count", "hits", "misses", "false_alarms", "brier_sample_count"]
    return streamed.select(*keys).join(batch.select(*keys), keys).agg(F.count("*").alias("buckets"))


@query("stream_failure_streaks", """
    SELECT subscription_id, epoch(max(created_at))::BIGINT AS last_failed_epoch
    FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY created_at DESC, id DESC) AS rn FROM deliveries WHERE status IN ('ok', 'failed'))
    WHERE rn <= 5 GROUP BY subscription_id HAVING count(*) = 5 AND bool_and(status = 'failed')""", ("deliveries",))
def failure_streaks(t: Tables) -> DataFrame:
    """Breakers after all deliveries, which arrive in order of time, but not within a batch."""
    states = jobs.drain(t.spark, state.streak_stream(_streams(t).deliveries()), "streaks", mode="update", key=["subscription_id"])
    return states.where("failing").select("subscription_id", epoch("last_failed_at", "last_failed_epoch"))


@query("stream_delivery_outcomes", """
    WITH made AS (
        SELECT 'D' || o_orderkey // 4 AS delivery_id, o_orderkey % 4 + 1 AS attempt, [NULL, 200, 404, 503, 301][o_custkey % 5 + 1] AS response,
               epoch(o_orderdate) AS told_at, o_orderkey
        FROM orders
    ), told AS (SELECT *, least(2, floor((told_at - min(told_at) OVER ()) * 3 / greatest(max(told_at) OVER () - min(told_at) OVER (), 1))) AS batch FROM made),
    ahead AS (SELECT *, max(attempt) OVER (PARTITION BY delivery_id ORDER BY batch, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM told),
    final AS (
        SELECT *, CASE WHEN response BETWEEN 200 AND 299 THEN 'ok' WHEN response BETWEEN 400 AND 499 OR attempt >= 4 THEN 'failed' END AS status
        FROM ahead WHERE before IS NULL OR attempt > before
    )
    SELECT delivery_id, CAST(arg_min(attempt, (batch, attempt)) AS BIGINT) AS attempts, arg_min(status, (batch, attempt)) AS status
    FROM final WHERE status IS NOT NULL GROUP BY delivery_id""")
def delivery_outcomes(t: Tables) -> DataFrame:
    """One final row a delivery, whichever batches bring its attempts; those that come after a later one are ignored."""
    attempts = _streams(t).attempts().withColumns({"subscription_id": F.lit("S"), "created_at": F.timestamp_seconds(F.lit(EPOCH0))})
    # No wait is over within a run, so that only outcomes come out.
    made = jobs.drain(t.spark, state.delivery_stream(attempts, backoff_seconds=86400.0), "outcomes", waits=True)
    return made.select("delivery_id", F.col("attempt").cast("long").alias("attempts"), "status")
