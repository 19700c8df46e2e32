"""Rules, deliveries, upserts and retention."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.operators import catalog as cat
from stormframe.operators import changes, forecast, joins, rules
from stormframe.plans.derived import EPOCH0, Tables, at_epoch, text
from stormframe.plans.reads import axes
from stormframe.plans.registry import big, epoch, micros, query, rounded
from stormframe.session import scratch_folder, set_aside
from stormframe.sources import events as messages
from stormframe.sources import partitions

NOW = datetime(2024, 6, 1, tzinfo=UTC)


# --- rules ---------------------------------------------------------------------------------


def _evals(t: Tables) -> DataFrame:
    return rules.evaluate_rules(t.rules(), t.grids(), t.blocks(), axes(t))


def _stored_evals(t: Tables) -> DataFrame:
    """The evaluations as a scratch table, for steps that read them more than once."""
    return set_aside(_evals(t), "evals")


@query(
    "evaluate_rules",
    """SELECT rule_id, file_key, round(CASE WHEN isnan(value) THEN NULL ELSE value END, 6) + 0 AS value, satisfied, error_reason FROM evals""",
    ("evals",),
)
def evaluate_rules(t: Tables) -> DataFrame:
    return _evals(t).select("rule_id", "file_key", rounded("value"), "satisfied", "error_reason")


_FIRED = """(SELECT e.*, e.satisfied AND NOT coalesce(lag(e.satisfied) OVER (PARTITION BY e.rule_id ORDER BY e.valid_epoch, e.file_key), r.currently_firing) AS fired
            FROM evals e JOIN rules r ON r.rule_id = e.rule_id)"""


@query("rule_transitions", f"SELECT rule_id, file_key, satisfied, fired FROM {_FIRED}", ("evals", "rules"))
def rule_transitions(t: Tables) -> DataFrame:
    return rules.rule_transitions(_stored_evals(t), t.rules()).select("rule_id", "file_key", "satisfied", "fired")


@query(
    "rule_state",
    f"""SELECT rule_id, arg_max(satisfied, (valid_epoch, file_key)) AS currently_firing, max(valid_epoch) FILTER (WHERE fired) AS last_fired_epoch,
               count(*) FILTER (WHERE fired) AS times_fired FROM {_FIRED} GROUP BY rule_id""",
    ("evals", "rules"),
)
def rule_state(t: Tables) -> DataFrame:
    state = rules.rule_state(rules.rule_transitions(_stored_evals(t), t.rules()))
    return state.select("rule_id", "currently_firing", epoch("last_fired_at", "last_fired_epoch"), "times_fired")


@query(
    "active_rules",
    "SELECT rule_id FROM rules WHERE status = 'active' AND product = 'P3'",
    ("rules",),
)
def active_rules(t: Tables) -> DataFrame:
    return cat.active_rules(t.rules(), "P3", "00.50").select("rule_id")


@query(
    "rules_for_grids",
    """SELECT g.file_key, r.rule_id FROM rules r JOIN grids g ON g.product = r.product JOIN subscriptions s ON s.id = r.subscription_id
       WHERE r.status = 'active' AND s.status = 'active'""",
    ("rules", "grids", "subscriptions"),
)
def rules_for_grids(t: Tables) -> DataFrame:
    return joins.rules_for_grids(t.rules(), t.grids(), t.subscriptions()).select("file_key", "rule_id")


@query(
    "fan_out",
    """SELECT s.id AS subscription_id, m.event_type, count(*) AS n_events, CAST(sum(m.event_id) AS BIGINT) AS id_sum
       FROM messages m JOIN subscriptions s ON list_contains(s.events, m.event_type) WHERE s.status = 'active'
       GROUP BY s.id, m.event_type""",
    ("messages", "subscriptions"),
)
def fan_out(t: Tables) -> DataFrame:
    sent = joins.fan_out(t.messages(), t.subscriptions())
    return sent.groupBy("subscription_id", "event_type").agg(F.count("*").alias("n_events"), F.sum("event_id").alias("id_sum"))


@query("subscriptions_for_event", "SELECT id FROM subscriptions WHERE status = 'active' AND list_contains(events, 'mrms.grids.new')", ("subscriptions",))
def subscriptions_for_event(t: Tables) -> DataFrame:
    return cat.subscriptions_for(t.subscriptions(), "mrms.grids.new").select("id")


@query(
    "list_rules",
    "SELECT rule_id AS id, created_epoch FROM rules WHERE status = 'active' AND subscription_id = 'S7' ORDER BY created_epoch DESC, rule_id LIMIT 100",
    ("rules",),
)
def list_rules(t: Tables) -> DataFrame:
    listed = cat.list_rules(t.rules().withColumnRenamed("rule_id", "id"), "S7", "active")
    return listed.select("id", epoch("created_at", "created_epoch"))


@query(
    "list_subscriptions",
    "SELECT id, created_epoch FROM subscriptions WHERE status = 'active' ORDER BY created_epoch DESC, id LIMIT 100",
    ("subscriptions",),
)
def list_subscriptions(t: Tables) -> DataFrame:
    return cat.list_subscriptions(t.subscriptions(), "active").select("id", epoch("created_at", "created_epoch"))


@query(
    "list_deliveries",
    "SELECT id, status, epoch_us(created_at) AS created_at FROM deliveries WHERE subscription_id = 'S42' ORDER BY created_at DESC, id LIMIT 50",
    ("deliveries",),
)
def list_deliveries(t: Tables) -> DataFrame:
    return cat.list_deliveries(t.deliveries(), "S42").select("id", "status", micros("created_at"))


@query(
    "failing_subscriptions",
    """SELECT subscription_id, epoch_us(max(created_at)) AS last_failed_at FROM (
         SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY created_at DESC, id DESC) AS rn
         FROM deliveries WHERE status IN ('ok', 'failed')) WHERE rn <= 5
       GROUP BY subscription_id HAVING count(*) = 5 AND bool_and(status = 'failed')""",
    ("deliveries",),
)
def failing_subscriptions(t: Tables) -> DataFrame:
    return rules.failing_subscriptions(t.deliveries()).select("subscription_id", micros("last_failed_at"))


_STATUS = """CASE WHEN response_status BETWEEN 200 AND 299 THEN 'ok' WHEN response_status BETWEEN 400 AND 499 THEN 'failed'
                  WHEN attempt >= 4 THEN 'failed' ELSE 'retrying' END"""


@query(
    "classify_attempts",
    f"""SELECT delivery_id, attempt, {_STATUS} AS status, CASE WHEN {_STATUS} = 'retrying' THEN CAST(2 ** (attempt - 1) AS DOUBLE) END AS backoff_seconds
        FROM attempts""",
    ("attempts",),
)
def classify_attempts(t: Tables) -> DataFrame:
    return rules.classify_attempts(t.attempts()).select("delivery_id", big("attempt"), "status", "backoff_seconds")


@query(
    "delivery_outcomes",
    f"""SELECT delivery_id, attempt AS attempts, {_STATUS} AS status, response_status AS last_status, {_STATUS} = 'failed' AS terminal_failure
        FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY attempt DESC) AS rn FROM attempts) WHERE rn = 1""",
    ("attempts",),
)
def delivery_outcomes(t: Tables) -> DataFrame:
    out = rules.delivery_outcomes(t.attempts())
    return out.select("delivery_id", big("attempts"), "status", big("last_status"), "terminal_failure")


@query(
    "rule_fired_envelopes",
    f"""SELECT f.rule_id, f.file_key, 'rule.fired' AS event, 'WebhookEvent' AS type, true AS satisfied, f.product
        FROM (SELECT x.*, r.product FROM {_FIRED} x JOIN rules r ON r.rule_id = x.rule_id) f WHERE f.fired""",
    ("evals", "rules"),
)
def rule_fired_envelopes(t: Tables) -> DataFrame:
    fired = rules.rule_transitions(_stored_evals(t), t.rules()).where("fired").join(
        t.rules().select("rule_id", F.col("config.product").alias("product"), F.col("config.level").alias("level")), "rule_id"
    )
    data = F.struct(
        F.struct(F.col("rule_id").alias("id")).alias("rule"),
        F.struct("value", F.col("satisfied").alias("predicateSatisfied")).alias("evaluation"),
        F.struct(F.col("file_key").alias("fileKey"), "product", "level").alias("grid"),
    )
    sent = messages.delivery_envelope(fired, F.lit("rule.fired"), F.concat_ws("|", "rule_id", "file_key"), data)

    # An envelope is read once, not once for each field.
    told = "type string, event string, data struct<rule: struct<id: string>, evaluation: struct<predicateSatisfied: boolean>, grid: struct<fileKey: string, product: string>>"
    return sent.withColumn("_read", F.from_json("envelope", told)).select(
        F.col("_read.data.rule.id").alias("rule_id"), F.col("_read.data.grid.fileKey").alias("file_key"), F.col("_read.event").alias("event"),
        F.col("_read.type").alias("type"), F.col("_read.data.evaluation.predicateSatisfied").alias("satisfied"),
        F.col("_read.data.grid.product").alias("product"),
    )


# --- upserts -----------------------------------------------------------------------------------


def _batch_once(t: Tables) -> DataFrame:
    """The batch and a later copy of every third row with a larger size."""
    v = F.col("vec_id")
    once = t.files().where(v % 3 != 0).select(
        F.when(v % 5 == 4, F.concat("file_key", F.lit("-new"))).otherwise(F.col("file_key")).alias("file_key"),
        "product", "level", "valid_at",
        (F.col("size_bytes") + F.when(v % 2 == 0, 7).otherwise(0)).alias("size_bytes"),
        F.when(v % 7 != 0, F.lit("e")).otherwise(F.lit("?")).alias("etag"),
        F.lit(1).alias("seq"),
        "vec_id",
    )
    again = once.where(v % 4 == 1).withColumns({"size_bytes": F.col("size_bytes") + 100, "seq": F.lit(2)})
    return once.unionByName(again).drop("vec_id")


def _target(t: Tables) -> DataFrame:
    return t.files().select(
        "file_key", "product", "level", "valid_at", "size_bytes",
        F.when(F.col("vec_id") % 11 != 0, F.lit("e")).alias("etag"),
        at_epoch(F.lit(EPOCH0)).alias("discovered_at"), at_epoch(F.lit(EPOCH0)).alias("updated_at"),
    )


_UPSERT = """
    FROM (SELECT file_key, size_bytes, CASE WHEN vec_id % 11 <> 0 THEN 'e' END AS etag FROM files) o FULL JOIN (
        SELECT CASE WHEN vec_id % 5 = 4 THEN file_key || '-new' ELSE file_key END AS file_key,
               size_bytes + CASE WHEN vec_id % 2 = 0 THEN 7 ELSE 0 END + CASE WHEN vec_id % 4 = 1 THEN 100 ELSE 0 END AS size_bytes,
               CASE WHEN vec_id % 7 <> 0 THEN 'e' ELSE '?' END AS etag
        FROM files WHERE vec_id % 3 <> 0) n ON n.file_key = o.file_key"""
_ACTION = """CASE WHEN n.file_key IS NULL THEN 'kept' WHEN o.file_key IS NULL THEN 'inserted'
                  WHEN o.size_bytes IS DISTINCT FROM n.size_bytes OR o.etag IS DISTINCT FROM n.etag THEN 'updated' ELSE 'unchanged' END"""
_MUTABLE = ("product", "level", "valid_at", "size_bytes", "etag")


@query(
    "upsert_files",
    f"""SELECT coalesce(o.file_key, n.file_key) AS file_key, {_ACTION} AS action,
               CASE WHEN {_ACTION} IN ('inserted', 'updated') THEN n.size_bytes ELSE o.size_bytes END AS size_bytes,
               CASE WHEN {_ACTION} IN ('inserted', 'updated') THEN n.etag ELSE o.etag END AS etag,
               CASE WHEN {_ACTION} IN ('inserted', 'updated') THEN 1717200000 ELSE 1704067200 END AS updated_epoch {_UPSERT}""",
    ("files",),
)
def upsert_files(t: Tables) -> DataFrame:
    out = changes.upsert(_target(t), _batch_once(t), ["file_key"], _MUTABLE, NOW, batch_order=["seq"])
    return out.select("file_key", "action", "size_bytes", "etag", epoch("updated_at", "updated_epoch"))


@query(
    "upsert_files_stored",
    f"""SELECT coalesce(o.file_key, n.file_key) AS file_key,
               CASE WHEN {_ACTION} IN ('inserted', 'updated') THEN n.size_bytes ELSE o.size_bytes END AS size_bytes,
               CASE WHEN {_ACTION} IN ('inserted', 'updated') THEN n.etag ELSE o.etag END AS etag,
               CASE WHEN {_ACTION} IN ('inserted', 'updated') THEN 1717200000 ELSE 1704067200 END AS updated_epoch {_UPSERT}""",
    ("files",),
)
def upsert_files_stored(t: Tables) -> DataFrame:
    """The same batch into a table stored by day."""
    path = f"{scratch_folder(t.spark, 'upserts')}/files"
    day = F.date_format("valid_at", "yyyy-MM-dd").alias("valid_date")
    target = _target(t).select("*", day)
    target.write.partitionBy("valid_date").parquet(path)
    partitions.upsert_stored(path, target.schema, _batch_once(t).select("*", day), ["file_key"], _MUTABLE, NOW, ["valid_date"], batch_order=["seq"])
    return t.spark.read.schema(target.schema).parquet(path).select("file_key", "size_bytes", "etag", epoch("updated_at", "updated_epoch"))


@query("upsert_action_counts", f"SELECT {_ACTION} AS action, count(*) AS n_rows {_UPSERT} GROUP BY 1", ("files",))
def upsert_action_counts(t: Tables) -> DataFrame:
    return changes.action_counts(changes.upsert(_target(t), _batch_once(t), ["file_key"], _MUTABLE, NOW, batch_order=["seq"]))


@query(
    "upsert_unconditional",
    f"SELECT CASE {_ACTION} WHEN 'unchanged' THEN 'updated' ELSE {_ACTION} END AS action, count(*) AS n_rows {_UPSERT} GROUP BY 1",
    ("files",),
)
def upsert_unconditional(t: Tables) -> DataFrame:
    out = changes.upsert(_target(t), _batch_once(t), ["file_key"], _MUTABLE, NOW, batch_order=["seq"], only_changed=False)
    return changes.action_counts(out)


@query("newly_inserted", "SELECT file_key || '-new' AS file_key FROM files WHERE vec_id % 3 <> 0 AND vec_id % 5 = 4", ("files",))
def newly_inserted(t: Tables) -> DataFrame:
    out = changes.upsert(_target(t), _batch_once(t), ["file_key"], _MUTABLE, NOW, batch_order=["seq"])
    return changes.new_keys(out).select("file_key")


@query(
    "patch_rules",
    """SELECT rule_id, CASE WHEN k % 4 = 0 THEN 'paused' ELSE status END AS status,
              CASE WHEN k % 6 = 0 THEN 'S0' ELSE subscription_id END AS subscription_id FROM rules""",
    ("rules",),
)
def patch_rules(t: Tables) -> DataFrame:
    r = t.rules().select("rule_id", "status", "subscription_id", F.col("part").alias("k"))
    given = r.where((F.col("k") % 4 == 0) | (F.col("k") % 6 == 0)).select(
        "rule_id", F.when(F.col("k") % 4 == 0, F.lit("paused")).alias("status"), F.when(F.col("k") % 6 == 0, F.lit("S0")).alias("subscription_id")
    )
    return changes.patch(r.drop("k"), given, "rule_id")


# --- retention -----------------------------------------------------------------------------------


def _stored(t: Tables) -> dict[str, DataFrame]:
    nowcasts = forecast.persistence(t.grids())
    pairs = joins.match_forecasts(nowcasts, t.grids())
    return {
        "files": t.files().drop("vec_id"),
        "grids": t.grids(),
        "nowcasts": nowcasts,
        "verifications": pairs.select("nowcast_id", "observation_file_key", "source_file_key", "horizon"),
    }


# The cut falls two hours into the frames.
CUT = datetime(2024, 1, 1, 8, tzinfo=UTC)


_PRUNED = """SELECT 'files' AS name, count(*) FILTER (WHERE valid_epoch >= 1704067200 + 7200) AS kept, count(*) FILTER (WHERE valid_epoch < 1704067200 + 7200) AS dropped FROM files
       UNION ALL SELECT 'grids', count(*) FILTER (WHERE valid_epoch >= 1704067200 + 7200), count(*) FILTER (WHERE valid_epoch < 1704067200 + 7200) FROM grids
       UNION ALL SELECT 'nowcasts', 3 * count(*) FILTER (WHERE valid_epoch >= 1704067200 + 7200), 3 * count(*) FILTER (WHERE valid_epoch < 1704067200 + 7200) FROM grids
       UNION ALL SELECT 'verifications', count(*) FILTER (WHERE due_epoch - horizon * 60 >= 1704067200 + 7200 AND observation_epoch >= 1704067200 + 7200),
                        count(*) FILTER (WHERE due_epoch - horizon * 60 < 1704067200 + 7200 OR observation_epoch < 1704067200 + 7200) FROM pairs"""


@query("prune_files_cascade", _PRUNED, ("files", "grids", "pairs"))
def prune_files_cascade(t: Tables) -> DataFrame:
    out = None
    for name, (kept, dropped) in changes.prune_files(_stored(t), 6, CUT).items():
        row = kept.agg(F.lit(name).alias("name"), F.count("*").alias("kept")).crossJoin(dropped.agg(F.count("*").alias("dropped")))
        out = row if out is None else out.unionByName(row)
    return out


@query("prune_files_stored", _PRUNED, ("files", "grids", "pairs"))
def prune_files_stored(t: Tables) -> DataFrame:
    """Retention on tables stored by the day of their source file."""
    folder = scratch_folder(t.spark, "dated")
    stored = _stored(t)
    source = stored["nowcasts"].select("nowcast_id", (F.col("valid_at") - F.make_dt_interval(mins=F.col("horizon"))).alias("_issued"))
    seen = stored["grids"].select(F.col("file_key").alias("observation_file_key"), F.col("valid_at").alias("_seen"))
    scored = stored["verifications"].join(source, "nowcast_id").join(seen, "observation_file_key").withColumn("_first", F.least("_issued", "_seen"))
    rows = {
        "files": (stored["files"], F.col("valid_at")),
        "grids": (stored["grids"], F.col("valid_at")),
        "nowcasts": (stored["nowcasts"], F.col("valid_at") - F.make_dt_interval(mins=F.col("horizon"))),
        "verifications": (scored, F.col("_first")),
    }
    paths = {name: f"{folder}/{name}" for name in rows}
    for name, (df, at) in rows.items():
        partitions.write_dated(df, paths[name], at)
    tally = partitions.prune_stored(t.spark, paths, 6, CUT)
    out = None
    for name, path in paths.items():
        kept = t.spark.read.parquet(path).agg(F.count("*").alias("kept"))
        row = kept.select(F.lit(name).alias("name"), "kept", F.lit(tally[name]["rows"]).cast("long").alias("dropped"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "prune_alerts",
    "SELECT id FROM alerts WHERE expires IS NULL OR expires >= TIMESTAMP '1998-05-02'",
    ("alerts",),
)
def prune_alerts(t: Tables) -> DataFrame:
    return changes.prune_alerts(t.alerts(), 30, datetime(1998, 6, 1, tzinfo=UTC)).select("id")


@query(
    "doomed_paths",
    """SELECT 'g/' || file_key AS path, 0 AS source FROM grids WHERE valid_epoch < 1704067200 + 7200
       UNION ALL SELECT 'n/' || file_key, 1 FROM grids WHERE valid_epoch < 1704067200 + 7200""",
    ("grids",),
)
def doomed_paths(t: Tables) -> DataFrame:
    stored = _stored(t)
    gone = changes.expired_files(stored["files"], 6, CUT)
    grids = stored["grids"].withColumn("path", text("g/", F.col("file_key")))
    nowcasts = stored["nowcasts"].withColumn("path", text("n/", F.col("source_file_key")))
    return changes.doomed_paths(gone, grids, nowcasts).select("path", big("source"))


@query(
    "prune_summary",
    """SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS deleted, CAST(sum(bytes) AS BIGINT) AS bytes
       FROM (SELECT valid_epoch // 3600 AS batch, count(*) AS n, sum(size_bytes) AS bytes FROM files GROUP BY 1)""",
    ("files",),
)
def prune_summary(t: Tables) -> DataFrame:
    hours = t.files().groupBy(F.floor(F.unix_timestamp("valid_at") / 3600).alias("batch"))
    return changes.prune_summary(hours.agg(F.count("*").alias("deleted"), F.sum("size_bytes").alias("bytes")))
