import contextlib
import io
import time
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import START
from stormframe.operators import catalog, forecast, rules
from stormframe.streaming import jobs, state
from test_tables import EVALS, at


def arrive(df, folder, name):
    """One file per arrival, in a source folder."""
    df.coalesce(1).write.parquet(str(folder / name))


def source(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def run(stream, out, checkpoint, transform=None, mode="append", waits=False):
    jobs.run_available(stream, jobs.batch_writer(str(out), transform), str(checkpoint), mode, waits).awaitTermination()


def test_rule_state_survives_restarts_and_matches_batch(spark, tmp_path):
    pattern = [True, True, False, True, True, False, True]
    rows = [(r, f"f{i}", at(i), 1.0, s != (r == "b"), None) for i, s in enumerate(pattern) for r in "ab"]
    df = spark.createDataFrame(rows, EVALS)
    for step in range(len(pattern)):
        arrive(df.where(F.col("file_key") == f"f{step}"), tmp_path / "in", f"step{step}")
        run(jobs.rule_stream(source(spark, df, tmp_path / "in")), tmp_path / "out", tmp_path / "checkpoint")
    got = {(r.rule_id, r.file_key): r.fired for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.rule_id, r.file_key): r.fired for r in rules.rule_transitions(df).collect()}
    assert got == want and sum(want.values()) == 5


def test_first_seen_is_silent_on_repeats(spark, tmp_path):
    df = spark.createDataFrame([("a", START), ("b", START)], "id string, ts timestamp")
    known = spark.createDataFrame([("b",)], "id string")
    for step in range(2):
        arrive(df, tmp_path / "in", f"poll{step}")
        fresh = jobs.first_seen(source(spark, df, tmp_path / "in"), ["id"], "ts", "1 hour")
        run(fresh, tmp_path / "out", tmp_path / "checkpoint", jobs.only_unknown(lambda: known, ["id"]))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_late_forecasts_are_matched(spark, tmp_path):
    seen = spark.createDataFrame([("o", "P", "L", at(10))], "file_key string, product string, level string, valid_at timestamp")
    said = spark.createDataFrame([("n", "P", "L", at(10))], "nowcast_id string, product string, level string, valid_at timestamp")
    (tmp_path / "said").mkdir()
    arrive(seen, tmp_path / "seen", "0")
    for step in range(2):
        pairs = jobs.verify_stream(source(spark, said, tmp_path / "said"), source(spark, seen, tmp_path / "seen"))
        run(pairs, tmp_path / "out", tmp_path / "checkpoint")
        if step == 0:
            arrive(said, tmp_path / "said", "0")
    assert [(r.nowcast_id, r.observation_file_key) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("n", "o")]


def test_conflation_counts_what_it_skips(spark):
    rows = [("P", f"f{i}", at(i)) for i in range(4)] + [("Q", "g", at(0))]
    batch = spark.createDataFrame(rows, "product string, file_key string, arrived timestamp")
    got = {r["product"]: (r.file_key, r.superseded) for r in jobs.conflate(batch, ["product"], "arrived").collect()}
    assert got == {"P": ("f3", 3), "Q": ("g", 0)}


def test_update_mode_over_many_batches_leaves_one_row_per_bucket(spark, tmp_path):
    rows = [("a", 10, START, n, 1.0 * n, 0.0, 1.0, 1, 2, 3, 4, 35.0, None, None, None) for n in (1, 3)]
    schema = (
        "algorithm string, horizon int, verified_at timestamp, sample_count bigint, mae double, bias double, rmse double, hits bigint, misses bigint, "
        "false_alarms bigint, correct_negatives bigint, threshold_dbz double, ensemble_size int, brier_score double, crps double"
    )
    df = spark.createDataFrame(rows, schema)
    for n in (1, 3):
        arrive(df.where(F.col("sample_count") == n), tmp_path / "in", f"s{n}")
    running = jobs.calibration_series_stream(source(spark, df, tmp_path / "in"))
    got = jobs.drain(spark, running, "series", mode="update", key=["algorithm", "horizon", "bucket_epoch"]).collect()
    assert [(r.verification_count, r.sample_count, r.mae_mean, r.hits) for r in got] == [(2, 4, 2.5, 2)]


def test_conflation_over_batches_equals_one_batch(spark):
    rows = [("P", f"f{i}", at(i)) for i in range(4)] + [("Q", "g", at(0))]
    df = spark.createDataFrame(rows, "product string, file_key string, arrived timestamp")
    parts = [jobs.conflate(df.where(F.col("file_key").isin(k)), ["product"], "arrived").withColumn("batch", F.lit(n)) for n, k in enumerate((["f0", "f2"], ["f1", "f3", "g"]))]
    got = jobs.merge_conflated(parts[0].union(parts[1]), ["product"], "arrived")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.conflate(df, ["product"], "arrived").select(*got.columns).collect()))


def test_rules_start_from_their_stored_state_and_late_grids_do_not_fire(spark, tmp_path):
    rows = [("a", "f1", at(1), 1.0, True, None), ("a", "f3", at(3), 1.0, False, None), ("a", "f2", at(2), 1.0, True, None), ("a", "f4", at(4), 1.0, True, None)]
    df = spark.createDataFrame(rows, EVALS)
    state = spark.createDataFrame([("a", True)], "rule_id string, currently_firing boolean")
    for step in (["f1", "f3"], ["f2", "f4"]):
        arrive(df.where(F.col("file_key").isin(step)), tmp_path / "in", step[0])
        run(jobs.rule_stream(source(spark, df, tmp_path / "in"), state), tmp_path / "out", tmp_path / "checkpoint")
    got = {r.file_key: (r.fired, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"f1": (False, False), "f3": (False, False), "f2": (False, True), "f4": (True, False)}


FRAMES = "file_key string, product string, level string, valid_at timestamp, n_rows int, n_cols int"


def hourly(spark, n, gap_after):
    """Frames an hour apart, with a day between two of them."""
    rows = [(f"f{i:02d}", "P", "L", START + timedelta(hours=i + (24 if i > gap_after else 0)), 2, 2) for i in range(n)]
    return spark.createDataFrame(rows, FRAMES)


def members(df):
    return {(r.source_file_key, r.horizon): tuple(r.members) for r in df.collect()}


def test_history_is_exact_over_hours_gaps_and_restarts(spark, tmp_path):
    df = hourly(spark, 12, 6)
    stored = df.where("file_key < 'f03'")
    for step in (["f03"], ["f05", "f04"], ["f06", "f05", "f07", "f08"], ["f09", "f10", "f11"]):
        arrive(df.where(F.col("file_key").isin(step)), tmp_path / "in", step[0])
        stream, issue = jobs.nowcast_stream(source(spark, df, tmp_path / "in"), forecast.ensemble_of_history, history=4, stored=stored)
        run(stream, tmp_path / "out", tmp_path / "checkpoint", issue)
    want = forecast.lagged_ensemble(df, 4).where("source_file_key >= 'f03'")
    assert members(spark.read.parquet(str(tmp_path / "out"))) == members(want)


def test_a_frame_older_than_what_is_remembered_takes_its_history_from_the_table(spark, tmp_path):
    df = hourly(spark, 12, 20)
    for step in ([f"f{i:02d}" for i in range(12) if i != 2], ["f02"]):
        arrive(df.where(F.col("file_key").isin(step)), tmp_path / "in", step[0])
        histories = state.frame_histories(source(spark, df, tmp_path / "in"), 3, kept=4)
        _, issue = jobs.nowcast_stream(df, forecast.ensemble_of_history, history=3, grids=lambda: df)
        run(histories, tmp_path / "out", tmp_path / "checkpoint", issue)
    got = members(spark.read.parquet(str(tmp_path / "out")))
    assert got["f02", 10] == ("f00", "f01", "f02") and got["f03", 10] == ("f00", "f01", "f03")


def test_histories_seeded_from_a_table_are_those_of_the_whole(spark, tmp_path):
    df = hourly(spark, 8, 3).unionByName(hourly(spark, 5, 2).withColumns({"product": F.lit("Q"), "file_key": F.concat(F.lit("q"), "file_key")}))
    (tmp_path / "in").mkdir()
    arrive(df.where("file_key >= 'f06' AND file_key < 'q' OR file_key >= 'qf04'"), tmp_path / "in", "a")
    run(state.frame_histories(source(spark, df, tmp_path / "in"), 3, df.where("file_key < 'f06' OR file_key >= 'q' AND file_key < 'qf04'")), tmp_path / "out", tmp_path / "c")
    got = {r.file_key: [h.file_key for h in r.history] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.file_key: [h.file_key for h in r.history] for r in catalog.frame_history(df, 3).collect()}
    assert got == {k: want[k] for k in ("f06", "f07", "qf04")}


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_a_batch_reads_only_the_hours_that_fall_due(spark, tmp_path):
    grids = hourly(spark, 60, 100)
    said = forecast.persistence(grids)
    path = str(tmp_path / "nowcasts")
    jobs.write_nowcasts(said, path)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in said.schema.fields)
    due = jobs.due_nowcasts(spark, path, f"{columns}, due_day string, due_hour string")
    batch = grids.where("file_key = 'f30'")
    plan = plan_text(due(batch))
    assert "PartitionFilters" in plan and "due_hour" in plan.split("PartitionFilters")[1].split("\n")[0]
    few = len(due(batch).inputFiles())
    assert 0 < len({f.rsplit("/", 1)[0] for f in due(batch).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) <= 2 < len({f.rsplit("/", 1)[0] for f in spark.read.parquet(path).inputFiles()}) and few
    got = {tuple(r) for r in jobs.verify_batch(due)(batch).select("nowcast_id", "observation_file_key").collect()}
    want = {tuple(r) for r in jobs.verify_batch(lambda _: said)(batch).select("nowcast_id", "observation_file_key").collect()}
    assert got == want and got
    assert jobs.verify_batch(due)(batch.limit(0)).count() == 0
    # More hours than are named one by one: days instead, with the same pairs.
    all_pairs = {tuple(r) for r in jobs.verify_batch(lambda _: said)(grids).select("nowcast_id", "observation_file_key").collect()}
    before, jobs.DUE_KEYS = jobs.DUE_KEYS, 3
    try:
        assert {tuple(r) for r in jobs.verify_batch(due)(grids).select("nowcast_id", "observation_file_key").collect()} == all_pairs
    finally:
        jobs.DUE_KEYS = before


def test_conflation_keeps_its_state_over_batches_and_restarts(spark, tmp_path):
    rows = [("P", f"f{i}", at(i)) for i in range(4)] + [("Q", "g", at(0))]
    df = spark.createDataFrame(rows, "product string, file_key string, arrived timestamp")
    for step in (["f0", "f2", "g"], ["f1"], ["f3"]):
        arrive(df.where(F.col("file_key").isin(step)), tmp_path / "in", step[0])
        run(jobs.conflate(source(spark, df, tmp_path / "in"), ["product"], "arrived"), tmp_path / "out", tmp_path / "checkpoint", mode="update")
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    got = jobs.latest_rows(out, ["product"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.conflate(df, ["product"], "arrived").select(*got.columns).collect()))
    # A batch writes the groups it has met.
    assert {r["product"] for r in out.where("batch = 1").collect()} == {"P"}


ATTEMPTS = "delivery_id string, subscription_id string, created_at timestamp, attempt int, response_status int"


def test_deliveries_end_once_and_wait_for_their_next_attempt(spark, tmp_path):
    rows = [("a", 1, 500), ("b", 1, 200), ("c", 1, 404), ("d", 1, None), ("a", 1, 500), ("a", 2, 201), ("b", 1, 200), ("d", 2, 503), ("d", 3, 503), ("d", 4, 503), ("a", 3, 500)]
    df = spark.createDataFrame([(k, "s", at(0), n, c) for k, n, c in rows], ATTEMPTS).withColumn("i", F.monotonically_increasing_id())
    order = [r.i for r in df.orderBy("i").collect()]
    for step in (order[:4], order[4:5], order[5:8], order[8:]):
        arrive(df.where(F.col("i").isin(step)), tmp_path / "in", str(step[0]))
        run(state.delivery_stream(source(spark, df, tmp_path / "in"), backoff_seconds=0.5), tmp_path / "out", tmp_path / "checkpoint", waits=True)
        time.sleep(1.2)
    got = [(r.delivery_id, r.attempt, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    final = sorted(x for x in got if x[2] != "due")
    assert final == [("a", 2, "ok"), ("b", 1, "ok"), ("c", 1, "failed"), ("d", 4, "failed")]
    due = [x for x in got if x[2] == "due"]
    # The wait of a and d was over when the second batch came; that of d's second attempt is cancelled by its third.
    assert sorted(due) == [("a", 2, "due"), ("d", 2, "due")] and len(set(due)) == len(due)


def test_deliveries_share_the_state_of_their_bucket(spark, tmp_path):
    # Forty deliveries, one of them without an id and one without a time, whose second attempts end every other one.
    ids = [None, *(f"d{i:02d}" for i in range(1, 40))]
    rows = [(i, "s", at(0) if k != 7 else None, n, [503, 200 if k % 2 else 503][n - 1]) for k, i in enumerate(ids) for n in (1, 2)]
    df = spark.createDataFrame(rows, ATTEMPTS)
    kept = []
    for n in (1, 2):
        arrive(df.where(F.col("attempt") == n), tmp_path / "in", f"n{n}")
        stream = state.delivery_stream(source(spark, df, tmp_path / "in"), backoff_seconds=3600.0, buckets=4)
        query = jobs.run_available(stream, jobs.batch_writer(str(tmp_path / "out")), str(tmp_path / "checkpoint"), waits=True)
        query.awaitTermination()
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
    got = {(r.delivery_id, r.created_at is None, r.attempt, r.status, r.response_status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(i, k == 7, 2, "ok", 200) for k, i in enumerate(ids) if k % 2}
    # A state and a call each for a bucket, not for a delivery.
    assert kept == [4, 4]


def test_streaks_equal_the_batch_whatever_the_order(spark, tmp_path):
    rows = [(f"{s}{i:02d}", s, "failed" if (i > 3) ^ (s == "b" and i == 9) else "ok", at(i)) for s in "abc" for i in range(10 if s != "c" else 4)]
    df = spark.createDataFrame(rows, "id string, subscription_id string, status string, created_at timestamp")
    for k in (2, 0, 1):
        arrive(df.where(F.substring("id", 2, 2).cast("int") % 3 == k), tmp_path / "in", f"s{k}")
        run(state.streak_stream(source(spark, df, tmp_path / "in")), tmp_path / "out", tmp_path / "checkpoint", mode="update")
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    got = jobs.latest_rows(out, ["subscription_id"]).where("failing").select("subscription_id", "last_failed_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rules.failing_subscriptions(df).collect())) != []


def test_rules_of_a_bucket_are_judged_together(spark, tmp_path):
    rows = [(f"r{k % 9}" if k % 9 else None, f"f{k // 9}", at(k // 9), float(k), (k * 7 + k // 9) % 3 == 0, None) for k in range(90)]
    df = spark.createDataFrame(rows, EVALS)
    state = spark.createDataFrame([("r1", True), ("r2", None)], "rule_id string, currently_firing boolean")
    for step in range(3):
        arrive(df.where(F.floor(F.substring("file_key", 2, 9).cast("int") / 4) == step), tmp_path / "in", f"step{step}")
        run(jobs.rule_stream(source(spark, df, tmp_path / "in"), state, buckets=2), tmp_path / "out", tmp_path / "checkpoint")
    want, firing = {}, {"r1": True}
    for rule, key, _, _, held, _ in sorted(rows, key=lambda r: r[2]):
        want[rule, key] = held and not firing.get(rule, False)
        firing[rule] = held
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.rule_id, r.file_key): r.fired for r in got} == want and len(got) == 90 and not any(r.late for r in got)
