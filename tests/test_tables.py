import json
import random
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import START, make_grid
from stormframe.functions.parsing import parse_polygon
from stormframe.functions.values import predicate_holds
from stormframe.operators import alerts, catalog, changes, grid, joins, ordering, rules
from stormframe.plans.all import QUERIES
from stormframe.plans.derived import Tables
from stormframe.plans.reads import axes
from stormframe.sources import catalog as stored
from stormframe.sources import feeds, partitions

NAN = float("nan")


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_asof_join_against_brute_force(spark):
    rng = random.Random(7)
    right = [("a" if rng.random() < 0.7 else "b", at(rng.randrange(600)), f"k{i:03d}") for i in range(200)]
    left = [(i, rng.choice("abc"), at(rng.randrange(-30, 700))) for i in range(300)]
    rdf = spark.createDataFrame(right, "g string, valid_at timestamp, file_key string")
    ldf = spark.createDataFrame(left, "id int, g string, t timestamp")
    got = {r.id: r.file_key for r in ordering.asof_join(ldf, rdf, ["g"], "t", "valid_at", "file_key").collect()}
    for i, g, t in left:
        seen = [(v, k) for gg, v, k in right if gg == g and v <= t]
        assert got[i] == (max(seen)[1] if seen else None)


def test_positions_and_previous_across_chunks(spark):
    rows = [("hot", at(7 * i), i) for i in range(100)] + [("cold", at(0), 0)]
    df = spark.createDataFrame(rows, "g string, t timestamp, v int")
    chunk = ordering.time_chunk(F.col("t"), 3600)
    placed = ordering.row_positions(df, ["g"], ["t"], chunk).where("g = 'hot'")
    assert all(r.position == r.v + 1 for r in placed.collect())
    before = ordering.with_previous(df, ["g"], ["t"], chunk, F.col("v"), "before").where("g = 'hot'")
    assert all(r.before == (r.v - 1 if r.v else None) for r in before.collect())


def test_match_window_is_inclusive(spark):
    said = spark.createDataFrame([("n", "P", "L", at(10))], "nowcast_id string, product string, level string, valid_at timestamp")
    seen = [(f"o{s}", "P", "L", at(10) + timedelta(seconds=s)) for s in (-61, -60, 0, 60, 61)]
    odf = spark.createDataFrame(seen, "file_key string, product string, level string, valid_at timestamp")
    got = {r.observation_file_key for r in joins.match_forecasts(said, odf).collect()}
    assert got == {"o-60", "o0", "o60"}


@pytest.mark.parametrize("n", [0, -1, 2])
def test_recent_frames(spark, n):
    grids = spark.createDataFrame([(f"f{i}", "P", "L", at(i)) for i in range(5)], "file_key string, product string, level string, valid_at timestamp")
    got = [r.file_key for r in catalog.recent_frames(grids, n, at(3)).collect()]
    assert got == (["f2", "f3"] if n == 2 else [])


def test_day_prefixes():
    assert catalog.days_touched(datetime(2024, 1, 1, 23, tzinfo=UTC), datetime(2024, 1, 3, tzinfo=UTC)) == ["20240101", "20240102"]
    with pytest.raises(ValueError):
        catalog.days_touched(at(5), at(5))


def test_bounds_are_checked(spark):
    for box in ((10, 5, -10, 6), (0, 6, 1, 5), (0, -91, 1, 5)):
        with pytest.raises(ValueError):
            catalog.check_bbox(*box)


def test_predicates_on_missing_values(spark):
    df = spark.createDataFrame([(NAN,), (None,), (5.0,)], "v double")
    for op, want in {"==": [False, False, True], "!=": [True, False, False], ">=": [False, False, True], ">": [False] * 3}.items():
        assert [r[0] for r in df.select(predicate_holds(F.col("v"), op, 5.0)).collect()] == want


EVALS = "rule_id string, file_key string, valid_at timestamp, value double, satisfied boolean, error_reason string"


def test_edge_trigger_rearms_on_errors(spark):
    pattern = [True, True, False, True, None, True]
    evals = [("r", f"f{i}", at(45 * i), 1.0, bool(s), "out_of_domain" if s is None else None) for i, s in enumerate(pattern)]
    df = spark.createDataFrame(evals, EVALS)
    fired = [r.fired for r in rules.rule_transitions(df).orderBy("valid_at").collect()]
    assert fired == [True, False, False, True, False, True]
    state = spark.createDataFrame([("r", True)], "rule_id string, currently_firing boolean")
    seeded = rules.rule_transitions(df, state)
    assert [r.fired for r in seeded.orderBy("valid_at").collect()] == [False, False, False, True, False, True]
    left = rules.rule_state(seeded).first()
    assert left.currently_firing and left.times_fired == 2 and left.last_fired_at == at(225).replace(tzinfo=None)


def test_rules_are_evaluated_once_for_their_transitions(spark, tmp_path):
    spark.range(60).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    cells = "transform(sequence(1, 64), i -> CAST((i * (id + 3)) % 7 AS FLOAT) / 7)"
    spark.range(24).selectExpr("id AS vec_id", f"{cells} AS embedding", "CAST(id % 3 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["rule_transitions"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_fold" not in plan and "ArrowEvalPython" not in plan
    t = Tables(spark, str(tmp_path))
    direct = rules.rule_transitions(rules.evaluate_rules(t.rules(), t.grids(), t.blocks(), axes(t)), t.rules())
    got = sorted(map(tuple, out.collect()))
    assert got and got == sorted(map(tuple, direct.select(*out.columns).collect()))


def test_failure_streak(spark):
    rows = [("s", f"d{i}", at(i), s) for i, s in enumerate(["ok", "failed", "retrying", "failed"])] + [("q", "e", at(1), "failed")]
    df = spark.createDataFrame(rows, "subscription_id string, id string, created_at timestamp, status string")
    assert [r.subscription_id for r in rules.failing_subscriptions(df, 2).collect()] == ["s"]
    assert rules.failing_subscriptions(df, 3).count() == 0 and rules.failing_subscriptions(df, 0).count() == 0


FILES = "file_key string, size_bytes bigint, etag string, updated_at timestamp"


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([("a", 1, None, START), ("b", 2, "x", START), ("c", 3, "x", START)], FILES)
    batch = spark.createDataFrame([("a", 1, None), ("b", 9, "x"), ("b", 5, "x"), ("d", 4, "x")], "file_key string, size_bytes bigint, etag string")
    first = changes.upsert(target, batch, ["file_key"], ["size_bytes", "etag"], at(60))
    rows = {r.file_key: r for r in first.collect()}
    assert {k: r.action for k, r in rows.items()} == {"a": "unchanged", "b": "updated", "c": "kept", "d": "inserted"}
    assert rows["b"].size_bytes == 9 and rows["a"].updated_at == START.replace(tzinfo=None)
    again = changes.upsert(first.drop("action"), batch, ["file_key"], ["size_bytes", "etag"], at(120))
    assert {r.action for r in again.collect()} == {"unchanged", "kept"}
    assert changes.new_keys(first).count() == 1


def test_cascade_takes_both_sides(spark):
    files = spark.createDataFrame([("old", at(0)), ("new", at(600))], "file_key string, valid_at timestamp")
    grids = files
    nowcasts = spark.createDataFrame([("n1", "old"), ("n2", "new")], "nowcast_id string, source_file_key string")
    pairs = spark.createDataFrame([("n1", "new"), ("n2", "old"), ("n2", "new")], "nowcast_id string, observation_file_key string")
    out = changes.prune_files({"files": files, "grids": grids, "nowcasts": nowcasts, "verifications": pairs}, 5, at(660))
    assert [tuple(r) for r in out["verifications"][0].collect()] == [("n2", "new")]
    assert out["verifications"][1].count() == 2 and out["nowcasts"][1].count() == 1
    with pytest.raises(ValueError):
        changes.expired_files(files, 0, at(0))


def test_checks_let_unknown_values_pass(spark):
    df = spark.createDataFrame([(1, 400), (None, None), (-1, 10)], "wind_speed_kt int, wind_direction_deg int")
    good, bad = changes.validate(df, changes.range_checks(changes.OBSERVATION_RANGES, df))
    assert good.count() == 1
    assert sorted(r.violations[0] for r in bad.collect()) == ["wind_direction_deg_range", "wind_speed_kt_range"]


def test_alert_features_with_collections(spark):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    collection = {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": square}, {"type": "Point", "coordinates": [5, 5]}, {"type": "MultiPolygon", "coordinates": [square, square]}]}

    def feature(geometry, **properties):
        return {"type": "Feature", "geometry": geometry, "properties": properties}

    document = {
        "type": "FeatureCollection",
        "features": [
            feature(collection, id=" a ", event="Wind", severity="Severe", onset="2024-01-01T00:00:00-06:00"),
            feature(None, id="b", event="Wind", severity="Terrible"),
            feature(None, id="c", event="Wind"),
            {"type": "Feature", "geometry": None},
        ],
    }
    rows = feeds.read_alert_features(spark.createDataFrame([(json.dumps(document),), ('{"type":"Other","features":[]}',)], "payload string"))
    got = {r.id: r for r in rows.collect()}
    assert len(got["a"].parts) == 3 and got["a"].onset == datetime(2024, 1, 1, 6) and got["a"].error_reason is None
    assert got["b"].error_reason == "unknown_severity" and got["c"].severity == "Unknown" and got[None].error_reason == "no_properties"


def test_station_types_stay_visible(spark):
    base = {"icaoId": "KIAH", "reportTime": "2024-01-01T00:00:00Z", "lat": 1.0, "lon": 2.0, "rawOb": "x"}
    records = [{**base, "visib": v, "wdir": w} for v, w in ((5, 90), ("5", "VRB"), ("10+", "120"), ("M1/4", None))]
    bad = [{**base, "rawOb": ""}, {**base, "reportTime": "soon"}, {k: v for k, v in base.items() if k != "lat"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records + bad], "payload string")
    rows = feeds.read_station_records(df).collect()
    assert [r.visibility_sm for r in rows] == [5.0, None, 10.0, 0.0]
    assert [r.wind_direction_deg for r in rows] == [90, None, None, None]


def test_object_keys(spark):
    good = "CONUS/Refl_00.50/20240102/MRMS_Refl_00.50_20240102-030405.grib2.gz"
    keys = [good, good.replace("MRMS_Refl", "MRMS_Other"), good.replace("030405", "996099"), "readme", None]
    listing = spark.createDataFrame([(k, 1, '"tag"') for k in keys], "key string, size bigint, etag string")
    rows = stored.read_file_catalog(listing)
    kept = stored.usable(rows).collect()
    assert [(r.product, r.level, r.etag) for r in kept] == [("Refl", "00.50", "tag")]
    assert kept[0].valid_at == datetime(2024, 1, 2, 3, 4, 5) and stored.skipped(rows).first().skipped == 4


def test_stored_days_are_replaced_whole(spark, tmp_path):
    from helpers import make_grid

    _, blocks, _ = make_grid(spark, [1, 2], [1, 2], {"a": [1] * 4, "b": [2] * 4})
    path = str(tmp_path / "store")
    late = blocks.withColumns({"valid_at": F.col("valid_at") + F.expr("interval 3 days"), "file_key": F.concat("file_key", F.lit("-late"))})
    stored.write_blocks(blocks.unionByName(late), path)
    before = contents(path)
    changed = blocks.where("file_key = 'b'").withColumn("values", F.transform("values", lambda v: v + 5))
    assert stored.replace_grids(spark, path, changed) == ["product=P/level=00.50/valid_date=2024-01-01"]
    got = {r.file_key: r.values_ for r in stored.read_blocks(spark, path).withColumnRenamed("values", "values_").collect()}
    assert got["a"][0] == 1.0 and got["b"][0] == 7.0 and got["b-late"][0] == 2.0
    assert stored.read_blocks(spark, path).where("level = '00.50'").count() == 4
    after = contents(path)
    assert {k: v for k, v in after.items() if "01-04" in k} == {k: v for k, v in before.items() if "01-04" in k} != {}
    # Into a store that is not there yet.
    stored.replace_grids(spark, str(tmp_path / "new"), blocks)
    assert stored.read_blocks(spark, str(tmp_path / "new")).count() == 2


def contents(path):
    """Data files and their bytes."""
    return {str(f): f.read_bytes() for f in Path(path).rglob("*.parquet")}


DAY_FILES = "file_key string, valid_at timestamp, size_bytes long, updated_at timestamp, valid_date string"


def day_files(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(days=d), n, START, f"{START + timedelta(days=d):%Y-%m-%d}") for k, d, n in rows], DAY_FILES)


def test_a_batch_of_one_day_leaves_other_days_alone(spark, tmp_path):
    path = str(tmp_path / "files")
    target = day_files(spark, [(f"f{d}-{i}", d, i) for d in range(4) for i in range(5)])
    target.write.partitionBy("valid_date").parquet(path)
    before = contents(path)
    batch = day_files(spark, [("f2-1", 2, 1), ("f2-2", 2, 70), ("f2-9", 2, 9), ("f2-9", 2, 8), ("f3-0", 3, 0)]).drop("updated_at")
    now = START + timedelta(days=9)

    def apply():
        done = partitions.upsert_stored(path, target.schema, batch, ["file_key"], ["size_bytes"], now, ["valid_date"], ["size_bytes"])
        return {r.file_key: r.action for r in done.collect()}

    assert apply() == {"f2-1": "unchanged", "f2-2": "updated", "f2-9": "inserted", "f3-0": "unchanged"}
    after = contents(path)
    kept = {k: v for k, v in before.items() if "01-03" not in k}
    # Day 3 has a key of the batch too, but nothing changed there.
    assert {k: v for k, v in after.items() if "01-03" not in k} == kept and len(kept) >= 3
    want = changes.upsert(target, batch, ["file_key"], ["size_bytes"], now, ["size_bytes"]).drop("action")
    table = spark.read.schema(target.schema).parquet(path)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, want.select(*table.columns).collect()))
    assert apply() == {"f2-1": "unchanged", "f2-2": "unchanged", "f2-9": "unchanged", "f3-0": "unchanged"} and contents(path) == after
    # A table that is not there yet.
    first = partitions.upsert_stored(str(tmp_path / "none"), target.schema, batch, ["file_key"], ["size_bytes"], now, ["valid_date"], ["size_bytes"])
    assert {r.action for r in first.collect()} == {"inserted"}


def test_retention_drops_days_and_rewrites_one(spark, tmp_path):
    rows = [(f"f{h:03d}", START + timedelta(hours=h)) for h in range(0, 120, 5)] + [("none", None)]
    files = spark.createDataFrame(rows, "file_key string, valid_at timestamp")
    path = str(tmp_path / "files")
    partitions.write_dated(files, path, F.col("valid_at"))
    before = contents(path)
    now = START + timedelta(hours=118)
    want = {k for k, at in rows if at is None or at >= now - timedelta(hours=60)}
    tally = partitions.prune_stored(spark, {"files": path}, 60, now)
    assert {r.file_key for r in spark.read.parquet(path).collect()} == want
    assert tally == {"files": {"days": 2, "rows": len(rows) - len(want)}}
    after = contents(path)
    later = {k: v for k, v in before.items() if any(d in k for d in ("01-04", "01-05", "DEFAULT"))}
    assert {k: v for k, v in after.items() if k in later} == later and len(later) >= 3
    assert partitions.prune_stored(spark, {"files": path}, 60, now) == {"files": {"days": 0, "rows": 0}} and contents(path) == after
    with pytest.raises(ValueError):
        partitions.prune_stored(spark, {"files": path}, 0, now)


def test_a_listed_folder_becomes_a_catalog(spark, tmp_path):
    name = "CONUS/MergedReflectivityComposite_00.50/20240101/MRMS_MergedReflectivityComposite_00.50_20240101-120000.grib2.gz"
    for key in (name, "CONUS/readme.txt"):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / key).write_bytes(b"12345")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        listing = stored.list_objects(spark, root)
        assert {r.key for r in listing.collect()} == {name, "CONUS/readme.txt"}
        rows = stored.usable(stored.read_file_catalog(listing)).collect()
        assert [(r.file_key, r["product"], r.level, r.size_bytes) for r in rows] == [(name, "MergedReflectivityComposite", "00.50", 5)]


def test_the_work_queue_is_no_page(spark):
    files = spark.createDataFrame([(f"f{i:04d}", START) for i in range(600)], "file_key string, valid_at timestamp")
    none = spark.createDataFrame([], "file_key string")
    assert catalog.unmaterialised_files(files, none, 550).count() == 550
    assert catalog.unmaterialised_files(files, none, 0).count() == 0


def test_alerts_in_force_at_many_instants(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        start = rng.choice([None, rng.randrange(-5000, 20_000)])
        length = rng.choice([None, 0, 3, 50, 700, 9000])
        rows.append((i, None if start is None else at(start), None if length is None else at((start or 0) + length)))
    rows += [(900, at(5), at(4)), (901, at(60), at(60)), (902, None, None)]
    alert = spark.createDataFrame(rows, "id int, onset timestamp, expires timestamp")
    moments = [at(m) for m in (0, 5, 60, 61, 4999, 5000, 9000, 19_999)] + [at(rng.randrange(15_000)) for _ in range(80)]
    instants = spark.createDataFrame([(m,) for m in moments] + [(None,)], "at timestamp")
    got = sorted((r["at"], r.id) for r in alerts.active_at_instants(alert, instants).collect())
    naive = [m.replace(tzinfo=None) for m in moments]
    spans = [(i, s and s.replace(tzinfo=None), e and e.replace(tzinfo=None)) for i, s, e in rows]
    assert got == sorted((m, i) for m in naive for i, s, e in spans if (s is None or s <= m) and (e is None or e >= m))
    plan = alerts.active_at_instants(alert, instants)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert alerts.active_at_instants(alert, instants.limit(0)).count() == 0


def test_salts_follow_the_counted_rows(spark):
    rng = random.Random(2)
    events = [(i, "hot" if rng.random() < 0.99 else f"k{rng.randrange(30)}") for i in range(4000)]
    left = spark.createDataFrame(events, "id int, event_type string")
    right = spark.createDataFrame([(f"s{k}", t) for k in range(20) for t in ("hot", "k1", "k2", "none")], "sub string, event_type string")
    hot = joins.hot_keys(left, ["event_type"])
    assert [r.event_type for r in hot.collect()] == ["hot"]
    salts = hot.first()["_salts"]
    spread, listed = joins.spread_sides(left, right, ["event_type"], hot)
    # Rare keys are listed once, the hot one as often as its rows need.
    assert listed.count() == 60 + 20 * salts and salts == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_salt = [r["count"] for r in spread.where("event_type = 'hot'").groupBy("_salt").count().collect()]
    assert len(per_salt) == salts and max(per_salt) < 2 * min(per_salt)
    got = joins.spread_join(left, right, ["event_type"])
    assert sorted(map(tuple, got.select("id", "sub").collect())) == sorted((i, f"s{k}") for i, t in events if t in ("hot", "k1", "k2") for k in range(20))
    assert joins.spread_join(left.limit(0), right, ["event_type"]).count() == 0


def test_rules_are_evaluated_where_grids_are_read(spark):
    """Pairs of rules and grids are not shuffled, and come out as joined reads of single pairs would have them."""
    lats, lngs = [30 + 0.25 * i for i in range(6)], [-100 + 0.25 * i for i in range(6)]
    frames = {f"f{k}": [float((i * (k + 3)) % 40) if (i + k) % 7 else NAN for i in range(36)] for k in range(5)}
    grids, blocks, axes_ = make_grid(spark, lats, lngs, frames, 4)
    far = grids.where("file_key = 'f1'").withColumn("file_key", F.lit("unread"))
    grids = grids.unionByName(far).unionByName(grids.where("file_key = 'f2'"))

    def config(kind, k, polygon=None):
        op = (">", "<=", "!=")[k % 3]
        reducer = ("max", "mean", "min", "count_ge")[k % 4] if kind == "polygon" else None
        return (kind, "P" if k % 5 else "Q", "00.50", 30.0 + 0.02 * k, -100.0 + 0.03 * k, polygon, reducer, None if k % 6 == 1 else 9.0, (op, 12.0))

    boxes = [f"{x},{y},{x + w},{y},{x},{y + w}" for x, y, w in ((-100.1, 29.9, 0.8), (-99.4, 30.6, 1.0), (-99.99, 30.01, 0.1), (-80.0, 40.0, 1.0))]
    rows = [(f"p{k}", "s", "active", config("point", k)) for k in range(40)] + [(f"a{k}", "s", "active", config("polygon", k, boxes[k // 4 % 4])) for k in range(30)]
    rows += [("bad", "s", "active", config("polygon", 1, "1,2,3")), ("off", "s", "paused", config("point", 1)), rows[3], rows[45], (rows[46][0], "s", "active", config("polygon", 2, boxes[1]))]
    listed = spark.createDataFrame(rows, f"rule_id string, subscription_id string, status string, config {rules.CONFIG_TYPE}")
    evals = rules.evaluate_rules(listed, grids, blocks, axes_)
    plan = rules.evaluate_rules(listed.where("rule_id NOT IN ('bad') AND rule_id NOT LIKE 'a%'"), grids, blocks, axes_)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(_points")]
    due = joins.rules_for_grids(listed, grids)
    points = due.where("config.type = 'point'").select("rule_id", "file_key", F.col("config.lat").alias("latitude"), F.col("config.lng").alias("longitude"))
    shaped = listed.where("status = 'active' AND config.type = 'polygon'").select(
        F.col("rule_id").alias("polygon_id"), parse_polygon(F.col("config.polygon")).alias("p"), F.col("config.reducer").alias("reducer"),
        F.col("config.count_threshold").alias("threshold"), F.col("config.product").alias("product"), F.col("config.level").alias("level"),
    )
    reduced = grid.reduce_polygons(shaped.where("p.ring IS NOT NULL").withColumn("ring", F.col("p.ring")), blocks).withColumnRenamed("polygon_id", "rule_id")
    area = due.where("config.type = 'polygon'").select("rule_id", "file_key").join(reduced.withColumn("read", F.lit(1)), ["rule_id", "file_key"], "left")
    wrong = shaped.where("p.error_reason IS NOT NULL").select(F.col("polygon_id").alias("rule_id"), F.col("p.error_reason").alias("text"))
    area = area.join(wrong, "rule_id", "left").withColumn("error_reason", F.expr("coalesce(text, error_reason, if(read IS NULL, 'out_of_domain', NULL))"))
    want = grid.sample_points(points, grids, blocks, axes_).select("rule_id", "file_key", "value", "error_reason").unionByName(area.select("rule_id", "file_key", "value", "error_reason"))

    def rounded(df):
        return sorted((r.rule_id, r.file_key, repr(r.value and round(r.value, 9)), r.error_reason) for r in df.collect())

    got = rounded(evals)
    assert got == rounded(want) and {e for *_, e in got} >= {None, "out_of_domain", "missing_threshold"} and len(got) > 400


def test_small_groups_need_no_chunks(spark):
    rows = [(f"r{k % 50}" if k % 11 else None, f"f{k:03d}", at(k if k % 7 else 0), k % 3 == 0) for k in range(600)] + [("r1", "late", None, True)]
    df = spark.createDataFrame(rows, "rule_id string, file_key string, valid_at timestamp, satisfied boolean")
    out = ordering.with_previous(df, ["rule_id"], ["valid_at", "file_key"], ordering.time_chunk(F.col("valid_at"), 3600), F.col("satisfied"), "before")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [lag") == 1
    last, want = {}, {}
    for rule, key, _, held in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        want[rule, key] = last.get(rule)
        last[rule] = held
    got = out.collect()
    assert {(r.rule_id, r.file_key): r.before for r in got} == want and len(got) == len(want)
    # Few groups, each larger than a partition's share, go through their chunks.
    two = ordering.with_previous(df.withColumn("rule_id", F.lit("r")), ["rule_id"], ["valid_at", "file_key"], ordering.time_chunk(F.col("valid_at"), 3600), F.col("satisfied"), "before")
    ordered = sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1]))
    assert {r.file_key: r.before for r in two.collect()} == {r[1]: (ordered[i - 1][3] if i else None) for i, r in enumerate(ordered)}


def test_envelopes_are_read_once(spark, tmp_path):
    spark.range(60).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(24).selectExpr("id AS vec_id", "array_repeat(CAST(id % 5 AS FLOAT) / 5, 64) AS embedding", "CAST(id % 3 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["rule_fired_envelopes"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json(") == 1
    fired = {(r.rule_id, r.file_key) for r in QUERIES["rule_transitions"](spark, str(tmp_path)).where("fired").collect()}
    got = out.collect()
    assert {(r.rule_id, r.file_key) for r in got} == fired != set() and {(r.event, r.type, r.satisfied) for r in got} == {("rule.fired", "WebhookEvent", True)}


def test_rules_without_a_live_subscription_meet_no_grid(spark):
    config = ("point", "P", "L", 0.0, 0.0, None, None, None, (">", 1.0))
    listed = spark.createDataFrame([(f"r{k}", f"s{k % 3}", "active", config) for k in range(6)], f"rule_id string, subscription_id string, status string, config {rules.CONFIG_TYPE}")
    grids = spark.createDataFrame([("f", "P", "L"), ("g", "P", "L")], "file_key string, product string, level string")
    live = spark.createDataFrame([("s0", "active"), ("s0", "active"), ("s1", "paused"), (None, "active")], "id string, status string")
    out = joins.rules_for_grids(listed, grids, live)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
    assert sorted((r.rule_id, r.file_key) for r in out.collect()) == [("r0", "f"), ("r0", "g"), ("r3", "f"), ("r3", "g")]
