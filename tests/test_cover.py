"""Points in polygons under a cover cut to the points."""

import random

from pyspark.sql import functions as F

from helpers import START
from stormframe.functions import geo
from stormframe.operators import alerts, joins
from stormframe.plans.all import QUERIES

POLYGONS = "id string, parts array<array<array<struct<lng: double, lat: double>>>>"


def shape(*corners):
    return [[[{"lng": float(x), "lat": float(y)} for x, y in corners]]]


def polygons(spark):
    rng = random.Random(3)
    rows = [
        ("world", shape((-170, -80), (170, -80), (170, 80), (-170, 80))),
        ("hot", shape((10.2, 50.2), (10.9, 50.3), (10.4, 50.8))),
        ("tiny", shape((10.5, 50.5), (10.50001, 50.5), (10.5, 50.50001))),
        ("holed", [[[{"lng": 10.0, "lat": 50.0}, {"lng": 11.0, "lat": 50.0}, {"lng": 11.0, "lat": 51.0}, {"lng": 10.0, "lat": 51.0}], [{"lng": 10.3, "lat": 50.3}, {"lng": 10.7, "lat": 50.3}, {"lng": 10.7, "lat": 50.7}, {"lng": 10.3, "lat": 50.7}]]]),
        ("none", None),
    ]
    for k in range(20):
        x, y = rng.uniform(9, 11.5), rng.uniform(49, 51.5)
        rows.append((f"t{k}", shape((x, y), (x + rng.uniform(0.01, 1), y + rng.uniform(-0.2, 0.2)), (x + rng.uniform(-0.3, 0.3), y + rng.uniform(0.01, 1)))))
    return alerts.with_bounds(spark.createDataFrame(rows, POLYGONS))


def points(spark, n):
    """Nine of ten in one square, half of those at one place; some on corners and squares' borders."""
    rng = random.Random(4)

    def place(i):
        if i % 10 == 0:
            return rng.uniform(-20, 20), rng.uniform(-80, 80)
        return (10.5, 50.5) if i % 2 else (10 + rng.random(), 50 + rng.random())

    rows = [(i, *place(i)) for i in range(n)]
    rows += [(n + 1, 10.2, 50.2), (n + 2, 10.0, 50.0), (n + 3, 11.0, 50.5), (n + 4, 10.5, 50.25), (n + 5, None, 50.0), (n + 6, 10.3, 50.5), (n + 7, -170.0, 0.0)]
    return spark.createDataFrame(rows, "token int, longitude double, latitude double")


def pairs(df):
    return sorted((r.token, r.id) for r in df.select("token", "id").collect())


def test_a_cut_cover_finds_what_squares_alone_find(spark):
    found, shapes = points(spark, 3000), polygons(spark)
    plain = joins.points_in_polygons(found, shapes, cover=joins.Cover(1.0, frozenset(), {}))
    cover = joins.measured_cover(found.where("longitude IS NOT NULL"), F.col("longitude"), F.col("latitude"), most=100)
    assert {k % 8 for k in cover.cut} == set(range(joins.COVER_DEPTH)) and max(cover.parts.values()) >= 8
    cut = joins.points_in_polygons(found, shapes, cover=cover)
    got = pairs(cut)
    assert got == pairs(plain) and len(got) == len(set(got)) and {i for _, i in got} >= {"world", "hot", "holed", "tiny"}
    assert joins.points_in_polygons(found.limit(0), shapes).count() == joins.points_in_polygons(found, shapes.limit(0)).count() == 0


def test_no_square_holds_many_points(spark):
    found = points(spark, 20_000).where("longitude IS NOT NULL")
    cover = joins.measured_cover(found, F.col("longitude"), F.col("latitude"), most=400)
    square = cover.square(F.col("longitude"), F.col("latitude"))
    dealt = found.select(square.alias("s"), F.pmod(F.xxhash64("token"), cover.dealt(square).cast("long")).alias("d"))
    assert dealt.groupBy("s", "d").count().agg(F.max("count")).first()[0] <= 600
    # Most pairs inside need no test of edges.
    listed = joins._cover_polygons(polygons(spark).where("id = 'world'"), cover)
    assert listed.where("_inside").count() > 0.9 * listed.count()


def test_points_meet_polygons_in_packs(spark):
    """Pairs are tested as arrays: no interpreted test of edges runs for each pair."""
    rows = [
        ("two", [*shape((0.1, 0.1), (0.9, 0.1), (0.9, 0.4), (0.1, 0.4)), *shape((0.2, 0.3), (0.8, 0.3), (0.5, 0.9))]),
        ("open", [[[{"lng": 0.1, "lat": 0.1}, {"lng": None, "lat": 0.5}, {"lng": 0.9, "lat": 0.1}, {"lng": 0.5, "lat": 0.8}]]]),
        ("far", shape((5, 5), (6, 5), (6, 6))),
    ]
    shapes = alerts.with_bounds(spark.createDataFrame(rows, POLYGONS))
    rng = random.Random(9)
    at = [(rng.choice((rng.random(), 0.3, 0.5, 0.1)), rng.choice((rng.random(), 0.1, 0.3, 0.4))) for _ in range(400)]
    # Rows may repeat, and keys be null.
    found = spark.createDataFrame([(i if i % 9 else None, x, y) for i, (x, y) in enumerate(at)] * 2, "token int, longitude double, latitude double")
    met = joins.points_in_polygons(found, shapes)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    join = plan[: plan.index("Join")]
    assert "_hits" in join and "exists(" not in join
    parts = shapes.select("id", F.col("parts").alias("whole"))
    plain = found.crossJoin(parts).where(geo.parts_contain_point(F.col("whole"), F.col("longitude"), F.col("latitude")))

    def listed(df):
        return sorted(((r.id, r.token, r.longitude, r.latitude) for r in df.collect()), key=repr)

    got = listed(met)
    assert got == listed(plain) and {r[0] for r in got} == {"two", "open"}


def test_payloads_are_read_once(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(60)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(k, k, "O", "1-URGENT", START) for k in range(60)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    made = QUERIES["push_payloads"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json(") == plan.count("StructsToJsonEvaluator") == 1
    got = made.collect()
    assert got and all(r.title == "Storm O" and r.body and r.lat is not None and r.lng is not None for r in got)
