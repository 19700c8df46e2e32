"""Weather entities derived from the provided tables, as Spark frames.

The provided tables hold no weather data.  Every entity here is a row-wise derivation of
whole tables, so it grows with them; ``oracle`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.functions.geo import PARTS_TYPE
from stormframe.operators.alerts import with_bounds
from stormframe.operators.grid import with_block_bounds
from stormframe.session import configure

# Fixed values shared with the SQL derivations.
EPOCH0 = 1704067200  # 2024-01-01T00:00:00Z
CADENCE = 120
SIDE, BLOCK = 8, 4
LAT0, LNG0, STEP = 30.0, -100.0, 0.25
LEVEL = "00.50"


def at_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class Tables:
    """Derived entities of one data folder; nothing is read before an action needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def base(self, name: str, heavy: bool = False) -> DataFrame:
        """A provided table.  ``heavy`` work per row is dealt out evenly, however the files are cut."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if heavy:
            df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    # --- grids -------------------------------------------------------------------------

    def files(self) -> DataFrame:
        v = F.col("vec_id")
        return self.base("embeddings").select(
            text("frame-", F.lpad(v.cast("string"), 6, "0")).alias("file_key"),
            text("P", v % 2).alias("product"),
            F.lit(LEVEL).alias("level"),
            at_epoch(F.lit(EPOCH0) + F.floor(v / 2) * CADENCE).alias("valid_at"),
            (F.lit(1000) + F.col("label") * 10).cast("long").alias("size_bytes"),
            "vec_id",
        )

    def grids(self) -> DataFrame:
        """Every tenth file is still pending."""
        return self.files().where(F.col("vec_id") % 10 != 9).select(
            "file_key",
            "product",
            "level",
            "valid_at",
            F.lit(SIDE).alias("n_rows"),
            F.lit(SIDE).alias("n_cols"),
            F.lit(BLOCK).alias("block_height"),
            F.lit(BLOCK).alias("block_width"),
            F.concat(F.lit("square-"), "product").alias("axis_key"),
            F.lit(LAT0).alias("lat0"),
            F.lit(STEP).alias("dlat"),
            F.lit(LNG0).alias("lng0"),
            F.lit(STEP).alias("dlng"),
            F.lit(SIDE * SIDE * 4).cast("long").alias("nbytes"),
        )

    def blocks(self) -> DataFrame:
        v = F.col("vec_id")
        missing = (v * 7).cast("long")
        values = F.transform(
            "embedding",
            lambda e, i: F.when((missing + i) % 41 == 0, F.lit(float("nan"))).otherwise(F.lit(20.0) + F.lit(120.0) * e.cast("double")),
        )
        vectors = self.base("embeddings", heavy=True).where(v % 10 != 9).select(
            text("frame-", F.lpad(v.cast("string"), 6, "0")).alias("file_key"),
            text("P", v % 2).alias("product"),
            F.lit(LEVEL).alias("level"),
            at_epoch(F.lit(EPOCH0) + F.floor(v / 2) * CADENCE).alias("valid_at"),
            values.alias("_all"),
        )
        n = SIDE // BLOCK
        spots = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(n) for c in range(n)])
        row0, col0 = F.col("_s.r") * BLOCK, F.col("_s.c") * BLOCK
        piece = F.flatten(
            F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda r: F.slice("_all", (row0 + r) * SIDE + col0 + 1, BLOCK))
        )
        steps = F.sequence(F.lit(0), F.lit(BLOCK - 1))
        packed = vectors.withColumn("_s", F.explode(spots)).select(
            "file_key",
            "product",
            "level",
            "valid_at",
            F.col("_s.r").alias("block_row"),
            F.col("_s.c").alias("block_col"),
            row0.alias("row0"),
            col0.alias("col0"),
            F.lit(BLOCK).alias("height"),
            F.lit(BLOCK).alias("width"),
            F.transform(steps, lambda i: F.lit(LAT0) + (row0 + i) * F.lit(STEP)).alias("lats"),
            F.transform(steps, lambda i: F.lit(LNG0) + (col0 + i) * F.lit(STEP)).alias("lngs"),
            piece.alias("values"),
        )
        return with_block_bounds(packed)

    # --- probes ----------------------------------------------------------------------------

    def points(self) -> DataFrame:
        """Probes in and around the grid, over all frames and some time beyond; every fifth longitude is given in [0, 360)."""
        e, frames = F.col("event_id"), self.base("embeddings").agg(F.max("vec_id") + 1).scalar()
        lng = F.lit(-100.125) + (e % 140) / F.lit(64.0)
        return self.base("events").select(
            e.alias("point_id"),
            text("P", e % 3).alias("product"),
            F.lit(LEVEL).alias("level"),
            at_epoch(F.lit(EPOCH0 - 300) + (e * 37) % (frames * (CADENCE // 2) + 10000)).alias("at_time"),
            text("frame-", F.lpad((e % frames).cast("string"), 6, "0")).alias("frame"),
            (F.lit(29.875) + (F.col("user_id") % 130) / F.lit(64.0)).alias("latitude"),
            F.when(e % 5 == 0, lng + 360.0).otherwise(lng).alias("longitude"),
        )

    def observations(self) -> DataFrame:
        """Station reports as one JSON record per row."""
        e, u = F.col("event_id"), F.col("user_id")
        visib = F.array(*[F.lit(v) for v in ('"10+"', '"M1/4"', '"1/4"', '"1/2"', '"3/4"', '"P6SM"', "7")])
        payload = F.concat(
            F.lit('{"icaoId":"K'), F.lpad((u % 100).cast("string"), 3, "0"),
            F.lit('","reportTime":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit('","lat":'), (F.lit(25) + u % 20).cast("string"),
            F.lit(',"lon":'), (F.lit(-120) + u % 50).cast("string"),
            F.lit(',"rawOb":"'), F.when(e % 29 == 0, F.lit("")).otherwise(text("METAR ", e)),
            F.lit('","temp":'), (F.col("value") / 10).cast("string"),
            F.lit(',"wdir":'), F.when(F.col("event_type") == "error", F.lit('"VRB"')).otherwise(((e * 10) % 360).cast("string")),
            F.lit(',"visib":'), F.get(visib, (e % 7).cast("int")),
            F.lit("}"),
        )
        return self.base("events", heavy=True).select(payload.alias("payload"))

    # --- alerts ------------------------------------------------------------------------------

    def alerts(self) -> DataFrame:
        """Boxes, or every third one the lower-left triangle of its box."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        severity = F.element_at(
            F.array(*[F.lit(s) for s in ("Extreme", "Severe", "Moderate", "Minor", "Unknown")]),
            F.substring("o_orderpriority", 1, 1).cast("int"),
        )
        x0, y0 = F.lit(-120.0) + c % 50, F.lit(25.0) + k % 20
        x1, y1 = x0 + 1 + (k % 4) * 0.5, y0 + 1 + (c % 3) * 0.5

        def vertex(x: Column, y: Column) -> Column:
            return F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat"))

        box = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x1, y1), vertex(x0, y1))
        triangle = F.array(vertex(x0, y0), vertex(x1, y0), vertex(x0, y1))
        ring = F.when(k % 3 == 1, triangle).otherwise(box)
        rows = self.base("orders", heavy=True).select(
            text("A", k).alias("id"),
            text("Storm ", F.col("o_orderstatus")).alias("event"),
            F.when(k % 5 != 0, text("Headline ", k)).alias("headline"),
            F.when(k % 10 != 0, text("Area ", c)).alias("area_desc"),
            severity.alias("severity"),
            F.lit("Expected").alias("urgency"),
            F.lit("Likely").alias("certainty"),
            F.lit(None).cast("string").alias("sender_name"),
            F.col("o_orderdate").alias("onset"),
            F.when(k % 11 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(k % 60).cast("int"))).alias("expires"),
            F.when(k % 23 != 0, F.array(F.array(ring))).cast(PARTS_TYPE).alias("parts"),
        )
        return with_bounds(rows)

    def devices(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.base("customer").select(
            text("dev-", k).alias("token"),
            F.when(k % 17 != 0, F.lit(25.5) + k % 24).alias("latitude"),
            F.when(k % 17 != 0, F.lit(-123.5) + k % 58).alias("longitude"),
        )

    # --- rules and deliveries -----------------------------------------------------------------

    def rules(self) -> DataFrame:
        k = F.col("p_partkey")
        is_point = F.floor(k / 8) % 2 == 0
        x0, y0 = F.lit(-100.0625) + (k % 5) * 0.25, F.lit(29.9375) + (k % 3) * 0.25
        w, h = F.lit(0.5) + (k % 4) * 0.25, F.lit(0.5) + (k % 6) * 0.25
        polygon = F.concat_ws(",", *[v.cast("string") for v in (x0, y0, x0 + w, y0, x0 + w / 2, y0 + h)])
        reducer = F.get(F.array(*[F.lit(r) for r in ("max", "mean", "min", "count_ge")]), (F.floor(k / 16) % 4).cast("int"))
        op = F.get(F.array(*[F.lit(o) for o in (">", ">=", "<", "<=", "==", "!=")]), (F.floor(k / 3) % 6).cast("int"))
        limit = F.when(~is_point & (reducer == "count_ge"), (k % 9).cast("double")).otherwise(F.lit(10.0) + k % 30)
        config = F.struct(
            F.when(is_point, F.lit("point")).otherwise(F.lit("polygon")).alias("type"),
            text("P", k % 8).alias("product"),
            F.lit(LEVEL).alias("level"),
            F.when(is_point, F.lit(29.96875) + (k % 70) * 0.03125).alias("lat"),
            F.when(is_point, F.lit(-100.0) + (k % 64) * 0.03125).alias("lng"),
            F.when(~is_point, polygon).alias("polygon"),
            F.when(~is_point, reducer).alias("reducer"),
            F.when(~is_point & (k % 11 != 0), F.lit(25.0)).alias("count_threshold"),
            F.struct(op.alias("op"), limit.alias("threshold")).alias("predicate"),
        )
        return self.base("part").select(
            k.alias("part"),
            text("R", k).alias("rule_id"),
            text("S", k % 100).alias("subscription_id"),
            F.when(k % 13 == 0, F.lit("paused")).otherwise(F.lit("active")).alias("status"),
            config.alias("config"),
            (k % 2 == 0).alias("currently_firing"),
            at_epoch(F.lit(EPOCH0) + k).alias("created_at"),
        )

    def subscriptions(self) -> DataFrame:
        k = F.col("s_suppkey")
        subjects = F.array(*[F.lit(s) for s in SUBJECT_NAMES])
        return self.base("supplier").select(
            text("S", k).alias("id"),
            F.when(k % 7 == 0, F.lit("paused")).otherwise(F.lit("active")).alias("status"),
            F.slice(subjects, (k % 4 + 1).cast("int"), (k % 3 + 1).cast("int")).alias("events"),
            at_epoch(F.lit(EPOCH0) + k % 10).alias("created_at"),
        )

    def deliveries(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("retrying")
        return self.base("orders").select(
            text("D", F.col("o_orderkey")).alias("id"),
            text("S", F.col("o_custkey") % 100).alias("subscription_id"),
            status.alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    def attempts(self) -> DataFrame:
        k = F.col("o_orderkey")
        codes = F.array(*[F.lit(c).cast("int") for c in (None, 200, 404, 503, 301)])
        return self.base("orders").select(
            text("D", F.floor(k / 4)).alias("delivery_id"),
            (k % 4 + 1).cast("int").alias("attempt"),
            F.get(codes, (F.col("o_custkey") % 5).cast("int")).alias("response_status"),
        )

    def messages(self) -> DataFrame:
        """Events by subject."""
        subjects = F.array(*[F.lit(s) for s in SUBJECT_NAMES])
        return self.base("events").select(
            "event_id", F.get(subjects, (F.col("event_id") % 4).cast("int")).alias("event_type")
        )

    # --- verifications --------------------------------------------------------------------------

    def verifications(self) -> DataFrame:
        p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        flag = F.col("l_returnflag")
        ensemble = flag == "R"
        algorithm = F.when(flag == "A", "persistence").when(flag == "N", "advection").otherwise("lagged-ensemble")
        size = F.when(p % 17 == 0, 8).when(p % 19 == 0, 12).otherwise(10)

        def entry(i: Column) -> Column:
            count = ((p + i) % 4).cast("long")
            return F.struct(
                (i / 10).alias("lower"),
                count.alias("count"),
                F.least(count, ((s + i) % 3).cast("long")).alias("observed"),
                (i / 10 + 0.05).alias("mean_prob"),
            )

        return self.base("lineitem").select(
            algorithm.alias("algorithm"),
            F.get(F.array(F.lit(10), F.lit(30), F.lit(60)), n % 3).alias("horizon"),
            text("P", s % 2).alias("product"),
            F.lit(LEVEL).alias("level"),
            F.when(p % 50 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("sample_count"),
            (F.col("l_discount") * 100).alias("mae"),
            ((F.col("l_tax") - 0.04) * 100).alias("bias"),
            (F.col("l_discount") * 120).alias("rmse"),
            F.when(p % 13 == 0, None).when(n == 7, 40.0).otherwise(35.0).alias("threshold_dbz"),
            n.cast("long").alias("hits"),
            (p % 5).alias("misses"),
            (s % 4).alias("false_alarms"),
            (p % 7).alias("correct_negatives"),
            F.when(ensemble, 8).alias("ensemble_size"),
            F.when(ensemble, F.col("l_discount")).alias("brier_score"),
            F.when(ensemble, F.col("l_tax") * 10).alias("crps"),
            F.when(ensemble, F.transform(F.sequence(F.lit(0), size - 1), entry)).alias("reliability_bins"),
            F.col("l_shipdate").alias("verified_at"),
        )


# Event subjects in order.
SUBJECT_NAMES = ("alerts.nws.new", "mrms.files.new", "mrms.grids.new", "nowcast.grids.new")
