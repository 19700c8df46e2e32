"""File listings as a catalog, and grids at rest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stormframe.functions.parsing import FILE_KEY_PATTERN
from stormframe.operators.catalog import filter_catalog, scan_days
from stormframe.operators.grid import explode_cells
from stormframe.sources.partitions import in_partitions, partition_folders, replace_partitions


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """(key, size, etag) of the objects under a folder, keys relative to it; contents are pruned from the scan."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.expr(f"substring(path, {len(whole) + 2})")
    return found.select(key.alias("key"), F.col("length").alias("size"), F.lit(None).cast("string").alias("etag"))


def read_file_catalog(listing: DataFrame) -> DataFrame:
    """Catalog rows from an object listing (key, size, etag).

    ``valid_at`` is null - and the row unusable - where the key is not that of a radar file or
    where its folder and name disagree; see ``usable`` and ``skipped``.
    """

    def part(i: int) -> Column:
        return F.regexp_extract("key", FILE_KEY_PATTERN, i)

    ok = F.coalesce(F.col("key").rlike(FILE_KEY_PATTERN), F.lit(False)) & (part(1) == part(3)) & (part(2) == part(4))
    stamp = F.try_to_timestamp(F.concat(part(5), part(6)), F.lit("yyyyMMddHHmmss"))
    return listing.select(
        F.col("key").alias("file_key"),
        F.when(ok, part(1)).alias("product"),
        F.when(ok, part(2)).alias("level"),
        F.when(ok, stamp).alias("valid_at"),
        F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size_bytes"),
        F.regexp_replace("etag", '^"+|"+$', "").alias("etag"),
    )


def usable(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("valid_at").isNotNull())


def skipped(catalog: DataFrame) -> DataFrame:
    """Number of keys that were not understood."""
    return catalog.agg(F.count_if(F.col("valid_at").isNull()).alias("skipped"))


#: Partition columns of stored blocks.
STORED_BY = ("product", "level", "valid_date")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Store blocks by product, level and day.

    Only the partitions present in the frame are replaced, so rewriting a file means writing
    the day it belongs to.  Rows are sorted by place, which keeps min/max skipping tight.
    """
    dated = blocks.withColumn("valid_date", F.to_date("valid_at"))
    (
        dated.repartition("product", "level", "valid_date", "file_key")
        .sortWithinPartitions("product", "level", "valid_date", "file_key", "block_row", "block_col")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("product", "level", "valid_date")
        .parquet(path)
    )


def replace_grids(spark: SparkSession, path: str, blocks: DataFrame) -> list[str]:
    """Store ``blocks`` in place of the stored versions of their files; the partitions written.

    The days of these files are read, the other files of those days carried over, and the days
    staged and moved in; files of other days are not touched.  The products, levels and days of the
    new files, not their blocks, come to the driver.
    """
    dated = blocks.withColumn("valid_date", F.to_date("valid_at"))
    days = [r.asDict() for r in dated.select(*STORED_BY).distinct().collect()]
    rows = dated
    if partition_folders(spark, path, len(STORED_BY)):
        same_days = read_blocks(spark, path).where(in_partitions(days))
        others = same_days.join(blocks.select("file_key").distinct(), "file_key", "left_anti")
        rows = others.select(*dated.columns).unionByName(dated)
    place = ("file_key", "block_row", "block_col")
    return replace_partitions(rows.repartition(*STORED_BY, "file_key").sortWithinPartitions(*STORED_BY, *place), path, STORED_BY)


def read_blocks(
    spark: SparkSession,
    path: str,
    product: str | None = None,
    level: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Stored blocks; the day partition is pruned from the time window."""
    # Level names such as 00.50 are text, so partition values must not be inferred.
    schema = spark.read.option("mergeSchema", "false").parquet(path).schema
    for name in ("product", "level"):
        schema[name].dataType = StringType()
    blocks = spark.read.schema(schema).parquet(path)
    if since is not None and until is not None:
        blocks = scan_days(blocks, F.lit(since), F.lit(until))
    return filter_catalog(blocks, product, level, since, until)


def read_grid_cells(spark: SparkSession, path: str, **window: object) -> DataFrame:
    """Cells of stored grids."""
    return explode_cells(read_blocks(spark, path, **window))


def grid_locators(blocks: DataFrame) -> DataFrame:
    """Catalog row per stored grid: dims, shape, type and size.

    ``nbytes`` counts four bytes per cell.
    """
    n_rows, n_cols = F.max(F.col("row0") + F.col("height")), F.max(F.col("col0") + F.col("width"))
    located = blocks.groupBy("file_key").agg(
        F.first("product").alias("product"),
        F.first("level").alias("level"),
        F.first("valid_at").alias("valid_at"),
        n_rows.cast("int").alias("n_rows"),
        n_cols.cast("int").alias("n_cols"),
        F.max("height").alias("block_height"),
        F.max("width").alias("block_width"),
    )
    return located.select(
        "*",
        F.to_json(F.array(F.lit("latitude"), F.lit("longitude"))).alias("dims"),
        F.to_json(F.array("n_rows", "n_cols")).alias("shape"),
        F.lit("float32").alias("dtype"),
        (F.col("n_rows").cast("long") * F.col("n_cols") * 4).alias("nbytes"),
    )
