"""Stored tables changed partition by partition.

New contents are staged in a folder beside the table and then moved in, one partition at a time, so a
job may read what it replaces.  Partitions that a change does not touch keep their files.  Listing,
moving and deleting go by folder names alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stormframe.operators.changes import INSERTED, KEPT, UPDATED, upsert
from stormframe.session import scratch_folder

SOURCE_DATE, SOURCE_AT = "source_date", "source_at"


def _hadoop(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def partition_folders(spark: SparkSession, path: str, depth: int = 1) -> list[str]:
    """Names of a table's partition folders, relative to it, without reading any file."""
    names = [""]
    for _ in range(depth):
        deeper = []
        for name in names:
            fs, where = _hadoop(spark, f"{path}/{name}".rstrip("/"))
            if fs.exists(where):
                found = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
                deeper += [f"{name}/{n}".lstrip("/") for n in found if "=" in n and not n.startswith(("_", "."))]
        names = deeper
    return sorted(names)


def drop_partition(spark: SparkSession, path: str, name: str) -> None:
    fs, where = _hadoop(spark, f"{path}/{name}")
    fs.delete(where, True)


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> list[str]:
    """Put ``rows`` in place of the partitions they belong to; other partitions are not touched.

    ``rows`` may be read from the table itself.  Written again after a failure, the outcome is the same.
    """
    spark, stage = rows.sparkSession, f"{path.rstrip('/')}_stage-{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(stage)
    names = partition_folders(spark, stage, len(by))
    for name in names:
        fs, new = _hadoop(spark, f"{stage}/{name}")
        _, old = _hadoop(spark, f"{path}/{name}")
        fs.delete(old, True)
        fs.mkdirs(old.getParent())
        fs.rename(new, old)
    fs, left = _hadoop(spark, stage)
    fs.delete(left, True)
    return names


def in_partitions(values: Sequence[Mapping[str, object]]) -> Column:
    """Rows of the named partitions, as literals that prune folders."""
    every = [reduce(and_, [F.col(c) == v if v is not None else F.col(c).isNull() for c, v in one.items()]) for one in values]
    return reduce(or_, every, F.lit(False))


# --- upserts -----------------------------------------------------------------------------------


def upsert_stored(
    path: str,
    schema: StructType,
    batch: DataFrame,
    keys: Sequence[str],
    mutable: Sequence[str],
    now: datetime | Column,
    by: Sequence[str],
    batch_order: Sequence[str] | None = None,
    only_changed: bool = True,
) -> DataFrame:
    """Apply a batch to a stored table; the batch's rows with their ``action``.

    ``by`` are the table's partition columns, which a row's key decides for good (the day of a file, or
    a bucket of the key).  Only partitions that the batch has keys in are read, and only those in
    which a row is inserted or updated are written; the names of the former come to the driver, at
    most one per partition of the table.
    """
    spark = batch.sparkSession
    touched = [r.asDict() for r in batch.select(*by).distinct().collect()]
    exists = bool(partition_folders(spark, path, len(by)))
    target = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    folder = scratch_folder(spark, "upsert")
    upsert(target.where(in_partitions(touched)), batch, keys, mutable, now, batch_order, only_changed).write.parquet(folder)
    done = spark.read.parquet(folder).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], "action")
    changed = [r.asDict() for r in done.where(F.col("action").isin(INSERTED, UPDATED)).select(*by).distinct().collect()]
    if changed:
        replace_partitions(done.where(in_partitions(changed)).drop("action"), path, by)
    return done.where(F.col("action") != KEPT)


# --- retention ----------------------------------------------------------------------------------


def write_dated(rows: DataFrame, path: str, source_at: Column, mode: str = "append") -> None:
    """Store rows under the day of the file they fall with: its own time for a file or grid, its source's for a nowcast.

    For a verification that is the earlier of its nowcast's source and its observation.
    """
    dated = rows.withColumn(SOURCE_AT, source_at).withColumn(SOURCE_DATE, F.date_format(SOURCE_AT, "yyyy-MM-dd"))
    dated.write.mode(mode).partitionBy(SOURCE_DATE).parquet(path)


def prune_stored(spark: SparkSession, tables: Mapping[str, str], hours: int, now: datetime) -> dict[str, dict[str, int]]:
    """Delete what falls with files older than ``hours`` from tables stored by ``write_dated``.

    Whole days before the cut are dropped as folders; of each table one day is read and, if rows of
    it fall, written again.  Rows without a time stay.  Per table: ``days`` dropped, ``rows`` deleted
    (those of dropped days are counted in file footers).  Doing it again changes nothing.
    """
    if hours <= 0:
        raise ValueError("retention must be positive")
    cut = now - timedelta(hours=hours)
    last = f"{cut:%Y-%m-%d}"
    tally = {}
    for name, path in tables.items():
        days = {n.split("=", 1)[1]: n for n in partition_folders(spark, path)}
        gone = [n for day, n in sorted(days.items()) if day[:1].isdigit() and day < last]
        rows = sum(spark.read.parquet(f"{path}/{n}").count() for n in gone)
        for n in gone:
            drop_partition(spark, path, n)
        if last in days:
            day = spark.read.parquet(f"{path}/{days[last]}")
            falls = F.col(SOURCE_AT) < F.lit(cut)
            lost = day.where(falls).count()
            if lost:
                rows += lost
                kept = day.where(~falls).withColumn(SOURCE_DATE, F.lit(last))
                if not replace_partitions(kept, path, [SOURCE_DATE]):
                    drop_partition(spark, path, days[last])
        tally[name] = {"days": len(gone), "rows": rows}
    return tally
