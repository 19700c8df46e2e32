"""Ordered operators that never put a whole group into one task.

A group (one station, rule or product) may hold a third of all rows, so nothing here
opens a window over a bare group.  Rows are split into (group, time chunk) pieces, each
piece is handled on its own, and what must flow from one chunk to the next travels
through a summary that has one row per chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.operators.joins import hot_keys, hot_rows

DEFAULT_CHUNK_SECONDS = 3600


def time_chunk(time: Column, seconds: int = DEFAULT_CHUNK_SECONDS) -> Column:
    return F.floor(F.unix_timestamp(time) / seconds)


def row_positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column, name: str = "position"
) -> DataFrame:
    """1-based position of each row within its group.

    ``chunk`` must not decrease along ``order``; ``order`` must be total within a group.
    """
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*by, "_chunk"])
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_chunk", "_rank", "_offset")
    )


def with_previous(
    df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Add ``value`` of the preceding row of the group (null on the first).

    A window takes the groups that are small beside a shuffle partition, by the counted rows; the
    others are split by ``chunk``.  ``df`` is read to count and then once or, for large groups, twice more.
    """
    rows = df.withColumn("_chunk", chunk).withColumn("_value", F.struct(value.alias("v")))
    # A group or a time that is missing has no place in an order.
    rows = rows.where(functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, "_chunk")]))
    many = hot_rows(rows, by)
    large = hot_keys(rows, by, many).select(*by)
    small = rows.join(F.broadcast(large), list(by), "left_anti") if many else rows
    whole = Window.partitionBy(*by).orderBy(*order)
    found = small.withColumn(name, F.lag("_value").over(whole)["v"])
    if many:
        rows = rows.join(F.broadcast(large), list(by), "left_semi")
        inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
        last = rows.groupBy(*by, "_chunk").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
        across = Window.partitionBy(*by).orderBy("_chunk")
        carried = last.select(*by, "_chunk", F.lag("_last").over(across).alias("_carried"))
        split = (
            rows.withColumn("_lag", F.lag("_value").over(inside))
            .join(carried, [*by, "_chunk"])
            .withColumn(name, F.coalesce(F.col("_lag"), F.col("_carried"))["v"])
        )
        found = found.unionByName(split.select(*found.columns))
    return found.drop("_chunk", "_value")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    tie_break: str,
    prefix: str = "",
    tolerance_seconds: float | None = None,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Each left row with the latest right row of its group at or before its time.

    Left join: unmatched rows carry nulls.  A right row at exactly the probe time is
    visible; among equal times the largest ``tie_break`` wins.  Right columns other than
    ``by`` are returned under ``prefix + name``.

    Only distinct (group, time) probes enter the ordered step, so repeated probe times -
    the usual form of skew - are folded before the shuffle.
    """
    payload = [c for c in right.columns if c not in by]
    stamped = right.where(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("_t"), F.col(tie_break).alias("_tie"), F.struct(*payload).alias("_row")
    )
    facts = stamped.groupBy(*by, "_t").agg(F.max_by("_row", "_tie").alias("_row"))
    probes = left.where(F.col(left_time).isNotNull()).select(*by, F.col(left_time).alias("_t")).distinct()

    chunk = time_chunk(F.col("_t"), chunk_seconds)
    timeline = (
        facts.withColumn("_probe", F.lit(0))
        .unionByName(probes.withColumn("_probe", F.lit(1)), allowMissingColumns=True)
        .withColumn("_chunk", chunk)
    )
    inside = (
        Window.partitionBy(*by, "_chunk").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    )
    across = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        timeline.groupBy(*by, "_chunk")
        .agg(F.max_by("_row", F.when(F.col("_probe") == 0, F.col("_t"))).alias("_last"))
        .select(*by, "_chunk", F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    )
    resolved = (
        timeline.withColumn("_seen", F.last("_row", ignorenulls=True).over(inside))
        .where(F.col("_probe") == 1)
        .join(carried, [*by, "_chunk"])
        .select(*by, F.col("_t").alias(left_time), F.coalesce("_seen", "_carried").alias("_match"))
    )
    if tolerance_seconds is not None:
        age = F.unix_micros(left_time) - F.unix_micros(F.col("_match")[right_time])
        resolved = resolved.where(age <= tolerance_seconds * 1_000_000)
    joined = left.join(resolved, [*by, left_time], "left")
    return joined.select(*left.columns, *[F.col("_match")[c].alias(prefix + c) for c in payload])
