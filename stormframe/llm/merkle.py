"""Merkle manifests of tables: a root that names every row, and proofs of single rows.

The rows of a source are leaves in the order of their ids; every three consecutive nodes are hashed
to one, until one is left, the source's subroot.  Subroots in the order of their sources are hashed
to the root in the same way.

Only every few levels are stored (``Manifest.levels``); a stored node and the nodes below it down to
the next stored level form an aligned subtree of at most ``3**every`` nodes.  Proofs are made from
the top down: each subtree's missing inner nodes are hashed again from its stored nodes, the siblings
on the way of every node are put before the way of the subtree's top, and the rest is dropped.  No
task ever holds more than one such subtree, whatever the size of a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.llm.common import scratch, written

FAN = 3
#: Levels from one stored level to the next.
EVERY = 4
#: What a leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above the row's place in it


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string."""
    return F.sha2(text, 256)


def leaf(**changed: Column) -> Column:
    """Hash of a row's fields, each with its length in bytes; ``-`` where it is null.

    ``changed`` gives other values for some of the fields.
    """

    def one(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[one(name) for name in FIELDS]))


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the sources' trees and of the tree over them, each from the leaves upwards.

    A level holds ``tree``, ``pos``, ``n`` (nodes of the tree on this level) and ``hash``; the lowest
    also ``doc_id``, ``source`` and the columns kept beside a leaf.
    """

    levels: list[DataFrame]
    sources: list[DataFrame]
    every: int

    def root(self) -> DataFrame:
        """The root in one row, or none for an empty table."""
        return self.sources[-1].where("n = 1").select(F.col("hash").alias("root"))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a stored table) sorted into ranges, and the runs of each group in them.

    A run is one group's rows in one range: ``part``, ``first`` (place of its first row), ``before``
    (rows of the group in earlier ranges) and ``n`` (rows of the group).  There are at most as many
    runs as ranges and groups together, so windows over them are small whatever a group's size.
    """
    ranged = rows.repartitionByRange(*by, *order) if by else rows.repartitionByRange(*order)
    stored = written(ranged.sortWithinPartitions(*by, *order).withColumn("at", F.monotonically_increasing_id()), name)
    stored = stored.withColumn("part", F.shiftright("at", _PART_BITS))
    runs = stored.groupBy("part", *by).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy(*by)
    earlier = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return stored, runs.select("part", *by, "first", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("rows").over(group).alias("n"))


def _above(level: str) -> Column:
    """The hashes of the level above ``level``."""
    runs = F.sequence(F.lit(0), F.expr(f"(size({level}) - 1) div {FAN}").cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(F.col(level), i * FAN + 1, FAN), "")))


def _subtrees(nodes: DataFrame, every: int, kept: Sequence[str] = ()) -> DataFrame:
    """Aligned subtrees: ``below`` their stored nodes in order, ``h0`` to ``h<every>`` the hashes of their levels (null above a tree's top)."""
    span = FAN**every
    grouped = (
        nodes.where("n > 1")
        .groupBy("tree", F.expr(f"pos div {span}").alias("top"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *kept))).alias("below"), F.max("n").alias("n"))
        .withColumn("h0", F.transform("below", lambda b: b["hash"]))
    )
    for j in range(every):
        grouped = grouped.withColumn(f"h{j + 1}", F.when(F.col("n") > FAN**j, _above(f"h{j}")))
    return grouped


def _levels(leaves: DataFrame, every: int, folder: str) -> list[DataFrame]:
    """Stored levels above ``leaves``, up to where every tree has come to one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        most = -(-most // FAN**every)
        tops = _subtrees(levels[-1].select("tree", "pos", "n", "hash"), every)
        top = F.coalesce(*[F.get(F.col(f"h{j}"), F.lit(0)) for j in range(every, 0, -1)])
        above = tops.select("tree", F.col("top").alias("pos"), F.ceil(F.col("n") / FAN**every).alias("n"), top.alias("hash"))
        path = f"{folder}/level={len(levels) * every}"
        above.write.option("compression", "zstd").parquet(path)
        levels.append(leaves.sparkSession.read.schema(above.schema).parquet(path))
    return levels


def build(documents: DataFrame, kept: dict[str, Column] | None = None, every: int = EVERY, folder: str | None = None) -> Manifest:
    """The manifest of ``documents``, stored under ``folder`` (a scratch folder, if none is named).

    ``kept`` are further columns to keep beside each leaf, made from the row's own columns.  A null
    source is a source, before all others.  Rows of a source stand in the order of their ids, null
    ids first, and rows with equal ids in the order of their leaves; equal rows are leaves each.  An
    empty table has no root.  Other columns of the table play no part.
    """
    spark = documents.sparkSession
    folder = folder or scratch(spark, "merkle")
    kept = kept or {}
    rows = documents.select("doc_id", "source", leaf().alias("hash"), *[c.alias(name) for name, c in kept.items()])
    # The row's place in the table parts equal rows, so that no range holds more than its share.
    first = written(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    stored, runs = numbered(first, ["source"], ["doc_id", "hash", "row"], "ranges")
    runs = written(runs, "runs")
    # The number of a source among all sources is the number of its tree.
    named, spans = numbered(runs.select("source").distinct(), [], ["source"], "sources")
    trees = named.join(spans.withColumnRenamed("n", "n_trees"), "part").select(
        F.col("source").alias("of"), (F.col("at") - F.col("first") + F.col("before")).alias("tree"), "n_trees"
    )
    places = written(runs.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("part", "of", "first", "before", "n", "tree", "n_trees"), "places")
    same = (stored["part"] == places["part"]) & stored["source"].eqNullSafe(places["of"])
    pos = F.col("at") - F.col("first") + F.col("before")
    numbered_leaves = stored.join(places, same).select("tree", pos.alias("pos"), "n", "hash", "doc_id", "source", *kept)
    numbered_leaves.write.option("compression", "zstd").parquet(f"{folder}/level=0")
    levels = _levels(spark.read.schema(numbered_leaves.schema).parquet(f"{folder}/level=0"), every, folder)

    subroots = levels[0].where("n = 1").select("tree", "hash")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "hash"))
    counts = places.select("tree", "n_trees").distinct()
    over = subroots.join(counts, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("n_trees").alias("n"), "hash")
    return Manifest(levels, _levels(written(over, "subroots"), every, f"{folder}/sources"), every)


_STEP = "array<struct<left: array<string>, right: array<string>>>"


def _ways(levels: list[DataFrame], every: int, tops: DataFrame, carried: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Siblings on the way of every lowest node: ``way`` from the node upwards, then that of its tree's top.

    ``tops`` has ``tree``, ``way`` and ``carried`` columns for the top of each tree.
    """
    found: DataFrame | None = None
    for depth in reversed(range(len(levels))):
        own = kept if depth == 0 else ()
        names = ["tree", "pos", "hash", *own, "way", *carried]
        here = levels[depth].where("n = 1").select("tree", "pos", "hash", *own).join(tops, "tree").select(*names)
        if found is not None:
            above = found.select("tree", F.col("pos").alias("top"), F.col("way").alias("_way"), *carried)
            blocks = _subtrees(levels[depth].select("tree", "pos", "n", "hash", *own), every, own).join(above, ["tree", "top"])
            inner = blocks.select("tree", *[f"h{j}" for j in range(every)], "n", F.posexplode("below").alias("i", "node"), "_way", *carried)

            def step(j: int) -> Column:
                at = F.expr(f"i div {FAN**j}").cast("int")
                place, level = at % FAN, F.col(f"h{j}")
                beside = F.struct(F.slice(level, at - place + 1, place).alias("left"), F.slice(level, at + 2, F.lit(FAN - 1) - place).alias("right"))
                return F.when(F.col("n") > FAN**j, beside)

            way = F.concat(F.array_compact(F.array(*[step(j) for j in range(every)])), F.col("_way"))
            made = inner.select("tree", *[F.col("node")[c].alias(c) for c in ("pos", "hash", *own)], way.cast(_STEP).alias("way"), *carried)
            here = here.unionByName(made)
        found = here
    return found


def proofs(manifest: Manifest, kept: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof`` and the ``kept`` columns of every row.

    ``proof`` lists, level by level from the leaf to the root, the siblings left and right of the
    way; a node without siblings has two empty lists.
    """
    none = F.array().cast(_STEP)
    over = manifest.sources[-1].where("n = 1").select("tree", none.alias("way"), F.col("hash").alias("root"))
    sources = _ways(manifest.sources, manifest.every, over, ["root"], [])
    tops = sources.select(F.col("pos").alias("tree"), "way", F.col("hash").alias("subroot"), "root")
    ways = _ways(manifest.levels, manifest.every, tops, ["subroot", "root"], ["doc_id", "source", *kept])
    return ways.select("doc_id", "source", F.col("hash").alias("leaf"), "subroot", "root", F.col("way").alias("proof"), *kept)


def siblings(proof: Column) -> Column:
    """All hashes of a proof, level by level, left to right."""
    return F.flatten(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(F.concat(F.array_join(s["left"], ""), h, F.array_join(s["right"], ""))))
