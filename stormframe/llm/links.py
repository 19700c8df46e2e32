"""Connected components of similarity links, from candidates that share a token.

Candidates are groups of keys, each with some tokens; groups that share one may link.  Only connected
components are asked for, so pairs inside one component need no test.  Rounds of stars come first:
each group is tried against one group of another component at a time, which merges dense clusters
with work in proportion to their size; the first hubs are the most central groups, with which the
others of their cluster most likely link.  The last round joins every pair of groups that still lie in
different components, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import discard, written

#: Stars are tried while the pairs left between components outnumber the entries by this, so often at
#: most, and while at least this share of what they try links.
FEW_PAIRS, MOST_STARS, FRUITFUL = 2, 4, 0.25


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` of every node of undirected ``links(a, b)``; component is its smallest node.

    Alternates large-star and small-star steps (every node points its larger, then its smaller,
    neighbours to the least one) until the links are stars.  A hub is never gathered: its
    neighbours stay rows, and only their minimum is aggregated.
    """
    edges = written(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("u"))
        small = small.select("a", "b").union(small.select(F.col("u").alias("a"), "b")).where(F.col("a") != F.col("b")).distinct()
        old, edges = edges, written(small, name)
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def touched_members(members: DataFrame, entries: DataFrame) -> DataFrame:
    """``(key, group, head)`` of the ``members(key, group)`` that can link: of groups with an entry or with several keys.

    The head is the group's smallest key.
    """
    heads = members.groupBy("group").agg(F.min("key").alias("head"), F.max("key").alias("tail"))
    touched = entries.select("group", F.lit(True).alias("touched")).distinct()
    kept = heads.join(touched, "group", "left").where("touched OR head <> tail").select("group", "head")
    return written(members.join(kept, "group"), "members")


def grouped_components(
    entries: DataFrame,
    members: DataFrame,
    carried: tuple[str, ...],
    may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    central: tuple[str, ...] = (),
) -> DataFrame:
    """``(key, label)`` of every key that links with another; label is the smallest key it reaches.

    ``entries(token, group, *carried)`` hold tokens that at least two groups share; ``members(key,
    group, head)`` the keys.  ``may_link(a, b)`` says of two entries of one token whether this token can
    be the one by which their groups are found, and ``verify(pairs(a, b))`` keeps the pairs of keys that
    link.  The first hub of a token is the group least by the ``central`` columns of its entries.
    """
    links = tested = labels = None

    def labelled(frame: DataFrame, key: str) -> DataFrame:
        if labels is None:
            return frame.withColumn("label", F.col(key))
        of = labels.select(F.col("node").alias(key), F.col("component").alias("_c"))
        return frame.join(of, key, "left").withColumn("label", F.coalesce("_c", key)).drop("_c")

    def try_pairs(pairs: DataFrame) -> bool:
        """Verify new pairs; join what links.  False if few of them did."""
        nonlocal links, tested, labels
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        count = pairs.count()
        if not count:
            return False
        tested = pairs if tested is None else tested.union(pairs)
        new = written(verify(pairs), "links")
        linked = new.count()
        if linked:
            links = new if labels is None else labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)
            before, labels = labels, written(components(links, "labels"), "labels")
            discard(new)
            if before is not None:
                discard(before)
        return linked >= FRUITFUL * count

    def here(name: str) -> Column:
        return F.col(name)

    def there(name: str) -> Column:
        return F.col(f"{name}2")

    # Members of one group first: each against the group's head.
    try_pairs(members.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")))
    total = entries.count()
    for star in range(MOST_STARS):
        placed = entries.join(labelled(members.select("group", "head").distinct(), "head"), "group")
        per = placed.groupBy("token", "label").agg(F.count("*").cast("double").alias("c")).groupBy("token")
        left = per.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("left")).agg(F.sum("left")).first()[0] or 0
        if left <= FEW_PAIRS * total:
            break
        first = [F.col(c).alias(f"o_{c}") for c in central] if star == 0 else []
        hub = F.min(F.struct(*first, F.xxhash64("head", F.lit(star)).alias("h"), "head", "label", "group", *carried)).alias("hub")
        hubs = placed.groupBy("token").agg(hub, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "hub")
        near = placed.join(hubs, "token").where((F.col("label") != F.col("hub.label")) & may_link(here, lambda c: F.col(f"hub.{c}")))
        # Of the hubs that a group meets, that with which it shares most.
        met = near.groupBy("head", F.col("hub.head").alias("other")).agg(F.count("*").alias("c"))
        best = met.groupBy("head").agg(F.max(F.struct("c", "other")).alias("m")).select(F.col("head").alias("a"), F.col("m.other").alias("b"))
        if not try_pairs(best):
            break
    # Every pair of groups that is not yet in one component.  Of a token's entries, those of the component
    # with most of them need no comparison with each other, so only the others look for partners.
    state = labelled(members, "key")
    placed = entries.join(state.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "group")
    whole = F.col("lo") == F.col("hi")
    shares = placed.groupBy("token", F.when(whole, F.col("lo")).alias("label")).agg(F.count("*").alias("c"))
    ranked = F.max(F.when(F.col("label").isNotNull(), F.struct("c", "label"))).alias("most")
    open_tokens = shares.groupBy("token").agg(F.count("*").alias("labels"), F.bool_or(F.col("label").isNull()).alias("mixed"), ranked)
    open_tokens = open_tokens.where("labels > 1 OR mixed").select("token", F.col("most.label").alias("main"))
    placed = placed.join(open_tokens, "token").withColumn("seeks", ~F.coalesce(whole & (F.col("lo") == F.col("main")), F.lit(False)))
    other = placed.select("token", *(F.col(c).alias(f"{c}2") for c in ("group", "lo", "hi", "seeks", *carried)))
    once = (F.col("group") != F.col("group2")) & (~F.col("seeks2") | (F.col("group") < F.col("group2")))
    apart = once & (F.least("lo", "lo2") != F.greatest("hi", "hi2"))
    met = placed.where("seeks").join(other, "token").where(apart & may_link(here, there)).select("group", "group2").distinct()
    mine = state.select("group", F.col("key").alias("a"), F.col("label").alias("la"))
    theirs = state.select(F.col("group").alias("group2"), F.col("key").alias("b"), F.col("label").alias("lb"))
    across = met.join(mine, "group").join(theirs, "group2").where("la <> lb").select("a", "b")
    within = mine.join(theirs, F.col("group") == F.col("group2")).where("a < b AND la <> lb").select("a", "b")
    try_pairs(across.union(within))
    if tested is not None:
        discard(tested)
    if labels is None:
        return members.select("key", F.col("key").alias("label")).limit(0)
    return labels.select(F.col("node").alias("key"), F.col("component").alias("label"))
