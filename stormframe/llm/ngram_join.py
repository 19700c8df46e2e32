"""N-gram Jaccard self-join: grouped prefix join over word shingles.

A text's set holds the hashes of its distinct word shingles.  Under one global order (rare first),
two sets of Jaccard similarity t share an element of their prefixes.  Texts of equal sets are one
class; classes of equal size and prefix are one group, and only groups are joined by prefix elements.
Group pairs whose sizes fit, and that a shared element can be the first to find by its places in both
sets, are expanded to their members and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import VECTOR, WordHasher, discard, mix, summed, text_batches, vector_rows, written
from stormframe.llm.links import grouped_components, touched_members

#: Words of a shingle, and similarity in hundredths, where a caller names no others.
SHINGLE = 4
SIMILAR = 85
#: Bits of the largest frequency sketch that orders shingles, and of the filter on wanted sets.
MOST_SKETCH_BITS, FILTER_BITS = 23, 22

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0F2EC75A1FE1575], np.uint64)


# ---------------------------------------------------------------- sets of shingles


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of shingles of up to ``len(_K)`` words, ascending within each of consecutive texts, and how many each text has."""
    if not 1 <= shingle <= len(_K):
        raise ValueError(f"a shingle has 1 to {len(_K)} words")
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(np.arange(len(hashes)) + shingle <= ends[doc]) if len(hashes) else np.zeros(0, np.int64)
    s = np.zeros(len(whole), np.uint64)
    for j in range(shingle):
        s += hashes[whole + j] * _K[j]
    parts, docs = [mix(s)], [doc[whole]]
    for short in range(1, shingle):
        which = np.flatnonzero(counts == short)
        s = np.full(len(which), short, np.uint64) * np.uint64(0xA0761D6478BD642F)
        for j in range(short):
            s += hashes[ends[which] - short + j] * _K[j]
        parts.append(mix(s))
        docs.append(which)
    s, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(counts))


def _each(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    hasher = WordHasher()
    for batch in (x for whole in batches for x in text_batches(whole, "text")):
        for row, end, hashes, counts in hasher.words(batch.column("text")):
            yield batch.slice(row, end - row), *shingle_sets(hashes, counts, shingle)


def sketch_bits(documents: DataFrame) -> int:
    """Counters for one in fifteen shingles or so, between 2**16 and 2**MOST_SKETCH_BITS."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    return min(max(16, (size // 128).bit_length()), MOST_SKETCH_BITS)


def frequency_ranks(documents: DataFrame, bits: int, shingle: int = SHINGLE) -> np.ndarray:
    """The rank of shingles by the first bits of their hash: a thousand times the binary logarithm of their count.

    Counts are of texts, in 2**bits counters; the rank orders elements, rare ones first, and decides
    nothing else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for _, s, _ in _each(batches, shingle):
            at, n = np.unique(s >> np.uint64(64 - bits), return_counts=True)
            total[at.astype(np.int64)] += n.astype(np.int32)
        yield vector_rows(total)

    def rank(counts: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log2(np.maximum(counts, 1))).astype(np.uint16)

    ranks = summed(documents.select("text").mapInArrow(count, VECTOR), rank)
    return ranks if len(ranks) else np.zeros(1 << bits, np.uint16)


def prefix_size(n: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    return n + (-similar * n // 100) + 1


def prefixes(documents: DataFrame, ranks: np.ndarray, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``(doc_id, key, n, group, prefix)`` per row: the set's key and size, its group, and its rarest elements.

    Keys are 64-bit hashes of sets.  A task gives the prefix only with the first row of each group.
    """
    bits = len(ranks).bit_length() - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, s, n in _each(batches, shingle):
            doc = np.repeat(np.arange(len(n)), n)
            first = np.cumsum(n) - n
            some = n > 0
            sums = np.zeros(len(n), np.uint64)
            if len(s):
                sums[some] = np.add.reduceat(mix(s + np.uint64(0x2545F4914F6CDD1D)), first[some])
            key = mix(sums + n.astype(np.uint64) * _K[0])
            rank = ranks[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
            order = np.lexsort((rank << np.uint64(48) | s >> np.uint64(16), doc))
            size = np.where(some, prefix_size(n, similar), 0)
            inside = np.arange(len(s)) - first[doc] < size[doc]
            chosen = s[order][inside]
            edge = np.concatenate([[0], np.cumsum(size)])
            group = np.zeros(len(n), np.uint64)
            if len(chosen):
                place = (np.arange(len(chosen)) - edge[doc[inside]]).astype(np.uint64)
                group[some] = np.add.reduceat(mix(chosen + place * _K[1]), edge[:-1][some])
            group = mix(group + n.astype(np.uint64) * _K[2])
            lists = []
            for i, g in enumerate(group.tolist()):
                if n[i] and g not in seen:
                    seen.add(g)
                    lists.append(chosen[edge[i] : edge[i + 1]].view(np.int64))
                else:
                    lists.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(group.view(np.int64)), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "group", "prefix"],
            )

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id long, key long, n long, group long, prefix array<long>")


def wanted_sets(documents: DataFrame, keys: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(key, shingles)`` of the sets whose key is in ``keys``, made anew from the texts.

    A filter of at most 2**FILTER_BITS bits goes to the tasks; the join afterwards decides.
    """
    bits = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("bit")).distinct().toArrow()["bit"].to_numpy()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << FILTER_BITS, bool)
        on[bits] = True
        seen: set[int] = set()
        for _, s, n in _each(batches, shingle):
            first, some = np.cumsum(n) - n, n > 0
            if not some.any():
                continue
            sums = np.zeros(len(n), np.uint64)
            sums[some] = np.add.reduceat(mix(s + np.uint64(0x2545F4914F6CDD1D)), first[some])
            key = mix(sums + n.astype(np.uint64) * _K[0])
            out = []
            for i in np.flatnonzero(some & on[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]).tolist():
                if int(key[i]) not in seen:
                    seen.add(int(key[i]))
                    out.append((int(key[i].view(np.int64)), s[first[i] : first[i] + n[i]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["key", "shingles"])

    made = documents.select("text").mapInArrow(rows, "key long, shingles binary").join(keys, "key", "left_semi")
    return made.groupBy("key").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The ``pairs(a, b)`` of keys whose sets reach the similarity."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= similar * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


# ---------------------------------------------------------------- the join


def _sizes_fit(n: Column, m: Column, similar: int) -> Column:
    return 100 * F.least(n, m) >= similar * F.greatest(n, m)


def _found_first(i: Column, n: Column, j: Column, m: Column, similar: int) -> Column:
    """Can the elements at places ``i`` and ``j`` of two sets be the first that linking ones have in common?

    No element before them is common then, so no more can be common than what follows in either set.
    """
    return (100 + similar) * (F.least(n - i, m - j)) >= similar * (n + m)


def class_components(documents: DataFrame, rows: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``(key, label)`` of every class that links with another; label is the smallest key it reaches."""
    groups = rows.where("prefix IS NOT NULL").groupBy("group").agg(F.max("n").alias("n"), F.first("prefix").alias("prefix"))
    members = rows.where("n > 0").select("key", "group").distinct()
    entries = groups.select("group", "n", F.posexplode("prefix").alias("i", "token"))
    # One exchange by token serves both the count and the join.
    entries = entries.repartition("token")
    shared = entries.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("token")
    entries = written(entries.join(shared, "token"), "entries")
    members = touched_members(members, entries)
    sets: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        """Sets are made for the keys of pairs alone, when the first pair needs them."""
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        for made in sets:
            keys = keys.join(made.select("key"), "key", "left_anti")
        keys = written(keys, "wanted")
        if not keys.isEmpty():
            sets.append(written(wanted_sets(documents, keys, shingle), "sets"))
        discard(keys)
        return verified(pairs, reduce(DataFrame.union, sets), similar)

    labels = grouped_components(
        entries,
        members,
        ("n", "i"),
        lambda a, b: _sizes_fit(a("n"), b("n"), similar) & _found_first(a("i"), a("n"), b("i"), b("n"), similar),
        verify,
        # A group with few elements rarer than the shared one is close to what its cluster has in common.
        ("i",),
    )
    for table in (entries, *sets):
        discard(table)
    return labels


def near_copies(documents: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``documents(doc_id, text)``.

    Texts link whose sets of ``shingle`` words have a Jaccard similarity of ``similar`` hundredths.
    component_id is the smallest doc_id that links reach, the row's own included; texts without words
    (null, empty, blanks) have no shingles and link with nothing.  Repeated rows link with each other;
    a row without id links as any other, and its component's id is null only where no member has one.
    """
    rows = written(prefixes(documents, frequency_ranks(documents, sketch_bits(documents), shingle), shingle, similar), "prefixes")
    labels = class_components(documents, rows, shingle, similar)
    placed = rows.select("doc_id", "key", "n").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = placed.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = placed.join(smallest, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
