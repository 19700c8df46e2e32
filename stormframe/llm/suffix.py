"""Removal of repeated byte strings with suffix arrays by induced sorting.

A string of ``LENGTH`` bytes is kept only where it starts once in the whole corpus.  Its anchor, the
least hash among its ``GRAM``-byte pieces, depends on the string alone, so equal strings have equal
anchors: consecutive starts of one anchor form a fragment, and fragments are dealt to shards by
anchor.  Anchors that occur once cannot hold a repeat.  Each shard sorts the suffixes of its distinct
fragments: suffixes are classified, leftmost-smaller ones are sorted recursively, the rest is induced
from them, and permuted common prefixes show which starts share ``LENGTH`` bytes with another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import as_binary, mix, text_batches, written

LENGTH = 400
GRAM = 32
#: Bits of the filter on anchors that occur twice, and bytes of distinct fragments of one shard, about.
FILTER_BITS, SHARD_BYTES = 26, 1_500_000
#: Bytes of distinct fragments of one anchor up to which they are sorted together, and strings of a
#: more common anchor that are compared in one task, about.
ANCHOR_BYTES, TASK_STRINGS = 750_000, 2_000_000
#: Bytes of text that one numpy pass works on; longer texts are cut, their strings overlapping.
PIECE_BYTES = 2_000_000
CHUNKS = 64

_rng = np.random.Generator(np.random.PCG64(606))
_BYTE = _rng.integers(1, 2**63, 259, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


class Hashes:
    """Hashes of any substrings of ``data`` by prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


# ---------------------------------------------------------------- suffix arrays


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each element among the equal ones, of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return np.arange(len(sorted_keys)) - np.repeat(first, np.diff(np.concatenate([first, [len(sorted_keys)]])))


def _larger(t: np.ndarray) -> np.ndarray:
    """True where a suffix is larger than the one after it; the last symbol is the unique least one."""
    n = len(t)
    out = np.zeros(n, bool)
    change = np.flatnonzero(t[:-1] != t[1:])
    nearest = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    out[:-1] = t[nearest] > t[nearest + 1]
    return out


def _induce(t: np.ndarray, larger: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array in which ``seeds`` (leftmost-smaller suffixes) keep their order within a bucket.

    A bucket is one symbol.  All of a bucket's entries that are known induce the suffixes before
    them in one step; only runs of one symbol take a step per length.
    """
    n = len(t)
    sizes = np.bincount(t, minlength=sigma)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int32)
    by_symbol = np.argsort(t[seeds], kind="stable")
    seeds = seeds[by_symbol]
    seed_edges = np.searchsorted(t[seeds], np.arange(sigma + 1))
    head, larger_end = heads.copy(), heads.copy()

    def give(entries: np.ndarray, want: bool, pointer: np.ndarray, step: int) -> None:
        before = entries[entries > 0] - 1
        before = before[larger[before] == want]
        if len(before):
            symbols = t[before]
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            place = pointer[symbols] + step * _ranks(symbols)
            sa[place] = before
            count = np.bincount(symbols, minlength=sigma)
            pointer += step * count

    for c in range(sigma):
        at = heads[c]
        while at < head[c]:
            upto = head[c]
            give(sa[at:upto], True, head, 1)
            at = upto
        larger_end[c] = head[c]
        if seed_edges[c] < seed_edges[c + 1]:
            give(seeds[seed_edges[c] : seed_edges[c + 1]], True, head, 1)
    # Seeds have done their part; the smaller suffixes are induced anew, from the right.
    tail = ends - 1
    for c in range(sigma - 1, -1, -1):
        at = ends[c] - 1
        while at > tail[c]:
            upto = tail[c]
            give(sa[upto + 1 : at + 1][::-1], False, tail, -1)
            at = upto
        if larger_end[c] > heads[c]:
            give(sa[heads[c] : larger_end[c]][::-1], False, tail, -1)
    sa[0] = n - 1
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet: ranks of doubled length, of what is not yet unique."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    s = names[order]
    start = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    size = np.diff(np.concatenate([np.flatnonzero(start), [n]]))
    open_ = order[np.repeat(size, size) > 1]
    step = 1
    while len(open_):
        after = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        own = rank[open_]
        by = np.lexsort((after, own))
        open_, own, after = open_[by], own[by], after[by]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        first = np.flatnonzero(group)
        new = group | np.concatenate([[True], after[1:] != after[:-1]])
        place = np.arange(len(open_))
        base = own - np.repeat(first, np.diff(np.concatenate([first, [len(open_)]]))) + place
        rank[open_] = base[np.maximum.accumulate(np.where(new, place, 0))]
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(open_)]]))
        open_ = open_[np.repeat(size, size) > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of ``t`` in order.  ``t`` ends with its only 0; symbols are below ``sigma``."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    larger = _larger(t)
    leftmost = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    if len(leftmost) > 1:
        sa = _induce(t, larger, leftmost, sigma)
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        in_order = sa[is_leftmost[sa]]
        # Neighbours of equal length and hash are the same substring.
        until = np.empty(n, np.int64)
        until[leftmost] = np.concatenate([leftmost[1:] + 1, [n]])
        stretch = until[in_order] - in_order
        if sigma <= len(_BYTE):
            h = Hashes(t).of(in_order, until[in_order])
        else:
            up, down = powers(n + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(t.astype(np.uint64)) * up[:n])])
            h = (sums[until[in_order]] - sums[in_order]) * down[in_order]
        new = np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (h[1:] != h[:-1])])
        name = np.empty(n, np.int64)
        name[in_order] = np.cumsum(new) - 1
        names = name[leftmost]
        kinds = int(new.sum())
        if kinds == len(leftmost):
            order = np.empty(kinds, np.int64)
            order[names] = np.arange(kinds)
        elif kinds * 64 < len(leftmost):
            # Few symbols: the same steps once more.
            order = suffix_array(np.concatenate([names + 1, [0]]), kinds + 1)[1:]
        else:
            order = _by_doubling(names)
        leftmost = leftmost[order]
    return _induce(t, larger, leftmost, sigma)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix (up to ``most``) of its suffix and the one before it in order.

    Where both suffixes are preceded by the same symbol, the value is one less than that of the
    position before; only the other positions are measured.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    same = (i > 0) & (before > 0) & (t[i - 1] == t[np.maximum(before, 1) - 1])
    # A position whose neighbour on the left has no suffix before it is measured too.
    same[1:] &= before[:-1] >= 0
    measured = np.flatnonzero(~same & (before >= 0))
    h, a, b = Hashes(t), measured, before[measured]
    low, high = np.zeros(len(a), np.int64), np.minimum(most, n - np.maximum(a, b))
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = h.of(a, a + middle) == h.of(b, b + middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    # Values at most ``most`` at measured positions fall by one a step, which cannot pass a smaller true value.
    reach = np.full(n, -1, np.int64)
    reach[measured] = measured + low
    return np.maximum(np.maximum.accumulate(reach) - i, 0)


def repeated_starts(fragments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per fragment, a mask of the starts whose ``length`` bytes start in another place of these fragments as well."""
    sizes = np.array([len(f) for f in fragments])
    t = np.ones(int(sizes.sum()) + len(fragments) + 1, np.int16)
    edges = np.cumsum(sizes + 1) - sizes - 1
    for f, e in zip(fragments, edges, strict=True):
        t[e : e + len(f)] = np.frombuffer(f, np.uint8).astype(np.int16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    # Fragments differ, so no common prefix reaches over a whole one: two of the longest bound it.
    common = permuted_common_prefixes(t, sa, 2 * int(sizes.max()) + 2)
    hit = common >= length
    hit[sa[:-1]] |= common[sa[1:]] >= length
    return [hit[e : e + max(0, len(f) - length + 1)] for f, e in zip(fragments, edges, strict=True)]


# ---------------------------------------------------------------- anchors and fragments


def anchors(data: np.ndarray, edges: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that have one anchor: first start, number of starts, piece and the anchor's hash.

    ``edges`` bound the pieces of ``data``; strings lie within a piece.
    """
    n, wide = len(data), length - gram + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    h = Hashes(data)
    at = np.arange(n - gram + 1)
    h = mix(h.of(at, at + gram))
    # The least hash in a window of pieces, the leftmost of equals: from both ends of blocks as wide.
    key = (h & ~np.uint64((1 << 23) - 1)) | at.astype(np.uint64)
    blocks = -(-len(key) // wide)
    grid = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(blocks, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    place = np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64((1 << 23) - 1)
    place = place.astype(np.int64)
    piece = np.searchsorted(edges, np.arange(starts), "right") - 1
    inside = np.arange(starts) + length <= edges[piece + 1]
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    closed = np.concatenate([np.flatnonzero(~inside), [starts]])
    stop = np.minimum(np.concatenate([first[1:], [starts]]), closed[np.searchsorted(closed, first)])
    # Least hashes are small numbers; mixed once more, an anchor's bits are even again.
    return first, stop - first, piece[first], mix(h[place[first]])


def pieces(texts: pa.Array, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, edges, rows, offsets)``: texts side by side, about ``PIECE_BYTES`` at a time; longer ones are cut, their strings overlapping."""
    texts = as_binary(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    parts: list[tuple[int, int, int]] = []
    held = 0
    for row in range(len(texts)):
        lo, hi = int(offsets[row]), int(offsets[row + 1])
        for at in range(lo, max(lo, hi - length + 1), PIECE_BYTES):
            end = min(hi, at + PIECE_BYTES + length - 1)
            if held and held + end - at > PIECE_BYTES + length:
                yield _joined(data, parts, offsets)
                parts, held = [], 0
            parts.append((row, at, end))
            held += end - at
    if parts:
        yield _joined(data, parts, offsets)


def _joined(data: np.ndarray, parts: list[tuple[int, int, int]], offsets: np.ndarray):
    rows = np.array([p[0] for p in parts])
    edges = np.concatenate([[0], np.cumsum([e - a for _, a, e in parts])])
    return np.concatenate([data[a:e] for _, a, e in parts]), edges, rows, np.array([a for _, a, _ in parts]) - offsets[rows]


def repeated_anchors(texts: DataFrame) -> np.ndarray:
    """A filter, packed bits, that holds every anchor with two runs or more; 2**FILTER_BITS bits at any size."""
    width = 1 << (FILTER_BITS - CHUNKS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in text_batches(whole, "text")):
            found = [anchors(data, edges)[3] for data, edges, _, _ in pieces(batch.column("text"))]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            on[(batch.column("anchor").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        rows = [zlib.compress(np.packbits(c).tobytes(), 1) for c in on.reshape(CHUNKS, width)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([part % 16] * CHUNKS, pa.int32()), pa.array(rows, pa.binary())], ["chunk", "part", "bits"]
        )

    def unite(table: pa.Table) -> pa.Table:
        on = np.zeros(width // 8, np.uint8)
        for b in table["bits"].to_pylist():
            on |= np.frombuffer(zlib.decompress(b), np.uint8)
        return pa.table({"chunk": table["chunk"][:1], "part": table["part"][:1], "bits": [zlib.compress(on.tobytes(), 1)]})

    schema = "chunk int, part int, bits binary"
    counts = texts.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    some = counts.select("anchor").mapInArrow(bits, schema).groupBy("chunk", "part").applyInArrow(unite, schema)
    out = np.zeros((CHUNKS, width // 8), np.uint8)
    for c in some.groupBy("chunk").applyInArrow(unite, schema).toArrow().to_pylist():
        out[c["chunk"]] = np.frombuffer(zlib.decompress(c["bits"]), np.uint8)
    return out.ravel()


def fragments(texts: DataFrame, filter_bits: np.ndarray) -> DataFrame:
    """``(anchor, digest, doc_id, mark, start, n, body)``: a row per run whose anchor the filter holds.

    ``n`` counts the run's starts.  The bytes come with the first row of a digest in a task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (x for whole in batches for x in text_batches(whole, "text")):
            ids, marks = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy()
            null = np.array(batch.column("doc_id").is_null())
            for data, edges, owner, offset in pieces(batch.column("text")):
                first, n, piece, h = anchors(data, edges)
                spot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                on = np.flatnonzero((filter_bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1)
                first, n, piece, h = first[on], n[on], piece[on], h[on]
                digests, bodies = [], []
                for a, k in zip(first.tolist(), n.tolist(), strict=True):
                    body = data[a : a + k + LENGTH - 1].tobytes()
                    digest = hashlib.blake2b(body, digest_size=16).digest()
                    digests.append(digest)
                    bodies.append(None if digest in seen else zlib.compress(body, 1))
                    seen.add(digest)
                row = owner[piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(digests, pa.binary()),
                        pa.array(ids[row], pa.int64(), mask=null[row]) if len(row) else pa.array([], pa.int64()),
                        pa.array(marks[row], pa.int64()),
                        pa.array(first - edges[piece] + offset[piece], pa.int64()),
                        pa.array(n, pa.int32()),
                        pa.array(bodies, pa.binary()),
                    ],
                    ["anchor", "digest", "doc_id", "mark", "start", "n", "body"],
                )

    return texts.mapInArrow(rows, "anchor long, digest binary, doc_id long, mark long, start long, n int, body binary")


def repeats_in_shards(made: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(digest, starts, ends)`` of every fragment with repeated starts, as ranges relative to its first one.

    Copies of one fragment are one string with a count.  The strings of anchors that have several
    distinct ones are dealt to shards of about ``shard_bytes`` and sorted there; an anchor of very many
    (a line that a third of all texts hold, in other surroundings each time) is dealt string by string.
    """
    counts = made.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    per = counts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + LENGTH).alias("bytes"))
    counts = counts.join(per, "anchor")
    counts = written(counts, "fragment-counts")
    copied = counts.where("copies > 1").select(
        "digest", F.array(F.lit(0)).alias("starts"), F.array(F.col("n").cast("int")).alias("ends")
    )
    mixed = counts.where("kinds > 1")
    common = F.col("bytes") > ANCHOR_BYTES
    total = mixed.agg(F.sum(F.when(~common, F.col("n") + LENGTH)).alias("bytes"), F.sum(F.when(common, F.col("n"))).alias("strings")).first()
    shards = max(1, -(-(total["bytes"] or 0) // shard_bytes))
    bodies = made.where("body IS NOT NULL").select("anchor", "digest", "body")
    bodies = bodies.join(mixed.select("anchor", common.alias("common")).distinct(), "anchor")

    def sort(table: pa.Table) -> pa.Table:
        distinct = dict(zip(table["digest"].to_pylist(), table["body"].to_pylist(), strict=True))
        digests = sorted(distinct)
        masks = repeated_starts([zlib.decompress(distinct[d]) for d in digests])
        out: dict[str, list] = {"digest": [], "starts": [], "ends": []}
        for d, mask in zip(digests, masks, strict=True):
            if mask.any():
                change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                out["digest"].append(d)
                out["starts"].append(change[::2].tolist())
                out["ends"].append(change[1::2].tolist())
        kinds = {"digest": pa.binary(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    dealt = bodies.where("NOT common").select(F.pmod("anchor", F.lit(shards)).alias("shard"), "digest", "body")
    found = dealt.groupBy("shard").applyInArrow(sort, "digest binary, starts array<int>, ends array<int>")
    if total["strings"]:
        found = found.union(repeats_one_by_one(bodies.where("common").select("digest", "body"), -(-total["strings"] // TASK_STRINGS)))
    # A copied fragment is repeated as a whole, whatever else it shares.
    return copied.union(found.join(copied.select("digest"), "digest", "left_anti"))


def repeats_one_by_one(bodies: DataFrame, parts: int) -> DataFrame:
    """``(digest, starts, ends)`` as above, of fragments too many to be sorted together.

    Every string goes, as a 64-bit hash, to the task of that hash; hashes that two places share come
    back to their fragments.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner, place, digests = [], [], [], batch.column("digest").to_pylist()
            for k, body in enumerate(batch.column("body").to_pylist()):
                data = np.frombuffer(zlib.decompress(body), np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                hashes.append(mix(Hashes(data).of(at, at + LENGTH)))
                owner.append(np.full(len(at), k, np.int32))
                place.append(at.astype(np.int32))
            if not hashes:
                continue
            h, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[p] : edges[p + 1]]
                used, local = np.unique(owner[own], return_inverse=True)
                columns = [[p], [h[own].tobytes()], [local.astype(np.int32).tobytes()], [place[own].tobytes()], [b"".join(digests[u] for u in used)]]
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "h", "owner", "place", "digests"])

    def compare(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        h, owner, place = [], [], []
        for hs, own, at, ds in zip(*(table[c].to_pylist() for c in ("h", "owner", "place", "digests")), strict=True):
            numbers = np.array([number.setdefault(ds[i : i + 16], len(number)) for i in range(0, len(ds), 16)])
            h.append(np.frombuffer(hs, np.uint64))
            owner.append(numbers[np.frombuffer(own, np.int32)])
            place.append(np.frombuffer(at, np.int32))
        h, owner, place = np.concatenate(h), np.concatenate(owner), np.concatenate(place)
        # A fragment that several tasks sent counts once.
        order = np.lexsort((place, owner, h))
        h, owner, place = h[order], owner[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
        h, owner, place = h[new], owner[new], place[new]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        # One row per fragment, with all its places.
        owner, place = owner[twice], place[twice]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        digests = list(number)
        places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(place)), pa.int32()), pa.array(place, pa.int32()))
        return pa.table({"digest": pa.array([digests[i] for i in owner[begins]], pa.binary()), "places": places})

    dealt = bodies.mapInArrow(deal, "part int, h binary, owner binary, place binary, digests binary")
    hit = dealt.groupBy("part").applyInArrow(compare, "digest binary, places array<int>")
    # A fragment's places are fewer than its bytes.
    per = hit.groupBy("digest").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("starts"))
    return per.select("digest", "starts", F.transform("starts", lambda i: i + 1).alias("ends"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``documents(doc_id, text)``.

    Every byte goes that lies in a string of ``LENGTH`` bytes which also starts elsewhere; null reads
    as empty; repeated rows are each other's repeats; a null id is kept as it is.
    """
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    made = written(fragments(texts, repeated_anchors(texts)), "fragments")
    found = repeats_in_shards(made)
    span = F.explode(F.arrays_zip("starts", "ends")).alias("s")
    spans = made.select("digest", "doc_id", "mark", "start").join(found, "digest").select("doc_id", "mark", "start", span)
    spans = spans.select("doc_id", "mark", F.struct((F.col("start") + F.col("s.starts")).alias("a"), (F.col("start") + F.col("s.ends") - 1 + LENGTH).alias("b")).alias("s"))
    # A text's spans are fewer than its bytes.
    gone = spans.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    placed = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in text_batches(whole, "text")):
            out = []
            for doc_id, body, spans in zip(batch.column("doc_id").to_pylist(), as_binary(batch.column("text")).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                digest, upto, removed, runs = hashlib.sha256(), 0, 0, 0
                begin = end = 0
                for s in [*(spans or []), {"a": len(body) + 1, "b": len(body) + 1}]:
                    if s["a"] > end or end == 0:
                        if end:
                            digest.update(body[upto:begin])
                            upto, removed, runs = end, removed + end - begin, runs + 1
                        begin, end = s["a"], s["b"]
                    else:
                        end = max(end, s["b"])
                digest.update(body[upto:])
                out.append((doc_id, len(body), removed, runs, digest.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return placed.select("doc_id", "text", "spans").mapInArrow(cut, schema)
