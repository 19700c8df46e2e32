"""Compact monotone sequences and an n-gram trie made of them, queried many keys at a time."""

from __future__ import annotations

import os

import numpy as np

_BLOCK = 8  # words of 64 bits between two stored counts
#: Steps of quantised log10 probabilities, and the lowest value.
STEP, LOWEST = 1 / 4096, -15.9


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, side by side in 64-bit words, with one word to spare."""
    words = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero(shift + np.uint64(bits) > 64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary; access and search by counting bits."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        self.low = _pack(values & np.uint64((1 << self.bits) - 1), self.bits)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        ones = high + np.arange(n)
        size = n + (universe >> self.bits) + 2
        flags = np.zeros(-(-size // (64 * _BLOCK)) * 64 * _BLOCK, np.uint8)
        flags[ones] = 1
        self.upper = np.packbits(flags, bitorder="little").view(np.uint64)
        per = np.bitwise_count(self.upper).reshape(-1, _BLOCK).sum(1)
        self.ones = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        self.zeros = np.arange(len(self.ones)) * 64 * _BLOCK - self.ones

    def to_disk(self, path: str) -> EliasFano:
        """The same sequence with its words in memory-mapped files."""
        for name in ("low", "upper"):
            np.save(f"{path}.{name}.npy", getattr(self, name))
            setattr(self, name, np.load(f"{path}.{name}.npy", mmap_mode="r"))
        return self

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit."""
        counts = self.ones if one else self.zeros
        block = np.searchsorted(counts, k, "right") - 1
        left = k - counts[block]
        word = block * _BLOCK
        current = self.upper[word] if one else ~self.upper[word]
        for _ in range(_BLOCK - 1):
            have = np.bitwise_count(current).astype(np.int64)
            on = left >= have
            if not on.any():
                break
            left = np.where(on, left - have, left)
            word = word + on
            current = np.where(on, self.upper[word] if one else ~self.upper[word], current)
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            half = current & np.uint64((1 << width) - 1)
            have = np.bitwise_count(half).astype(np.int64)
            on = left >= have
            left = np.where(on, left - have, left)
            place += np.where(on, width, 0)
            current = np.where(on, current >> np.uint64(width), half)
        return word * 64 + place

    def get(self, index: np.ndarray) -> np.ndarray:
        high = self._select(index, True) - index
        return (high.astype(np.uint64) << np.uint64(self.bits) | _unpack(self.low, index, self.bits)).astype(np.int64)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is not less than each value, and whether it equals the value."""
        if self.n == 0:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        high, low = values >> self.bits, values.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        # Elements of one high part lie between two clear bits; their low parts ascend.
        end = self._select(high, False) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        stop = end.copy()
        while (open_ := np.flatnonzero(start < stop)).size:
            middle = (start[open_] + stop[open_]) >> 1
            less = _unpack(self.low, middle, self.bits) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            stop[open_] = np.where(less, stop[open_], middle)
        found = start < end
        found[found] = _unpack(self.low, start[found], self.bits) == low[found]
        return start, found


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10, LOWEST, 0.0) / -STEP).astype(np.uint16)


def restored(steps: np.ndarray) -> np.ndarray:
    return steps.astype(float) * -STEP


class Level:
    """Children of contexts: ids relative to the context, made monotone by the context's number, with a value each.

    ``parent`` numbers the context of each entry, ascending; ``ids`` ascend within a context.
    """

    def __init__(self, parent: np.ndarray, ids: np.ndarray, contexts: int, universe: int, values: np.ndarray, path: str):
        self.universe, self.n = universe, len(ids)
        first = np.searchsorted(parent, np.arange(contexts + 1))
        # Where each context's children begin: the trie's pointers.
        self.pointers = EliasFano(first, self.n + 1).to_disk(f"{path}.pointers")
        self.ids = EliasFano(parent.astype(np.int64) * universe + ids, max(1, contexts * universe)).to_disk(f"{path}.ids")
        np.save(f"{path}.values.npy", values)
        self.values = np.load(f"{path}.values.npy", mmap_mode="r")

    def find(self, parent: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each (context, id), and whether it is there; a negative context has no children."""
        known = parent >= 0
        entry, found = np.zeros(len(parent), np.int64), np.zeros(len(parent), bool)
        if self.n and known.any():
            at, hit = self.ids.successor(parent[known] * self.universe + ids[known])
            entry[known], found[known] = at, hit
        return entry, found

    def value(self, entry: np.ndarray) -> np.ndarray:
        return self.values[entry]

    def children(self, context: np.ndarray) -> np.ndarray:
        """How many children contexts have."""
        return self.pointers.get(context + 1) - self.pointers.get(context)


class Trie:
    """Trigram model of some middle words: v -> w, and v -> u -> w for the text u v w.

    Built from counts; keeps smoothed, quantised log10 probabilities and the weights of the lower
    order, in memory-mapped levels under ``folder``.
    """

    def __init__(self, folder: str, universe: int, bigrams: tuple, trigrams: tuple):
        """``bigrams``: (v, w, log p, v's weight per v in ``roots``); ``trigrams``: (v, u, w, log p, weight per (v, u))."""
        self.universe = universe
        path = os.path.join(folder, "level")
        v, w, p, roots, root_weight = bigrams
        self.roots = EliasFano(roots, universe).to_disk(f"{path}-roots")
        self.root_weight = quantised(root_weight)
        self.two = Level(np.searchsorted(roots, v), w, len(roots), universe, quantised(p), f"{path}-2")
        cv, cu, weight, tv, tu, tw, tp = trigrams
        context = np.searchsorted(roots, cv)
        self.contexts = Level(context, cu, len(roots), universe, quantised(weight), f"{path}-c")
        pair = cv.astype(np.int64) * universe + cu
        self.three = Level(np.searchsorted(pair, tv.astype(np.int64) * universe + tu), tw, len(cv), universe, quantised(tp), f"{path}-3")

    def log10(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 p(w | u v); ``base`` is log10 p(w)."""
        root, known = self.roots.successor(v)
        root = np.where(known, root, -1)
        entry, seen = self.two.find(root, w)
        two = base.copy()
        lower = known & ~seen
        two[lower] += restored(self.root_weight[root[lower]])
        two[seen] = restored(self.two.value(entry[seen]))
        context, has = self.contexts.find(root, u)
        entry, seen = self.three.find(np.where(has, context, -1), w)
        lower = has & ~seen
        two[lower] += restored(self.contexts.value(context[lower]))
        two[seen] = restored(self.three.value(entry[seen]))
        return two
