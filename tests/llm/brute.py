"""Plain versions of the operators, one text after the other."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib


def words(text):
    """Words as bytes, A-Z folded."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").encode().split()


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def near_copies(docs):
    """{id: (shingles, component)}, all pairs compared."""
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    union, ids = Union(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def without_repeats(docs, length=400):
    """{id: (bytes, removed, spans, sha256 of the rest)}; ``docs`` may hold rows more than once."""
    seen = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


class Trigrams:
    """Interpolated absolute discounting over words, without classes or quantisation."""

    def __init__(self, docs, d2, d3):
        self.d2, self.d3 = d2, d3
        self.texts = {i: [*words(t), None] for i, t in docs}
        self.held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in self.texts}
        train = [self.texts[i] for i in self.texts if not self.held[i]]
        self.c = collections.Counter(w for t in train for w in t)
        self.n = sum(self.c.values())
        self.whole = self.n + 0.5 * (len(self.c) + 1)
        self.listed = {w for w, k in self.c.items() if k >= 2 or w is None}
        self.rare = sum(k + 0.5 for w, k in self.c.items() if w not in self.listed) + 0.5
        self.c1, self.c2, self.c3, self.t1, self.t2, self.c12 = (collections.Counter() for _ in range(6))
        for t in train:
            for u, v, w in self.triples(t):
                self.t1[v] += not self.c2[v, w]
                self.t2[u, v] += not self.c3[u, v, w]
                self.c2[v, w] += 1
                self.c3[u, v, w] += 1
                self.c1[v] += 1
                self.c12[u, v] += 1

    def triples(self, text):
        s = ["^", "^", *(w if w in self.listed else "rare" for w in text)]
        return zip(s, s[1:], s[2:], strict=False)

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.5) / self.whole) for w in text)

    def score(self, text):
        total = 0.0
        for (u, v, w), word in zip(self.triples(text), text, strict=True):
            p = self.rare / self.whole if w == "rare" else (self.c[w] + 0.5) / self.whole
            if self.c1[v]:
                p = (max(self.c2[v, w] - self.d2, 0) + self.d2 * self.t1[v] * p) / self.c1[v]
            if self.c12[u, v]:
                p = (max(self.c3[u, v, w] - self.d3, 0) + self.d3 * self.t2[u, v] * p) / self.c12[u, v]
            total += math.log10(p)
            if w == "rare":
                total += math.log10((self.c[word] + 0.5) / self.rare)
        return total


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
