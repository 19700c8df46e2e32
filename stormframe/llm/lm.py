"""Scoring of texts with a trigram model kept in Elias-Fano tries.

Symbols are the commonest words of the training texts, the end of a text, and one class for all other
words; a word of that class has the class's probability times its own share of it.  Probabilities are
interpolated with absolute discounting down to the smoothed word frequencies, so they sum to one.

The model is never gathered: text is dealt by the middle word of its trigrams, and a shard holds, for
its middle words, every bigram and trigram there is.  It counts those of the training texts, builds
its trie, looks up its part of every text, and returns sums per text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import VECTOR, WordHasher, held_out, mix, summed, text_batches, vector_rows, written
from stormframe.llm.eliasfano import Trie

#: Words with a symbol of their own, at most; a bounded table that goes to every task.
VOCABULARY = 1 << 17
#: Discounts of bigram and trigram counts.
DISCOUNT_2, DISCOUNT_3 = 0.75, 0.85
#: Tokens of one shard and of one block of text on its way there, about; a middle word of more than a
#: 64th of all tokens is split by the word before it.
SHARD_TOKENS, BLOCK_TOKENS, HOT_SHARE = 3_000_000, 4_000_000, 64
#: Distinct trigrams that a shard looks up at once.
ASKED = 1 << 18
END_HASH = int(mix(np.array([0x454E44], np.uint64))[0])
RARE = 0
_SLOTS = 1 << 20


class Symbols:
    """Hash to symbol: RARE for all but the listed hashes, 1.. in their order; the end of a text follows, then its beginning."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.end, self.begin, self.universe = len(hashes) + 1, len(hashes) + 2, len(hashes) + 3
        self.tables: list[np.ndarray] = []
        left = np.arange(1, len(hashes) + 1)
        # Two tables by different bits of the hash; what fits in neither stays in a sorted rest.
        for shift in (44, 20):
            table = np.zeros(_SLOTS, np.int32)
            slot = self._slot(hashes[left - 1], shift)
            table[slot[::-1]] = left[::-1]
            left = left[table[slot] != left]
            self.tables.append(table)
        self.known = np.concatenate([[np.uint64(0)], hashes])
        rest = np.sort(hashes[left - 1])
        self.rest, self.rest_symbol = rest, left[np.argsort(hashes[left - 1])]

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64(_SLOTS - 1)).astype(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for table, shift in zip(self.tables, (44, 20), strict=True):
            s = table[self._slot(h, shift)]
            out = np.where((s > 0) & (self.known[s] == h), s, out)
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h), len(self.rest) - 1)
            out = np.where(self.rest[at] == h, self.rest_symbol[at], out)
        return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Texts with their token hashes, the end of each included, and how many there are."""
    hasher = WordHasher()
    for batch in (x for whole in batches for x in text_batches(whole, "text")):
        for row, end, hashes, counts in hasher.words(batch.column("text")):
            tokens = np.insert(hashes, np.cumsum(counts), np.uint64(END_HASH))
            yield batch.slice(row, end - row), tokens, counts + 1


def _flag(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def common_words(texts: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """Hashes of about the commonest words of the training texts, commonest first.

    Tasks report words in proportion to their own size; which words are listed shapes the model, and
    exact counts follow separately.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = (n >= max(1, size // (8 * most))) & (h != np.uint64(END_HASH))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for batch, tokens, counts in _texts(batches):
            tokens = tokens[np.repeat(_flag(batch, "train"), counts)]
            held.append(tokens)
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield flush()
                size = 0
        if size:
            yield flush()

    counts = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()["h"].to_numpy().view(np.uint64)


def symbol_counts(texts: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Exact training counts of every symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(hashes)
        total = np.zeros(symbols.universe, np.int64)
        for batch, tokens, counts in _texts(batches):
            s = symbols.of(tokens)
            s[np.cumsum(counts) - 1] = symbols.end
            total += np.bincount(s[np.repeat(_flag(batch, "train"), counts)], minlength=symbols.universe)
        yield vector_rows(total)

    return summed(texts.mapInArrow(count, VECTOR))


def _sequence(symbols: Symbols, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the tokens, and of the one and the two before each."""
    w = symbols.of(tokens)
    first = np.cumsum(counts) - counts
    w[first + counts - 1] = symbols.end
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[first] = u[first] = symbols.begin
    second = (first + 1)[counts > 1]
    u[second] = symbols.begin
    return u, v, w


def hot_bigrams(texts: DataFrame, hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Exact training counts of what follows each hot middle word: len(hot) rows of one per symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(hashes)
        number = np.full(symbols.universe, -1)
        number[hot] = np.arange(len(hot))
        total = np.zeros(len(hot) * symbols.universe, np.int64)
        for batch, tokens, counts in _texts(batches):
            _, v, w = _sequence(symbols, tokens, counts)
            at = np.flatnonzero(np.repeat(_flag(batch, "train"), counts) & (number[v] >= 0))
            total += np.bincount(number[v[at]] * symbols.universe + w[at], minlength=len(total))
        yield vector_rows(total)

    return summed(texts.mapInArrow(count, VECTOR)).reshape(len(hot), -1)


# ---------------------------------------------------------------- blocks of text on their way to shards

BLOCK = "shard int, block long, keys binary, docs binary, marks binary, train binary"


def _planes(values: np.ndarray) -> bytes:
    """Compressed differences of ascending values, byte by byte of equal weight."""
    steps = np.diff(values, prepend=np.int64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.int64).ravel())


class Blocks:
    """Collects (shard, key, text) entries of a task and gives them as compact rows, sorted by shard and key."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.keys: list[np.ndarray] = []
        self.shards: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.train: list[np.ndarray] = []
        self.size = self.texts = 0

    def add(self, shard: np.ndarray, key: np.ndarray, doc: np.ndarray, marks: np.ndarray, train: np.ndarray) -> None:
        self.keys.append(key)
        self.shards.append(shard.astype(np.int32))
        self.docs.append((doc + self.texts).astype(np.int32))
        self.marks.append(marks)
        self.train.append(train)
        self.size, self.texts = self.size + len(key), self.texts + len(marks)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One shard is sorted at a time, so a task holds the entries once, and their order."""
        number, texts = self.number, (np.concatenate(self.marks), np.concatenate(self.train))
        whole = []
        for held in (self.shards, self.keys, self.docs):
            whole.append(np.concatenate(held))
            held.clear()
        shard, key, doc = whole
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard, np.unique(shard), sorter=order)
        squeeze = zstandard.ZstdCompressor(1)
        for at in np.split(order, edges[1:]) if len(order) else ():
            k = key[at]
            by_key = np.argsort(k, kind="stable")
            used, local = np.unique(doc[at[by_key]], return_inverse=True)
            small = local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
            marks, train = (t[used].tobytes() for t in texts)
            columns = [[int(shard[at[0]])], [number], [_planes(k[by_key])], [squeeze.compress(bytes([small.itemsize]) + small.tobytes())], [marks], [train]]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            names = ["shard", "block", "keys", "docs", "marks", "train"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        self.__init__(number + 1)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """A shard's entries: keys, and the number of each one's text; per block the texts' marks, and their training flags."""
    keys, docs, marks, train, base = [], [], [], [], 0
    for k, d, m, t in zip(*(table[c].to_pylist() for c in ("keys", "docs", "marks", "train")), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(d)
        keys.append(_values(k))
        docs.append(np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1).astype(np.int32) + np.int32(base))
        marks.append(np.frombuffer(m, np.int64))
        train.append(np.frombuffer(t, bool))
        base += len(marks[-1])
    return np.concatenate(keys), np.concatenate(docs), marks, np.concatenate(train)


def _dealt(texts: DataFrame, entries) -> DataFrame:
    """Blocks of what ``entries(tokens, counts)`` gives for some texts: shard, key and text number of each entry."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held = entries(), Blocks(TaskContext.get().partitionId() << 32)
        for batch, tokens, counts in _texts(batches):
            held.add(*make(tokens, counts), batch.column("mark").to_numpy(), _flag(batch, "train"))
            if held.size >= BLOCK_TOKENS:
                yield from held.rows()
        if held.size:
            yield from held.rows()

    return texts.mapInArrow(deal, BLOCK)


def _packed(table: pa.Table, marks: list[np.ndarray], doc: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """A row per block that came to the shard: its texts' marks and sums of ``columns``, as bytes."""
    edges = np.cumsum([len(m) for m in marks])
    sums = {c: np.split(np.bincount(doc, x, minlength=edges[-1]), edges[:-1]) for c, x in columns.items()}
    out = {"block": table["block"].combine_chunks(), "marks": pa.array([m.tobytes() for m in marks], pa.binary())}
    return out | {c: pa.array([x.tobytes() for x in parts], pa.binary()) for c, parts in sums.items()}


def _per_text(packed: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(mark, *columns)``: a block's sums from all shards meet again, and a row per text comes out."""

    def unite(table: pa.Table) -> pa.Table:
        marks, place = np.unique(np.frombuffer(b"".join(table["marks"].to_pylist()), np.int64), return_inverse=True)
        sums = {c: np.bincount(place, np.frombuffer(b"".join(table[c].to_pylist()), float), minlength=len(marks)) for c in columns}
        return pa.table({"mark": marks, **sums})

    return packed.select("block", "marks", *columns).groupBy("block").applyInArrow(unite, ", ".join(["mark long", *(f"{c} double" for c in columns)]))


# ---------------------------------------------------------------- words without a symbol


def rare_words(texts: DataFrame, hashes: np.ndarray, shards: int) -> DataFrame:
    """Blocks with sums per text over its rare words: of log10(count + 0.5), how many are known, and how many there are.

    ``n`` and ``v``, a shard's tokens and distinct words of the training texts, stand in one of its rows.
    """

    def entries():
        symbols = Symbols(hashes)

        def of(tokens: np.ndarray, counts: np.ndarray):
            s = symbols.of(tokens)
            s[np.cumsum(counts) - 1] = symbols.end
            at = np.flatnonzero(s == RARE)
            h = tokens[at]
            return (h % np.uint64(shards)).astype(np.int64), (h >> np.uint64(1)).view(np.int64), np.repeat(np.arange(len(counts)), counts)[at]

        return of

    def count(table: pa.Table) -> pa.Table:
        key, doc, marks, train = _gathered(table)
        words, place = np.unique(key, return_inverse=True)
        counts = np.bincount(place[train[doc]], minlength=len(words))
        c = counts[place]
        rows = _packed(table, marks, doc, {"logs": np.log10(c + 0.5), "known": (c > 0).astype(float), "rare": np.ones(len(c))})
        once = np.zeros(len(marks))
        once[0] = 1
        return pa.table({**rows, "n": once * counts.sum(), "v": once * (counts > 0).sum()})

    schema = "block long, marks binary, logs binary, known binary, rare binary, n double, v double"
    return _dealt(texts, entries).groupBy("shard").applyInArrow(count, schema)


# ---------------------------------------------------------------- the model


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def build_trie(folder: str, keys: np.ndarray, universe: int, base: np.ndarray, hot: dict[int, np.ndarray]) -> Trie:
    """The trie of sorted training keys (v * universe + u) * universe + w.

    ``base`` are probabilities of symbols; ``hot`` gives the full row of counts after middle words
    that are spread over several shards.  What is not needed further is dropped at once: a shard's
    arrays are what a task's memory consists of.
    """
    tri, c3 = _runs(keys)
    pair, w3 = tri // universe, (tri % universe).astype(np.int32)
    del tri
    context, start = np.unique(pair, return_index=True)
    total = np.add.reduceat(c3, start) if len(c3) else c3
    kinds = np.diff(np.append(start, len(c3)))
    u3 = (pair % universe).astype(np.int32)
    pair //= universe
    v3 = pair.astype(np.int32)
    vw = pair
    vw *= universe
    vw += w3
    del pair, start
    order = np.argsort(vw, kind="stable")
    two, first = np.unique(vw[order], return_index=True)
    c2 = np.add.reduceat(c3[order], first) if len(c3) else c3
    del order, first
    for v, row in hot.items():
        own = two // universe == v
        if own.any():
            seen = np.flatnonzero(row)
            two, c2 = np.concatenate([two[~own], v * universe + seen]), np.concatenate([c2[~own], row[seen]])
    order = np.argsort(two)
    two, c2 = two[order], c2[order]
    del order
    roots, start = np.unique(two // universe, return_index=True)
    kinds2 = np.diff(np.append(start, len(two)))
    total2 = np.add.reduceat(c2, start) if len(c2) else c2
    weight2 = DISCOUNT_2 * kinds2 / total2
    parent = np.repeat(np.arange(len(roots)), kinds2)
    p2 = (c2 - DISCOUNT_2) / total2[parent] + weight2[parent] * base[two % universe]
    del c2, parent
    lower = p2[np.searchsorted(two, vw)]
    del vw
    weight3 = DISCOUNT_3 * kinds / total
    lower *= np.repeat(weight3, kinds)
    p3 = (c3 - DISCOUNT_3) / np.repeat(total, kinds)
    p3 += lower
    del c3, lower
    log = np.log10
    bigrams = (two // universe, two % universe, log(p2), roots, log(weight2))
    del two, p2
    log(p3, out=p3)
    trigrams = (context // universe, context % universe, log(weight3), v3, u3, w3, p3)
    return Trie(folder, universe, bigrams, trigrams)


def shard_scores(table: pa.Table, base: np.ndarray, hot: dict[int, np.ndarray]) -> pa.Table:
    """A shard's blocks with the summed log10 probabilities of their texts' entries, by the shard's own trie."""
    universe = len(base)
    key, doc, marks, train = _gathered(table)
    with tempfile.TemporaryDirectory() as folder:
        learned = key[train[doc]]
        learned.sort()
        trie = build_trie(folder, learned, universe, base, hot)
        del learned
        order = np.argsort(key, kind="stable").astype(np.int32)
        asked, times = _runs(key[order])
        del key
        logs = np.empty(len(asked))
        for at in range(0, len(asked), ASKED):
            some = asked[at : at + ASKED]
            pair, w = some // universe, some % universe
            logs[at : at + ASKED] = trie.log10(pair // universe, pair % universe, w, np.log10(base[w]))
        del asked
        each = np.empty(len(order))
        each[order] = np.repeat(logs, times)
        del order, logs, times
        return pa.table(_packed(table, marks, doc, {"score": each}))


def score_shards(texts: DataFrame, hashes: np.ndarray, base: np.ndarray, shards: int, hot: np.ndarray, hot_counts: np.ndarray, parts: int) -> DataFrame:
    """Blocks with sums per text of log10 p(symbol | two before)."""
    universe = len(base)

    def entries():
        symbols = Symbols(hashes)
        split = np.zeros(universe, bool)
        split[hot] = True
        spread = (mix(np.arange(universe, dtype=np.uint64) + np.uint64(1)) >> np.uint64(8)).astype(np.int64)

        def of(tokens: np.ndarray, counts: np.ndarray):
            u, v, w = _sequence(symbols, tokens, counts)
            shard = (spread[v] + np.where(split[v], spread[u] % parts * 7919, 0)) % shards
            return shard, (v * universe + u) * universe + w, np.repeat(np.arange(len(counts)), counts)

        return of

    rows = {int(v): c for v, c in zip(hot, hot_counts, strict=True)}
    return _dealt(texts, entries).groupBy("shard").applyInArrow(lambda t: shard_scores(t, base, rows), "block long, marks binary, score binary")


def score(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``documents(doc_id, text)``.

    Null and empty texts have one token, the end.  Repeated rows are scored alike (and learned from as
    often as they occur); a null id is held out only if the empty text's checksum says so.  Without
    training texts, every token has the share 0.5 / 0.5 of the smoothed frequencies.  Words are told
    apart by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    texts = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"), (~held_out(5, 1)).alias("train"))
    plain = texts.select("text", "mark", "train")
    hashes = common_words(plain)
    counts = symbol_counts(plain, hashes)
    universe = len(hashes) + 3
    if not len(counts):
        counts = np.zeros(universe, np.int64)
    known_n = int(counts.sum())
    shards = max(1, -(-known_n * 5 // 4 // SHARD_TOKENS))
    rare = written(rare_words(plain, hashes, shards), "rare")
    extra = rare.agg(F.sum("n"), F.sum("v")).first()
    n = known_n
    v = int((counts[1:] > 0).sum()) + int(extra[1] or 0)
    whole = n + 0.5 * (v + 1)
    base = (counts + 0.5) / whole
    base[RARE] = (counts[RARE] + 0.5 * (int(extra[1] or 0) + 1)) / whole
    base[universe - 1] = 0.5 / whole
    hot = np.flatnonzero(counts * HOT_SHARE > n)
    hot_counts = hot_bigrams(plain, hashes, hot) if len(hot) else np.zeros((0, universe), np.int64)
    modelled = written(score_shards(plain, hashes, base, shards, hot, hot_counts, shards), "scores")
    log_base = np.log10(base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(hashes)
        for batch, tokens, sizes in _texts(batches):
            s = symbols.of(tokens)
            s[np.cumsum(sizes) - 1] = symbols.end
            doc = np.repeat(np.arange(len(sizes)), sizes)
            own = s != RARE
            logs = np.bincount(doc, np.where(own, log_base[s], 0.0), minlength=len(sizes))
            known = np.bincount(doc, own & (counts[s] > 0), minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), batch.column("train"), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logs)],
                ["doc_id", "mark", "train", "n_tokens", "known", "logs"],
            )

    rows = written(texts.mapInArrow(count, "doc_id long, mark long, train boolean, n_tokens long, known long, logs double"), "texts")
    # Repeated texts have added up under one mark.
    copies = rows.groupBy("mark").agg(F.count("*").alias("copies"))
    sums = _per_text(rare, ("logs", "known", "rare")).groupBy("mark").agg(F.sum("logs").alias("rl"), F.sum("known").alias("rk"), F.sum("rare").alias("rn"))
    scores = _per_text(modelled, ("score",)).groupBy("mark").agg(F.sum("score").alias("score"))
    per = copies.join(scores, "mark").join(sums, "mark", "left")
    per = per.select("mark", *((F.coalesce(c, F.lit(0.0)) / F.col("copies")).alias(c) for c in ("rl", "rk", "rn", "score")))
    log_whole, log_rare = float(np.log10(whole)), float(log_base[RARE])
    own_share = F.col("rl") - F.col("rn") * log_whole
    return rows.join(per, "mark").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.round("rk").cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + own_share).alias("base_score"),
        (F.col("score") + own_share - F.col("rn") * log_rare).alias("score"),
    )
