"""Operators on texts against plain versions, on small tables with every odd kind of row."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from brute import Trigrams, edit_distance, near_copies, without_repeats, words
from conftest import EDGES
from stormframe.llm import line_dedup, links, lm, ngram_join, suffix
from stormframe.llm.common import WordHasher, held_out
from stormframe.llm.eliasfano import EliasFano, Trie


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_word_hashes_tell_words_apart_and_fold_case():
    import pyarrow as pa

    texts = ["The cat\tthe CAT", "", None, "a\x0bb\x0cc\rd e", "é É"]
    rows = []
    for _, _, h, n in WordHasher().words(pa.array(texts)):
        rows += np.split(h, np.cumsum(n)[:-1])
    assert [len(r) for r in rows] == [4, 0, 0, 5, 2]
    assert rows[0][0] == rows[0][2] and rows[0][1] == rows[0][3] and rows[0][0] != rows[0][1]
    assert rows[4][0] != rows[4][1]  # only A-Z are folded


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(7, i) for i in range(1000, 1300)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame([*chain, *hub, (5, 5)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys([7, *range(1000, 1300)], 7)}


# ------------------------------------------------------------------ n-gram join


def test_near_copies_against_all_pairs(spark, docs):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        words_ = sentence(rng, rng.choice([30, 60, 200])).split()
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(words_)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) + 10, " ".join(copy).upper() if base % 3 == 0 else " ".join(copy)))
    rows += [(900 + i, t) for i, t in enumerate(["", "one", "One", "one two", "one two three", "one  two\nTHREE", None])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs(rows)).collect()}
    assert got == near_copies(rows)
    assert len(set(got.values())) > 12


def test_near_copies_of_odd_rows(spark, docs):
    got = sorted(ngram_join.near_copies(docs(EDGES)).collect(), key=str)
    assert len(got) == len(EDGES)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == by[2][:0] + [(0, 1)] and by[3] == [(0, 3)] and by[4] == [(1, 4)]
    assert by[5] == [(10, 5)] and by[6] == [(10, 5)] * 2 and by[None] == [(8, None)] and by[7] == [(1, 7)]
    assert ngram_join.near_copies(docs([])).count() == 0


# ------------------------------------------------------------------ suffix arrays


@pytest.mark.parametrize("symbols", [1, 2, 3, 200])
def test_suffix_arrays_and_common_prefixes(symbols):
    rng = random.Random(symbols)
    for _ in range(40):
        t = np.array([rng.randint(1, symbols) for _ in range(rng.randint(1, 90))] + [0], np.int16)
        sa = suffix.suffix_array(t, 258)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common = suffix.permuted_common_prefixes(t, sa, 1000)
        for a, b in zip(sa, sa[1:], strict=False):
            same = 0
            while t[a + same] == t[b + same]:
                same += 1
            assert common[b] == same


@pytest.mark.parametrize("together", [750_000, 0])
def test_repeats_against_counting(spark, docs, monkeypatch, together):
    monkeypatch.setattr(suffix, "ANCHOR_BYTES", together)
    rng = random.Random(9)
    passage = sentence(rng, 120)
    rows = [(i, sentence(rng, rng.randrange(5, 300))) for i in range(20)]
    rows += [(100 + i, f"{sentence(rng, 20)} {passage} {sentence(rng, rng.randrange(200))}") for i in range(8)]
    rows += [(200, rows[0][1]), (201, rows[21][1]), (202, "ab" * 700), (203, "x" * 401), (204, "y" * 400), (205, passage[:400]), (206, "ñ" * 250 + passage[50:470])]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicate(docs(rows)).collect()}
    assert got == without_repeats(rows)


def test_repeats_of_odd_rows_and_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE_BYTES", 1500)
    rng = random.Random(2)
    long = sentence(rng, 2000)
    rows = [(1, long), (2, long[3000:5000] + sentence(rng, 100)), *((i + 10 if i else None, t) for i, t in EDGES if i != 7)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicate(docs(rows)).collect()}
    assert got == without_repeats(rows)
    assert suffix.deduplicate(docs([])).count() == 0


# ------------------------------------------------------------------ language model


def test_elias_fano_and_its_trie(tmp_path):
    rng = np.random.default_rng(0)
    for n, universe in ((1, 1), (7, 3), (900, 1000), (2000, 10**9)):
        x = np.sort(rng.integers(0, universe, n))
        e = EliasFano(x, universe).to_disk(str(tmp_path / f"e{n}"))
        assert isinstance(e.upper, np.memmap) and (e.get(np.arange(n)) == x).all()
        q = rng.integers(0, universe, 300)
        at, hit = e.successor(q)
        assert (at == np.searchsorted(x, q)).all() and (hit == np.isin(q, x)).all()
    keys = np.sort(rng.integers(0, 6**3, 500))
    base = np.full(6, 1 / 6)
    trie = lm.build_trie(str(tmp_path), keys, 6, base, {})
    assert isinstance(trie, Trie)
    every = np.arange(6)
    for v in range(7):
        for u in range(6):
            # Probabilities of each context sum to one, up to their quantisation.
            p = 10 ** trie.log10(np.full(6, v % 6 if v < 6 else 5), np.full(6, u), every, np.log10(base))
            assert p.sum() == pytest.approx(1, abs=2e-3)
    assert trie.two.children(np.arange(len(trie.root_weight))).sum() == trie.two.n


def test_a_shard_is_scored_in_little_memory(monkeypatch):
    monkeypatch.setattr(lm, "ASKED", 20_000, raising=False)
    n, universe = 200_000, 5000
    rng = np.random.default_rng(5)
    u, v, w = (np.minimum(universe ** rng.random(n), universe - 1).astype(np.int64) for _ in range(3))
    blocks = lm.Blocks(0)
    blocks.add(np.zeros(n, np.int64), (v * universe + u) * universe + w, np.sort(rng.integers(0, 900, n)), rng.integers(0, 1 << 60, 900), rng.random(900) < 0.8)
    table = pa.Table.from_batches(list(blocks.rows()))
    tracemalloc.start()
    try:
        out = lm.score_shards(_Held(), np.arange(1, universe - 2).astype(np.uint64), np.full(universe, 1 / universe), 1, np.zeros(0, np.int64), np.zeros((0, universe), np.int64), 1)(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sums = np.frombuffer(out["score"][0].as_py())
    assert len(sums) == 900 and (sums < 0).all()
    assert peak < 190 * n


class _Held:
    """Stands for the texts, and gives the function that a shard's table goes through."""

    def mapInArrow(self, f, schema):
        return self

    def groupBy(self, key):
        return self

    def applyInArrow(self, f, schema):
        return f


def test_blocks_of_text_are_sorted_without_copies_of_the_whole():
    rng, n, shards = np.random.default_rng(5), 50_000, 16
    keys, shard, doc = rng.integers(0, 1 << 50, (8, n)), rng.integers(0, shards, (8, n)), np.sort(rng.integers(0, 100, (8, n)))
    blocks = lm.Blocks(7)
    for part in range(8):
        blocks.add(shard[part], keys[part].copy(), doc[part], np.arange(100) + 100 * part, np.arange(100) % 5 > 0)
    seen = set()
    for row in blocks.rows():
        found = lm._gathered(pa.Table.from_batches([row]))
        s, text = row.column("shard")[0].as_py(), found[2][0][found[1]]
        own = shard.ravel() == s
        want = sorted(zip(keys.ravel()[own].tolist(), (doc + 100 * np.arange(8)[:, None]).ravel()[own].tolist(), strict=True))
        assert sorted(zip(found[0].tolist(), text.tolist(), strict=True)) == want and (np.diff(found[0]) >= 0).all()
        seen.add(s)
    assert seen == set(range(shards)) and not blocks.size
    tracemalloc.start()
    for part in range(8):
        blocks.add(shard[part], keys[part].copy(), doc[part], np.arange(100), np.ones(100, bool))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert sum(1 for _ in blocks.rows()) == shards
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    # The entries come together once, and their order; sorted copies of all of them took twice as much.
    assert peak < 30 * 8 * n


def test_scores_against_a_plain_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(1, 120), 150) + (f" rare{i}" if i % 2 else "")) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, None), (2001, " \n"), (2002, "Unseen words only")]
    got = {r.doc_id: r for r in lm.score(docs(rows)).collect()}
    plain = Trigrams(rows, lm.DISCOUNT_2, lm.DISCOUNT_3)
    assert set(got) == set(plain.texts)
    for i, text in plain.texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (plain.held[i], len(text), sum(plain.c[w] > 0 for w in text), plain.n)
        assert r.base_score == pytest.approx(plain.base(text))
        assert r.score == pytest.approx(plain.score(text), abs=3e-4 * len(text))


def test_scores_of_odd_rows(spark, docs):
    got = lm.score(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.score <= 0 and r.base_score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(docs([])).count() == 0
    held = spark.createDataFrame([(i,) for i in range(60)], "doc_id long").where(held_out(5, 1)).collect()
    alone = lm.score(docs([(held[0][0], "nothing to learn from")])).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.n_known == 0


# ------------------------------------------------------------------ lines


def plain_lines(rows):
    places, count = [], {}
    for i, t in rows:
        lines = (t or "").split("\n")
        count[i] = len(lines)
        for k, line in enumerate(lines):
            norm = regex.sub(r"[^\p{L}\p{M}0\n]+", " ", regex.sub(r"\p{N}", "0", line.lower())).strip(" ")
            if norm:
                places.append((i, k, norm))
    names = sorted({n for _, _, n in places})

    def sim(name):
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in name.split(" ")]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) // 2)

    sims = {n: sim(n) for n in names}
    up = {n: n for n in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, x in enumerate(names):
        for y in names[k + 1 :]:
            if (sims[x] ^ sims[y]).bit_count() <= 3 and edit_distance(x, y) <= max(len(x), len(y)) * 20 // 100:
                up[find(x)] = find(y)
    first = {}
    for i, k, n in sorted(places):
        first.setdefault(find(n), (i, k))
    gone = collections.defaultdict(list)
    for i, k, n in places:
        if first[find(n)] != (i, k):
            gone[i].append(k)
    return {i: (count[i], count[i] - len(gone[i]), sorted(gone[i])) for i in count}


def test_lines_against_all_pairs(spark, docs):
    rng = random.Random(8)
    bases = [sentence(rng, 60) for _ in range(6)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(bases).split() if rng.random() < 0.7 else sentence(rng, 8).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "Other"
            lines.append(rng.choice(["{}", "{}!", "- {}", ""]).format(" ".join(w)))
        rows.append((i, "\n".join(lines)))
    frame = docs(rows)
    result = line_dedup.deduplicate_lines(frame)
    got = {r.doc_id: (r.n_lines, r.n_kept, list(r.removed)) for r in result.collect()}
    want = plain_lines(rows)
    assert got == want and any(v[2] for v in want.values())
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(frame, result).collect()}
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][2]) for i, t in rows}


def test_lines_of_odd_rows(spark, docs):
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(docs(EDGES)).collect()}
    assert len(got) == len({i for i, _ in EDGES})
    assert got[1].n_lines == 1 and got[1].n_kept == 1 and got[3].n_lines == 2 and got[3].n_kept == 2
    assert got[5].n_kept == 1 and got[6].n_kept == 0 and got[None].n_kept == 1
    assert line_dedup.deduplicate_lines(docs([])).count() == 0


def test_line_dedup_is_native(spark, docs):
    frame = line_dedup.lines(docs([(1, "a b")])).select(F.xxhash64("norm").alias("key"), "norm")
    plan = line_dedup.simhash(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_words_helper():
    assert words("A\x0bb é") == [b"a", b"b", "é".encode()]
