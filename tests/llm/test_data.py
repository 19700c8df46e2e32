"""Archives, search, shards, classifier, decontamination, mixing and the pipeline."""

import collections
import glob
import gzip
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import near_copies
from conftest import EDGES
from stormframe.llm import decontam, mixing, shards, topk, toxicity, warc
from stormframe.llm.common import WordHasher, scratch

VOCABULARY = os.environ.get("STORMFRAME_VOCABULARY", shards.VOCABULARY)


# ------------------------------------------------------------------ WARC


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(6):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        merged = [x[0] for x in warc.LoserTree([iter([(x, i) for x in r]) for i, r in enumerate(runs)])]
        assert merged == sorted(x for r in runs for x in r)


def test_archives_round_trip_in_global_order(spark):
    rng = random.Random(3)
    html = ["", None, "short", "x" * 99, "y" * 100, "é" * 60, "a\r\n\r\nb" * 40, "WARC/1.1\r\n\r\n" * 30]
    urls = ["http://www.b.example/p?q=1#f", "https://a.example:80/x", "HTTP://A.example/x", None, "http://h.example/ \n", "not a url"]
    rows = [(i, rng.choice(urls), rng.choice(html)) for i in range(200)] + [(None, urls[0], "z" * 200), (None, urls[0], "z" * 200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch(spark, "archives")
    got = warc.capture_index(pages, path, archive_bytes=4000, range_rows=20).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        again = i is not None and len(h.encode()) >= 100 and first.get(h) != i
        want.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    order = [(r.urlkey, r.captured_at, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order) and len({r.archive for r in got}) > 1
    r = next(r for r in got if r.record_type == "response" and r.payload_bytes > 100)
    with gzip.open(r.archive.removeprefix("file:"), "rb") as file:
        file.seek(r.record_offset)
        record = file.read(r.record_length)
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert next(warc.parse("a", record))["payload_digest"] == r.payload_digest
    assert warc.capture_index(pages.limit(0), scratch(spark, "none")).count() == 0


# ------------------------------------------------------------------ top-k


@pytest.mark.parametrize("blocks", [(32_768, 2_048), (40, 3)])
def test_top_k_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 8)).round(2)
    x[10:20] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, [1.0] * 3), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, 150, 10):
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in range(150) if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 150, 10))
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# ------------------------------------------------------------------ shards


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_to_one(size):
    slots = shards.permuted(np.arange(size), size)
    assert sorted(slots.tolist()) == list(range(size))
    assert size < 10 or (slots != np.arange(size)).any()
    assert (shards.permuted(np.arange(size), size) == slots).all()


def test_shards_hold_every_token_in_its_place(spark, docs):
    rows = [*EDGES, *((20 + i, f"line {i}\nmore <|endoftext|> text " * 30) for i in range(30))]
    path = shards.vocabulary_path(VOCABULARY)
    index, folder = shards.materialise(docs(rows).repartition(3), path, length=64, shard_sequences=16)
    got = index.collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    streams = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.slot):
        (file,) = glob.glob(f"{folder.removeprefix('file:')}/shard={r.shard}/part-*")
        data = np.memmap(file, np.uint8, "r")[r.byte_offset : r.byte_offset + 2 * 64 + 1]
        assert data[-1] == ord("\n") and r.shard == r.slot // 16
        tokens = data[:-1].tobytes()
        ids = np.frombuffer(tokens, "<u2")
        assert (ids[r.n_tokens :] == shards.END).all()
        start = 0
        for d, n in zip(r.doc_ids, r.lengths, strict=True):
            streams[d].append(ids[start : start + n])
            start += n
        assert start == r.n_tokens
    encode = shards.encoder(path).encode_ordinary
    for i in {i for i, _ in rows}:
        want = sorted(x for d, t in rows if d == i for x in [*encode(t or ""), shards.END])
        assert sorted(np.concatenate(streams[i]).tolist()) == want
    empty, _ = shards.materialise(docs([]), path)
    assert empty.count() == 0


# ------------------------------------------------------------------ toxicity


def test_classifier_learns_from_rows_it_may_see(spark, docs):
    rng = random.Random(7)
    bad, filler = ["idiot", "scum", "moron", "grobian", "grobheit"], ["house", "tree", "water", "stone", "cloud"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rng.choice(filler) + rng.choice("abcdefgh") for _ in range(60)] + ([rng.choice(bad) for _ in range(4)] if toxic else [])
        if i % 7 == 0 and not toxic:
            text.append("idiot")
        rng.shuffle(text)
        rows.append((i, " ".join(text).title()))
        labels.append((i, 1, int(toxic)))
    frame = docs([*rows, *((i + 5000 if i else None, t) for i, t in EDGES)])
    label = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, label).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    right = sum(got[i].predicted == truth[i] for i in held) / len(held)
    assert len(held) > 200 and right > 0.97
    assert all(got[i + 5000].predicted == 0 for i, _ in EDGES if i)
    flipped = label.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(frame, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.toxicity(docs([]), label).count() == 0
    assert toxicity.toxicity(frame, label.limit(0)).count() == frame.count()


# ------------------------------------------------------------------ decontamination

ITEM = "If Anna buys 3 apples for 5 dollars and Bob buys 3 pears, how many pieces of fruit do they carry home in total?"


def test_templates_catch_copies_and_other_parameters(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "seven little words stand in this item"), (1, ITEM)], "item_id long, text string")
    rows = [
        (1, f"Before it. {ITEM} After it."),
        (2, ITEM.replace("Anna", "Carla").replace("Bob", "Dan").replace("3", "12").replace("dollars", "euros").replace("\n", " ")),
        (3, ITEM.replace("Bob buys 3", "Bob buys 4")),
        (4, ITEM.replace("fruit", "bread").replace("apples", "stones").replace("carry", "bring")),
        (5, " ".join(ITEM.split()[:9])),
        (6, "nothing of the kind " * 20),
        (7, f"{'filler words here ' * 9000}{ITEM}"),
        (8, "there are Seven little words, stand in this item, too"),
        *((i + 100 if i else None, t) for i, t in EDGES),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(rows), bench).collect()}
    assert set(got) >= {(1, 1), (2, 1), (7, 1)} and {d for d, _ in got} <= {1, 2, 3, 7, 8}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].one_to_one
    # Item 1 has one value for two numbers; document 3 has two, so no window with both agrees.
    assert (3, 1) not in got or got[3, 1].n_windows < got[1, 1].n_windows
    assert sorted(r.doc_id for r in decontam.clean(docs(rows), bench).where("doc_id < 8").collect()) == sorted({1, 2, 3, 4, 5, 6, 7} - {d for d, _ in got})
    assert decontam.contaminated(docs([]), bench).count() == 0
    assert decontam.contaminated(docs(rows), bench.limit(0)).count() == 0


def test_templates_of_few_literal_words_and_short_items(spark, docs):
    train, share = "A train travels 60 km in 2 hours and 90 km in 3 hours", "What is 15 percent of 80?"
    bench = spark.createDataFrame([(1, train), (2, share), (3, "Name four rivers"), (4, "7 km, 8 hours, 9 Miles")], "item_id long, text string")
    rows = [
        (1, "so it goes: " + train.replace("60", "45").replace("90", "75").replace("2 h", "4 h").replace("3 h", "6 h") + ", they say"),
        (2, "asked again. " + share.replace("15", "20").replace("80", "50") + " and so on"),
        (3, "please: Name four rivers, and no more"),
        (4, "please: Name four lakes, and no more"),
        # Consistency fails: one value stands where the item has two.
        (5, train.replace("60", "45").replace("90", "45")),
        # A part of a template with few literal words, and a template without any, are no copies.
        (6, "it was 20 percent of 50"),
        (7, "over 5 km, 6 hours, 4 Miles"),
        (8, f"{train} {share}"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (8, 1), (8, 2)}
    assert not got[1, 1].verbatim and got[1, 1].one_to_one and got[1, 1].n_windows == 2
    assert not got[2, 2].verbatim and got[3, 3].verbatim and got[8, 1].verbatim


def plain_template(text):
    out = []
    for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or ""):
        b = w.encode()
        kind = "num" if w[0].isdigit() and w[0].isascii() else "name" if "A" <= w[0] <= "Z" or (b[0] == 0xC3 and len(b) > 1 and 0x80 <= b[1] <= 0x9E) else "unit" if re.sub("[A-Z]", lambda m: m[0].lower(), w) in decontam.UNITS else w
        if out and kind in ("num", "name") and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + (w,))
        else:
            out.append((kind, (w,)))
    return out


def plain_contaminated(rows, items):
    """(document, item) by the stated rule: windows with equal slot patterns, those of few literal words with equal values or together."""
    want = set()
    fold = re.compile("[A-Z]")
    parsed = {k: plain_template(t) for k, t in items}
    for i, t in rows:
        doc = plain_template(t)
        for k, item in parsed.items():
            n = min(decontam.WINDOW, len(item))
            if n == 0:
                continue
            shifts = collections.defaultdict(list)
            for a in range(len(doc) - n + 1):
                for b in range(len(item) - n + 1):
                    x, y = doc[a : a + n], item[b : b + n]
                    if [p for p, _ in x] != [p for p, _ in y]:
                        continue
                    slots = [[tuple(fold.sub(lambda m: m[0].lower(), w) for w in v) for p, v in z if p in ("num", "name", "unit")] for z in (x, y)]
                    if n < decontam.LEAST_TOKENS and slots[0] != slots[1]:
                        continue
                    if [slots[0].index(v) for v in slots[0]] == [slots[1].index(v) for v in slots[1]]:
                        literal = {b + j for j, (p, _) in enumerate(y) if p not in ("num", "name", "unit")}
                        few = len(literal) < min(decontam.LITERALS, n - 1)
                        shifts[a - b].append((b, not few or slots[0] == slots[1], set(zip(*slots, strict=True)), literal))
            for found in shifts.values():
                pairs = set().union(*(p for *_, p, _ in found))
                words = set().union(*(w for *_, w in found))
                one = len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
                whole = len({b for b, *_ in found}) == len(item) - n + 1 and len(words) >= decontam.WHOLE_LITERALS
                if any(alone for _, alone, *_ in found) or (one and (len(words) >= decontam.LITERALS or whole)):
                    want.add((i, k))
    return want


def test_windows_against_a_plain_search(spark, docs):
    rng = random.Random(12)
    words = ["apple", "River", "7", "12", "km", "stone", "über", "Émile", "green", "walks", "hours", "a"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(2, 30)))) for k in range(15)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) + " " + (rng.choice(items)[1] if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, re.sub("7|12", lambda m: str(int(m[0]) + 1), t)) for i, t in rows[:30]]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_contaminated(rows, items)
    assert got == want and want


def test_rows_without_an_id_are_judged_each(spark, docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(None, ITEM), (None, "a clean row without an id"), (None, None), (None, "a clean row without an id"), (3, ITEM), (4, "clean"), (4, f"{ITEM} twice")]
    frame = docs(rows).withColumns({"_hit": F.lit("x"), "mark": F.lit("y")})
    got = decontam.clean(frame, bench)
    assert got.columns == frame.columns
    assert sorted(map(repr, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(repr, [rows[1], rows[2], rows[3]]))


# ------------------------------------------------------------------ mixing


def test_raking_meets_margins():
    rng = np.random.default_rng(3)
    mass = rng.uniform(1, 50, (3, 4, 2))
    margins = [np.array([0.2, 0.3, 0.5]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    w = mixing.rake(mass, margins)
    for axis, m in enumerate(margins):
        assert w.sum(tuple(i for i in range(3) if i != axis)) == pytest.approx(m)
    p = mixing.probabilities(mass, w, 0.3)
    assert (p * mass).sum() == pytest.approx(0.3 * mass.sum()) and p.max() <= 1
    if p.max() < 1:
        assert (p * mass / (p * mass).sum()) == pytest.approx(w)
    assert (mixing.probabilities(mass, w, 1.0) * mass).sum() <= mass.sum()
    assert mixing.rake(np.zeros((2, 2)), [np.array([0.5, 0.5])] * 2).sum() == 0


def test_mixture_of_odd_rows_and_its_shares(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(50)), rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src1", None]), "x") for i in range(3000)]
    frame = spark.createDataFrame([*rows, (None, None, None, None, "x"), (1, "", "en", "src0", "x")], "doc_id long, text string, lang string, source string, topic string")
    mixed = mixing.mix_weights(frame, {"src0": 0.5, "*": 0.5}, {"en": 0.5, "*": 0.5}, keep=0.3).cache()
    assert mixed.count() == 3002 and mixed.where("_probability < 0 OR _probability > 1").count() == 0
    taken = mixed.where("_sampled")
    total = taken.agg(F.sum("_tokens")).first()[0]
    assert total / mixed.agg(F.sum("_tokens")).first()[0] == pytest.approx(0.3, abs=0.03)
    share = taken.where("source = 'src0'").agg(F.sum("_tokens")).first()[0] / total
    assert share == pytest.approx(0.5, abs=0.05)
    mixed.unpersist()
    assert mixing.mix_weights(frame.limit(0)).count() == 0


def test_every_source_has_a_target_and_topics_follow_the_words(spark):
    rng = random.Random(6)
    subject = [[f"{name}{k}" for k in range(60)] for name in ("sea", "law")]
    tongue = {"en": [f"the{k}" for k in range(25)], "de": [f"der{k}" for k in range(25)]}
    rows = []
    for i in range(4000):
        about, lang = i % 2, rng.choice(["en", "en", "de"])
        words = [rng.choice(subject[about]) for _ in range(20)] + [rng.choice(tongue[lang]) for _ in range(20)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang, rng.choice(["a"] * 8 + ["b"] * 3 + ["c", None]), about))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, about int")
    mixed = mixing.mix_weights(frame, topics=2, keep=0.3).collect()
    of = [collections.Counter(r._topic for r in mixed if r.about == a) for a in (0, 1)]
    top = [c.most_common(1)[0][0] for c in of]
    assert top[0] != top[1] and all(c[t] > 0.98 * c.total() for c, t in zip(of, top, strict=True))
    assert {(r.source, r._source) for r in mixed} == {("a", 0), ("b", 1), ("c", 2), (None, 3)}
    all_, kept, wished = collections.Counter(), collections.Counter(), collections.Counter()
    for r in mixed:
        all_[r.source] += r._tokens
        kept[r.source] += r._tokens * r._probability
    for n in all_:
        wished[n] = all_[n] ** 0.5
    for n in all_:
        assert kept[n] / kept.total() == pytest.approx(wished[n] / sum(wished.values()), abs=1e-6)
    assert kept.total() == pytest.approx(0.3 * all_.total())


def test_topics_are_fitted_on_every_text(spark):
    rows = [(i, f"all{i % 3} {'seldom' if i % 700 == 0 else 'often'} sea{i % 5} sea{i % 7}", i % 2) for i in range(6000)]
    rows += [(None, None, 0), (6000, " ", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _lang int")
    fitted = mixing.fit_topics(frame.repartition(7), 2, 2)
    known = {int(w): x for w, x in zip(fitted.words, fitted.weights, strict=True)}
    for word, n in (("seldom", 9), ("all0", 2000), ("sea0", sum(i % 5 == 0 or i % 7 == 0 for i in range(6000)))):
        (_, _, hashes, _), = WordHasher().words(pa.array([word]))
        assert known[int(hashes[0])] == pytest.approx(np.log(1 + 6000 / n))
    again = mixing.fit_topics(frame.repartition(3), 2, 2)
    assert all(np.array_equal(a, b) for a, b in zip(fitted, again, strict=True))


# ------------------------------------------------------------------ pipeline


def test_near_copy_stage_takes_five_words_and_four_fifths(spark, docs):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    rows = []
    for _ in range(8):
        words = [f"w{rng.randrange(400)}" for _ in range(100)]
        # A copy cut to 83 of 100 words, one cut to 77, and one with four words changed apart.
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate([words, words[:83], words[:77], [f"x{i}" if i % 33 == 10 else w for i, w in enumerate(words)]])]
    rows += [(900 + i, t) for i, t in enumerate(["a b c d", "A b c d", "a b c", None, ""])]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id for r in pipeline.drop_near_copies(spark, docs(rows), "").collect()}
    assert got == set(label.values())
    assert got != {c for _, c in near_copies(rows).values()}


def test_stages_against_plain_decisions(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_shards"]
    first = stages["toxicity"](spark, docs, sf_dir)
    verdict = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert first.columns == names and sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in verdict.where("predicted = 0").collect())
    second = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    plain = near_copies([(r.doc_id, r.text) for r in docs.collect()])
    assert second.columns == names and sorted(r.doc_id for r in second.collect()) == sorted({c for _, c in plain.values()})
    third = stages["decontamination"](spark, docs, sf_dir)
    hit = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert third.columns == names and {r.doc_id for r in third.collect()} == {r.doc_id for r in docs.collect()} - hit
    fourth = stages["mixing"](spark, docs, sf_dir)
    assert fourth.columns == names and 0 < fourth.count() < docs.count()
    last = stages["token_shards"](spark, fourth, sf_dir)
    assert {d for r in last.collect() for d in r.doc_ids} == {r.doc_id for r in fourth.collect()}
    assert pipeline.run(spark, sf_dir).count() > 0


