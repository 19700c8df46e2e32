"""Merkle manifests, personal data and phrases against plain versions."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from conftest import EDGES
from stormframe.llm import merkle, phrases, pii
from stormframe.llm.queries import QUERIES

# ------------------------------------------------------------------ Merkle manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def plain_tree(leaves):
    """Every level from the leaves to the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return out


def plain_manifest(rows):
    """(doc_id, source, leaf, subroot, root, proof), sorted."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x for *_, x in sorted(groups[s])]) for s in names}
    over = plain_tree([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for at, (known, i, x) in enumerate(sorted(groups[s])):
            out.append((i if known else None, s, x, trees[s][-1][0], over[-1][0], plain_proof(trees[s], at) + plain_proof(over, k)))
    return sorted(out, key=repr)


def table(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("tree", "pos", "n", "hash", "part", "at", "way", "top", "row", "key"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def manifest_rows(seed, sizes):
    rng = random.Random(seed)
    rows = [(i, t, "en", None, None) for i, t in EDGES if i != 7]
    rows.append((7, "long " * 60_000, None, "big", 300_000))
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), f"text {rng.random()}\n" * rng.randrange(3), None, source, rng.choice([None, 5])) for _ in range(n)]
    return rows


def test_manifest_against_a_plain_tree(spark):
    for every in (1, 2, 4):
        rows = manifest_rows(every, {"one": 1, "three": 3, "four": 4, "ten": 10, "": 28, "hot": 300, "é": 82})
        named = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
        made = merkle.build(table(spark, rows), every=every)
        got = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in merkle.proofs(made).collect()]
        assert sorted(got, key=repr) == plain_manifest(named)
        assert made.root().first().root == got[0][4]
        # Stored levels are ``every`` apart: 300 leaves need six levels.
        assert len(made.levels) == 1 + -(-6 // every)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle.proofs(merkle.build(table(spark, []))).count() == 0
    row = (1, None, None, None, None)
    got = merkle.proofs(merkle.build(table(spark, [row]))).first()
    assert got.leaf == got.subroot == got.root == sha("1:1----") and got.proof == []


def test_equal_rows_are_leaves_each(spark):
    rows = [(5, "same", "en", "s", 4)] * 700 + [(6, "other", "en", "s", 5)]
    got = merkle.proofs(merkle.build(table(spark, rows)))
    assert got.count() == 701 and got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_tampering_is_seen_where_it_changes_a_text(spark, tmp_path):
    rows = manifest_rows(9, {"a": 40, "b": 7})
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        hit = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (r.folded_root == r.root) == (not hit)


# ------------------------------------------------------------------ personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_identifiers(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and doubled % 10 == 0, 10 <= len(digits) <= 15)
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_open_identifiers_against_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ0123456789..@@+--  ()_%\n,é4111") for _ in range(rng.randrange(60)))
        assert pii.identifiers(text) == plain_identifiers(text)


DISGUISED = [
    ("mail", "john.doe [at] example [dot] com", "email"),
    ("mail", "anna at mail dot example dot org", "email"),
    ("mail", "jоhn@exаmple.com", "email"),
    ("mail", "foo&#64;bar.com", "email"),
    ("mail", "user@mail(dot)example(dot)com", "email"),
    ("mail", "user @ example.com", "email"),
    ("mail", "john_at_example_dot_com", "email"),
    ("mail", "a​b@c​d.com", "email"),
    ("mail", "x7 at example.com", "email"),
    ("call", "plus four nine one seven zero five five five one two three four", "phone"),
    ("call", "plus 49 170 5551234", "phone"),
    ("call", "+vier neun eins sieben null fünf fünf fünf eins zwei drei vier", "phone"),
    ("host", "one nine two dot one six eight dot one dot one", "ip"),
    ("host", "192 dot 168 dot 0 dot 1", "ip"),
    ("host", "192.168.O.1", "ip"),
    ("card", "４１１１ １１１１ １１１１ １１１１", "card"),
    ("card", "4O12 8888 8888 1881", "card"),
    ("card", "four triple one, double one double one, one one one one, one one one one", "card"),
]


def test_disguises_give_spans_of_the_source():
    for before, shown, kind in DISGUISED:
        text = f"élan \U0001f600 {before} {shown} and on."
        at = text.index(shown)
        found = [(pii.KINDS[k], s, e) for s, k, e, _ in pii.personal_data(text)]
        if shown.startswith("+vier"):  # a plus sign before a word is no number yet, so the words alone are none
            continue
        assert (kind, at, at + len(shown)) in found, shown


def test_prose_is_left_alone():
    for text in (
        "We met at the end.Then we stayed at home at night. Look at example one.",
        "One of two, three at most; four or five at nine. un deux trois",
        "The dot at the end of a line. dot dot dot. Stay at night dot dot dot",
        "Version 2.0.1 of 1 2 3, (at) all [dot] costs &#64; nothing",
        "Ещё текст · ΑΒΓ δοκιμή １２３ ｆｕｌｌ",
    ):
        assert pii.personal_data(text) == []


def test_gates_lose_nothing_and_open_spans_stay(monkeypatch):
    rng = random.Random(2)
    bits = ["john", "at", "(at)", "dot", "[dot]", "@", ".", " ", " ", " ", "example", "com", "one", "two", "double", "zero", "4O1", "1", "192", "plus", "+", "-", "о", "​", "&#64;", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(5_000)]
    gated = [pii.personal_data(t) for t in texts]
    monkeypatch.setattr(pii, "_may_be_disguised", lambda text: True)
    assert gated == [pii.personal_data(t) for t in texts] and sum(not o for g in gated for *_, o in g) > 100
    for t, found in zip(texts, gated, strict=True):
        assert [x[:3] for x in found if x[3]] == plain_identifiers(t)
        assert all(0 <= s < e <= len(t) for s, _, e, _ in found)


def test_odd_rows_and_the_digests(spark, docs, tmp_path):
    rows = [*EDGES, (20, "a@b.cc 10.0.0.1 and " + "4111111111111111 " * 2 + "+1 (632) 555-4827"), (21, "x " * 200_000 + "jo at ex dot org"), (20, "a@b.cc")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        base = plain_identifiers(t)
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        counts = [sum(k == j for _, k, _ in base) for j in range(4)]
        assert any(r.base_sha256 == sha(listed) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts for r in by[i])
    assert by[21][0].spans == f"email:{400_000}:{400_000 + len('jo at ex dot org')}" and by[21][0].n_email == 0 and by[21][0].n_disguised == 1
    assert QUERIES["op12_personal_data"](spark, str(tmp_path)).where("spans IS NULL").count() == 0
    assert pii.detect(docs([])).count() == 0


# ------------------------------------------------------------------ phrases


def plain_phrases(rows, least, wanted):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for (lang, *g), a in count.items():
        if a < least or len(g) < 2:
            continue
        s, _, l, r = min((1000 * a * total[lang] // (count[lang, *g[:k]] * count[lang, *g[k:]]), k, count[lang, *g[:k]], count[lang, *g[k:]]) for k in range(1, len(g)))  # noqa: E741
        out.append((lang, g, a, l, r, s))
    inside = {(y[0], *y[1:][i : i + k]): n for y, n in count.items() if n >= least for k in range(2, len(y) - 1) for i in range(len(y) - k) if count[y[0], *y[1:][i : i + k]] == n}
    kept = [x for x in out if (x[0], *x[1]) not in inside]
    best = collections.defaultdict(list)
    for lang, g, a, l, r, s in kept:  # noqa: E741
        best[lang].append((-s, -a, " ".join(g).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows_ in best.items() for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:wanted]))  # noqa: E741


def phrase_rows():
    rng = random.Random(5)
    rows = []
    for lang in ("en", "de", None):
        words = [f"{lang}{i}" for i in range(60)] + ["über", "A\tb", "x\x00"]
        for _ in range(150):
            text = " ".join(rng.choice(words[: rng.choice([4, 20, 63])]) for _ in range(rng.randrange(40)))
            if rng.random() < 0.4:
                text += " New York City council; the Quick brown  fox\njumps over. the the the the the the"
            rows.append((lang, text))
    return [*rows, ("en", None), ("en", ""), ("fr", "A lone text"), ("en", "Long " * 50_000 + "end")]


def test_phrases_against_counting(spark):
    rows = phrase_rows()
    frame = spark.createDataFrame([(i, t, lang, "n", "a", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, word string, n int")
    for least, wanted, first in ((4, 40, 64), (3, 10_000, 1 << 14)):
        got = sorted(tuple(r) for r in phrases.collocations(frame.repartition(3), least, wanted, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == plain_phrases(rows, least, wanted) and got
    assert phrases.collocations(frame.limit(0)).count() == 0
    assert phrases.collocations(frame.where("lang = 'fr'")).count() == 0


def test_pieces_longer_than_a_pass_stay_whole(spark, monkeypatch):
    import numpy as np

    data = np.frombuffer(b"ab. " * 10 + b"x" * 50 + b"; c", np.uint8)
    monkeypatch.setattr(phrases, "PASS_BYTES", 7)
    parts = [p.tobytes() for p in phrases._parts(data)]
    assert b"".join(parts) == data.tobytes() and all(p.endswith((b".", b";", b"c")) for p in parts) and len(parts) > 3
