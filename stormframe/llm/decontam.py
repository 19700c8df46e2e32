"""Benchmark decontamination by templates.

Texts become template tokens: numbers, names (capitalised words) and units turn into typed
placeholders, everything else is lower-cased.  Windows of template tokens are joined by hash between
documents and benchmark items, and a match counts only if its slots are consistent: equal values in
the item stand where equal values stand in the document.  A question with other numbers or names is
so found as well; where a window has few literal words, the windows around it must be found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.llm.common import PASS_BYTES, as_binary, mix, text_batches

WINDOW = 13
#: Items with fewer template tokens than this are no template: they are found with their slot values alone.  Windows with
#: fewer literal words count with other values only where they make up a passage of so many, or a whole item of WHOLE_LITERALS.
LEAST_TOKENS, LITERALS, WHOLE_LITERALS = 5, 6, 2
#: Bits of the filter that decides which windows of documents take part in the join.
FILTER_BITS = 22

# Words that read as units.
UNITS = (
    "mm cm m km mi ft inch inches foot feet mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams "
    "kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp kmh mph celsius "
    "fahrenheit kelvin volt volts watt watts joule joules"
).split()

_rng = np.random.Generator(np.random.PCG64(77))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_PART = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PART[_a:_b] = True
LITERAL, NUMBER, NAME, UNIT = range(4)
_HOLDER = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_FOLD = np.uint64(0x9E3779B97F4A7C15 | 1)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Horner hash of each word, all words a byte further at a time: as many passes as the longest word has bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left, h = starts[order], size[order], np.zeros(len(order), np.uint64)
    steps, alive = 0, len(order)
    values = _TABLE[_LOWER] if fold else _TABLE
    while alive:
        alive = int(np.searchsorted(-left, -steps, "left"))
        if not alive:
            break
        h[:alive] = h[:alive] * _FOLD + values[data[at[:alive] + steps]]
        steps += 1
    out = np.empty(len(order), np.uint64)
    out[order] = mix(h + left.astype(np.uint64))
    return out


_UNIT_ENDS = np.cumsum([len(u) for u in UNITS])
_UNIT_HASHES = np.sort(
    _word_hashes(np.frombuffer("".join(UNITS).encode(), np.uint8), np.concatenate([[0], _UNIT_ENDS[:-1]]), _UNIT_ENDS, fold=True)
)


def template(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of bytes: hash, class, value hash and start.  Neighbouring numbers, and neighbouring names, are one slot.

    ``breaks`` are the starts of texts: no token and no slot reaches over them.
    """
    part = _PART[data]
    first, last = part.copy(), part.copy()
    first[1:] &= ~part[:-1]
    last[:-1] &= ~part[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner], last[inner - 1] = part[inner], part[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return z, np.zeros(0, np.int8), z, starts
    kind = np.zeros(len(starts), np.int8)
    head, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    word = _word_hashes(data, starts, ends, fold=True)
    kind[_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, word), len(_UNIT_HASHES) - 1)] == word] = UNIT
    kind[((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))] = NAME
    kind[(head >= 48) & (head <= 57)] = NUMBER
    text = np.searchsorted(breaks, starts, "right")
    joined = np.zeros(len(starts), bool)
    joined[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUMBER)) & (text[1:] == text[:-1])
    keep = np.flatnonzero(~joined)
    value = np.add.reduceat(word, keep)
    kind = kind[keep]
    return np.where(kind == LITERAL, word[keep], _HOLDER[kind]), kind, value, starts[keep]


def _windows(tokens: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
    for j in range(n):
        h = h * _FOLD + tokens[j : j + len(h)]
    return mix(h + np.uint64(n))


def few_literals(kind: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` tokens have too few literal words to count alone with other slot values."""
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    return literal[n:] - literal[:-n] < min(LITERALS, n - 1)


def window_keys(tokens: np.ndarray, kind: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A hash per window of ``n`` tokens, of the template alone; of windows shorter than a template, of the slots' values too."""
    return _windows(tokens if n >= LEAST_TOKENS else np.where(kind == LITERAL, tokens, mix(value ^ tokens)), n)


def _pattern(values: list[int]) -> str:
    """Which slots of a window hold equal values."""
    return ",".join(str(values.index(v)) for v in values)


WINDOW_ROW = "id long, size int, key long, pattern string, at long, slots array<long>, few boolean, literals array<long>, tokens long"


def windows(texts: DataFrame, id_column: str, sizes: list[int] | None, known: np.ndarray | None) -> DataFrame:
    """Windows of whole texts as rows.  ``sizes`` None: one size per text, ``WINDOW`` or all its tokens.

    With ``known``, sorted filter bits, only windows whose bit is among them.  ``literals`` are the
    places of a window's literal words in its text, ``tokens`` the size of the text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        if known is not None:
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[known] = True
        for batch in (x for whole in batches for x in text_batches(whole, "text", PASS_BYTES)):
            ids, texts = batch.column("id").to_pylist(), as_binary(batch.column("text"))
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            breaks = offsets - offsets[0]
            tokens, kind, value, starts = template(data, breaks)
            edges = np.searchsorted(starts, breaks)
            found: list[tuple] = []
            for n in sizes if sizes is not None else range(1, WINDOW + 1):
                if len(tokens) < n:
                    continue
                key, few = window_keys(tokens, kind, value, n), few_literals(kind, n)
                hit = bits[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] if bits is not None else np.ones(len(key), bool)
                at = np.flatnonzero(hit)
                text = np.searchsorted(edges, at, "right") - 1
                inside = at + n <= edges[text + 1]
                if sizes is None:
                    inside &= np.minimum(edges[text + 1] - edges[text], WINDOW) == n
                for i, t in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
                    slots = value[i : i + n][kind[i : i + n] != LITERAL].view(np.int64).tolist()
                    at_text = int(edges[t])
                    literals = (np.flatnonzero(kind[i : i + n] == LITERAL) + (i - at_text)).tolist()
                    whole = int(edges[t + 1]) - at_text
                    found.append((ids[t], n, int(key[i].view(np.int64)), _pattern(slots), i - at_text, slots, bool(few[i]), literals, whole))
            if found:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()), pa.int64()]
                names = ["id", "size", "key", "pattern", "at", "slots", "few", "literals", "tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return texts.select(F.col(id_column).alias("id"), "text").mapInArrow(rows, WINDOW_ROW)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_windows, one_to_one, verbatim)`` of every document and item that share a consistent window.

    Within a window, slots of the document and the item must be equal to each other in the same
    places.  A window of few literal words counts with equal slot values, or where the windows found
    in place with it hold ``LITERALS`` literal words together or are the whole item, which then has
    ``WHOLE_LITERALS``, and all their slots map one to one.  Items of fewer than ``LEAST_TOKENS``
    template tokens are found as a whole with their slot values.  ``n_windows`` counts the item's
    windows found in place; ``one_to_one`` says whether the slots of all of them map one to one (the
    first and last may have grown together with what stands around the passage); ``verbatim`` is
    false where some slot has another value.  Null and empty texts share nothing.  Repeated rows give
    one row; a null id is an id of its own.  Only the bits of the filter, at most 2**FILTER_BITS,
    come to the driver; a large benchmark fills the filter and sends more windows to the join, which
    decides.
    """
    items = windows(benchmark.select("item_id", "text"), "item_id", None, None).distinct()
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    known = items.select(bit.alias("bit")).distinct().toArrow()["bit"].to_numpy()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    found = windows(documents, "doc_id", sizes, known).select(F.col("id").alias("doc_id"), "size", "key", "pattern", "at", "slots")
    i = items.withColumnsRenamed({"id": "item_id", "at": "item_at", "slots": "item_slots"})
    pairs = found.join(i, ["size", "key", "pattern"])
    slot = F.arrays_zip("item_slots", "slots")
    alone = ~F.col("few") | (F.col("item_slots") == F.col("slots"))
    by = ("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))

    def distinct(arrays: Column) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(arrays)))

    # A shift's windows are at most the item's, and so are its slots.
    per = pairs.groupBy(*by).agg(
        F.collect_set("item_at").alias("every"),
        F.collect_set(F.when(alone, F.col("item_at"))).alias("strong"),
        distinct(slot).alias("every_slot"),
        distinct(F.when(alone, slot)).alias("strong_slot"),
        F.size(distinct(F.col("literals"))).alias("literals"),
        F.max(F.col("tokens") - F.col("size") + 1).alias("windows"),
    )

    def sound(slots: Column) -> Column:
        one = F.size(slots)
        return (F.size(F.array_distinct(F.transform(slots, lambda s: s["item_slots"]))) == one) & (
            F.size(F.array_distinct(F.transform(slots, lambda s: s["slots"]))) == one
        )

    passage = (F.col("literals") >= LITERALS) | ((F.size("every") == F.col("windows")) & (F.col("literals") >= WHOLE_LITERALS))
    per = per.withColumn("together", passage & sound(F.col("every_slot"))).where("together OR size(strong) > 0")
    per = per.select(
        "doc_id",
        "item_id",
        F.size(F.when(F.col("together"), F.col("every")).otherwise(F.col("strong"))).alias("n"),
        F.when(F.col("together"), F.col("every_slot")).otherwise(F.col("strong_slot")).alias("slots"),
    )
    same = F.forall("slots", lambda s: s["item_slots"] == s["slots"])
    return per.groupBy("doc_id", "item_id").agg(
        F.sum("n").cast("long").alias("n_windows"), F.max(sound(F.col("slots"))).alias("one_to_one"), F.max(same).alias("verbatim")
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that share a consistent window with an item.

    Rows that share an id go together; rows without one are judged each, by their texts.
    """
    named = documents.where(F.col("doc_id").isNotNull())
    hit = contaminated(named.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    kept = named.join(hit, "doc_id", "left_anti").select(*documents.columns)
    mark = F.sha2(F.coalesce("text", F.lit("")), 256)
    nameless = documents.where(F.col("doc_id").isNull())
    # Equal texts are equally contaminated, so a text's hash serves as its id.
    marked = nameless.select(F.xxhash64("text").alias("doc_id"), "text", mark.alias("mark"))
    leaks = contaminated(marked.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    gone = marked.join(leaks, "doc_id", "left_semi").select(F.col("mark").alias("_gone")).distinct()
    return kept.unionByName(nameless.join(gone, mark == gone["_gone"], "left_anti"))
