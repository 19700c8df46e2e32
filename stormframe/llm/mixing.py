"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to the marginals of source, language and topic; documents are then sampled
with the probabilities that give those weights in expectation.  Topics are clusters of texts by their
words, fitted on all texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormframe.llm.common import VECTOR, WordHasher, discard, mix, summed, text_batches, vector_rows, written

#: Production targets: shares of tokens.  Every source has its own, in proportion to its tokens to the power of TEMPER;
#: in given targets and for languages, "*" stands for every class that is not named.
TEMPER = 0.5
LANGUAGES = {"en": 0.54, "fr": 0.18, "de": 0.17, "es": 0.10, "*": 0.01}
TOPICS = 4
#: Share of the corpus's tokens to sample.
KEEP = 0.45
SEED = 11
#: Words that tell topics apart, and the rarest and commonest of them by the texts (and the share of texts) that hold them.
TOPIC_WORDS, RAREST, COMMONEST = 2048, 3, 0.5
#: Starts of the clustering, and the most passes that they make over the table.
STARTS, ROUNDS = 2, 10
#: Parts of one in which texts are summed; texts that one step takes; distinct words that a task counts together.
UNIT, ROWS_TOGETHER, COUNTED_TOGETHER = 2.0**20, 4096, 1 << 20


class Topics(NamedTuple):
    """Word hashes, ascending; their weights; a centre per topic; and an offset per language and topic."""

    words: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    offsets: np.ndarray

    def of(self, hashes: np.ndarray, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The nearest centre of each text, of the lower topic on ties; 0 for texts without any of the words."""
        texts = len(counts)
        if not len(self.words):
            return np.zeros(texts, np.int32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        once = np.unique(np.repeat(np.arange(texts), counts)[hit] * len(self.words) + at[hit])
        text, word = once // len(self.words), once % len(self.words)
        length = np.sqrt(np.bincount(text, self.weights[word] ** 2, minlength=texts))
        near = np.stack([np.bincount(text, self.weights[word] * c[word], minlength=texts) for c in self.centres], 1)
        near = near / np.maximum(length, 1e-300)[:, None] + self.offsets[lang]
        return np.where(length > 0, near.argmax(1), 0).astype(np.int32)


def _counted(documents: DataFrame) -> DataFrame:
    """Words (hashes) with the number of texts that hold them, of every text; a null word counts the texts with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, texts, held, size = WordHasher(), 0, [], 0

        def rows() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate([w for w, _ in held] or [np.zeros(0, np.uint64)]), return_inverse=True)
            n = np.bincount(place, np.concatenate([k for _, k in held] or [np.zeros(0)]), len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([*words.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), texts], pa.int64())], ["word", "n"])

        for batch in (part for whole in batches for part in text_batches(whole, "text")):
            for row, end, hashes, counts in hasher.words(batch.column("text")):
                words, place = np.unique(hashes, return_inverse=True)
                once = np.unique(np.repeat(np.arange(end - row), counts) * len(words) + place)
                held.append((words, np.bincount(once % max(1, len(words)), minlength=len(words))))
                texts, size = texts + int((counts > 0).sum()), size + len(words)
                if size > COUNTED_TOGETHER:
                    yield rows()
                    texts, held, size = 0, [], 0
        yield rows()

    return documents.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Rows(NamedTuple):
    """Texts as sparse rows over the topic words: text, word and value of each entry, values in units of ``1 / UNIT``, so that sums are exact in any order."""

    lang: np.ndarray
    text: np.ndarray
    word: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, weights: np.ndarray) -> _Rows:
        lists, lang = batch.column("words"), batch.column("_lang").to_numpy()
        text, word = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
        length = np.sqrt(np.bincount(text, weights[word] ** 2, minlength=len(lists)))
        return cls(lang, text, word, np.rint(weights[word] / length[text] * UNIT))

    def squares(self, means: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Squared distances of texts, less the mean of their language, to centres of any number of leading axes."""
        n, flat = len(self.lang), centres.reshape(-1, centres.shape[-1])
        value = self.value / UNIT
        own = np.bincount(self.text, value * (value - 2 * means[self.lang[self.text], self.word]), minlength=n) + (means * means).sum(1)[self.lang]
        near = np.stack([np.bincount(self.text, value * c[self.word], minlength=n) for c in flat], 1) - (means @ flat.T)[self.lang]
        return np.maximum(own[:, None] - 2 * near + (flat * flat).sum(1), 0).reshape(n, *centres.shape[:-1])

    def sums(self, to: np.ndarray, classes: int, words: int) -> np.ndarray:
        """The rows of each class added up."""
        return np.bincount(to[self.text] * words + self.word, self.value, minlength=classes * words).reshape(classes, words)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, ROWS_TOGETHER) for whole in batches for i in range(0, whole.num_rows, ROWS_TOGETHER))


def _first_centres(texts: DataFrame, topics: int, weights: np.ndarray, means: np.ndarray, seed: int) -> np.ndarray:
    """Centres of each start, texts drawn from all: the first at even chances, the others by their squared distance to those before.

    The draw is a race of exponential times from the keyed hash of a text's id, so only the winners come to the driver.
    """
    centres = np.zeros((STARTS, 0, len(weights)))
    for place in range(topics):

        def race(batches: Iterator[pa.RecordBatch], place: int = place, centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                h = batch.column("_h").to_numpy().view(np.uint64)
                far = _Rows.of(batch, weights).squares(means, centres).min(2) if place else np.ones((len(h), STARTS))
                for k in range(STARTS):
                    u = ((mix(h ^ np.uint64((seed << 16) + place * STARTS + k + 1)) >> np.uint64(11)) + np.uint64(1)).astype(float) / 2**53
                    time = np.divide(-np.log(u), far[:, k], out=np.full(len(u), np.inf), where=far[:, k] > 1e-9)
                    first = np.flatnonzero(time == time.min()).tolist()
                    rows = batch.select(["_lang", "words"]).take(pa.array(first))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(first), pa.int32()), pa.array(time[first]), *rows.columns], ["k", "time", "_lang", "words"])

        won = texts.mapInArrow(race, "k int, time double, _lang int, words array<short>").groupBy("k").agg(F.min(F.struct("time", "_lang", "words")).alias("w"))
        won = won.select("k", "w._lang", "w.words").orderBy("k").toArrow().combine_chunks().to_batches()[0]
        rows = _Rows.of(won, weights)
        drawn = rows.sums(np.arange(STARTS), STARTS, len(weights)) / UNIT - means[rows.lang]
        centres = np.concatenate([centres, drawn[:, None]], 1)
    return centres


def _clusters(texts: DataFrame, topics: int, weights: np.ndarray, means: np.ndarray, seed: int) -> np.ndarray:
    """Centres of k-means over all ``texts``, the best of a few starts that go through the table together."""
    centres, languages, before = _first_centres(texts, topics, weights, means, seed), len(means), None
    shape = (STARTS, topics, len(weights) + languages)
    for _ in range(ROUNDS):

        def step(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, cost = np.zeros(shape), np.zeros(STARTS)
            for batch in _slices(batches):
                rows = _Rows.of(batch, weights)
                far = rows.squares(means, centres)
                for k, to in enumerate(far.argmin(2).T):
                    total[k, :, : len(weights)] += rows.sums(to, topics, len(weights))
                    np.add.at(total[k, :, len(weights) :], (to, rows.lang), 1)
                cost += np.rint(far.min(2) * UNIT).sum(0)
            yield vector_rows(np.concatenate([total.ravel(), cost]))

        sums = summed(texts.mapInArrow(step, VECTOR))
        total, cost = sums[:-STARTS].reshape(shape), sums[-STARTS:]
        if before is not None and (total == before).all():
            break
        before, in_lang = total, total[:, :, len(weights) :]
        n = in_lang.sum(2, keepdims=True)
        moved = (total[:, :, : len(weights)] / UNIT - in_lang @ means) / np.maximum(n, 1)
        last, centres = centres, np.where(n > 0, moved, centres)
        best = last[int(cost.argmin())]
    return best


def fit_topics(documents: DataFrame, topics: int, languages: int, seed: int = SEED) -> Topics:
    """Topics of ``documents(doc_id, text, _lang)``, fitted on all of them.

    Words, their weights, the languages' means and the centres are counts and sums over every text; a
    scratch table holds the numbers of each text's topic words, and fixed-size sums come to the driver.
    A text is its distinct words, rare ones weighing more, less the mean text of its language: topics are
    not languages.
    """
    none = Topics(np.zeros(0, np.uint64), np.zeros(0), np.zeros((topics, 0)), np.zeros((languages, topics)))
    counted = _counted(documents).persist()
    n = counted.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    common = counted.where(F.col("word").isNotNull() & F.col("n").between(min(RAREST, n), max(1, COMMONEST * n)))
    fit = common.orderBy(F.desc("n"), F.col("word") < 0, "word").limit(TOPIC_WORDS).toArrow()
    counted.unpersist()
    if not fit.num_rows:
        return none
    words = fit["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, weights = words[order], np.log(1 + n / fit["n"].to_numpy()[order])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in (part for whole in batches for part in text_batches(whole, "text")):
            for row, end, hashes, counts in hasher.words(batch.column("text")):
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                hit = words[at] == hashes
                once = np.unique(np.repeat(np.arange(end - row), counts)[hit] * len(words) + at[hit])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(once // len(words), minlength=end - row))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(once % len(words), pa.int16()))
                part = pa.RecordBatch.from_arrays([*batch.select(["_h", "_lang"]).slice(row, end - row).columns, lists], ["_h", "_lang", "words"])
                yield part.filter(pa.array(counts > 0))

    hashed = documents.select(F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("_h"), "text", "_lang")
    texts = written(hashed.mapInArrow(listed, "_h long, _lang int, words array<short>"), "mixing-words")

    def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((languages, len(weights) + 1))
        for batch in _slices(batches):
            rows = _Rows.of(batch, weights)
            total[:, :-1] += rows.sums(rows.lang, languages, len(weights))
            total[:, -1] += np.bincount(rows.lang, minlength=languages)
        yield vector_rows(total.ravel())

    total = summed(texts.mapInArrow(by_language, VECTOR)).reshape(languages, -1)
    means = total[:, :-1] / UNIT / np.maximum(total[:, -1:], 1)
    centres = _clusters(texts, topics, weights, means, seed)
    discard(texts)
    return Topics(words, weights, centres, -means @ centres.T - (centres * centres).sum(1) / 2)


def with_topic(documents: DataFrame, topics: int, languages: int) -> DataFrame:
    """``documents`` (with ``_lang``, the number of the language) with ``_topic`` and ``_tokens`` (words of the whole text)."""
    schema = T.StructType([*documents.schema.fields, T.StructField("_topic", T.IntegerType()), T.StructField("_tokens", T.LongType())])
    fitted = fit_topics(documents, topics, languages)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in (part for whole in batches for part in text_batches(whole, "text")):
            topic, tokens = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            lang = batch.column("_lang").to_numpy()
            for row, end, hashes, counts in hasher.words(batch.column("text")):
                topic[row:end] = fitted.of(hashes, counts, lang[row:end])
                tokens[row:end] = counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topic), pa.array(tokens)], [*batch.schema.names, "_topic", "_tokens"])

    return documents.mapInArrow(label, schema)


def rake(mass: np.ndarray, margins: list[np.ndarray], steps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """``mass`` (one axis per margin) scaled so that its sums along each axis follow ``margins``.

    Shares of classes without any mass are spread over the others; margins that contradict the empty
    cells are met as nearly as the last step allows.
    """
    weights = mass / max(mass.sum(), 1e-300)
    for _ in range(steps):
        worst = 0.0
        for axis, margin in enumerate(margins):
            rest = tuple(i for i in range(mass.ndim) if i != axis)
            sums = weights.sum(rest)
            target = np.where(mass.sum(rest) > 0, margin, 0.0)
            target = target / target.sum() if target.sum() > 0 else sums
            factor = np.divide(target, sums, out=np.zeros_like(sums), where=sums > 0)
            worst = max(worst, float(np.abs(sums - target).max()))
            shape = [1] * mass.ndim
            shape[axis] = -1
            weights = weights * factor.reshape(shape)
        if worst < tolerance:
            break
    return weights


def probabilities(mass: np.ndarray, weights: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """Per cell, min(1, c * weight / mass) with c such that a share ``keep`` of all tokens is expected.

    Where no probability reaches 1, expected tokens are proportional to ``weights``; a scarce cell
    gives all it has, and the others make up for it.
    """
    ratio = np.divide(weights, mass, out=np.zeros_like(weights), where=mass > 0)
    wanted = keep * mass.sum()
    order = np.argsort(-ratio, axis=None)
    r, m = ratio.ravel()[order], mass.ravel()[order]
    full = np.concatenate([[0.0], np.cumsum(m)[:-1]])
    rest = np.cumsum((r * m)[::-1])[::-1]
    # With the first i cells at 1, c follows from what is left; the first i that leaves all others below 1 holds.
    for i in range(len(r)):
        c = (wanted - full[i]) / rest[i] if rest[i] > 0 else 0.0
        if c * r[i] <= 1:
            return np.minimum(1.0, max(c, 0.0) * ratio)
    return np.ones_like(ratio)


def _class(column: str, names: list[str]) -> Column:
    found = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)) - 1
    return F.when(F.coalesce(found, F.lit(-1)) >= 0, found).otherwise(F.lit(names.index("*"))).cast("int")


def tempered(tokens: np.ndarray, power: float = TEMPER) -> np.ndarray:
    """Shares in proportion to a power of the tokens: small sources are raised against large ones."""
    raised = np.where(tokens > 0, np.maximum(tokens, 1.0) ** power, 0.0)
    return raised / max(raised.sum(), 1e-300)


def mix_weights(
    documents: DataFrame, sources: Mapping[str, float] | None = None, languages: Mapping[str, float] = LANGUAGES, topics: int = TOPICS, seed: int = SEED, keep: float = KEEP
) -> DataFrame:
    """``documents`` with ``_tokens``, ``_topic``, ``_probability`` and ``_sampled``.

    Without ``sources``, every source is a class of its own (null included, the last), numbered in
    order, and its target is its tempered share; one row per source and cell comes to the driver.
    With them, and for languages, classes are those of the targets plus one for all others.
    Documents without words carry no weight and are kept with their cell's probability.  A document
    is sampled when the keyed hash of its id, as a fraction, is below its probability: repeated rows
    share their fate, and a run repeats it.
    """
    langs = list(languages)
    source = F.col("source") if sources is None else F.when(F.col("source").isin([n for n in sources if n != "*"]), F.col("source")).otherwise(F.lit("*"))
    marked = with_topic(documents.withColumn("_lang", _class("lang", langs)), topics, len(langs)).withColumn("_name", source)
    cells = marked.groupBy("_name", "_lang", "_topic").agg(F.sum("_tokens").alias("mass")).collect()
    found = {r["_name"] for r in cells}
    names = list(sources) if sources is not None else [*sorted(n for n in found if n is not None), *([None] if None in found else [])]
    number = {n: i for i, n in enumerate(names)}
    mass = np.zeros((len(names), len(langs), topics))
    for r in cells:
        mass[number[r["_name"]], r["_lang"], r["_topic"]] = r["mass"]
    target = np.array(list(sources.values())) if sources is not None else tempered(mass.sum((1, 2)))
    p = mass
    if names:
        p = probabilities(mass, rake(mass, [target, np.array(list(languages.values())), np.full(topics, 1 / topics)]), keep)
    rows = [pa.array(names, pa.string()), pa.array(range(len(names)), pa.int32()), pa.array([x.ravel().tolist() for x in p], pa.list_(pa.float64()))]
    table = documents.sparkSession.createDataFrame(pa.table(rows, ["_of", "_source", "_cells"]))
    unit = (F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)
    marked = marked.join(table, F.col("_name").eqNullSafe(F.col("_of")), "left")
    marked = marked.withColumn("_probability", F.get("_cells", F.col("_lang") * topics + F.col("_topic"))).drop("_name", "_of", "_cells")
    return marked.withColumn("_sampled", unit < F.col("_probability"))
