"""Toxicity by weak supervision.

Many weak voters (a lexicon, words that labelled rows suggest, and patterns over them) vote on
every document.  A generative label model, fitted by expectation maximisation, estimates the
accuracy of each voter and the correlation of voter pairs; its posteriors are the labels on which
a linear classifier is trained, which then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormframe.llm.common import held_out, text_batches

# Insults that vote "toxic".
LEXICON = (
    "idiot moron stupid trash scum loser pathetic worthless disgusting clown dumb jerk fool garbage filth vermin coward "
    "imbecile retard bastard bitch asshole shit fuck dickhead slut whore pig hate kill"
).split()

#: Bounds of the training sample and of what is learned from it; none grows with the corpus.
SAMPLE_ROWS = 20_000
LEARNED_WORDS = 64
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Words, voters' parameters and the classifier; a few kilobytes."""

    words: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    accuracies: tuple[float, ...]
    correlations: tuple[tuple[float, ...], ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.bias, -30, 30)))


def _finder(voters: tuple[str, ...]):
    """Counts of each voter's words in the lower-cased text, and the number of blanks plus one.

    A voter is a whole word, or with a final ``*`` every word that begins so.
    """
    automaton = ahocorasick.Automaton()
    for i, v in enumerate(voters):
        word = v.rstrip("*")
        same = automaton.get(word, ((), ()))
        automaton.add_word(word, (len(word), *(((*same[-2], i), same[-1]) if word == v else (same[-2], (*same[-1], i)))))
    automaton.make_automaton()

    def counts(text: str) -> tuple[np.ndarray, int]:
        out, low = np.zeros(len(voters)), text.lower()
        for end, (size, whole, begun) in automaton.iter(low):
            if end < size or not low[end - size].isalpha():
                if whole and not low[end + 1 : end + 2].isalpha():
                    out[list(whole)] += 1
                if begun:
                    out[list(begun)] += 1
        return out, low.count(" ") + 1

    return counts


def _counted(batch: pa.RecordBatch, find) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in text_batches(batch, "text"):
        got = [find(t or "") for t in part.column("text").to_pylist()]
        yield part, np.array([c for c, _ in got]), np.array([n for _, n in got], float)


def features(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: presence of each word, then counts that the pattern voters look at."""
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    density = 1000 * total / np.maximum(sizes, 1)
    return np.column_stack([counts > 0, np.log1p(total), kinds, np.log1p(density), total >= 2, kinds >= 3]).astype(float)


def votes(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """+1 toxic, -1 clean, 0 abstain.  A word's absence is no vote; patterns also vote clean."""
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    density = 1000 * total / np.maximum(sizes, 1)
    patterns = [
        np.where(total == 0, -1, 0),
        np.where(kinds >= 2, 1, np.where(kinds == 0, -1, 0)),
        np.where(total >= 3, 1, np.where(total <= 1, -1, 0)),
        np.where(density >= 4, 1, np.where(density < 1, -1, 0)),
    ]
    return np.column_stack([(counts > 0).astype(int), *patterns])


def fit_label_model(v: np.ndarray, prior: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "toxic" per row, with each voter's accuracy and the pairwise correlations.

    Voters are independent given the label, except that correlated ones share their say: a voter's
    log-odds are divided by the sum of its positive correlations with the others (given the label).
    ``prior`` starts the posteriors; its mean is the class balance.
    """
    post, balance = prior.astype(float), np.clip(prior.mean(), 1e-3, 1 - 1e-3)
    accuracy, corr = np.full(v.shape[1], 0.7), np.eye(v.shape[1])
    for _ in range(steps):
        w1, w0 = post.sum() + 2, (1 - post).sum() + 2
        odds = np.zeros((v.shape[1], 3))
        residual = np.zeros(v.shape)
        for k, value in enumerate((-1, 0, 1)):
            hit = (v == value).astype(float)
            odds[:, k] = np.log((post @ hit + 0.5) / w1) - np.log(((1 - post) @ hit + 0.5) / w0)
        for label in (post, 1 - post):
            mean = (label @ v) / max(label.sum(), 1e-9)
            residual += label[:, None] * (v - mean)
        spread = residual.std(0) + 1e-9
        corr = np.clip((residual.T @ residual) / len(v) / np.outer(spread, spread), -1, 1)
        np.fill_diagonal(corr, 1.0)
        share = 1 / np.maximum(1.0, np.where(corr > 0.3, corr, 0).sum(1))
        logit = np.log(balance / (1 - balance)) + sum(((v == value) * odds[:, k] * share).sum(1) for k, value in enumerate((-1, 0, 1)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        said = np.abs(v).sum(0)
        accuracy = (((v > 0) * new[:, None]).sum(0) + ((v < 0) * (1 - new)[:, None]).sum(0) + 1) / (said + 2)
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, accuracy, corr


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - target) + keep * w
        hess = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def suggest_words(training: DataFrame, most: int = LEARNED_WORDS) -> list[str]:
    """Words, and beginnings of words, in many toxic rows and in nearly no others.

    A distributed count over the labelled rows; ``most`` strings come back.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]+"), 0))).alias("word")
    words = training.select(F.monotonically_increasing_id().alias("row"), "toxic", word).where(F.length("word") >= 4)
    begun = words.select("row", "toxic", F.concat(F.substring("word", 1, 4), F.lit("*")).alias("word")).distinct()
    per = words.union(begun).groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.count("*").alias("b"))
    p = training.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.count("*").alias("n")).first()
    if not p["p"] or p["p"] == p["n"]:
        return []
    lift = (F.col("a") + 0.5) / (F.lit(p["p"]) + 1) / ((F.col("b") - F.col("a") + 0.5) / (F.lit(p["n"] - p["p"]) + 1))
    strong = per.where((F.col("a") >= 20) & (lift >= 100) & (F.col("a") >= 0.02 * p["p"])).orderBy(F.desc("a"), "word").limit(most)
    return [r["word"] for r in strong.collect()]


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows whose id is not held out; at most ``sample_rows`` of them, by the hash of their id."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(3, 1))
    seen = seen.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    training = documents.where(~held_out(3, 1)).select("doc_id", "text").join(F.broadcast(seen), "doc_id").select("text", "toxic")
    words = tuple(dict.fromkeys([*LEXICON, *suggest_words(training)]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(words)
        for batch in batches:
            for part, counts, sizes in _counted(batch, find):
                yield pa.RecordBatch.from_pydict(
                    {"counts": pa.array(counts.tolist(), pa.list_(pa.float64())), "size": pa.array(sizes), "toxic": part.column("toxic")}
                )

    # Numbers only, at most sample_rows of them: the texts stay with the executors.
    rows = training.mapInArrow(count, "counts array<double>, size double, toxic int").toArrow()
    if rows.num_rows == 0:
        return Model(words, (*[0.0] * len(words), 1.0, 0.0, 0.0, 1.0, 1.0), -3.0, (0.7,) * (len(words) + 4), ())
    counts = np.array(rows["counts"].to_pylist()).reshape(rows.num_rows, len(words))
    sizes, toxic = rows["size"].to_numpy(), rows["toxic"].to_numpy().astype(float)
    v = votes(counts, sizes)
    # Given labels enter as one more voter, right nine times in ten.
    post, accuracy, corr = fit_label_model(v, np.where(toxic == 1, 0.9, 0.1 * toxic.mean()))
    weights, bias = fit_linear(features(counts, sizes), post)
    return Model(words, tuple(map(float, weights)), bias, tuple(map(float, accuracy)), tuple(tuple(map(float, r)) for r in corr))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every whole text; null reads as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(model.words)
        for batch in batches:
            for part, counts, sizes in _counted(batch, find):
                s = model.score(features(counts, sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    return documents.select("doc_id", "text").mapInArrow(of, "doc_id long, score double, predicted int")


def marked(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents``, all columns, with ``_toxic``: 1 where the text is rejected."""
    model = train(documents, labels)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(model.words)
        for batch in batches:
            for part, counts, sizes in _counted(batch, find):
                bad = pa.array((model.score(features(counts, sizes)) >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, bad], [*part.schema.names, "_toxic"])

    return documents.mapInArrow(of, T.StructType([*documents.schema.fields, T.StructField("_toxic", T.IntegerType())]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``documents(doc_id, text)``.

    Null and empty texts are scored as texts without words; repeated rows are scored each; a null id
    counts as held out only if the empty text's checksum says so.  Labels null in either column, of
    unknown documents or of held-out ids are not used; without any, a fixed rule on the lexicon scores.
    """
    model = train(documents, labels)
    return score(documents, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
