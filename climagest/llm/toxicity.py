"""Toxicity by subword bags.

A word is the mean of the vectors of its character n-grams, a window of neighbouring words the
mean of its words, and a linear softmax tells toxic windows from others. Vectors and softmax
are trained jointly in numpy, so a misspelling that was never seen shares the vectors of
its character n-grams. A text is scored by its most toxic window: one insult in a long text counts as
much as in a short one, and every word of the text is looked at.

Labels hold for texts, not windows, so training picks, pass by pass, the window of each text
that scores highest so far, together with a random one of the clean texts.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.llm.columns import with_mapped
from climagest.sources.shared import written

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
WIDTH = 8
WINDOW = 6
#: Bound of the sample that is fitted: texts of each class, and bytes of a text to qualify.
TEXTS_PER_CLASS, TEXT_BYTES = 2500, 32_768
PASSES, WARM, BATCH, RATE, SEED = 24, 4, 64, 0.3, 17
THRESHOLD = 0.3
#: Log odds that a window of unknown words reaches at most: a chance of a quarter.
NO_EVIDENCE = float(np.log(0.25 / 0.75))
#: Words whose scores a task remembers, in each of two generations.
WORDS = 60_000

SIGNS = string.punctuation + "…«»“”‘’¡¿"


def grams(word: str) -> list[int]:
    """Buckets of the character n-grams of a word in ``<>`` and of the whole word."""
    word = f"<{word.strip(SIGNS) or word}>"
    if word.isascii():
        coded = word.encode()
        found = [zlib.crc32(coded[i : i + n]) % BUCKETS for n in SIZES for i in range(len(coded) - n + 1)]
    else:
        found = [
            zlib.crc32(word[i : i + n].encode("utf-8", "replace")) % BUCKETS
            for n in SIZES
            for i in range(len(word) - n + 1)
        ]
    found.append(zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS)
    return found


def words_of(text: str) -> list[str]:
    return text.lower().split()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name.lower() in {column.lower() for column in df.columns}:
        name += "_"
    return name


@dataclass
class Sample:
    """Texts as word numbers, and the n-grams of every distinct word."""

    starts: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Sample:
        numbers: dict[str, int] = {}
        # an empty text is one empty word, so that it has a window
        words = [[numbers.setdefault(w, len(numbers)) for w in words_of(text) or [""]] for text in texts]
        bags = [np.array(grams(word), np.int32) for word in numbers]
        starts, gram_starts = (np.concatenate(([0], np.cumsum([len(x) for x in rows]))) for rows in (words, bags))
        return cls(starts, np.concatenate([np.array(w, np.int64) for w in words]), np.concatenate(bags), gram_starts)

    def best(self, gram_scores: np.ndarray) -> np.ndarray:
        """Where the highest-scoring window of each text starts."""
        sums = np.add.reduceat(gram_scores[self.grams], self.gram_starts[:-1])
        means = sums / np.diff(self.gram_starts)
        found = np.empty(len(self.starts) - 1, np.int64)
        for i, (start, stop) in enumerate(zip(self.starts, self.starts[1:])):
            found[i] = start + int(np.argmax(window_means(means[self.words[start:stop]])))
        return found

    def bag(self, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of the window at ``at`` in a text that ends at ``stop``, and their weights, which sum to 1."""
        words = self.words[at : min(at + WINDOW, stop)]
        bags = [self.grams[self.gram_starts[w] : self.gram_starts[w + 1]] for w in words]
        return np.concatenate(bags), np.concatenate([np.full(len(b), 1 / (len(b) * len(bags))) for b in bags])


def window_means(scores: np.ndarray) -> np.ndarray:
    """Mean of each window of neighbouring words; a shorter text is one window."""
    if len(scores) <= WINDOW:
        return scores.mean(keepdims=True)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


@dataclass
class Model:
    """Vectors of the buckets and the softmax over clean and toxic."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def gram_scores(self) -> np.ndarray:
        """How far each n-gram moves a window towards toxic: the softmax is linear in the vectors."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def offset(self) -> float:
        """What a window without evidence scores, as log odds: below the threshold, whatever the share of toxic texts."""
        return min(float(self.bias[1] - self.bias[0]), NO_EVIDENCE)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Joint training by stochastic gradients; the same texts in the same order give the same model.

    Labels of one class, or none, do not tell toxic texts from others: then every text scores about 0.
    """
    random = np.random.Generator(np.random.PCG64(SEED))
    labels = np.array(toxic, np.int64)
    vectors = random.normal(0, 0.1, (BUCKETS, WIDTH))
    model = Model(vectors, random.normal(0, 0.1, (WIDTH, 2)), np.zeros(2))
    if len(set(toxic)) < 2:
        model.weights[:] = 0
        model.bias[:] = (30, 0)
        return model
    sample = Sample.of(texts)
    lengths = np.diff(sample.starts)
    for step in range(PASSES):
        any_window = sample.starts[:-1] + (random.random(len(texts)) * np.maximum(1, lengths - WINDOW + 1)).astype(np.int64)
        chosen = any_window if step < WARM else sample.best(model.gram_scores())
        which = np.concatenate((np.arange(len(texts)), np.flatnonzero(labels == 0)))
        at = np.concatenate((chosen, any_window[labels == 0]))
        rate = RATE * (1 - step / PASSES)
        order = random.permutation(len(which))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            bags = [sample.bag(at[i], sample.starts[which[i] + 1]) for i in picked]
            rows = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
            ids, shares = np.concatenate([b for b, _ in bags]), np.concatenate([w for _, w in bags])
            means = np.stack([np.bincount(rows, shares * model.vectors[ids, k], len(bags)) for k in range(WIDTH)], axis=1)
            scores = means @ model.weights + model.bias
            chances = np.exp(scores - scores.max(axis=1, keepdims=True))
            chances /= chances.sum(axis=1, keepdims=True)
            chances[np.arange(len(bags)), labels[which[picked]]] -= 1
            back = chances @ model.weights.T
            model.weights -= rate * means.T @ chances / len(bags)
            model.bias -= rate * chances.mean(axis=0)
            # as many windows share a bucket as the batch has: steps of single windows, summed
            np.subtract.at(model.vectors, ids, rate * 20 * shares[:, None] * back[rows])
    return model


class Scores(dict):
    """Mean n-gram score of each word seen; bounded."""

    def __init__(self, gram_scores: np.ndarray) -> None:
        self.gram_scores = gram_scores.tolist()
        self.before: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        score = self.before.get(word)
        if score is None:
            found = grams(word)
            score = sum(map(self.gram_scores.__getitem__, found)) / len(found)
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = score
        return score


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, label, digest`` of at most TEXTS_PER_CLASS texts of each class, always the same ones.

    Distinct texts are drawn by their digests, so copies of one text count once. Only ids and digests are
    shuffled and ranked; the texts of the drawn ids are fetched afterwards. A threshold on the
    digests, set from the class's size, leaves the ranking a small multiple of what it draws.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fit_to_learn = docs.where(F.octet_length(text) <= TEXT_BYTES)
    digests = fit_to_learn.select("doc_id", F.md5(text.cast("binary")).alias("digest"))
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    distinct = written(
        digests.join(known, "doc_id").groupBy("label", "digest").agg(F.min("doc_id").alias("doc_id")), "labelled"
    )
    drawn = []
    for label, count in distinct.groupBy("label").count().collect():
        of_class = distinct.where(F.col("label") == label)
        if count > 2 * TEXTS_PER_CLASS:
            share = 2 * TEXTS_PER_CLASS / count
            near = of_class.where(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") < int(share * (1 << 48)))
            of_class = near if near.count() >= TEXTS_PER_CLASS else of_class
        drawn.append(of_class.orderBy("digest").limit(TEXTS_PER_CLASS))
    if not drawn:
        return fit_to_learn.select(text.alias("text"), F.lit(0).alias("label"), F.lit("").alias("digest")).limit(0)
    picked = written(reduce(DataFrame.union, drawn).select("label", "digest", "doc_id"), "drawn")
    # at most 2 * TEXTS_PER_CLASS rows of an id and a digest
    found = fit_to_learn.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    found = found.where(F.md5(F.col("text").cast("binary")) == F.col("digest"))
    return found.groupBy("label", "digest").agg(F.min("text").alias("text")).select("text", "label", "digest")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of a bounded, reproducible sample: of each class the distinct texts whose digests come first."""
    found = sorted(sample_of(docs, labels).collect(), key=lambda row: (row.label, row.digest))
    return fit([row.text for row in found], [row.label for row in found])


def score(docs: DataFrame, model: Model, others: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """The columns ``others`` and ``into``, from 0 to 1, of every row; a null text counts as empty.

    An empty text is scored as one empty word, below the threshold unless empty texts are labelled toxic. Nothing but the text is looked at.
    """
    gram_scores, offset = model.gram_scores(), model.offset()

    def start() -> Callable[[pa.Array], pa.Array]:
        known = Scores(gram_scores)

        def chances(texts: pa.Array) -> pa.Array:
            found = np.empty(len(texts))
            for i, value in enumerate(texts):
                words = words_of((value.as_py() or b"").decode("utf-8", "replace")) or [""]
                found[i] = window_means(np.fromiter(map(known.__getitem__, words), np.float64, len(words))).max() + offset
            return pa.array(1 / (1 + np.exp(-np.clip(found, -500, 500))))

        return chances

    return with_mapped(docs, text, into, T.DoubleType(), start, others)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained on the labelled documents that are not held out; a label of an id that several documents bear holds for all."""
    return trained(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = toxicity_model(docs, labels)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    found = score(rows, model, ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.3 or more, all columns."""
    into = free_name(docs, "score")
    found = score(docs, toxicity_model(docs, labels), docs.columns, into=into)
    return found.where(F.col(f"`{into}`") < THRESHOLD).select(*(f"`{name}`" for name in docs.columns))
