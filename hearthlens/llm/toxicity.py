"""Toxicity by a classifier chain of sparse linear models.

The categories are predicted one after the other: each model sees the words of the text and the
probabilities of the categories before it. While the chain is trained those probabilities are out of
fold, each from a model that has not seen the row, so that a later model does not trust an earlier one
more than it deserves; the models kept for prediction are fitted on all sampled rows. Words count by
presence, so one insult in a long text is as visible as in a short one, and the l1 penalty removes the
words that say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.llm.common import ship, worker_task
from hearthlens.llm.linear import Rows, softmax, train_ftrl

#: Labelled rows that the chain is trained on, about; the sample is drawn by a hash of key and text.
TRAINING_ROWS = 8000
#: Sampled texts that a word has to occur in to become a column.
LEAST_TEXTS = 5
FOLDS = 3
EPOCHS = 5
#: Standard errors by which the l1 penalty asks a word to differ from chance.
SURE = 2.5
_WORD = re.compile(r"[^\W\d_]+")
#: Marks whose share of a text tells markup, shouting and noise from prose.
MARKS = "!|#%&*$=<>{}\n"
#: Words also count by so many first letters, which inflected and compound forms share.
PREFIX = 5
LEVELS = (0.001, 0.01, 0.05, 0.2, 0.5)


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a whole text, and words that tell its shape."""
    words = _WORD.findall(text.lower())
    found = set(words)
    found.update([word[:PREFIX] + "~" for word in found if len(word) > PREFIX])
    size = max(1, len(text))
    shape = {mark: text.count(mark) / size for mark in MARKS}
    shape["letters"] = sum(map(len, words)) / size
    shape["distinct"] = len(set(words)) / max(1, len(words))
    shape["capitals"] = sum(map(str.isupper, text)) / size
    found.update(f"{name} {sum(share > level for level in LEVELS)}" for name, share in shape.items())
    return found


@dataclass
class Chain:
    categories: list[str]
    columns: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, text: str | None) -> list[float | None]:
        """The probability of each category; 0 for a null text or one without words."""
        if not text or not self.weights or not _WORD.search(text):
            return [0.0] * len(self.categories)
        found = [0, *(self.columns[w] for w in words_of(text) & self.columns.keys())]
        done: list[float] = []
        for weights in self.weights:
            score = weights[found].sum(axis=0) + sum(p * weights[len(self.columns) + 1 + i] for i, p in enumerate(done))
            done.append(float(softmax(np.atleast_2d(score))[0, 1]))
        return done


@worker_task("toxicity")
def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words_of(text.as_py())), pa.string())], ["word"])


def _fitted(words: list[np.ndarray], flags: np.ndarray, columns: int, folds: int) -> list[np.ndarray]:
    """Weights of each category of the chain, in order."""
    categories = flags.shape[1]
    fold = np.arange(len(words)) % folds
    width = columns + 1 + categories
    before = np.zeros((len(words), 0))
    models = []
    for category in range(categories):
        parts, values = [], []
        for i, found in enumerate(words):
            parts.append(np.concatenate([[0], found, columns + 1 + np.arange(category)]))
            values.append(np.concatenate([np.ones(len(found) + 1), before[i]]))
        rows = Rows(np.array([len(p) for p in parts]), np.concatenate(parts).astype(np.int64), np.concatenate(values))
        labels = flags[:, category]
        share = labels.mean()
        even = np.sqrt(np.array([0.5 / max(1e-9, 1 - share), 0.5 / max(1e-9, share)])).clip(0.2, 5.0)

        def fitted(chosen: np.ndarray) -> np.ndarray:
            part = rows.take(chosen)
            # what the gradients of a word without any say add up to by chance, over all epochs
            chance = np.sqrt(np.bincount(part.columns, minlength=width) * share * (1 - share)) * even[labels[chosen]].mean()
            penalty = SURE * EPOCHS * chance
            penalty[columns + 1:] = 0.0
            return train_ftrl(part, labels[chosen], width, 2, EPOCHS, 32, 0.3, l1=penalty, l2=1.0, class_weights=even)

        out = np.zeros(len(words))
        if category < categories - 1:
            for k in range(folds):
                held = np.flatnonzero(fold == k)
                if len(held):
                    out[held] = softmax(rows.take(held).times(fitted(np.flatnonzero(fold != k))))[:, 1]
        models.append(fitted(np.arange(len(words))))
        before = np.column_stack([before, out])
    return models


def fit(labelled: DataFrame, categories: Sequence[str], text: str = "text", training_rows: int = TRAINING_ROWS,
        folds: int = FOLDS, key: str | None = None) -> Chain:
    """The chain over the 0/1 columns ``categories``, in that order.

    Rows with a null text or category are left out. The words of a hash sample of about
    ``training_rows`` rows are counted in Spark; those in few of its texts are dropped, and the rows,
    as column numbers, are trained on in one task, whose input that parameter bounds. The sample is
    drawn by ``key`` and text, and a text with the same flags is in it once, so a big group of copies
    adds one row. A table without labelled rows gives a chain that predicts 0.
    """
    categories = list(categories)
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.array(*[F.col(c).cast("int") for c in categories]).alias("flags"),
                           (F.col(key) if key else F.lit(0)).alias("key"))
    rows = rows.where(F.col("text").isNotNull() & ~F.exists("flags", lambda f: f.isNull()))
    total = rows.count()
    if not total:
        return Chain(categories, {}, [])
    drawn = F.pmod(F.xxhash64("key", "text", F.lit(5)), F.lit(1_000_000)) < min(1.0, training_rows / total) * 1_000_000
    sample = rows.where(drawn).select("text", "flags").distinct()
    counted = sample.select("text").mapInArrow(_vocabulary, "word string").groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = sorted(r["word"] for r in counted.where(F.col("n") >= LEAST_TEXTS).collect())
    columns = {word: i + 1 for i, word in enumerate(vocabulary)}
    shared = labelled.sparkSession.sparkContext.broadcast(columns)  # words of the bounded sample

    @worker_task("toxicity")
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [np.array(sorted(known[w] for w in words_of(t.as_py()) & known.keys()), dtype="<u4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["words", "flags"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(code=[tuple(f) for f in group["flags"]]).sort_values(["words", "code"], ignore_index=True)
        mixed = np.random.default_rng(3).permutation(len(group))
        words = [np.frombuffer(group["words"][i], "<u4").astype(np.int64) for i in mixed]
        flags = np.array([group["flags"][i] for i in mixed], dtype=np.int64).reshape(len(mixed), -1)
        models = _fitted(words, flags, len(columns), folds)
        return pd.DataFrame({"category": range(len(models)), "weights": [m.astype("<f4").tobytes() for m in models]})

    trained = sample.mapInArrow(numbered, "words binary, flags array<int>").groupBy().applyInPandas(
        train, "category int, weights binary").collect()
    width = len(columns) + 1 + len(categories)
    models = [np.frombuffer(r["weights"], "<f4").reshape(width, 2).astype(np.float64) for r in sorted(trained, key=lambda r: r["category"])]
    if not models:
        return Chain(categories, {}, [])
    # words without a weight in any model are never looked at again
    used = [w for w, i in columns.items() if any(m[i].any() for m in models)]
    keep = np.array([0, *(columns[w] for w in used), *range(len(columns) + 1, width)])
    return Chain(categories, {w: i + 1 for i, w in enumerate(used)}, [m[keep] for m in models])


def predicted(spark, chain: Chain, text: Column) -> Column:
    """struct of the probabilities ``p_<category>`` of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(chain)  # words of the bounded sample that kept a weight
    names = [f"p_{c}" for c in chain.categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    @worker_task("toxicity")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in part], columns=names)

    return predict(text)


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, low_quality, toxic, severe) of the documents with labels: the chain of categories that
    the labels can tell, ``severe`` being toxic and of low quality."""
    known = labels.select(F.col(key).alias("__key"), F.col("quality").alias("__quality"), F.col("toxic").alias("__toxic"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(known, "__key")
    low, toxic = (F.col("__quality") == 0).cast("int"), F.col("__toxic").cast("int")
    return rows.select(F.col("__key").alias("key"), F.col("__text").alias("text"), low.alias("low_quality"), toxic.alias("toxic"), (low * toxic).alias("severe"))


CATEGORIES = ("low_quality", "toxic", "severe")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5,
          training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(key, p_low_quality, p_toxic, p_severe, toxic) of every document, ``toxic`` telling whether
    p_toxic is at least ``threshold``. A null text, or one without words, is not toxic; repeated rows
    and null keys stay; other columns are not read."""
    chain = fit(labelled(docs, labels, key, text), CATEGORIES, "text", training_rows, key="key")
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = rows.select("__key", predicted(docs.sparkSession, chain, F.col("__text")).alias("__p"))
    return found.select(F.col("__key").alias(key), "__p.*", (F.col("__p.p_toxic") >= threshold).alias("toxic"))
