"""Language identification by a sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, and n-grams of one to
three characters are counted in a fixed number of hashed columns. Document frequencies come from every
row that may be learned from. The model is trained with follow-the-regularised-leader and elastic-net
penalties on a bounded sample, and its scores are divided by a temperature fitted on rows of that sample
which the weights have not seen. Prediction reads the text alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthlens.llm.common import ship, worker_task
from hearthlens.llm.linear import Rows, softmax, train_ftrl

COLUMNS = 1 << 14
LONGEST = 3
#: Rows of each language that the weights are fitted on, about; counts and frequencies use all rows.
ROWS_PER_LANGUAGE = 1500
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the n-grams of a whole text by hashed column; None without any letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of each run of others stands for its space
    line = np.where(letter, codes, 32)[kept].astype(np.uint64)
    line = np.concatenate([[np.uint64(32)], line, [np.uint64(32)]]).astype(np.uint64)
    total = np.zeros(COLUMNS, dtype=np.int64)
    hashed = np.zeros(len(line), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        if len(line) < n:
            break
        hashed = (hashed[:len(line) - n + 1] + line[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=COLUMNS)
    return total


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of unit length, the intercept in column 0."""
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    norm = math.sqrt(float(values @ values)) or 1.0
    return np.concatenate([[0], at + 1]), np.concatenate([[1.0], values * (8.0 / norm)])


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        columns, values = tf_idf(counts, self.idf)
        shares = softmax((values @ self.weights[columns])[None, :] / self.temperature)[0]
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


@worker_task("language")
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(COLUMNS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            counts = gram_counts(text.as_py())
            if counts is not None:
                seen += counts > 0
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["gram", "n"])


@worker_task("language")
def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, columns, counts = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = gram_counts(text.as_py())
            if found is not None:
                at = np.flatnonzero(found)
                labels.append(label)
                columns.append(at.astype("<u2").tobytes())
                counts.append(np.minimum(found[at], 0xFFFFFFFF).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.string()), pa.array(columns, pa.binary()), pa.array(counts, pa.binary())], ["label", "columns", "counts"])


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log-loss, by golden section over its logarithm. As in
    Platt's method the target of n right rows is (n + 1) / (n + 2), so that separable rows do not make
    the model certain."""
    rows, classes = scores.shape
    if not rows or classes < 2:
        return 1.0
    rest = 1.0 / (rows + 2)
    targets = np.full(scores.shape, rest / (classes - 1))
    targets[np.arange(rows), labels] = 1.0 - rest

    def loss(x: float) -> float:
        return -float((targets * np.log(softmax(scores / math.exp(x)) + 1e-300)).sum())

    low, high, ratio = math.log(0.05), math.log(50.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(train: DataFrame, label: str = "lang", text: str = "text", rows_per_language: int = ROWS_PER_LANGUAGE,
        key: str | None = None) -> LanguageModel:
    """A model of the rows with a label and a text that has a letter.

    The document frequencies and the rows of each language are counted over all rows. The weights see
    a hash sample of about ``rows_per_language`` rows of each language, gathered in one task as hashed
    counts, whose size has a bound; a fifth of them fits the temperature only. The sample is drawn by
    ``key`` and text, and rows with equal counts are in it once, so a big group of copies adds one row.
    Without such rows the model knows no language.
    """
    ship(train.sparkSession)
    drawn_by = F.col(key) if key else F.lit(0)
    rows = train.select(F.col(label).alias("label"), F.col(text).alias("text"), drawn_by.alias("key")).where(
        F.col("label").isNotNull() & F.col("text").rlike("\\p{L}"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((COLUMNS + 1, 0)), np.zeros(COLUMNS), 1.0)
    total = sum(sizes.values())
    found = rows.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    idf = np.full(COLUMNS, math.log(1.0 + total))
    for gram, n in found:  # at most one row per hashed column
        idf[gram] = math.log((1.0 + total) / (1.0 + n)) + 0.1

    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rows_per_language / sizes[name]))])
    drawn = F.pmod(F.xxhash64("key", "text", F.lit(11)), F.lit(1_000_000)) < F.try_element_at(share, F.col("label")) * 1_000_000
    sample = rows.where(drawn).select("label", "text").mapInArrow(_samples, "label string, columns binary, counts binary").distinct()
    number = {name: i for i, name in enumerate(languages)}

    def train_one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["columns", "counts", "label"], ignore_index=True)
        lengths, columns, values = [], [], []
        for raw, counts in zip(group["columns"], group["counts"]):
            whole = np.zeros(COLUMNS, dtype=np.int64)
            whole[np.frombuffer(raw, "<u2")] = np.frombuffer(counts, "<u4")
            at, value = tf_idf(whole, idf)
            lengths.append(len(at))
            columns.append(at.astype(np.int32))
            values.append(value.astype(np.float32))
        data = Rows(np.array(lengths), np.concatenate(columns), np.concatenate(values))
        labels = group["label"].map(number).to_numpy()
        held = np.arange(len(labels)) % 5 == 4
        fitted = np.flatnonzero(~held)
        weights = train_ftrl(data.take(fitted), labels[fitted], COLUMNS + 1, len(languages))
        kept = np.flatnonzero(held)
        scores = data.take(kept).times(weights)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "temperature": [_temperature(scores, labels[kept])]})

    trained = sample.groupBy().applyInPandas(train_one, "weights binary, temperature double").first()
    if trained is None:
        return LanguageModel([], np.zeros((COLUMNS + 1, 0)), np.zeros(COLUMNS), 1.0)
    weights = np.frombuffer(trained["weights"], "<f4").reshape(COLUMNS + 1, len(languages)).astype(np.float64)
    return LanguageModel(languages, weights, idf, trained["temperature"])


def predicted(spark, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column: ``und`` and 0 for a null text or one without a letter."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # languages times hashed columns: a bounded size

    @F.pandas_udf("lang_pred string, score double")
    @worker_task("language")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in part], columns=["lang_pred", "score"])

    return predict(text)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the key as text leaves 1 when divided by 3. A null
    key is held out as well."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang",
             rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, learned from the rows that are not held out.
    Repeated rows and null keys stay; other columns are not read."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(label).alias("__label"))
    model = fit(rows.where(~held_out(F.col("__key"))), "__label", "__text", rows_per_language, "__key")
    found = rows.select("__key", predicted(docs.sparkSession, model, F.col("__text")).alias("__p"))
    return found.select(F.col("__key").alias(key), held_out(F.col("__key")).alias("held_out"), "__p.lang_pred", "__p.score")
