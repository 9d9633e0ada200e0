"""Quality by positive-unlabelled learning: non-negative unbiased risk over trusted positives and unlabelled web text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.samples import bounded
from quarry.llm.common import runs, small, table, text_bytes, written
from quarry.llm.hashing import grams, run_digests, split_words
from quarry.llm.language import held_out

#: Trusted positives and unlabelled texts that the model is fitted on, each at most, by hash order.
MOST_FITTED = 40_000
AT_ONCE = 1 << 18

#: What is measured of a text. Shares are of words, or of characters where the name says so.
FEATURES = (
    "log_words", "mean_length", "signs_in_chars", "upper_in_chars", "digits_in_chars", "marks_in_chars", "same_as_last",
    "distinct", "lone_signs", "signed_words", "repeated_pairs", "repeated_eights", "words_per_line", "repeated_lines", "longest", "exclaimed",
)
_KIND = np.zeros(256, np.uint8)
for _chars, _kind in ((b"#*$%&|<>@^~=+_\\{}[]", 1), (bytes(range(65, 91)), 2), (bytes(range(48, 58)), 3), (b".,;:?\"'()-/", 4), (b"!", 5)):
    _KIND[list(_chars)] = _kind


def _per(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a value of each word by document."""
    total = np.concatenate(([0], np.cumsum(words)))
    return total[first[1:]] - total[first[:-1]]


def _repeats(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """How many of a document's n-grams are not the first of their kind, by document."""
    out = np.zeros(len(first) - 1)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= n:
            own = values[a : b - n + 1]
            out[d] = len(own) - len(np.unique(own))
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document; all 0 for one without words."""
    words = split_words(data, offsets)
    n = np.diff(words.first)
    chars = np.maximum(1, np.diff(offsets))
    kinds = _KIND[data]
    by_kind = [np.diff(np.concatenate(([0], np.cumsum(kinds == k)))[offsets]) / chars for k in range(1, 6)]
    length = words.end - words.start
    has_sign = np.concatenate(([0], np.cumsum(kinds == 1)))
    signs = has_sign[words.end] - has_sign[words.start]
    lines = np.diff(np.concatenate(([0], np.cumsum(data == 10)))[offsets]) + 1
    last = np.zeros(len(words.digest), bool)
    last[1:] = words.digest[1:] == words.digest[:-1]
    last[words.first[:-1][n > 0]] = False
    pairs, eights = grams(words.digest, 2), grams(words.digest, 8)
    # a line is known by all its words
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line_of = breaks[words.start] if len(words.start) else np.empty(0, int)
    begins = np.ones(len(words.start), bool)
    begins[1:] = line_of[1:] != line_of[:-1]
    begins[words.first[:-1][n > 0]] = True
    begin_at = np.flatnonzero(begins)
    heads = run_digests(words.digest, begin_at, np.append(begin_at[1:], len(words.digest)))[0] if len(begin_at) else np.empty(0, np.uint64)
    line_first = np.searchsorted(begin_at, words.first)
    some = np.maximum(1, n)
    longest = np.zeros(len(n))
    if len(length):
        filled = n > 0
        longest[filled] = np.maximum.reduceat(length, words.first[:-1][filled])
    rows = np.column_stack([
        np.log1p(n), _per(length, words.first) / some, by_kind[0], by_kind[1], by_kind[2], by_kind[3], _per(last, words.first) / some,
        1 - _repeats(words.digest, words.first, 1) / some, _per(signs == length, words.first) / some, _per(signs > 0, words.first) / some,
        _repeats(pairs, words.first, 2) / some, _repeats(eights, words.first, 8) / some, np.minimum(n / lines, 100) / 100, _repeats(heads, line_first, 1) / lines, np.log1p(longest), by_kind[4],
    ])
    rows[n == 0] = 0
    return rows


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_bytes(batch.column(0))
        parts = [features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in runs(at, AT_ONCE)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=[*batch.schema.names[1:], "features"])


def measure(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns `keep` of each row with its features; one of them that is named features is replaced. Null and empty texts
    have features of 0. Rows map one to one, repeated ones too; an empty table gives an empty result."""
    kept = docs.select(F.col(text).alias("_text"), *(c for c in keep if c != "features"))
    return kept.mapInArrow(_measured, T.StructType(kept.schema.fields[1:]).add("features", T.ArrayType(T.DoubleType())))


class Model:
    """A logistic model of standardised features and their squares."""

    def __init__(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.weights = np.zeros(2 * x.shape[1] + 1)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def margin(self, design: np.ndarray) -> np.ndarray:
        return design @ self.weights

    def column(self, features: Column) -> Column:
        """The score as a Column, so that no second pass through Python is needed."""
        total: Column = F.lit(float(self.weights[0]))
        k = len(self.mean)
        for i in range(k):
            z = (F.get(features, F.lit(i)) - float(self.mean[i])) / float(self.scale[i])
            z = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z))
            total = total + z * float(self.weights[1 + i]) + z * z * float(self.weights[1 + k + i])
        return 1 / (1 + F.exp(-total))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-2) -> Model:
    """Minimises the non-negative unbiased risk of the logistic loss by Adam over all rows.

    risk = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the second term would fall below 0 the step goes the
    other way on it, as published for this estimator.
    """
    model = Model(unlabelled)
    p, u = model.design(positive), model.design(unlabelled)
    sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(m, -30, 30)))
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        at_p, at_u = sigmoid(model.margin(p)), sigmoid(model.margin(u))
        negative = -np.log(np.maximum(1 - at_u, 1e-12)).mean() + prior * np.log(np.maximum(1 - at_p, 1e-12)).mean()
        of_negative = u.T @ at_u / len(u) - prior * (p.T @ at_p) / len(p)
        if negative >= 0:
            gradient = -prior * (p.T @ (1 - at_p)) / len(p) + of_negative
        else:
            gradient = -of_negative
        gradient = gradient + decay * np.concatenate(([0], model.weights[1:]))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        model.weights = model.weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return model


def estimate_prior(at_positive: np.ndarray, at_unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled texts: the least ratio of what lies above a threshold, unlabelled to positive,
    over thresholds that at least a tenth of the positives pass. The standard errors are added to the numerator, so that
    small samples don't make the least ratio too low."""
    cuts = np.quantile(at_positive, np.linspace(0.0, 0.9, 46))
    above_p = 1 - np.searchsorted(np.sort(at_positive), cuts, "left") / len(at_positive)
    above_u = 1 - np.searchsorted(np.sort(at_unlabelled), cuts, "left") / len(at_unlabelled)
    slack = np.sqrt(above_u * (1 - above_u) / len(at_unlabelled)) + np.sqrt(above_p * (1 - above_p) / len(at_positive))
    return float(np.clip(((above_u + slack) / above_p).min(), 0.05, 0.95))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Model, float]:
    """The model and the class prior. The prior is estimated on each half of both samples by a model of the other half,
    first fitted at a prior of one half; the mean of both is taken."""
    found = []
    for k in range(2):
        ranked = fit(positive[k::2], unlabelled[k::2], 0.5, steps=300) if len(positive) > 1 and len(unlabelled) > 1 else fit(positive, unlabelled, 0.5, steps=300)
        p, u = (positive[1 - k :: 2], unlabelled[1 - k :: 2]) if len(positive) > 1 and len(unlabelled) > 1 else (positive, unlabelled)
        found.append(estimate_prior(ranked.margin(ranked.design(p)), ranked.margin(ranked.design(u))))
    prior = sum(found) / 2
    return fit(positive, unlabelled, prior), prior


def _sample(measured: DataFrame, key: str, most: int) -> np.ndarray:
    rows = bounded(measured, most, key, "features").select("features").toArrow().column(0)
    flat = rows.combine_chunks()
    return np.asarray(flat.flatten()).reshape(-1, len(FEATURES)) if len(flat) else np.zeros((0, len(FEATURES)))


def score(measured: DataFrame, trusted: DataFrame, key: str = "doc_id", most_fitted: int = MOST_FITTED) -> DataFrame:
    """measured (key, features, ...) with `score`. trusted: (key, features) of positives that may be learned from.

    Both samples are the first most_fitted rows by hash of the key. Without trusted positives or without texts every score
    is 0.5. Rows map one to one, repeated and null keys too.
    """
    positive, unlabelled = _sample(trusted, key, most_fitted), _sample(measured, key, most_fitted)
    if not len(positive) or not len(unlabelled):
        return measured.withColumn("score", F.lit(0.5))
    model, _ = learn(positive, unlabelled)
    return measured.withColumn("score", model.column(F.col("features")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, from trusted positives among labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    measured = written(measure(docs, ("doc_id", "held_out")))
    good = table(spark, sf_dir, "labels").where("quality = 1").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id").distinct()
    trusted = measured.join(small(good), "doc_id", "left_semi")
    return score(measured, trusted).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
