"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed words.

P(grade >= j | x) = sigmoid(w.x - t_j) with one weight vector w for all grades and ascending thresholds t_1 < t_2 < ... Grades are
0, 1, ..., J. A text's features are the words that occur in it, once each, hashed into ``DIMS`` buckets, and the ranges of a few shares: of
upper case letters, of characters other than letters and digits, of repeated words, of words said twice in a row. The expected grade is the sum of the tail
probabilities.

Weights and thresholds maximise the penalised likelihood (L-BFGS). Buckets whose share of texts hardly differs between low and high grades
keep weight 0. The model is fitted on about ``sample_rows`` rated documents, taken by a hash of the id (a documented bound); every
document is scored, on its whole text, read in pieces.

Defined results: a null or empty text is scored by its ranges alone; without rated rows every probability is one half; an equal
text with an equal id and rating counts once, others each; repeated documents get a row each; null ids are never learned from; other columns stay, but for those named like an
added one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import Workspace, free_name, others
from parley.llm.words import BLOCK, Hasher

DIMS = 1 << 18
#: Where the ranges of the shares begin.
RANGES = np.array([0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
SHARES = 4
SIZE = DIMS + SHARES * (len(RANGES) + 1)
KINDS = np.array([1 if 0x41 <= b <= 0x5A else 0 if b in (9, 10, 13, 32) or chr(b).isalnum() or b >= 128 else 2 for b in range(256)], np.uint8)


def features(hasher: Hasher, texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Each text's buckets."""
    for first, hashes, offsets in hasher.texts(texts):
        buckets = (hashes >> np.uint64(46)).astype(np.int32)
        for d in range(len(offsets) - 1):
            said = buckets[offsets[d] : offsets[d + 1]]
            own = np.unique(said)
            text, n = texts[first + d] or b"", int(offsets[d + 1] - offsets[d])
            upper = odd = 0
            for at in range(0, len(text), BLOCK):
                kinds = np.bincount(KINDS[np.frombuffer(text[at : at + BLOCK], np.uint8)], minlength=3)
                upper, odd = upper + int(kinds[1]), odd + int(kinds[2])
            shares = (upper / max(1, len(text)), odd / max(1, len(text)), 1 - len(own) / n if n else 0.0, float((said[1:] == said[:-1]).mean()) if n > 1 else 0.0)
            ranges = DIMS + np.arange(SHARES) * (len(RANGES) + 1) + np.searchsorted(RANGES, shares, side="right")
            yield np.concatenate([own, ranges.astype(np.int32)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, buckets: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return sigmoid(float(self.weights[buckets].sum()) - self.thresholds)


def telling(rows: list[tuple[int, np.ndarray]], grades: int, least: float = 4.0, min_df: int = 5) -> np.ndarray:
    """Buckets whose share of texts differs by ``least`` standard errors between the grades below some threshold and the others."""
    z = np.zeros(SIZE)
    y = np.array([g for g, _ in rows])
    by = np.zeros((grades + 1, SIZE))
    for g, b in rows:
        by[g, b] += 1
    whole, n = by.sum(0), len(rows)
    for j in range(1, grades + 1):
        high = int((y >= j).sum())
        if 0 < high < n:
            share = whole / n
            gap = by[j:].sum(0) / high - by[:j].sum(0) / (n - high)
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / high + 1 / (n - high)))
            z = np.maximum(z, np.abs(gap) / error)
    z[whole < min_df] = 0
    z[DIMS:] = np.where(whole[DIMS:] >= min_df, np.maximum(z[DIMS:], least), 0)
    return np.flatnonzero(z >= least)


class Indicators:
    """A matrix of zeros and ones, by the places of the ones."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.shape = len(rows), columns

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.shape[1])


def objective(theta: np.ndarray, x: Indicators, y: np.ndarray, grades: int, l2: float) -> tuple[float, np.ndarray]:
    """Negative penalised log-likelihood and its gradient. ``theta``: weights, the first threshold, logarithms of the steps to the next."""
    k = x.shape[1]
    w, steps = theta[:k], np.exp(theta[k + 1 :])
    t = theta[k] + np.concatenate([[0.0], np.cumsum(steps)])
    tail = np.ones((len(y), grades + 2))
    tail[:, 1:-1] = sigmoid(x.times(w)[:, None] - t)
    tail[:, -1] = 0
    at = np.arange(len(y))
    slope = tail * (1 - tail)
    chance = np.maximum(tail[at, y] - tail[at, y + 1], 1e-12)
    low, high = slope[at, y] / chance, slope[at, y + 1] / chance
    d_t = np.array([high[y == j - 1].sum() - low[y == j].sum() for j in range(1, grades + 1)])
    d_theta = np.concatenate([x.transposed_times(low - high) - l2 * w, [d_t.sum()], [d_t[j:].sum() * steps[j - 1] for j in range(1, grades)]])
    return float(-np.log(chance).sum() + l2 / 2 * (w @ w)), -d_theta


def minimise(f, theta: np.ndarray, rounds: int = 200, memory: int = 10) -> np.ndarray:
    """L-BFGS with a halving line search."""
    value, slope = f(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, coefficients = -slope, []
        for s, d in reversed(pairs):
            a = (s @ step) / (s @ d)
            coefficients.append(a)
            step = step - a * d
        if pairs:
            s, d = pairs[-1]
            step = step * ((s @ d) / (d @ d))
        else:
            step = step / max(1.0, float(np.linalg.norm(step)))
        for (s, d), a in zip(pairs, reversed(coefficients), strict=True):
            step = step + (a - (d @ step) / (s @ d)) * s
        rate, down = 1.0, float(slope @ step)
        while rate > 1e-10 and (new := f(theta + rate * step))[0] > value + 1e-4 * rate * down:
            rate /= 2
        if rate <= 1e-10 or value - new[0] < 1e-7 * abs(value):
            break
        s, d = rate * step, new[1] - slope
        theta, value, slope = theta + s, *new
        if s @ d > 1e-12:
            pairs = [*pairs[1 - memory :], (s, d)]
    return theta


def learn(rows: list[tuple[int, np.ndarray]], grades: int, l2: float = 0.2, least: float = 4.0, min_df: int = 5) -> Model:
    kept = telling(rows, grades, least, min_df)
    number = np.full(SIZE, -1)
    number[kept] = np.arange(len(kept))
    x = Indicators([own[own >= 0] for own in (number[b] for _, b in rows)], len(kept))
    y = np.array([g for g, _ in rows])
    theta = minimise(lambda v: objective(v, x, y, grades, l2), np.zeros(len(kept) + grades))
    weights = np.zeros(SIZE, np.float32)
    weights[kept] = theta[: len(kept)]
    t = theta[len(kept)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(kept) + 1 :]))])
    return Model(weights, t.astype(np.float32))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", grade_col: str = "grade", text_col: str = "text", sample_rows: int = 12_000, l2: float = 0.2, least: float = 4.0, min_df: int = 5) -> Model:
    """``ratings``: (id, grade from 0 to ``grades``). Buckets that ``min_df`` texts of the sample have, with shares that differ by ``least`` standard
    errors between grades, get weights, however many they are."""
    spark = docs.sparkSession
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id is not null and grade is not null")
    n = rated.count()
    if not n:
        return Model(np.zeros(SIZE, np.float32), np.zeros(grades, np.float32))
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rated.filter(draw < F.lit(sample_rows / n))
    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "utf-8").alias("text")).join(F.broadcast(sample), "id").select("id", "grade", "text")  # about sample_rows rows
    texts = texts.dropDuplicates(["id", "grade", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = list(features(hasher, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([b.tobytes() for b in found], pa.binary())], names=["id", "grade", "buckets"])

    made = Workspace(spark, "quality").table(texts.mapInArrow(run, "id long, grade int, buckets binary"), "sample")

    # The sample meets in one task, not in the driver; it is bounded by sample_rows.
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, y, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((i, y, np.frombuffer(b, np.int32)))
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = learn([r[1:] for r in rows], grades, l2, least, min_df)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (model.weights, model.thresholds)], names=["w", "t"])

    row = made.coalesce(1).mapInArrow(train, "w binary, t binary").first()
    return Model(*(np.frombuffer(x, np.float32) for x in row))


def rate(docs: DataFrame, model: Model, keep_grade: int, min_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` plus expected_grade, tail (P(grade >= keep_grade)) and keep (tail >= min_tail)."""
    added = ("expected_grade", "tail", "keep")
    names = others(docs, *added)
    own = docs.select(*(F.col(f"`{c}`") for c in names))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # SIZE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), Model(*shared.value)
        for batch in batches:
            tails = [own.tails(b) for b in features(hasher, batch.column(len(names)).to_pylist())]
            tail = [float(p[keep_grade - 1]) for p in tails]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([float(p.sum()) for p in tails], pa.float64()), pa.array(tail, pa.float64()), pa.array([p >= min_tail for p in tail], pa.bool_())], names=[*names, *added])

    schema = T.StructType([*own.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return docs.select(*(F.col(f"`{c}`") for c in names), F.encode(F.col(text_col), "utf-8").alias(free_name(docs, "_raw"))).mapInArrow(run, schema)
