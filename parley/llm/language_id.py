"""Language identification by nearest centroid: TF-IDF vectors of byte n-grams against several clustered centroids per language.

A text is lower-cased and everything but letters becomes one space (in the JVM); the n-grams of 1 to 4 bytes of its UTF-8 form are
hashed into ``DIMS`` buckets, weighted by (1 + ln tf) * idf and scaled to length 1. Centroids are the spherical k-means clusters of
each language's training texts. The prediction is the language of the centroid with the largest cosine, which is the score.

A text too far from all centroids is rejected. Cosines grow with the number of different n-grams of a text, so distances are compared with
those of training texts of its language and size (a power of two of different n-grams): its score must be ``REJECT`` times their
first percentile, or that of all languages where there are fewer than ``ENOUGH`` such texts, or that of the next smaller size.

The model is fitted on a sample: ``per_language`` documents of each language in expectation (a parameter), taken by a hash of id and text, so
that a language's share of the table does not matter. Every label is learned; a language takes ``DIMS * clusters`` floats, half a megabyte.
Prediction reads every text as a whole, in pieces, whatever its length.

Defined results: a null text, and one without letters, is ``und`` with score 0; a table without labelled rows makes everything ``und``;
ties between languages go to the first in alphabetical order; repeated rows get a result each and are learned from once; rows with a null id
or null language are never learned from; other columns stay, but for those named like an added one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import HEAVY_KEYS, Workspace, free_name, others

DIMS = 1 << 15
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 20
REJECT, ENOUGH, SIZES = 0.4, 20, 17


def letters(text: Column) -> Column:
    return F.encode(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), "utf-8")


def codes(data: bytes) -> np.ndarray:
    """Buckets of all n-grams of one piece."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    found, h = [], np.zeros(len(a), np.uint32)
    for n in ORDERS:
        if len(a) < n:
            break
        h = (h[: len(a) - n + 1] * np.uint32(0x01000193)) ^ (a[n - 1 :] + np.uint32(n * 257))
        g = h * np.uint32(0x9E3779B1)
        found.append((g >> np.uint32(17)).astype(np.uint16))
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and their numbers; pieces overlap by what an n-gram needs."""
    if len(text) <= PIECE:
        found = np.sort(codes(text))
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return found[first], np.diff(np.append(first, len(found)))
    whole = np.zeros(DIMS, np.int64)
    most = max(ORDERS) - 1
    for at in range(0, len(text), PIECE):
        whole += np.bincount(codes(text[at : at + PIECE + most]), minlength=DIMS)
        if at + PIECE < len(text):  # what begins in the overlap belongs to the next piece
            whole -= np.bincount(codes(text[at + PIECE : at + PIECE + most]), minlength=DIMS)
    terms = np.flatnonzero(whole)
    return terms.astype(np.uint16), whole[terms]


def spherical_kmeans(vectors: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of sparse unit vectors. Starts from the vectors that are farthest from the starts before them."""
    def dots(c: np.ndarray) -> np.ndarray:
        return np.array([w @ c[t] for t, w in vectors])

    def dense(i: int) -> np.ndarray:
        out = np.zeros(DIMS, np.float32)
        out[vectors[i][0]] = vectors[i][1]
        return out

    def mean(members: np.ndarray) -> np.ndarray:
        out = np.zeros(DIMS, np.float32)
        for i in members:
            out[vectors[i][0]] += vectors[i][1]
        return out / max(1e-12, float(np.linalg.norm(out)))

    centres = [mean(np.arange(len(vectors)))]
    near = dots(centres[0])
    while len(centres) < min(k, len(vectors)):
        centres.append(dense(int(near.argmin())))
        near = np.maximum(near, dots(centres[-1]))
    for _ in range(rounds):
        own = np.stack([dots(c) for c in centres]).argmax(0)
        centres = [mean(np.flatnonzero(own == j)) for j in range(len(centres)) if (own == j).any()]
    return np.stack(centres)


class Model:
    """Names, and one column per centroid of weights that already hold the idf."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, least: dict[str, list[float]] | None = None):
        self.parts = (langs, idf, centroids, least)
        self.langs, self.idf, self.least = langs, idf, least or {}
        self.weights = np.ascontiguousarray((centroids * idf).T)

    def nearest(self, terms: np.ndarray, n: np.ndarray) -> tuple[str | None, float]:
        tf = (1 + np.log(n)).astype(np.float32)
        norm = float(np.linalg.norm(tf * self.idf[terms]))
        if not norm or not self.langs:
            return None, 0.0
        cosine = (tf @ self.weights[terms]) / norm
        best = int(cosine.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cosine[best])))

    def predict(self, text: bytes) -> tuple[str | None, float]:
        return self.nearest(*term_counts(text))

    def judge(self, text: bytes) -> tuple[str | None, float, bool]:
        """Language, score, and if that is too low for a text of this size."""
        terms, n = term_counts(text)
        lang, score = self.nearest(terms, n)
        return lang, score, lang is None or score < self.least.get(lang, [0.0] * SIZES)[size_of(terms)]


def size_of(terms: np.ndarray) -> int:
    return min(SIZES - 1, max(1, len(terms)).bit_length() - 1)


def least_scores(rows: list[tuple[str, int, float, int]], everywhere: list[tuple[int, float, int]], langs: list[str]) -> dict[str, list[float]]:
    """For each language and size the score below which a text is rejected; from (lang, size, percentile, n) and (size, percentile, n)."""
    own = {(lang, size): p for lang, size, p, n in rows if n >= ENOUGH}
    whole = {size: p for size, p, n in everywhere if n >= ENOUGH}
    out: dict[str, list[float]] = {}
    for lang in set(langs):
        last, found = 0.0, []
        for size in range(SIZES):
            last = own.get((lang, size), whole.get(size, last))
            found.append(REJECT * last)
        out[lang] = found
    return out


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 300, clusters: int = 4) -> Model:
    """Fit on the rows of ``docs``, which are the training rows."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    space = Workspace(spark, "language-id")
    counts = space.table(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")), "counts")
    n_langs = counts.count()
    if not n_langs:
        return Model([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32))
    unit = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(17))
    draw = F.pmod(unit, F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select(F.col(lang_col).alias("lang"), unit.alias("unit"), draw.alias("draw"), F.col(text_col).alias("text"))
    drawn = drawn.join(F.broadcast(counts) if n_langs <= HEAVY_KEYS else counts, "lang").filter(F.col("draw") * F.col("n") < per_language).dropDuplicates(["lang", "unit"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.astype(np.int32) for t, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int64()))], names=["lang", "terms", "tf"])

    sample = space.table(drawn.select("lang", letters(F.col("text")).alias("t")).mapInArrow(vectors, "lang string, terms array<int>, tf array<bigint>"), "sample")
    n = sample.count()
    df = np.zeros(DIMS)
    for t, c in sample.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # DIMS rows at most
        df[t] = c
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        made = []
        for terms, tf in zip(group["terms"], group["tf"], strict=True):
            w = (1 + np.log(tf)).astype(np.float32) * idf[terms]
            made.append((terms, w / np.linalg.norm(w)))
        centres = spherical_kmeans(made, clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.tobytes() for c in centres]})

    # A group holds the sample of one language.
    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary").orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    model = Model(langs, idf, np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32))
    shared = spark.sparkContext.broadcast(model.parts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            got = [(t, *own.nearest(t, n)) for t, n in ((np.array(t, np.uint16), np.array(n)) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x, _ in got], pa.string()), pa.array([size_of(t) for t, *_ in got], pa.int32()), pa.array([x for *_, x in got], pa.float64())], names=["lang", "size", "score"])

    scores = space.table(sample.mapInArrow(scored, "lang string, size int, score double").filter("lang is not null"), "scores")
    lowest, n = F.percentile("score", F.lit(0.01)).alias("p"), F.count(F.lit(1)).alias("n")
    by_lang = [tuple(r) for r in scores.groupBy("lang", "size").agg(lowest, n).collect()]  # SIZES rows per language
    everywhere = [tuple(r) for r in scores.groupBy("size").agg(lowest, n).collect()]
    return Model(langs, idf, model.parts[2], least_scores(by_lang, everywhere, langs))


def identify(docs: DataFrame, model: Model, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score and rejected (no letters, too low for a text of its size, or below ``min_score``)."""
    keep = others(docs, "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)  # DIMS * clusters floats per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            found = [own.judge(x.as_py()) if x.is_valid else (None, 0.0, True) for x in batch.column(len(keep))]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x or "und" for x in langs], pa.string()), pa.array(scores, pa.float64()), pa.array([far or s < min_score for _, s, far in found], pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    schema = T.StructType([*docs.select(*(F.col(f"`{c}`") for c in keep)).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    text = F.when(F.col(text_col).rlike(r"\p{L}"), letters(F.col(text_col)))
    return docs.select(*(F.col(f"`{c}`") for c in keep), text.alias(free_name(docs, "_letters"))).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
