"""Extractive summaries that follow the centroid of a document's utterances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.vectors import utterance_idf, utterance_vectors
from parley.plans.settle import settled

METHODS = ("first", "best", "tfidf", "all")
CANDIDATES = 250


def centroids(vectors: DataFrame) -> DataFrame:
    """(doc_id, term, c): sums of the vectors of a document."""
    return vectors.groupBy("doc_id", "term").agg(F.sum("w").alias("c"))


def cosines(utterances: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, score): cosine to the centroid; 0 for an utterance without words."""
    whole = with_centroids(vectors if vectors is not None else utterance_vectors(utterances))
    found = whole.groupBy("doc_id", "pos").agg((F.sum(F.col("w") * F.col("c")) / F.max("length")).alias("score"))
    return utterances.select("doc_id", "pos").join(found, ["doc_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def new_vocabulary(utterances: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(doc_id, pos, score): sum of the idf above ``threshold`` of the words that no earlier utterance of the document has."""
    words = utterances.select("doc_id", "pos", F.explode(X.tokens(F.col("tokenized"))).alias("term"))
    fresh = words.withColumn("first", F.min("pos").over(Window.partitionBy("doc_id", "term"))).filter("pos = first")
    value = F.when(F.col("idf") > threshold, F.col("idf")).otherwise(F.lit(0.0))
    found = fresh.join(utterance_idf(utterances), "term").groupBy("doc_id", "pos").agg(F.sum(value).alias("score"))
    return utterances.select("doc_id", "pos").join(found, ["doc_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def greedy(to_centre: np.ndarray, gram: np.ndarray, length: float, steps: int) -> list[int]:
    """Each step adds the row with which the sum is nearest to the centroid; rows stay eligible, ties go to the first."""
    n = len(to_centre)
    picked: list[int] = []
    with_sum, norm2, dot = np.zeros(n), 0.0, 0.0
    own = np.diag(gram)
    for _ in range(steps if n else 0):
        bottom = length * np.sqrt(np.maximum(0, norm2 + 2 * with_sum + own))
        cosine = np.divide(dot + to_centre, bottom, out=np.zeros(n), where=bottom > 1e-12)
        best = int(np.flatnonzero(cosine >= cosine.max() - 1e-12)[0])
        picked.append(best)
        norm2 += 2 * with_sum[best] + own[best]
        dot += to_centre[best]
        with_sum = with_sum + gram[best]
    return picked


def with_centroids(vectors: DataFrame) -> DataFrame:
    """``vectors`` plus c, the centroid's weight of the term, and length, that of the document's centroid: the squares of its weights are the sum of w * c.

    Both are sums within a document, so a single pass over the vectors is enough.
    """
    own = vectors.withColumn("c", F.sum("w").over(Window.partitionBy("doc_id", "term")))
    return own.withColumn("length", F.sqrt(F.sum(F.col("w") * F.col("c")).over(Window.partitionBy("doc_id"))))


def cover(utterances: DataFrame, whole: DataFrame, steps: int) -> DataFrame:
    """(doc_id, step, pos, text): the greedy choice among all utterances of a document, step by step over all documents at once.

    A candidate keeps its products with the centroid, with itself and with the sum of what was taken, the last of which grows by its product with
    what a step takes: a join of the vectors with the taken ones by document and term. So no task holds a document, and a step costs
    what that join costs. Ties go to the first utterance; utterances without words score 0.
    """
    vectors = settled(whole.select("doc_id", "pos", "term", "w"))
    own = whole.groupBy("doc_id", "pos").agg(F.sum(F.col("w") * F.col("c")).alias("toc"), F.sum(F.col("w") * F.col("w")).alias("own"))
    lengths = whole.groupBy("doc_id").agg(F.max("length").alias("length"))
    zero = F.lit(0.0)
    state = utterances.select("doc_id", "pos").join(own, ["doc_id", "pos"], "left").join(lengths, "doc_id", "left").na.fill(0.0, ["toc", "own", "length"])
    state = settled(state.withColumns({"with_sum": zero, "norm2": zero, "dot": zero}))
    taken = []
    for step in range(steps):
        bottom = F.col("length") * F.sqrt(F.greatest(zero, F.col("norm2") + 2 * F.col("with_sum") + F.col("own")))
        scored = state.withColumn("cosine", F.when(bottom > 1e-12, (F.col("dot") + F.col("toc")) / bottom).otherwise(zero))
        most = scored.groupBy("doc_id").agg(F.max("cosine").alias("most"))
        near = scored.join(most, "doc_id").filter(F.col("cosine") >= F.col("most") - 1e-12)
        first = F.min_by(F.struct("pos", F.col("with_sum").alias("s"), F.col("own").alias("o"), F.col("toc").alias("t")), "pos")
        best = settled(near.groupBy("doc_id").agg(first.alias("b")).select("doc_id", "b.*"))
        taken.append(best.select("doc_id", F.lit(step).cast("long").alias("step"), "pos"))
        if step < steps - 1:
            with_best = vectors.join(best.select("doc_id", "pos"), ["doc_id", "pos"]).select("doc_id", "term", F.col("w").alias("b"))
            more = vectors.join(with_best, ["doc_id", "term"]).groupBy("doc_id", "pos").agg(F.sum(F.col("w") * F.col("b")).alias("more"))
            grown = state.join(more, ["doc_id", "pos"], "left").join(best.drop("pos"), "doc_id")
            state = settled(grown.select("doc_id", "pos", "toc", "own", "length", (F.col("with_sum") + F.coalesce("more", zero)).alias("with_sum"), (F.col("norm2") + 2 * F.col("s") + F.col("o")).alias("norm2"), (F.col("dot") + F.col("t")).alias("dot")))
    picked = taken[0]
    for one in taken[1:]:
        picked = picked.unionByName(one)
    return picked.join(utterances.select("doc_id", "pos", "text"), ["doc_id", "pos"]).select("doc_id", "step", "pos", "text")


def summarize(utterances: DataFrame, method: str = "first", n: int = CANDIDATES, length: int = 5, threshold: float = 10.0) -> DataFrame:
    """(doc_id, step, pos, text). The candidates are the first ``n`` utterances, the ``best`` by cosine, the best by ``tfidf`` of new words, or
    ``all``, however many. An unknown method counts as first."""
    whole = with_centroids(utterance_vectors(utterances))
    # Scores that a choice needs come from the same pass; utterances without words score 0.
    terms = whole.groupBy("doc_id", "pos").agg(F.collect_list(F.struct("term", "w", "c")).alias("terms"), F.max("length").alias("length"), (F.sum(F.col("w") * F.col("c")) / F.max("length")).alias("score"))
    if method == "all":
        return cover(utterances, whole, length)
    rows = utterances.select("doc_id", "pos", "text").join(terms, ["doc_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if method == "tfidf":
        rows = rows.drop("score").join(new_vocabulary(utterances, threshold), ["doc_id", "pos"])
    if method in ("best", "tfidf"):
        best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "pos")
        rows = rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n).drop("r")
    else:
        rows = rows.filter(F.col("pos") < n)
    # The centroid's length, for candidates without words too.
    rows = rows.withColumn("length", F.max("length").over(Window.partitionBy("doc_id"))).drop("score")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        at: dict[str, int] = {}
        sparse = [[] if t is None else t for t in group["terms"]]
        for own in sparse:
            for x in own:
                at.setdefault(x["term"], len(at))
        dense, centre = np.zeros((len(group), len(at))), np.zeros(len(at))
        for i, own in enumerate(sparse):
            for x in own:
                dense[i, at[x["term"]]] = x["w"]
                centre[at[x["term"]]] = x["c"]
        whole = group["length"].iloc[0]
        picked = greedy(dense @ centre, dense @ dense.T, 0.0 if pd.isna(whole) else float(whole), length)
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[0], "step": np.arange(len(picked)), "pos": group["pos"].to_numpy()[picked], "text": group["text"].to_numpy()[picked]})

    return rows.groupBy("doc_id").applyInPandas(run, "doc_id long, step long, pos long, text string")
