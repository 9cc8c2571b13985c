"""Keyphrases by PageRank on the graph of similar utterances of a document.

Any two utterances with a word in common are linked, whatever the similarity, and ranks ignore the similarity unless ``weighted`` is asked
for; so the three similarities give the same keyphrases by default. Nodes are texts: equal ones are one node, with a loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.corpus import chosen_speakers
from parley.operators.graph import pagerank
from parley.operators.vectors import within_document_vectors

METHODS = ("naive", "idf-mod", "tfidf")


def _pairs(rows: DataFrame, value: str, total) -> DataFrame:
    """Sum of products of ``value`` over the words that two utterances of a document share."""
    a = rows.select("doc_id", "term", F.col("pos").alias("i"), F.col(value).alias("x"))
    b = rows.select("doc_id", "term", F.col("pos").alias("j"), F.col(value).alias("y"))
    return a.join(b, ["doc_id", "term"]).filter("i < j").groupBy("doc_id", "i", "j").agg(total.alias("sim"))


def overlaps(utterances: DataFrame, pattern: str = X.TOKEN) -> DataFrame:
    """(doc_id, i, j, overlap): words that both utterances have."""
    rows = utterances.select("doc_id", "pos", F.explode(F.array_distinct(X.tokens(F.col("tokenized"), pattern))).alias("term")).withColumn("one", F.lit(1))
    return _pairs(rows, "one", F.count(F.lit(1))).withColumnRenamed("sim", "overlap")


def edges(utterances: DataFrame, method: str = "naive", pattern: str = X.TOKEN) -> DataFrame:
    """(doc_id, i, j, sim). Words are what matches ``pattern`` in the cleaned text. An unknown method counts as naive."""
    if method == "idf-mod":
        rows = within_document_vectors(utterances, pattern).withColumn("v", F.col("tf") * F.col("idf"))
        norms = rows.groupBy("doc_id", "pos").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        found = _pairs(rows, "v", F.sum(F.col("x") * F.col("y")))
        left, right = (norms.select("doc_id", F.col("pos").alias(c), F.col("norm").alias(f"norm_{c}")) for c in ("i", "j"))
        return found.join(left, ["doc_id", "i"]).join(right, ["doc_id", "j"]).select("doc_id", "i", "j", (F.col("sim") / (F.col("norm_i") * F.col("norm_j"))).alias("sim"))
    if method == "tfidf":
        return _pairs(within_document_vectors(utterances, pattern), "w", F.sum(F.col("x") * F.col("y")))
    return overlaps(utterances, pattern).select("doc_id", "i", "j", X.naive_edge(F.col("overlap")).alias("sim"))


def graph(utterances: DataFrame, method: str = "naive", weighted: bool = False, prune: bool = False, pattern: str = X.TOKEN) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, node, text), a node being the first position of its text, and edges (doc_id, a, b[, weight])."""
    node = F.min("pos").over(Window.partitionBy("doc_id", "text")).alias("node")
    known = utterances.select("doc_id", "pos", "text", node)
    found = edges(utterances, method, pattern) if weighted else overlaps(utterances, pattern)
    ends = found.join(known.select("doc_id", F.col("pos").alias("i"), F.col("node").alias("x")), ["doc_id", "i"]).join(known.select("doc_id", F.col("pos").alias("j"), F.col("node").alias("y")), ["doc_id", "j"])
    ends = ends.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    ends = ends.groupBy("doc_id", "a", "b").agg(F.max("sim").alias("weight")) if weighted else ends.select("doc_id", "a", "b").distinct()
    nodes = known.filter("pos = node").select("doc_id", "node", "text")
    if prune:
        linked = ends.select("doc_id", F.col("a").alias("node")).union(ends.select("doc_id", F.col("b").alias("node")))
        nodes = nodes.join(linked, ["doc_id", "node"], "left_semi")
    return nodes, ends


def scores(utterances: DataFrame, method: str = "naive", weighted: bool = False, rounds: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, pattern: str = X.TOKEN) -> DataFrame:
    """(doc_id, node, text, score). With ``keep`` documents of very many edges are ranked by joins, not in a task."""
    nodes, ends = graph(utterances, method, weighted, pattern=pattern)
    return pagerank(nodes.select("doc_id", "node"), ends, rounds, keep).join(nodes, ["doc_id", "node"])


def keyphrases(utterances: DataFrame, speakers: list[str] | None = None, use_main: bool = False, top: int = 5, max_words: int | None = 50, method: str = "naive", weighted: bool = False, rounds: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, pattern: str = X.TOKEN) -> DataFrame:
    """(doc_id, rank, text, score): the best of each document with fewer than ``max_words`` words; ties go to the first text."""
    ranked = scores(chosen_speakers(utterances, speakers, use_main), method, weighted, rounds, keep, pattern)
    if max_words:
        ranked = ranked.filter(F.size(X.words(F.col("text"))) < max_words)
    # Scores that differ in rounding only are ties.
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "node")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("doc_id", "rank", "text", "score")
