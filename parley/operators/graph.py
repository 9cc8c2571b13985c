"""PageRank and centrality. Graphs are undirected edges (doc_id, a, b), a self-loop once; nodes (doc_id, node)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def power_iteration(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Ranks of one graph. A fixed number of ``rounds``, or until the change is below the tolerance."""
    loops = a == b
    src, dst = np.concatenate([a, b[~loops]]), np.concatenate([b, a[~loops]])
    weight = np.concatenate([weight, weight[~loops]])
    out = np.bincount(src, weight, n)
    dangling = out == 0
    share = weight / out[src] if len(src) else weight
    rank = np.full(n, 1 / n)
    for _ in range(rounds if rounds is not None else ROUNDS):
        new = DAMPING * (np.bincount(dst, rank[src] * share, n) + rank[dangling].sum() / n) + (1 - DAMPING) / n
        change = np.abs(new - rank).sum()
        rank = new
        if rounds is None and change < n * TOLERANCE:
            break
    return rank


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, most: int = 5_000_000) -> DataFrame:
    """(doc_id, node, score): each document's graph in a group of its own. ``edges`` may carry a ``weight``, else 1.

    With ``keep`` (see ``pagerank_frames``), documents of more than ``most`` edges are ranked by joins, in a fixed number of rounds.
    """
    if keep:
        edges = keep(edges)
        large = keep(edges.groupBy("doc_id").count().filter(F.col("count") > most).select("doc_id"))
        if not large.isEmpty():
            # Documents beyond a task's size; there are few.
            many = pagerank_frames(nodes.join(large, "doc_id", "left_semi"), edges.join(large, "doc_id", "left_semi"), rounds or ROUNDS, keep)
            return pagerank(nodes.join(large, "doc_id", "left_anti"), edges.join(large, "doc_id", "left_anti"), rounds).unionByName(many)
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    linked = edges.select("doc_id", "a", "b", weight.alias("weight"))
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list("node")).alias("nodes")).join(linked.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "weight")).alias("edges")), "doc_id", "left")

    def run(parts):
        for part in parts:
            out = []
            for doc, names, own in zip(part["doc_id"], part["nodes"], part["edges"], strict=True):
                at = {x: i for i, x in enumerate(names)}
                own = [] if own is None else own
                ends = [np.array([at[e[c]] for e in own], np.int64) for c in ("a", "b")]
                rank = power_iteration(len(at), *ends, np.array([e["weight"] for e in own], float), rounds)
                out.append(pd.DataFrame({"doc_id": doc, "node": names, "score": rank}))
            yield pd.concat(out) if out else pd.DataFrame({"doc_id": [], "node": [], "score": []})

    kind = nodes.schema["node"].dataType.simpleString()
    # One row per document, so Arrow batches hold many small graphs.
    return rows.mapInPandas(run, f"doc_id {nodes.schema['doc_id'].dataType.simpleString()}, node {kind}, score double")


def transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, src, dst, p) of the edges in both directions, by their weights if they have some; nodes without edges have no row."""
    edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    both = edges.select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(edges.filter("a <> b").select("doc_id", F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    degree = both.groupBy("doc_id", "src").agg(F.sum("weight").alias("degree"))
    return both.join(degree, ["doc_id", "src"]).select("doc_id", "src", "dst", (F.col("weight") / F.col("degree")).alias("p"))


def pagerank_frames(nodes: DataFrame, edges: DataFrame, rounds: int, keep) -> DataFrame:
    """The same as joins and aggregations, for graphs larger than a task. ``keep`` writes a DataFrame and reads it back (say
    ``DataFrame.checkpoint``), so that lineage stays short; it is called every five rounds."""
    steps = keep(transitions(nodes, edges))
    sizes = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    base = keep(nodes.join(sizes, "doc_id").join(steps.select("doc_id", F.col("src").alias("node"), F.lit(False).alias("dangling")).distinct(), ["doc_id", "node"], "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))))
    rank = base.withColumn("score", 1.0 / F.col("n"))
    for r in range(rounds):
        lost = rank.filter("dangling").groupBy("doc_id").agg(F.sum("score").alias("lost"))
        got = rank.select("doc_id", F.col("node").alias("src"), "score").join(steps, ["doc_id", "src"]).groupBy("doc_id", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        new = base.join(got, ["doc_id", "node"], "left").join(lost, "doc_id", "left")
        rank = new.select("doc_id", "node", "n", "dangling", (DAMPING * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n")) + (1 - DAMPING) / F.col("n")).alias("score"))
        if r % 5 == 4:
            rank = keep(rank)
    return rank.select("doc_id", "node", "score")


def eigenvector(weights: np.ndarray) -> np.ndarray | None:
    """Of a symmetric matrix of weights, by steps x + Ax; None if ``ROUNDS`` do not suffice."""
    n = len(weights)
    x = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = x + weights @ x
        new /= np.linalg.norm(new) or 1.0
        if np.abs(new - x).sum() < n * TOLERANCE:
            return new
        x = new
    return None


def centrality(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, centrality) of one network of some dozens of keywords, by eigenvector, or by degree where that does not converge.

    ``edges``: (k1, k2, weight). The network is bounded by the number of keywords and is solved in one task.
    """
    whole = terms.select("term", F.lit(None).cast("string").alias("k2"), F.lit(0.0).alias("weight")).union(edges.select("k1", "k2", "weight"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["term", "k2", "weight"]]
        names = sorted(set(rows["term"][rows["k2"].isna()]))
        at = {x: i for i, x in enumerate(names)}
        matrix = np.zeros((len(names), len(names)))
        for a, b, w in rows[rows["k2"].notna()].itertuples(index=False):
            matrix[at[a], at[b]] = matrix[at[b], at[a]] = w
        found = eigenvector(matrix)
        if found is None:
            found = (matrix > 0).sum(1) / max(1, len(names) - 1)
        return pd.DataFrame({"term": names, "centrality": found})

    return whole.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, "term string, centrality double")
