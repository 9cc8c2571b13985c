"""Connected components of a distributed edge list, without ever collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Workspace, attach


#: Edges that one task takes at once; 16 bytes each.
ONE_TASK = 200_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a bounded number of edges, by union-find with the smallest node as root."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([top(x) for x in list(root)], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, label): for each end of an edge (a, b) the smallest node of its component.

    Up to ``ONE_TASK`` edges are united in one task. Beyond that, each round hooks every current label to the smallest label that an
    edge joins it to, follows these pointers to their end, and puts the new labels into the edges; edges within a label go. So labels at
    least halve in number where edges remain, and the rounds are few. Joins use ``attach``, so a label with a large part of all edges is
    no hot key.
    """
    if edges.count() <= ONE_TASK:
        return space.table(edges.select("a", "b").coalesce(1).mapInArrow(united, "node long, label long"), f"{name}-labels")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = space.table(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label")), f"{name}-labels0")
    live = space.table(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-live0")
    rounds = 0
    while n_live := live.count():
        rounds += 1
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = space.table(both.groupBy("a").agg(F.min("b").alias("to"), F.count(F.lit(1)).alias("n")).withColumn("to", F.least("a", "to")), f"{name}-hooks{rounds}")
        # Follow pointers up to their end: they only lead to smaller labels, so there are no circles.
        jumps = 0
        while True:
            n_by_to = hooks.filter("to <> a").groupBy("to").agg(F.count(F.lit(1)).alias("m"))
            above = hooks.filter("to <> a").select(F.col("a").alias("to"), F.col("to").alias("next")).join(n_by_to, "to")
            up = attach(hooks.select("to", "a", "n"), above, ["to"], hooks.count(), n="m")
            moved = space.table(up.select("a", F.col("next"), F.col("n").alias("k")), f"{name}-moved{rounds}-{jumps}")
            if moved.isEmpty():
                break
            jumps += 1
            hooks = space.table(hooks.join(moved.select("a", "next"), "a", "left").select("a", F.coalesce("next", "to").alias("to"), "n"), f"{name}-hooks{rounds}-{jumps}")
        n_labels = labels.count()
        per = labels.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
        renamed = hooks.select(F.col("a").alias("label"), "to")
        new = attach(labels, renamed.join(per, "label"), ["label"], n_labels, n="m").select("node", F.col("to").alias("label"))
        old = labels
        # A label without an edge left keeps its nodes.
        stay = attach_anti(old, renamed, n_labels)
        labels = space.table(new.unionByName(stay), f"{name}-labels{rounds}")
        deg_a = live.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
        step = attach(live, hooks.select("a", "to").join(deg_a, "a"), ["a"], n_live, n="m").select(F.col("to").alias("x"), "b")
        step = space.table(step, f"{name}-step{rounds}")
        deg_b = step.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
        step = attach(step, hooks.select(F.col("a").alias("b"), "to").join(deg_b, "b"), ["b"], n_live, n="m").select("x", F.col("to").alias("y"))
        live = space.table(step.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-live{rounds}")
    return labels


def attach_anti(labels: DataFrame, renamed: DataFrame, total: int) -> DataFrame:
    """The rows of ``labels`` whose label is not renamed."""
    per = labels.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    gone = per.join(renamed.select("label"), "label", "left_anti")
    return attach(labels, gone, ["label"], total, n="m")
