"""Exact top-k by inner product over an impact-ordered index that is read score-at-a-time.

Every component x becomes floor(scale * x). The index is cut into blocks of ``block_rows`` vectors. A component other than 0 is a posting of
its dimension; its impact is its size, quantised to ``LEVELS`` levels at most, and the postings of one dimension and one level are a segment.
Queries are answered ``CHUNK`` at a time, alike ones together; a chunk orders all segments of a block by descending weight x impact, weight
being the mean size of its queries' components, and adds them to the accumulators in this order, several at a time.

A vector's score lies within ``rest`` of its accumulator: the sum over dimensions of the query's own weight times the largest impact not yet
read there (or the rounding of the levels, where that is more). So the k-th largest accumulator less ``rest`` is a lower bound of the k-th score, and
a vector whose accumulator plus ``rest`` is below it, or below the k-th score of blocks read before, is proven to be no member. A query stops
in a block once scoring all possible members costs less than reading on; these are scored exactly on the integers. Nothing else stops it.

Blocks are dealt into groups. A group's task builds its blocks once and takes all queries, block by block, the k-th score so far carried from
one block to the next. The groups' lists are merged by (score descending, id ascending).

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a null id take no part; a missing last
component counts as 0; ties go to the smaller id; a candidate with the query's id is the query's own row; repeated query rows are answered
each; fewer than k candidates give fewer rows; an empty table gives none. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import Workspace

LEVELS = 64
#: Shares of the postings after which queries look for a proof.
LOOKS = (0.5, 0.65, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)
#: Queries that read together.
CHUNK = 16
#: Blocks that a group holds at most.
GROUP = 64


def integers(vector: Column, scale: int) -> Column:
    """Null where the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, whole)


def pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """(block, ids, dims, data): blocks of at most ``block_rows`` rows of (id, v); int64, row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vectors: list[list[int]] = []

        def out() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            dims = max(map(len, vectors))
            data = np.zeros((len(ids), dims), np.int64)
            for r, i in enumerate(order):
                data[r, : len(vectors[i])] = vectors[i]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), pa.array([dims], pa.int64()), pa.array([small(data).tobytes()], pa.binary())], names=["block", "ids", "dims", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == block_rows:
                    yield out()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield out()

    return rows.mapInArrow(run, "block long, ids binary, dims long, data binary")


def small(data: np.ndarray) -> np.ndarray:
    """In the shortest type that holds all values; ``unpack`` tells it by the number of bytes."""
    for kind in (np.int8, np.int16, np.int32):
        if not data.size or (data.min() >= np.iinfo(kind).min and data.max() <= np.iinfo(kind).max):
            return data.astype(kind)
    return data


def unpack(ids: bytes, dims: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    width = len(data) // max(1, len(own) * dims)
    return own, np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}.get(width, np.int8)).reshape(len(own), dims).astype(np.int64)


class Index:
    """The segments of one block. ``read`` and ``postings`` sum up what queries read, and what they would have read to the end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        size = np.abs(vectors.T).reshape(-1)
        self.shift = max(0, int(size.max(initial=0)).bit_length() - (LEVELS - 1).bit_length())
        level = size >> self.shift
        at = np.flatnonzero(level)
        key = (at // max(1, n)) * (2 * LEVELS) + (2 * LEVELS - 1 - level[at])  # dimensions ascend, levels descend
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        # A posting: which component of which vector, and its impact with the sign.
        self.cells = at % max(1, n) * dims + at // max(1, n)
        self.impacts = np.sign(vectors.T.reshape(-1)[at]) * (level[at] << self.shift)
        self.starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.counts = np.diff(np.append(self.starts, len(key)))
        self.dim, self.level = key[self.starts] // (2 * LEVELS), 2 * LEVELS - 1 - key[self.starts] % (2 * LEVELS)
        # Largest component that is left in a dimension: before anything is read, and after each segment.
        slack = (1 << self.shift) - 1
        top = (self.level << self.shift) + slack
        last = np.append(self.dim[1:] != self.dim[:-1], True) if len(key) else np.zeros(0, bool)
        self.after = np.where(last, slack, np.append(top[1:], 0)) if len(key) else top
        self.most = np.full(dims, slack, np.int64)
        np.maximum.at(self.most, self.dim, top)
        self.read = self.postings = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, thresholds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best for each of a chunk of queries; of those that reach its threshold, if that is one."""
        n, dims = self.vectors.shape
        size = np.abs(queries)
        found: list[tuple[np.ndarray, np.ndarray]] = [(self.ids[:0], self.ids[:0])] * len(queries)
        order = np.argsort(-(size.mean(0)[self.dim] * self.level), kind="stable")
        done = np.cumsum(self.counts[order])
        total = int(done[-1]) if len(done) else 0
        whole = int(size.sum(1).max(initial=0)) * int(self.most.max(initial=0))
        kind = np.float32 if whole < 2**23 else np.float64 if whole < 2**52 else np.int64
        weights, left = queries.astype(kind), self.most.copy()
        sums = np.zeros((n, len(queries)), kind)
        alive, begin = np.arange(len(queries)), 0
        self.postings += total * len(queries)
        for share in LOOKS:
            end = min(len(order), int(np.searchsorted(done, share * total)) + 1)
            if begin < end:
                # The postings of the next segments, each added to the accumulators of all queries by one product.
                own_segments = np.sort(order[begin:end])
                at = np.repeat(self.starts[own_segments] - np.cumsum(self.counts[own_segments]) + self.counts[own_segments], self.counts[own_segments])
                at += np.arange(len(at))
                taken = np.zeros(n * dims, kind)
                taken[self.cells[at]] = self.impacts[at]
                sums += taken.reshape(n, dims) @ weights[alive].T
                np.minimum.at(left, self.dim[own_segments], self.after[own_segments])
                begin = end
            read = int(done[begin - 1]) if begin else 0
            rest = size[alive] @ left
            stopped, columns = np.zeros(len(alive), bool), np.ascontiguousarray(sums.T)
            for row, q in enumerate(alive.tolist()):
                own_sums = columns[row]
                other = self.ids != own[q]
                rivals = own_sums[other]
                bound = thresholds[q]
                if len(rivals) <= k:
                    members = np.flatnonzero(other)
                else:
                    if bound == NONE:
                        bound = np.partition(rivals, len(rivals) - k)[len(rivals) - k] - rest[row]
                    members = np.flatnonzero(other & (own_sums >= bound - rest[row]))
                if len(rivals) <= k or begin == len(order) or len(members) * dims <= total - read:
                    scores = self.vectors[members] @ queries[q]
                    best = np.lexsort((self.ids[members], -scores))[:k]
                    found[q], stopped[row] = (self.ids[members][best], scores[best]), True
            self.read += read * int(stopped.sum())
            alive, sums = alive[~stopped], sums[:, ~stopped]
            if not len(alive):
                break
        return found


#: Threshold of a query that has fewer than k scores so far.
NONE = np.iinfo(np.int64).min


def alike(queries: np.ndarray) -> np.ndarray:
    """An order in which queries with the same largest components are neighbours."""
    largest = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :3]
    signs = np.take_along_axis(queries, largest, 1) < 0
    return np.lexsort((largest * 2 + signs).T[::-1]) if largest.size else np.arange(len(queries))


def searched(blocks: list[Index], queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best of several blocks, for each query."""
    empty = np.zeros(0, np.int64)
    found = [(empty, empty)] * len(queries)
    order = alike(queries)
    for at in range(0, len(order), CHUNK):
        chunk = order[at : at + CHUNK]
        for block in blocks:
            width = block.vectors.shape[1]
            # Components that one side lacks are 0.
            part = np.pad(queries[chunk], ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
            known = np.array([found[q][1][k - 1] if len(found[q][1]) == k else NONE for q in chunk.tolist()], np.int64)
            for q, (ids, scores) in zip(chunk.tolist(), block.search(part, own[chunk], k, known), strict=True):
                ids, scores = np.concatenate([found[q][0], ids]), np.concatenate([found[q][1], scores])
                best = np.lexsort((ids, -scores))[:k]
                found[q] = ids[best], scores[best]
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, block_rows: int = 4096, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for every row of ``queries`` against every row of ``vectors``."""
    spark = vectors.sparkSession
    space = Workspace(spark, "topk")

    def whole(rows: DataFrame) -> tuple[DataFrame, int]:
        out = rows.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null")
        return out, out.count()

    rows, n = whole(vectors)
    asked, n_asked = whole(queries)
    # As many groups as keep all cores busy, or more where a group would be too large for a task.
    groups = max(1, -(-n // (block_rows * GROUP)), min(spark.sparkContext.defaultParallelism, -(-n // 512)))
    index = space.table(pack(rows.repartition(groups), block_rows).select(F.shiftright("block", 32).cast("int").alias("no"), F.lit(0).alias("side"), "block", "ids", "dims", "data"), "index")
    sent = space.table(pack(asked.repartition(max(1, -(-n_asked // query_rows))), query_rows), "queries")
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("no"), F.lit(1).alias("side"), "block", "ids", "dims", "data")
    # A group's own blocks come first, then the queries, one row each.
    met = index.unionByName(sent).repartitionById(groups, "no").sortWithinPartitions("no", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blocks = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                no, side, block, ids, dims, data = (c[row].as_py() for c in batch.columns)
                if no != last:
                    last, blocks = no, []
                own, values = unpack(ids, dims, data)
                if not side:
                    blocks.append(Index(own, values))
                    continue
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for i, (found, scores) in enumerate(searched(blocks, values, own, k)):
                    for into, x in zip(out, (np.full(len(found), own[i]), np.full(len(found), block), np.full(len(found), i), found, scores), strict=True):
                        into.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "query_block", "query_row", "id", "score"])

    found = met.mapInArrow(run, "query_id long, query_block long, query_row long, id long, score long")
    best = Window.partitionBy("query_id", "query_block", "query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
