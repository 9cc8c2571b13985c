"""Topic segmentation by lexical cohesion, and a sentence for each segment.

A document's words are cut into pseudo-sentences of ``w`` words. Between any two lies a gap; its score is the cosine of the word counts in
up to ``k`` pseudo-sentences on either side. Deep valleys of the smoothed scores are boundaries, moved to the nearest paragraph break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.corpus import concat_documents
from parley.operators.sentences import Learned, learn, split
from parley.plans.asof import around
from parley.plans.settle import settled

# What joins utterances, how many gaps lie between boundaries and characters between paragraph breaks at least, and what a
# paragraph break is.
SEPARATOR = "\n\n\t "
APART = 4
PARAGRAPH = 100
BREAK = r"[ \t\r\f\x0B]*\n[ \t\r\f\x0B]*\n[ \t\r\f\x0B]*"
#: Put before a break for a moment; it stands for no character of a text.
_MARK = "\x1e"


@dataclass(frozen=True)
class Tiling:
    w: int = 100
    k: int = 40
    stop: tuple[str, ...] = tuple(X.STOP_BASE)
    lowercase: bool = False
    smoothing: int = 2


def joined(utterances: DataFrame) -> DataFrame:
    """(doc_id, text) with the utterances as paragraphs."""
    return concat_documents(utterances, "text", SEPARATOR)


#: Cells of a table of word counts that a task holds at once.
CELLS = 1 << 22


def block_scores(words: np.ndarray, n_tokens: int, at: np.ndarray, t: Tiling) -> np.ndarray:
    """Scores of a document's gaps. ``words``: numbers of its words without the stop list; ``at``: their places among all ``n_tokens``.

    Counts in blocks are differences of prefix sums over the pseudo-sentences; words are taken some at a time.
    """
    n = -(-n_tokens // t.w)
    gaps = max(0, n - 1)
    g = np.arange(gaps)
    size = np.where(g < t.k - 1, g + 1, np.where(g > gaps - t.k, gaps - g, t.k))
    sums = np.zeros((3, gaps))
    names, own = np.unique(words, return_inverse=True)
    order = np.argsort(own, kind="stable")
    own, seq = own[order], at[order] // t.w
    step = max(1, CELLS // (n + 1))
    for first in range(0, len(names) if gaps else 0, step):
        b, e = np.searchsorted(own, [first, first + step])
        counts = np.zeros((min(step, len(names) - first), n + 1))
        np.add.at(counts, (own[b:e] - first, seq[b:e] + 1), 1)
        before = counts.cumsum(1)
        left, right = before[:, g + 1] - before[:, g - size + 1], before[:, np.minimum(g + size + 1, n)] - before[:, g + 1]
        sums += np.stack([(left * right).sum(0), (left * left).sum(0), (right * right).sum(0)])
    return np.divide(sums[0], np.sqrt(sums[1] * sums[2]), out=np.zeros(gaps), where=(sums[1] > 0) & (sums[2] > 0))


def gap_scores(docs: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    """(doc_id, gap, gaps, score). Documents of one pseudo-sentence have no gap.

    A document's words are numbered by the column they come in, so there is no row per word and gap.
    """
    toks = docs.select("doc_id", X.raw_tokens(F.lower("text") if t.lowercase else F.col("text")).alias("toks"))
    stop = pa.array(t.stop, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            numbers, kept = np.asarray(coded.indices), ~np.asarray(pc.is_in(coded.dictionary, stop))
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            out = []
            for doc, b, e in zip(batch.column(0).to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
                own = numbers[b:e]
                at = np.flatnonzero(kept[own]) if len(own) else own
                scores = block_scores(own[at], len(own), at, t)
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), doc), pa.int64()), pa.array(np.arange(len(scores)), pa.int64()), pa.array(np.full(len(scores), len(scores)), pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "gap", "gaps", "score"]))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []

    return toks.mapInArrow(run, "doc_id long, gap long, gaps long, score double")


def smoothed(scores: DataFrame, smoothing: int = 2) -> DataFrame:
    """(doc_id, gap, gaps, score): means of ``smoothing`` + 1 neighbours. At the ends the series goes on reflected through its end points.

    Series shorter than the window have none; one as long as it loses a score; a window of fewer than three leaves all as they are.
    """
    if smoothing < 2:
        return scores
    width = smoothing + 1
    rows = scores.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gap", "score"))).alias("r")).select("doc_id", F.transform("r", lambda r: r["score"]).alias("x"))
    rows = rows.filter(F.size("x") >= width).withColumn("n", F.size("x"))
    x, n = F.col("x"), F.col("n")
    reflected = F.least(F.lit(width), n - 1) - 1
    rows = rows.withColumn("gaps", n + reflected - (width - 1))

    def mean(i: Column) -> Column:
        """Of the window from place ``first`` of the series on: place t < 0 stands for 2 x[0] - x[1 - t], and t >= n for 2 x[n - 1] - x[2 n - 1 - t].

        Each score is taken once, times how often it counts, so that the rounding depends on nothing but the series.
        """
        first = i + (width - 1) // 2 - reflected
        last = first + width - 1

        def add(acc: Column, j: Column) -> Column:
            once = lambda c: c.cast("int")
            times = once(j.between(first, last)) - once((1 - j).between(first, F.lit(-1))) - once((2 * n - 1 - j).between(n, last))
            ends = once(j == 0) * F.greatest(-first, F.lit(0)) + once(j == n - 1) * F.greatest(last - n + 1, F.lit(0))
            return acc + (times + 2 * ends) * x[j]

        lowest, highest = F.greatest(F.least(first, 2 * n - 1 - last), F.lit(0)), F.least(F.greatest(last, 1 - first), n - 1)
        return F.aggregate(F.sequence(lowest, highest), F.lit(0.0), add) / width

    means = F.transform(F.sequence(F.lit(0), F.col("gaps") - 1), mean)
    out = rows.select("doc_id", F.col("gaps").cast("long").alias("gaps"), F.posexplode(means).alias("gap", "score"))
    return out.select("doc_id", F.col("gap").cast("long").alias("gap"), "gaps", "score")


def depths(scores: DataFrame) -> DataFrame:
    """(doc_id, gap, gaps, score, depth): how far the scores rise on both sides before they fall; 0 near the ends."""
    w = Window.partitionBy("doc_id").orderBy("gap")
    s, prev, nxt = F.col("score"), F.lag("score").over(w), F.lead("score").over(w)
    # Going left, scores rise as long as they do not fall going right: a run begins where the score is above the one before.
    starts = F.when(prev.isNull() | (s > prev), s)
    ends = F.when(nxt.isNull() | (s > nxt), s)
    marked = scores.withColumn("_start", starts).withColumn("_end", ends)
    left = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_end", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    clip = F.least(F.greatest(F.col("gaps") / 10, F.lit(2.0)), F.lit(5.0)).cast("int")
    inside = (F.col("gap") >= clip) & (F.col("gap") < F.col("gaps") - clip)
    return marked.withColumn("depth", F.when(inside, left + right - 2 * s).otherwise(F.lit(0.0))).drop("_start", "_end")


def candidates(deep: DataFrame) -> DataFrame:
    """(doc_id, gap, gaps, depth, cutoff): depths above the mean less half the standard deviation.

    Of five depths only the third can be more than 0, and then the cutoff is 0 but for the rounding, which decides whether the others pass. So
    both are folded in the order of the gaps, the deviation by Welford's recurrence, and come out the same however rows are dealt.
    """
    rows = deep.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gap", "gaps", "depth"))).alias("r"))
    first = F.struct(*(F.lit(0.0).alias(x) for x in ("n", "total", "mean", "squares")))

    def add(acc: Column, x: Column) -> Column:
        n, apart = acc["n"] + 1, x - acc["mean"]
        mean = acc["mean"] + apart / n
        return F.struct(n.alias("n"), (acc["total"] + x).alias("total"), mean.alias("mean"), (acc["squares"] + (x - mean) * apart).alias("squares"))

    cutoff = F.aggregate(F.transform("r", lambda r: r["depth"]), first, add, lambda acc: acc["total"] / acc["n"] - F.sqrt(acc["squares"] / acc["n"]) / 2)
    every = rows.select("doc_id", cutoff.alias("cutoff"), F.explode("r").alias("r"))
    return every.select("doc_id", "r.*", "cutoff").filter(F.col("depth") > F.col("cutoff")).select("doc_id", "gap", "gaps", "depth", "cutoff")


def flagged(deep: DataFrame) -> DataFrame:
    """(doc_id, gaps, taken): candidates by descending depth and gap, as long as none that was taken is too near."""
    rows = candidates(deep).groupBy("doc_id").agg(F.max("gaps").alias("gaps"), F.sort_array(F.collect_list(F.struct(F.round("depth", 12).alias("depth"), "gap")), asc=False).alias("c"))
    empty = F.array().cast("array<bigint>")
    taken = F.aggregate("c", empty, lambda acc, e: F.when(F.exists(acc, lambda y: F.abs(y - e["gap"]) < APART), acc).otherwise(F.array_append(acc, e["gap"])))
    return rows.select("doc_id", "gaps", taken.alias("taken"))


def boundaries(deep: DataFrame) -> DataFrame:
    """(doc_id, gap)."""
    return flagged(deep).select("doc_id", F.explode("taken").alias("gap"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, at): the document's beginning, and its paragraph breaks that are far enough behind the one before."""
    sizes = F.transform(F.split(F.regexp_replace("text", f"({BREAK})", f"{_MARK}$1"), _MARK, -1), lambda x: F.length(x).cast("long"))
    # All pieces but the last end where a break begins.
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.lit(0).cast("long")).alias("taken"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.when(acc["at"] + x - F.element_at(acc["taken"], -1) >= PARAGRAPH, F.array_append(acc["taken"], acc["at"] + x)).otherwise(acc["taken"]).alias("taken"))
    folded = F.aggregate(F.slice("sizes", F.lit(1), F.size("sizes") - 1), first, step)
    return docs.select("doc_id", sizes.alias("sizes")).select("doc_id", F.explode(folded["taken"]).alias("at"))


def gap_places(docs: DataFrame, found: DataFrame, w: int) -> DataFrame:
    """(doc_id, gap, at, n_chars): where the boundaries of ``found`` (doc_id, taken) lie in the text.

    Gap g lies at the blank after word number max(g, 1) * w + 1, words being runs between blanks; two gaps never at the same character.
    """
    rows = docs.join(found.select("doc_id", "taken"), "doc_id").select("doc_id", "taken", F.length("text").alias("n_chars"), F.regexp_extract_all("text", F.lit("[ \\t\\n]*[^ \\t\\n]+"), F.lit(0)).alias("words"))
    # Characters of every w words, so that no boundary counts them again.
    whole = F.when(F.size("words") >= w, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("words") / w) - 1, F.lit(0)).cast("int")), lambda c: F.length(F.array_join(F.slice("words", c * w + 1, F.lit(w)), "")))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "n_chars", "words", whole.alias("chars"), F.explode("taken").alias("gap")).withColumn("turn", F.greatest("gap", F.lit(1)).cast("int"))
    rows = rows.filter(F.col("turn") * w < F.size("words"))
    end = F.aggregate(F.slice("chars", F.lit(1), F.col("turn")), F.lit(0), lambda acc, x: acc + x) + F.length(F.get("words", F.col("turn") * w))
    placed = rows.select("doc_id", "gap", "n_chars", end.alias("end")).filter("end < n_chars")
    return placed.select("doc_id", "gap", (F.col("end") + 1 + (F.col("gap") == 1).cast("int")).cast("long").alias("at"), F.col("n_chars").cast("long").alias("n_chars")).filter("at <= n_chars")


def snapped(docs: DataFrame, found: DataFrame, w: int) -> DataFrame:
    """(doc_id, gap, at, paragraph): each boundary and the paragraph break nearest to it, the earlier of two as near."""
    near = around(gap_places(docs, found, w), paragraphs(docs), ["doc_id"], "at")
    best = F.when(F.col("after") - F.col("at") < F.col("at") - F.col("before"), F.col("after")).otherwise(F.col("before"))
    return near.withColumn("paragraph", best).filter(F.abs(F.col("paragraph") - F.col("at")) < F.col("n_chars")).select("doc_id", "gap", "at", "paragraph")


def found_boundaries(docs: DataFrame, t: Tiling) -> DataFrame:
    return flagged(depths(smoothed(gap_scores(docs, t), t.smoothing)))


def segments(utterances: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    """(doc_id, seg, text). A document too short for a boundary is one segment."""
    docs = joined(utterances)
    cuts = snapped(docs, found_boundaries(docs, t), t.w).filter("paragraph > 0").groupBy("doc_id").agg(F.array_sort(F.collect_set("paragraph")).alias("cuts"))
    none, n = F.array().cast("array<bigint>"), F.length("text").cast("long")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", none), F.array(n))
    rows = docs.join(cuts, "doc_id", "left").withColumn("edges", edges)
    parts = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.substr("text", F.element_at("edges", i).cast("int") + 1, (F.element_at("edges", i + 1) - F.element_at("edges", i)).cast("int")))
    return rows.select("doc_id", F.posexplode(parts).alias("seg", "text")).select("doc_id", F.col("seg").cast("long").alias("seg"), X.segment_text(F.col("text")).alias("text"))


def plot_data(utterances: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    """(doc_id, gap, score, smooth, depth, boundary): what a chart of the segmentation shows."""
    scores = gap_scores(joined(utterances), t)
    smooth = smoothed(scores, t.smoothing)
    deep = depths(smooth)
    marks = boundaries(deep).withColumn("boundary", F.lit(1))
    shown = deep.select("doc_id", "gap", F.col("score").alias("smooth"), "depth").join(marks, ["doc_id", "gap"], "left")
    return scores.select("doc_id", "gap", "score").join(shown, ["doc_id", "gap"], "left").withColumn("boundary", F.coalesce("boundary", F.lit(0)))


def gain(text: Column, smoothing: float = 0.4) -> Column:
    """How a sentence ranks over all directions, among those of its segment; -1 without words.

    A word's weight is ``smoothing`` plus the rest's share of its count in the largest of the sentence, and ``smoothing`` for a word that the
    sentence lacks. Latent semantic analysis ranks by the square root of the sum, over the directions, of squared singular value times squared
    place; over all directions that is the length of the sentence's column of weights. Its square less what a column without counts
    would have is the same order, and no decomposition is needed.
    """
    # Sums over the words of (s + (1 - s) c / m)^2 - s^2 need the counts c only as their sum, their sum of squares and their maximum m,
    # and the sorted words give all three in one go: the square of a run grows by twice its length less one.
    none = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("squares"), F.lit(0).alias("most"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["word"] == word, acc["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), (acc["all"] + 1).alias("all"), (acc["squares"] + 2 * run - 1).alias("squares"), F.greatest(acc["most"], run).alias("most"))

    def rank(acc: Column) -> Column:
        return F.when(acc["most"] > 0, 2 * smoothing * (1 - smoothing) * acc["all"] / acc["most"] + (1 - smoothing) ** 2 * acc["squares"] / (acc["most"] * acc["most"])).otherwise(-1.0)

    return F.aggregate(F.array_sort(X.raw_tokens(F.lower(text))), none, step, rank)


def lsa_rank(sentences: list[str], topics: int, smoothing: float) -> np.ndarray:
    """Ranks by the leading directions only, from the decomposition."""
    at: dict[str, int] = {}
    counts = [[at.setdefault(w, len(at)) for w in re.findall(r"\w+", s.lower())] for s in sentences]
    matrix = np.zeros((max(1, len(at)), len(sentences)))
    for j, own in enumerate(counts):
        np.add.at(matrix[:, j], own, 1)
    top = matrix.max(0)
    matrix = np.where(top > 0, smoothing + (1 - smoothing) * matrix / np.where(top > 0, top, 1), 0)
    _, sigma, v = np.linalg.svd(matrix, full_matrices=False)
    return np.sqrt(((sigma[:topics, None] ** 2) * (v[:topics] ** 2)).sum(0))


def segment_sentences(segmented: DataFrame, learned: Learned | None = None) -> DataFrame:
    """(doc_id, seg, part, sent, begin, text): the sentences of each utterance (part) of a segment; nulls for an empty one."""
    parts = settled(segmented.select("doc_id", "seg", F.posexplode(F.split("text", " \\| ")).alias("part", "text")))
    return split(parts, learned or learn(parts), ("doc_id", "seg", "part"), empty=True)


def summaries(segmented: DataFrame, learned: Learned | None = None, topics: int | None = None, smoothing: float = 0.4) -> DataFrame:
    """(doc_id, seg, sentence): the sentence that ranks first by latent semantic analysis, the first of equals.

    Sentences are those of ``learned``, or of what the segments tell themselves. All directions count, or the leading ``topics``.
    """
    found = segment_sentences(segmented, learned)
    if topics is None:
        rows = found.withColumn("rank", F.coalesce(gain(F.col("text"), smoothing), F.lit(-2.0)))
    else:
        whole = found.groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(F.struct("part", "sent", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
        rank = F.pandas_udf(lambda lists: lists.map(lambda x: lsa_rank(list(x), topics, smoothing)), "array<double>")
        rows = whole.withColumn("r", rank(F.transform("s", lambda x: x["text"]))).select("doc_id", "seg", F.explode(F.arrays_zip("s", "r")).alias("x")).select("doc_id", "seg", "x.s.*", F.col("x.r").alias("rank"))
    return rows.groupBy("doc_id", "seg").agg(F.coalesce(F.min_by("text", F.struct(-F.round("rank", 9), "part", "sent")), F.lit("")).alias("sentence"))
