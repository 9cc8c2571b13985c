"""Line dedup: levelled sorted runs of line hashes, compacted periodically; each new batch merge-anti-joins the runs and adds its own.

DataFrame operations only. A line's key is the line without the whitespace ``[\\x20\\x09-\\x0D]`` at either end and with A-Z
lower-cased; its hash is MD5 of that key. A text that is null or empty is one empty line, and lines with an empty key always stay.

The runs are tables (hash, n) in the shared folder, dealt into buckets by the hash and sorted by it within a bucket, which Spark knows of: a
merge join with a run moves and sorts no row of the run. A run holds for each hash the number of documents of its batches
that have the line, in two parts: a hash is settled once a run counts ``min_docs`` documents, open before that. A new batch is
merge-anti-joined with the settled part of every run, the newest included, as settled hashes need no further counting; what is left is
added as a run of level 0. Level i holds fewer than ``fanout`` runs; ``fanout`` of them are merged into one of level
i + 1, by an aggregation that moves each of their rows once. So the runs that a batch meets grow with the logarithm of the number of batches.

A batch holds about ``bucket_rows`` hashes per bucket, whatever the files are like, and a quarter of the table at most. So the number of batches
grows with the table, and with it neither the memory of a task nor the size of a new run.

Defined results: a row is a document, so a repeated row counts again; rows that share an id are counted apart; a null id is an id like
any other; ties do not arise; an empty table gives an empty table; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import Workspace, attach, free_name, others, sorted_buckets, spread_left

TRIMMED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(TRIMMED))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hash(line: Column, min_chars: int = 1) -> Column:
    """Null where the key has fewer than ``min_chars`` code points."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The state that is kept between batches. ``met`` tells how many runs each batch was joined with."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, buckets: int | None = None):
        self.spark, self.space, self.min_docs, self.fanout = spark, Workspace(spark, "line-runs"), min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.met: list[int] = []
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"level{level}_run{self.made}"
        self.made += 1
        run = counts.select("hash", "n", (F.col("n") >= self.min_docs).alias("settled"))
        with sorted_buckets(self.spark):
            self.levels[level].append((name, self.space.bucketed(run, name, "hash", self.buckets, by="settled")))

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row (hash) for each different line of each of its documents."""
        counts = batch.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        runs = self.runs()
        for run in runs:
            counts = counts.join(run.filter("settled").select("hash").hint("merge"), "hash", "left_anti")
        self.met.append(len(runs))
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged([run for _, run in old]), level + 1)
            for name, _ in old:
                self.space.drop(name)
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        whole = runs[0].select("hash", "n")
        for run in runs[1:]:
            whole = whole.unionAll(run.select("hash", "n"))
        return whole.groupBy("hash").agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame:
        """All runs merged: the hashes found in ``min_docs`` documents or more, with at least that many as ``n``."""
        with sorted_buckets(self.spark):
            return self.space.table(self._merged(self.runs()).filter(F.col("n") >= self.min_docs), "settled")


def batches_of(tasks: list[tuple[int, int, int]], rows: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of row numbers that hold about ``rows`` hashes, from what each task wrote (task, hashes, documents).

    Row numbers are those of ``monotonically_increasing_id``. A task that wrote more than ``rows`` is cut by its documents, small ones are put together.
    """
    out: list[tuple[int, int]] = []
    begin, held, last = None, 0, 0
    for task, hashes, docs in tasks:
        pieces = max(1, min(docs, -(-hashes // rows)))
        for k in range(pieces):
            first, last = (task << 33) + docs * k // pieces, (task << 33) + docs * (k + 1) // pieces - 1
            begin, held = (first if begin is None else begin), held + -(-hashes // pieces)
            if held >= rows:
                out.append((begin, last))
                begin, held = None, 0
    return out if begin is None else [*out, (begin, last)]


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, bucket_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", report: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` free of all lines whose key at least ``min_docs`` documents have, plus ``n_lines`` and ``n_dropped``
    (which replace columns of these names) if ``report``.

    The texts are hashed once into a table of hashes, numbered as written. Ranges of these numbers make the batches, which meet the runs in turn.
    Texts and their hits meet by a hash of id and text. Two documents with the same one would share their hits, all of which are frequent lines.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "line-dedup")
    hashes = F.array_distinct(F.array_compact(F.transform(lines_of(F.col(text_col)), lambda x: line_hash(x, min_chars))))
    unit = F.xxhash64(F.col(id_col), F.col(text_col))
    prints = space.table(docs.select(unit.alias("unit"), hashes.alias("hashes"), F.monotonically_increasing_id().alias("row")), "prints")
    rows = sorted(tuple(r) for r in prints.groupBy(F.shiftright("row", 33)).agg(F.sum(F.size("hashes")), F.count(F.lit(1))).collect())  # a row per task
    total = sum(n for _, n, _ in rows)
    runs = LineRuns(spark, min_docs)
    # Four batches at least, so that runs are met in tables of any size.
    for first, last in batches_of(rows, max(1, min(bucket_rows * runs.buckets, -(-total // 4)))):
        runs.add(prints.filter(F.col("row").between(first, last)).select(F.explode("hashes").alias("hash")))
    if not runs.runs():
        hits = prints.select("unit", F.col("hashes").alias("hits")).limit(0)
    else:
        # A settled n may miss rows of later batches, but their sum is within the total, which is what bounds the broadcast.
        hits = attach(prints.select("unit", F.explode("hashes").alias("hash")), runs.settled(), ["hash"], total).groupBy("unit").agg(F.collect_set("hash").alias("hits"))
    own, found = free_name(docs, "_unit"), free_name(docs, "_hits")
    hits = hits.select(F.col("unit").alias(own), F.col("hits").alias(found))
    joined = spread_left(docs.withColumn(own, unit), hits, own, prints.groupBy(F.col("unit").alias(own)).agg(F.count(F.lit(1)).alias("n")), sum(n for *_, n in rows), space)
    lines = lines_of(F.col(text_col))
    kept = F.when(F.col(found).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(found), line_hash(x, min_chars)), F.lit(False))))
    added = [F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped")] if report else []
    return joined.select(*(F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in others(docs, "n_lines", "n_dropped", drop=report)), *added)
