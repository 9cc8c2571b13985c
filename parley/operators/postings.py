"""A saved index of terms in compressed blocks, which grows by batches.

A term's postings (document, position) are cut into blocks of at most ``BLOCK``, and a block is a row: the term, the first and last document, and the
differences of documents from one posting to the next, which are small numbers, with the positions. Blocks of a batch are written sorted by
term and first document, so a look-up reads the row groups that can hold the term, and of these its blocks; with a range of documents it
skips blocks by their first and last. A batch adds files and changes none; ``merge`` makes new blocks of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X

#: Postings of a block at most, as a power of two.
BLOCK_BITS = 7


def postings(utterances: DataFrame) -> DataFrame:
    """(term, doc_id, pos): words of two letters or more and pairs of neighbouring ones, once per utterance."""
    terms = X.unigrams_and_bigrams(X.long_tokens(F.col("tokenized")))
    return utterances.select("doc_id", "pos", F.explode(F.array_distinct(terms)).alias("term"))


def packed(found: DataFrame) -> DataFrame:
    """(term, first_doc, last_doc, n, gaps, positions) of postings (term, doc_id, pos).

    Postings are dealt by ranges and sorted, so a frequent term is cut over tasks, and blocks are runs of their numbers in a task.
    """
    order = ["term", "doc_id", "pos"]
    numbered = found.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    blocks = numbered.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "pos"))).alias("p"))
    gap: Column = F.transform("p", lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(x["doc_id"] - F.get("p", i - 1)["doc_id"]))
    return blocks.select("term", F.get("p", F.lit(0))["doc_id"].alias("first_doc"), F.element_at("p", -1)["doc_id"].alias("last_doc"), F.size("p").alias("n"), gap.alias("gaps"), F.transform("p", lambda x: x["pos"]).alias("positions"))


def unpacked(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, pos) of blocks."""
    first = F.struct(F.col("first_doc").alias("at"), F.array().cast("array<bigint>").alias("docs"))
    step = lambda acc, g: F.struct((acc["at"] + g).alias("at"), F.array_append(acc["docs"], acc["at"] + g).alias("docs"))
    docs = F.aggregate("gaps", first, step, lambda acc: acc["docs"])
    both = F.arrays_zip(docs.alias("doc_id"), F.col("positions").alias("pos"))
    return blocks.select("term", F.explode(both).alias("x")).select("term", "x.doc_id", "x.pos")


class PostingIndex:
    """Blocks under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, blocks: DataFrame, mode: str) -> None:
        blocks.repartitionByRange("term", "first_doc").sortWithinPartitions("term", "first_doc").write.mode(mode).parquet(self.path)

    def add(self, utterances: DataFrame) -> None:
        """Utterances that are not in the index yet."""
        self._write(packed(postings(utterances)), "append")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def merge(self, path: str) -> PostingIndex:
        """The same postings in full blocks, as an index at another path."""
        new = PostingIndex(self.spark, path)
        new._write(packed(unpacked(self.blocks())), "error")
        return new

    def find(self, term: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
        """(doc_id, pos) of a word or pair of words, of all documents or of a range of them."""
        wanted = self.blocks().filter(F.col("term") == X.clean_term(F.lit(term)))
        if first_doc is not None:
            wanted = wanted.filter(F.col("last_doc") >= first_doc)
        if last_doc is not None:
            wanted = wanted.filter(F.col("first_doc") <= last_doc)
        hits = unpacked(wanted).select("doc_id", "pos")
        if first_doc is not None:
            hits = hits.filter(F.col("doc_id") >= first_doc)
        return hits if last_doc is None else hits.filter(F.col("doc_id") <= last_doc)
