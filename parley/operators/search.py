"""Look-up of a word or a pair of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as X


class Search:
    """An inverted index of the words (two letters or more) and pairs of neighbouring ones of every utterance.

    ``save`` writes it bucketed and sorted by term, for reuse by many searches.
    """

    def __init__(self, utterances: DataFrame):
        self.utterances, self.terms = utterances, X.unigrams_and_bigrams(X.long_tokens(F.col("tokenized")))
        self.index = utterances.select("doc_id", "pos", F.explode(F.array_distinct(self.terms)).alias("term"))
        self.saved = False

    def save(self, table: str, buckets: int = 64) -> None:
        self.index.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)
        self.index, self.saved = self.index.sparkSession.table(table), True

    def find_occurrences(self, term: str) -> DataFrame:
        """(doc_id, file, pos, text) of the utterances with the term; none if it is unknown."""
        wanted = X.clean_term(F.lit(term))
        if not self.saved:  # one look at every utterance costs less than an index that is used once
            return self.utterances.filter(F.array_contains(self.terms, wanted)).select("doc_id", "file", "pos", "text")
        hits = self.index.filter(F.col("term") == wanted).select("doc_id", "pos")
        return self.utterances.join(hits, ["doc_id", "pos"], "left_semi").select("doc_id", "file", "pos", "text")

    __call__ = find_occurrences

    def grouped(self, term: str) -> DataFrame:
        """(file, n, lines): a file's hits in order, joined by line ends."""
        rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
        return self.find_occurrences(term).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("lines"))
