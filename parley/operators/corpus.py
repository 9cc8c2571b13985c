"""Selections and views of utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X


def renumbered(utterances: DataFrame) -> DataFrame:
    """``pos`` counted anew within each document."""
    return utterances.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long"))


def parse_speakers(utterances: DataFrame, speakers: list[str]) -> tuple[DataFrame, DataFrame]:
    """The utterances of the named speakers and those of all others, each renumbered. Names are compared exactly."""
    named = F.coalesce(F.col("speaker").isin(*speakers), F.lit(False)) if speakers else F.lit(False)
    return renumbered(utterances.filter(named)), renumbered(utterances.filter(~named))


def chosen_speakers(utterances: DataFrame, speakers: list[str] | None, use_main: bool) -> DataFrame:
    if not speakers:
        return utterances
    main, others = parse_speakers(utterances, speakers)
    return main if use_main else others


def document(utterances: DataFrame, doc_id: int) -> DataFrame:
    return utterances.filter(F.col("doc_id") == doc_id)


def concat_documents(utterances: DataFrame, column: str = "tokenized", joiner: str = " ") -> DataFrame:
    """(doc_id, text): a document's utterances in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("x"))))
    return utterances.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), joiner).alias("text"))


def tokens_without_stopwords(utterances: DataFrame, stop: list[str] = X.STOP_BASE) -> DataFrame:
    """(doc_id, pos, tok), repeats kept."""
    return utterances.select("doc_id", "pos", F.explode(X.without(X.tokens(F.col("tokenized")), stop)).alias("tok"))


def described(utterances: DataFrame) -> DataFrame:
    """(doc_id, n, described): each document's size in print."""
    return utterances.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("described", F.format_string("Document of %d utterances", "n"))


def described_corpus(utterances: DataFrame) -> DataFrame:
    return utterances.agg(F.count_distinct("doc_id").alias("n")).select("n", F.format_string("Corpus of %d transcripts", "n").alias("described"))
