"""Counts, percentiles, speakers and named entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.plans.numbering import ranked as numbered


def count_docs(utterances: DataFrame) -> DataFrame:
    return utterances.agg(F.count_distinct("doc_id").alias("n_docs"))


def doc_words(utterances: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_distinct), case kept; documents without words too."""
    return utterances.select("doc_id", F.explode_outer(X.words(F.col("text"))).alias("w")).groupBy("doc_id").agg(F.count("w").alias("n_words"), F.count_distinct("w").alias("n_distinct"))


def corpus_words(utterances: DataFrame) -> DataFrame:
    """Distinct words are counted after a grouping by word, so no task holds the vocabulary."""
    per_word = utterances.select(F.explode(X.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return per_word.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def doc_lines(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def corpus_lines(utterances: DataFrame) -> DataFrame:
    return utterances.agg(F.count(F.lit(1)).alias("n_lines"))


def utterance_percentiles(utterances: DataFrame, percentiles: tuple[float, ...] = (25, 50, 75, 95, 100)) -> DataFrame:
    """(pct, value) of the number of words, by linear interpolation. Exact: lengths are few, so each is weighted by its count."""
    lengths = utterances.select(F.size(X.words(F.col("text"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("weight"))
    shares = F.array(*(F.lit(p / 100) for p in percentiles))
    whole = lengths.agg(F.percentile("n", shares, F.col("weight")).alias("v"))
    named = F.arrays_zip(F.array(*(F.lit(float(p)) for p in percentiles)).alias("pct"), F.col("v").alias("value"))
    return whole.select(F.explode(named).alias("x")).select(F.col("x.pct").alias("pct"), F.col("x.value").alias("value"))


def doc_speakers(utterances: DataFrame, ranked: bool = False) -> DataFrame:
    """(doc_id, speaker, n_utterances); ``ranked`` adds the rank by number, then first appearance."""
    counts = utterances.groupBy("doc_id", "speaker").agg(F.count(F.lit(1)).alias("n_utterances"), F.min("pos").alias("first"))
    if not ranked:
        return counts.drop("first")
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_utterances"), "first"))).drop("first")


def corpus_speakers(utterances: DataFrame, ranked: bool = False, top: int | None = None) -> DataFrame:
    """(speaker, n_utterances); ``ranked`` adds the rank by number, then first appearance."""
    if not ranked:
        return utterances.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_utterances"))
    counts = utterances.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_utterances"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return most_common(counts, "n_utterances", "first", top).drop("first")


def most_common(counts: DataFrame, n: str, first: str, top: int | None = None) -> DataFrame:
    """``counts`` with their rank by ``n``, ties by what comes ``first``; all of them, or the ``top``."""
    if top is None:
        return numbered(counts.withColumn("_less", -F.col(n)), "_less", first).drop("_less")
    best = counts.orderBy(F.desc(n), first).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(n), first)).cast("long"))


def speaker_total(utterances: DataFrame, names: list[str]) -> DataFrame:
    """Utterances of the named speakers."""
    return corpus_speakers(utterances).filter(F.col("speaker").isin(*names)).agg(F.coalesce(F.sum("n_utterances"), F.lit(0)).alias("n_utterances"))


#: A recogniser takes texts and gives each one's entities.
Recogniser = Callable[[pd.Series], pd.Series]


def entity_mentions(utterances: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(doc_id, pos, at, entity), ``at`` counting an utterance's entities. Without a recogniser runs of capitalised words are taken, an approximation."""
    found: Column = X.entities(F.col("text"))
    if recogniser:
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield recogniser(texts)

        found = F.pandas_udf(run, "array<string>")("text")
    return utterances.select("doc_id", "pos", F.posexplode(found).alias("at", "entity"))


def entity_counts(utterances: DataFrame, per_document: bool = False, recogniser: Recogniser | None = None, ranked: bool = False, top: int | None = None) -> DataFrame:
    """([doc_id,] entity, n); ``ranked``, over all documents, adds the rank by number, then first appearance."""
    keys = ["doc_id", "entity"] if per_document else ["entity"]
    mentions = entity_mentions(utterances, recogniser).groupBy(*keys)
    if not ranked:
        return mentions.agg(F.count(F.lit(1)).alias("n"))
    return most_common(mentions.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos", "at")).alias("first")), "n", "first", top).drop("first")


def entity_keywords(utterances: DataFrame, min_count: int = 5, top: int = 75, recogniser: Recogniser | None = None) -> DataFrame:
    """(term): of the ``top`` entities those with ``min_count`` mentions whose lower-case form is no stop word."""
    best = entity_counts(utterances, recogniser=recogniser).orderBy(F.desc("n"), "entity").limit(top)
    return best.filter(F.col("n") >= min_count).select(F.lower("entity").alias("term")).filter(~F.col("term").isin(*X.STOP_KEYWORDS)).distinct()
