"""Cleaning and search are stateless; counts by speaker and document are incremental aggregates, bounded by their keys.

Statistics over the whole corpus (document frequencies and what builds on them) belong into batches, for instance by ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.sources.transcripts import speaker_and_text


def stream_lines(spark: SparkSession, directory: str) -> DataFrame:
    """(file, speaker, text, tokenized) of transcript files as they arrive."""
    lines = spark.readStream.format("text").load(directory).select(F.col("_metadata.file_path").alias("file"), "value")
    speaker, text = speaker_and_text(F.col("value"))
    return lines.select("file", speaker.alias("speaker"), text.alias("text")).withColumn("tokenized", X.strip(X.clean(F.col("text"))))


def running_speakers(lines: DataFrame) -> DataFrame:
    return lines.groupBy("speaker").agg(F.count(F.lit(1)).alias("n_utterances"))


def running_words(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.sum(F.size(X.words(F.col("text")))).alias("n_words"), F.count(F.lit(1)).alias("n_lines"))


def stream_search(lines: DataFrame, term: str) -> DataFrame:
    """Utterances with a word or a pair of words."""
    terms = X.unigrams_and_bigrams(X.long_tokens(F.col("tokenized")))
    return lines.filter(F.array_contains(terms, X.clean_term(F.lit(term)))).select("file", "speaker", "text")
