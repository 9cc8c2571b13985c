"""Term vectors in long form: a row per unit and term. Vocabulary is rows, never columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.corpus import concat_documents


def term_counts(units: DataFrame, keys: list[str], toks: Column) -> DataFrame:
    """(keys, term, tf)."""
    return units.select(*keys, F.explode(toks).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by,] term, df) from rows that are one per unit and term."""
    return counts.groupBy(*(by or []), "term").agg(F.count(F.lit(1)).alias("df"))


def number_of(units: DataFrame) -> Column:
    """The number of all rows, empty ones included, as a scalar subquery."""
    return units.agg(F.count(F.lit(1))).scalar()


def idf(df: DataFrame, n: Column, smooth: bool = True) -> DataFrame:
    """Plus ``idf``: ln((1+n)/(1+df)) + 1, or ln(n/df) + 1 if not ``smooth``."""
    value = F.log((n + 1) / (F.col("df") + 1)) + 1 if smooth else F.log(n / F.col("df")) + 1
    return df.withColumn("idf", value)


def weighted(counts: DataFrame, idfs: DataFrame, keys: list[str], on: list[str], sublinear: bool = False) -> DataFrame:
    """(keys, term, w): tf times idf, scaled to length 1 per unit."""
    tf = F.log(F.col("tf")) + 1 if sublinear else F.col("tf")
    raw = counts.join(idfs.select(*on, "idf"), on).select(*keys, "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.withColumn("w", F.col("w") / norm)


def utterance_vectors(utterances: DataFrame) -> DataFrame:
    """(doc_id, pos, term, w) over all utterances of the corpus, stop words left out."""
    keys = ["doc_id", "pos"]
    counts = term_counts(utterances, keys, X.without(X.tokens(F.col("tokenized")), X.STOP_BASE))
    return weighted(counts, utterance_idf(utterances), keys, ["term"])


def utterance_idf(utterances: DataFrame) -> DataFrame:
    """(term, df, idf). An utterance is one row, so its different words need no grouping before they are counted."""
    words = utterances.select(F.explode(F.array_distinct(X.without(X.tokens(F.col("tokenized")), X.STOP_BASE))).alias("term"))
    return idf(document_frequency(words), number_of(utterances))


def within_document_vectors(utterances: DataFrame, pattern: str = X.TOKEN) -> DataFrame:
    """(doc_id, pos, term, tf, idf, w): idf among the utterances of each document, all words kept."""
    keys = ["doc_id", "pos"]
    counts = term_counts(utterances, keys, X.tokens(F.col("tokenized"), pattern))
    sizes = utterances.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    df = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "term"))
    rows = counts.withColumn("df", df).join(sizes, "doc_id").withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return rows.select(*keys, "term", "tf", "idf", (F.col("raw") / norm).alias("w"))


def keyword_vectors(utterances: DataFrame, low: float = 0.10, high: float = 0.80) -> DataFrame:
    """(doc_id, term, w): whole documents, terms of a tenth to eight tenths of them, sublinear tf, unsmoothed idf."""
    docs = concat_documents(utterances)
    counts = term_counts(docs, ["doc_id"], X.without(X.long_tokens(F.col("text")), X.STOP_KEYWORDS))
    n = number_of(docs)
    idfs = idf(document_frequency(counts).filter(F.col("df").between(n * low, n * high)), n, smooth=False)
    return weighted(counts, idfs, ["doc_id"], ["term"], sublinear=True)


def cluster_vectors(utterances: DataFrame, low: float = 0.02, high: float = 0.50, max_features: int = 200_000) -> DataFrame:
    """(doc_id, term, w): words and pairs of whole documents; of the terms within bounds the most frequent ``max_features``."""
    docs = concat_documents(utterances, joiner=" . ")
    counts = term_counts(docs, ["doc_id"], X.unigrams_and_bigrams(X.without(X.long_tokens(F.col("text")), X.STOP_CLUSTER)))
    n = number_of(docs)
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df").between(n * low, n * high))
    terms = terms.orderBy(F.desc("total"), "term").limit(max_features).drop("total")
    return weighted(counts, idf(terms, n), ["doc_id"], ["term"])
