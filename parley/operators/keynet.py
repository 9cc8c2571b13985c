"""A network of keywords: how often they occur near each other, and which are central."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.corpus import chosen_speakers
from parley.operators.graph import centrality
from parley.operators.stats import entity_keywords
from parley.operators.vectors import keyword_vectors

KEYWORDS = 50
#: Keywords of a network at most.
MOST = 1000
#: The weights of all edges sum up to this.
TOTAL_WEIGHT = 400


def keywords(utterances: DataFrame, top: int = KEYWORDS, focus_doc: int | None = None, mean: bool = False) -> DataFrame:
    """(term, score): the best by tf-idf in the focus document (the first by default), or by the mean over all with ``mean``.

    Terms of other documents only score 0 and fill up by the alphabet.
    """
    vectors = keyword_vectors(utterances)
    if mean:
        scored = vectors.groupBy("term").agg(F.sum("w").alias("score"))
    else:
        first = F.lit(focus_doc) if focus_doc is not None else utterances.agg(F.min("doc_id")).scalar()
        scored = vectors.groupBy("term").agg(F.coalesce(F.sum(F.when(F.col("doc_id") == first, F.col("w"))), F.lit(0.0)).alias("score"))
    # A distributed top-k: no task sorts the vocabulary.
    return scored.orderBy(F.desc(F.round("score", 9)), "term").limit(top)


def occurrences(utterances: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, pos, term, n) of the keywords, words or pairs of words."""
    # Some dozens of keywords, found once and then part of the plan.
    names = [r["term"] for r in terms.select("term").limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} keywords")
    found = F.filter(X.unigrams_and_bigrams(X.long_tokens(F.col("tokenized"))), lambda t: t.isin(names))
    return utterances.select("doc_id", "pos", F.explode(found).alias("term")).groupBy("doc_id", "pos", "term").agg(F.count(F.lit(1)).alias("n"))


def cooccurrences(utterances: DataFrame, terms: DataFrame, window: int = 10) -> DataFrame:
    """(k1, k2, c), k1 < k2: sums of products of counts over utterances of a document less than ``window`` apart.

    Positions are dealt into buckets of ``window``; a pair lies in the same bucket or in neighbouring ones, so a long document is no
    single task's work.
    """
    found = occurrences(utterances, terms).withColumn("bucket", F.floor(F.col("pos") / window))
    a = found.select("doc_id", "bucket", F.col("term").alias("k1"), F.col("pos").alias("p"), F.col("n").alias("x"))
    b = found.select("doc_id", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("term").alias("k2"), F.col("pos").alias("q"), F.col("n").alias("y"))
    near = a.join(b, ["doc_id", "bucket"]).filter((F.col("k1") < F.col("k2")) & (F.abs(F.col("p") - F.col("q")) < window))
    return near.groupBy("k1", "k2").agg(F.sum(F.col("x") * F.col("y")).alias("c"))


def network(utterances: DataFrame, terms: DataFrame, window: int = 10) -> DataFrame:
    """(k1, k2, weight)."""
    found = cooccurrences(utterances, terms, window)
    # The pairs of some dozens of keywords are a few hundred rows.
    whole = F.sum("c").over(Window.partitionBy(F.lit(0)))
    return found.select("k1", "k2", (TOTAL_WEIGHT * F.col("c") / whole).alias("weight"))


def build_keywords(utterances: DataFrame, speakers: list[str] | None = None, use_main: bool = True, window: int = 10, top: int = KEYWORDS, focus_doc: int | None = None, by_entities: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (term, centrality, node_size) in ascending order and edges (k1, k2, weight, edge_width)."""
    utterances = chosen_speakers(utterances, speakers, use_main)
    terms = entity_keywords(utterances) if by_entities else keywords(utterances, top, focus_doc).select("term")
    edges = network(utterances, terms, window)
    nodes = centrality(terms, edges).withColumn("node_size", F.col("centrality") * F.col("centrality") * 5000).orderBy("centrality", "term")
    return nodes, edges.withColumn("edge_width", F.col("weight") / 4.5)
