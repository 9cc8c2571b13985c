"""The analyses as queries over the driver's tables, and DuckDB SQL with the same results.

``conversations`` gives the utterances: a document per conversation, an utterance per line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import analyses, centroid, chunker, cluster, corpus, keynet, layout, lexrank, postings, segment, sentences, stats, tagger, vectors
from parley.operators.search import Search
from parley.oracles import ORACLES  # noqa: F401
from parley.plans.settle import new_folder, settled
from parley.sources import transcripts

MAIN = ["assistant"]
TILING = segment.Tiling(w=20, k=10)
#: Below the default, which only a corpus of 16,206 utterances or more can reach.
IDF_THRESHOLD = 4.0


def utterances(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    return transcripts.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), numbered)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def over_utterances(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(utterances(spark, sf_dir))


def speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    speaker, text = transcripts.speaker_and_text(F.concat(F.col("speaker"), F.lit(": "), F.col("text")))
    return u.select("doc_id", "pos", speaker.alias("speaker"), text.alias("text"))


def reread(u: DataFrame) -> DataFrame:
    path = new_folder(u.sparkSession, "talks")
    transcripts.write_transcripts(u, path, 4)
    return transcripts.read_split_transcripts(u.sparkSession, path, numbered=False).groupBy("speaker", "text").agg(F.count(F.lit(1)).alias("n"))


def year_files(u: DataFrame) -> DataFrame:
    name: Column = F.concat(F.lit("talk_"), F.col("doc_id"), F.lit("_"), F.col("doc_id") % 7 + 2010, F.lit(".txt"))
    return transcripts.year_groups(u.select("doc_id").distinct().select(name.alias("file")))


def tiles(u: DataFrame) -> DataFrame:
    return segment.gap_scores(segment.joined(u), TILING)


def deep(u: DataFrame) -> DataFrame:
    return segment.depths(segment.smoothed(tiles(u)))


def indexed_search(u: DataFrame) -> DataFrame:
    """Looked up in an index of two batches, the utterances of the main speakers and all others."""
    index = postings.PostingIndex(u.sparkSession, new_folder(u.sparkSession, "postings"))
    main = F.coalesce(F.col("speaker").isin(MAIN), F.lit(False))
    index.add(u.filter(main))
    index.add(u.filter(~main))
    return index.find("of the")


def nearest_paragraphs(u: DataFrame) -> DataFrame:
    docs = segment.joined(u)
    return segment.snapped(docs, segment.found_boundaries(docs, TILING), TILING.w)


def network_layout(u: DataFrame) -> DataFrame:
    terms = settled(keywords_of(u))
    return layout.network_layout(terms, keynet.network(u, terms))


def keywords_of(u: DataFrame) -> DataFrame:
    return keynet.keywords(u).select("term")


SELECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "split_main_speakers": lambda u: corpus.parse_speakers(u, MAIN)[0].select("doc_id", F.col("pos").alias("new_pos"), "speaker"),
    "split_other_speakers": lambda u: corpus.parse_speakers(u, MAIN)[1].select("doc_id", F.col("pos").alias("new_pos"), "speaker"),
    "transcripts_reread": reread,
    "concat_documents": corpus.concat_documents,
    "year_groups": year_files,
    "tokens_without_stopwords": corpus.tokens_without_stopwords,
    "described_documents": lambda u: corpus.described(u).select("doc_id", "described"),
    "described_corpus": lambda u: corpus.described_corpus(u).select("described"),
    "shown_utterances": lambda u: u.select("doc_id", "pos", X.shown(F.col("speaker"), F.col("text")).alias("shown")),
    "clean_terms": lambda u: u.select("doc_id", "pos", X.clean_term(F.col("text")).alias("cleaned")),
}

COUNTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "count_docs": stats.count_docs,
    "doc_words": stats.doc_words,
    "corpus_words": stats.corpus_words,
    "doc_lines": stats.doc_lines,
    "corpus_lines": stats.corpus_lines,
    "utterance_percentiles": lambda u: rounded(stats.utterance_percentiles(u), "value"),
    "doc_speakers": lambda u: stats.doc_speakers(u, ranked=True),
    "corpus_speakers": stats.corpus_speakers,
    "main_speaker_total": lambda u: stats.speaker_total(u, MAIN),
    "entities_heuristic": stats.entity_counts,
    "entities_by_document": lambda u: stats.entity_counts(u, per_document=True),
    "entity_keywords": stats.entity_keywords,
    "corpus_speakers_ranked": lambda u: stats.corpus_speakers(u, ranked=True),
    "entities_ranked": analyses.Entities(top=75),
    "entities_ranked_all": analyses.Entities(),
}

LOOKUPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "search_unigram": lambda u: Search(u)("the").select("file", "pos", "text"),
    "search_bigram": lambda u: Search(u)("of the").select("file", "pos", "text"),
    "search_postings": indexed_search,
    "search_grouped": lambda u: Search(u).grouped("the"),
}

WEIGHTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tfidf_utterance": lambda u: rounded(vectors.utterance_vectors(u), "w"),
    "tfidf_document_sublinear": lambda u: rounded(vectors.keyword_vectors(u), "w"),
    "tfidf_cluster": lambda u: rounded(vectors.cluster_vectors(u), "w"),
    "doc_distance_matrix": lambda u: cluster.distance_pieces(u).select("doc_id", "first", F.posexplode("distances").alias("at", "dist")).select("doc_id", (F.col("first") + F.col("at")).cast("int").alias("other"), F.round("dist", 6).alias("dist")),
    "doc_cosine_distance": lambda u: rounded(cluster.distances(vectors.cluster_vectors(u), u), "dist"),
}

GRAPHS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lexrank_edges_naive": lambda u: rounded(lexrank.edges(u, "naive"), "sim"),
    "lexrank_edges_idfmod": lambda u: rounded(lexrank.edges(u, "idf-mod"), "sim"),
    "lexrank_edges_tfidf": lambda u: rounded(lexrank.edges(u, "tfidf"), "sim"),
    "lexrank_pagerank_fixed": lambda u: rounded(lexrank.scores(u, rounds=20).select("doc_id", "text", "score"), "score"),
    "lexrank_pruned_nodes": lambda u: lexrank.graph(u, prune=True)[0],
    "lexrank_keyphrases": lambda u: rounded(analyses.Keyphrases()(u), "score"),
    "lexrank_weighted": lambda u: rounded(lexrank.keyphrases(u, method="tfidf", weighted=True), "score"),
    "keynet_keywords": lambda u: rounded(keynet.keywords(u), "score"),
    "keynet_cooccurrence": lambda u: keynet.cooccurrences(u, keywords_of(u)),
    "keynet_edges": lambda u: rounded(keynet.network(u, keywords_of(u)), "weight"),
    "keynet_centrality": lambda u: rounded(analyses.KeywordNetwork()(u)[0], "centrality", "node_size"),
}

NETWORKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "keynet_layout": lambda u: rounded(network_layout(u), "x", "y"),
}

SUMMARIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "centroid_cosine": lambda u: rounded(centroid.cosines(u), "score"),
    "centroid_new_vocab": lambda u: rounded(centroid.new_vocabulary(u, IDF_THRESHOLD), "score"),
    "centroid_summary": analyses.Summary(),
    "centroid_summary_best": analyses.Summary("best", n=5),
    "centroid_summary_all": analyses.Summary("all"),
    "centroid_summary_tfidf": analyses.Summary("tfidf", n=5, threshold=IDF_THRESHOLD),
}

SEGMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "texttile_gaps": lambda u: rounded(tiles(u).select("doc_id", "gap", "score"), "score"),
    "texttile_smooth": lambda u: rounded(segment.smoothed(tiles(u)).select("doc_id", "gap", "score"), "score"),
    "texttile_depth": lambda u: rounded(deep(u).select("doc_id", "gap", "depth"), "depth"),
    "texttile_candidates": lambda u: rounded(segment.candidates(deep(u)).select("doc_id", "gap", "depth"), "depth"),
    "texttile_boundaries": lambda u: segment.boundaries(deep(u)),
    "texttile_segments": analyses.Segmentation(TILING),
    "texttile_plot": lambda u: rounded(analyses.Segmentation(TILING)(u, plot=True), "score", "smooth", "depth"),
    "paragraph_nearest": lambda u: nearest_paragraphs(u),
    "segment_lsa": lambda u: segment.summaries(segment.segments(u, TILING), sentences.learn(u)),
    "segment_lsa_topics": lambda u: segment.summaries(segment.segments(u, TILING), sentences.learn(u), topics=3),
}

SENTENCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "abbreviation_scores": lambda u: rounded(sentences.abbreviations(sentences.type_counts(sentences.profile(u))), "score"),
    "sentence_collocations": lambda u: rounded(sentences.learn(u).collocations, "ratio"),
    "sentence_starters": lambda u: rounded(sentences.learn(u).starters, "ratio"),
    "sentences": sentences.sentences,
    "entities_chunked": lambda u: rounded(chunker.entity_counts(sentences.word_tokens(sentences.sentences(u))), "weight"),
    "entity_tree": lambda u: rounded(chunker.entity_tree(sentences.word_tokens(sentences.sentences(u))), "weight"),
    "entities_tagged": lambda u: tagger.entity_counts(sentences.sentences(u), rounds=3),
    "word_tokens": lambda u: sentences.word_tokens(sentences.sentences(u)),
}

CLUSTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kmeans_labels": lambda u: cluster.k_means(u)[0],
    "kmeans_top_terms": lambda u: rounded(cluster.k_means(u)[1], "weight"),
    "mds_positions": lambda u: rounded(cluster.layout(u), "x", "y"),
    "cluster_frame": lambda u: rounded(cluster.cluster_frame(u), "x", "y"),
    "ward_linkage": lambda u: rounded(cluster.ward_linkage(u), "height"),
    "dendrogram_links": lambda u: rounded(layout.dendrogram_links(cluster.ward_linkage(u)), "height", "left_height", "right_height"),
    "dendrogram_labels": cluster.dendrogram_labels,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "utterances_load": lambda spark, sf_dir: utterances(spark, sf_dir, numbered=True),
    "parse_speaker_lines": speaker_lines,
    **{name: over_utterances(f) for group in (SELECTIONS, COUNTS, LOOKUPS, WEIGHTS, GRAPHS, NETWORKS, SUMMARIES, SEGMENTS, SENTENCES, CLUSTERS) for name, f in group.items()},
}
