"""The thin queries over the operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import language_id, pii, quality, structure, warc
from parley.llm.common import Workspace
from parley.llm.decontam import find_items
from parley.llm.exact_dedup import exact_duplicates
from parley.llm.fim import fill_in_middle, restored
from parley.llm.line_dedup import drop_frequent_lines
from parley.llm.mixing import mix
from parley.llm.near_dedup import near_duplicates
from parley.llm.substrings import repeated_passages
from parley.llm.topk import top_k

#: Cosine below which a text is taken for none of the languages.
MIN_LANGUAGE_SCORE = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, grades(table(spark, sf_dir, "labels")), grades=2, sample_rows=12_000)
    return quality.rate(docs, model, keep_grade=2, min_tail=0.5).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model, min_score=MIN_LANGUAGE_SCORE)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), entropy=0.98, max_repetition=4.0, budget=1.0)
    return plan.withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, window=6, min_words=50, similarity=0.8)
    return found.withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'warc').path}/archive"
    warc.write_pages(table(spark, sf_dir, "pages"), path, min_bytes=0)
    records = warc.read_warc(spark, path, verify=True).filter(F.col("type").isin("response", "revisit"))
    return records.select(warc.page_id(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), warc.page_id(F.col("refers_to")).alias("refers_to"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.fit(docs)).drop("text")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), "class_id", "copy_of", "n_joining")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20, scale=64)
    return found.withColumnRenamed("id", "vec_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return structure.Repair(structure.damaged(turns)).report(turns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs, digest=True, texts=False)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, rate=90, spm_rate=20)
    whole = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_topk_search": op10_topk_search,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}
