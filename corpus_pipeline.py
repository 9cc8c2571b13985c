"""A training corpus from raw documents: each stage takes all that its predecessor kept, and what it decides takes effect.

The stages but for the last return the columns of ``documents``. Their results are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import Workspace, free_name
from parley.llm.decontam import decontaminate
from parley.llm.language_id import fit, held_out, identify
from parley.llm.line_dedup import drop_frequent_lines
from parley.llm.mixing import mixed_documents
from parley.llm.near_dedup import near_duplicates
from parley.llm.queries import MIN_LANGUAGE_SCORE


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the new texts, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for no language go."""
    model = fit(docs.filter(~held_out()))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    kept = identify(whole, model, min_score=MIN_LANGUAGE_SCORE).filter(~F.col("rejected"))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go from all texts."""
    return recounted(drop_frequent_lines(docs, min_docs=10, min_chars=1, report=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates stays; of rows equal in id and text, the smallest row.

    Rows are told apart by id and text, not by the id alone: different texts that share an id, or have none, are documents of their own.
    """
    space = Workspace(spark, "near-dedup-stage")
    unit = free_name(docs, "_unit")
    own = docs.withColumn(unit, F.xxhash64("doc_id", "text"))
    units = space.table(own.groupBy(unit).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "units")
    found = near_duplicates(own.select(unit, "text"), k=5, similarity=0.8, id_col=unit).select(F.col("id").alias(unit), "class_id")
    found = space.table(found.join(units, unit), "classes")
    # Ids ascend, none comes last.
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", unit)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = found.join(first.select("class_id", F.col(f"first.{unit}").alias("_first")), "class_id").filter(F.col(unit) != F.col("_first")).select(unit)
    kept = own.join(space.table(gone, "gone"), unit, "left_anti")
    again = space.table(units.filter("n > 1").select(unit), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # Equal rows go by partial minima, so a row repeated very often is no single task's work.
    rows = F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")
    one = kept.join(again, unit, "left_semi").groupBy(unit).agg(rows)
    return kept.join(again, unit, "left_anti").select(*docs.columns).unionByName(one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of ten words or more that items have go from the text; a text of which they are more than half goes."""
    return recounted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, min_span=10, max_coverage=0.5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, with or without an id, small sources more often, twice at most on average."""
    return mixed_documents(docs, max_repetition=2.0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the first stage nor the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
