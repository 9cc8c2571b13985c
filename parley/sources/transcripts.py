"""Transcripts as a DataFrame of utterances: doc_id, pos, line_no, speaker, text, tokenized, file, score.

``pos`` counts a document's utterances from 0, ``line_no`` those of the corpus, documents in order of their ids (files: of their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as X
from parley.plans.numbering import offsets
from parley.plans.settle import settled

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("line_no", T.LongType()), T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("tokenized", T.StringType()), T.StructField("file", T.StringType()), T.StructField("score", T.DoubleType()),
])

#: What ends a line of a transcript, CR LF first.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
UNKNOWN = "UNK"


def speaker_and_text(line: Column) -> tuple[Column, Column]:
    """Split at the first colon; without one the speaker is unknown."""
    parts = F.split(line, ":", 2)
    known = F.size(parts) == 2
    return X.strip(F.when(known, parts[0]).otherwise(F.lit(UNKNOWN))), X.strip(F.when(known, parts[1]).otherwise(line))


def finished(lines: DataFrame, numbered: bool = True) -> DataFrame:
    """From (doc_id, pos, speaker, text, file) to the schema."""
    full = lines.withColumn("tokenized", X.strip(X.clean(F.col("text")))).withColumn("score", F.lit(-1.0))
    if not numbered:
        return full.withColumn("line_no", F.lit(None).cast("long")).select(*SCHEMA.fieldNames())
    starts = offsets(lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "n", "start").select("doc_id", "start")
    return full.join(starts, full["doc_id"].eqNullSafe(starts["doc_id"]), "left").drop(starts["doc_id"]).withColumn("line_no", F.col("start") + F.col("pos")).select(*SCHEMA.fieldNames())


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """The regular files of a directory, not below it. Names that begin with a dot or underscore are not seen."""
    return spark.read.format("binaryFile").load(directory).select(F.col("path").alias("file"))


def read_transcripts(spark: SparkSession, directory: str, numbered: bool = True) -> DataFrame:
    """Text files of one utterance a line, ``speaker: text``, in UTF-8."""
    whole = spark.read.text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    ranks = offsets(whole.select("file").withColumn("n", F.lit(1)), "file", "n", "doc_id").select("file", "doc_id")
    body = F.regexp_replace(F.col("value"), f"(?:{LINE_END})\\z", "")
    lines = whole.join(ranks, "file").filter(F.length("value") > 0).select("doc_id", "file", F.posexplode(F.split(body, LINE_END)).alias("pos", "line"))
    speaker, text = speaker_and_text(F.col("line"))
    return finished(lines.select("doc_id", F.col("pos").cast("long").alias("pos"), speaker.alias("speaker"), text.alias("text"), "file"), numbered)


def read_split_transcripts(spark: SparkSession, directory: str, numbered: bool = True) -> DataFrame:
    """The rows of ``read_transcripts``, with files of any size read in byte ranges, as many tasks a file as ``spark.sql.files.maxPartitionBytes`` makes.

    The reader cuts files at line feeds only, so a line that crosses ranges stays whole, and what else ends a line is cut within what it gives. A
    line's number is its place in its range, plus the lines of the ranges before it. Whether the last line feed is there, which decides if the end
    of the last line is one, is told by the file's size.
    """
    raw = spark.read.option("lineSep", "\n").text(directory).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row"))
    raw = settled(raw)
    # Without the last line feed a byte is missing from the lines' sizes; with a mark of byte order, which the reader drops, three more are.
    files = raw.groupBy("file").agg((F.max("bytes") + 1 - F.sum(F.octet_length("value") + 1)).alias("over"), F.max(F.struct("range", "row")).alias("last"), F.min(F.struct("range", "row")).alias("first"))
    ranks = offsets(files.select("file").withColumn("n", F.lit(1)), "file", "n", "doc_id").select("file", "doc_id")
    rows = raw.join(files.join(ranks, "file"), "file")
    at = F.struct("range", "row")
    open_end = (at == F.col("last")) & F.col("over").isin(0, 3)
    value = F.when((at == F.col("first")) & (F.col("over") >= 3), F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value"))
    # A line feed takes one carriage return before it with it; an open end is no line.
    parts = F.split(F.when(open_end, F.regexp_replace(value, f"(?:{LINE_END})\\z", "")).otherwise(F.regexp_replace(value, "\r\\z", "")), LINE_END)
    rows = rows.select("doc_id", "file", "range", "row", parts.alias("parts"))
    sizes = rows.groupBy("file", "range").agg(F.sum(F.size("parts")).alias("n"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("file", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("in_range", F.coalesce(F.sum(F.size("parts")).over(within), F.lit(0))).join(starts, ["file", "range"])
    lines = counted.select("doc_id", "file", (F.col("start") + F.col("in_range")).alias("from"), F.posexplode("parts").alias("i", "line"))
    speaker, text = speaker_and_text(F.col("line"))
    return finished(lines.select("doc_id", (F.col("from") + F.col("i")).cast("long").alias("pos"), speaker.alias("speaker"), text.alias("text"), "file"), numbered)


def write_transcripts(utterances: DataFrame, directory: str, files: int) -> None:
    """Text files of lines ``speaker: text``, a document's lines in order in one file."""
    dealt = utterances.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "pos")
    dealt.select(F.concat("speaker", F.lit(": "), "text").alias("value")).write.text(directory)


def from_conversations(conversations: DataFrame, numbered: bool = False) -> DataFrame:
    """(conv_id, turn, role, text): a document per conversation, an utterance per line of a turn."""
    turns = conversations.select(F.col("conv_id").alias("doc_id"), "turn", F.col("role").alias("speaker"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    # A conversation is one document and fits a task; documents are dealt by their ids.
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "line", "text")) - 1
    lines = turns.select("doc_id", at.cast("long").alias("pos"), "speaker", X.strip(F.col("text")).alias("text"), F.concat(F.lit("conv_"), F.col("doc_id").cast("string")).alias("file"))
    return finished(lines, numbered)


def from_documents(documents: DataFrame, numbered: bool = False) -> DataFrame:
    """(doc_id, text): an utterance per line, without speakers."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return finished(lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(UNKNOWN).alias("speaker"), X.strip(F.col("text")).alias("text"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file")), numbered)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """In-memory (doc_id, pos, speaker, text, file)."""
    return finished(spark.createDataFrame(rows, "doc_id long, pos long, speaker string, text string, file string"))


def year_groups(files: DataFrame, path: str = "file") -> DataFrame:
    """(year, file): a file is in the group of every year that occurs anywhere in its path. Years are those of all files.

    Both sides meet on the four-character pieces of a path, so this is an equi-join.
    """
    paths = files.select(F.col(path).alias("_path"))
    years = paths.select(X.year(F.col("_path")).alias("year")).distinct()
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_path") - 3))
    pieces = paths.withColumn("year", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(F.col("_path"), i, F.lit(4))))))
    return pieces.join(years, "year").select("year", F.col("_path").alias("file"))
