"""Exact dedup by progressive refinement: rows are grouped by length, then by a hash of their beginning, then by a hash of the whole.

DataFrame operations only. Two texts are equal when they are so without the whitespace ``[\\x20\\x09-\\x0D]``; a null text is an empty one. Of
equal texts the row with the most characters stays, whitespace included, and of these the one with the smallest id.

1. A first pass tells every row's length without whitespace and the hash of its first ``prefix`` characters, a few bytes a row, which are
   written. Rows whose length no other row has are done.
2. What is left is counted by length and hash of the beginning, and rows that are alone in their group are done.
3. A second pass over the texts hashes as a whole (SHA-256) only rows of a group that is left; these are written with all their columns, and
   all others go by unchanged and are never moved.

Which rows go on to the next level is told by a filter of ``filter_bits`` bits, a bit per hashed group: a broadcast of a fixed size, whatever
the data (8 MB). A row whose bit another group has set goes on without need and is alone in the end, so the filter decides about work, not about
results: groups are those of length, beginning and whole together. Groups are counted with partial aggregation, and a group of any size
gets its result by a broadcast of its one row, so no task sees a whole group.

Defined results: each row is a document; of rows with the same characters and id one stays, the first as written; a null id comes
after all others; empty and blank texts are one group; ids may repeat; an empty table gives an empty table; other columns are kept, and
those with the names of added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Workspace, attach, free_name, others

BLANKS = " \t\n\x0b\x0c\r"
ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: Words of 64 bits in a row of a filter.
WORDS = 512


def normalised(text: Column) -> Column:
    """The text without whitespace."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def group_filter(groups: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """A bit for every row's hashed ``keys``, as ``bits / (64 * WORDS)`` rows (part, words) at most."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = groups.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("one"))
    held = F.map_from_entries(F.collect_list(F.struct((F.col("word") % WORDS).cast("int"), "one")))
    rows = words.groupBy(F.expr(f"CAST(word div {WORDS} AS INT)").alias("part")).agg(held.alias("held"))
    return rows.select("part", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long"))).alias("words"))


def passed(rows: DataFrame, by: DataFrame, keys: list[str], bits: int, out: str) -> DataFrame:
    """``rows`` and in ``out`` whether the bit of their ``keys`` is set."""
    part, words, bit = (free_name(rows, x) for x in ("_part", "_words", "_bit"))
    table = F.broadcast(by.select(F.col("part").alias(part), F.col("words").alias(words)))
    own = rows.withColumn(bit, F.pmod(F.xxhash64(*keys), F.lit(bits)))
    joined = own.join(table, F.expr(f"CAST(`{bit}` div {64 * WORDS} AS INT) = `{part}`"), "left")
    is_set = F.expr(f"(shiftright(`{words}`[CAST(`{bit}` div 64 % {WORDS} AS INT)], CAST(`{bit}` % 64 AS INT)) & 1L) = 1L")
    return joined.withColumn(out, F.coalesce(is_set, F.lit(False))).drop(part, words, bit)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, filter_bits: int = 1 << 26, digest: bool = False, texts: bool = True) -> DataFrame:
    """``docs`` plus ``keep_id``, the id of the row that stays of those with an equal text, ``group_size``, their number, and ``kept``.

    With ``digest`` there is ``text_sha256`` too, the SHA-256 of every text without whitespace; without ``texts``, ``text_col`` is left out.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    kept_columns = [c for c in others(docs, *(ADDED if digest else ADDED[:3])) if texts or c != text_col]
    bare, size, head, whole, left, row, chars = (free_name(docs, f"_{x}") for x in ("bare", "size", "head", "whole", "left", "row", "chars"))
    own = docs.withColumn(bare, normalised(F.col(text_col))).withColumn(size, F.length(bare)).withColumn(head, F.xxhash64(F.left(F.col(bare), F.lit(prefix))))

    facts = space.table(own.select(size, head), "facts")
    repeated = lambda rows, keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lengths = space.table(group_filter(repeated(facts, [size]), [size], filter_bits), "lengths")
    beginnings = space.table(group_filter(repeated(passed(facts, lengths, [size], filter_bits, left).filter(left), [size, head]), [size, head], filter_bits), "beginnings")

    told = passed(own, beginnings, [size, head], filter_bits, left)
    columns = [F.col(f"`{c}`") for c in kept_columns]
    hashed = told.filter(left).select(*columns, F.col(id_col).alias(f"{row}_id"), F.length(F.coalesce(text_col, F.lit(""))).alias(chars), size, head, F.unhex(F.sha2(bare, 256)).alias(whole), F.monotonically_increasing_id().alias(row))
    suspects = space.table(hashed, "suspects")
    keys = [size, head, whole]
    order = F.struct(-F.col(chars), F.col(f"{row}_id").isNull(), F.col(f"{row}_id").alias("id"), F.col(row).alias("row"))
    groups = suspects.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("_first.id").alias(f"{row}_keep"), F.col("_first.row").alias(f"{row}_first"), F.col("n").alias(f"{row}_n"), "n")
    met = attach(suspects, space.table(groups, "groups"), keys, suspects.count(), few=1000)

    sha = [F.lower(F.hex(whole)).alias("text_sha256")] if digest else []
    grouped = met.select(*columns, F.col(f"{row}_keep").alias("keep_id"), F.col(f"{row}_n").alias("group_size"), (F.col(row) == F.col(f"{row}_first")).alias("kept"), *sha)
    sha = [F.sha2(bare, 256).alias("text_sha256")] if digest else []
    alone = told.filter(~F.col(left)).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *sha)
    return alone.unionByName(grouped)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text."""
    kept = free_name(docs, "_kept")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(kept), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return exact_duplicates(own).filter("kept").select(*(F.col(f"{kept}.`{c}`").alias(c) for c in docs.columns))
