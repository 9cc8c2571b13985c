"""Named entities as nested chunks, told from other capitalised words by mutual bootstrapping of spans and their contexts.

A chunk is a run of capitalised tokens, in which a connector (``of``, ``de``, ...) may stand between two of them; the parts between
connectors are chunks within it. Whether a span's text is a name is learned: at first by how often it is capitalised within sentences, where
only names are. Then the words before and behind names get the mean weight of the spans that they stand beside, and spans the mean of
their contexts' weights and their own first one, a few times over. Both sides are tables of counts, and a round is two joins and two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.settle import settled

# Small words within names.
CONNECTORS = ("of", "de", "la", "du", "del", "da", "von", "van", "der", "den", "and", "the", "&")
KEYS = ("doc_id", "pos", "sent")


def spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, sent, begin, end, depth, parent_begin, entity, left, right) from ``word_tokens``. ``begin`` and ``end`` count tokens; ``left`` and
    ``right`` are the words around in small letters, ``^`` and ``$`` where there is none."""
    line = Window.partitionBy(*KEYS).orderBy("i")
    capital = F.col("token").rlike(r"\A\p{Lu}") & ~F.col("token").isin("I", "A")
    rows = tokens.select(*KEYS, "i", "token", capital.alias("capital"))
    rows = rows.withColumn("left", F.coalesce(F.lower(F.lag("token").over(line)), F.lit("^"))).withColumn("right", F.coalesce(F.lower(F.lead("token").over(line)), F.lit("$")))
    inside = F.col("capital") | (F.lower("token").isin(*CONNECTORS) & F.coalesce(F.lag("capital").over(line) & F.lead("capital").over(line), F.lit(False)))
    rows = rows.withColumn("inside", inside).filter("inside")
    # Places in a run have the same distance from their number among those kept.
    outer = F.col("i") - F.row_number().over(line)
    inner = F.col("i") - F.row_number().over(Window.partitionBy(*KEYS, "capital").orderBy("i"))
    rows = rows.withColumn("outer", outer).withColumn("inner", inner)

    def joined(*by: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("i", "token")))
        return rows.filter("capital" if "inner" in by else "inside").groupBy(*KEYS, *by).agg(
            F.min("i").alias("begin"), (F.max("i") + 1).alias("end"), F.array_join(F.transform(own, lambda x: x["token"]), " ").alias("entity"), F.min_by("left", "i").alias("left"), F.max_by("right", "i").alias("right"))

    top = joined("outer")
    whole = top.select(*KEYS, "outer", F.col("begin").alias("_b"), F.col("end").alias("_e"))
    nested = joined("outer", "inner").join(whole, [*KEYS, "outer"]).filter("begin > _b OR end < _e")
    columns = [*KEYS, "begin", "end", "depth", "parent_begin", "entity", "left", "right"]
    return top.withColumn("depth", F.lit(0)).withColumn("parent_begin", F.lit(None).cast("long")).select(*columns).unionByName(nested.withColumn("depth", F.lit(1)).withColumn("parent_begin", F.col("_b")).select(*columns))


def weights(found: DataFrame, rounds: int = 3, prior: float = 1.0) -> DataFrame:
    """(entity, n, weight) of ``spans``, after so many rounds. ``prior`` is how many contexts a span's first weight counts for, and how many spans of
    weight 0 every context has beside its own."""
    sides = F.array(F.concat(F.lit("< "), F.col("left")), F.concat(F.lit("> "), F.col("right")))
    met = settled(found.select("entity", F.explode(sides).alias("context")).groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n")))
    # A mention has two contexts; those at the beginning of a sentence tell nothing of the capital.
    first = met.groupBy("entity").agg(F.floor(F.sum("n") / 2).cast("long").alias("n"), (1 - F.sum(F.when(F.col("context") == "< ^", F.col("n")).otherwise(0)) / (F.sum("n") / 2)).alias("own"))
    first = settled(first)
    now = first.select("entity", F.col("own").alias("weight"))
    beside = met.filter(~F.col("context").isin("< ^", "> $"))
    for _ in range(rounds):
        contexts = beside.join(now, "entity").groupBy("context").agg((F.sum(F.col("n") * F.col("weight")) / (F.sum("n") + prior)).alias("worth"))
        told = beside.join(contexts, "context").groupBy("entity").agg(F.sum(F.col("n") * F.col("worth")).alias("sum"), F.sum("n").alias("seen"))
        weight = (prior * F.col("own") + F.coalesce("sum", F.lit(0.0))) / (prior + F.coalesce("seen", F.lit(0)))
        now = settled(first.join(told, "entity", "left").select("entity", weight.alias("weight")))
    return first.select("entity", "n").join(now, "entity")


def entity_counts(tokens: DataFrame, least: float = 0.3, rounds: int = 3) -> DataFrame:
    """(entity, n, weight) of the spans that weigh ``least`` or more."""
    return weights(spans(tokens), rounds).filter(F.col("weight") >= least)


def entity_tree(tokens: DataFrame, least: float = 0.3, rounds: int = 3) -> DataFrame:
    """(doc_id, pos, sent, begin, end, depth, parent_begin, entity, weight): mentions, each with the one that it lies in."""
    found = spans(tokens)
    return found.drop("left", "right").join(weights(found, rounds).filter(F.col("weight") >= least).select("entity", "weight"), "entity").select(*KEYS, "begin", "end", "depth", "parent_begin", "entity", "weight")
