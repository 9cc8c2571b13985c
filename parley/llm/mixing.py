"""Mixing sources to target weights by temperature.

With T_i tokens in source i, weights are q_i = T_i^t / sum_j T_j^t. The exponent t is bisected in [0, 1]: to the largest whose weights
have at least ``entropy`` (a share of the logarithm of the number of sources), or to the smallest at which no source is repeated more
often than ``max_repetition`` allows. Where both are given, the repetition limit has the last word. A budget of B tokens gives source i
q_i * B tokens; without a budget, B is the smallest that gives every source one whole epoch.

The budget is realised as permutations of blocks: a source is cut into blocks of about ``block_tokens`` tokens by a hash of the id; each
epoch orders blocks, and documents within a block, by hashes of its own. All epochs but a source's last are whole; the last ends where the
source's budget does: a document is in it if it starts before that. Where it starts is the sum of the tokens before it, which comes from sums
of blocks, over at most ``2 ** FAN_BITS`` sums of blocks per source, so no task sees a whole source.

What is planned are units: rows of equal id, source and text are one unit and travel together; all others go their own way, whether or not they
share an id or have none.

Defined results: a text without words counts as one token; a null source is a source; a null id is an id like any other; ties of
hashes go to the smaller unit; an empty table gives an empty plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import HEAVY_KEYS, Workspace, attach, free_name, others, spread_left

FAN_BITS = 12
#: Sources are listed on the driver, some 200 bytes each; more than this is taken for an error.
MAX_SOURCES = 1_000_000


def weights(tokens: list[float], t: float) -> list[float]:
    most = max(tokens)
    raw = [(x / most) ** t for x in tokens]
    total = math.fsum(raw)
    return [x / total for x in raw]


def entropy_of(q: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in q if x > 0)


def budget_of(tokens: list[float], q: list[float]) -> float:
    """Tokens that give every source one whole epoch."""
    return max(n / x for n, x in zip(tokens, q, strict=True))


def exponent(tokens: list[float], entropy: float | None, max_repetition: float | None, budget: float | None, steps: int = 60) -> float:
    def repetition(t: float) -> float:
        q = weights(tokens, t)
        b = budget if budget is not None else budget_of(tokens, q)
        return max(b * x / n for n, x in zip(tokens, q, strict=True))

    t = 1.0
    if entropy is not None:  # entropy falls with t
        low, high, wanted = 0.0, 1.0, entropy * math.log(max(1, len(tokens)))
        if entropy_of(weights(tokens, 1.0)) < wanted:
            for _ in range(steps):
                mid = (low + high) / 2
                low, high = (mid, high) if entropy_of(weights(tokens, mid)) >= wanted else (low, mid)
            t = low
    if max_repetition is not None and (entropy is None or repetition(t) > max_repetition):  # repetition falls with t
        low, high = (0.0 if entropy is None else t), 1.0
        if repetition(low) <= max_repetition:
            return low
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if repetition(mid) <= max_repetition else (mid, high)
        t = high
    return t


def mix(docs: DataFrame, entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, block_tokens: int = 1 << 17, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The plan: (id, source, n_tokens, weight, epoch, block, block_key, doc_key), a row per copy. Read it by (epoch, block_key, block,
    doc_key) within a source. ``budget``: tokens, as a multiple of all tokens."""
    return _plan(docs, Workspace(docs.sparkSession, "mixing"), entropy, max_repetition, budget, block_tokens, seed, id_col, source_col, text_col)[0].drop("unit")


def unit_of(id_col: str, source_col: str, text_col: str) -> Column:
    """Equal for equal rows. Two others with the same number would travel together, which does no harm."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), F.col(text_col))


def _plan(docs: DataFrame, space: Workspace, entropy: float | None, max_repetition: float | None, budget: float | None, block_tokens: int, seed: int, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The plan with its units, and (unit, id, source, n: rows, n_tokens)."""
    own = docs.select(unit_of(id_col, source_col, text_col).alias("unit"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")).cast("long").alias("n_tokens"))
    units = own.groupBy("unit").agg(F.min("id").alias("id"), F.min("source").alias("source"), F.greatest(F.lit(1), F.sum("n_tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
    units = space.table(units.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "units")
    totals = units.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("s").limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = [float(r["tokens"]) for r in totals]
    rows = []
    if totals:
        whole = None if budget is None else budget * math.fsum(tokens)
        q = weights(tokens, exponent(tokens, entropy, max_repetition, whole))
        whole = budget_of(tokens, q) if whole is None else whole
        for r, x in zip(totals, q, strict=True):
            share = x * whole
            full = int(share // r["tokens"] + 1e-9)
            rest = max(0, round(share - full * r["tokens"]))
            rows.append((r["s"], r["n"], x, full, rest, max(1, -(-r["tokens"] // block_tokens))))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "s string, n long, weight double, full int, rest long, blocks long")
    n_units = sum(r["n"] for r in totals)
    placed = attach(units, plan, ["s"], n_units)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("blocks")))

    def key(epoch, *of):
        return F.xxhash64(F.lit(seed), epoch, *of)

    # The last epoch: where does each document start?
    last = space.table(placed.select("unit", "id", "s", "source", "n_tokens", "weight", "full", "rest", "block", key(F.col("full"), F.col("s"), F.col("block")).alias("block_key"), key(F.col("full"), F.col("unit")).alias("doc_key")), "placed")
    blocks = space.table(last.filter("rest > 0").groupBy("s", "rest", "block", "block_key").agg(F.sum("n_tokens").alias("tokens")).withColumn("fan", F.shiftright("block_key", 64 - FAN_BITS)), "blocks")
    fans = blocks.groupBy("s", "fan").agg(F.sum("tokens").alias("tokens"))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fans = fans.select("s", "fan", before(Window.partitionBy("s").orderBy("fan")).alias("fan_start"))
    starts = blocks.withColumn("in_fan", before(Window.partitionBy("s", "fan").orderBy("block_key", "block"))).join(fans, ["s", "fan"]).select("s", "block", (F.col("fan_start") + F.col("in_fan")).alias("block_start"), "rest", "tokens")
    starts = space.table(starts, "starts")
    inside = starts.filter("block_start + tokens <= rest").select("s", "block", F.lit(True).alias("all_in"), F.lit(0).cast("long").alias("block_start"))
    # One block per source holds the end of the budget; only its documents are put in order.
    edge = starts.filter("block_start < rest and block_start + tokens > rest").select("s", "block", F.lit(False).alias("all_in"), "block_start")
    chosen = inside.unionByName(edge)
    chosen = F.broadcast(chosen) if sum(r[5] for r in rows) <= HEAVY_KEYS else chosen
    partial = last.join(chosen, ["s", "block"])
    within = Window.partitionBy("s", "block").orderBy("doc_key", "unit").rowsBetween(Window.unboundedPreceding, -1)
    cut = partial.filter("not all_in").withColumn("start", F.col("block_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).filter("start < rest").drop("start")
    partial = partial.filter("all_in").unionByName(cut).select("unit", "id", "source", "n_tokens", "weight", F.col("full").alias("epoch"), "block", "block_key", "doc_key")
    epochs = last.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    epochs = epochs.select("unit", "id", "source", "n_tokens", "weight", "epoch", "block", key(F.col("epoch"), F.col("s"), F.col("block")).alias("block_key"), key(F.col("epoch"), F.col("unit")).alias("doc_key"))
    return epochs.unionByName(partial), units.select("unit", F.col("n_rows").alias("n"))


def mixed_documents(docs: DataFrame, entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None, block_tokens: int = 1 << 17, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the plan, a row per copy, with all their columns and mix_weight, mix_epoch, mix_block, mix_block_key and
    mix_doc_key, which replace columns of these names."""
    space = Workspace(docs.sparkSession, "mixed")
    plan, units = _plan(docs, space, entropy, max_repetition, budget, block_tokens, seed, id_col, source_col, text_col)
    own, copies = free_name(docs, "_unit"), free_name(docs, "_plan")
    added = [f"mix_{c}" for c in ("weight", "epoch", "block", "block_key", "doc_key")]
    named = [F.col(c.removeprefix("mix_")).alias(c) for c in added]
    # A unit has as many copies as its source has epochs.
    table = plan.groupBy(F.col("unit").alias(own)).agg(F.collect_list(F.struct(*named)).alias(copies))
    kept = others(docs, *added)
    left = docs.select(*(F.col(f"`{c}`") for c in kept), unit_of(id_col, source_col, text_col).alias(own))
    counts = units.withColumnRenamed("unit", own)
    rows = spread_left(left, table, own, counts, counts.agg(F.sum("n")).first()[0] or 0, space)
    return rows.withColumn(copies, F.explode(copies)).select(*(F.col(f"`{c}`") for c in kept), F.col(f"{copies}.*"))
