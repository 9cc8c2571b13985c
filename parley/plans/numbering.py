"""Running offsets over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.settle import settled

#: Ranges that the keys are cut into.
RANGES = 200


def offsets(counts: DataFrame, key: str, n: str, out: str) -> DataFrame:
    """``counts`` (one row per key) plus the sum of ``n`` over all smaller keys.

    Keys are cut into ranges at ``RANGES`` of them that a hash picks; sums run within a range and over the ranges' totals.
    """
    picked = [r[0] for r in counts.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(RANGES).select(key).collect()]
    kind = counts.schema[key].dataType
    bounds = F.array(*(F.lit(b) for b in sorted(set(picked)))).cast(f"array<{kind.simpleString()}>")
    ranged = counts.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(key)))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(n).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are ranges.
    return ranged.withColumn("_in", F.coalesce(F.sum(n).over(within), F.lit(0))).join(F.broadcast(totals), "_range").withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_in", "_start")


def ranked(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """``df`` plus its rows' numbers from 1 in ``order``: a distributed sort, written, of which each part's rows are numbered from where the one before
    ends. Only the parts' sizes come to the driver."""
    rows = settled(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = sorted(tuple(r) for r in rows.groupBy(part).agg(F.count(F.lit(1))).collect())  # a row per task
    starts, before = [], 0
    for number, n in sizes:
        starts.append(F.struct(F.lit(number), F.lit(before).cast("long")))
        before += n
    if not starts:
        return rows.withColumn(out, F.lit(0).cast("long")).drop("_row")
    first = F.element_at(F.map_from_entries(F.array(*starts)), part)
    return rows.withColumn(out, first + (F.col("_row") - F.shiftleft(part, 33)) + 1).drop("_row")
