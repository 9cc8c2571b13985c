"""As-of joins: the nearest row of another table before and after a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(left: DataFrame, right: DataFrame, by: list[str], at: str) -> DataFrame:
    """``left`` plus ``before``, the largest ``at`` of ``right`` with the same ``by`` that is not above its own, and ``after``, the smallest above it.

    Both tables are put together and sorted once, with no row for a pair: two windows look back to the last place and on to the next.
    """
    places = right.select(*by, at).distinct().withColumn("_place", F.col(at)).withColumn("_own", F.lit(0))
    rows = left.withColumn("_own", F.lit(1)).unionByName(places, allowMissingColumns=True)
    # At the same place, what is looked for comes first.
    order = Window.partitionBy(*by).orderBy(at, "_own")
    before = F.last("_place", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_place", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("after", after).filter("_own = 1").drop("_own", "_place")
