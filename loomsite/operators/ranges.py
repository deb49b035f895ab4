"""Places of rows in the order of a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsite.plans.stage import stage

#: Ranges into which the values are cut, and the accuracy of their borders (of all rows, one in so many).
RANGES, ACCURACY = 256, 10_000


def places(df: DataFrame, order: list[str], count: str | None, upto: str, total: str) -> DataFrame:
    """df with `upto`: the sum of `count` (or the number of rows) up to and with the row in the order given, and `total`.

    The first order column is a number and not null. Approximate quantiles cut it into ranges; sums per range are added
    up, one row a range, and rows are only ordered inside their range. Equal values of the first column share a range:
    give distinct values where one value may be that of very many rows.
    """
    df = stage(df, "ordered")
    first, one = F.col(order[0]), F.col(count) if count else F.lit(1)
    cuts = df.agg(F.percentile_approx(first.cast("double"), [i / RANGES for i in range(1, RANGES)], ACCURACY).alias("c")).first().c or []
    borders = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    at = df.withColumn("_range", F.size(F.filter(borders, lambda b: b < first.cast("double"))))
    sums = at.groupBy("_range").agg(F.sum(one).alias("_sum"))
    before = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), total: F.sum("_sum").over(Window.partitionBy())}).drop("_sum")
    inside = F.sum(one).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at.join(F.broadcast(before), "_range").withColumn(upto, F.col("_before") + inside).drop("_range", "_before")  # one row per range
