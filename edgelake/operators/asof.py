"""As-of and range joins, linear in the rows: no inequality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Every left row with ``values`` of the last right row of the same ``by`` at or before it (null if none).

    Both sides are laid in one order and the last right row is carried forward; right rows come first on equal ``on``.
    """
    side = right.select(*by, on, F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    own = [c for c in left.columns if c not in (*by, on)]
    both = left.withColumns({"_side": F.lit(1), "_row": F.struct(*own) if own else F.lit(1)}).select(*by, on, "_side", "_row").unionByName(side, allowMissingColumns=True)
    over = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_value", ignorenulls=True).over(over)).where("_side = 1")
    return out.select(*by, on, *(F.col("_row")[c].alias(c) for c in own), *(F.col("_last")[v].alias(v) for v in values))


def in_range(rows: DataFrame, ranges: DataFrame, on: str, values: dict) -> DataFrame:
    """Values of the last range of days (start, end, seq) that holds the date ``on``; defaults from ``values``.

    Ranges are laid out by day, so the join is one of equal days.
    """
    days = ranges.where("start <= end").select(F.explode(F.sequence("start", "end")).alias(on), "seq", F.struct(*values).alias("_v"))
    last = days.groupBy(on).agg(F.max_by("_v", "seq").alias("_v"))
    return rows.join(last, on, "left").select(*rows.columns, *(F.coalesce(F.col("_v")[v], F.lit(d)).alias(v) for v, d in values.items()))
