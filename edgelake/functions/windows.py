"""Rolling expressions over daily rows.

A frame over n rows gives null until it holds n non-null values. NaN never enters: sources turn it into null.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_instrument() -> WindowSpec:
    return W.partitionBy("instrument").orderBy("date")


def rolling(agg: Column, x: Column, n: int, over: WindowSpec | None = None) -> Column:
    """``agg`` over the last n rows, null unless ``x`` has n non-null values there."""
    frame = (over or by_instrument()).rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def log_return(x: Column, over: WindowSpec | None = None) -> Column:
    return F.ln(F.try_divide(x, F.lag(x).over(over or by_instrument())))


def change(x: Column, n: int, over: WindowSpec | None = None) -> Column:
    return F.try_divide(x, F.lag(x, n).over(over or by_instrument())) - 1


def sample_skew(x: Column, n: int) -> Column:
    """Bias-corrected skewness of the last n rows."""
    skew = rolling(F.skewness(x), x, n)
    return F.when(~F.isnan(skew), skew) * ((n * (n - 1)) ** 0.5 / (n - 2))


def rsi(change_: Column, n: int) -> Column:
    """Relative strength from simple means of gains and losses; null while there is no loss."""
    gain = F.when(change_.isNotNull(), F.greatest(change_, F.lit(0.0)))
    loss = F.when(change_.isNotNull(), -F.least(change_, F.lit(0.0)))
    ratio = rolling(F.avg(gain), gain, n) / F.nullif(rolling(F.avg(loss), loss, n), F.lit(0.0))
    return 100 - 100 / (1 + ratio)


def true(condition: Column) -> Column:
    """A condition as a value: null counts as false."""
    return F.coalesce(condition, F.lit(False))
