"""Ordered operators on hot keys: running values, as-of joins and runs in two passes over blocks of the order.

A window over one key sorts all its rows in one task. Here the order of each key is cut into blocks. Within a block an
ordinary window gives the running values; what a block adds as a whole (its sum, maximum, last value) is one row, and a
window over these few rows gives what each block starts from. Both are combined row by row. So a key of any size is
spread over as many tasks as it has blocks, both passes aggregate before they shuffle, and all of it stays with Spark's own
expressions.

A block is a column that ascends with the order: spans of days or a number's multiples (``by_width``), or ranges with about
equally many rows between measured quantiles (``by_rows``). Rows with equal order stay in one block; a run of equal values
longer than a block is not cut.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.tables import write_table

#: Rows of a block about, and blocks at most, which bounds the quantiles that are looked up.
ROWS, BLOCKS = 1 << 18, 512
#: A side of a join is broadcast only if it was measured and holds at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def number(df: DataFrame, order: str) -> Column:
    """A date, timestamp or number as a number."""
    kind = df.schema[order].dataType.simpleString()
    return {"date": F.unix_date(order), "timestamp": F.unix_micros(order)}.get(kind, F.col(order))


def by_width(df: DataFrame, order: str, width: int) -> Column:
    """Blocks of ``width`` days, microseconds or units."""
    return F.floor(number(df, order) / width)


def by_rows(df: DataFrame, order: str, rows: int = ROWS) -> Column:
    """Blocks of about ``rows`` rows of all keys together, between approximate quantiles of ``order``."""
    n = df.count()
    blocks = min(BLOCKS, -(-n // rows))
    if blocks <= 1:
        return F.lit(0)
    value = number(df, order)
    cuts = df.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]  # a value a block
    return rank(value, sorted(set(cuts or [])))


def rank(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: a look at every step-th of them, and one at those in between, so that a row meets few of them."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    under = lambda a: F.size(F.filter(a, lambda c: c <= value))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    whole = under(F.array(*(F.lit(g[0]) for g in groups)))
    return F.greatest(whole - 1, F.lit(0)) * step + under(F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), F.greatest(whole, F.lit(1))))


class Running:
    """A running value: of the rows of a block so far, of a whole block, and of what was before with what is in the block."""

    def __init__(self, local, whole, carried, combine):
        self.local, self.whole, self.carried, self.combine = local, whole, carried, combine


def total(x: Column) -> Running:
    """Running sum, null before the first value."""
    return Running(lambda w: F.sum(x).over(w), F.sum(x), lambda b, w: F.sum(b).over(w), lambda before, here: F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0))))


def count(x: Column) -> Running:
    return Running(lambda w: F.count(x).over(w), F.count(x), lambda b, w: F.sum(b).over(w), lambda before, here: F.coalesce(before, F.lit(0)) + here)


def product(x: Column) -> Running:
    """Running product of positive numbers, by the sum of logarithms."""
    logs = total(F.log(x))
    return Running(logs.local, logs.whole, logs.carried, lambda before, here: F.exp(logs.combine(before, here)))


def highest(x: Column) -> Running:
    return Running(lambda w: F.max(x).over(w), F.max(x), lambda b, w: F.max(b).over(w), lambda before, here: F.greatest(before, here))


def lowest(x: Column) -> Running:
    return Running(lambda w: F.min(x).over(w), F.min(x), lambda b, w: F.min(b).over(w), lambda before, here: F.least(before, here))


def last(x: Column, order: list[Column]) -> Running:
    """The last value that isn't null; ``order`` is that of the rows."""
    there = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    whole = F.max_by(F.when(x.isNotNull(), F.struct(x.alias("x"))), F.when(x.isNotNull(), there))
    return Running(lambda w: F.last(F.when(x.isNotNull(), F.struct(x.alias("x"))), ignorenulls=True).over(w), whole, lambda b, w: F.last(b, ignorenulls=True).over(w), lambda before, here: F.coalesce(here, before)["x"])


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, values: dict[str, Running], inclusive: bool = True) -> DataFrame:
    """Add each of ``values`` over the rows of the same keys up to this one (without it, unless ``inclusive``), in ``order``.

    Rows with equal order are taken one after another in no fixed sequence, as in a window over rows.
    """
    over = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = df.withColumn("_block", block.cast("long"))
    parts = rows.groupBy(*keys, "_block").agg(*(v.whole.alias(f"_{n}") for n, v in values.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_kb"), *(v.carried(F.col(f"_{n}"), before).alias(f"_{n}") for n, v in values.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_block").eqNullSafe(F.col("_kb")))
    out = rows.withColumns({f"_here_{n}": v.local(over) for n, v in values.items()}).join(carried, same, "left")
    return out.select(*df.columns, *(v.combine(F.col(f"_{n}"), F.col(f"_here_{n}")).alias(n) for n, v in values.items()))


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], block: Column) -> DataFrame:
    """As operators.asof.asof(), with the rows of a key spread over ``block``, an expression of ``on``.

    Left rows of the same ``by`` and ``on`` have the same last right row, so it is looked up for each of these once and
    joined to the rows, which aren't sorted themselves: by a broadcast if its measured rows and bytes are few, else by a shuffle.
    """
    side = right.select(*by, on, F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    both = left.select(*by, on).distinct().withColumn("_side", F.lit(1)).unionByName(side, allowMissingColumns=True)
    keys = [*by, on]
    found = running(both, by, [on, "_side"], block, {"_last": last(F.col("_value"), [F.col(on), F.col("_side")])}).where("_side = 1")
    found = write_table(found.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)), "_last"), "asof")
    # a day with very many rows would be one task of a join by shuffle
    n, size = found.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    found = F.broadcast(found) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else found
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)))
    own = [c for c in left.columns if c not in keys]
    return left.join(found, same, "left").select(*keys, *own, *(F.col("_last")[v].alias(v) for v in values))


def runs(df: DataFrame, keys: list[str], order: str, value: str, block: Column) -> DataFrame:
    """Runs of one value: (keys, value, start, end, n); null is a value of its own."""
    whole = F.struct(F.col(value).alias("v"))
    rows = running(df, keys, [order], block, {"_before": last(whole, [F.col(order)])}, inclusive=False)
    # whole is never null, so no row before means that the run is the key's first
    new = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))
    rows = running(rows.withColumn("_new", new.cast("long")), keys, [order], block, {"_run": total(F.col("_new"))})
    return rows.groupBy(*keys, "_run", value).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def equity(daily: DataFrame, block: Column) -> DataFrame:
    """As operators.backtest.equity(), in blocks of days: equity, its running maximum and drawdown."""
    rows = running(daily, [], ["date"], block, {"equity": product(1 + F.col("ret"))})
    rows = running(rows, [], ["date"], block, {"peak": highest(F.col("equity"))})
    return rows.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))
