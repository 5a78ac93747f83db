"""Event-driven backtest of the trigger rules with synthetic option premiums, and its scorecard.

One trade may be open per instrument and direction, and MAX_POSITIONS at a time; capital never decides on an entry. With no more
pairs than positions each pair is a walk of its own. With more, walks interact, and spans of days are walked in parallel until
each has started from what its predecessor leaves (operators/positions.py). Compounding is an ordered product afterwards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.constants import MAX_POSITION_SHARE, MAX_POSITIONS, OPTION_STOP
from edgelake.functions.pricing import at_the_money, atm_premium, black_scholes, strike_step
from edgelake.functions.stats import profit_factor, sharpe, win_rate
from edgelake.operators import positions
from edgelake.operators.asof import asof
from edgelake.operators.features import synthetic_iv
from edgelake.operators.positions import NEVER
from edgelake.operators.triggers import backtest_triggers

HOLDING = {"SEED-001": 5, "SEED-002": 2, "SEED-003": 5, "SEED-004": 10}


def trading_days(history: DataFrame, start: str, end: str) -> DataFrame:
    """Business days with a regime and no warning: neither exits nor entries happen on others."""
    days = history.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.weekday("date") < 5))
    return days.where(~F.col("transition_warning_flag")).select(F.col("date").alias("day"), "regime_state")


def candidates(features: DataFrame, days: DataFrame, steps: dict[str, float] | None = None) -> DataFrame:
    """Fillable signals by day: the latest feature row on or before a day decides, and prices the entry."""
    rows = synthetic_iv(features).drop("ret")
    names = [c for c in rows.columns if c not in ("instrument", "date")]
    names_of = features.groupBy().agg(F.collect_set("instrument").alias("_names"))  # one row
    grid = days.crossJoin(F.broadcast(names_of)).withColumn("instrument", F.explode("_names")).drop("_names")
    grid = asof(grid.withColumnRenamed("day", "date"), rows.withColumn("row_date", F.col("date")), "date", ["instrument"], [*names, "row_date"])
    signals = backtest_triggers(grid.where("row_date is not null").withColumn("day", F.col("date")))
    signals = signals.withColumnRenamed("close", "price")
    table = F.create_map(*(F.lit(x) for kv in HOLDING.items() for x in kv))
    signals = signals.withColumns({"holding_period": table[F.col("edge_id")], "option_type": F.when(F.col("direction") == "LONG", "call").otherwise("put"), "step": strike_step(F.col("instrument"), steps)})
    value = atm_premium(F.col("price"), F.col("iv"), F.col("step"), F.col("option_type"), F.col("holding_period"))
    signals = signals.withColumn("_v", value).where("_v is not null")
    return signals.select("instrument", "direction", "day", "seq", "edge_id", "trigger_value", "holding_period", "option_type", "regime_state", at_the_money(F.col("price"), F.col("step")).alias("strike"), F.col("_v.price").alias("entry_premium"))


def greedy(signals: DataFrame, days: DataFrame, pairs: int) -> DataFrame:
    """The trades taken, with their exit days. The first signal of a day wins its pair; a pair is free again on its exit day."""
    # the first trading day on or after entry + holding period closes a trade
    exits = days.select(F.col("day").alias("exit_day"))
    first = W.partitionBy("instrument", "direction", "day").orderBy("seq")
    rows = signals.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("due", F.expr("date_add(day, holding_period)"))
    rows = next_day(rows, exits)
    if pairs > MAX_POSITIONS:
        return positions.taken(rows)
    fields = rows.schema.fields

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        free, keep = None, []
        for day, exit_day in zip(pdf["day"], pdf["exit_day"], strict=True):
            take = free is None or day >= free
            if take:
                free = NEVER if pd.isna(exit_day) else exit_day
            keep.append(take)
        return pdf[keep][[f.name for f in fields]]

    return rows.groupBy("instrument", "direction").applyInPandas(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))


def next_day(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Add exit_day: the first of ``days`` on or after ``due`` (null if none); days are few and looked up in one array."""
    all_days = days.agg(F.sort_array(F.collect_set("exit_day")).alias("_days"))  # one row
    later = F.expr("filter(_days, d -> d >= due)")
    return rows.crossJoin(F.broadcast(all_days)).withColumn("exit_day", F.try_element_at(later, F.lit(1))).drop("_days")


def closed_trades(trades: DataFrame, features: DataFrame) -> DataFrame:
    """Exit premium (intrinsic value: the holding period is over) and net return, floored by the stop."""
    rows = trades.where("exit_day is not null").withColumn("date", F.col("exit_day"))
    rows = asof(rows, features.select("instrument", "date", F.col("close").alias("exit_price")), "date", ["instrument"], ["exit_price"])
    value = black_scholes(F.col("exit_price"), F.col("strike"), F.lit(0.0), 0.0, F.lit(1.0), F.col("option_type"))
    rows = rows.withColumn("exit_premium", value["price"])
    pnl = F.greatest(F.try_divide(F.col("exit_premium") - F.col("entry_premium"), F.col("entry_premium")), F.lit(-OPTION_STOP))
    return rows.select(
        F.concat_ws("_", "edge_id", "instrument", F.date_format("day", "yyyy-MM-dd")).alias("trade_id"), "edge_id", "instrument", F.lit("INDEX_OPTIONS").alias("instrument_class"), "direction",
        "holding_period", F.col("day").alias("entry_date"), F.col("exit_day").alias("exit_date"), "entry_premium", "exit_premium", (pnl * 100).alias("net_return_pct"),
        F.col("regime_state").alias("regime_at_entry"), "trigger_value",
    )


def run(features: DataFrame, history: DataFrame, start: str, end: str, steps: dict[str, float] | None = None) -> DataFrame:
    days = trading_days(history, start, end)
    pairs = 2 * features.agg(F.count_distinct("instrument")).first()[0]
    return closed_trades(greedy(candidates(features, days, steps), days, pairs), features)


def daily_returns(trades: DataFrame) -> DataFrame:
    """(date, ret): mean return of the trades closed on each business day between the first and the last exit, 0 on others."""
    by_day = trades.groupBy(F.col("exit_date").alias("date")).agg((F.avg("net_return_pct") / 100).alias("ret"))
    span = by_day.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return span.join(by_day, "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def equity(daily: DataFrame) -> DataFrame:
    """Equity, its running maximum and drawdown; the peak starts with the first day's equity."""
    over = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = daily.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(over))).withColumn("peak", F.max("equity").over(over))
    return rows.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def log_growth(returns: Column, share: float = MAX_POSITION_SHARE) -> Column:
    """Logarithm of the growth over all returns (percent), each on a share of the capital; the growth itself is too large for a double from some ten thousand trades on."""
    return F.coalesce(F.sum(F.log1p(share * returns / 100)), F.lit(0.0))


def scorecard(trades: DataFrame) -> DataFrame:
    """(criterion, passed, actual, threshold), eight rows and ``all``."""
    total = trades.agg(
        win_rate(F.col("net_return_pct")).alias("win_rate"), profit_factor(F.col("net_return_pct") / 100).alias("profit_factor"), F.count("*").cast("double").alias("trades"),
        F.size(F.array_except(F.array(F.lit(2), F.lit(5), F.lit(10)), F.collect_set("holding_period"))).cast("double").alias("periods_missing"),
        F.count_distinct("instrument_class").cast("double").alias("classes"), log_growth(F.col("net_return_pct")).alias("growth"),
    )
    line = equity(daily_returns(trades)).agg(sharpe(F.col("ret")).alias("sharpe"), F.max(F.abs("drawdown")).alias("max_drawdown"), F.count("*").alias("days"))
    rows = total.crossJoin(F.broadcast(line))  # one row each
    cagr = F.expm1(F.col("growth") * 252 / F.greatest(F.col("days"), F.lit(1)))
    tests = [
        ("sharpe_gt_1", F.col("sharpe"), ">", 1.0), ("max_dd_lt_8pct", F.col("max_drawdown"), "<", 0.08), ("win_rate_gt_50pct", F.col("win_rate"), ">", 0.50),
        ("profit_factor_gt_1p4", F.col("profit_factor"), ">", 1.4), ("net_cagr_positive", cagr, ">", 0.0), ("min_100_trades", F.col("trades"), ">=", 100.0),
        ("all_holding_periods_covered", F.col("periods_missing"), "<=", 0.0), ("all_instruments_covered", F.col("classes"), ">=", 1.0),
    ]
    compare = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    each = [F.struct(F.lit(k).alias("criterion"), F.coalesce(compare[op](x, F.lit(limit)), F.lit(False)).alias("passed"), x.cast("double").alias("actual"), F.lit(limit).alias("threshold")) for k, x, op, limit in tests]
    out = rows.select(F.inline(F.array(*each)))
    return out.unionByName(out.agg(F.lit("all").alias("criterion"), F.bool_and("passed").alias("passed"), F.count_if("passed").cast("double").alias("actual"), F.lit(8.0).alias("threshold")))
