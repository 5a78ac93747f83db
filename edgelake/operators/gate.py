"""Rules that admit, rank and size signals. Each rule chain is one conditional expression in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.constants import (
    BANDIT_TRADES, CAPITAL, CONFIDENT, MAX_MARGIN_SHARE, MAX_POSITION_SHARE, MAX_POSITIONS, META_THRESHOLD, META_TRADES, SLIPPAGE_FUTURES, SLIPPAGE_OPTIONS, SLOTS, THETA_STOP, UNSURE,
    VIX_SPIKE, WAIT_DAYS,
)


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def liquidity_reason(klass: Column, oi: Column, spread: Column, volume: Column) -> Column:
    """Why a signal isn't liquid, or null; unknown open interest or volume is 0, an unknown spread 1."""
    option, commodity, currency = klass == "INDEX_OPTIONS", klass == "COMMODITY_FUTURES", klass == "CURRENCY_FUTURES"
    traded = F.coalesce(volume, F.lit(0))
    return (
        F.when(option & (F.coalesce(oi, F.lit(0)) < 100), "INSUFFICIENT_OI")
        .when(option & (F.coalesce(spread, F.lit(1.0)) > 0.08), "BID_ASK_TOO_WIDE")
        .when((commodity & (traded < 500)) | (currency & (traded < 1000)), "INSUFFICIENT_VOLUME")
    )


def risk(signals: DataFrame, positions: DataFrame, capital: float = CAPITAL, lots: int = 1, halted: str | None = None) -> DataFrame:
    """Add reason: the first failing check of ten, or OK. Sums of the book are joined; whether by broadcast is left to Spark."""
    book = positions.agg(F.count("*").alias("_open"), F.coalesce(F.sum("margin"), F.lit(0.0)).alias("_margin"))
    classes = positions.groupBy("instrument_class").agg(F.count("*").alias("_class"))
    names = positions.groupBy("underlying").agg(F.count("*").alias("_name"))
    held = positions.select("underlying", "direction", "holding_period").distinct().withColumn("_held", F.lit(True))
    rows = signals.crossJoin(F.broadcast(book)).join(classes, "instrument_class", "left").join(names, "underlying", "left")  # the book's totals are one row
    rows = rows.join(held, ["underlying", "direction", "holding_period"], "left")
    illiquid = liquidity_reason(F.col("instrument_class"), F.col("oi_lots"), F.col("bid_ask_spread_pct"), F.col("daily_volume_lots"))
    reason = (
        F.when(F.lit(halted is not None), f"SYSTEM_HALTED: {halted}")
        .when(F.col("transition_warning_flag"), "TRANSITION_WATCH_ACTIVE")
        .when(F.col("_open") >= MAX_POSITIONS, "MAX_POSITIONS_REACHED")
        .when(F.col("lot_value") * lots > capital * MAX_POSITION_SHARE, "POSITION_SIZE_EXCEEDS_7pct_CAPITAL")
        .when(F.col("_margin") + F.col("margin_per_lot") * lots > capital * MAX_MARGIN_SHARE, "MARGIN_LIMIT_EXCEEDED")
        .when(F.col("_class") >= 2, F.concat(F.lit("ASSET_CLASS_CONCENTRATION_"), "instrument_class"))
        .when(F.col("_name") >= 2, F.concat(F.lit("UNDERLYING_CONCENTRATION_"), "underlying"))
        .when(F.col("margin_per_lot") > capital, "CANNOT_AFFORD_SINGLE_LOT")
        .when(illiquid.isNotNull(), illiquid)
        .when(F.col("_held"), "DUPLICATE_POSITION_TUPLE")
        .otherwise("OK")
    )
    return rows.withColumn("reason", reason).select(*signals.columns, "reason")


def strong(edge: Column, direction: Column, value: Column) -> Column:
    """SEED-001 and SEED-003 need a trigger value of at least 1.5 on their side."""
    weak = edge.isin("SEED-001", "SEED-003") & (((direction == "LONG") & (value > -1.5)) | ((direction == "SHORT") & (value < 1.5)))
    return ~F.coalesce(weak, F.lit(False))


def validate(signals: DataFrame, positions: DataFrame, edges: DataFrame, capital: float = CAPITAL, meta_trades: int = 0) -> DataFrame:
    """Add decision and reason: risk, transition, decay, strength, then the meta score once it's active. An unknown edge isn't decayed."""
    rows = risk(signals, positions, capital).join(edges.select("edge_id", F.col("decay_flag").alias("_decay")), "edge_id", "left")
    score = F.col("meta_score") if "meta_score" in signals.columns else F.lit(0.6)
    reason = (
        F.when(F.col("reason") != "OK", F.col("reason"))
        .when(F.coalesce("_decay", F.lit(0)) == 1, "EDGE_DECAYED")
        .when(~strong(F.col("edge_id"), F.col("direction"), F.col("trigger_value")), "SIGNAL_STRENGTH_INSUFFICIENT")
        .when(F.lit(meta_trades >= META_TRADES) & (score < META_THRESHOLD), F.format_string("META_SCORE_%.3f", score.cast("double")))
        .otherwise("OK")
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("decision", F.when(F.col("reason") == "OK", "APPROVED").otherwise("REJECTED")).drop("_decay")


def slots(positions: DataFrame) -> DataFrame:
    """(holding_period, used, most, free) of every slot."""
    table = positions.sparkSession.createDataFrame(list(SLOTS.items()), "holding_period int, most int")
    used = positions.groupBy("holding_period").agg(F.count("*").alias("used"))
    out = F.broadcast(table).join(used, "holding_period", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.withColumn("free", F.col("used") < F.col("most"))


def score(win_rate: Column, confidence: Column) -> Column:
    return F.coalesce(win_rate, F.lit(0.5)) + F.when(F.coalesce(confidence, F.lit(0.0)) > CONFIDENT, 0.05).otherwise(0.0)


def select_trades(signals: DataFrame, positions: DataFrame, arrival: str, by: list[str] | None = None, per_class: int = 2) -> DataFrame:
    """Free slots, then the first two of a class, then the first of an underlying and direction; add score and rank.

    ``by`` names the columns of a batch; each batch is selected by itself.
    """
    by = by or []
    rows = signals.join(F.broadcast(slots(positions).where("free").select("holding_period")), "holding_period", "left_semi")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by, "instrument_class").orderBy(arrival))).where(F.col("_n") <= per_class)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by, "underlying", "direction").orderBy(arrival))).where("_n = 1").drop("_n")
    rows = rows.withColumn("score", score(F.col("edge_win_rate"), F.col("confidence")))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), arrival)))


def bandit_cold(meta_score: Column) -> Column:
    return F.when(meta_score > 0.65, "MEDIUM").when(meta_score > META_THRESHOLD, "SMALL").otherwise("SKIP")


def size(signals: DataFrame, capital: float = CAPITAL, trades: int = 0) -> DataFrame:
    """Add size_multiplier, recommended_lots and confidence_score; the bandit's action decides once it has seen enough trades.

    A margin of zero says nothing of how many lots can be held (division by zero gives null), so one lot is left.
    """
    confidence = F.col("confidence")
    tier = F.when(confidence >= CONFIDENT, 1.0).when(confidence >= UNSURE, 0.75).otherwise(0.50)
    if trades >= BANDIT_TRADES:
        tier = F.coalesce(F.try_element_at(literal_map({"SKIP": 0.0, "SMALL": 0.5, "MEDIUM": 1.0, "LARGE": 1.5}), F.col("bandit_action")), tier)
    lots = F.greatest(F.lit(1), F.floor(F.try_divide(capital * MAX_POSITION_SHARE * F.col("size_multiplier"), F.coalesce("margin_per_lot", F.lit(50_000.0)))))
    rows = signals.withColumn("size_multiplier", tier)
    return rows.withColumns({"recommended_lots": F.when(F.col("size_multiplier") == 0, 0).otherwise(lots).cast("long"), "confidence_score": confidence * F.col("size_multiplier")})


def mid_hold_exit(option: Column, theta: Column, days: Column, move: Column, vix: Column, basis: Column) -> Column:
    """The first reason to leave a position, or HOLD."""
    option = F.coalesce(option, F.lit(False))
    return (
        F.when(option & (theta > THETA_STOP), "THETA_STOP")
        .when(days >= 15, "HARD_EXPIRY")
        .when(move > 2.5, "VOL_SPIKE")
        .when(option & (vix > VIX_SPIKE), "VIX_SPIKE_OPTION_EXIT")
        .when(F.abs(basis) > 2.0, "BASIS_DISLOCATION")
        .otherwise("HOLD")
    )


def max_slippage(klass: Column, holding: Column) -> Column:
    option = F.try_element_at(literal_map(SLIPPAGE_OPTIONS), holding)
    return F.when(klass == "INDEX_OPTIONS", option).otherwise(F.try_element_at(literal_map(SLIPPAGE_FUTURES), holding))


def still_waiting(added: Column, today: Column, holding: Column) -> Column:
    """Whether a waiting signal hasn't expired: its age is within its holding period's limit."""
    return F.datediff(today, added) <= F.try_element_at(literal_map(WAIT_DAYS), holding)


def close_book(closes: list[float], capital: float = CAPITAL) -> dict:
    """Daily pnl, peak, drawdown and halt after closing trades in order. Drawdown is that of each trade against the peak."""
    daily, peak, drawdown, halt = 0.0, capital, 0.0, None
    for pnl in closes:
        daily += pnl
        peak = max(peak, capital + pnl)
        drawdown = (peak - capital - pnl) / peak
        if halt is None and drawdown > 0.08:
            halt = f"DRAWDOWN_{drawdown:.1%}"
        if halt is None and daily < -0.04 * capital:
            halt = "SINGLE_DAY_LOSS_4PCT"
    return {"daily_pnl": daily, "peak": peak, "drawdown": drawdown, "halt": halt}


def book_states(closes: DataFrame, by: str, order: list[str], capital: float = CAPITAL) -> DataFrame:
    """The running state of close_book() after every close (pnl), for each ``by``, as window aggregates."""
    over = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    peak = F.greatest(F.lit(capital), F.max(capital + F.col("pnl")).over(over))
    rows = closes.withColumns({"daily_pnl": F.sum("pnl").over(over), "peak": peak})
    rows = rows.withColumn("drawdown", (F.col("peak") - capital - F.col("pnl")) / F.col("peak"))
    deep = F.when(F.col("drawdown") > 0.08, F.concat(F.lit("DRAWDOWN_"), F.format_string("%.1f%%", F.col("drawdown") * 100)))
    reason = F.coalesce(deep, F.when(F.col("daily_pnl") < -0.04 * capital, "SINGLE_DAY_LOSS_4PCT"))
    return rows.withColumn("_reason", reason).withColumn("halt", F.first("_reason", ignorenulls=True).over(over)).drop("_reason")


def after_reset(halt: Column) -> Column:
    """The halt that is left on a new day."""
    return F.when(halt != "SINGLE_DAY_LOSS_4PCT", halt)


def daily_reset(book: dict) -> dict:
    """A new day clears the day's pnl, and a halt for the day's loss only."""
    return book | {"daily_pnl": 0.0, "halt": None if book["halt"] == "SINGLE_DAY_LOSS_4PCT" else book["halt"]}
