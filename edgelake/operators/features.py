"""The daily feature table of every instrument: 24 columns in one pass over one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.constants import IV_MULTIPLIER
from edgelake.functions.windows import by_instrument, change, log_return, rolling, rsi, sample_skew, true


def with_features(bars: DataFrame) -> DataFrame:
    """All feature columns, before rows without ret_1d, z_21d or rsi_2 are dropped."""
    over, close = by_instrument(), F.col("close")
    before = F.lag(close).over(over)
    rows = bars.withColumns(
        {
            "_before": before,
            "_change": close - before,
            "_n": F.row_number().over(over),
            "ret_1d": log_return(close),
            **{f"mom_{n}d": change(close, n) for n in (5, 10, 20, 60)},
            "_mean_21": rolling(F.avg(close), close, 21),
            "_std_21": rolling(F.stddev_samp(close), close, 21),
            "rolling_max_252": rolling(F.max(close), close, 252),
            "rolling_min_252": rolling(F.min(close), close, 252),
        }
    )
    ret, move = F.col("ret_1d"), F.col("_change")
    up, down = true(move > 0), true(move < 0)
    rows = rows.withColumns(
        {
            "vol_5d": rolling(F.stddev_samp(ret), ret, 5),
            "vol_20d": rolling(F.stddev_samp(ret), ret, 20),
            "_ret_mean_20": rolling(F.avg(ret), ret, 20),
            "ret_skew_20": sample_skew(ret, 20),
            "rsi_2": rsi(move, 2),
            "rsi_14": rsi(move, 14),
            # a streak counts from the last row that breaks it; the first row always does
            "_up_from": F.max(F.when(~up, F.col("_n"))).over(over.rowsBetween(W.unboundedPreceding, 0)),
            "_down_from": F.max(F.when(~down, F.col("_n"))).over(over.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    width = F.nullif(F.col("rolling_max_252") - F.col("rolling_min_252"), F.lit(0.0))
    gap = F.try_divide(F.col("open") - F.col("_before"), F.col("_before"))
    return rows.select(
        "instrument", "date", "close", "ret_1d", "mom_5d", "mom_10d", "mom_20d", "mom_60d", "vol_5d", "vol_20d",
        F.try_divide("vol_5d", F.nullif("vol_20d", F.lit(0.0))).alias("vol_ratio_vols"),
        true(F.col("vol_5d") > F.col("vol_20d")).cast("int").alias("vol_expanding"),
        ((close - F.col("_mean_21")) / F.nullif("_std_21", F.lit(0.0))).alias("z_21d"),
        "rsi_2", "rsi_14", "rolling_max_252", "rolling_min_252",
        ((close - F.col("rolling_max_252")) / width).alias("pct_from_hi"),
        ((close - F.col("rolling_min_252")) / width).alias("pct_from_lo"),
        ((ret - F.col("_ret_mean_20")) / F.nullif("vol_20d", F.lit(0.0))).alias("ret_zscore"),
        "ret_skew_20", (F.col("_n") - F.col("_up_from")).cast("long").alias("up_streak"), (F.col("_n") - F.col("_down_from")).cast("long").alias("down_streak"),
        gap.alias("gap_pct"), true((gap < -0.01) & (close < F.col("_before"))).cast("int").alias("gap_unfilled_eod"),
    )


def features(bars: DataFrame) -> DataFrame:
    """The feature table. Rows whose last two changes hold no loss have no rsi_2 and are dropped with it."""
    return with_features(bars).dropna(subset=["ret_1d", "z_21d", "rsi_2"])


def synthetic_iv(prices: DataFrame, n: int = 20, multiplier: float = IV_MULTIPLIER) -> DataFrame:
    """Add ret and iv: the annualized deviation of the last n log returns, scaled. Rows count, not days."""
    out = prices.withColumn("ret", log_return(F.col("close")))
    return out.withColumn("iv", rolling(F.stddev_samp("ret"), F.col("ret"), n) * (252**0.5) * multiplier)
