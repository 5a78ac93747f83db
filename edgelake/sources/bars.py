"""Daily bars: files, clean-up, synthetic series and storage by instrument."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR = "instrument string, date date, open double, high double, low double, close double, volume long"
# Start price, annual drift and annual volatility of the synthetic series.
SERIES = {
    "NIFTY": (5200.0, 0.115, 0.16), "BANKNIFTY": (9000.0, 0.130, 0.20), "FINNIFTY": (8000.0, 0.110, 0.18), "MIDCPNIFTY": (6000.0, 0.090, 0.20),
    "GOLD_USD": (1100.0, 0.060, 0.15), "SILVER_USD": (17.0, 0.040, 0.28), "CRUDE_USD": (80.0, 0.000, 0.40), "COPPER_USD": (3.50, 0.025, 0.22),
    "USDINR": (46.0, 0.040, 0.06), "EURINR": (65.0, 0.020, 0.08), "GBPINR": (75.0, 0.022, 0.09), "JPYINR": (0.50, 0.005, 0.09),
    "EURUSD": (1.43, -0.020, 0.08), "GBPUSD": (1.61, -0.020, 0.08), "USDJPY": (93.0, 0.030, 0.09),
}
# First and last day of a market phase, daily drift and deviation of the index, mean of its volatility index and how much that varies.
PHASES = [
    ("2010-01-01", "2010-10-31", 0.0008, 0.0095, 18.0, 0.8), ("2010-11-01", "2011-12-31", -0.0003, 0.0135, 24.0, 1.2), ("2012-01-01", "2013-08-31", 0.0002, 0.0085, 17.0, 0.7),
    ("2013-09-01", "2014-04-30", 0.0003, 0.0090, 15.0, 0.7), ("2014-05-01", "2015-12-31", 0.0010, 0.0075, 14.0, 0.6), ("2016-01-01", "2016-02-28", -0.0007, 0.0120, 22.0, 1.1),
    ("2016-03-01", "2016-10-31", 0.0008, 0.0070, 13.0, 0.6), ("2016-11-01", "2016-12-31", -0.0008, 0.0130, 21.0, 1.0), ("2017-01-01", "2017-12-31", 0.0009, 0.0065, 12.0, 0.5),
    ("2018-01-01", "2019-03-31", -0.0002, 0.0100, 20.0, 0.9), ("2019-04-01", "2020-01-31", 0.0005, 0.0085, 14.5, 0.7), ("2020-02-01", "2020-03-23", -0.0055, 0.0250, 55.0, 3.0),
    ("2020-03-24", "2020-12-31", 0.0015, 0.0130, 22.0, 1.2), ("2021-01-01", "2021-10-31", 0.0010, 0.0072, 13.0, 0.6), ("2021-11-01", "2022-06-30", -0.0003, 0.0105, 22.0, 1.0),
    ("2022-07-01", "2023-12-31", 0.0007, 0.0082, 13.5, 0.7), ("2024-01-01", "2024-05-31", 0.0008, 0.0075, 13.0, 0.6), ("2024-06-01", "2026-12-31", 0.0005, 0.0090, 15.0, 0.8),
]
OUTSIDE = (0.0004, 0.0090, 16.0, 0.8)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by instrument; the filter on it prunes folders."""
    return clean(spark.read.parquet(path))


def read_folder(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """All files of a folder in one scan, the instrument taken from the file name."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), f"{suffix.replace('.', '[.]')}$", "")
    return spark.read.option("pathGlobFilter", f"*{suffix}").parquet(path).withColumn("instrument", name)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, close) of a CSV file whose price column is ``close`` or ``Close``; rows without either are dropped."""
    rows = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in rows.columns}
    return rows.select(F.try_to_date(names["date"]).alias("date"), F.expr(f"try_cast(`{names['close']}` as double)").alias("close")).dropna()


def clean(bars: DataFrame) -> DataFrame:
    """Lower-case names, days without time, NaN as null, and no row without a close."""
    out = bars.toDF(*(c.lower() for c in bars.columns)).withColumn("date", F.to_date("date"))
    numbers = [f.name for f in out.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in numbers}).dropna(subset=["close"])


def write_bars(bars: DataFrame, path: str) -> None:
    """Overwrite the instruments that ``bars`` holds, and no others."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument").parquet(path)


def resolve_source(*candidates: tuple[str, object]) -> DataFrame:
    """The first candidate (name, function giving a DataFrame) that can be read and has rows, with a column ``source``."""
    failures = []
    for name, make in candidates:
        try:
            rows = make()
            if not rows.isEmpty():
                return rows.withColumn("source", F.lit(name))
            failures.append(f"{name}: no rows")
        except Exception as error:  # noqa: BLE001  any failure of a source hands over to the next
            failures.append(f"{name}: {type(error).__name__}")
    raise ValueError("no source has rows: " + "; ".join(failures))


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.sql("select explode(sequence(cast(:a as date), cast(:b as date))) as date", args={"a": start, "b": end})
    return days.where(F.weekday("date") < 5)


def synthetic_bars(spark: SparkSession, start: str, end: str, series: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Geometric Brownian bars; each instrument's numbers come from the CRC of its name, so they are the same everywhere."""
    table = series or SERIES
    days = business_days(spark, start, end)
    names = spark.createDataFrame([(k, *v) for k, v in table.items()], "instrument string, start double, drift double, vol double")
    rows = days.crossJoin(F.broadcast(names))
    uniform = lambda k: (F.pmod(F.xxhash64("instrument", "date", F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(uniform(k))) * F.cos(2 * np.pi * uniform(k + 1))
    over = W.partitionBy("instrument").orderBy("date")
    rows = rows.withColumns({"_r": F.col("drift") / 252 + F.col("vol") / np.sqrt(252) * normal(0), "_d": F.col("vol") / np.sqrt(252) * 0.5})
    rows = rows.withColumn("close", F.round(F.col("start") * F.exp(F.sum("_r").over(over)), 4))
    rows = rows.withColumn("open", F.round(F.coalesce(F.lag("close").over(over) * (1 + F.col("_d") * normal(2)), F.col("close")), 4))
    move = lambda k: F.abs(F.col("_d") * normal(k))
    rows = rows.withColumns({"high": F.greatest("open", "close", F.round(F.col("close") * (1 + move(4)), 4)), "low": F.least("open", "close", F.round(F.col("close") * (1 - move(6)), 4))})
    return rows.select("instrument", "date", "open", "high", "low", "close", (1e5 + 9.9e6 * uniform(8)).cast("long").alias("volume"))


def mean_reverting(spark: SparkSession, start: str, end: str, kappa: float = 0.05, theta: float = 16.0, sigma: float = 1.5, jump: float = 4.0, share: float = 0.005, floor: float = 8.0) -> DataFrame:
    """(date, close): a mean-reverting series with jumps and a floor, from its mean; each value needs the one before, so the series is one group."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rng, level, out = np.random.default_rng(zlib.crc32(b"VIX")), theta, [theta][: len(pdf)]
        for shock, luck in zip(rng.standard_normal(len(pdf))[1:], rng.random(len(pdf))[1:], strict=True):
            level = max(floor, level + kappa * (theta - level) + sigma * shock + (jump if luck < share else 0.0))
            out.append(level)
        return pd.DataFrame({"date": pdf["date"], "close": out})

    return business_days(spark, start, end).groupBy(F.lit("all")).applyInPandas(work, "date date, close double")


def regime_paths(spark: SparkSession, start: str, end: str, phases: list[tuple[str, str, float, float, float, float]] = PHASES, default: tuple[float, float, float, float] = OUTSIDE) -> DataFrame:
    """(date, close, vix): an index whose daily returns follow dated phases, and a volatility index that reverts to the phase's mean.

    The last phase that holds a day wins; ``default`` counts outside of all.
    """
    from edgelake.operators.asof import in_range

    table = spark.createDataFrame([(i, *p) for i, p in enumerate(phases)], "seq int, start string, end string, drift double, vol double, mean double, vary double")
    table = table.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    days = in_range(business_days(spark, start, end), table, "date", dict(zip(("drift", "vol", "mean", "vary"), default, strict=True)))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rng, level, vix, closes, vixes = np.random.default_rng(42), 5200.0, 16.0, [], []
        for drift, vol, mean, vary in zip(pdf["drift"], pdf["vol"], pdf["mean"], pdf["vary"], strict=True):
            level *= np.exp(rng.normal(drift, vol))
            vix = max(8.0, vix + 0.05 * (mean - vix) + rng.normal(0, mean * 0.08 * vary))
            closes.append(level)
            vixes.append(vix)
        return pd.DataFrame({"date": pdf["date"], "close": closes, "vix": vixes})

    return days.groupBy(F.lit("all")).applyInPandas(work, "date date, close double, vix double")


def summary(bars: DataFrame, needed: str = "2015-01-01") -> DataFrame:
    """Span and rows of each instrument, and whether its history begins late."""
    out = bars.groupBy("instrument").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("rows"))
    return out.withColumn("status", F.when(F.col("start") > F.lit(needed).cast("date"), "INSUFFICIENT_HISTORY").otherwise("OK"))


def in_session(ts: Column, start: str, end: str) -> Column:
    """Whether a time of day on Monday to Friday lies between two HH:MM, both included."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    at = lambda s: int(s[:2]) * 60 + int(s[3:])
    return (F.weekday(ts) < 5) & minutes.between(at(start), at(end))
