"""Forward-return statistics of the edges in and out of sample, and the acceptance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.constants import OPTION_STOP
from edgelake.functions.stats import floored, p_value, t_statistic, win_rate
from edgelake.operators.triggers import POOLED


def segment_of(date: Column, train: tuple[str, str], test: tuple[str, str]) -> Column:
    between = lambda w: date.between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))
    return F.when(between(train), "IS").when(between(test), "OOS")


def edge_statistics(triggers: DataFrame, train: tuple[str, str], test: tuple[str, str], singles: dict[str, str]) -> DataFrame:
    """(edge_id, segment, n, win_rate, avg_return, avg_return_net, t_stat) of triggered rows.

    Pooled edges leave out rows without a forward return; those of one instrument (``singles``) count them, as losses.
    """
    rows = triggers.where("hit").withColumn("segment", segment_of(F.col("date"), train, test)).where("segment is not null")
    own = F.create_map(*(F.lit(x) for kv in singles.items() for x in kv))
    pooled = F.col("edge_id").isin(POOLED)
    rows = rows.where((pooled & F.col("forward").isNotNull()) | (~pooled & (F.try_element_at(own, F.col("edge_id")) == F.col("instrument"))))
    rows = rows.withColumn("ret", F.col("forward") * F.col("direction")).withColumn("net", floored(F.col("ret"), -OPTION_STOP))
    return rows.groupBy("edge_id", "segment").agg(
        F.count("*").alias("n"), win_rate(F.col("ret")).alias("win_rate"), F.avg("ret").alias("avg_return"), F.avg("net").alias("avg_return_net"), t_statistic(F.col("net")).alias("t_stat")
    )


def with_p_value(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p_value", p_value(F.col("t_stat"), F.col("n").cast("double")))


def gate(stats: DataFrame, edges: list[str]) -> DataFrame:
    """(edge_id, n, win_rate, avg_return_net, oos_win_rate, status, reason): the reasons to fail, joined in a fixed order."""
    spark = stats.sparkSession
    names = spark.createDataFrame([(e,) for e in edges], "edge_id string")
    of = lambda s: stats.where(F.col("segment") == s)
    rows = F.broadcast(names).join(of("IS").select("edge_id", "n", "win_rate", "avg_return_net"), "edge_id", "left")
    rows = rows.join(of("OOS").select("edge_id", F.col("win_rate").alias("oos_win_rate")), "edge_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.concat_ws(
        ", ",
        F.when(F.col("n") < 30, "INSUFFICIENT_DATA"),
        F.when(F.col("win_rate") <= 0.50, "FAILED_WIN_RATE"),
        F.when(F.col("avg_return_net") <= 0, "FAILED_AVG_RETURN"),
        F.when(F.col("oos_win_rate") < F.col("win_rate") - 0.08, "OOS_DIVERGENCE"),
    )
    rows = rows.withColumn("reason", F.nullif(reason, F.lit("")))
    return rows.withColumn("status", F.when(F.col("reason").isNull(), "ACTIVE").otherwise("FAILED_REVALIDATION"))
