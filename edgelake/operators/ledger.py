"""Ledgers as tables: inserts that leave existing keys alone, keyed updates, and what outcomes do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.constants import USD_PROXY
from edgelake.functions.windows import true
from edgelake.operators.asof import asof


def insert_absent(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with the rows whose key it doesn't hold; of rows that share a key the first by ``order`` enters, or the smallest row."""
    new = rows.join(table.select(key), key, "left_anti")
    first = W.partitionBy(key).orderBy(*([order] if order else []), F.to_json(F.struct(*rows.columns)))
    new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return table.unionByName(new.select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of ``changes`` in the rows of its keys; nulls are written too. Keys of changes are unique."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key), F.struct(*names).alias("_new"))
    rows = table.join(new, key, "left")
    return rows.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Union of both where the newer row of a key wins; of new rows that share a key the last by ``order``, or the largest row."""
    both = old.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)))
    last = W.partitionBy(*keys).orderBy(F.desc("_source"), *([F.desc(order)] if order else []), F.desc(F.to_json(F.struct(*old.columns))))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_source")


def append_newer(history: DataFrame, fresh: DataFrame, on: str = "date") -> DataFrame:
    """History with the fresh rows after its last one; what it holds is never revised."""
    last = history.agg(F.max(on).alias("_last"))
    return history.unionByName(fresh.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(on) > F.col("_last"))).drop("_last"))


def shadow_outcomes(ledger: DataFrame, prices: DataFrame, as_of: str, index: str = "NIFTY") -> DataFrame:
    """(signal_id, shadow_outcome, shadow_return_pct, exit_date) of signals without an outcome.

    A signal leaves after one and a half holding periods in calendar days, or on ``as_of`` if that is sooner; both prices are
    the last on or before their day. A decision that names SHORT turns the sign.
    """
    today = F.lit(as_of).cast("date")
    rows = ledger.where(F.col("shadow_outcome").isNull() & (F.col("signal_date") <= today))
    proxy = F.create_map(*(F.lit(x) for kv in ({"ALL_INDICES": index} | USD_PROXY).items() for x in kv))
    rows = rows.select(
        "signal_id", "ai2_decision", F.coalesce(F.try_element_at(proxy, F.col("underlying")), F.col("underlying")).alias("instrument"), F.col("signal_date").alias("date"),
        F.least(today, F.date_add("signal_date", (F.col("holding_period") * 1.5).cast("int"))).alias("leave"),
    )
    closes = prices.select("instrument", "date", "close", F.col("date").alias("found"))
    rows = asof(rows, closes, "date", ["instrument"], ["close"]).select("signal_id", "ai2_decision", "instrument", F.col("leave").alias("date"), F.col("close").alias("entry"))
    rows = asof(rows, closes, "date", ["instrument"], ["close", "found"]).where("entry is not null and close is not null and entry <> 0")
    side = F.when(true(F.contains("ai2_decision", F.lit("SHORT"))), -1.0).otherwise(1.0)
    gain = side * (F.col("close") - F.col("entry")) / F.col("entry")
    return rows.select("signal_id", F.when(gain > 0, "WIN").otherwise("LOSS").alias("shadow_outcome"), (gain * 100).alias("shadow_return_pct"), F.col("found").alias("exit_date"))


def rejection_analysis(ledger: DataFrame) -> DataFrame:
    """Count and win rate by edge and decision; rows without either key are left out, an open outcome is no win."""
    rows = ledger.where("edge_id is not null and ai2_decision is not null")
    wins = F.coalesce(F.col("shadow_outcome") == "WIN", F.lit(False)).cast("double")
    return rows.groupBy("edge_id", "ai2_decision").agg(F.count("signal_id").alias("count"), F.avg(wins).alias("win_rate"))


def hit_rates(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Edges with wins and losses raised by the outcomes, and the live hit rate."""
    sums = outcomes.groupBy("edge_id").agg(F.count_if(true(F.col("net_return_pct") > 0)).alias("_w"), F.count("*").alias("_n"))
    rows = edges.join(sums, "edge_id", "left")
    rows = rows.withColumns({"live_wins": F.col("live_wins") + F.coalesce("_w", F.lit(0)), "live_losses": F.col("live_losses") + F.coalesce(F.col("_n") - F.col("_w"), F.lit(0))})
    total = F.col("live_wins") + F.col("live_losses")
    rate = F.when(F.col("_n").isNotNull() & (total > 0), F.try_divide(F.col("live_wins"), total)).otherwise(F.col("live_hit_rate"))
    return rows.withColumn("live_hit_rate", rate).select(*edges.columns)


def decay(win_rate: Column, wins: Column, losses: Column) -> Column:
    """A struct (watch_flag, posterior_win_rate, decay_flag): a beta posterior with a prior of 20 trades at the historical rate."""
    rate = F.when(F.coalesce(win_rate, F.lit(0.0)) == 0, 0.5).otherwise(win_rate)
    w, n = F.coalesce(wins, F.lit(0)), F.coalesce(wins, F.lit(0)) + F.coalesce(losses, F.lit(0))
    posterior = (rate * 20 + w) / (20 + n)
    watch = (posterior < rate - 0.05) & (n >= 20)
    return F.struct(watch.alias("watch_flag"), F.when(watch, posterior).alias("posterior_win_rate"), ((posterior < rate - 0.08) & (n >= 30)).alias("decay_flag"))


def log_rows(history: DataFrame, chosen: list[str]) -> DataFrame:
    """Rows of the observation log: an id made of the key and the chosen columns as JSON, nulls kept."""
    details = F.to_json(F.struct(*chosen), {"ignoreNullFields": "false"})
    key = F.sha2(F.concat_ws("|", F.col("date").cast("string"), "regime_state"), 256)
    return history.select(key.alias("observation_id"), "date", "regime_state", "regime_confidence", details.alias("details"))


def trade_close(outcomes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """What closed trades write: the trade log, the bandit's replay, the thresholds' observations, signal updates and edges with new hit rates and decay flags.

    Rewards and gains are returns in percent, as they are.
    """
    won = true(F.col("net_return_pct") > 0)
    log = outcomes.select("trade_id", "edge_id", "instrument_class", "direction", "holding_period", "net_return_pct", "regime_at_entry", "exit_date", won.cast("int").alias("won"))
    replay = outcomes.where("bandit_action is not null").select(F.concat(F.lit("R_"), "trade_id").alias("transition_id"), F.col("bandit_action").alias("action"), F.col("net_return_pct").alias("reward"), F.coalesce("bandit_context", F.array_repeat(F.lit(0.0), 10)).alias("context"))
    observed = outcomes.select(F.coalesce("trigger_feature", F.lit("z_21d_threshold")).alias("param"), F.coalesce("trigger_value", F.lit(0.0)).alias("threshold"), F.col("net_return_pct").alias("pnl"))
    signals = outcomes.select("signal_id", F.when(won, "WIN").otherwise("LOSS").alias("shadow_outcome"), F.col("net_return_pct").alias("shadow_return_pct"), "exit_date")
    rated = hit_rates(edges, outcomes).withColumn("_d", decay(F.col("win_rate"), F.col("live_wins"), F.col("live_losses")))
    rated = rated.withColumns({"decay_flag": F.greatest("decay_flag", F.col("_d.decay_flag").cast("int")), "status": F.when(F.col("_d.decay_flag"), "DECAYED").otherwise(F.col("status"))})
    return {"log": log, "replay": replay, "observations": observed, "signals": signals, "edges": rated.select(*edges.columns)}


def save_state(rows: DataFrame, path: str, version: int) -> None:
    """Learner state as a table; each version is a folder of its own, so readers never see half of one."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_state(spark, path: str, default: DataFrame) -> DataFrame:
    """The latest saved version, or ``default`` where none can be read."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return default
    last = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == last).drop("version")
