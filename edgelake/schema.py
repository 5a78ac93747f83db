"""Declared schemas of the ledgers and of what the operators exchange; money is double, days are dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = {
    "bars": "instrument string, date date, open double, high double, low double, close double, volume bigint",
    "regime_history": "date date, regime_state string, regime_confidence double, hmm_state_int int, prob_H_BULL double, prob_L_BULL double, prob_SIDEWAYS double, prob_L_BEAR double, prob_H_BEAR double, "
    "transition_warning_flag boolean, index_close double, vix_close double",
    "positions": "trade_id string, instrument_class string, underlying string, direction string, holding_period int, margin double",
    "edges": "edge_id string, holding_period int, edge_regime string, edge_direction string, win_rate double, status string, decay_flag int, live_wins bigint, live_losses bigint, live_hit_rate double, underlying string",
    "signals": "signal_id string, edge_id string, instrument string, underlying string, date date, direction string, option_type string, holding_period int, trigger_feature string, trigger_value double, regime_state string",
    "signal_ledger": "signal_id string, edge_id string, signal_date date, underlying string, holding_period int, ai2_decision string, shadow_outcome string, shadow_return_pct double, exit_date date",
    "trade_log": "trade_id string, edge_id string, instrument_class string, direction string, holding_period int, net_return_pct double, regime_at_entry string, exit_date date, won int",
    "replay": "transition_id string, action string, reward double, context array<double>",
    "observations": "observation_id string, date date, regime_state string, regime_confidence double, details string",
    "versions": "version_id string, component string, version string, created date, note string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conform(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a declared table in its order and types; missing ones are null, others go."""
    have = set(rows.columns)
    return rows.selectExpr(*(f"cast({f.name if f.name in have else 'null'} as {f.dataType.simpleString()}) as {f.name}" for f in schema(name).fields))


def missing(rows: DataFrame, name: str) -> list[str]:
    """Declared columns that rows lack, in the declared order."""
    return [f for f in schema(name).fieldNames() if f not in rows.columns]
