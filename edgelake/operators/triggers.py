"""Trigger rules over feature rows, in three modes that differ as their purposes do.

``revalidate`` judges every row without a regime but for SEED-004; ``backtest`` knows SEED-001 to 004 and asks for the
regime; ``live`` takes the edges of a table, whose regime must be contained in the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.constants import BULL
from edgelake.functions.windows import by_instrument, rolling, true

#: holding period of each edge's revalidation
HOLDING = {"SEED-001": 5, "SEED-002": 2, "SEED-003": 5, "SEED-004": 10, "SEED-005": 5, "SEED-006": 10}
#: of single instruments; the others pool all instruments
POOLED = ["SEED-001", "SEED-002", "SEED-003", "SEED-004"]


def momentum() -> Column:
    return true((F.col("mom_5d") > 0) & (F.col("rsi_14") > 55) & (F.col("vol_expanding") == 0))


def beyond(limit: float) -> tuple[Column, Column]:
    """A z-score beyond a limit on either side, bought low and sold high."""
    z = F.col("z_21d")
    return true(F.abs(z) > limit), F.when(true(z < -limit), 1).otherwise(-1)


def revalidation_triggers(features: DataFrame, regimes: DataFrame) -> DataFrame:
    """(instrument, date, close, edge_id, hit, direction, forward): six rows a feature row, forward being the log return over
    the edge's holding period, counted in feature rows."""
    over = by_instrument()
    rows = features.join(regimes.select("date", "regime_state"), "date", "left")
    close = F.col("close")
    rows = rows.withColumns(
        {
            "_low": true(F.col("rsi_2") < 10),
            "_sma_50": rolling(F.avg(close), close, 50),
            "_sma_200": rolling(F.avg(close), close, 200),
            **{f"_f{h}": F.ln(F.lead(close, h).over(over) / close) for h in (2, 5, 10)},
        }
    )
    rows = rows.withColumn("_twice", F.col("_low") & true(F.lag("_low").over(over)))
    trend = true(close > F.col("_sma_50")) | true(close > F.col("_sma_200") * 0.85)
    one = F.lit(1)
    tests = {
        "SEED-001": beyond(2.0),
        "SEED-002": (F.col("gap_unfilled_eod") == 1, one),
        "SEED-003": (F.col("_twice") & trend, one),
        "SEED-004": (momentum() & true(F.col("regime_state").isin(BULL)), one),
        "SEED-005": beyond(2.0),
        "SEED-006": beyond(1.8),
    }
    each = F.array(*(F.struct(F.lit(k).alias("edge_id"), hit.alias("hit"), d.alias("direction"), F.col(f"_f{HOLDING[k]}").alias("forward")) for k, (hit, d) in tests.items()))
    return rows.select("instrument", "date", "close", F.inline(each))


def backtest_triggers(rows: DataFrame) -> DataFrame:
    """(…, seq, edge_id, direction, trigger_value) of rows with features and regime_state, in the order of the edges."""
    calm, z = true(F.col("regime_state") == "SIDEWAYS"), F.col("z_21d")
    tests = [
        ("SEED-001", calm & true(F.abs(z) > 2.0), F.when(z < 0, "LONG").otherwise("SHORT"), z),
        ("SEED-002", calm & (F.col("gap_unfilled_eod") == 1), F.lit("LONG"), F.col("gap_pct")),
        ("SEED-003", true(F.col("rsi_2") < 10), F.lit("LONG"), F.col("rsi_2")),
        ("SEED-004", true(F.col("regime_state").isin(BULL)) & momentum(), F.lit("LONG"), F.col("mom_5d")),
    ]
    hits = F.array(*(F.when(hit, F.struct(F.lit(i).alias("seq"), F.lit(k).alias("edge_id"), d.alias("direction"), v.alias("trigger_value"))) for i, (k, hit, d, v) in enumerate(tests)))
    keep = [c for c in ("instrument", "date", "day", "regime_state", "close", "iv") if c in rows.columns]
    return rows.select(*keep, F.inline(F.filter(hits, lambda h: h.isNotNull())))


def active_edges(edges: DataFrame, regime: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """Active edges that fit the regime (one row), once for each of their instruments (pos, instrument)."""
    groups = F.create_map(*(x for k, v in members.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    fits = (F.col("edge_regime") == "ALL") | (F.col("regime_state") == F.col("edge_regime")) | F.contains("regime_state", "edge_regime")
    active = edges.where("status = 'ACTIVE'").crossJoin(F.broadcast(regime)).where(fits)  # one row
    return active.select("*", F.posexplode(F.coalesce(F.try_element_at(groups, F.col("underlying")), F.array("underlying"))).alias("pos", "instrument"))


def live_scan(edges: DataFrame, regime: DataFrame, latest: DataFrame, members: dict[str, list[str]], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Signals of active edges against the current regime (one row) and each instrument's latest features.

    edges: (edge_id, edge_regime, edge_direction, underlying, holding_period). An edge over several instruments takes the first
    that fires, in the order of ``members``.
    """
    t = {"z": -2.0, "rsi": 10.0, "gap": -0.01, "z_currency": 1.8} | (thresholds or {})
    each = active_edges(edges, regime, members)
    z = F.col("z_21d")
    rules = {
        "SEED-001": (true(F.abs(z) > abs(t["z"])), z, "z_21d"),
        "SEED-002": (true(F.col("gap_pct") < t["gap"]) & (F.col("gap_unfilled_eod") == 1), F.col("gap_pct"), "gap_pct"),
        "SEED-003": (true(F.col("rsi_2") < t["rsi"]), F.col("rsi_2"), "rsi_2"),
        "SEED-004": (momentum(), F.col("mom_5d"), "mom_5d"),
        "SEED-006": (true(F.abs(z) > t["z_currency"]), z, "z_21d"),
    }
    hit, value, name = F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("string")
    for edge, (test, v, n) in rules.items():
        own = F.col("edge_id") == edge
        hit, value, name = F.when(own, test).otherwise(hit), F.when(own, v).otherwise(value), F.when(own, F.lit(n)).otherwise(name)
    rows = each.join(latest, "instrument").withColumns({"trigger_value": value, "trigger_feature": name}).where(hit)
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy("edge_id").orderBy("pos"))).where("_rank = 1")
    both = F.col("edge_id").isin("SEED-001", "SEED-005", "SEED-006")
    side = F.when(both, F.when(F.col("trigger_value") < 0, "LONG").otherwise("SHORT")).otherwise(F.col("edge_direction"))
    rows = rows.withColumn("direction", side).withColumn("option_type", F.when(F.col("direction") == "LONG", "call").otherwise("put"))
    stamp = F.concat_ws("_", "edge_id", "instrument", F.date_format("date", "yyyyMMdd"))
    return rows.select(stamp.alias("signal_id"), "edge_id", "instrument", "underlying", "date", "direction", "option_type", "holding_period", "trigger_feature", "trigger_value", "regime_state")
