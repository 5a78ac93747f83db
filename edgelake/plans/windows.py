"""Rolling features and window functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.functions.windows import by_instrument, log_return
from edgelake.operators import backtest, regime, scan
from edgelake.operators.features import features, synthetic_iv, with_features
from edgelake.plans import fixtures as fx
from edgelake.plans.registry import SQL, r, register

ALL = "ret_1d mom_5d mom_10d mom_20d mom_60d vol_5d vol_20d vol_ratio_vols z_21d rsi_2 rsi_14 rolling_max_252 rolling_min_252 pct_from_hi pct_from_lo ret_zscore ret_skew_20 gap_pct close"
KEY = "instrument, date"


def columns(name: str, doubles: str, others: str = "") -> None:
    names = [*doubles.split(), *others.split()]
    extra = (", " + ", ".join(others.split())) if others else ""
    register(name, lambda s, d: with_features(fx.bars(s, d)).select("instrument", "date", *names), fx.sql(f"select {KEY}, {r(doubles)}{extra} from feat0"))


columns("w01_log_return", "ret_1d")
columns("w02_momentum", "mom_5d mom_10d mom_20d mom_60d")
columns("w03_volatility", "vol_5d vol_20d")
columns("w05_range_252", "rolling_max_252 rolling_min_252")
columns("w06_skew", "ret_skew_20")
columns("w07_vol_ratio", "vol_ratio_vols", "vol_expanding")
columns("w08_zscores", "z_21d ret_zscore")
columns("w09_rsi", "rsi_2 rsi_14")
columns("w10_range_position", "pct_from_hi pct_from_lo")
columns("w12_gaps", "gap_pct", "gap_unfilled_eod")
register("w11_streaks", lambda s, d: with_features(fx.bars(s, d)).select("instrument", "date", "up_streak", "down_streak"), fx.sql(f"select {KEY}, up_streak, down_streak from feat0"))
register(
    "w13_features",
    lambda s, d: features(fx.bars(s, d)).withColumnRenamed("instrument", "underlying"),
    fx.sql(f"select instrument underlying, date, {r(ALL)}, vol_expanding, gap_unfilled_eod, up_streak, down_streak from feat"),
)


def rolling_means(s, d):
    from edgelake.functions.windows import rolling

    close = F.col("close")
    return features(fx.bars(s, d)).select("instrument", "date", *(rolling(F.avg(close), close, n).alias(f"sma_{n}") for n in (50, 200)))


register("w04_rolling_means", rolling_means, fx.sql(f"select {KEY}, round({fx.full(50, 'avg(close)', 'close')},9) sma_50, round({fx.full(200, 'avg(close)', 'close')},9) sma_200 from feat" + fx.WINDOWS), 9)
register(
    "w14_forward_returns",
    lambda s, d: features(fx.bars(s, d)).select("instrument", "date", *(F.ln(F.lead("close", h).over(by_instrument()) / F.col("close")).alias(f"fwd_{h}") for h in (2, 5, 10))),
    fx.sql(f"select {KEY}, " + ", ".join(f"round(ln(lead(close,{h}) over w/close),6) fwd_{h}" for h in (2, 5, 10)) + " from feat" + fx.WINDOWS),
)
register(
    "w15_two_days_low",
    lambda s, d: features(fx.bars(s, d)).select("instrument", "date", ((F.col("rsi_2") < 10) & F.coalesce(F.lag(F.col("rsi_2") < 10).over(by_instrument()), F.lit(False))).alias("twice")),
    fx.sql(f"select {KEY}, rsi_2<10 and coalesce(lag(rsi_2<10) over w,false) twice from feat" + fx.WINDOWS),
)
register("w16_transition_flag", lambda s, d: fx.history(s, d).select("date", "transition_warning_flag"), fx.sql("select date, transition_warning_flag from history"))
register(
    "w17_synthetic_iv",
    lambda s, d: synthetic_iv(features(fx.bars(s, d))).select("instrument", "date", "iv"),
    fx.sql(f"select {KEY}, round({fx.full(20, 'stddev_samp(ret)', 'ret')}*sqrt(252)*1.1,6) iv from g" + fx.WINDOWS, g="select instrument, date, ln(close/lag(close) over (partition by instrument order by date)) ret from feat"),
)
DAILY = {
    "byday": "select exit_date date, avg(net_return_pct)/100 ret from trades group by 1",
    "grid": "select cast(unnest(generate_series((select min(date) from byday),(select max(date) from byday),interval 1 day)) as date) date",
    "daily": "select g.date, coalesce(b.ret,0) ret from grid g left join byday b on g.date=b.date where isodow(g.date)<6",
    "eq": "select *, exp(sum(ln(1+ret)) over (order by date)) equity from daily",
    "dd": "select *, max(equity) over (order by date) peak from eq",
}
# the equity of thousands of days of large returns is compared by its logarithm
register("w18_equity_curve", lambda s, d: backtest.equity(backtest.daily_returns(fx.trades(s, d))).select("date", F.ln("equity").alias("log_equity")), fx.sql("select date, round(ln(equity),6) log_equity from eq", **DAILY))
register("w19_drawdown", lambda s, d: backtest.equity(backtest.daily_returns(fx.trades(s, d))).select("date", "drawdown"), fx.sql("select date, round((equity-peak)/peak,6) drawdown from dd", **DAILY))
register(
    "w20_regime_blocks",
    lambda s, d: regime.blocks(fx.history(s, d)),
    fx.sql(
        'select regime_state, min(date) "start", max(date) "end", count(*) as days from h2 group by regime_state, g',
        h1="select *, case when lag(regime_state) over (order by date) is distinct from regime_state then 1 else 0 end n from history",
        h2="select *, sum(n) over (order by date) g from h1",
    ),
)


def first_k(s, d):
    w = W.partitionBy("day", "instrument_class").orderBy("event_id")
    return fx.signals(s, d).withColumn("n", F.row_number().over(w)).where("n <= 2").select("event_id", "instrument_class", "n")


register("w21_first_two_of_class", first_k, fx.sql("select event_id, instrument_class, n from (select *, row_number() over (partition by day, instrument_class order by event_id) n from signals) where n<=2"))


def first_of_key(s, d):
    w = W.partitionBy("day", "underlying", "direction").orderBy("event_id")
    return fx.signals(s, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id", "underlying", "direction")


register("w22_keep_first", first_of_key, fx.sql("select event_id, underlying, direction from (select *, row_number() over (partition by day, underlying, direction order by event_id) n from signals) where n=1"))
register(
    "w23_keep_last",
    lambda s, d: fx.signals(s, d).withColumn("n", F.row_number().over(W.partitionBy("day", "edge_id").orderBy(F.desc("event_id")))).where("n = 1").select("day", "edge_id", "event_id"),
    fx.sql("select day, edge_id, max(event_id) event_id from signals group by 1,2"),
)


# the same in blocks, for series that no task can sort alone
def equity_in_blocks(s, d):
    daily = backtest.daily_returns(fx.trades(s, d))
    return scan.equity(daily, scan.by_rows(daily, "date", 200)).select("date", F.ln("equity").alias("log_equity"), "drawdown")


register("w19_drawdown_in_blocks", equity_in_blocks, fx.sql("select date, round(ln(equity),6) log_equity, round((equity-peak)/peak,6) drawdown from dd", **DAILY))


def regime_runs(s, d):
    history = fx.history(s, d)
    return scan.runs(history, [], "date", "regime_state", scan.by_width(history, "date", 90)).withColumnRenamed("n", "days")


register("w20_regime_runs_in_blocks", regime_runs, SQL["w20_regime_blocks"])


def runs_of_all_events(s, d):
    """Runs of one event type over all events as a single series."""
    events = fx.table(s, d, "events").select("event_id", "event_type")
    return scan.runs(events, [], "event_id", "event_type", scan.by_rows(events, "event_id", 4096))


register(
    "w20_runs_of_one_series",
    runs_of_all_events,
    'select event_type, min(event_id) "start", max(event_id) "end", count(*) n from (select *, row_number() over (order by event_id)-row_number() over (partition by event_type order by event_id) g from events) group by event_type, g',
)
