"""Inputs of the registered queries, derived from the given tables; each as a DataFrame and as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgelake.constants import EDGES
from edgelake.operators import regime

STEPS = {"A": 5.0, "N": 2.5}
TRAIN, TEST = ("1995-01-01", "1999-12-31"), ("2000-01-01", "2001-12-31")
TRAIN_END = TRAIN[1]
STATES = {"H_BEAR": (-1.5, 1.6, 1.0), "L_BEAR": (-0.6, 0.5, 0.4), "SIDEWAYS": (0.0, -0.4, 0.0), "L_BULL": (0.6, 0.3, -0.4), "H_BULL": (1.5, 1.2, -1.0)}
SINGLES = {"SEED-005": "N", "SEED-006": "R"}
AS_OF = "2001-06-30"
POSITIONS = [
    ("P1", "SYNTHETIC_PAIR", "U3", "LONG", 10, 150000.0), ("P2", "SYNTHETIC_PAIR", "U4", "SHORT", 10, 150000.0), ("P3", "INDEX_OPTIONS", "U0", "LONG", 15, 100000.0),
    ("P4", "COMMODITY_FUTURES", "U0", "SHORT", 15, 100000.0), ("P5", "CURRENCY_FUTURES", "U1", "LONG", 2, 100000.0), ("P6", "SWAPS", "U1", "SHORT", 5, 100000.0),
]

BARS = """
  with d as (select l_returnflag inst, cast(l_shipdate as date) dt, count(*) n, sum(cast(round(l_discount*100) as bigint)) sd, sum(cast(round(l_tax*100) as bigint)) st, sum(l_quantity) v
             from {lineitem} group by l_returnflag, cast(l_shipdate as date)),
  e as (select inst, dt, v, (sd-5*n)/(300*sqrt(cast(n as double))) r, (st-4*n)/(300*sqrt(cast(n as double))) g from d),
  f as (select inst, dt, v, g, round(100*exp(sum(r) over (partition by inst order by dt rows between unbounded preceding and current row)),4) c from e),
  h as (select *, round(coalesce(lag(c) over (partition by inst order by dt),c)*exp(g),4) o from f)
  select inst instrument, dt date, o open, greatest(o,c) high, least(o,c) low, c close, cast(v as bigint) volume from h"""
VIX = """
  select cast(o_orderdate as date) date, round(15*exp((sum(cast(o_custkey % 11 as bigint))-5*count(*))/(20*sqrt(cast(count(*) as double)))),4) vix
  from {orders} group by cast(o_orderdate as date)"""
SIGNALS = """
  select event_id, concat('SEED-00', cast(1+event_id%6 as string)) edge_id,
    case event_type when 'click' then 'INDEX_OPTIONS' when 'view' then 'INDEX_OPTIONS' when 'purchase' then 'COMMODITY_FUTURES' when 'signup' then 'CURRENCY_FUTURES' else 'SYNTHETIC_PAIR' end instrument_class,
    concat('U', cast(user_id%8 as string)) underlying, case when event_id%14<7 then 'LONG' else 'SHORT' end direction,
    cast(case event_id%4 when 0 then 2 when 1 then 5 when 2 then 10 else 15 end as int) holding_period,
    round(value/100-2.5,4) trigger_value, round(value*300,2) lot_value, round(value*500,2) margin_per_lot,
    (event_id*7)%1500 oi_lots, round(cast(event_id%13 as double)/100,2) bid_ask_spread_pct, (event_id*11)%1500 daily_volume_lots, event_id%29=0 transition_warning_flag,
    round(cast(event_id%100 as double)/100,2) confidence, round(0.5+cast(event_id%7 as double)/100,2) edge_win_rate, ts, cast(ts as date) as day
  from {events}"""
TRADES = """
  select cast(o_orderkey as string) trade_id, concat('SEED-00', cast(1+o_custkey%6 as string)) edge_id, cast(case o_orderkey%4 when 0 then 2 when 1 then 5 when 2 then 10 else 15 end as int) holding_period,
    cast(o_orderdate as date) exit_date, round(cast((o_orderkey*37)%141-35 as double),4) net_return_pct, case when o_custkey%3=0 then 'COMMODITY_FUTURES' else 'INDEX_OPTIONS' end instrument_class, o_orderkey
  from {orders}"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bars(s: SparkSession, d: str) -> DataFrame:
    return s.sql(BARS, lineitem=table(s, d, "lineitem"))


def market(s: SparkSession, d: str) -> DataFrame:
    return bars(s, d).where("instrument = 'A'").join(s.sql(VIX, orders=table(s, d, "orders")), "date")


def signals(s: SparkSession, d: str) -> DataFrame:
    return s.sql(SIGNALS, events=table(s, d, "events"))


def trades(s: SparkSession, d: str) -> DataFrame:
    return s.sql(TRADES, orders=table(s, d, "orders"))


def history(s: SparkSession, d: str) -> DataFrame:
    """The regime history of fixed states."""
    return regime.labelled(regime.score_fixed(regime.standardized(regime.market_inputs(market(s, d)), TRAIN_END), STATES))


def positions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(POSITIONS, "trade_id string, instrument_class string, underlying string, direction string, holding_period int, margin double")


def edges(s: SparkSession) -> DataFrame:
    """Two of six are decayed, so that filters and flags have something to do."""
    rows = [(k, h, r, side, w, "DECAYED" if k == "SEED-006" else "ACTIVE", int(k == "SEED-006"), 10 * i, 8 * i, 0.5, "ALL_INDICES" if i < 4 else "N") for i, (k, (h, r, side, w)) in enumerate(EDGES.items())]
    return s.createDataFrame(
        rows,
        "edge_id string, holding_period int, edge_regime string, edge_direction string, win_rate double, status string, decay_flag int, live_wins bigint, live_losses bigint, live_hit_rate double, underlying string",
    )


def ledger(s: SparkSession, d: str) -> DataFrame:
    """Signals of the year 2001 on instruments, half of them decided, some with an outcome."""
    return s.sql(LEDGER, orders=table(s, d, "orders"))


LEDGER = """
  select concat('S', cast(o_orderkey as string)) signal_id, concat('SEED-00', cast(1+o_custkey%6 as string)) edge_id, cast(o_orderdate as date) signal_date,
    case o_orderkey%5 when 0 then 'ALL_INDICES' when 1 then 'A' when 2 then 'N' when 3 then 'R' else 'GOLD' end underlying,
    cast(case o_orderkey%4 when 0 then 2 when 1 then 5 when 2 then 10 else 15 end as int) holding_period,
    case o_custkey%4 when 0 then 'PENDING' when 1 then 'APPROVED' when 2 then 'REJECTED' when 3 then case when o_orderkey%2=0 then 'SHORT' else null end end ai2_decision,
    case when o_orderkey%3=0 then case when o_orderkey%2=0 then 'WIN' else 'LOSS' end end shadow_outcome
  from {orders} where o_orderdate >= timestamp '2001-01-01 00:00:00'"""

W = "partition by instrument order by date"


def full(n: int, agg: str, x: str) -> str:
    return f"case when count({x}) over w{n} = {n} then {agg} over w{n} end"


WINDOWS = f" window w as ({W})" + "".join(f", w{n} as ({W} rows between {n - 1} preceding and current row)" for n in (2, 5, 14, 20, 21, 50, 200, 252))


def values(rows: list[tuple]) -> str:
    literal = lambda v: "null" if v is None else "'" + v + "'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else repr(v)
    return "values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


NUMERATOR = "((((((3.52624965998911e-02*z+0.700383064443688)*z+6.37396220353165)*z+33.912866078383)*z+112.079291497871)*z+221.213596169931)*z+220.206867912376)"
DENOMINATOR = "(((((((8.83883476483184e-02*z+1.75566716318264)*z+16.064177579207)*z+86.7807322029461)*z+296.564248779674)*z+637.333633378831)*z+793.826512519948)*z+440.413735824752)"


def cdf(x: str) -> str:
    """The normal distribution written out in SQL."""
    tail = f"(case when z > 37 then 0 when z < 7.07106781186547 then exp(-z*z/2)*{NUMERATOR}/{DENOMINATOR} else exp(-z*z/2)/(z+1/(z+2/(z+3/(z+4/(z+0.65)))))/2.506628274631 end)".replace("z", f"abs({x})")
    # exp(-abs(x)*abs(x)/2): the letters of function names hold no z
    return f"(case when {x} > 0 then 1-{tail} else {tail} end)"


PROB_ARGMAX = "case " + " ".join(f"when prob_{k} = regime_confidence then '{k}'" for k in STATES) + " end"
DISTANCE = {k: f"exp(-1.5*((log_ret-({a}))*(log_ret-({a}))+(vol_5d-({b}))*(vol_5d-({b}))+(vix-({c}))*(vix-({c})))/2)" for k, (a, b, c) in STATES.items()}
TOTAL = "(" + "+".join(f"e_{k}" for k in STATES) + ")"

CTES = {
    "bars": BARS.format(lineitem="lineitem"),
    "vix": VIX.format(orders="orders"),
    "signals": SIGNALS.format(events="events"),
    "trades": TRADES.format(orders="orders"),
    "ledger": LEDGER.format(orders="orders"),
    "f0": "select *, lag(close) over w pc, close-lag(close) over w chg, ln(close/lag(close) over w) ret_1d, "
    + ", ".join(f"close/lag(close,{n}) over w - 1 mom_{n}d" for n in (5, 10, 20, 60))
    + f", {full(21, 'avg(close)', 'close')} m21, {full(21, 'stddev_samp(close)', 'close')} s21, {full(252, 'max(close)', 'close')} rolling_max_252, {full(252, 'min(close)', 'close')} rolling_min_252 from bars"
    + WINDOWS,
    "f1": "select *, case when chg is not null then greatest(chg,0.0) end gain, case when chg is not null then -least(chg,0.0) end loss, coalesce(close>pc,false) up, coalesce(close<pc,false) down, "
    f"{full(5, 'stddev_samp(ret_1d)', 'ret_1d')} vol_5d, {full(20, 'stddev_samp(ret_1d)', 'ret_1d')} vol_20d, {full(20, 'avg(ret_1d)', 'ret_1d')} rm20, {full(20, 'skewness(ret_1d)', 'ret_1d')} ret_skew_20 from f0" + WINDOWS,
    "f2": f"select *, 100-100/(1+{full(2, 'avg(gain)', 'gain')}/nullif({full(2, 'avg(loss)', 'loss')},0)) rsi_2, 100-100/(1+{full(14, 'avg(gain)', 'gain')}/nullif({full(14, 'avg(loss)', 'loss')},0)) rsi_14, "
    "sum(case when up then 0 else 1 end) over w ug, sum(case when down then 0 else 1 end) over w dg from f1" + WINDOWS,
    "feat0": "select instrument, date, open, close, ret_1d, mom_5d, mom_10d, mom_20d, mom_60d, vol_5d, vol_20d, vol_5d/nullif(vol_20d,0) vol_ratio_vols, cast(coalesce(vol_5d>vol_20d,false) as int) vol_expanding, "
    "(close-m21)/nullif(s21,0) z_21d, rsi_2, rsi_14, rolling_max_252, rolling_min_252, (close-rolling_max_252)/nullif(rolling_max_252-rolling_min_252,0) pct_from_hi, "
    "(close-rolling_min_252)/nullif(rolling_max_252-rolling_min_252,0) pct_from_lo, (ret_1d-rm20)/nullif(vol_20d,0) ret_zscore, ret_skew_20, "
    "cast(sum(cast(up as int)) over (partition by instrument, ug order by date) as bigint) up_streak, cast(sum(cast(down as int)) over (partition by instrument, dg order by date) as bigint) down_streak, "
    "(open-pc)/pc gap_pct, cast(coalesce((open-pc)/pc < -0.01 and close<pc,false) as int) gap_unfilled_eod from f2",
    "feat": "select * from feat0 where ret_1d is not null and z_21d is not null and rsi_2 is not null",
    "market": "select b.*, v.vix from bars b join vix v on b.date=v.date where b.instrument='A'",
    "m1": "select date, close index_close, vix vix_close, ln(close/lag(close) over (order by date)) log_ret, vix/100 vix from market",
    "m2": "select *, case when count(log_ret) over (order by date rows between 4 preceding and current row)=5 then stddev_samp(log_ret) over (order by date rows between 4 preceding and current row) end vol_5d from m1",
    "inputs": "select * from m2 where vol_5d is not null and log_ret is not null",
    "scale": f"select avg(log_ret) a1, stddev_pop(log_ret) s1, avg(vol_5d) a2, stddev_pop(vol_5d) s2, avg(vix) a3, stddev_pop(vix) s3 from inputs where date <= date '{TRAIN_END}'",
    "std": "select date, index_close, vix_close, (log_ret-a1)/nullif(s1,0) log_ret, (vol_5d-a2)/nullif(s2,0) vol_5d, (vix-a3)/nullif(s3,0) vix from inputs, scale",
    "w0": "select *, " + ", ".join(f"{e} e_{k}" for k, e in DISTANCE.items()) + " from std",
    "w1": "select date, index_close, vix_close, log_ret, vol_5d, vix, " + ", ".join(f"e_{k}/{TOTAL} prob_{k}" for k in STATES) + " from w0",
    "w2": "select *, greatest(" + ", ".join(f"prob_{k}" for k in STATES) + ") regime_confidence from w1",
    "history": f"select *, case when regime_confidence<0.5 then 'SIDEWAYS' else {PROB_ARGMAX} end regime_state, "
    "coalesce(lag(regime_confidence) over (order by date)-regime_confidence>0.20,false) or coalesce((vix_close-lag(vix_close) over (order by date))/lag(vix_close) over (order by date)>0.25,false) transition_warning_flag from w2",
    "positions": f"select * from ({values(POSITIONS)}) t(trade_id, instrument_class, underlying, direction, holding_period, margin)",
    "edges": "select * from ("
    + values([(k, h, r, side, w, "DECAYED" if k == "SEED-006" else "ACTIVE", int(k == "SEED-006"), 10 * i, 8 * i, 0.5, "ALL_INDICES" if i < 4 else "N") for i, (k, (h, r, side, w)) in enumerate(EDGES.items())])
    + ") t(edge_id, holding_period, edge_regime, edge_direction, win_rate, status, decay_flag, live_wins, live_losses, live_hit_rate, underlying)",
}


def sql(query: str, **more: str) -> str:
    """A query over the fixtures; ``more`` are its own table expressions, in order."""
    parts = {k: v.replace(" as string)", " as varchar)") for k, v in (CTES | more).items()}
    return "with recursive " + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + "\n" + query
