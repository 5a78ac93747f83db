"""Scalar functions, pricing, triggers, revalidation, backtest, gates, ledgers, learners and batch twins of the streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from edgelake import schema
from edgelake.constants import CAPITAL, EDGES
from edgelake.functions.pricing import at_the_money, atm_premium, black_scholes, normal_cdf, normal_pdf, strike_step
from edgelake.operators import backtest, gate, learn, ledger, markov, regime, revalidate, triggers
from edgelake.operators.features import features, synthetic_iv
from edgelake.plans import fixtures as fx
from edgelake.plans.registry import r, register
from edgelake.plans.relational import X, replay
from edgelake.sources import bars as source
from edgelake.streaming import live, state

B, FE, T, S, H = fx.bars, (lambda s, d: features(fx.bars(s, d))), fx.trades, fx.signals, fx.history
GRID = "select event_id, value/25-2 x, 80+value s, 100.0 k, (event_id%4)*5/252.0 t, case when event_id%7=0 then 0.0 else 0.1+(event_id%5)*0.1 end v, case when event_id%2=0 then 'call' else 'put' end kind from events"


def grid(s, d):
    e = fx.table(s, d, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", (F.col("value") / 25 - 2).alias("x"), (80 + F.col("value")).alias("s"), F.lit(100.0).alias("k"), (i % 4 * 5 / 252.0).alias("t"),
        F.when(i % 7 == 0, 0.0).otherwise(0.1 + i % 5 * 0.1).alias("v"), F.when(i % 2 == 0, "call").otherwise("put").alias("kind"),
    )


register("f01_math", lambda s, d: grid(s, d).select("event_id", F.ln("s").alias("l"), F.exp("x").alias("e"), F.sqrt("s").alias("q"), F.abs("x").alias("a"), F.pow("s", F.lit(0.5)).alias("p")), fx.sql("select event_id, round(ln(s),6) l, round(exp(x),6) e, round(sqrt(s),6) q, round(abs(x),6) a, round(power(s,0.5),6) p from g", g=GRID))
register("f02_normal", lambda s, d: grid(s, d).select("event_id", normal_cdf(F.col("x")).alias("cdf"), normal_pdf(F.col("x")).alias("pdf")), fx.sql(f"select event_id, round({fx.cdf('x')},6) cdf, round(exp(-x*x/2)/sqrt(2*pi()),6) pdf from g", g=GRID))
register("f03_strikes", lambda s, d: B(s, d).select("instrument", "date", at_the_money(F.col("close"), strike_step(F.col("instrument"), fx.STEPS)).alias("strike")), fx.sql("select instrument, date, round_even(close/p,0)*p strike from (select *, case instrument when 'A' then 5.0::double when 'N' then 2.5::double else 50.0::double end p from bars)"))
CODES = ["NIFTY", "BANKNIFTY", "FINNIFTY", "MIDCPNIFTY", "GOLD", "SILVER", "CRUDEOIL", "COPPER", "USDINR", "EURUSD", "OTHER"]
register(
    "f04_strike_steps",
    lambda s, d: S(s, d).select("event_id", F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 11 + 1).cast("int")).alias("code"), F.col("lot_value").alias("x"))
    .select("event_id", "code", strike_step(F.col("code")).alias("step"), at_the_money(F.col("x"), strike_step(F.col("code"))).alias("strike")),
    fx.sql(
        "select event_id, code, st step, nullif(round_even(x/st,0)*st,0) strike from b",
        a=f"select event_id, lot_value x, ({CODES!r})[cast(event_id%11 as int)+1] code from signals",
        b="select *, case code when 'BANKNIFTY' then 100.0::double when 'MIDCPNIFTY' then 25 when 'GOLD' then 100 when 'SILVER' then 100 when 'COPPER' then 5 when 'USDINR' then 0.25 when 'EURUSD' then 0.001 else 50 end st from a",
    ),
)
register(
    "f06_finite",
    lambda s, d: fx.table(s, d, "events").select("event_id", F.try_divide(F.col("value"), F.nullif(F.col("user_id") % 5, F.lit(0)).cast("double")).alias("x"), F.ln(F.col("value") - 50).alias("l"))
    .select("event_id", F.coalesce(F.abs("x") < float("inf"), F.lit(False)).alias("finite"), F.coalesce(F.nanvl("l", F.lit(None).cast("double")), F.lit(0.0)).alias("filled"), (F.col("l").isNull() | F.isnan("l")).alias("missing")),
    "select event_id, coalesce(isfinite(value/nullif(user_id%5,0)),false) finite, case when value>50 then round(ln(value-50),6) else 0 end filled, not coalesce(value>50,false) missing from events",
)
register(
    "f17_keys",
    lambda s, d: S(s, d).select("event_id", F.substring(F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "edge_id", "direction"), 256), 1, 32).alias("key")),
    fx.sql("select event_id, substr(sha256(event_id||'|'||edge_id||'|'||direction),1,32) as key from signals"),
)
register("p15_literal_columns", lambda s, d: S(s, d).select("event_id", F.lit("OPEN").alias("status"), F.lit(0.0).alias("pnl"), F.lit(None).cast("date").alias("exit_date"), F.lit(True).alias("live")), fx.sql("select event_id, 'OPEN' status, 0.0::double pnl, cast(null as date) exit_date, true live from signals"))
register("f05_truncate", lambda s, d: S(s, d).select("event_id", F.greatest(F.lit(1), F.floor(94500.0 / F.nullif(F.col("margin_per_lot"), F.lit(0.0)))).cast("long").alias("lots")), fx.sql("select event_id, cast(greatest(1,floor(94500.0::double/nullif(margin_per_lot,0))) as bigint) lots from signals"))
register(
    "f07_calendar",
    lambda s, d: fx.ledger(s, d).select("signal_id", F.datediff(F.lit("2001-12-31").cast("date"), "signal_date").alias("age"), F.date_add("signal_date", (F.col("holding_period") * 1.5).cast("int")).alias("leave"), F.weekday("signal_date").alias("dow")),
    fx.sql("select signal_id, date '2001-12-31'-signal_date age, signal_date+cast(floor(holding_period*1.5) as int) leave, isodow(signal_date)-1 dow from ledger"),
)
register("f09_business_days", lambda s, d: source.business_days(s, "2000-01-01", "2000-12-31"), "select cast(d as date) date from (select unnest(generate_series(date '2000-01-01', date '2000-12-31', interval 1 day)) d) where isodow(d)<6")
register(
    "f11_strings",
    lambda s, d: T(s, d).select(F.concat_ws("_", "edge_id", "trade_id", F.date_format("exit_date", "yyyy-MM-dd")).alias("id"), F.format_string("META_SCORE_%d", F.col("holding_period")).alias("reason"), F.substring(F.col("exit_date").cast("string"), 1, 7).alias("month"), F.regexp_replace("edge_id", "^SEED-", "").alias("tail")),
    fx.sql("select edge_id||'_'||trade_id||'_'||cast(exit_date as varchar) id, 'META_SCORE_'||holding_period reason, substr(cast(exit_date as varchar),1,7) as month, regexp_replace(edge_id,'^SEED-','') tail from trades"),
)
register(
    "f14_json",
    lambda s, d: fx.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].cast("long").alias("k"), F.to_json(F.struct("event_id", "event_type"), {"ignoreNullFields": "false"}).alias("js")),
    """select event_id, cast(props->>'k' as bigint) k, '{"event_id":'||event_id||',"event_type":"'||event_type||'"}' js from events""",
)
register("f15_codes", lambda s, d: H(s, d).select("date", F.try_element_at(gate.literal_map(learn.REGIME_CODES), F.col("regime_state")).alias("code"), (F.col("regime_state") == "SIDEWAYS").cast("int").alias("calm")), fx.sql("select date, case regime_state when 'H_BEAR' then 0 when 'L_BEAR' then 1 when 'SIDEWAYS' then 2 when 'L_BULL' then 3 else 4 end code, cast(regime_state='SIDEWAYS' as int) calm from history"))
register("f16_dot", lambda s, d: replay(s, d).select("event_id", F.aggregate(F.zip_with("context", "context", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x).alias("norm")), fx.sql(f"select event_id, round(list_sum(list_transform(x, lambda a: a*a)),6) norm from (select event_id, cast({X} as double[]) x from signals)"))

BS = {
    "g": GRID,
    "p": "select *, case when t<=0 or v<=0 then null else (ln(s/k)+(0.065+v*v/2)*t)/(v*sqrt(t)) end d1, exp(-0.065*t)*k dk, case kind when 'call' then 1.0 else -1.0 end w from g",
    "q": "select *, d1-v*sqrt(t) d2, w*d1 y1, w*(d1-v*sqrt(t)) y2 from p",
    "n": f"select *, {fx.cdf('y1')} n1, {fx.cdf('y2')} n2, exp(-d1*d1/2)/sqrt(2*pi()) f1 from q",
}


def priced(s, d):
    c = F.col
    return grid(s, d).select("event_id", black_scholes(c("s"), c("k"), c("t"), 0.065, c("v"), c("kind")).alias("b")).select("event_id", "b.*")


register(
    "d08_black_scholes",
    priced,
    fx.sql(
        "select event_id, round(greatest(case when d1 is null then w*(s-k) else w*(s*n1-dk*n2) end,0),6) price, round(case when d1 is null then case when w>0 and s>k then 1.0 when w<0 and s<k then -1.0 else 0.0 end else w*n1 end,6) delta, "
        "round(case when d1 is null then 0 else (-(s*f1*v)/(2*sqrt(t))-w*0.065*dk*n2)/252 end,6) theta, round(case when d1 is null then 0 else f1/(s*v*sqrt(t)) end,6) gamma from n",
        **BS,
    ),
)
IV = {
    "g1": "select instrument, date, close, ln(close/lag(close) over (partition by instrument order by date)) ret from feat",
    "ivs": f"select instrument, date, close, {fx.full(20, 'stddev_samp(ret)', 'ret')}*sqrt(252)*1.1 iv from g1" + fx.WINDOWS,
}
PREMIUM = {
    "p1": "select *, case instrument when 'A' then 5.0::double when 'N' then 2.5::double else 50.0::double end p, 5/252.0::double t from ivs where iv>0",
    "p2": "select *, round_even(close/p,0)*p k from p1",
    "p3": "select *, (ln(close/k)+(0.065+iv*iv/2)*t)/(iv*sqrt(t)) d1 from p2 where k>0",
    "p4": "select *, d1-iv*sqrt(t) d2 from p3",
}


def atm(s, d):
    rows = synthetic_iv(FE(s, d)).where("iv > 0").withColumn("p", strike_step(F.col("instrument"), fx.STEPS))
    value = atm_premium(F.col("close"), F.col("iv"), F.col("p"), F.lit("call"), F.lit(5))
    return rows.select("instrument", "date", at_the_money(F.col("close"), F.col("p")).alias("strike"), value["price"].alias("premium")).where("strike > 0")


register("d09_atm_premium", atm, fx.sql(f"select instrument, date, k strike, round(greatest(close*{fx.cdf('d1')}-k*exp(-0.065*t)*{fx.cdf('d2')},0),6) premium from p4", **IV, **PREMIUM))

MOMENTUM = "coalesce(mom_5d>0 and rsi_14>55 and vol_expanding=0,false)"
REVALIDATION = {
    "r0": f"select f.*, h.regime_state, {fx.full(50, 'avg(close)', 'close')} sma50, {fx.full(200, 'avg(close)', 'close')} sma200, coalesce(lag(rsi_2<10) over w,false) before, "
    + ", ".join(f"ln(lead(close,{k}) over w/close) f{k}" for k in (2, 5, 10))
    + " from feat f left join history h on f.date=h.date"
    + fx.WINDOWS.replace("order by date", "order by f.date"),
    "r1": "select instrument, date, 'SEED-001' edge_id, abs(z_21d)>2 hit, case when z_21d< -2 then 1 else -1 end direction, f5 forward from r0 union all select instrument, date, 'SEED-002', gap_unfilled_eod=1, 1, f2 from r0 "
    "union all select instrument, date, 'SEED-003', rsi_2<10 and before and (coalesce(close>sma50,false) or coalesce(close>sma200*0.85,false)), 1, f5 from r0 "
    f"union all select instrument, date, 'SEED-004', {MOMENTUM} and coalesce(regime_state in ('H_BULL','L_BULL'),false), 1, f10 from r0 "
    "union all select instrument, date, 'SEED-005', abs(z_21d)>2, case when z_21d< -2 then 1 else -1 end, f5 from r0 union all select instrument, date, 'SEED-006', abs(z_21d)>1.8, case when z_21d< -1.8 then 1 else -1 end, f10 from r0",
    "r2": f"select *, case when date between date '{fx.TRAIN[0]}' and date '{fx.TRAIN[1]}' then 'IS' when date between date '{fx.TEST[0]}' and date '{fx.TEST[1]}' then 'OOS' end segment, forward*direction ret, case when forward is not null then greatest(forward*direction,-0.35) end net from r1 where hit",
    "r3": "select * from r2 where segment is not null and ((edge_id<='SEED-004' and forward is not null) or (edge_id='SEED-005' and instrument='N') or (edge_id='SEED-006' and instrument='R'))",
    "st": "select edge_id, segment, count(*) n, avg(case when ret>0 then 1.0 else 0 end) win_rate, avg(ret) avg_return, avg(net) avg_return_net, avg(net)/(nullif(stddev_samp(net),0)/sqrt(count(net))) t_stat from r3 group by 1,2",
}
TRIG = lambda s, d: triggers.revalidation_triggers(FE(s, d), H(s, d))
STATS = lambda s, d: revalidate.edge_statistics(TRIG(s, d), fx.TRAIN, fx.TEST, fx.SINGLES)
register("d04_triggers", lambda s, d: TRIG(s, d).where("hit").drop("hit", "close"), fx.sql(f"select instrument, date, edge_id, direction, {r('forward')} from r1 where hit", **REVALIDATION))
register("d05_edge_statistics", STATS, fx.sql(f"select edge_id, segment, n, {r('win_rate avg_return avg_return_net t_stat')} from st", **REVALIDATION))
GATE = {
    "gt": "select e.edge_id, coalesce(i.n,0) n, i.win_rate, i.avg_return_net, o.win_rate oos_win_rate from (select edge_id from edges) e left join (select * from st where segment='IS') i on e.edge_id=i.edge_id left join (select * from st where segment='OOS') o on e.edge_id=o.edge_id",
    "gs": "select *, nullif(concat_ws(', ', case when n<30 then 'INSUFFICIENT_DATA' end, case when win_rate<=0.5 then 'FAILED_WIN_RATE' end, case when avg_return_net<=0 then 'FAILED_AVG_RETURN' end, case when oos_win_rate<win_rate-0.08 then 'OOS_DIVERGENCE' end),'') reason from gt",
}
register("d06_acceptance_gate", lambda s, d: revalidate.gate(STATS(s, d), list(EDGES)), fx.sql(f"select edge_id, n, {r('win_rate avg_return_net oos_win_rate')}, reason, case when reason is null then 'ACTIVE' else 'FAILED_REVALIDATION' end status from gs", **REVALIDATION, **GATE))
register(
    "d07_write_back",
    lambda s, d: ledger.update(fx.edges(s), revalidate.gate(STATS(s, d), list(EDGES)).select("edge_id", "status"), "edge_id").select("edge_id", "holding_period", "status"),
    fx.sql("select e.edge_id, holding_period, case when reason is null then 'ACTIVE' else 'FAILED_REVALIDATION' end status from edges e join gs on e.edge_id=gs.edge_id", **REVALIDATION, **GATE),
)
register("a03_p_values", lambda s, d: revalidate.with_p_value(STATS(s, d)))

LATEST = lambda s, d: FE(s, d).groupBy("instrument").agg(F.max_by(F.struct("date", "z_21d", "gap_pct", "gap_unfilled_eod", "rsi_2", "rsi_14", "mom_5d", "vol_expanding"), "date").alias("x")).select("instrument", "x.*")


def scan(s, d):
    now = s.createDataFrame([("SIDEWAYS",)], "regime_state string")
    return triggers.live_scan(fx.edges(s), now, LATEST(s, d), {"ALL_INDICES": ["A", "N", "R"]}, {"z": -0.5, "rsi": 60.0})


LIVE = {
    "lt": "select * from feat qualify row_number() over (partition by instrument order by date desc)=1",
    "ei": "select e.*, i.instrument, i.pos from edges e, (values ('A',0),('N',1),('R',2)) i(instrument, pos) where e.underlying='ALL_INDICES' or e.underlying=i.instrument",
    "lv": "select ei.edge_id, ei.instrument, ei.underlying, ei.holding_period, ei.edge_direction, ei.pos, lt.date, case ei.edge_id when 'SEED-001' then z_21d when 'SEED-002' then gap_pct when 'SEED-003' then rsi_2 when 'SEED-004' then mom_5d when 'SEED-006' then z_21d end trigger_value, "
    f"case ei.edge_id when 'SEED-001' then abs(z_21d)>0.5 when 'SEED-002' then gap_pct< -0.01 and gap_unfilled_eod=1 when 'SEED-003' then rsi_2<60 when 'SEED-004' then {MOMENTUM} when 'SEED-006' then abs(z_21d)>1.8 else false end hit from ei join lt on ei.instrument=lt.instrument "
    "where status='ACTIVE' and (edge_regime='ALL' or contains('SIDEWAYS', edge_regime))",
    "lf": "select *, case when edge_id in ('SEED-001','SEED-005','SEED-006') then case when trigger_value<0 then 'LONG' else 'SHORT' end else edge_direction end direction from lv where hit qualify row_number() over (partition by edge_id order by pos)=1",
}
register(
    "d01_live_scan",
    scan,
    fx.sql(
        "select edge_id||'_'||instrument||'_'||strftime(date,'%Y%m%d') signal_id, edge_id, instrument, underlying, date, direction, case when direction='LONG' then 'call' else 'put' end option_type, holding_period, "
        "case edge_id when 'SEED-002' then 'gap_pct' when 'SEED-003' then 'rsi_2' when 'SEED-004' then 'mom_5d' else 'z_21d' end trigger_feature, round(trigger_value,6) trigger_value, 'SIDEWAYS' regime_state from lf",
        **LIVE,
    ),
)

register(
    "j08_edges_by_instrument",
    lambda s, d: triggers.active_edges(fx.edges(s), s.createDataFrame([("SIDEWAYS",)], "regime_state string"), {"ALL_INDICES": ["A", "N", "R"]}).select("edge_id", "underlying", "pos", "instrument"),
    fx.sql("select edge_id, underlying, case when underlying='ALL_INDICES' then pos else 0 end pos, instrument from ei where status='ACTIVE' and (edge_regime='ALL' or contains('SIDEWAYS', edge_regime))", **LIVE),
)
register(
    "d02_scan_by_regime",
    lambda s, d: triggers.live_scan(fx.edges(s), s.createDataFrame([("SIDEWAYS",)], "regime_state string"), LATEST(s, d), {"ALL_INDICES": ["A", "N", "R"]}, {"z": -0.05, "rsi": 99.0, "gap": 1.0, "z_currency": 0.05}).select("edge_id", "instrument", "direction", "trigger_value"),
    fx.sql(
        "select edge_id, instrument, case when edge_id in ('SEED-001','SEED-005','SEED-006') then case when trigger_value<0 then 'LONG' else 'SHORT' end else edge_direction end direction, round(trigger_value,6) trigger_value from "
        "(select *, case edge_id when 'SEED-001' then abs(v)>0.05 when 'SEED-002' then v<1 and gap_unfilled_eod=1 when 'SEED-003' then v<99 else false end ok, v trigger_value from "
        "(select ei.*, lt.gap_unfilled_eod, case ei.edge_id when 'SEED-001' then z_21d when 'SEED-002' then gap_pct when 'SEED-003' then rsi_2 end v from ei join lt on ei.instrument=lt.instrument where status='ACTIVE' and (edge_regime='ALL' or contains('SIDEWAYS', edge_regime)))) "
        "where ok qualify row_number() over (partition by edge_id order by pos)=1",
        **LIVE,
    ),
)

BT = {
    "dy": f"select date dy, regime_state from history where date between date '{fx.TEST[0]}' and date '{fx.TEST[1]}' and isodow(date)<6 and not transition_warning_flag",
    "fi": "select f.*, v.iv from feat f join ivs v on f.instrument=v.instrument and f.date=v.date",
    "gr": "select i.instrument, dy.dy, dy.regime_state, f.* exclude (instrument) from dy cross join (values ('A'),('N'),('R')) i(instrument) asof join fi f on f.instrument=i.instrument and dy.dy>=f.date",
    "sg": "select instrument, dy, regime_state, close, iv, 0 seq, 'SEED-001' edge_id, case when z_21d<0 then 'LONG' else 'SHORT' end direction, z_21d trigger_value, 5 hp from gr where regime_state='SIDEWAYS' and abs(z_21d)>2 "
    "union all select instrument, dy, regime_state, close, iv, 1, 'SEED-002', 'LONG', gap_pct, 2 from gr where regime_state='SIDEWAYS' and gap_unfilled_eod=1 "
    "union all select instrument, dy, regime_state, close, iv, 2, 'SEED-003', 'LONG', rsi_2, 5 from gr where rsi_2<10 "
    f"union all select instrument, dy, regime_state, close, iv, 3, 'SEED-004', 'LONG', mom_5d, 10 from gr where regime_state in ('H_BULL','L_BULL') and {MOMENTUM}",
    "s1": "select *, case instrument when 'A' then 5.0::double when 'N' then 2.5::double else 50.0::double end p, hp/252.0::double t, case direction when 'LONG' then 1.0 else -1.0 end w from sg where iv>0",
    "s2": "select *, round_even(close/p,0)*p k from s1",
    "s3": "select *, (ln(close/k)+(0.065+iv*iv/2)*t)/(iv*sqrt(t)) d1 from s2",
    "s4": "select *, w*d1 y1, w*(d1-iv*sqrt(t)) y2 from s3",
    "s5": f"select *, greatest(w*(close*{fx.cdf('y1')}-k*exp(-0.065*t)*{fx.cdf('y2')}),0) premium from s4",
}
CANDIDATES = lambda s, d: backtest.candidates(FE(s, d), backtest.trading_days(H(s, d), *fx.TEST), fx.STEPS)
register("d03_backtest_signals", lambda s, d: CANDIDATES(s, d).select("instrument", "day", "edge_id", "direction", "trigger_value"), fx.sql(f"select instrument, dy as day, edge_id, direction, {r('trigger_value')} from s5", **IV, **BT))
register("d10_entry_fills", lambda s, d: CANDIDATES(s, d).select("instrument", "day", "edge_id", "strike", "entry_premium"), fx.sql("select instrument, dy as day, edge_id, k strike, round(premium,6) entry_premium from s5", **IV, **BT))
WALK = {
    "c1": "select *, (select min(dy) from dy where dy.dy>=s5.dy+hp) exit_day from s5 qualify row_number() over (partition by instrument, direction, dy order by seq)=1",
    "c2": "select *, row_number() over (partition by instrument, direction order by dy) n from c1",
    # the next trade of a pair is its first candidate on or after the exit day
    "wk": "select c2.* from c2 where n=1 union all select nx.* from wk join lateral (select * from c2 where c2.instrument=wk.instrument and c2.direction=wk.direction and c2.dy>=wk.exit_day order by c2.dy limit 1) nx on true",
    "cl": "select wk.*, f.close exit_price from wk asof join feat f on wk.instrument=f.instrument and wk.exit_day>=f.date where exit_day is not null",
    "tr": "select edge_id||'_'||instrument||'_'||cast(dy as varchar) trade_id, edge_id, instrument, 'INDEX_OPTIONS' instrument_class, direction, hp holding_period, dy entry_date, exit_day exit_date, premium entry_premium, greatest(w*(exit_price-k),0) exit_premium, "
    "greatest((greatest(w*(exit_price-k),0)-premium)/nullif(premium,0),-0.35)*100 net_return_pct, regime_state regime_at_entry, trigger_value from cl",
}
TR = f"trade_id, edge_id, instrument, instrument_class, direction, holding_period, entry_date, exit_date, {r('entry_premium exit_premium net_return_pct')}, regime_at_entry, {r('trigger_value')}"
register("d12_backtest", lambda s, d: backtest.run(FE(s, d), H(s, d), *fx.TEST, fx.STEPS), fx.sql(f"select {TR} from tr", **IV, **BT, **WALK))
register("d12_capital", lambda s, d: backtest.run(FE(s, d), H(s, d), *fx.TEST, fx.STEPS).agg(F.count("*").alias("n"), (math.log(CAPITAL) + backtest.log_growth(F.col("net_return_pct"))).alias("log_capital")), fx.sql("select count(*) n, round(ln(1350000.0)+coalesce(sum(ln(1+0.07*net_return_pct/100)),0),6) log_capital from tr", **IV, **BT, **WALK))

register("d13_hidden_markov", lambda s, d: regime.classify(regime.market_inputs(fx.market(s, d)), fx.TRAIN_END))
STAY = 0.9
N_STATES = len(fx.STATES)


def decoded(s, d):
    """Filtered and Viterbi states of a Markov model with fixed states, in chunks of the series."""
    rows = regime.standardized(regime.market_inputs(fx.market(s, d)), fx.TRAIN_END).withColumn("series", F.lit("A"))
    chunks = markov.chunked(rows, "series", "date", regime.INPUTS, 128, 500)
    moves = np.full((N_STATES, N_STATES), (1 - STAY) / (N_STATES - 1))
    np.fill_diagonal(moves, STAY)
    model = regime.Hmm(np.full(N_STATES, 1 / N_STATES), moves, np.array(list(fx.STATES.values())), np.stack([np.eye(3)] * N_STATES), [])
    return markov.decode(chunks, model, smoothed=False).select(F.col("order").alias("date"), "state", *(F.col("probs")[i].alias(f"prob_{k}") for i, k in enumerate(fx.STATES)))


def decoded_sql() -> str:
    """The recursions a row at a time: distributions p, best scores v with the state k they came from, then the way back."""
    at = range(N_STATES)
    move = lambda i, j: STAY if i == j else (1 - STAY) / (N_STATES - 1)
    every = lambda f, sep=", ": sep.join(f(j) for j in at)
    return fx.sql(
        f"select o.date, bk.s::int state, {', '.join(f'round(p{j},6) prob_{k}' for j, k in enumerate(fx.STATES))} from fw join bk using (n) join obs o using (n)",
        o1="select row_number() over (order by date) n, date, " + ", ".join(f"-0.5*((log_ret-({a}))^2+(vol_5d-({b}))^2+(vix-({c}))^2)-1.5*ln(2*pi()) l{j}" for j, (a, b, c) in enumerate(fx.STATES.values())) + " from std",
        obs=f"select *, greatest({every(lambda j: f'l{j}')}) top from o1",
        fw=f"select n, {every(lambda j: f'exp(l{j}-top)/(' + every(lambda i: f'exp(l{i}-top)', '+') + f') p{j}')}, {every(lambda j: f'l{j}+ln({1 / N_STATES}) v{j}')}, {every(lambda j: f'0::bigint k{j}')} from obs where n=1 union all "
        f"select n, {every(lambda j: f'q{j}/(' + every(lambda i: f'q{i}', '+') + ')')}, {every(lambda j: f'list_max(w{j})+l{j}')}, {every(lambda j: f'list_position(w{j}, list_max(w{j}))-1')} from ("
        f"select o.*, {every(lambda j: '(' + every(lambda i: f'p{i}*{move(i, j)}', '+') + f')*exp(l{j}-top) q{j}')}, {every(lambda j: '[' + every(lambda i: f'v{i}+ln({move(i, j)})') + f'] w{j}')} from fw join obs o on o.n=fw.n+1)",
        bk=f"select n, s from (select n, list_position([{every(lambda j: f'v{j}')}], greatest({every(lambda j: f'v{j}')}))-1 s from fw order by n desc limit 1) union all select fw.n-1, [{every(lambda j: f'k{j}')}][s+1] from bk join fw on fw.n=bk.n where fw.n>1",
    )


register("d13_decode_in_chunks", decoded, decoded_sql())
register(
    "d14_states_by_mean",
    lambda s, d: regime.named_by_mean(T(s, d).withColumn("state", F.col("holding_period") % 7), "state", "net_return_pct"),
    fx.sql("select state, round(mean,6) mean, (['H_BEAR','L_BEAR','SIDEWAYS','L_BULL','H_BULL'])[cast(row_number() over (order by mean) as int)] label from (select holding_period%7 state, avg(net_return_pct) mean from trades group by 1)"),
)
register("d15_labels", lambda s, d: H(s, d).select("date", *(f"prob_{k}" for k in fx.STATES), "regime_confidence", "regime_state"), fx.sql("select date, " + r(" ".join(f"prob_{k}" for k in fx.STATES) + " regime_confidence") + ", regime_state from history"))

RISK = {
    "bk": "select count(*) o, sum(margin) m from positions",
    "rk": "select s.*, case when transition_warning_flag then 'TRANSITION_WATCH_ACTIVE' when o>=8 then 'MAX_POSITIONS_REACHED' when lot_value>1350000*0.07 then 'POSITION_SIZE_EXCEEDS_7pct_CAPITAL' when m+margin_per_lot>1350000*0.60 then 'MARGIN_LIMIT_EXCEEDED' "
    "when (select count(*) from positions p where p.instrument_class=s.instrument_class)>=2 then 'ASSET_CLASS_CONCENTRATION_'||instrument_class when (select count(*) from positions p where p.underlying=s.underlying)>=2 then 'UNDERLYING_CONCENTRATION_'||underlying "
    "when margin_per_lot>1350000 then 'CANNOT_AFFORD_SINGLE_LOT' when instrument_class='INDEX_OPTIONS' and oi_lots<100 then 'INSUFFICIENT_OI' when instrument_class='INDEX_OPTIONS' and bid_ask_spread_pct>0.08 then 'BID_ASK_TOO_WIDE' "
    "when instrument_class='COMMODITY_FUTURES' and daily_volume_lots<500 or instrument_class='CURRENCY_FUTURES' and daily_volume_lots<1000 then 'INSUFFICIENT_VOLUME' "
    "when exists (select 1 from positions p where p.underlying=s.underlying and p.direction=s.direction and p.holding_period=s.holding_period) then 'DUPLICATE_POSITION_TUPLE' else 'OK' end reason from signals s, bk",
    "va": "select rk.* exclude (reason), case when reason<>'OK' then reason when coalesce(e.decay_flag,0)=1 then 'EDGE_DECAYED' when rk.edge_id in ('SEED-001','SEED-003') and (direction='LONG' and trigger_value> -1.5 or direction='SHORT' and trigger_value<1.5) then 'SIGNAL_STRENGTH_INSUFFICIENT' else 'OK' end reason from rk left join edges e on rk.edge_id=e.edge_id",
}
register("d16_risk_gate", lambda s, d: gate.risk(S(s, d), fx.positions(s)).select("event_id", "reason"), fx.sql("select event_id, reason from rk", **RISK))
register(
    "d17_liquidity",
    lambda s, d: S(s, d).select("event_id", gate.liquidity_reason(F.col("instrument_class"), F.col("oi_lots"), F.col("bid_ask_spread_pct"), F.col("daily_volume_lots")).alias("reason")),
    fx.sql("select event_id, case when instrument_class='INDEX_OPTIONS' and oi_lots<100 then 'INSUFFICIENT_OI' when instrument_class='INDEX_OPTIONS' and bid_ask_spread_pct>0.08 then 'BID_ASK_TOO_WIDE' when instrument_class='COMMODITY_FUTURES' and daily_volume_lots<500 or instrument_class='CURRENCY_FUTURES' and daily_volume_lots<1000 then 'INSUFFICIENT_VOLUME' end reason from signals"),
)


def exits(s, d):
    i = F.col("event_id")
    rows = S(s, d).select(
        "event_id", (i % 2 == 0).alias("opt"), F.when(i % 5 > 0, i % 50 / 100.0).alias("theta"), (i % 17).alias("held"), F.when(i % 3 > 0, F.col("trigger_value")).alias("move"), (i % 31 / 100.0).alias("vix"), F.when(i % 4 > 0, F.col("trigger_value")).alias("basis")
    )
    c = F.col
    return rows.select("event_id", gate.mid_hold_exit(c("opt"), c("theta"), c("held"), c("move"), c("vix"), c("basis")).alias("reason"))


register(
    "d19_mid_hold_exits",
    exits,
    fx.sql(
        "select event_id, case when opt and theta>0.30 then 'THETA_STOP' when held>=15 then 'HARD_EXPIRY' when move>2.5 then 'VOL_SPIKE' when opt and vix>0.25 then 'VIX_SPIKE_OPTION_EXIT' when abs(basis)>2 then 'BASIS_DISLOCATION' else 'HOLD' end reason from x",
        x="select event_id, event_id%2=0 opt, case when event_id%5>0 then event_id%50/100.0::double end theta, event_id%17 held, case when event_id%3>0 then trigger_value end as move, event_id%31/100.0::double vix, case when event_id%4>0 then trigger_value end basis from signals",
    ),
)
register(
    "d20_daily_reset",
    lambda s, d: S(s, d).select("event_id", gate.after_reset(F.element_at(F.array(F.lit("SINGLE_DAY_LOSS_4PCT"), F.lit("DRAWDOWN_9.0%"), F.lit(None).cast("string")), (F.col("event_id") % 3 + 1).cast("int"))).alias("halt")),
    fx.sql("select event_id, case event_id%3 when 1 then 'DRAWDOWN_9.0%' end halt from signals"),
)
register("d25_bandit_sizing", lambda s, d: gate.size(S(s, d).withColumn("bandit_action", F.when(F.col("event_id") % 4 > 0, F.element_at(F.array(*map(F.lit, learn.ACTIONS)), (F.col("event_id") % 4 + 1).cast("int")))), trades=200).select("event_id", "size_multiplier"), fx.sql("select event_id, case event_id%4 when 1 then 0.5::double when 2 then 1.0 when 3 then 1.5 else case when confidence>=0.70 then 1.0 when confidence>=0.50 then 0.75 else 0.50 end end size_multiplier from signals"))
VALID = lambda s, d: gate.validate(S(s, d), fx.positions(s), fx.edges(s))
register("d21_validator", lambda s, d: VALID(s, d).select("event_id", "decision", "reason"), fx.sql("select event_id, case when reason='OK' then 'APPROVED' else 'REJECTED' end decision, reason from va", **RISK))
register("d22_strength", lambda s, d: S(s, d).select("event_id", gate.strong(F.col("edge_id"), F.col("direction"), F.col("trigger_value")).alias("strong")), fx.sql("select event_id, not (edge_id in ('SEED-001','SEED-003') and (direction='LONG' and trigger_value> -1.5 or direction='SHORT' and trigger_value<1.5)) strong from signals"))
SELECT = {
    "ap": "select * from va where reason='OK' and holding_period not in (select h from (values (2,3),(5,2),(10,2),(15,1)) t(h, most) where (select count(*) from positions p where p.holding_period=h)>=most)",
    "a1": "select * from ap qualify row_number() over (partition by day, instrument_class order by event_id)<=2",
    "a2": "select *, edge_win_rate+case when confidence>0.70 then 0.05 else 0 end score from a1 qualify row_number() over (partition by day, underlying, direction order by event_id)=1",
}
APPROVED = lambda s, d: gate.select_trades(VALID(s, d).where("decision = 'APPROVED'"), fx.positions(s), "event_id", ["day"])
register("d23_selection", lambda s, d: APPROVED(s, d).select("day", "event_id", "score", "rank"), fx.sql("select day, event_id, round(score,6) score, row_number() over (partition by day order by score desc, event_id) rank from a2", **RISK, **SELECT))
register("d24_score", lambda s, d: S(s, d).select("event_id", gate.score(F.col("edge_win_rate"), F.col("confidence")).alias("score")), fx.sql("select event_id, round(edge_win_rate+case when confidence>0.70 then 0.05 else 0 end,6) score from signals"))
TIER = "case when confidence>=0.70 then 1.0::double when confidence>=0.50 then 0.75 else 0.50 end"
register(
    "d25_sizing",
    lambda s, d: gate.size(S(s, d)).select("event_id", "size_multiplier", "recommended_lots", "confidence_score"),
    fx.sql(f"select event_id, {TIER} size_multiplier, cast(greatest(1,floor(94500.0::double*{TIER}/margin_per_lot)) as bigint) recommended_lots, round(confidence*{TIER},6) confidence_score from signals where margin_per_lot>0").replace("where margin_per_lot>0", ""),
)
register(
    "d26_waitlist",
    lambda s, d: fx.ledger(s, d).where(gate.still_waiting(F.col("signal_date"), F.lit("2001-03-05").cast("date"), F.col("holding_period")) & (F.col("signal_date") <= F.lit("2001-03-05").cast("date"))).select("signal_id"),
    fx.sql("select signal_id from ledger where signal_date<=date '2001-03-05' and date '2001-03-05'-signal_date <= case holding_period when 2 then 0 when 5 then 2 when 10 then 3 else 4 end"),
)
register("d27_slippage", lambda s, d: S(s, d).select("event_id", gate.max_slippage(F.col("instrument_class"), F.col("holding_period")).alias("slippage")), fx.sql("select event_id, case when instrument_class='INDEX_OPTIONS' then case holding_period when 2 then 0.05::double when 5 then 0.06 when 10 then 0.08 else 0.10 end else case holding_period when 2 then 0.0015::double when 5 then 0.0020 when 10 then 0.0025 else 0.0030 end end slippage from signals"))
SHADOW = {
    "s0": f"select signal_id, ai2_decision, case underlying when 'ALL_INDICES' then 'A' when 'GOLD' then 'GOLD_USD' else underlying end instrument, signal_date, least(date '{fx.AS_OF}', signal_date+cast(floor(holding_period*1.5) as int)) leave from ledger where shadow_outcome is null and signal_date<=date '{fx.AS_OF}'",
    "s1": "select s0.*, f.close entry from s0 asof join feat f on s0.instrument=f.instrument and s0.signal_date>=f.date",
    "s2": "select s1.*, f.close out, f.date found from s1 asof join feat f on s1.instrument=f.instrument and s1.leave>=f.date",
    "s3": "select *, case when contains(ai2_decision,'SHORT') then -1 else 1 end*(out-entry)/entry gain from s2",
}
register("d28_shadow_outcomes", lambda s, d: ledger.shadow_outcomes(fx.ledger(s, d), FE(s, d), fx.AS_OF, "A"), fx.sql("select signal_id, case when gain>0 then 'WIN' else 'LOSS' end shadow_outcome, round(gain*100,6) shadow_return_pct, found exit_date from s3", **SHADOW))
RATES = {"hr": "select e.*, live_wins+coalesce(w,0) wins, live_losses+coalesce(n-w,0) losses from edges e left join (select edge_id k, count(*) filter (net_return_pct>0) w, count(*) n from trades group by 1) on k=edge_id"}
register("d29_hit_rates", lambda s, d: ledger.hit_rates(fx.edges(s), T(s, d)).select("edge_id", "live_wins", "live_losses", "live_hit_rate"), fx.sql("select edge_id, wins live_wins, losses live_losses, round(wins/(wins+losses),6) live_hit_rate from hr", **RATES))
register(
    "d30_decay",
    lambda s, d: ledger.hit_rates(fx.edges(s), T(s, d)).select("edge_id", ledger.decay(F.col("win_rate"), F.col("live_wins"), F.col("live_losses")).alias("x")).select("edge_id", "x.*"),
    fx.sql(
        "select edge_id, po<win_rate-0.05 and n>=20 watch_flag, case when po<win_rate-0.05 and n>=20 then round(po,6) end posterior_win_rate, po<win_rate-0.08 and n>=30 decay_flag from (select edge_id, win_rate, (win_rate*20+wins)/(20+wins+losses) po, wins+losses n from hr)",
        **RATES,
    ),
)
register(
    "d30_decay_by_period",
    lambda s, d: T(s, d).groupBy("edge_id", "holding_period").agg(F.count_if(F.col("net_return_pct") > 40).alias("w"), F.count_if(F.col("net_return_pct") <= 40).alias("l")).join(fx.edges(s).select("edge_id", "win_rate"), "edge_id")
    .select("edge_id", "holding_period", ledger.decay(F.col("win_rate"), F.col("w"), F.col("l")).alias("x")).select("edge_id", "holding_period", "x.*"),
    fx.sql(
        "select edge_id, holding_period, po<win_rate-0.05 and n>=20 watch_flag, case when po<win_rate-0.05 and n>=20 then round(po,6) end posterior_win_rate, po<win_rate-0.08 and n>=30 decay_flag "
        "from (select t.edge_id, t.holding_period, win_rate, (win_rate*20+w)/(20+n) po, n from t join edges e on t.edge_id=e.edge_id)",
        t="select edge_id, holding_period, count(*) filter (net_return_pct>40) w, count(*) n from trades group by 1,2",
    ),
)


def book_events(s, d):
    """Signals of 16 portfolios; every fifth event closes an earlier trade of its portfolio, and some end the day."""
    i = F.col("event_id")
    rows = S(s, d).withColumns({
        "portfolio": F.concat(F.lit("P"), (i % 16).cast("string")), "seq": i, "kind": F.when(i % 211 == 0, "reset").when(i % 5 == 4, "close").otherwise("signal"),
        "trade_id": F.concat(F.lit("T"), F.when(i % 5 == 4, i - 48).otherwise(i).cast("string")), "lot_value": F.col("lot_value") * 2, "margin_per_lot": F.col("margin_per_lot") / 2,
        "liquidity": gate.liquidity_reason(F.col("instrument_class"), F.col("oi_lots"), F.col("bid_ask_spread_pct"), F.col("daily_volume_lots")), "pnl": F.when(i % 5 == 4, F.round(F.col("trigger_value") * 1000, 2)),
    })
    return rows.select(*(c.split()[0] for c in state.EVENT.split(", ")))


register("t06_books", lambda s, d: state.book_replay(book_events(s, d)))
register("d32_bandit_cold", lambda s, d: S(s, d).select("event_id", gate.bandit_cold(F.col("edge_win_rate") + F.col("confidence") / 5).alias("action")), fx.sql("select event_id, case when edge_win_rate+confidence/5>0.65 then 'MEDIUM' when edge_win_rate+confidence/5>0.58 then 'SMALL' else 'SKIP' end as action from signals"))
register("d32_bandit_warm", lambda s, d: learn.bandit_choose(replay(s, d).select("event_id", "context"), learn.bandit_sums(replay(s, d))).select("event_id", "bandit_action"))
register("d33_context", lambda s, d: replay(s, d).select("event_id", F.posexplode("context").alias("i", "x")), fx.sql(f"select event_id, i-1 i, round(x[i],6) x from (select event_id, cast({X} as double[]) x from signals), generate_series(1,10) g(i)"))


def observations(s, d):
    params = list(learn.BOUNDS)
    i = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, params)), (i % 4 + 1).cast("int"))
    low, high = (F.try_element_at(gate.literal_map({k: v[j] for k, v in learn.BOUNDS.items()}), name) for j in (0, 1))
    at = low + (high - low) * (i % 41) / 40.0
    return S(s, d).select(name.alias("param"), at.alias("threshold"), (-F.pow((i % 41) / 40.0 - 0.3, F.lit(2.0)) + 0.01 * F.col("trigger_value")).alias("pnl"))


def meta(s, d):
    rows = S(s, d).withColumn("net_return_pct", F.col("trigger_value") * F.when(F.col("direction") == "LONG", 1).otherwise(-1) + F.col("holding_period") % 5)
    model = learn.meta_fit(rows.where("event_id % 5 > 0"))
    return learn.meta_score(rows.where("event_id % 5 = 0"), model).select("event_id", "meta_pass", (F.col("net_return_pct") > 0).alias("truth"))


register(
    "d34_cells",
    lambda s, d: learn.threshold_cells(observations(s, d)),
    fx.sql(
        "select param, round(round((least(hi,greatest(lo,x))-lo)/((hi-lo)/1000))*((hi-lo)/1000)+lo,6) threshold, round(avg(pnl),6) pnl, round(avg(pnl*pnl),6) squares, count(*) n from o group by param, lo, hi, round((least(hi,greatest(lo,x))-lo)/((hi-lo)/1000))",
        o=f"select b.param, b.lo, b.hi, b.lo+(b.hi-b.lo)*(event_id%41)/40.0::double x, -power((event_id%41)/40.0::double-0.3,2)+0.01*trigger_value pnl from signals s join (values {', '.join(f'({i}, {k!r}, {v[0]}::double, {v[1]}::double)' for i, (k, v) in enumerate(learn.BOUNDS.items()))}) b(i, param, lo, hi) on s.event_id%4=b.i",
    ),
)
register("d34_thresholds", lambda s, d: learn.thresholds(observations(s, d)))
register("d35_meta_labels", meta)

# batch twins of the streams
register(
    "t03_first_of_local_day",
    lambda s, d: S(s, d).withColumn("local_date", F.to_date(F.from_utc_timestamp("ts", "Asia/Kolkata"))).groupBy("local_date", "edge_id", "underlying", "direction").agg(F.min("event_id").alias("event_id")),
    fx.sql("select cast(ts+interval 330 minute as date) local_date, edge_id, underlying, direction, min(event_id) event_id from signals group by all"),
)
register(
    "t09_daily_bars",
    lambda s, d: fx.table(s, d, "events").groupBy(F.col("event_type").alias("instrument"), F.to_date("ts").alias("date")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")),
    "select event_type instrument, cast(ts as date) date, arg_min(value,ts) open, max(value) high, min(value) low, arg_max(value,ts) as close, count(*) volume from events group by 1,2",
)

register(
    "t05_batch_pipeline",
    lambda s, d: live.opened(live.simulated_fills(gate.size(APPROVED(s, d)))),
    fx.sql("select 'SIM_'||event_id trade_id, instrument_class, underlying, direction, holding_period, margin_per_lot margin from a2", **RISK, **SELECT),
)

# sources and schemas
register(
    "p01_clean",
    lambda s, d: source.clean(B(s, d).withColumns({"date": F.col("date").cast("timestamp") + F.expr("interval 9 hours"), "close": F.when(F.col("volume") % 7 == 0, float("nan")).otherwise(F.col("close")), "open": F.when(F.col("volume") % 5 == 0, float("nan")).otherwise(F.col("open"))}).withColumnsRenamed({"close": "Close", "open": "OPEN"})),
    fx.sql("select instrument, date, case when volume%5<>0 then open end open, high, low, close, volume from bars where volume%7<>0"),
)
register(
    "s07_first_source_with_rows",
    lambda s, d: source.resolve_source(("missing", lambda: fx.table(s, d, "no_such_table")), ("empty", lambda: B(s, d).where("false")), ("stored", lambda: B(s, d))).select("instrument", "date", "close", "source"),
    fx.sql("select instrument, date, close, 'stored' source from bars"),
)
register(
    "u04_conformed",
    lambda s, d: schema.conform(T(s, d), "trade_log"),
    fx.sql("select trade_id, edge_id, instrument_class, cast(null as varchar) direction, holding_period, net_return_pct, cast(null as varchar) regime_at_entry, exit_date, cast(null as int) won from trades"),
)

# synthetic sources
register("s08_synthetic_bars", lambda s, d: source.synthetic_bars(s, "2010-01-01", "2012-12-31"))
register("s09_mean_reverting", lambda s, d: source.mean_reverting(s, "2010-01-01", "2012-12-31"))
register("s10_regime_paths", lambda s, d: source.regime_paths(s, "2010-01-01", "2026-12-31"))


def closes(s, d):
    return T(s, d).select("edge_id", "exit_date", "o_orderkey", (F.col("net_return_pct") * 1000).alias("pnl"))


register(
    "d18_book_states",
    lambda s, d: gate.book_states(closes(s, d), "edge_id", ["exit_date", "o_orderkey"]).select("o_orderkey", "daily_pnl", "peak", "drawdown", "halt"),
    fx.sql(
        "select o_orderkey, round(daily_pnl,6) daily_pnl, round(peak,6) peak, round(drawdown,6) drawdown, h halt from b3",
        b1="select *, net_return_pct*1000 pnl, sum(net_return_pct*1000) over (partition by edge_id order by exit_date, o_orderkey) daily_pnl, greatest(1350000, max(1350000+net_return_pct*1000) over (partition by edge_id order by exit_date, o_orderkey)) peak from trades",
        b2="select *, (peak-1350000-pnl)/peak drawdown, case when (peak-1350000-pnl)/peak>0.08 then 'DRAWDOWN_'||format('{:.1f}%', (peak-1350000-pnl)/peak*100) when daily_pnl< -54000 then 'SINGLE_DAY_LOSS_4PCT' end why0 from b1",
        b3="select *, first_value(why0 ignore nulls) over (partition by edge_id order by exit_date, o_orderkey rows between unbounded preceding and current row) h from b2",
    ),
)


def outcomes(s, d):
    i = F.col("event_id")
    return S(s, d).select(
        F.concat(F.lit("T"), i.cast("string")).alias("trade_id"), "edge_id", "instrument_class", "direction", "holding_period", F.col("trigger_value").alias("net_return_pct"), F.lit("SIDEWAYS").alias("regime_at_entry"),
        F.col("day").alias("exit_date"), F.concat(F.lit("S"), i.cast("string")).alias("signal_id"), F.when(i % 3 > 0, "SMALL").alias("bandit_action"), F.array(F.col("confidence")).alias("bandit_context"),
        F.lit("rsi_2_threshold").alias("trigger_feature"), F.col("confidence").alias("trigger_value"),
    )


def closed(part):
    return lambda s, d: ledger.trade_close(outcomes(s, d), fx.edges(s))[part]


register("d31_close_log", closed("log"), fx.sql("select 'T'||event_id trade_id, edge_id, instrument_class, direction, holding_period, trigger_value net_return_pct, 'SIDEWAYS' regime_at_entry, day exit_date, cast(trigger_value>0 as int) won from signals"))
register("d31_close_replay", closed("replay"), fx.sql("select 'R_T'||event_id transition_id, 'SMALL' as action, trigger_value reward, [confidence] context from signals where event_id%3>0"))
register("d31_close_observations", closed("observations"), fx.sql("select 'rsi_2_threshold' param, confidence threshold, trigger_value pnl from signals"))
register("d31_close_signals", closed("signals"), fx.sql("select 'S'||event_id signal_id, case when trigger_value>0 then 'WIN' else 'LOSS' end shadow_outcome, trigger_value shadow_return_pct, day exit_date from signals"))
register(
    "d31_close_edges",
    lambda s, d: closed("edges")(s, d).select("edge_id", "status", "decay_flag", "live_wins", "live_losses", "live_hit_rate"),
    fx.sql(
        "select edge_id, case when dk then 'DECAYED' else status end status, greatest(decay_flag, cast(dk as int)) decay_flag, w live_wins, l live_losses, round(w/(w+l),6) live_hit_rate from u2",
        u1="select e.*, live_wins+coalesce(cw,0) w, live_losses+coalesce(cn-cw,0) l from edges e left join (select edge_id k, count(*) filter (trigger_value>0) cw, count(*) cn from signals group by 1) on k=edge_id",
        u2="select *, (win_rate*20+w)/(20+w+l)<win_rate-0.08 and w+l>=30 dk from u1",
    ),
)
register(
    "s23_log_rows",
    lambda s, d: ledger.log_rows(H(s, d), ["transition_warning_flag"]).withColumn("regime_confidence", F.col("regime_confidence")),
    fx.sql("select sha256(cast(date as varchar)||'|'||regime_state) observation_id, date, regime_state, round(regime_confidence,6) regime_confidence, '{\"transition_warning_flag\":'||transition_warning_flag||'}' details from history"),
)
