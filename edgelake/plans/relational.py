"""Scans, projections, joins, aggregates, sorts and sets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from edgelake.constants import BULL, CAPITAL
from edgelake.functions.stats import floored, profit_factor, sharpe, t_statistic, win_rate
from edgelake.operators import asof, backtest, gate, ledger, learn, regime, scan
from edgelake.operators.features import features
from edgelake.plans import fixtures as fx
from edgelake.plans.registry import r, register
from edgelake.plans.windows import DAILY
from edgelake.sources import bars as source

B, FE, T, S, H = fx.bars, (lambda s, d: features(fx.bars(s, d))), fx.trades, fx.signals, fx.history
BAR = "instrument, date, open, high, low, close, volume"
cast = lambda x: F.lit(x).cast("date")

# scans
register("s01_scan", B, fx.sql(f"select {BAR} from bars"))
register("s02_two_columns", lambda s, d: B(s, d).where("instrument = 'N'").select("date", "close"), fx.sql("select date, close from bars where instrument='N'"))
register(
    "s04_instruments",
    lambda s, d: fx.table(s, d, "lineitem").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("l_returnflag").alias("instrument")).groupBy("file", "instrument").count().select("file", "instrument", F.col("count").alias("n")),
    "select 'lineitem.parquet' file, l_returnflag instrument, count(*) n from lineitem group by 2",
)


def upsert(s, d):
    old = B(s, d).where(F.col("date") <= cast("2000-12-31"))
    new = B(s, d).where(F.col("date") >= cast("2000-11-01")).withColumn("close", F.round(F.col("close") + 1.0, 4))
    return ledger.upsert_latest(old, new, ["instrument", "date"])


register("s12_upsert", upsert, fx.sql("select instrument, date, open, high, low, case when date>=date '2000-11-01' then round(close+1.0,4) else close end close, volume from bars"))
register(
    "s13_append_newer",
    lambda s, d: ledger.append_newer(H(s, d).where(F.col("date") <= cast("2000-06-30")).select("date", "regime_state"), H(s, d).select("date", F.lit("NEW").alias("regime_state"))),
    fx.sql("select date, case when date<=date '2000-06-30' then regime_state else 'NEW' end regime_state from history"),
)
register("s14_latest", lambda s, d: H(s, d).agg(F.max_by(F.struct("date", "regime_state", "regime_confidence"), "date").alias("x")).select("x.*"), fx.sql(f"select date, regime_state, {r('regime_confidence')} from history order by date desc limit 1"))
register(
    "s15_point_lookup",
    lambda s, d: H(s, d).join(F.broadcast(s.createDataFrame([("1999-03-01",), ("2000-02-02",), ("1900-01-01",)], "date string").withColumn("date", F.to_date("date"))), "date").select("date", "regime_state"),
    fx.sql("select date, regime_state from history where date in (date '1999-03-01', date '2000-02-02', date '1900-01-01')"),
)
register("s16_active", lambda s, d: fx.edges(s).where("status = 'ACTIVE'").select("edge_id", "win_rate"), fx.sql("select edge_id, win_rate from edges where status='ACTIVE'"))
register("s17_pending", lambda s, d: fx.ledger(s, d).where(F.col("shadow_outcome").isNull() & (F.col("signal_date") <= cast("2001-03-31"))), fx.sql("select * from ledger where shadow_outcome is null and signal_date<=date '2001-03-31'"))
register("s18_full_table", lambda s, d: fx.ledger(s, d), fx.sql("select * from ledger"))
register(
    "s19_keyed_reads",
    lambda s, d: S(s, d).join(F.broadcast(fx.edges(s).select("edge_id", "decay_flag", "live_wins", "live_losses", "win_rate")), "edge_id", "left").select("event_id", "edge_id", "decay_flag", "live_wins", "live_losses", "win_rate"),
    fx.sql("select s.event_id, s.edge_id, decay_flag, live_wins, live_losses, win_rate from signals s left join edges e on s.edge_id=e.edge_id"),
)
register("s20_project_order", lambda s, d: fx.edges(s).where("decay_flag = 0").select("edge_id", "win_rate").orderBy("edge_id"), fx.sql("select edge_id, win_rate from edges where decay_flag=0 order by edge_id"))


def insert(s, d):
    rows = fx.ledger(s, d).select("signal_id", "edge_id", "ai2_decision")
    return ledger.insert_absent(rows.where("edge_id <> 'SEED-001'"), rows.withColumn("ai2_decision", F.lit("NEW")).union(rows.withColumn("ai2_decision", F.lit("NEWER"))), "signal_id", "ai2_decision")


register("s21_insert_absent", insert, fx.sql("select signal_id, edge_id, case when edge_id='SEED-001' then 'NEW' else ai2_decision end ai2_decision from ledger"))
register(
    "s22_update",
    lambda s, d: ledger.update(fx.ledger(s, d), fx.ledger(s, d).where("holding_period = 5").select("signal_id", F.lit("WIN").alias("shadow_outcome"), F.lit(None).cast("string").alias("ai2_decision")), "signal_id"),
    fx.sql("select signal_id, edge_id, signal_date, underlying, holding_period, case when holding_period=5 then null else ai2_decision end ai2_decision, case when holding_period=5 then 'WIN' else shadow_outcome end shadow_outcome from ledger"),
)
register("s26_seed_table", lambda s, d: fx.edges(s).select("edge_id", "holding_period", "edge_regime", "edge_direction", "win_rate"), fx.sql("select edge_id, holding_period, edge_regime, edge_direction, win_rate from edges"))
register(
    "s29_simulated_fill",
    lambda s, d: S(s, d).select("event_id", F.concat(F.lit("SIM_"), F.col("event_id").cast("string")).alias("order_id"), F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("lot_value")), F.lit(0.0)).alias("fill_price")),
    fx.sql("select event_id, 'SIM_' || cast(event_id as varchar) order_id, coalesce(case when event_id%3=0 then lot_value end,0) fill_price from signals"),
)
register("s31_summary", lambda s, d: source.summary(B(s, d), "1995-01-03"), fx.sql("""select instrument, min(date) "start", max(date) "end", count(*) "rows", case when min(date)>date '1995-01-03' then 'INSUFFICIENT_HISTORY' else 'OK' end status from bars group by 1"""))

# projections and predicates
register(
    "p02_days_and_slices",
    lambda s, d: fx.table(s, d, "events").select("event_id", F.to_date("ts").alias("day"), (F.to_date("ts") <= cast("2024-01-15")).alias("train"), F.to_date("ts").between(cast("2024-01-10"), cast("2024-01-20")).alias("inside")),
    "select event_id, cast(ts as date) as day, cast(ts as date)<=date '2024-01-15' as train, cast(ts as date) between date '2024-01-10' and date '2024-01-20' as inside from events",
)
register("p03_drop_nulls", lambda s, d: fx.ledger(s, d).dropna(subset=["ai2_decision", "shadow_outcome"]).select("signal_id"), fx.sql("select signal_id from ledger where ai2_decision is not null and shadow_outcome is not null"))
register("p04_slice", lambda s, d: B(s, d).where((F.col("date") >= cast("1999-01-01")) & (F.col("date") < cast("1999-07-01"))).select("instrument", "date", "close"), fx.sql("select instrument, date, close from bars where date>=date '1999-01-01' and date<date '1999-07-01'"))
register(
    "p07_scalars",
    lambda s, d: S(s, d).select(
        "event_id", F.try_divide(F.col("lot_value"), F.nullif(F.col("bid_ask_spread_pct"), F.lit(0.0))).alias("per_spread"), floored(F.col("trigger_value"), -0.35).alias("floored"), F.greatest(F.col("trigger_value"), F.lit(0.0)).alias("gain"),
        F.coalesce(F.col("trigger_value") > 0, F.lit(False)).cast("int").alias("up"), F.when(F.col("direction") == "LONG", 1).otherwise(-1).alias("sign"), F.col("instrument_class").isin("INDEX_OPTIONS", "SYNTHETIC_PAIR").alias("member"),
    ),
    fx.sql("select event_id, round(lot_value/nullif(bid_ask_spread_pct,0),6) per_spread, greatest(trigger_value,-0.35) floored, greatest(trigger_value,0) gain, cast(trigger_value>0 as int) up, case when direction='LONG' then 1 else -1 end sign, instrument_class in ('INDEX_OPTIONS','SYNTHETIC_PAIR') member from signals"),
)
register("p13_defaults", lambda s, d: fx.ledger(s, d).select("signal_id", F.coalesce("ai2_decision", F.lit("LONG")).alias("side"), F.coalesce("shadow_outcome", F.lit("OPEN")).alias("outcome")), fx.sql("select signal_id, coalesce(ai2_decision,'LONG') side, coalesce(shadow_outcome,'OPEN') outcome from ledger"))
register(
    "p16_regime_contains",
    lambda s, d: H(s, d).select("date", F.contains("regime_state", F.lit("BULL")).alias("bull"), F.col("regime_state").isin(BULL).alias("listed")),
    fx.sql("select date, contains(regime_state,'BULL') bull, regime_state in ('H_BULL','L_BULL') listed from history"),
)
register(
    "p17_sessions",
    lambda s, d: fx.table(s, d, "events").select("event_id", source.in_session(F.col("ts"), "09:15", "15:30").alias("exchange"), source.in_session(F.col("ts"), "09:00", "23:30").alias("commodity")),
    "select event_id, isodow(ts)<6 and hour(ts)*60+minute(ts) between 555 and 930 exchange, isodow(ts)<6 and hour(ts)*60+minute(ts) between 540 and 1410 commodity from events",
)

# joins
register("j01_index_and_vix", lambda s, d: fx.market(s, d).select("date", "close", "vix"), fx.sql("select date, close, vix from market"))


def mismatch(s, d):
    a, v = B(s, d).where("instrument = 'A'"), s.sql(fx.VIX, orders=fx.table(s, d, "orders"))
    one = a.select("date", F.lit(1).alias("a"), F.lit(0).alias("v")).union(v.select("date", F.lit(0), F.lit(1))).groupBy("date").agg(F.max("a").alias("a"), F.max("v").alias("v"))
    return one.agg(F.sum(F.col("a") * F.col("v")).alias("joined"), F.sum(F.col("a") + F.col("v") - 2 * F.col("a") * F.col("v")).alias("mismatched"))


register("j01_mismatch", mismatch, fx.sql("select (select count(*) from market) joined, (select count(*) from bars where instrument='A')+(select count(*) from vix)-2*(select count(*) from market) mismatched"))
register("j02_features_and_regime", lambda s, d: FE(s, d).join(H(s, d).select("date", "regime_state"), "date", "left").select("instrument", "date", "z_21d", "regime_state"), fx.sql("select instrument, f.date, round(z_21d,6) z_21d, regime_state from feat f left join history h on f.date=h.date"))
register("j03_reindex", lambda s, d: B(s, d).where("instrument = 'A'").select("date").join(H(s, d).select("date", "vix_close"), "date", "left"), fx.sql("select b.date, vix_close from bars b left join history h on b.date=h.date where instrument='A'"))
register("j04_calendar_fill", lambda s, d: backtest.daily_returns(T(s, d)), fx.sql("select date, round(ret,6) ret from daily", **DAILY))


def asof_query(s, d):
    left = fx.ledger(s, d).where("underlying in ('A','N','R')").select("signal_id", F.col("underlying").alias("instrument"), F.col("signal_date").alias("date"))
    return asof.asof(left, FE(s, d).select("instrument", "date", "close"), "date", ["instrument"], ["close"])


register("j05_asof", asof_query, fx.sql("select l.signal_id, l.underlying instrument, l.signal_date date, f.close from ledger l asof left join feat f on l.underlying=f.instrument and l.signal_date>=f.date where l.underlying in ('A','N','R')"))


def asof_one_series(s, d):
    """Every line with the order before its shipment, over all lines and orders as a single series."""
    lines = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_date(F.to_date("l_shipdate")).alias("day"))
    days = fx.table(s, d, "orders").groupBy(F.unix_date(F.to_date("o_orderdate")).alias("day")).agg(F.max("o_orderkey").alias("last_order"), F.count("*").alias("orders"))
    return scan.asof(lines, days, "day", [], ["last_order", "orders"], scan.by_width(lines, "day", 64))


register(
    "j05_asof_one_series",
    asof_one_series,
    "select l_orderkey, l_linenumber, l.day as day, last_order, orders from (select *, l_shipdate::date-date '1970-01-01' as day from lineitem) l asof left join (select o_orderdate::date-date '1970-01-01' as day, max(o_orderkey) last_order, count(*) orders from orders group by 1) o on l.day>=o.day",
)


def grid_asof(s, d):
    days = H(s, d).where(F.weekday("date") < 5).select("date")
    grid = days.crossJoin(F.broadcast(s.createDataFrame([("A",), ("N",), ("R",)], "instrument string")))
    return asof.asof(grid, FE(s, d).select("instrument", "date", "z_21d", F.col("date").alias("row_date")), "date", ["instrument"], ["z_21d", "row_date"])


register(
    "j06_latest_row_of_day",
    grid_asof,
    fx.sql("select g.instrument, g.date, round(f.z_21d,6) z_21d, f.date row_date from g asof left join feat f on g.instrument=f.instrument and g.date>=f.date", g="select i.instrument, h.date from history h, (values ('A'),('N'),('R')) i(instrument) where isodow(h.date)<6"),
)
EDGE_DAYS = "select date, edge_id from history h join edges e on e.edge_regime='ALL' or h.regime_state=e.edge_regime or contains(h.regime_state, e.edge_regime)"
register(
    "j07_edges_by_regime",
    lambda s, d: H(s, d).join(F.broadcast(fx.edges(s)), F.expr("edge_regime = 'ALL' or regime_state = edge_regime or contains(regime_state, edge_regime)")).select("date", "edge_id"),
    fx.sql(EDGE_DAYS),
)
register(
    "j09_static_maps",
    lambda s, d: fx.ledger(s, d).select("signal_id", F.coalesce(F.try_element_at(gate.literal_map({"ALL_INDICES": "NIFTY", "GOLD": "GOLD_USD"}), F.col("underlying")), F.col("underlying")).alias("instrument")),
    fx.sql("select signal_id, case underlying when 'ALL_INDICES' then 'NIFTY' when 'GOLD' then 'GOLD_USD' else underlying end instrument from ledger"),
)
register(
    "j10_trading_days",
    lambda s, d: backtest.trading_days(H(s, d), *fx.TEST),
    fx.sql(f"select date as day, regime_state from history where date between date '{fx.TEST[0]}' and date '{fx.TEST[1]}' and isodow(date)<6 and not transition_warning_flag"),
)
PHASES = [("1995-01-01", "1997-06-30", 0.1), ("1997-01-01", "1998-12-31", 0.2), ("2000-01-01", "2000-12-31", 0.3)]


def range_join(s, d):
    phases = s.createDataFrame([(i, *p) for i, p in enumerate(PHASES)], "seq int, start string, end string, drift double").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    return asof.in_range(B(s, d).where("instrument = 'A'").select("date"), phases, "date", {"drift": 0.05})


register(
    "j11_range_join",
    range_join,
    fx.sql(
        "select b.date, coalesce((select arg_max(drift, seq) from ph where b.date between a and z),0.05) drift from bars b where instrument='A'",
        ph="select seq, cast(a as date) a, cast(z as date) z, drift from (" + fx.values([(i, *p) for i, p in enumerate(PHASES)]) + ") t(seq, a, z, drift)",
    ),
)
register(
    "j12_not_yet_held",
    lambda s, d: S(s, d).join(F.broadcast(fx.positions(s).select("underlying", "direction").distinct()), ["underlying", "direction"], "left_anti").select("event_id"),
    fx.sql("select event_id from signals s where not exists (select 1 from positions p where p.underlying=s.underlying and p.direction=s.direction)"),
)
register(
    "j12_held",
    lambda s, d: S(s, d).join(F.broadcast(fx.positions(s).select("underlying", "direction", "holding_period").distinct()), ["underlying", "direction", "holding_period"], "left_semi").select("event_id"),
    fx.sql("select event_id from signals s where exists (select 1 from positions p where p.underlying=s.underlying and p.direction=s.direction and p.holding_period=s.holding_period)"),
)
register(
    "j13_decayed",
    lambda s, d: S(s, d).join(F.broadcast(fx.edges(s).select("edge_id", "decay_flag")), "edge_id", "left").select("event_id", (F.coalesce("decay_flag", F.lit(0)) == 1).alias("decayed")),
    fx.sql("select event_id, coalesce(decay_flag,0)=1 decayed from signals s left join edges e on s.edge_id=e.edge_id"),
)

# aggregates
NET = "net_return_pct"


def net():
    return F.col(NET)


register(
    "a01_returns_by_edge",
    lambda s, d: T(s, d).groupBy("edge_id").agg(win_rate(net()).alias("win_rate"), F.avg(net()).alias("avg_return"), F.avg(floored(net(), -35.0 / 2)).alias("avg_net"), t_statistic(net()).alias("t_stat"), F.count("*").alias("n")),
    fx.sql("select edge_id, round(avg(case when net_return_pct>0 then 1.0 else 0 end),6) win_rate, round(avg(net_return_pct),6) avg_return, round(avg(greatest(net_return_pct,-17.5)),6) avg_net, round(avg(net_return_pct)/(stddev_samp(net_return_pct)/sqrt(count(*))),6) t_stat, count(*) n from trades group by 1"),
)
register("a06_rejections", lambda s, d: ledger.rejection_analysis(fx.ledger(s, d)), fx.sql("""select edge_id, ai2_decision, count(*) "count", round(avg(case when shadow_outcome='WIN' then 1.0 else 0 end),6) win_rate from ledger where ai2_decision is not null group by 1,2"""))
register("a07_regime_counts", lambda s, d: H(s, d).groupBy("regime_state").agg(F.count("*").alias("n"), F.count_if("transition_warning_flag").alias("warnings")), fx.sql("select regime_state, count(*) n, count(*) filter (transition_warning_flag) warnings from history group by 1"))
register("a09_mean_by_exit", lambda s, d: T(s, d).groupBy("exit_date").agg(F.avg(net()).alias("mean_return")), fx.sql("select exit_date, round(avg(net_return_pct),6) mean_return from trades group by 1"))
register(
    "a10_coverage",
    lambda s, d: T(s, d).groupBy("edge_id").agg(F.count_distinct("instrument_class").alias("classes"), (F.size(F.array_except(F.array(F.lit(2), F.lit(5), F.lit(10)), F.collect_set("holding_period"))) == 0).alias("covered")),
    fx.sql("select edge_id, count(distinct instrument_class) classes, count(distinct holding_period) filter (holding_period in (2,5,10))=3 covered from trades group by 1"),
)
register("a12_by_holding_period", lambda s, d: T(s, d).groupBy("holding_period").agg(win_rate(net()).alias("win_rate"), F.count("*").alias("n")), fx.sql("select holding_period, round(avg(case when net_return_pct>0 then 1.0 else 0 end),6) win_rate, count(*) n from trades group by 1"))


def histogram(s, d):
    span = T(s, d).groupBy("edge_id").agg(F.min(net()).alias("low"), F.max(net()).alias("high"))
    rows = T(s, d).join(F.broadcast(span), "edge_id")
    rows = rows.withColumn("bin", F.least(F.floor((net() - F.col("low")) * 20 / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))), F.lit(19)).cast("long"))
    return rows.groupBy("edge_id", "bin").agg(F.count("*").alias("n"))


register("a13_histogram", histogram, fx.sql("select edge_id, cast(least(floor((net_return_pct-low)*20/nullif(high-low,0)),19) as bigint) bin, count(*) n from trades join (select edge_id e, min(net_return_pct) low, max(net_return_pct) high from trades group by 1) on e=edge_id group by 1,2"))
register(
    "a14_profit_factor",
    lambda s, d: T(s, d).groupBy("edge_id").agg(profit_factor(net()).alias("profit_factor")),
    fx.sql("select edge_id, round(sum(case when net_return_pct>0 then net_return_pct end)/sum(case when net_return_pct<0 then -net_return_pct end),6) profit_factor from trades group by 1"),
)
register(
    "a15_portfolio_line",
    lambda s, d: backtest.equity(backtest.daily_returns(T(s, d))).agg(sharpe(F.col("ret")).alias("sharpe"), F.max(F.abs("drawdown")).alias("max_drawdown"), F.count("*").alias("days")),
    fx.sql("select round(avg(ret)/stddev_samp(ret)*sqrt(252),6) sharpe, round(max(abs((equity-peak)/peak)),6) max_drawdown, count(*) as days from dd", **DAILY),
)
register(
    "a16_cagr",
    lambda s, d: T(s, d).groupBy("edge_id").agg(F.expm1(backtest.log_growth(net(), 0.001) * 252 / F.count("*")).alias("cagr")),
    fx.sql("select edge_id, round(power(exp(sum(ln(1+0.001*net_return_pct/100))),252.0/count(*))-1,6) cagr from trades group by 1"),
)
register("a18_margin", lambda s, d: fx.positions(s).groupBy("instrument_class").agg(F.sum("margin").alias("margin"), F.count("*").alias("n")), fx.sql("select instrument_class, sum(margin) margin, count(*) n from positions group by 1"))
register("a19_slots", lambda s, d: gate.slots(fx.positions(s)), fx.sql("select h holding_period, coalesce(n,0) used, most, coalesce(n,0)<most free from (values (2,3),(5,2),(10,2),(15,1)) t(h, most) left join (select holding_period, count(*) n from positions group by 1) on h=holding_period"))
register(
    "a20_compounded",
    lambda s, d: T(s, d).groupBy("edge_id").agg((math.log(CAPITAL) + backtest.log_growth(net())).alias("log_capital")),
    fx.sql("select edge_id, round(ln(1350000.0)+sum(ln(1+0.07*net_return_pct/100)),6) log_capital from trades group by 1"),
)
register("a21_spans", lambda s, d: B(s, d).groupBy("instrument").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.min_by("close", "date").alias("open_close"), F.max_by("close", "date").alias("end_close")), fx.sql('select instrument, min(date) "first", max(date) "last", count(*) n, arg_min(close,date) open_close, arg_max(close,date) end_close from bars group by 1'))
register("a22_standardized", lambda s, d: regime.standardized(regime.market_inputs(fx.market(s, d)), fx.TRAIN_END), fx.sql(f"select date, index_close, vix_close, {r('log_ret vol_5d vix')} from std"))
CARD = {
    "t": "select avg(case when net_return_pct>0 then 1.0 else 0 end) wr, sum(case when net_return_pct>0 then net_return_pct end)/sum(case when net_return_pct<0 then -net_return_pct end) pf, count(*) n, count(distinct instrument_class) k, 3-count(distinct holding_period) filter (holding_period in (2,5,10)) miss, sum(ln(1+0.07*net_return_pct/100)) lc from trades",
    "l": "select avg(ret)/stddev_samp(ret)*sqrt(252) sh, max(abs((equity-peak)/peak)) mdd, count(*) as days from dd",
    "c": "select 'sharpe_gt_1' criterion, sh>1 passed, sh actual, 1.0 threshold from t,l union all select 'max_dd_lt_8pct', mdd<0.08, mdd, 0.08 from t,l union all select 'win_rate_gt_50pct', wr>0.5, wr, 0.5 from t,l union all select 'profit_factor_gt_1p4', pf>1.4, pf, 1.4 from t,l union all select 'net_cagr_positive', exp(lc*252/days)-1>0, exp(lc*252/days)-1, 0 from t,l union all select 'min_100_trades', n>=100, n, 100 from t,l union all select 'all_holding_periods_covered', miss<=0, miss, 0 from t,l union all select 'all_instruments_covered', k>=1, k, 1 from t,l",
}
# returns of this fixture compound to astronomical rates, which are compared by their logarithm
register("a23_scorecard", lambda s, d: backtest.scorecard(T(s, d)).withColumn("actual", F.when(F.col("criterion") == "net_cagr_positive", F.log1p("actual")).otherwise(F.col("actual"))), fx.sql("select criterion, passed, round(case when criterion='net_cagr_positive' then ln(1+actual) else cast(actual as double) end,6) actual, cast(threshold as double) threshold from c union all select 'all', bool_and(passed), count(*) filter (passed), 8 from c", **DAILY, **CARD))


def replay(s, d):
    rows = S(s, d).withColumn("meta_score", F.lit(0.6))
    action = F.element_at(F.array(*map(F.lit, learn.ACTIONS)), (F.col("event_id") % 4 + 1).cast("int"))
    return rows.select("event_id", action.alias("action"), (F.col("trigger_value") / 10).alias("reward"), learn.context(rows).alias("context"))


X = "[confidence, 0.6, trigger_value, holding_period/15.0::double, case when instrument_class='INDEX_OPTIONS' then 1.0 else 0 end, case when direction='LONG' then 1.0 else 0 end, 0.55, 0, 0, 7/30.0::double]"
register(
    "a24_outer_products",
    lambda s, d: learn.bandit_sums(replay(s, d)),
    fx.sql(
        "select action, i-1 i, j-1 j, round(sum(x[i]*x[j])+case when i=j then 1 else 0 end,6) a, case when j=1 then round(sum(reward*x[i]),6) end b from rp, generate_series(1,10) g(i), generate_series(1,10) k(j) group by action, i, j",
        rp=f"select case event_id%4 when 0 then 'SKIP' when 1 then 'SMALL' when 2 then 'MEDIUM' else 'LARGE' end action, trigger_value/10 reward, cast({X} as double[]) x from signals",
    ),
)

# sorts and limits
register("k02_ranked", lambda s, d: gate.select_trades(S(s, d), fx.positions(s), "event_id", ["day"], 2).select("day", "event_id", "score", "rank"), fx.sql(
    "select day, event_id, round(score,6) score, row_number() over (partition by day order by score desc, event_id) rank from c",
    a="select * from (select *, row_number() over (partition by day, instrument_class order by event_id) n from signals where holding_period not in (select h from (values (2,3),(5,2),(10,2),(15,1)) t(h, most) where (select count(*) from positions p where p.holding_period=h)>=most)) where n<=2",
    c="select *, edge_win_rate+case when confidence>0.70 then 0.05 else 0 end score from (select *, row_number() over (partition by day, underlying, direction order by event_id) n2 from a) where n2=1",
))
register("k03_top_abs", lambda s, d: FE(s, d).orderBy(F.desc(F.abs("z_21d")), "instrument", "date").limit(5).select("instrument", "date", "z_21d"), fx.sql("select instrument, date, round(z_21d,6) z_21d from feat order by abs(z_21d) desc, instrument, date limit 5"))
register("k04_tail", lambda s, d: H(s, d).orderBy(F.desc("date")).limit(5).select("date", "regime_state"), fx.sql("select date, regime_state from history order by date desc limit 5"))
register("k05_argmax", lambda s, d: H(s, d).select("date", F.array_position(F.array(*(F.col(f"prob_{k}") for k in fx.STATES)), F.col("regime_confidence")).alias("state")), fx.sql("select date, list_position([" + ", ".join(f"prob_{k}" for k in fx.STATES) + "], regime_confidence) state from history"))



def capped(s, d):
    """Orders as candidate trades of 30 instruments in two directions."""
    rows = fx.table(s, d, "orders").select(
        F.format_string("I%02d", F.col("o_custkey") % 30).alias("instrument"), F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("seq"), F.element_at(F.array(*map(F.lit, (2, 5, 10, 15))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("holding_period"),
    )
    return backtest.greedy(rows, rows.select("day").distinct(), 60).select("instrument", "direction", "day", "seq", "exit_day")


register(
    "k06_position_cap",
    capped,
    # one candidate after another, with the list of open trades
    """with recursive o as (select 'I'||lpad((o_custkey%30)::varchar,2,'0') instrument, case when o_orderkey%2=0 then 'LONG' else 'SHORT' end direction, o_orderdate::date as day, o_orderkey seq, [2,5,10,15][o_orderkey%4+1]::int hold from orders),
    days as (select distinct day as d from o),
    e as (select o.*, x.d exit_day from o asof left join days x on o.day+o.hold<=x.d),
    c as materialized (select *, row_number() over (order by day, instrument, seq) n from (select * from e qualify row_number() over (partition by instrument, direction, day order by seq)=1)),
    walk(n, held, taken) as (select 0::bigint, []::struct(p varchar, e date)[], false
      union all
      select n, case when ok then list_append(still, {'p': pair, 'e': coalesce(exit_day, date '9999-12-31')}) else still end, ok
      from (select *, len(still)<8 and len(list_filter(still, lambda x: x.p=pair))=0 ok
        from (select c.n, c.exit_day, c.instrument||c.direction pair, list_filter(walk.held, lambda x: x.e>c.day) still from walk join c on c.n=walk.n+1)))
    select instrument, direction, day, seq, exit_day from c join walk using (n) where taken""",
)

# sets
register("u01_union_all", lambda s, d: H(s, d).where(F.col("date") <= cast(fx.TRAIN_END)).select("date", F.lit("IS").alias("segment")).unionByName(H(s, d).where(F.col("date") > cast(fx.TRAIN_END)).select("date", F.lit("OOS").alias("segment"))), fx.sql(f"select date, case when date<=date '{fx.TRAIN_END}' then 'IS' else 'OOS' end segment from history"))
register("u03_except", lambda s, d: S(s, d).select("event_id").join(S(s, d).where("holding_period = 2").select("event_id"), "event_id", "left_anti"), fx.sql("select event_id from signals where holding_period<>2"))
