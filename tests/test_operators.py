"""Operators on small hand-made frames, learners by their properties, and the streams against their batch twins."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelake.functions.pricing import at_the_money, atm_premium, black_scholes, normal_cdf
from edgelake.functions.stats import profit_factor, sharpe, student_p
from edgelake.operators import asof, backtest, gate, learn, ledger, markov, positions, regime, scan
from edgelake.operators.features import features, with_features
from edgelake.plans import fixtures as fx
from edgelake.sources import bars as source
from edgelake.streaming import live

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, opens=None, name="A"):
    rows = [(name, DAY + dt.timedelta(days=i), float(o), float(c), float(c), float(c), 1) for i, (c, o) in enumerate(zip(closes, opens or closes, strict=True))]
    return spark.createDataFrame(rows, source.BAR)


def test_rising_prices_have_no_rsi_and_no_feature_row(spark):
    rows = with_features(bars(spark, range(100, 140))).collect()
    assert all(r["rsi_2"] is None and r["rsi_14"] is None for r in rows)
    assert [r["up_streak"] for r in rows] == list(range(40)) and {r["down_streak"] for r in rows} == {0}
    assert features(bars(spark, range(100, 140))).count() == 0


def test_constant_prices_have_no_zscore(spark):
    rows = with_features(bars(spark, [100.0] * 30)).collect()
    assert all(r["z_21d"] is None and r["vol_ratio_vols"] is None and r["pct_from_hi"] is None for r in rows)
    assert {r["vol_expanding"] for r in rows} == {0} and rows[0]["ret_1d"] is None and rows[1]["ret_1d"] == 0


def test_frames_wait_for_enough_rows(spark):
    closes = [100 + (i * 7) % 5 for i in range(30)]
    rows = with_features(bars(spark, closes)).orderBy("date").collect()
    assert [r["vol_5d"] is None for r in rows[:7]] == [True] * 5 + [False] * 2
    assert [r["z_21d"] is None for r in rows[19:22]] == [True, False, False]
    x = np.array(closes[:21], float)
    assert rows[20]["z_21d"] == pytest.approx((x[-1] - x.mean()) / x.std(ddof=1))
    d = np.diff(closes[1:4])
    gain, loss = np.maximum(d, 0).mean(), -np.minimum(d, 0).mean()
    assert rows[3]["rsi_2"] == pytest.approx(100 - 100 / (1 + gain / loss))


def test_gap_that_stays_open(spark):
    rows = with_features(bars(spark, [100, 97, 99, 99], [100, 98, 95, 99])).orderBy("date").collect()
    assert [r["gap_unfilled_eod"] for r in rows] == [0, 1, 0, 0]


def test_corrected_skew(spark):
    from edgelake.functions.windows import sample_skew

    got = bars(spark, [1, 2, 4, 9]).select(sample_skew(F.col("close"), 4).alias("s")).collect()[-1]["s"]
    assert got == pytest.approx(1.330938, abs=1e-6)


def test_clean_turns_nan_into_null(spark):
    assert source.clean(bars(spark, [1.0, float("nan"), 3.0])).count() == 2


def price(spark, *cases):
    rows = spark.createDataFrame(cases, "s double, k double, t double, v double, kind string")
    return [r["b"] for r in rows.select(black_scholes(F.col("s"), F.col("k"), F.col("t"), 0.065, F.col("v"), F.col("kind")).alias("b")).collect()]


def test_prices(spark):
    call, put, over, still = price(spark, (100.0, 95.0, 0.25, 0.2, "call"), (100.0, 95.0, 0.25, 0.2, "put"), (100.0, 95.0, 0.0, 0.2, "call"), (90.0, 95.0, 0.25, 0.0, "put"))
    assert call["price"] - put["price"] == pytest.approx(100 - 95 * math.exp(-0.065 * 0.25))
    assert 0 < call["delta"] < 1 and call["delta"] - put["delta"] == pytest.approx(1) and call["gamma"] == pytest.approx(put["gamma"])
    assert (over["price"], over["delta"], over["theta"], over["gamma"]) == (5, 1, 0, 0) and (still["price"], still["delta"]) == (5, -1)
    with pytest.raises(Exception, match="call or put"):
        price(spark, (100.0, 95.0, 0.25, 0.2, "straddle"))
    # five days at the money cost about one percent of the price
    assert 0.007 <= price(spark, (100.0, 100.0, 5 / 252, 0.15, "call"))[0]["price"] / 100 <= 0.011


def test_normal_distribution_and_strikes(spark):
    xs = [-40.0, -8.0, -1.0, 0.0, 0.5, 3.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-15)
    strikes = [r[0] for r in spark.createDataFrame([(125.0,), (175.0,)], "s double").select(at_the_money(F.col("s"), F.lit(50.0))).collect()]
    assert strikes == [100.0, 200.0]  # halves go to the even multiple


def test_student_p_values():
    assert student_p(2.0, 11) == pytest.approx(0.0733880, abs=1e-6) and student_p(0.0, 5) == pytest.approx(1.0) and np.isnan(student_p(1.0, 1))
    assert student_p([2.0, float("nan"), 0.0], [11, 5, 5]).tolist() == pytest.approx([0.0733880, float("nan"), 1.0], abs=1e-6, nan_ok=True)
    assert student_p(12.706, 2) == pytest.approx(0.05, abs=1e-4)


def test_empty_and_single_returns(spark):
    rows = spark.createDataFrame([(0.5,)], "x double")
    one = rows.agg(sharpe(F.col("x")).alias("s"), profit_factor(F.col("x")).alias("p")).first()
    assert one["s"] == 0 and one["p"] == float("inf")


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("A", 1, 10), ("A", 5, 11), ("B", 5, 12), ("A", 3, 13)], "instrument string, date int, id int")
    right = spark.createDataFrame([("A", 2, 2.0), ("A", 3, 3.0), ("A", 6, 6.0)], "instrument string, date int, v double")
    got = {r["id"]: r["v"] for r in asof.asof(left, right, "date", ["instrument"], ["v"]).collect()}
    assert got == {10: None, 11: 3.0, 12: None, 13: 3.0}


def test_scans_in_blocks_equal_windows(spark):
    """Running values over random keys and blocks, with nulls in values and keys, are those of one window."""
    rng = random.Random(9)
    rows = [(rng.choice(["A", "A", "A", "B", None]), i, rng.choice([None, *range(-3, 4)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, x int")
    values = {"s": scan.total(F.col("x")), "n": scan.count(F.col("x")), "hi": scan.highest(F.col("x")), "lo": scan.lowest(F.col("x")), "z": scan.last(F.col("x"), [F.col("t")]), "p": scan.product(F.abs("x") + 1.0)}
    want = {}
    for key in ("A", "B", None):
        s = n = 0
        hi = lo = z = p = None
        for _, t, x in (r for r in rows if r[0] == key):
            if x is not None:
                s, n, hi, lo, z, p = s + x, n + 1, max(x, x if hi is None else hi), min(x, x if lo is None else lo), x, (p or 1.0) * (abs(x) + 1)
            want[key, t] = (s if n else None, n, hi, lo, z, p)
    for block in (scan.by_width(df, "t", 7), scan.by_rows(df, "t", 50), F.lit(0)):
        got = {(r["k"], r["t"]): r for r in scan.running(df, ["k"], ["t"], block, values).collect()}
        assert len(got) == len(rows)
        for k, w in want.items():
            assert tuple(got[k])[3:8] == w[:5] and (got[k]["p"] is None) == (w[5] is None) and (w[5] is None or got[k]["p"] == pytest.approx(w[5]))
    assert scan.running(df.where("false"), ["k"], ["t"], scan.by_rows(df.where("false"), "t"), values).count() == 0


def test_asof_in_blocks_equals_asof(spark):
    rng = random.Random(10)
    left = spark.createDataFrame([(rng.choice(["A", "B", None]), rng.randrange(300), i) for i in range(300)], "instrument string, date int, id int")
    right = spark.createDataFrame([(rng.choice(["A", "B"]), d, rng.choice([None, float(d)])) for d in range(0, 300, 3)], "instrument string, date int, v double")
    plain = sorted(map(tuple, asof.asof(left, right, "date", ["instrument"], ["v"]).collect()), key=str)
    for block in (scan.by_width(left, "date", 10), scan.by_rows(left, "date", 20)):
        assert sorted(map(tuple, scan.asof(left, right, "date", ["instrument"], ["v"], block).collect()), key=str) == plain


def test_one_long_series_is_spread(spark):
    """A million rows of one key: no block, so no task, holds more than a few hundredths of them."""
    df = spark.range(1_000_000).select(F.lit("A").alias("k"), F.col("id").alias("t"))
    block = scan.by_rows(df, "t", 20_000)
    assert df.groupBy(block).count().agg(F.max("count")).first()[0] < 40_000
    rows = scan.running(df, ["k"], ["t"], block, {"s": scan.total(F.col("t"))})
    assert rows.where(F.col("s") != F.col("t") * (F.col("t") + 1) / 2).count() == 0 and rows.count() == 1_000_000


def signal(**changes):
    base = {"underlying": "NIFTY", "instrument_class": "INDEX_OPTIONS", "direction": "LONG", "holding_period": 5, "lot_value": 75000.0, "margin_per_lot": 50000.0, "oi_lots": 500, "bid_ask_spread_pct": 0.02, "daily_volume_lots": 2000}
    return base | {"transition_warning_flag": False, "edge_id": "SEED-001", "trigger_value": -2.5} | changes


SIGNAL = "underlying string, instrument_class string, direction string, holding_period int, lot_value double, margin_per_lot double, oi_lots int, bid_ask_spread_pct double, daily_volume_lots int, transition_warning_flag boolean, edge_id string, trigger_value double"
BOOK = "trade_id string, instrument_class string, underlying string, direction string, holding_period int, margin double"


def numbered(spark, signals):
    """Signals with their place: a join keeps no order of rows."""
    return spark.createDataFrame([(i, *signal(**s).values()) for i, s in enumerate(signals)], f"place int, {SIGNAL}")


def reasons(spark, signals, book=(), **more):
    rows = gate.risk(numbered(spark, signals), spark.createDataFrame(list(book), BOOK), **more).collect()
    return [r["reason"] for r in sorted(rows, key=lambda r: r["place"])]


def test_governor_scenarios(spark):
    assert gate.close_book([-90_000.0], 1_000_000.0)["halt"].startswith("DRAWDOWN")
    assert gate.close_book([-50_000.0], 1_000_000.0)["halt"] == "SINGLE_DAY_LOSS_4PCT"
    assert gate.daily_reset(gate.close_book([-50_000.0], 1_000_000.0))["halt"] is None and gate.daily_reset(gate.close_book([-90_000.0], 1_000_000.0))["halt"]
    eight = [(f"t{i}", f"C{i}", f"U{i}", "LONG", 5, 1.0) for i in range(8)]
    assert reasons(spark, [{}], eight) == ["MAX_POSITIONS_REACHED"]
    assert reasons(spark, [{"margin_per_lot": 200_000.0}], [("t", "X", "Y", "LONG", 5, 650_000.0)]) == ["MARGIN_LIMIT_EXCEEDED"]
    assert reasons(spark, [{"transition_warning_flag": True}, {}, {"oi_lots": None}]) == ["TRANSITION_WATCH_ACTIVE", "OK", "INSUFFICIENT_OI"]
    assert reasons(spark, [{}], halted="X") == ["SYSTEM_HALTED: X"]


def test_validator(spark):
    rows = numbered(spark, [{}, {"transition_warning_flag": True}, {"trigger_value": -1.3}, {"edge_id": "SEED-006"}, {"edge_id": "unknown"}])
    want = {0: ("APPROVED", "OK"), 1: ("REJECTED", "TRANSITION_WATCH_ACTIVE"), 2: ("REJECTED", "SIGNAL_STRENGTH_INSUFFICIENT"), 3: ("REJECTED", "EDGE_DECAYED"), 4: ("APPROVED", "OK")}
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for bytes_ in (most, "-1"):  # joined by broadcast and by shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bytes_)
        try:
            got = {r["place"]: (r["decision"], r["reason"]) for r in gate.validate(rows, spark.createDataFrame([], BOOK), fx.edges(spark)).collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        assert got == want


def naive_walk(signals, days):
    """Day by day over all pairs at once, with the limit on open positions."""
    open_, out = {}, []
    for day in days:
        for pair in [p for p, (start, hold, _) in open_.items() if (day - start).days >= hold]:
            out.append((*pair, open_[pair][0], day, open_.pop(pair)[2]))
        for inst, side, seq, hold in sorted((s[1:] for s in signals if s[0] == day), key=lambda s: (s[0], s[2])):
            if len(open_) < 8 and (inst, side) not in open_:
                open_[inst, side] = (day, hold, seq)
    return sorted(out)


def test_backtest_walks_decompose(spark):
    rng = random.Random(4)
    days = [DAY + dt.timedelta(days=i) for i in range(60) if rng.random() < 0.7]
    signals = [(d, i, s, q, rng.choice([2, 5, 10])) for d, i, s, q in itertools.product(days, "ABC", ("LONG", "SHORT"), range(2)) if rng.random() < 0.3]
    rows = spark.createDataFrame([(i, s, d, q, h) for d, i, s, q, h in signals], "instrument string, direction string, day date, seq int, holding_period int")
    table = spark.createDataFrame([(d,) for d in days], "day date")
    for pairs in (6, 9):  # one group a pair, and one group of all
        got = backtest.greedy(rows, table, pairs).where("exit_day is not null").collect()
        assert sorted((r["instrument"], r["direction"], r["day"], r["exit_day"], r["seq"]) for r in got) == naive_walk(signals, days)


@pytest.mark.parametrize("density", [0.004, 0.2])
def test_position_limit_of_many_pairs(spark, density):
    """60 instruments with and without room: spans walked in parallel give the serial walk, and none holds much of the candidates."""
    rng = random.Random(6)
    days = [DAY + dt.timedelta(days=i) for i in range(2500) if rng.random() < 0.7]
    signals = [(d, f"I{i:02d}", s, 0, rng.choice([2, 5, 10, 15])) for d in days for i in range(60) for s in ("LONG", "SHORT") if rng.random() < density]
    rows = spark.createDataFrame([(i, s, d, q, h) for d, i, s, q, h in signals], "instrument string, direction string, day date, seq int, holding_period int")
    table = spark.createDataFrame([(d,) for d in days], "day date")
    got = backtest.greedy(rows, table, 120).where("exit_day is not null").collect()
    assert sorted((r["instrument"], r["direction"], r["day"], r["exit_day"], r["seq"]) for r in got) == naive_walk(signals, days)
    able = positions.enterable(rows, 8)
    by_span = [r["count"] for r in able.groupBy(F.floor(F.unix_date("day") / positions.SPAN)).count().collect()]
    assert max(by_span) <= sum(by_span) / 10 and max(r["count"] for r in able.groupBy("day").count().collect()) <= 16


def test_position_limit_over_gaps_and_open_ends(spark):
    """Trades that never close block their pairs over spans without candidates; an empty table has no trades."""
    kind = "instrument string, direction string, day date, seq int, exit_day date"
    far = DAY + dt.timedelta(days=2000)
    rows = [(f"I{i}", "LONG", DAY, i, None) for i in range(7)] + [("I0", "LONG", far, 1, None), ("J0", "LONG", far, 2, far + dt.timedelta(days=3)), ("J1", "LONG", far, 3, None), ("J0", "SHORT", far, 4, None)]
    got = {(r["instrument"], r["direction"], r["seq"]) for r in positions.taken(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(f"I{i}", "LONG", i) for i in range(7)} | {("J0", "LONG", 2)}
    assert positions.taken(spark.createDataFrame([], kind)).count() == 0


def test_ledger_first_writer_wins_and_update(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    new = ledger.insert_absent(table, rows, "k", "v")
    assert {tuple(r) for r in new.collect()} == {("a", 1), ("b", 2)}
    changed = ledger.update(new, spark.createDataFrame([("b", None)], "k string, v int"), "k")
    assert {tuple(r) for r in changed.collect()} == {("a", 1), ("b", None)}
    assert ledger.rejection_analysis(spark.createDataFrame([("1", "E", "APPROVED", None), ("2", "E", None, "WIN")], "signal_id string, edge_id string, ai2_decision string, shadow_outcome string")).collect()[0]["win_rate"] == 0


def test_hidden_markov_model():
    rng = np.random.default_rng(0)
    states = np.repeat([0, 1, 2, 1, 0, 2], 60)
    x = np.stack([states * 2.0 - 2, states * 0.5, -states * 1.0], 1) + 0.3 * rng.standard_normal((len(states), 3))
    model = regime.fit_hmm(x, 3)
    assert all(b >= a - 1.0 for a, b in zip(model.likelihoods, model.likelihoods[1:], strict=False))
    assert (np.diff(model.means[:, 0]) > 0).all() and np.allclose(model.moves.sum(1), 1)
    decoded, posterior = regime.decode(x, model)
    assert (decoded == states).mean() > 0.97 and np.allclose(posterior.sum(1), 1)
    assert np.allclose(regime.decode(x, model, smoothed=False)[1].sum(1), 1)


def series_of(rng, n):
    state = np.cumsum(rng.random(n) < 0.03) % 3
    return rng.standard_normal((n, 2)) * [0.5, 1] + np.stack([state * 2.0 - 2, (state == 1) * 3.0], 1)


def in_chunks(spark, series, length):
    rows = [(k, i, *map(float, r)) for k, x in series.items() for i, r in enumerate(x)] + [("A", 10_000, None, 1.0)]
    df = spark.createDataFrame(rows, "series string, t int, a double, b double").repartition(4)
    return markov.chunked(df, "series", "t", ["a", "b"], length, 300)


def test_markov_model_in_chunks_equals_one_series(spark, monkeypatch):
    monkeypatch.setattr(markov, "GROUP", 3)
    x = series_of(np.random.default_rng(1), 1501)
    chunks = in_chunks(spark, {"A": x}, 100)
    assert chunks.count() == 16 and chunks.agg(F.max("size")).first()[0] == 100
    first, plain = regime.first_hmm(x, 3), regime.fit_hmm(x, 3, 4)
    model = markov.fit(chunks, first, 4)
    for a, b in ((model.means, plain.means), (model.covariances, plain.covariances), (model.moves, plain.moves), (model.start, plain.start), (model.likelihoods, plain.likelihoods)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    for smoothed in (True, False):
        states, probs = regime.decode(x, plain, smoothed)
        rows = sorted(markov.decode(chunks, plain, smoothed).collect(), key=lambda r: r["order"])
        assert [r["state"] for r in rows] == states.tolist() and np.allclose([r["probs"] for r in rows], probs, atol=1e-8)


def test_markov_model_of_many_series(spark):
    """Series of different lengths share a model: expected counts are the sums of each one's own."""
    rng = np.random.default_rng(2)
    series = {k: series_of(rng, n) for k, n in (("A", 130), ("B", 1), ("C", 64), ("D", 65))}
    chunks, model = in_chunks(spark, series, 32), regime.first_hmm(series["A"], 3)
    found, weight, likelihood, start = markov.expected(chunks, model), 0, 0.0, 0
    decoded = {(r["series"], r["order"]): r["state"] for r in markov.decode(chunks, model).collect()}
    for k, x in series.items():
        a, b, total = regime.forward_backward(regime.log_density(x, model.means, model.covariances), model.start, model.moves)
        posterior = np.exp(a + b - total)
        weight, likelihood, start = weight + posterior.sum(0), likelihood + total, start + posterior[0]
        assert [decoded[k, i] for i in range(len(x))] == regime.decode(x, model)[0].tolist()
    assert np.allclose(found["weight"], weight) and np.isclose(found["likelihood"], likelihood) and np.allclose(found["start"], start)
    assert len(decoded) == 260


def test_bandit_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, learn.ACTIONS[i % 4], float(rng.standard_normal()), rng.standard_normal(10).tolist()) for i in range(80)]
    replay = spark.createDataFrame(rows, "event_id int, action string, reward double, context array<double>")
    got = {r["event_id"]: r["bandit_action"] for r in learn.bandit_choose(replay, learn.bandit_sums(replay)).collect()}
    for i, _, _, x in rows:
        bounds = []
        for action in learn.ACTIONS:
            c = np.array([r[3] for r in rows if r[1] == action])
            inverse = np.linalg.inv(np.eye(10) + c.T @ c)
            theta = inverse @ (c.T @ np.array([r[2] for r in rows if r[1] == action]))
            bounds.append(theta @ x + math.sqrt(np.array(x) @ inverse @ x))
        assert got[i] == learn.ACTIONS[int(np.argmax(bounds))]


def test_thresholds_find_the_best_point(spark):
    low, high, default = learn.BOUNDS["z_21d_threshold"]
    rows = [("z_21d_threshold", low + (high - low) * i / 60, -((i / 60 - 0.3) ** 2)) for i in range(61)] + [("rsi_2_threshold", 7.0, 1.0)]
    got = {r["param"]: r["threshold"] for r in learn.thresholds(spark.createDataFrame(rows, "param string, threshold double, pnl double")).collect()}
    assert got["z_21d_threshold"] == pytest.approx(low + 0.3 * (high - low), abs=0.05)
    assert got["rsi_2_threshold"] == 10.0 and got["z_21d_currency"] == -1.8
    assert learn.meta_fit(spark.createDataFrame([(1.0,)], "net_return_pct double")) is None


def test_sources(spark, tmp_path):
    made = source.synthetic_bars(spark, "2020-01-01", "2020-03-31")
    source.write_bars(made, str(tmp_path / "bars"))
    source.write_bars(made.where("instrument = 'NIFTY'").withColumn("close", F.lit(1.0)), str(tmp_path / "bars"))
    stored = source.read_bars(spark, str(tmp_path / "bars"))
    assert stored.count() == made.count() and {r[0] for r in stored.where("close = 1").select("instrument").distinct().collect()} == {"NIFTY"}
    assert made.where("low > least(open, close) or high < greatest(open, close)").isEmpty()
    (tmp_path / "vix.csv").write_text("date,Close\n2020-01-01,15.5\n2020-01-02,\nbad,1\n")
    assert [tuple(r) for r in source.read_csv(spark, str(tmp_path / "vix.csv")).collect()] == [(DAY, 15.5)]
    found = source.resolve_source(("missing", lambda: source.read_csv(spark, str(tmp_path / "none.csv"))), ("local", lambda: source.read_csv(spark, str(tmp_path / "vix.csv"))))
    assert found.first()["source"] == "local"
    made.limit(3).drop("instrument").coalesce(1).write.parquet(str(tmp_path / "raw"))
    assert source.read_folder(spark, str(tmp_path / "raw")).count() == 3
    assert source.mean_reverting(spark, "2020-01-01", "2020-06-30").where("close < 8").isEmpty()


def test_streams_equal_their_batch_twins(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    ticks = fx.table(spark, d, "events").select("ts", F.col("event_type").alias("key"), "value")
    ticks.repartition(1).write.parquet(str(tmp_path / "ticks"))
    stream = live.daily_bars(live.read_stream(spark, str(tmp_path / "ticks"), "ts timestamp, key string, value double"))
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete" if False else "append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["instrument"], r["date"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.table("daily").collect()}
    from edgelake.plans.all import QUERIES

    want = {(r["instrument"], r["date"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in QUERIES["t09_daily_bars"](spark, d).collect()}
    assert got and all(want[k] == tuple(round(x, 6) if isinstance(x, float) else x for x in v) for k, v in got.items())

    signals = fx.signals(spark, d).drop("day")
    signals.repartition(1).write.parquet(str(tmp_path / "signals"))
    seen = []
    query = live.run_pipeline(
        live.read_stream(spark, str(tmp_path / "signals"), signals.schema.simpleString()[7:-1].replace(":", " ")), lambda: fx.positions(spark), fx.edges(spark),
        lambda batch, number: seen.extend(r["event_id"] for r in batch.collect()), str(tmp_path / "check"),
    )
    query.awaitTermination(120)
    approved = gate.validate(signals, fx.positions(spark), fx.edges(spark)).where("decision = 'APPROVED'")
    assert sorted(seen) == sorted(r["event_id"] for r in gate.select_trades(approved, fx.positions(spark), "event_id").collect())


def test_declared_schemas(spark, tmp_path):
    from edgelake import schema

    rows = spark.createDataFrame([("t", 5.0)], "trade_id string, margin double")
    assert schema.missing(rows, "positions") == ["instrument_class", "underlying", "direction", "holding_period"]
    assert schema.conform(rows, "positions").schema.simpleString() == schema.empty(spark, "positions").schema.simpleString()
    assert all(schema.empty(spark, name).count() == 0 for name in schema.TABLES)
    default = spark.createDataFrame([(0,)], "x int")
    assert ledger.load_state(spark, str(tmp_path / "none"), default).first()["x"] == 0
    for version in (1, 2):
        ledger.save_state(spark.createDataFrame([(version,)], "x int"), str(tmp_path / "state"), version)
    assert ledger.load_state(spark, str(tmp_path / "state"), default).first()["x"] == 2


def test_books_are_kept_over_batches(spark, tmp_path):
    rows = [("p", 1, -30_000.0), ("p", 2, -30_000.0), ("q", 1, 5_000.0)]
    for i, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, "portfolio string, seq int, pnl double").coalesce(1).write.mode("append").parquet(str(tmp_path / "closes"))
    stream = live.read_stream(spark, str(tmp_path / "closes"), "portfolio string, seq int, pnl double")
    seen: dict = {}
    query = (
        live.books(stream, 1_000_000.0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda batch, _: seen.update({r["portfolio"]: (r["daily_pnl"], r["halt"]) for r in batch.collect()})).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert seen == {"p": (-60_000.0, "SINGLE_DAY_LOSS_4PCT"), "q": (5_000.0, None)}
    book = gate.book_states(spark.createDataFrame(rows, "portfolio string, seq int, pnl double"), "portfolio", ["seq"], 1_000_000.0).collect()
    assert {(r["portfolio"], r["seq"]): r["halt"] for r in book} == {("p", 1): None, ("p", 2): "SINGLE_DAY_LOSS_4PCT", ("q", 1): None}


def test_failing_batches_leave_the_stream_running(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i,)], "x int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, failures = [], []

    def step(batch, number):
        value = batch.first()[0]
        if value == 1:
            raise ValueError("bad batch")
        seen.append(value)

    query = live.start(live.read_stream(spark, str(tmp_path / "in"), "x int"), live.isolated(step, lambda rows: failures.extend(rows.collect())), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None and sorted(seen) == [0, 2]
    assert [(r["error"], r["message"]) for r in failures] == [("ValueError", "bad batch")]


def test_daily_tasks_run_once_a_day(spark):
    at = lambda text: spark.sql(f"select timestamp '{text}' ts")
    marks, ran = [], []
    done = lambda: spark.createDataFrame(marks, "task string, day date")
    run = live.once_a_day([("open", "09:15", lambda b, n: ran.append("open")), ("close", "15:30", lambda b, n: ran.append("close"))], done, lambda rows: marks.extend(map(tuple, rows.collect())), zone="UTC")
    for i, text in enumerate(["2024-01-02 08:00:00", "2024-01-02 09:20:00", "2024-01-02 12:00:00", "2024-01-02 16:00:00", "2024-01-02 17:00:00", "2024-01-03 15:31:00"]):
        run(at(text), i)
    run(at("2024-01-03 16:00:00").where("false"), 9)
    assert ran == ["open", "close", "open", "close"] and len(marks) == 4


def test_upserts_keep_to_their_instruments_and_days(spark, tmp_path):
    row = lambda name, day, close: (name, DAY + dt.timedelta(days=day), close, close, close, close, 1)
    schema = "instrument string, date date, open double, high double, low double, close double, volume long"
    stored = {"rows": spark.createDataFrame([row("A", 100, 1.0), row("A", 99, 1.0), row("B", 100, 1.0)], schema), "written": []}
    spark.createDataFrame([row("A", 100, 2.0), row("A", 100, 3.0), row("A", 101, 2.0), row("A", 30, 2.0), row("C", 1, 5.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live.upsert_batches(live.read_stream(spark, str(tmp_path / "in"), schema), lambda: stored["rows"], lambda rows: stored["written"].extend(rows.collect()), str(tmp_path / "check")).awaitTermination(120)
    got = {(r["instrument"], (r["date"] - DAY).days): r["close"] for r in stored["written"]}
    assert got == {("A", 99): 1.0, ("A", 100): 3.0, ("A", 101): 2.0, ("C", 1): 5.0}


def test_first_signal_of_a_day_in_a_stream(spark, tmp_path):
    rows = [("E1", "U", "LONG", "2024-01-02 04:00:00"), ("E1", "U", "LONG", "2024-01-02 05:00:00"), ("E1", "U", "SHORT", "2024-01-02 05:00:00"), ("E1", "U", "LONG", "2024-01-02 20:00:00")]
    frame = spark.createDataFrame(rows, "edge_id string, underlying string, direction string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.first_of_day(live.read_stream(spark, str(tmp_path / "in"), "edge_id string, underlying string, direction string, ts timestamp"))
    stream.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    # 20:00 in UTC is the next local day
    assert sorted((r["direction"], r["local_date"].day) for r in spark.table("firsts").collect()) == [("LONG", 2), ("LONG", 3), ("SHORT", 2)]


def test_closed_trades_fan_out(spark, tmp_path):
    schema = "trade_id string, edge_id string, instrument_class string, direction string, holding_period int, net_return_pct double, regime_at_entry string, exit_date date, signal_id string, bandit_action string, bandit_context array<double>, trigger_feature string, trigger_value double"
    rows = [("t1", "SEED-001", "INDEX_OPTIONS", "LONG", 5, 12.5, "SIDEWAYS", DAY, "s1", "SMALL", None, None, None), ("t2", "SEED-001", "INDEX_OPTIONS", "LONG", 5, -3.0, "SIDEWAYS", DAY, "s2", None, [1.0], "rsi_2_threshold", 8.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got: dict = {}
    write = {k: (lambda frame, k=k: got.setdefault(k, []).extend(frame.collect())) for k in ("log", "replay", "observations", "signals", "edges")}
    live.close_trades(live.read_stream(spark, str(tmp_path / "in"), schema), lambda: fx.edges(spark), write, str(tmp_path / "check")).awaitTermination(180)
    assert sorted((r["trade_id"], r["won"]) for r in got["log"]) == [("t1", 1), ("t2", 0)]
    assert [(r["reward"], r["context"]) for r in got["replay"]] == [(12.5, [0.0] * 10)]
    assert sorted((r["param"], r["threshold"], r["pnl"]) for r in got["observations"]) == [("rsi_2_threshold", 8.0, -3.0), ("z_21d_threshold", 0.0, 12.5)]
    assert next((r["live_wins"], r["live_losses"]) for r in got["edges"] if r["edge_id"] == "SEED-001") == (1, 1)


def test_regime_paths_follow_their_phases(spark):
    rows = source.regime_paths(spark, "2010-01-01", "2026-12-31").toPandas().set_index("date").sort_index()
    rng, level, vix = np.random.default_rng(42), 5200.0, 16.0
    for day, close, got in zip(rows.index, rows["close"], rows["vix"], strict=True):
        mu, sigma, mean, vary = next((p[2:] for p in source.PHASES if p[0] <= str(day) <= p[1]), source.OUTSIDE)
        level *= math.exp(rng.normal(mu, sigma))
        vix = max(8.0, vix + 0.05 * (mean - vix) + rng.normal(0, mean * 0.08 * vary))
        assert close == pytest.approx(level) and got == pytest.approx(vix)


def test_synthetic_series_have_the_stated_drift_and_deviation(spark):
    rows = source.synthetic_bars(spark, "2010-01-01", "2021-12-31").toPandas().sort_values(["instrument", "date"])
    assert set(rows["instrument"]) == set(source.SERIES)
    for name, part in rows.groupby("instrument"):
        ret = np.log(part["close"]).diff().dropna()
        assert ret.std() * math.sqrt(252) == pytest.approx(source.SERIES[name][2], rel=0.08)
        assert (part["volume"].between(1e5, 1e7)).all()


def test_a_low_price_has_no_strike(spark):
    row = spark.sql("select 1.1 s, 0.2 v").select(atm_premium(F.col("s").cast("double"), F.col("v").cast("double"), F.lit(50.0), F.lit("call"), F.lit(5)).alias("p"), at_the_money(F.lit(1.1), F.lit(0.001)).alias("k")).first()
    assert row["p"] is None and row["k"] == pytest.approx(1.1)


def test_threshold_cells_are_weighted(spark):
    low, high, _ = learn.BOUNDS["rsi_2_threshold"]
    rows = [("rsi_2_threshold", low + (high - low) * (i % 3000) / 3000, float(-abs(i % 3000 - 2900))) for i in range(6000)] + [("rsi_2_threshold", 99.0, -1e4)]
    frame = spark.createDataFrame(rows, "param string, threshold double, pnl double")
    cells = learn.threshold_cells(frame)
    assert cells.count() <= 1001 and cells.agg(F.sum("n")).first()[0] == 6001
    got = {r["param"]: r["threshold"] for r in learn.thresholds(frame).collect()}
    assert got["rsi_2_threshold"] == pytest.approx(low + (high - low) * 2900 / 3000, abs=0.4)


def test_a_margin_of_zero_leaves_one_lot(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.0), (2, 0.9, -0.0), (3, 0.9, 30_000.0), (4, 0.6, None)], "event_id bigint, confidence double, margin_per_lot double")
    got = {r["event_id"]: r["recommended_lots"] for r in gate.size(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_growth_beyond_the_largest_double_keeps_its_logarithm(spark):
    rows = spark.range(40_000).select(F.lit(35.0).alias("net_return_pct"), F.expr("date_add(date'2001-01-01', cast(id % 700 as int))").alias("exit_date"), F.lit(2).alias("holding_period"), F.lit("A").alias("instrument_class"))
    assert rows.agg(backtest.log_growth(F.col("net_return_pct"))).first()[0] == pytest.approx(40_000 * math.log1p(0.07 * 0.35))
    row = backtest.scorecard(rows).where("criterion = 'net_cagr_positive'").first()
    days = backtest.daily_returns(rows).count()
    assert math.log1p(row["actual"]) == pytest.approx(40_000 * math.log1p(0.07 * 0.35) * 252 / days)


def test_waiting_signals_are_not_looked_through_at_every_close(monkeypatch):
    """Signals that may wait on and on cost a close no more, and the book is that of a walk through all of them."""
    from edgelake.streaming.state import SIGNAL_FIELDS, WAIT_DAYS, Book, new_totals

    class Plain(Book):
        def step(self, e):
            if e["kind"] != "close":
                return super().step(e)
            waiting, out = self.waiting, []
            self.queue = type(self.queue)()
            head = super().step(e)
            for s in waiting:
                if (e["day"] - s["since"]).days > WAIT_DAYS.get(s["holding_period"], 0):
                    out.append((s["trade_id"], "waiting", "EXPIRED"))
                elif self.free(s["holding_period"]) > 0 and self.reason(s, False, None) == "OK":
                    self.open(s)
                    out.append((s["trade_id"], "waiting", "OPENED"))
                else:
                    self.wait(s)
            return head + out

    def events(n, seed):
        rng = random.Random(seed)
        for i in range(n):
            kind = rng.choices(["signal", "close", "reset"], [6, 3, 0.1])[0]
            values = [f"T{max(0, i - rng.randrange(12)) if kind == 'close' else i}", rng.choice("abcdef"), rng.choice("uvwxyz"), rng.choice("LS"), rng.choice([2, 5, 10, 15, 7]), rng.uniform(0, 99_000), rng.uniform(-10_000, 300_000)]
            yield dict(zip(SIGNAL_FIELDS, values, strict=True)) | {"seq": i, "day": DAY + dt.timedelta(days=rng.randrange(9)), "kind": kind, "liquidity": None, "transition_warning_flag": False, "pnl": rng.uniform(-25_000, 25_000)}

    for seed in range(20):
        assert Book({}, [], new_totals(1350000.0), 1350000.0).rows("P", list(events(300, seed))) == Plain({}, [], new_totals(1350000.0), 1350000.0).rows("P", list(events(300, seed)))
    asked = []
    free = Book.free
    monkeypatch.setattr(Book, "free", lambda self, holding: asked.append(1) or free(self, holding))
    signal = lambda i: {"trade_id": f"T{i}", "instrument_class": f"c{i}", "underlying": f"u{i}", "direction": "LONG", "holding_period": 15, "lot_value": 1.0, "margin_per_lot": 1.0, "kind": "signal", "liquidity": None, "transition_warning_flag": False}
    rows = [(signal(i) if i % 2 == 0 else {"trade_id": "none", "kind": "close", "pnl": 0.0}) | {"seq": i, "day": DAY} for i in range(2000)]
    book = Book({}, [], new_totals(1350000.0), 1350000.0)
    book.rows("P", rows)
    assert len(book.waiting) == 999 and len(asked) < 3000


def test_asof_of_one_hot_day_isnt_sorted_in_one_task(spark):
    left = spark.range(0, 20_000, 1, 4).select("id", (F.floor(F.col("id") / 50_000) + 5).cast("int").alias("day"))
    right = spark.createDataFrame([(4, 1), (6, 2)], "day int, v int")
    got = scan.asof(left, right, "day", [], ["v"], scan.by_width(left, "day", 2)).withColumn("task", F.spark_partition_id())
    assert got.agg(F.count("*"), F.min("v"), F.max("v"), F.count_distinct("task") > 1).first() == (20_000, 1, 1, True)


def test_rank_among_cuts_equals_counting(spark):
    for cuts in ([], [3], [1, 4, 4.5, 9], list(range(0, 1022, 2))):
        cuts = [float(c) for c in cuts]
        rows = spark.range(-3, 1030).select((F.col("id") / 1.0).alias("x")).select("x", scan.rank(F.col("x"), cuts).alias("n")).collect()
        assert [r["n"] for r in rows] == [sum(c <= r["x"] for c in cuts) for r in rows]
    assert spark.range(1).select(scan.rank(F.lit(None).cast("double"), [1.0, 2.0])).first()[0] == 0
