"""Keyed state of streams against batch twins and plain sums, over restarts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelake.constants import SLOTS
from edgelake.operators import gate, learn
from edgelake.streaming import live, state

DAY = dt.date(2020, 1, 6)


@pytest.fixture(autouse=True)
def provider(spark):
    state.use_state(spark)
    yield
    spark.conf.unset(state.PROVIDER_KEY)


def drain(stream, folder, mode="append"):
    """Run a stream over what has arrived and return the rows it has appended so far."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def events(rng, n):
    """Signals, closes of trades (known or not) and resets of three portfolios; several periods, underlyings and days."""
    rows = []
    for i in range(n):
        portfolio, kind = rng.choice("pqr"), rng.choices(["signal", "close", "reset"], [6, 4, 0.3])[0]
        pnl = float(rng.choice([-9_000] * 6 + [-60_000, 10_000, 20_000])) if kind == "close" else None
        trade = f"T{rng.randrange(max(i - 9, 0), i + 1)}" if kind == "close" else f"T{i}"
        lot = float(rng.choice([50_000, 60_000, 200_000]))
        rows.append((portfolio, i, DAY + dt.timedelta(days=i // 12), kind, trade, rng.choice(["INDEX_OPTIONS", "COMMODITY_FUTURES", "CURRENCY_FUTURES", "SWAPS", "X"]), f"U{rng.randrange(9)}", rng.choice(["LONG", "SHORT"]), rng.choice([2, 5, 10, 15, 7]), lot, lot / 2, rng.choice([None] * 9 + ["INSUFFICIENT_OI"]), rng.random() < 0.05, pnl))
    return rows


def test_books_equal_their_batch_twin_after_a_restart(spark, tmp_path):
    rows = events(random.Random(19), 240)
    for part in (rows[:100], rows[100:150], rows[150:]):
        spark.createDataFrame(part, state.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(state.book_stream(live.read_stream(spark, str(tmp_path / "in"), state.EVENT)), tmp_path)  # each time a new query
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    twin = state.book_replay(spark.createDataFrame(rows, state.EVENT)).collect()
    assert got == sorted(map(str, twin))
    kinds = {(r["kind"], r["outcome"].split(":")[0]) for r in twin}
    assert {("signal", "OPENED"), ("signal", "WAITING"), ("waiting", "OPENED"), ("waiting", "EXPIRED"), ("close", "CLOSED"), ("close", "UNKNOWN_TRADE"), ("signal", "SYSTEM_HALTED")} <= kinds


def test_books_keep_every_limit():
    """Slots, classes and underlyings are never exceeded, and closes book what gate.close_book() does between resets."""
    for seed in range(20):
        book, closes = state.Book({}, [], state.new_totals(1_350_000.0), 1_350_000.0), []
        for e in state.events_of(iter([__import__("pandas").DataFrame([r for r in events(random.Random(seed), 200) if r[0] == "p"], columns=[c.split()[0] for c in state.EVENT.split(", ")])])):
            book.step(e)
            held = list(book.positions.values())
            assert all(sum(p["holding_period"] == h for p in held) <= SLOTS.get(h, 0) for h in {p["holding_period"] for p in held})
            assert all(sum(p[k] == x for p in held) <= 2 for k in ("instrument_class", "underlying") for x in {p[k] for p in held})
            if e["kind"] == "reset":
                closes = None
            elif e["kind"] == "close" and closes is not None:
                closes.append(e["pnl"])
                plain = gate.close_book(closes, 1_350_000.0)
                assert {k: book.totals[k] for k in plain} == plain


def test_rules_of_books_equal_the_gate(spark):
    held = [("a", "INDEX_OPTIONS", "U0", "LONG", 5, 300_000.0), ("b", "INDEX_OPTIONS", "U1", "LONG", 5, 300_000.0), ("c", "X", "U0", "SHORT", 2, 100_000.0)]
    kind = "trade_id string, instrument_class string, underlying string, direction string, holding_period int, margin double"
    names = [c.split()[0] for c in kind.split(", ")]
    positions = {p[0]: dict(zip(names[1:], p[1:], strict=True)) for p in held}
    rng, signals = random.Random(2), []
    for i in range(60):
        signals.append((f"s{i}", rng.choice(["INDEX_OPTIONS", "X", "COMMODITY_FUTURES"]), f"U{rng.randrange(4)}", rng.choice(["LONG", "SHORT"]), rng.choice([2, 5]), float(rng.choice([50_000, 200_000])), float(rng.choice([10_000, 120_000, 2_000_000])), rng.random() < 0.2, 500, 0.02, rng.choice([100, 2000])))
    names = "trade_id string, instrument_class string, underlying string, direction string, holding_period int, lot_value double, margin_per_lot double, transition_warning_flag boolean, oi_lots int, bid_ask_spread_pct double, daily_volume_lots int"
    rows = spark.createDataFrame(signals, names)
    rows = rows.withColumn("liquidity", gate.liquidity_reason(F.col("instrument_class"), F.col("oi_lots"), F.col("bid_ask_spread_pct"), F.col("daily_volume_lots")))
    for halt in (None, "X"):
        book = state.Book(positions, [], state.new_totals(1_350_000.0) | {"halt": halt}, 1_350_000.0)
        want = {r["trade_id"]: r["reason"] for r in gate.risk(rows, spark.createDataFrame(held, kind), halted=halt).collect()}
        assert {r["trade_id"]: book.reason(r.asDict(), r["transition_warning_flag"], r["liquidity"]) for r in rows.collect()} == want


def test_bandit_state_equals_a_fit_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(str(rng.choice(learn.ACTIONS)), float(rng.standard_normal()), rng.standard_normal(10).tolist()) for _ in range(3000)]
    rows += [("SMALL", 1.0, [1.0] * 10)] * 50 + [("SMALL", 0.0, [0.0] * 10)]  # directions that repeat, and none
    kind = "action string, reward double, context array<double>"
    for part in (rows[:1000], rows[1000:1001], rows[1001:]):
        spark.createDataFrame(part, kind).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        drain(state.bandit_stream(live.read_stream(spark, str(tmp_path / "in"), kind, 10)), tmp_path, "update")
    out = spark.read.parquet(str(tmp_path / "out"))
    models = out.groupBy("action").agg(F.max_by(F.struct("n", "inverse", "theta"), "n").alias("m")).select("action", "m.*")
    for r in models.collect():
        x = np.array([c for a, _, c in rows if a == r["action"]])
        y = np.array([v for a, v, _ in rows if a == r["action"]])
        a = np.eye(10) + x.T @ x
        assert r["n"] == len(x)
        assert np.abs(np.array(r["inverse"]).reshape(10, 10) - np.linalg.inv(a)).max() < 1e-9 and np.abs(np.array(r["theta"]) - np.linalg.solve(a, x.T @ y)).max() < 1e-9
    # the choice from models is that from all sums; an action that has seen nothing has the widest bound
    signals = spark.createDataFrame([(i, (rng.standard_normal(10) * 5).tolist()) for i in range(200)], "event_id int, context array<double>")
    plain = {r["event_id"]: r["bandit_action"] for r in learn.bandit_choose(signals, learn.bandit_sums(spark.createDataFrame(rows, kind))).collect()}
    assert {r["event_id"]: r["bandit_action"] for r in state.bandit_action(signals, models).collect()} == plain
    assert len(set(plain.values())) == 4
    assert {r["bandit_action"] for r in state.bandit_action(signals, models.where("action <> 'LARGE'")).collect()} == {"LARGE"}


def test_sessions_open_switch_and_close_over_two_days(spark, tmp_path):
    """Friday and Monday: both sessions, a scan at the weekend, and closes that only timers can have made."""
    at = lambda day, hour, minute: dt.datetime(2020, 1, day, hour, minute) - dt.timedelta(minutes=330)  # noqa: E731  UTC of a local time
    scans = [
        ("d", at(10, 9, 0), 1, "INDEX_OPTIONS"), ("d", at(10, 9, 20), 2, "INDEX_OPTIONS"), ("d", at(10, 15, 30), 3, "INDEX_OPTIONS"), ("d", at(10, 18, 0), 4, "INDEX_OPTIONS"), ("d", at(10, 18, 5), 5, "COMMODITY_FUTURES"),
        ("d", at(11, 12, 0), 6, "INDEX_OPTIONS"), ("d", at(13, 10, 0), 7, "CURRENCY_FUTURES"), ("d", at(14, 3, 0), 8, "COMMODITY_FUTURES"), ("e", at(13, 16, 0), 9, "COMMODITY_FUTURES"), ("d", at(14, 8, 0), 10, "X"),
    ]
    for part in (scans[:3], scans[3:6], scans[6:9], scans[9:]):
        spark.createDataFrame(part, state.SCAN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(state.session_stream(live.read_stream(spark, str(tmp_path / "in"), state.SCAN)), tmp_path)
    log = [(r["desk"], r["event"], r["mode"], r["event_id"], r["at"] + dt.timedelta(minutes=330)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {x[3]: x[1] for x in log if x[3]} == {1: "SKIP", 2: "SCAN", 3: "SCAN", 4: "SKIP", 5: "SCAN", 6: "SKIP", 7: "SCAN", 8: "SKIP", 9: "SCAN", 10: "SKIP"}
    changes = lambda desk: sorted((x[4], x[1], x[2]) for x in log if x[0] == desk and not x[3])
    local = lambda day, hour, minute: dt.datetime(2020, 1, day, hour, minute)
    assert changes("d") == [
        (local(10, 9, 20), "OPEN", "ALL"), (local(10, 15, 31), "SWITCH", "COMMODITY"), (local(10, 23, 31), "CLOSE", "CLOSED"),
        (local(13, 10, 0), "OPEN", "ALL"), (local(13, 15, 31), "SWITCH", "COMMODITY"), (local(13, 23, 31), "CLOSE", "CLOSED"),
    ]
    assert changes("e") == [(local(13, 16, 0), "OPEN", "COMMODITY"), (local(13, 23, 31), "CLOSE", "CLOSED")]
