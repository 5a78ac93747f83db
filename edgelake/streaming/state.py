"""What the live loop remembers from scan to scan, as keyed state: books of positions and slots, the bandit's model, and sessions.

Each is a processor for ``transformWithStateInPandas``; its state lives in RocksDB and is checkpointed with the stream, so a
restarted query goes on where the last committed batch ended. Sessions need that provider:
``spark.sql.streaming.stateStore.providerClass`` = PROVIDER.
"""

from __future__ import annotations

import bisect
import datetime as dt
import heapq
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from edgelake.constants import CAPITAL, MAX_MARGIN_SHARE, MAX_POSITION_SHARE, MAX_POSITIONS, SLOTS, WAIT_DAYS
from edgelake.operators.gate import close_book
from edgelake.operators.learn import ACTIONS
from edgelake.tables import bound_batches

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"

EVENT = (
    "portfolio string, seq bigint, day date, kind string, trade_id string, instrument_class string, underlying string, direction string, holding_period int, "
    "lot_value double, margin_per_lot double, liquidity string, transition_warning_flag boolean, pnl double"
)
POSITION = "instrument_class string, underlying string, direction string, holding_period int, margin double"
WAITING = "trade_id string, since date, instrument_class string, underlying string, direction string, holding_period int, lot_value double, margin_per_lot double"
TOTALS = "daily_pnl double, peak double, drawdown double, halt string"
DECISION = "portfolio string, seq bigint, trade_id string, kind string, outcome string, open_positions int, free_slots int, daily_pnl double, drawdown double, halt string"
DECISION_NAMES = [c.split()[0] for c in DECISION.split(", ")]
DECISION_TYPES = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in DECISION.split(", ")]
SIGNAL_FIELDS = ["trade_id", "instrument_class", "underlying", "direction", "holding_period", "lot_value", "margin_per_lot"]


def use_state(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER_KEY, PROVIDER)


class Lowest:
    """Values by number, numbers added in ascending order: a tree of minima finds the first number after another one whose value is low enough."""

    def __init__(self):
        self.at: list[int] = []
        self.size, self.low = 1, [math.inf] * 2

    def put(self, i: int, x: float) -> None:
        i += self.size
        self.low[i] = x
        while i > 1:
            i //= 2
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def add(self, n: int, x: float) -> None:
        if len(self.at) == self.size:
            left = [(m, y) for m, y in zip(self.at, self.low[self.size :], strict=True) if y < math.inf]
            self.size = 1 << (2 * len(left) + 1).bit_length()
            self.at = [m for m, _ in left]
            self.low = [math.inf] * self.size + [y for _, y in left] + [math.inf] * (self.size - len(left))
            for i in range(self.size - 1, 0, -1):
                self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])
        self.at.append(n)
        self.put(len(self.at) - 1, x)

    def remove(self, n: int) -> None:
        i = bisect.bisect_left(self.at, n)
        if i < len(self.at) and self.at[i] == n:
            self.put(i, math.inf)

    def first(self, after: int, fits: Callable[[float], bool]) -> int | None:
        """``fits`` holds for all values below one that it holds for, and not for infinity."""
        start = bisect.bisect_right(self.at, after)
        if start == len(self.at) or not fits(self.low[1]):
            return None
        i = start + self.size
        while not fits(self.low[i]):
            i += 1
            if i & (i - 1) == 0:  # beyond the last one
                return None
            while i % 2 == 0:
                i //= 2
        while i < self.size:
            i = 2 * i if fits(self.low[2 * i]) else 2 * i + 1
        return self.at[i - self.size]


class Queue:
    """Waiting signals in order of arrival, found by the day they expire and, for each tuple of what the rules ask for, by margin."""

    def __init__(self):
        self.items: dict[int, dict] = {}
        self.due: dict[int, list] = {}
        self.kinds: dict[tuple, Lowest] = {}
        self.count = 0

    @staticmethod
    def kind(s: dict) -> tuple:
        return s["instrument_class"], s["underlying"], s["direction"], s["holding_period"]

    def add(self, s: dict, margin: float) -> None:
        self.items[self.count] = s
        heapq.heappush(self.due.setdefault(s["holding_period"], []), (s["since"], self.count))
        if margin < math.inf:
            self.kinds.setdefault(self.kind(s), Lowest()).add(self.count, margin)
        self.count += 1

    def remove(self, n: int) -> dict:
        s = self.items.pop(n)
        if (low := self.kinds.get(self.kind(s))) is not None:
            low.remove(n)
        return s

    def expire(self, day: dt.date) -> list[tuple[int, dict]]:
        out = []
        for holding, heap in self.due.items():
            while heap and (day - heap[0][0]).days > WAIT_DAYS.get(holding, 0):
                _, n = heapq.heappop(heap)
                if n in self.items:
                    out.append((n, self.remove(n)))
        return out


class Book:
    """One portfolio: open positions by trade, signals that wait for a slot, pnl and halt.

    Events come in order of ``seq``. A ``signal`` meets the risk rules and then the slots of its holding period; without a
    free slot it waits. A ``close`` frees its trade's slot, books its pnl and lets waiting signals in, the oldest first, while
    they haven't expired and the rules allow them. A ``reset`` ends the day.

    As open positions are few, an event takes a time that grows with the logarithm of the signals that wait: they are
    looked through only after a position went or a halt was lifted, as before that none of them may enter.
    """

    def __init__(self, positions: dict[str, dict], waiting: list[dict], totals: dict, capital: float):
        self.positions, self.totals, self.capital = positions, totals, capital
        self.margin, self.looser, self.queue = sum(p["margin"] for p in positions.values()), True, Queue()
        for s in waiting:
            self.wait(s)

    @property
    def waiting(self) -> list[dict]:
        return list(self.queue.items.values())

    def wait(self, s: dict) -> None:
        never = s["lot_value"] > self.capital * MAX_POSITION_SHARE or s["margin_per_lot"] > self.capital
        self.queue.add(s, math.inf if never else s["margin_per_lot"])

    def fits(self, margin: float) -> bool:
        return not self.margin + margin > self.capital * MAX_MARGIN_SHARE

    def crowded(self, s: dict) -> str | None:
        held = self.positions.values()
        if sum(p["instrument_class"] == s["instrument_class"] for p in held) >= 2:
            return f"ASSET_CLASS_CONCENTRATION_{s['instrument_class']}"
        if sum(p["underlying"] == s["underlying"] for p in held) >= 2:
            return f"UNDERLYING_CONCENTRATION_{s['underlying']}"
        return None

    def doubled(self, s: dict) -> bool:
        return any(p["underlying"] == s["underlying"] and p["direction"] == s["direction"] and p["holding_period"] == s["holding_period"] for p in self.positions.values())

    def reason(self, s: dict, flag: bool, illiquid: str | None) -> str:
        """The first failing rule, in the order of gate.risk(), or OK."""
        if self.totals["halt"] is not None:
            return f"SYSTEM_HALTED: {self.totals['halt']}"
        if flag:
            return "TRANSITION_WATCH_ACTIVE"
        if len(self.positions) >= MAX_POSITIONS:
            return "MAX_POSITIONS_REACHED"
        if s["lot_value"] > self.capital * MAX_POSITION_SHARE:
            return "POSITION_SIZE_EXCEEDS_7pct_CAPITAL"
        if not self.fits(s["margin_per_lot"]):
            return "MARGIN_LIMIT_EXCEEDED"
        if (why := self.crowded(s)) is not None:
            return why
        if s["margin_per_lot"] > self.capital:
            return "CANNOT_AFFORD_SINGLE_LOT"
        if illiquid is not None:
            return illiquid
        return "DUPLICATE_POSITION_TUPLE" if self.doubled(s) else "OK"

    def free(self, holding: int) -> int:
        """Free slots of a holding period; a period without slots has none."""
        return min(SLOTS.get(holding, 0) - sum(p["holding_period"] == holding for p in self.positions.values()), sum(SLOTS.values()) - len(self.positions))

    def open(self, s: dict) -> None:
        self.positions[s["trade_id"]] = {k: s[k] for k in ("instrument_class", "underlying", "direction", "holding_period")} | {"margin": s["margin_per_lot"]}
        self.moved(s["margin_per_lot"] < 0)

    def moved(self, looser: bool) -> None:
        self.margin = sum(p["margin"] for p in self.positions.values())
        self.looser |= looser

    def step(self, e: dict) -> list[tuple[str, str, str]]:
        """(trade, kind, outcome) of what an event brings about."""
        if e["kind"] == "signal":
            s = {k: e[k] for k in SIGNAL_FIELDS}
            why = self.reason(s, bool(e["transition_warning_flag"]), e["liquidity"])
            if why == "OK" and self.free(s["holding_period"]) <= 0:
                self.wait(s | {"since": e["day"]})
                why = "WAITING"
            elif why == "OK":
                self.looser |= s["trade_id"] in self.positions  # takes the place of a position
                self.open(s)
                why = "OPENED"
            return [(s["trade_id"], "signal", why)]
        if e["kind"] == "reset":
            lifted = self.totals["halt"] == "SINGLE_DAY_LOSS_4PCT"
            self.totals |= {"daily_pnl": 0.0, "halt": None if lifted else self.totals["halt"]}
            self.looser |= lifted
            return [(e["trade_id"], "reset", "RESET")]
        known = self.positions.pop(e["trade_id"], None) is not None
        if known:
            self.moved(True)
        t = self.totals
        closed = close_book([e["pnl"]], self.capital)
        peak = max(t["peak"], closed["peak"])
        drawdown, daily = (peak - self.capital - e["pnl"]) / peak, t["daily_pnl"] + e["pnl"]
        halt = t["halt"] or (f"DRAWDOWN_{drawdown:.1%}" if drawdown > 0.08 else "SINGLE_DAY_LOSS_4PCT" if daily < -0.04 * self.capital else None)
        self.totals = {"daily_pnl": daily, "peak": peak, "drawdown": drawdown, "halt": halt}
        moves = [(n, s["trade_id"], "EXPIRED") for n, s in self.queue.expire(e["day"])] + self.let_in()
        return [(e["trade_id"], "close", "CLOSED" if known else "UNKNOWN_TRADE"), *((trade, "waiting", what) for _, trade, what in sorted(moves))]

    def let_in(self) -> list[tuple[int, str, str]]:
        """(number, trade, OPENED) of the waiting signals that enter, each meeting the positions that those before it left."""
        out: list = []
        if not self.looser or self.totals["halt"] is not None:
            return out
        self.looser, after = False, -1
        while len(self.positions) < MAX_POSITIONS:
            may = (dict(zip(("instrument_class", "underlying", "direction", "holding_period"), kind, strict=True)) | {"low": low} for kind, low in self.queue.kinds.items() if self.free(kind[3]) > 0)
            found = [n for k in may if self.crowded(k) is None and not self.doubled(k) and (n := k["low"].first(after, self.fits)) is not None]
            if not found:
                break
            after = min(found)
            s = self.queue.remove(after)
            self.looser |= s["trade_id"] in self.positions
            self.open(s)
            out.append((after, s["trade_id"], "OPENED"))
        return out

    def rows(self, portfolio: str, events: Iterable[dict]) -> list[tuple]:
        out = []
        for e in events:
            for trade, kind, outcome in self.step(e):
                t = self.totals
                out.append((portfolio, e["seq"], trade, kind, outcome, len(self.positions), sum(SLOTS.values()) - len(self.positions), t["daily_pnl"], t["drawdown"], t["halt"]))
        return out


def new_totals(capital: float) -> dict:
    return {"daily_pnl": 0.0, "peak": capital, "drawdown": 0.0, "halt": None}


def events_of(frames: Iterator[pd.DataFrame]) -> list[dict]:
    """Rows in order of seq, with None for what is missing."""
    rows = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
    return sorted(rows, key=lambda r: r["seq"])


def decisions(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=DECISION_NAMES)


class BookProcessor(StatefulProcessor):
    """Value state for totals, map state for positions by trade, list state for waiting signals; bounded by positions and the days a signal may wait."""

    def __init__(self, capital: float):
        self.capital = capital

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.positions = handle.getMapState("positions", "trade_id string", POSITION)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
        totals = dict(zip(names(TOTALS), self.totals.get(), strict=True)) if self.totals.exists() else new_totals(self.capital)
        held = {k[0]: dict(zip(names(POSITION), v, strict=True)) for k, v in self.positions.iterator()}
        waiting = [dict(zip(names(WAITING), w, strict=True)) for w in self.waiting.get()]
        book = Book(dict(held), list(waiting), totals, self.capital)
        out = book.rows(key[0], events_of(rows))
        for trade in held.keys() - book.positions.keys():
            self.positions.removeKey((trade,))
        for trade, p in book.positions.items():
            if held.get(trade) != p:
                self.positions.updateValue((trade,), tuple(p[n] for n in names(POSITION)))
        if book.waiting != waiting:
            self.waiting.put([tuple(w[n] for n in names(WAITING)) for w in book.waiting]) if book.waiting else self.waiting.clear()
        self.totals.update(tuple(book.totals[n] for n in names(TOTALS)))
        yield decisions(out)

    def close(self) -> None:
        pass


def book_stream(events: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """What each event (EVENT) does to its portfolio (DECISION); within a micro-batch events are taken in order of seq."""
    return events.groupBy("portfolio").transformWithStateInPandas(BookProcessor(capital), DECISION, "Append", "None")


def book_replay(events: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """The batch twin: all events of a portfolio in order of seq, sorted by Spark and read a batch at a time, so that only the book is in memory."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    bound_batches(events.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, portfolio = None, None
        for batch in batches:
            out: list = []
            for key, rows in itertools.groupby(batch.to_pylist(), lambda e: e["portfolio"]):
                if book is None or key != portfolio:
                    book, portfolio = Book({}, [], new_totals(capital), capital), key
                out += book.rows(key, rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), DECISION_TYPES, strict=True)], DECISION_NAMES) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in DECISION_TYPES], DECISION_NAMES)

    return events.select(*names).repartition("portfolio").sortWithinPartitions("portfolio", "seq").mapInArrow(work, DECISION)


# the bandit --------------------------------------------------------------------------------------------------------

PARTS = "action string, n bigint, outer array<double>, weighted array<double>"
MODEL = "action string, n bigint, inverse array<double>, theta array<double>"


def partial_sums(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Sums of outer products and rewarded contexts by action of all rows of a task, so that state meets a row a task and action."""
    sums: dict = {}
    for f in frames:
        for action, rows in f.groupby("action"):
            x, reward = np.stack(rows["context"].to_list()), rows["reward"].to_numpy(float)
            n, outer, weighted = sums.get(action, (0, np.zeros((size, size)), np.zeros(size)))
            sums[action] = (n + len(x), outer + x.T @ x, weighted + reward @ x)
    yield pd.DataFrame([(a, n, o.ravel().tolist(), w.tolist()) for a, (n, o, w) in sums.items()], columns=["action", "n", "outer", "weighted"])


def updated_inverse(inverse: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """The inverse of a sum of the inverted matrix and ``outer`` (symmetric, not negative), by one rank-one update for each of its directions."""
    values, vectors = np.linalg.eigh(outer)
    for value, v in zip(values, vectors.T, strict=True):
        if value > 1e-14 * max(values[-1], 0):
            u = inverse @ v
            inverse = inverse - np.outer(u, u) * (value / (1 + value * (v @ u)))
    return inverse


class BanditProcessor(StatefulProcessor):
    """By action: the inverse of the identity plus all outer products, the rewarded contexts' sum, and how many there were."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "n bigint, inverse array<double>, weighted array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, inverse, weighted = 0, np.eye(self.size), np.zeros(self.size)
        if self.model.exists():
            n, flat, weighted = self.model.get()
            inverse, weighted = np.array(flat).reshape(self.size, self.size), np.array(weighted)
        for f in rows:
            for more, outer, reward in zip(f["n"], f["outer"], f["weighted"], strict=True):
                n, inverse, weighted = n + int(more), updated_inverse(inverse, np.array(outer).reshape(self.size, self.size)), weighted + np.array(reward)
        self.model.update((n, inverse.ravel().tolist(), weighted.tolist()))
        yield pd.DataFrame({"action": [key[0]], "n": [n], "inverse": [inverse.ravel().tolist()], "theta": [(inverse @ weighted).tolist()]})

    def close(self) -> None:
        pass


def bandit_stream(replay: DataFrame, size: int = 10) -> DataFrame:
    """The model of each action (MODEL) whenever outcomes (action, reward, context) arrive; nothing is refitted."""
    parts = replay.select("action", "reward", "context").mapInPandas(lambda f: partial_sums(f, size), PARTS)
    return parts.groupBy("action").transformWithStateInPandas(BanditProcessor(size), MODEL, "Update", "None")


def bandit_action(signals: DataFrame, models: DataFrame, size: int = 10, alpha: float = 1.0) -> DataFrame:
    """Add bandit_action from the models of actions, a row each; an action without a model has seen nothing. ``signals`` need ``context``.

    Bounds are expressions over the model's arrays, so the choice runs without Python.
    """
    have = models.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("action", F.struct("inverse", "theta")))).alias("_m"))  # a row of as many entries as actions
    rows = signals.crossJoin(F.broadcast(have))
    x, at = F.col("context"), F.sequence(F.lit(0), F.lit(size - 1))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def bound(action: str):
        m = F.try_element_at("_m", F.lit(action))
        spread = dot(x, F.transform(at, lambda i: dot(F.slice(m["inverse"], i * size + 1, size), x)))
        return F.coalesce(dot(m["theta"], x) + alpha * F.sqrt(F.greatest(spread, F.lit(0.0))), alpha * F.sqrt(dot(x, x)))

    rows = rows.withColumn("_b", F.array(*map(bound, ACTIONS)))
    best = F.element_at(F.array(*map(F.lit, ACTIONS)), F.array_position("_b", F.array_max("_b")).cast("int"))
    return rows.select(*signals.columns, best.alias("bandit_action"))


# sessions ----------------------------------------------------------------------------------------------------------

#: (mode, opens, closes) of a working day in local time: all instruments, then commodities alone.
SESSIONS = [("ALL", dt.time(9, 15), dt.time(15, 30)), ("COMMODITY", dt.time(15, 30), dt.time(23, 30))]
ZONE_MINUTES = 330
SCAN = "desk string, ts timestamp, event_id bigint, instrument_class string"
LOG = "desk string, at timestamp, event string, mode string, event_id bigint"


def mode_at(ts: dt.datetime) -> tuple[str, dt.datetime | None]:
    """(mode, its end) of a moment in local time; sessions hold their opening minute and the last one too, and there are none at weekends."""
    if ts.weekday() < 5:
        minute = ts.replace(second=0, microsecond=0).time()
        for mode, opens, closes in SESSIONS:
            if opens <= minute and (minute <= closes):
                return mode, dt.datetime.combine(ts.date(), closes) + dt.timedelta(minutes=1)
    return "CLOSED", None


class SessionProcessor(StatefulProcessor):
    """A desk's mode and its end; an event-time timer ends each mode, so it closes without any further event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mode = handle.getValueState("mode", "mode string, until bigint")

    def enter(self, desk: str, now: dt.datetime, mode: str, until: dt.datetime | None, out: list) -> None:
        before = self.mode.get()[0] if self.mode.exists() else "CLOSED"
        if mode == before:
            return
        event = "OPEN" if before == "CLOSED" else "CLOSE" if mode == "CLOSED" else "SWITCH"
        out.append((desk, utc(now), event, mode, None))
        self.mode.update((mode, millis(until) if until else 0))
        if until:
            self.handle.registerTimer(millis(until))

    def end(self, desk: str, by: int, out: list) -> None:
        """Enter what follows modes that ended up to a moment."""
        while self.mode.exists() and 0 < self.mode.get()[1] <= by:
            now = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=self.mode.get()[1], minutes=ZONE_MINUTES)
            self.enter(desk, now, *mode_at(now), out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        for r in sorted((r for f in rows for r in f.to_dict("records")), key=lambda r: (r["ts"], r["event_id"])):
            now = local(r["ts"])
            self.end(key[0], millis(now), out)  # the watermark follows behind
            mode, until = mode_at(now)
            self.enter(key[0], now, mode, until, out)
            allowed = mode == "ALL" or (mode == "COMMODITY" and r["instrument_class"] == "COMMODITY_FUTURES")
            out.append((key[0], r["ts"].to_pydatetime(), "SCAN" if allowed else "SKIP", mode, r["event_id"]))
        yield log(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        self.end(key[0], expiredTimerInfo.getExpiryTimeInMs(), out)  # nothing is left to do if an event has ended the mode
        yield log(out)

    def close(self) -> None:
        pass


def local(ts: pd.Timestamp) -> dt.datetime:
    return ts.to_pydatetime().replace(tzinfo=None) + dt.timedelta(minutes=ZONE_MINUTES)


def utc(now: dt.datetime) -> dt.datetime:
    return now - dt.timedelta(minutes=ZONE_MINUTES)


def millis(now: dt.datetime) -> int:
    return int((utc(now) - dt.datetime(1970, 1, 1)) / dt.timedelta(milliseconds=1))


def log(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["desk", "at", "event", "mode", "event_id"])
    return out.astype({"event_id": "Int64", "at": "datetime64[us]"})


def session_stream(scans: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """The log (LOG) of each desk: sessions that open, switch to commodities alone and close, and what a scan in them admits.

    ``scans`` (SCAN) have timestamps in a session of UTC; sessions are local. Modes end by event-time timers as the watermark passes.
    """
    rows = scans.withWatermark("ts", lateness)
    return rows.groupBy("desk").transformWithStateInPandas(SessionProcessor(), LOG, "Append", "EventTime")
