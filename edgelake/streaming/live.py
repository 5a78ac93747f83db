"""The live loop as a stream: files of bars or signals arrive, and each micro-batch runs the batch operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgelake.operators import gate, ledger
from edgelake.sources import snapshots

EVERY = "300 seconds"


def read_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def local_day(ts, zone: str = "Asia/Kolkata"):
    return F.to_date(F.from_utc_timestamp(ts, zone))


def first_of_day(signals: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first signal of an edge, underlying and direction on each local day; state older than ``lateness`` is dropped."""
    rows = signals.withColumn("local_date", local_day(F.col("ts"))).withWatermark("ts", lateness)
    return rows.dropDuplicatesWithinWatermark(["local_date", "edge_id", "underlying", "direction"])


def daily_bars(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """An extension: one bar a day and key from ticks (ts, key, value), finished when the watermark passes."""
    day = F.window("ts", "1 day")
    out = ticks.withWatermark("ts", lateness).groupBy(day, "key").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )
    return out.select(F.col("key").alias("instrument"), F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")


Step = Callable[[DataFrame, int], None]


def isolated(step: Step, failed: Callable[[DataFrame], None]) -> Step:
    """A step whose failure is handed to ``failed`` as a row (batch, error, message) and leaves the stream running."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            step(batch, number)
        except Exception as error:  # noqa: BLE001  whatever fails in a batch must not end the loop
            failed(batch.sparkSession.createDataFrame([(number, type(error).__name__, str(error)[:1000])], "batch bigint, error string, message string"))

    return run


LETTER = {"_batch": "bigint", "_error": "string", "_message": "string"}


def quarantined(step: Step, path: str) -> Step:
    """A step whose failing batches are kept, all their rows with the batch's number and error, in a folder each, while the stream goes on.

    A batch that fails again replaces its folder, so a restart leaves one copy. If the rows can't be kept the stream stops.
    """

    def run(batch: DataFrame, number: int) -> None:
        try:
            step(batch, number)
        except Exception as error:  # noqa: BLE001  whatever fails in a batch must not end the loop
            what = {"_batch": F.lit(number).cast("bigint"), "_error": F.lit(type(error).__name__), "_message": F.lit(str(error)[:1000])}
            batch.withColumns(what).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return run


def dead_letters(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches in quarantine, ascending."""
    return sorted(int(n[6:]) for n in snapshots.listed(spark, path) if n.startswith("batch-"))


def replay(spark: SparkSession, path: str, step: Step) -> list[int]:
    """Run a step over the batches in quarantine, each under its own number, oldest first, and release those that succeed.

    A crash after a step and before the release repeats the batch, so steps should know numbers that they have taken, as
    snapshots.upsert() does. Returns the numbers that were released.
    """
    released = []
    for number in dead_letters(spark, path):
        rows = spark.read.parquet(f"{path}/batch-{number}")
        step(rows.drop(*LETTER), number)
        fs, p = snapshots.file_system(spark, f"{path}/batch-{number}")
        fs.delete(p, True)
        released.append(number)
    return released


def upsert_versions(bars: DataFrame, path: str, checkpoint: str, keys: list[str], by: str, order: str | None = None, quarantine: str | None = None, once: bool = True):
    """Merge every micro-batch into a table of atomic versions, once each however often it is run; batches that fail go to ``quarantine``."""
    step = version_step(path, keys, by, order)
    return start(bars, quarantined(step, quarantine) if quarantine else step, checkpoint, once)


def version_step(path: str, keys: list[str], by: str, order: str | None = None, stream: str = "bars") -> Step:
    def step(batch: DataFrame, number: int) -> None:
        snapshots.upsert(path, batch, keys, by, order, stream, number)

    return step


def once_a_day(tasks: list[tuple[str, str, Step]], done: Callable[[], DataFrame], mark: Callable[[DataFrame], None], zone: str = "Asia/Kolkata") -> Step:
    """A step that runs each task (name, HH:MM, step) in the first batch whose newest ``ts`` is at or past its local time, once a day.

    ``done`` gives the rows (task, day) that ``mark`` has written, so a restarted stream doesn't repeat a task.
    """

    def run(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(F.from_utc_timestamp("ts", zone))).first()[0]
        if now is None:
            return
        ran = {r["task"] for r in done().where(F.col("day") == F.lit(now.date())).collect()}  # as many as tasks
        for name, at, step in tasks:
            if name not in ran and (now.hour, now.minute) >= (int(at[:2]), int(at[3:])):
                step(batch, number)
                mark(batch.sparkSession.createDataFrame([(name, now.date())], "task string, day date"))

    return run


def start(stream: DataFrame, step: Step, checkpoint: str, once: bool = True):
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=EVERY)).start()


def upsert_batches(bars: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, once: bool = True, days: int = 60):
    """Merge every micro-batch into the stored bars, newest first by instrument and date.

    Only the batch's instruments are read and written (write_bars() leaves other partitions alone), and rows over ``days`` older
    than an instrument's last stored day are dropped: history isn't revised.
    """

    def merge(batch: DataFrame, _: int) -> None:
        names = [r[0] for r in batch.select("instrument").distinct().collect()]  # partitions touched
        old = read().where(F.col("instrument").isin(names))
        last = old.groupBy("instrument").agg(F.max("date").alias("_last"))
        fresh = batch.join(last, "instrument", "left").where(F.col("_last").isNull() | (F.col("date") >= F.date_sub("_last", days))).drop("_last")
        write(ledger.upsert_latest(old, fresh, ["instrument", "date"]))

    return start(bars, merge, checkpoint, once)


def simulated_fills(sized: DataFrame) -> DataFrame:
    """Orders filled at the quoted price, 0 where there is none."""
    return sized.withColumns({"order_id": F.concat(F.lit("SIM_"), F.col("event_id").cast("string")), "fill_price": F.coalesce("lot_value", F.lit(0.0))})


def run_pipeline(signals: DataFrame, positions: Callable[[], DataFrame], edges: DataFrame, write: Step, checkpoint: str, once: bool = True, failed: Callable[[DataFrame], None] | None = None):
    """Validate, select, size and fill each micro-batch of signals against the book as it stands, and hand the trades to ``write``."""

    def step(batch: DataFrame, number: int) -> None:
        book = positions()
        approved = gate.validate(batch, book, edges).where("decision = 'APPROVED'")
        write(simulated_fills(gate.size(gate.select_trades(approved, book, "event_id"))), number)

    return start(signals, isolated(step, failed) if failed else step, checkpoint, once)


def opened(trades: DataFrame) -> DataFrame:
    """The rows that trades add to the book."""
    return trades.select(F.col("order_id").alias("trade_id"), "instrument_class", "underlying", "direction", "holding_period", F.col("margin_per_lot").alias("margin"))


def close_trades(outcomes: DataFrame, edges: Callable[[], DataFrame], write: dict[str, Callable[[DataFrame], None]], checkpoint: str, once: bool = True):
    """Fan each micro-batch of closed trades out to the log, both learners' observations, the signals and the edges, as ledger.trade_close() gives them."""

    def step(batch: DataFrame, _: int) -> None:
        for name, rows in ledger.trade_close(batch, edges()).items():
            write[name](rows)

    return start(outcomes, step, checkpoint, once)


def books(closes: DataFrame, capital: float) -> DataFrame:
    """(portfolio, daily_pnl, drawdown, halt) after each batch of closes (portfolio, seq, pnl): state kept by portfolio."""

    def step(key, frames, state: GroupState):
        daily, peak, halt = state.get if state.exists else (0.0, capital, None)
        drawdown = 0.0
        for pdf in frames:
            for pnl in pdf.sort_values("seq")["pnl"]:
                daily, peak = daily + pnl, max(peak, capital + pnl)
                drawdown = (peak - capital - pnl) / peak
                if halt is None and drawdown > 0.08:
                    halt = f"DRAWDOWN_{drawdown:.1%}"
                if halt is None and daily < -0.04 * capital:
                    halt = "SINGLE_DAY_LOSS_4PCT"
        state.update((daily, peak, halt))
        yield pd.DataFrame({"portfolio": [key[0]], "daily_pnl": [daily], "drawdown": [drawdown], "halt": [halt]})

    return closes.groupBy("portfolio").applyInPandasWithState(
        step, "portfolio string, daily_pnl double, drawdown double, halt string", "daily double, peak double, halt string", "update", GroupStateTimeout.NoTimeout
    )
