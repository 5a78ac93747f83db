"""The limit on open positions as a parallel algorithm.

A walk takes candidate trades in the order of day, instrument and sequence: a candidate enters if its pair (instrument and
direction) isn't open and fewer than ``most`` trades are. This looks serial, since every entry depends on all before it, but
what passes from one day to the next is no more than ``most`` open trades.

- Of a day only the first 2 * most candidates can enter: at most ``most`` of them are blocked by their own open trade, and
  when as many entered there is no room left. A window limit cuts each day to these before the shuffle, so the work
  follows the number of days, not of instruments.
- The time line is cut into spans of days. All spans are walked at once, each from a guess of the trades that are open at
  its start, at first none. A span whose guess differs from what its predecessor leaves is walked again with this, until no
  guess differs. Then every span has been walked from its true state, so the result is that of the serial walk. Round r
  leaves the first r spans right at least, and spans that no trade crosses are right at once.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.constants import MAX_POSITIONS
from edgelake.tables import drop_table, write_table

#: Days of a span, and when trades that never close do.
SPAN, NEVER = 128, dt.date(9999, 12, 31)
EPOCH = dt.date(1970, 1, 1)
OPEN = "array<struct<instrument: string, direction: string, exit_day: date>>"
WALKED = f"span int, entering {OPEN}, leaving {OPEN}, taken array<struct<instrument: string, direction: string, day: date>>"


def enterable(rows: DataFrame, most: int) -> DataFrame:
    """The candidates of each day that can enter whatever is open; of a pair's candidates of a day the first counts."""
    one = Window.partitionBy("day", "instrument", "direction").orderBy("seq")
    order = Window.partitionBy("day").orderBy("instrument", "seq", "direction")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * most).drop("_n")


def walk_span(rows: pd.DataFrame, open_: dict, most: int, end: dt.date) -> tuple[list[dict], list[dict]]:
    """The trades of a span that enter, and those still open after ``end``; ``open_`` maps pairs to exit days."""
    taken = []
    for pair, day, exit_day in zip(zip(rows["instrument"], rows["direction"], strict=True), rows["day"], rows["exit_day"], strict=True):
        open_ = {k: v for k, v in open_.items() if v > day}
        if pair not in open_ and len(open_) < most:
            open_[pair] = exit_day
            taken.append({"instrument": pair[0], "direction": pair[1], "day": day})
    leaving = [{"instrument": k[0], "direction": k[1], "exit_day": v} for k, v in sorted(open_.items()) if v > end]
    return taken, leaving


def taken(candidates: DataFrame, most: int = MAX_POSITIONS, span: int = SPAN) -> DataFrame:
    """The rows of candidates (instrument, direction, day, seq, exit_day, …) that a serial walk takes; exit_day is null if a trade never closes."""
    narrow = candidates.select("instrument", "direction", "day", "seq", F.coalesce("exit_day", F.lit(NEVER)).alias("exit_day"))
    able = write_table(enterable(narrow, most).withColumn("span", F.floor(F.unix_date("day") / span).cast("int")), "enterable")

    def work(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(states):  # a span that needs no walk
            return pd.DataFrame({"span": [], "entering": [], "leaving": [], "taken": []})
        number, entering = int(states["span"].iloc[0]), [dict(x) for x in states["entering"].iloc[0]]
        end = EPOCH + dt.timedelta(days=(number + 1) * span)
        rows = rows.sort_values(["day", "instrument", "seq", "direction"])
        got, leaving = walk_span(rows, {(x["instrument"], x["direction"]): x["exit_day"] for x in entering}, most, end)
        return pd.DataFrame({"span": [number], "entering": [entering], "leaving": [leaving], "taken": [got]})

    def walk(states: DataFrame) -> DataFrame:
        rows = able.join(states.select("span"), "span", "left_semi")
        return rows.groupBy("span").cogroup(states.groupBy("span")).applyInPandas(work, WALKED)

    ends = able.agg(F.min("span").alias("a"), F.max("span").alias("b")).where("a is not null")
    spans = ends.select(F.explode(F.sequence("a", "b")).alias("span"))  # spans without candidates pass on what is open
    walked = write_table(walk(spans.withColumn("entering", F.array().cast(OPEN))), "walked")
    while True:
        left = walked.select((F.col("span") + 1).alias("span"), "leaving")
        wrong = walked.select("span", "entering").join(left, "span").where("leaving <> entering").select("span", F.col("leaving").alias("entering"))
        wrong = write_table(wrong, "wrong")
        if wrong.isEmpty():
            drop_table(wrong)
            break
        again = write_table(walked.join(wrong.select("span"), "span", "left_anti").unionByName(walk(wrong)), "walked")
        drop_table(walked, wrong)
        walked = again
    drop_table(able)
    keys = walked.select(F.explode("taken").alias("t")).select("t.*")
    one = Window.partitionBy("day", "instrument", "direction").orderBy("seq")
    firsts = candidates.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return firsts.join(keys, ["instrument", "direction", "day"], "left_semi")
