"""Hidden Markov models over long or many series: forward-backward, Viterbi and EM as scans over chunks.

A step of the forward recursion is a matrix (transitions times the row's densities), and matrices compose, so a chunk of rows
is one small matrix whatever came before it; with maxima and sums in place of sums and products the same holds for Viterbi. A
pass works in three parts. Each chunk is reduced to its matrix. A scan over the matrices (in groups of GROUP chunks, then over
the groups) gives what enters each chunk from the left and from the right. Then each chunk runs its own recursions from there.
EM adds up the expected counts of all chunks in each task before they meet.

Chunks of a series are rows of one table (``chunked``), so no pass but the first shuffles rows; a task runs its chunks in
lockstep, a numpy step for a row of all of them. No series is ever in one task: of a series of n rows only n / (LENGTH * GROUP)
matrices are. All series share one model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.operators import scan
from edgelake.operators.regime import Hmm, log_density
from edgelake.tables import bound_batches, drop_table, write_table

#: Rows of a chunk, chunks of a group, and chunks that a task runs in lockstep.
LENGTH, GROUP, TOGETHER = 256, 256, 128
RIDGE = 1e-3


def chunked(rows: DataFrame, series: str, order: str, inputs: list[str], length: int = LENGTH, block_rows: int = scan.ROWS) -> DataFrame:
    """A written table (series, chunk, size, orders, x): the rows of each series in order (unique within it), ``length`` a chunk. Rows without an input are left out."""
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col(series).alias("series"), F.col(order).alias("order"), F.array(*(F.col(c).cast("double") for c in inputs)).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    placed = scan.running(rows, ["series"], ["order"], scan.by_rows(rows, "order", block_rows), {"n": scan.count(F.col("order"))})
    placed = placed.withColumn("chunk", F.floor((F.col("n") - 1) / length))
    sorted_ = F.array_sort(F.collect_list(F.struct("order", "x")))
    out = placed.groupBy("series", "chunk").agg(sorted_.alias("r"))
    return write_table(out.select("series", "chunk", F.size("r").alias("size"), F.col("r.order").alias("orders"), F.flatten("r.x").alias("x")), "chunks")


class Lockstep:
    """Some chunks side by side: densities (chunks, rows, states), scaled by each row's largest, and which rows are there."""

    def __init__(self, pdf: pd.DataFrame, model: Hmm):
        self.first, self.size = pdf["chunk"].to_numpy() == 0, pdf["size"].to_numpy()
        n, states, width = int(self.size.max()), len(model.means), model.means.shape[1]
        self.x = np.zeros((len(pdf), n, width))
        for i, flat in enumerate(pdf["x"]):
            self.x[i, : self.size[i]] = np.asarray(flat).reshape(-1, width)
        self.here = np.arange(n)[None, :] < self.size[:, None]
        self.logs = log_density(self.x.reshape(-1, width), model.means, model.covariances).reshape(len(pdf), n, states)
        self.top = np.where(self.here, self.logs.max(2), 0.0)
        self.b = np.exp(self.logs - self.logs.max(2)[:, :, None])
        # before a series' first row every state leads to the start's distribution
        self.into = np.where(self.first[:, None, None], model.start[None, None, :], model.moves[None])
        self.moves, self.n, self.states = model.moves, n, states

    def into_row(self, t: int) -> np.ndarray:
        return self.into if t == 0 else np.broadcast_to(self.moves, self.into.shape)

    def product(self) -> np.ndarray:
        """The chunks' matrices (sum-product), each scaled to a largest entry of 1."""
        m = np.broadcast_to(np.eye(self.states), self.into.shape).copy()
        for t in range(self.n):
            step = np.einsum("cij,cjk->cik", m, self.into_row(t)) * self.b[:, t, None, :]
            m = np.where(self.here[:, t, None, None], step / step.max((1, 2))[:, None, None], m)
        return m

    def longest(self) -> np.ndarray:
        """The chunks' matrices of best log scores (max-plus)."""
        with np.errstate(divide="ignore"):
            first, later = np.log(self.into), np.log(self.moves)
        m = first + self.logs[:, 0, None, :]
        for t in range(1, self.n):
            step = (m[:, :, :, None] + later[None, None]).max(2) + self.logs[:, t, None, :]
            m = np.where(self.here[:, t, None, None], step, m)
        return m

    def forward(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered distributions of all rows from those before the chunks, and each chunk's log likelihood given what came before."""
        out, likelihood, now = np.zeros(self.b.shape), np.zeros(len(left)), left
        for t in range(self.n):
            step = np.einsum("ci,cij->cj", now, self.into_row(t)) * self.b[:, t]
            total = step.sum(1)
            now = np.where(self.here[:, t, None], step / total[:, None], now)
            likelihood += np.where(self.here[:, t], np.log(total) + self.top[:, t], 0.0)
            out[:, t] = now
        return out, likelihood

    def backward(self, right: np.ndarray) -> np.ndarray:
        """For each row, up to a factor, the likelihood of all later rows by state."""
        out, now = np.ones(self.b.shape), right
        for t in range(self.n - 1, -1, -1):
            out[:, t] = now
            if t:
                step = np.einsum("ij,cj->ci", self.moves, self.b[:, t] * now)
                now = np.where(self.here[:, t, None], step / step.max(1)[:, None], now)
        return out

    def path(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Viterbi states of all rows, given the best scores before the chunks and the states of their last rows."""
        with np.errstate(divide="ignore"):
            later, first = np.log(self.moves), np.log(self.into)
        back, best = np.zeros(self.b.shape, np.int64), before
        for t in range(self.n):
            step = best[:, :, None] + (first if t == 0 else later[None])
            back[:, t] = step.argmax(1)
            best = np.where(self.here[:, t, None], step.max(1) + self.logs[:, t], best)
        states, now, chunk = np.zeros(self.b.shape[:2], np.int64), last.copy(), np.arange(len(last))
        for t in range(self.n - 1, -1, -1):
            states[:, t] = now
            now = np.where(self.here[:, t], back[chunk, t, now], now)
        return states


def slices(frames: Iterator[pd.DataFrame], model: Hmm) -> Iterator[tuple[pd.DataFrame, Lockstep]]:
    for pdf in frames:
        for at in range(0, len(pdf), TOGETHER):
            part = pdf.iloc[at : at + TOGETHER]
            yield part, Lockstep(part, model)


def square(values, states: int) -> np.ndarray:
    return np.array(list(values), float).reshape(-1, states, states)


def reduced(chunks: DataFrame, model: Hmm, best: bool) -> DataFrame:
    """(series, chunk, part, m): each chunk's matrix, flat."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, chunk in slices(frames, model):
            m = chunk.longest() if best else chunk.product()
            yield pd.DataFrame({"series": pdf["series"], "chunk": pdf["chunk"], "part": pdf["chunk"] // GROUP, "m": list(m.reshape(len(m), -1))})

    kind = chunks.schema["series"].dataType.simpleString()
    return write_table(chunks.mapInPandas(work, f"series {kind}, chunk bigint, part bigint, m array<double>"), "matrices")


def compose(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """The matrix of one stretch followed by another; scaled, as only ratios (differences) count."""
    if best:
        out = (a[:, :, None] + b[None]).max(1)
        return out - out.max()
    out = a @ b
    return out / out.max()


def scanned(ms: np.ndarray, left: np.ndarray, right: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """What enters each of a row of matrices from the left and from the right. For best scores ``right`` is the state of the last row, and what enters is the state of each one's last row."""
    n = len(ms)
    lefts = np.zeros((n, ms.shape[1]))
    for i in range(n):
        lefts[i] = left
        left = (left[:, None] + ms[i]).max(0) if best else left @ ms[i]
        left = left - left.max() if best else left / left.sum()
    rights = np.zeros(n, np.int64) if best else np.zeros((n, ms.shape[1]))
    for i in range(n - 1, -1, -1):
        rights[i] = right
        right = (lefts[i] + ms[i][:, right]).argmax() if best else ms[i] @ right
        right = right if best else right / right.max()
    return lefts, rights


def carried(matrices: DataFrame, states: int, best: bool) -> DataFrame:
    """(series, chunk, left, right): what enters each chunk; of each series' groups of chunks first, then within the groups."""
    kind = matrices.schema["series"].dataType.simpleString()
    right = "int" if best else "array<double>"

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        total = None
        for m in square(pdf["m"], states):
            total = m if total is None else compose(total, m, best)
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "part": pdf["part"].iloc[:1], "m": [total.ravel()]})

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ms = square(pdf["m"], states)
        end = np.ones(states)
        if best:
            score = np.zeros(states)
            for m in ms:
                score = (score[:, None] + m).max(0)
                score -= score.max()
            end = score.argmax()
        left, right_ = scanned(ms, np.zeros(states) if best else np.full(states, 1 / states), end, best)
        return pd.DataFrame({"series": pdf["series"], "part": pdf["part"], "left": list(left), "right": right_ if best else list(right_)})

    def within(key: tuple, pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        end = ends["right"].iloc[0]
        left, right_ = scanned(square(pdf["m"], states), np.array(ends["left"].iloc[0]), end if best else np.array(end), best)
        return pd.DataFrame({"series": pdf["series"], "chunk": pdf["chunk"], "left": list(left), "right": right_ if best else list(right_)})

    groups = matrices.groupBy("series", "part").applyInPandas(group, f"series {kind}, part bigint, m array<double>")
    ends = groups.groupBy("series").applyInPandas(over, f"series {kind}, part bigint, left array<double>, right {right}")
    return matrices.groupBy("series", "part").cogroup(ends.groupBy("series", "part")).applyInPandas(within, f"series {kind}, chunk bigint, left array<double>, right {right}")


def with_ends(chunks: DataFrame, model: Hmm, best: bool) -> tuple[DataFrame, DataFrame]:
    """The chunks with what enters them, and the table of matrices, to be dropped after use."""
    matrices = reduced(chunks, model, best)
    return chunks.join(carried(matrices, len(model.means), best), ["series", "chunk"]), matrices


def expected(chunks: DataFrame, model: Hmm) -> dict[str, np.ndarray]:
    """Expected counts of one EM round: likelihood, start, moves, weight, sums of inputs and of their products, by state."""
    states, width = model.means.shape
    ready, matrices = with_ends(chunks, model, False)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: 0.0 for k in ("likelihood", "start", "moves", "weight", "x", "xx")}
        for pdf, c in slices(frames, model):
            left = np.array(list(pdf["left"]), float)
            a, likelihood = c.forward(left)
            b = c.backward(np.array(list(pdf["right"]), float))
            posterior = a * b
            posterior = posterior / posterior.sum(2)[:, :, None] * c.here[:, :, None]
            before = np.concatenate([left[:, None], a[:, :-1]], 1)
            into = c.b * b
            pair_total = np.einsum("cti,ij,ctj->ct", before, c.moves, into)
            some = c.here.copy()
            some[:, 0] &= ~c.first  # nothing leads into a series' first row
            into = into * np.where(some, 1 / pair_total, 0.0)[:, :, None]
            sums["likelihood"] += likelihood.sum()
            sums["start"] += posterior[c.first, 0].sum(0)
            sums["moves"] += np.einsum("cti,ctj->ij", before, into) * c.moves
            sums["weight"] += posterior.sum((0, 1))
            sums["x"] += np.einsum("cts,ctd->sd", posterior, c.x)
            sums["xx"] += np.einsum("cts,ctd,cte->sde", posterior, c.x, c.x)
        rows = [(k, i, float(v)) for k, s in sums.items() for i, v in enumerate(np.ravel(s))]
        yield pd.DataFrame(rows, columns=["what", "i", "v"])

    found = ready.mapInPandas(work, "what string, i int, v double").groupBy("what", "i").agg(F.sum("v").alias("v")).collect()  # as many as the model has numbers
    drop_table(matrices)
    shapes = {"likelihood": (), "start": (states,), "moves": (states, states), "weight": (states,), "x": (states, width), "xx": (states, width, width)}
    out = {k: np.zeros(int(np.prod(s))) for k, s in shapes.items()}
    for r in found:
        if r["i"] < len(out[r["what"]]):
            out[r["what"]][r["i"]] += r["v"]
    return {k: out[k].reshape(s) for k, s in shapes.items()}


def fit(chunks: DataFrame, initial: Hmm, most: int = 2_000, tolerance: float = 1e-4) -> Hmm:
    """EM from ``initial`` over all rows of all series, until the likelihood rises by less than ``tolerance``; states by ascending mean of the first input."""
    model, history = initial, []
    for _ in range(most):
        e = expected(chunks, model)
        history.append(float(e["likelihood"]))
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        means = e["x"] / e["weight"][:, None]
        spread = e["xx"] / e["weight"][:, None, None] - means[:, :, None] * means[:, None, :]
        model = Hmm(e["start"] / e["start"].sum(), e["moves"] / e["moves"].sum(1, keepdims=True), means, spread + RIDGE * np.eye(means.shape[1]), history)
    order = model.means[:, 0].argsort()
    return Hmm(model.start[order], model.moves[order][:, order], model.means[order], model.covariances[order], history)


def decode(chunks: DataFrame, model: Hmm, smoothed: bool = True) -> DataFrame:
    """(series, order, state, probs) of every row: Viterbi states, and smoothed or filtered distributions."""
    ready, _ = with_ends(chunks, model, False)
    paths, _ = with_ends(chunks, model, True)
    ready = ready.join(paths.select("series", "chunk", F.col("left").alias("before"), F.col("right").alias("last")), ["series", "chunk"])
    kind, order = (chunks.schema[c].dataType for c in ("series", "orders"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, c in slices(frames, model):
            probs, _ = c.forward(np.array(list(pdf["left"]), float))
            if smoothed:
                probs = probs * c.backward(np.array(list(pdf["right"]), float))
                probs = probs / probs.sum(2)[:, :, None]
            states = c.path(np.array(list(pdf["before"]), float), pdf["last"].to_numpy())
            yield pd.DataFrame({"series": np.repeat(pdf["series"].to_numpy(), c.size), "order": np.concatenate(list(pdf["orders"])), "state": states[c.here], "probs": list(probs[c.here])})

    return ready.mapInPandas(work, f"series {kind.simpleString()}, order {order.elementType.simpleString()}, state int, probs array<double>")
