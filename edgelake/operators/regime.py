"""Market regimes: scoring with fixed states, and a Gaussian hidden Markov model."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelake.constants import CONFIDENCE_DROP, REGIMES, UNSURE, VIX_SPIKE
from edgelake.functions.windows import log_return, rolling, true

INPUTS = ["log_ret", "vol_5d", "vix"]


def by_date():
    """One series; a few thousand rows go through one task."""
    return W.orderBy("date")


def market_inputs(market: DataFrame) -> DataFrame:
    """(date, index_close, vix_close, log_ret, vol_5d, vix) of an index joined with its volatility, without incomplete rows."""
    rows = market.select("date", F.col("close").alias("index_close"), F.col("vix").alias("vix_close"))
    rows = rows.withColumn("log_ret", log_return(F.col("index_close"), by_date()))
    ret = F.col("log_ret")
    return rows.withColumns({"vol_5d": rolling(F.stddev_samp(ret), ret, 5, by_date()), "vix": F.col("vix_close") / 100}).dropna()


def standardized(rows: DataFrame, train_end: str) -> DataFrame:
    """Inputs less their mean over their population deviation, both of the training rows."""
    train = rows.where(F.col("date") <= F.lit(train_end).cast("date"))
    scale = train.agg(*(f(c).alias(f"_{p}_{c}") for c in INPUTS for p, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.crossJoin(F.broadcast(scale))  # one row
    return out.select("date", "index_close", "vix_close", *((F.col(c) - F.col(f"_m_{c}")).__truediv__(F.nullif(F.col(f"_s_{c}"), F.lit(0.0))).alias(c) for c in INPUTS))


def score_fixed(rows: DataFrame, states: dict[str, tuple[float, float, float]], sharpness: float = 1.5) -> DataFrame:
    """Posteriors of fixed spherical states under equal priors, without transitions: prob_<label> columns."""
    distance = lambda m: sum((F.col(c) - x) * (F.col(c) - x) for c, x in zip(INPUTS, m, strict=True))
    out = rows.withColumns({f"_{k}": F.exp(-sharpness * distance(m) / 2) for k, m in states.items()})
    total = sum((F.col(f"_{k}") for k in states), F.lit(0.0))
    return out.withColumns({f"prob_{k}": F.col(f"_{k}") / total for k in states}).drop(*(f"_{k}" for k in states))


def labelled(rows: DataFrame) -> DataFrame:
    """regime_state, regime_confidence and the warning flag from prob_ columns.

    The likeliest label wins, the first of REGIMES on ties; below UNSURE it is SIDEWAYS. A drop in confidence or a jump of the
    volatility index against the row before warns of a transition.
    """
    probs = F.array(*(F.col(f"prob_{k}") for k in REGIMES))
    best = F.array_max(probs)
    label = F.element_at(F.array(*map(F.lit, REGIMES)), F.array_position(probs, best).cast("int"))
    out = rows.withColumns({"regime_confidence": best, "regime_state": F.when(best < UNSURE, "SIDEWAYS").otherwise(label)})
    drop = F.lag("regime_confidence").over(by_date()) - F.col("regime_confidence") > CONFIDENCE_DROP
    before = F.lag("vix_close").over(by_date())
    spike = F.try_divide(F.col("vix_close") - before, before) > VIX_SPIKE
    return out.withColumn("transition_warning_flag", true(drop) | true(spike))


def blocks(history: DataFrame) -> DataFrame:
    """Runs of one regime: (regime_state, start, end, days)."""
    new = F.coalesce(F.lag("regime_state").over(by_date()) != F.col("regime_state"), F.lit(True))
    runs = history.withColumn("_run", F.sum(new.cast("long")).over(by_date().rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("_run", "regime_state").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("_run")


def named_by_mean(rows: DataFrame, state: str, value: str) -> DataFrame:
    """(state, mean, label): states named by ascending mean; there are no more of them than names."""
    means = rows.groupBy(F.col(state).alias("state")).agg(F.avg(value).alias("mean"))
    names = F.array(*map(F.lit, REGIMES))
    return means.withColumn("label", F.element_at(names, F.row_number().over(W.orderBy("mean"))))


@dataclass
class Hmm:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihoods: list[float]


def log_density(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covariances, strict=True)):
        root = np.linalg.cholesky(c)
        y = np.linalg.solve(root, (x - m).T)
        out[:, k] = -0.5 * (y * y).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(density: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    with np.errstate(divide="ignore"):
        ls, lm = np.log(start), np.log(moves)
    a, b = np.empty_like(density), np.zeros_like(density)
    a[0] = ls + density[0]
    for t in range(1, len(density)):
        a[t] = density[t] + log_sum(a[t - 1][:, None] + lm, 0)
    for t in range(len(density) - 2, -1, -1):
        b[t] = log_sum(lm + density[t + 1] + b[t + 1], 1)
    return a, b, float(log_sum(a[-1], 0))


def first_hmm(x: np.ndarray, states: int = 5, seed: int = 42) -> Hmm:
    """Where EM starts: k-means centres, one covariance, and states that mostly stay."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), states, replace=False)]
    for _ in range(50):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(states)])
    ridge = 1e-3 * np.eye(x.shape[1])
    means, covariances = centres, np.stack([np.cov(x.T, bias=True) + ridge] * states)
    moves = np.full((states, states), 0.1 / (states - 1))
    np.fill_diagonal(moves, 0.9)
    return Hmm(np.full(states, 1 / states), moves, means, covariances, [])


def fit_hmm(x: np.ndarray, states: int = 5, most: int = 2_000, tolerance: float = 1e-4, seed: int = 42) -> Hmm:
    """Baum-Welch in log space from a k-means start; states are ordered by ascending mean of the first column."""
    first, ridge = first_hmm(x, states, seed), 1e-3 * np.eye(x.shape[1])
    start, moves, means, covariances, history = first.start, first.moves, first.means, first.covariances, []
    for _ in range(most):
        density = log_density(x, means, covariances)
        a, b, total = forward_backward(density, start, moves)
        history.append(total)
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        posterior = np.exp(a + b - total)
        with np.errstate(divide="ignore"):
            pair = np.exp(a[:-1, :, None] + np.log(moves) + (density[1:] + b[1:])[:, None, :] - total).sum(0)
        start, moves = posterior[0] / posterior[0].sum(), pair / pair.sum(1, keepdims=True)
        weight = posterior.sum(0)
        means = posterior.T @ x / weight[:, None]
        covariances = np.stack([((x - means[k]).T * posterior[:, k]) @ (x - means[k]) / weight[k] + ridge for k in range(states)])
    order = means[:, 0].argsort()
    return Hmm(start[order], moves[order][:, order], means[order], covariances[order], history)


def decode(x: np.ndarray, model: Hmm, smoothed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(Viterbi states, posteriors); filtered posteriors see no later rows."""
    density = log_density(x, model.means, model.covariances)
    a, b, total = forward_backward(density, model.start, model.moves)
    posterior = np.exp(a + b - total) if smoothed else np.exp(a - log_sum(a, 1)[:, None])
    with np.errstate(divide="ignore"):
        lm, best = np.log(model.moves), np.log(model.start) + density[0]
    back = np.zeros(density.shape, int)
    for t in range(1, len(x)):
        step = best[:, None] + lm
        back[t] = step.argmax(0)
        best = step.max(0) + density[t]
    states = np.empty(len(x), int)
    states[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states, posterior


def classify(rows: DataFrame, train_end: str, smoothed: bool = True) -> DataFrame:
    """Fit on the training rows and decode them and the later ones separately. One series of a few thousand rows is one group."""
    names = ", ".join(f"prob_{k} double" for k in REGIMES)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = pdf[INPUTS].to_numpy()
        train = (pd.to_datetime(pdf["date"]) <= pd.Timestamp(train_end)).to_numpy()
        model = fit_hmm(x[train])
        out = pdf[["date", "index_close", "vix_close"]].copy()
        states, probs = np.zeros(len(x), int), np.zeros((len(x), len(REGIMES)))
        for part in (train, ~train):
            if part.any():
                states[part], probs[part] = decode(x[part], model, smoothed)
        out["hmm_state_int"] = states
        for i, k in enumerate(REGIMES):
            out[f"prob_{k}"] = probs[:, i]
        return out

    schema = f"date date, index_close double, vix_close double, hmm_state_int int, {names}"
    return labelled(standardized(rows, train_end).groupBy(F.lit("all")).applyInPandas(work, schema))
