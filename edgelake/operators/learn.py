"""Learners: LinUCB sizing, Gaussian-process thresholds and a boosted-tree meta-labeler."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.constants import META_THRESHOLD, META_TRADES

# The order of actions decides ties.
ACTIONS = ["SKIP", "SMALL", "MEDIUM", "LARGE"]
#: parameter: (lowest, highest, default)
BOUNDS = {"z_21d_threshold": (-3.0, -1.5, -2.0), "rsi_2_threshold": (5.0, 15.0, 10.0), "gap_pct_threshold": (-0.015, -0.007, -0.01), "z_21d_currency": (-2.5, -1.2, -1.8)}
REGIME_CODES = {"H_BEAR": 0, "L_BEAR": 1, "SIDEWAYS": 2, "L_BULL": 3, "H_BULL": 4}
#: label features and what stands for a missing value
META_FEATURES = {
    "trigger_value": 0.0, "hmm_confidence": 0.5, "regime_code": 2.0, "vix_level": 15.0, "dte": 5.0, "holding_period": 5.0, "recent_edge_win_rate": 0.55, "vol_expanding": 0.0,
    "z_21d": 0.0, "rsi_2": 50.0, "mom_5d": 0.0, "day_of_week": 2.0, "days_since_last_trade": 7.0,
}


def context(signals: DataFrame) -> Column:
    """Ten scaled features of a signal; missing columns and nulls take defaults."""
    have = set(signals.columns)
    get = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in have else F.lit(default)
    flag = lambda c, value: F.coalesce(F.col(c) == value, F.lit(False)).cast("double") if c in have else F.lit(0.0)
    return F.array(
        get("confidence", 0.5), get("meta_score", 0.6), get("trigger_value", 0.0), get("holding_period", 5.0) / 15, flag("instrument_class", "INDEX_OPTIONS"), flag("direction", "LONG"),
        get("recent_edge_win_rate", 0.55), get("current_drawdown", 0.0), get("open_positions_count", 0.0) / 8, get("days_since_last_trade", 7.0) / 30,
    )


def bandit_sums(replay: DataFrame) -> DataFrame:
    """(action, i, j, a, b): the sums of outer products (plus the identity) and of rewarded contexts (for j = 0), built up from partial sums."""
    pairs = replay.select("action", "reward", "context", F.posexplode("context").alias("i", "x"))
    pairs = pairs.select("action", "reward", "i", "x", F.posexplode("context").alias("j", "y"))
    sums = pairs.groupBy("action", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("a"), F.sum(F.when(F.col("j") == 0, F.col("reward") * F.col("x"))).alias("b"))
    return sums.withColumn("a", F.col("a") + (F.col("i") == F.col("j")).cast("double"))


def bandit_choose(signals: DataFrame, sums: DataFrame, size: int = 10, alpha: float = 1.0) -> DataFrame:
    """Add bandit_action: the action with the highest upper confidence bound, the first of ACTIONS on ties. signals need ``context``."""
    models = {k: (np.eye(size), np.zeros(size)) for k in ACTIONS}
    for r in sums.collect():  # len(ACTIONS) * size * size rows
        if r["action"] in models:
            models[r["action"]][0][r["i"], r["j"]] = r["a"]
            if r["b"] is not None:
                models[r["action"]][1][r["i"]] = r["b"]
    solved = [(np.linalg.inv(a), np.linalg.inv(a) @ b) for a, b in models.values()]

    @F.pandas_udf("string")
    def choose(contexts: pd.Series) -> pd.Series:
        x = np.stack(contexts.to_list()) if len(contexts) else np.zeros((0, size))
        bounds = np.stack([x @ theta + alpha * np.sqrt(np.einsum("ni,ij,nj->n", x, inverse, x)) for inverse, theta in solved], 1)
        return pd.Series([ACTIONS[i] for i in bounds.argmax(1)], dtype="object")

    return signals.withColumn("bandit_action", choose("context"))


def gaussian_process(x: np.ndarray, y: np.ndarray, at: np.ndarray, n: np.ndarray, deviation: float) -> np.ndarray:
    """Posterior mean with a squared-exponential kernel, given means y of n observations each; the length scale maximizes the marginal likelihood over a grid."""
    mean, scale = np.average(y, weights=n), deviation or 1.0
    z, best = (y - mean) / scale, (-np.inf, 1.0, None)
    for length in np.logspace(-5, 5, 81):
        k = np.exp(-0.5 * ((x[:, None] - x) / length) ** 2) + np.diag(1e-10 / n)
        try:
            root = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            continue
        weights = np.linalg.solve(root.T, np.linalg.solve(root, z))
        fit = -0.5 * z @ weights - np.log(np.diag(root)).sum()
        if fit > best[0]:
            best = (fit, length, weights)
    if best[2] is None:
        return np.full(len(at), mean)
    return mean + scale * (np.exp(-0.5 * ((at[:, None] - x) / best[1]) ** 2) @ best[2])


def threshold_cells(observations: DataFrame) -> DataFrame:
    """(param, threshold, pnl, squares, n): observations of known parameters averaged by cell, a thousandth of the parameter's bounds; beyond the bounds they count at the bound."""
    table = lambda j: F.create_map(*(F.lit(x) for k, v in BOUNDS.items() for x in (k, v[j])))
    low, high = (F.try_element_at(table(j), F.col("param")) for j in (0, 1))
    width = (high - low) / 1000
    cell = F.round((F.least(high, F.greatest(low, F.col("threshold"))) - low) / width) * width + low
    rows = observations.where(F.col("param").isin(list(BOUNDS)) & F.col("threshold").isNotNull() & F.col("pnl").isNotNull())
    return rows.groupBy("param", cell.alias("threshold")).agg(F.avg("pnl").alias("pnl"), F.avg(F.col("pnl") * F.col("pnl")).alias("squares"), F.count("*").alias("n"))


def thresholds(observations: DataFrame, least_total: int = 50, least: int = 20) -> DataFrame:
    """(param, threshold): per parameter the best of 50 points in its bounds, or its default with too few observations.

    The process sees the averages of at most 1,001 cells a parameter, weighted by their counts.
    """
    total = observations.count()
    bounds = BOUNDS

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["param"].iloc[0]
        low, high, default = bounds[name]
        n = pdf["n"].to_numpy(float)
        if n.sum() >= least and total >= least_total:
            grid, y = np.linspace(low, high, 50), pdf["pnl"].to_numpy()
            deviation = np.sqrt(max(0.0, np.average(pdf["squares"], weights=n) - np.average(y, weights=n) ** 2))
            default = float(grid[gaussian_process(pdf["threshold"].to_numpy(), y, grid, n, deviation).argmax()])
        return pd.DataFrame({"param": [name], "threshold": [default]})

    found = threshold_cells(observations).groupBy("param").applyInPandas(work, "param string, threshold double")
    names = observations.sparkSession.createDataFrame([(k, v[2]) for k, v in bounds.items()], "param string, fallback double")
    return F.broadcast(names).join(found, "param", "left").select("param", F.coalesce("threshold", "fallback").alias("threshold"))


def meta_features(signals: DataFrame) -> list[Column]:
    codes = F.create_map(*(F.lit(x) for kv in REGIME_CODES.items() for x in kv))
    rows = {c: F.col(c).cast("double") for c in signals.columns if c in META_FEATURES}
    if "regime_state" in signals.columns:
        rows["regime_code"] = F.try_element_at(codes, F.col("regime_state")).cast("double")
    return [F.coalesce(rows[c], F.lit(d)).alias(c) if c in rows else F.lit(d).alias(c) for c, d in META_FEATURES.items()]


def meta_fit(trades: DataFrame, seed: int = 42):
    """A boosted-tree model of net_return_pct > 0, or None before META_TRADES trades."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = trades.select(*meta_features(trades), (F.col("net_return_pct") > 0).cast("double").alias("label")).where("label is not null")
    if rows.count() < META_TRADES:
        return None
    trees = GBTClassifier(maxIter=100, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(META_FEATURES), outputCol="features"), trees]).fit(rows)


def meta_score(signals: DataFrame, model) -> DataFrame:
    """Add meta_score and meta_pass; 0.6 and true without a model."""
    if model is None:
        return signals.withColumns({"meta_score": F.lit(0.6), "meta_pass": F.lit(True)})
    from pyspark.ml.functions import vector_to_array

    own = [c for c in signals.columns if c not in META_FEATURES]
    rows = signals.select(*own, *(F.col(c).alias(f"_{c}") for c in signals.columns if c in META_FEATURES), *meta_features(signals))
    rows = model.transform(rows).withColumn("meta_score", vector_to_array("probability")[1])
    rows = rows.select(*own, *(F.col(f"_{c}").alias(c) for c in signals.columns if c in META_FEATURES), "meta_score")
    return rows.withColumn("meta_pass", F.col("meta_score") >= META_THRESHOLD)
