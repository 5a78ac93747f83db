"""Exact k-means over whole numbers, with bounds from the history of centroids.

Each round assigns every vector to its nearest centroid and moves each centroid to the mean of its vectors, rounded down.
For each vector and centroid the distance at its last evaluation is kept with the round it was taken in. The history of
all centroids is kept too, so a bound is loosened by the norm of the centroid's total displacement since that round,
not by the sum of its moves: a centroid that wanders back costs nothing. While the upper bound of the own centroid stays
below the lower bounds of all others nothing is computed; otherwise the own distance is taken, then those of the
centroids whose bounds still fail, exactly, in whole numbers. Bounds are compared with room for rounding, so ties are
always decided by exact distances; they go to the smaller number.

Vectors travel with their bounds, so a round is one pass without a shuffle: it writes the table of the next round and, in
the same files, each task's sums of the vectors that changed centroid, ``k`` rows at most. These partial sums, the
centroids and their history (k vectors a round) are all that passes the driver. A lost task reads its part of the former
round's table again.

Defined results: vectors that are null, of another length than ``size``, or hold null or non-finite components are left
out; null ids are kept but start no centroid unless too few others are there; rows that share an id, repeated ones too,
are vectors of their own (their order as starting centroids follows their components); with fewer vectors than
``k`` there are fewer centroids; an empty table gives an empty result; other columns are ignored whatever their names.
Components beyond LARGEST after scaling raise an error, as squared distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.arrays import make_room
from edgelake.llm.shared import Tables, bound_batches

#: Squared distances of vectors of up to 2**11 components stay below 2**62.
LARGEST = 1 << 24
#: Room for rounding in bounds, as a share of them.
ROOM = 1e-9
NAMES = ["id", "x", "cluster", "distance", "at", "round", "count", "sums"]


def whole(table: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, x): vectors of ``size`` finite components as whole numbers floor(scale * component)."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where((F.size("vector") == size) & fits)
    return rows.select("id", F.transform("vector", lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")).cast("bigint"))).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of ``seed:id``, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    picked = rows.orderBy(F.asc_nulls_last(key), "x").limit(k).select("x").collect()  # k rows
    return np.array([r["x"] for r in picked], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole rows to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, cluster: np.ndarray, at: np.ndarray, when: np.ndarray, drift: np.ndarray, centroids: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance to it (-1 if bounds held without it); ``at`` and ``when`` take what is evaluated.

    at[i, j]: the squared distance to centroid j in round when[i, j]; drift[r, j]: how far j has moved from round r to now.
    """
    n, k = at.shape
    rows, each = np.arange(n), np.arange(k)
    loose = drift[when, each[None, :]]
    root = np.sqrt(at.astype(np.float64))
    low, high = (root - loose) * (1 - ROOM), (root[rows, cluster] + loose[rows, cluster]) * (1 + ROOM)
    low[rows, cluster] = np.inf
    least = low.min(1) if k > 1 else np.full(n, np.inf)

    own = np.flatnonzero((high >= least - ROOM) & (when[rows, cluster] < now))
    for j in range(k):
        mine = own[cluster[own] == j]
        at[mine, j], when[mine, j] = squared(x[mine], centroids[j]), now
    high[own] = np.sqrt(at[own, cluster[own]].astype(np.float64)) * (1 + ROOM)

    best, value = cluster.copy(), at[rows, cluster]
    exact = when[rows, cluster] == now
    for j in range(k):
        failed = np.flatnonzero((low[:, j] <= high + ROOM) & (cluster != j))
        stale = failed[when[failed, j] < now]
        at[stale, j], when[stale, j] = squared(x[stale], centroids[j]), now
        value_j = at[failed, j]
        nearer = (value_j < value[failed]) | ((value_j == value[failed]) & (j < best[failed]))
        best[failed[nearer]], value[failed[nearer]] = j, value_j[nearer]
    return best, np.where(exact | (best != cluster), value, -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel(), kind))


def a_round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray, now: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their new cluster and bounds; at the end of the task a row for each cluster with the sums that moved."""
    make_room()
    k, size = centroids.shape
    sums, counts, kind = np.zeros((k, size), np.int64), np.zeros(k, np.int64), None
    for batch in batches:
        n, kind = batch.num_rows, batch.column("id").type
        if not n:
            continue
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
        x = flat("x").astype(np.int64).reshape(n, size)
        if now == 0:
            at = np.stack([squared(x, c) for c in centroids], 1)
            when, old = np.zeros((n, k), np.int16), np.full(n, -1)
            cluster = at.argmin(1)  # the first of equals
            distance = at[np.arange(n), cluster]
        else:
            at, when = flat("at").astype(np.int64).reshape(n, k), flat("round").astype(np.int16).reshape(n, k)
            old = batch.column("cluster").to_numpy().astype(np.int64)
            cluster, distance = assign(x, old, at, when, drift, centroids, now)
        if last:
            for j in range(k):
                open_ = np.flatnonzero((distance < 0) & (cluster == j))
                distance[open_] = squared(x[open_], centroids[j])
        change = np.flatnonzero(cluster != old)
        for j in range(k):
            to, gone = change[cluster[change] == j], change[old[change] == j]
            sums[j] += x[to].sum(0) - x[gone].sum(0)
            counts[j] += len(to) - len(gone)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), lists(at, pa.int64()), lists(when, pa.int16()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], NAMES
        )
    if kind is not None:
        void = lambda t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays(
            [void(kind), void(pa.list_(pa.int64())), pa.array(np.arange(k), pa.int32()), void(pa.int64()), void(pa.list_(pa.int64())), void(pa.list_(pa.int16())), pa.array(counts), lists(sums, pa.int64())], NAMES
        )


def moved_sums(table: DataFrame, k: int, size: int) -> tuple[list[list[int]], list[int]]:
    """The change of each cluster's component sums and count."""
    parts = table.where("count is not null")
    sums = parts.select("cluster", F.posexplode("sums").alias("place", "v")).groupBy("cluster", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    total, count = [[0] * size for _ in range(k)], [0] * k
    for r in sums.collect():  # k * size rows
        total[r["cluster"]][r["place"]] = int(r["v"])
    for r in parts.groupBy("cluster").agg(F.sum("count").alias("n")).collect():
        count[r["cluster"]] = int(r["n"])
    return total, count


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: ``id_col``, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 after ``rounds`` moves of the centroids."""
    spark = table.sparkSession
    bound_batches(spark)
    tables = Tables()
    rows = tables.write(whole(table, id_col, vector_col, size, scale), "points")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, x array<long>, cluster int, distance long, at array<long>, round array<smallint>, count long, sums array<long>"
    centroids = first_centroids(rows, k, seed)
    result = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return tables.result(spark.createDataFrame([], result), "clusters")
    k, history, state, written = len(centroids), [centroids], rows, rows
    sums, counts = [[0] * size for _ in range(k)], [0] * k
    for now in range(rounds + 1):
        centroids, last = history[now], now == rounds
        drift = np.sqrt(((np.stack(history).astype(np.float64) - centroids) ** 2).sum(2)) * (1 + ROOM)
        new = tables.write(state.mapInArrow(lambda b, c=centroids, d=drift, n=now, e=last: a_round(b, c, d, n, e), schema), "round")
        tables.drop(written)
        state, written = new.where("count is null"), new
        if not last:
            more, change = moved_sums(new, k, size)
            sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, more, strict=True)]
            counts = [a + b for a, b in zip(counts, change, strict=True)]
            history.append(np.array([[v // n for v in s] if n else c for s, n, c in zip(sums, counts, centroids.tolist(), strict=True)], np.int64))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    inertia = {r[0]: int(r[1]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    out = state.select(F.col("id").alias(id_col), "cluster", "distance", of([inertia.get(j, 0) for j in range(k)]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))
    return tables.result(out, "clusters")
