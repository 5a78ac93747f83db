"""Exact nearest neighbours by a block matrix join over quantised vectors.

Each distinct vector is a node; it is scaled to 8-bit integers, and the norms of the scaled vector and of what rounding
took away are kept. Query nodes are cut into blocks, and candidate nodes into strips: a task takes one block of
queries and reads its strip in tiles as they come, so it holds one block and one tile whatever the strip's length.
The product of two 8-bit tiles is exact; with the norms it bounds the inner product from both sides (Cauchy-Schwarz on
the rounding errors). Pairs whose upper bound falls below the query's least result so far, or below as many lower
bounds of the tile as are asked for, are dropped for good. The others are recomputed in double precision from the original
vectors, component after component, and the best are merged into the query's heap. A strip returns as many nodes a
query as can be asked for and no more, however many vectors lie close together; heaps of all strips are merged at the end.

Copies of a vector are one node with its smallest ids, as many as can be asked for, which are selected in each task
before they are shuffled, then in salted groups. The work is the product of queries and candidates, as an exact search
needs; blocks and strips spread it evenly, and each candidate is copied once for each block of queries.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id
take no part; only vectors of equal length are compared; rows repeated with id and vector count once, and rows that share
an id but not the vector are queries and candidates of their own; equal scores go to smaller ids; fewer candidates than
asked for are all returned; ids are whole numbers; other columns are ignored whatever their names; an empty table gives an
empty result. Distinct vectors are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.arrays import make_room
from edgelake.llm.embedding_dedup import by_length, matrix
from edgelake.llm.near_dedup import sorted_groups
from edgelake.llm.shared import Tables, bound_batches, small

#: Query nodes of a block and about how many blocks there are between these bounds; candidates of a strip at least, and strips at most.
BLOCK, LARGEST_BLOCK, BLOCKS, STRIP, STRIPS = 512, 16_384, 64, 8192, 64
#: Pairs of a tile, components of an exact product in single precision, and pairs that are recomputed at once.
TILE, SLICE, PAIRS = 1 << 21, 1024, 1 << 15
#: Groups that the copies of a vector are dealt to.
SALTS = 64
#: Room for rounding in the bounds, as a share of the product of two norms.
ROOM = 1e-9
ROW = ["node", "size", "least", "vector", "code", "step", "length", "error"]


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add code, step, length and error to (node, size, least, vector): components are code * step, up to a vector of norm ``error``; length is the norm of code * step."""
    make_room()
    for batch in batches:
        for part in by_length(batch):
            x = matrix(part.column("vector"))
            step = np.abs(x).max(1) / 127
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                code = np.where(step[:, None] > 0, np.rint(x / step[:, None]), 0).astype(np.int8)
                back = code * step[:, None]
                norms = [np.sqrt((v * v).sum(1)) for v in (back, x - back)]
            codes = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.py_buffer(np.ascontiguousarray(code))])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "size", "least", "vector")), codes, pa.array(step), *map(pa.array, norms)], ROW)


def codes_of(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32, 1, column.offset * 4)[0]
    return np.frombuffer(data, np.int8, len(column) * size, first).reshape(-1, size)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of 8-bit rows: sums of up to SLICE products are whole numbers that single precision holds."""
    total = a[:, :SLICE].astype(np.float32) @ b[:, :SLICE].astype(np.float32).T
    if a.shape[1] > SLICE:
        total = total.astype(np.float64)
        for at in range(SLICE, a.shape[1], SLICE):
            total += a[:, at : at + SLICE].astype(np.float32) @ b[:, at : at + SLICE].astype(np.float32).T
    return total


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


class Block:
    """The queries of a block and the k best nodes of each so far."""

    def __init__(self, rows: pa.Table, k: int):
        self.k, self.node, self.size = k, rows.column("node").to_numpy(), rows.column("size")[0].as_py()
        self.code, self.vector = codes_of(rows.column("code"), self.size), matrix(rows.column("vector").combine_chunks())
        self.step, self.length, self.error = (rows.column(c).to_numpy() for c in ("step", "length", "error"))
        none = np.zeros(0, np.int64)
        self.best = (none, np.zeros(0), none, none)  # (query's place, score, least id, node), sorted by place, then best first
        self.least = np.full(len(self.node), -np.inf)  # score of the k-th

    def tile(self, rows: pa.RecordBatch) -> None:
        step, length, error = (rows.column(c).to_numpy() for c in ("step", "length", "error"))
        with np.errstate(over="ignore", invalid="ignore"):
            about = products(self.code, codes_of(rows.column("code"), self.size)) * step[None, :] * self.step[:, None]
            off = self.length[:, None] * error[None, :] + self.error[:, None] * (length + error)[None, :]
            off += ROOM * (self.length + self.error)[:, None] * (length + error)[None, :]
            low, high = about - off, about + off
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # beyond double precision no bound is known
        floor = self.least
        if rows.num_rows >= self.k:
            floor = np.maximum(floor, np.partition(low, rows.num_rows - self.k, 1)[:, -self.k])
        q, c = np.nonzero(high >= floor[:, None])
        vector, least, node = matrix(rows.column("vector")), rows.column("least").to_numpy(), rows.column("node").to_numpy()
        for at in range(0, len(q), PAIRS):
            p, r = q[at : at + PAIRS], c[at : at + PAIRS]
            near = high[p, r] >= self.least[p]  # results so far may exclude more
            p, r = p[near], r[near]
            score = in_order(self.vector[p], vector[r])
            p, score, r = (v[score >= self.least[p]] for v in (p, score, r))
            if len(p):
                self.merge(p, score, least[r], node[r])

    def merge(self, *found: np.ndarray) -> None:
        q, score, least, node = (np.concatenate(x) for x in zip(self.best, found, strict=True))
        order = np.lexsort((node, least, -score, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[rank < self.k]
        self.best = tuple(x[order] for x in (q, score, least, node))
        full = rank[rank < self.k] == self.k - 1
        self.least[self.best[0][full]] = self.best[1][full]

    def batch(self) -> pa.RecordBatch:
        q, score, least, node = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.node[q]), pa.array(score), pa.array(least), pa.array(node)], FOUND)


FOUND = ["query", "score", "least", "node"]


def search_strips(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query, score, least, node): the k best of a strip for each query; rows are sorted by (size, i, j, side): queries come first."""
    make_room()
    key, block, waiting = None, None, []
    for rows in batches:
        if not rows.num_rows:
            continue
        columns = [rows.column(c).to_numpy() for c in ("size", "i", "j", "side")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
        for at, to in itertools.pairwise([0, *change.tolist(), rows.num_rows]):
            here, part = tuple(int(c[at]) for c in columns[:3]), rows.slice(at, to - at)
            if here != key:
                if block:
                    yield block.batch()
                key, block, waiting = here, None, []
            if columns[3][at] == 0:
                waiting.append(part)
            elif waiting:  # else no query was dealt to this block
                block = block or Block(pa.Table.from_batches(waiting).combine_chunks(), k)
                width = max(64, TILE // len(block.node))
                for first in range(0, part.num_rows, width):
                    block.tile(part.slice(first, width))
    if block:
        yield block.batch()


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query, score, node): of the rows of all strips, sorted by query, the k first of a heap by score and least id."""
    for part in sorted_groups(batches, ["query"]):
        score, least, node = (part.column(c).to_numpy() for c in FOUND[1:])
        best = heapq.nsmallest(k, zip((-score).tolist(), least.tolist(), node.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([part.column("query").slice(0, len(best)).combine_chunks(), pa.array([-s for s, _, _ in best]), pa.array([n for _, _, n in best])], ["query", "score", "node"])


def nodes_of(rows: DataFrame, most: int) -> DataFrame:
    """(node, vector, ids): each distinct vector and its ``most`` smallest ids, ascending. Only ids are dealt to salted groups."""
    salted = rows.select("id", "node").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_n") <= most).drop("_n")  # noqa: E731  limited in each task first
    ids = first(first(salted, "node", "salt"), "node").groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.groupBy("node").agg(F.first("vector").alias("vector")).join(ids, "node")


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, ``id_col``, score): the ``k`` rows with the largest inner product for each row whose id is divisible by ``every``."""
    bound_batches(table.sparkSession)
    tables = Tables()
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = tables.write(rows.where(finite & F.exists("vector", lambda v: v != 0)).withColumn("node", F.xxhash64("vector")), "rows")
    queries = tables.write(rows.where(F.col("id") % every == 0).select("id", "node").distinct(), "queries")
    nodes = tables.write(nodes_of(rows, k + 1), "nodes")

    vectors = nodes.select("node", F.size("vector").alias("size"), F.col("ids")[0].alias("least"), "vector")
    own_kind = table.schema[vector_col].dataType.simpleString()
    codes = vectors.mapInArrow(quantised, f"node long, size int, least long, vector {own_kind}, code binary, step double, length double, error double")
    codes = tables.write(codes, "codes")
    wanted = tables.write(codes.join(queries.select("node").distinct(), "node", "left_semi"), "wanted")
    # a row for each length of vectors
    n = F.count("*")
    strips = F.least(F.lit(STRIPS), F.ceil(n / STRIP)).cast("int").alias("strips")
    blocks = F.ceil(n / F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.ceil(n / BLOCKS)))).cast("int").alias("blocks")
    shape = small(tables.write(codes.groupBy("size").agg(strips).join(wanted.groupBy("size").agg(blocks), "size"), "shape"))
    own = lambda c: F.pmod(F.xxhash64("node", F.lit("block")), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    names = ["i", "j", "side", *ROW]
    left = wanted.join(shape, "size").withColumns({"i": own("blocks"), "side": F.lit(0)}).withColumn("j", each("strips"))
    right = codes.join(shape, "size").withColumns({"j": own("strips"), "side": F.lit(1)}).withColumn("i", each("blocks"))
    tiles = left.select(*names).union(right.select(*names)).repartition("size", "i", "j").sortWithinPartitions("size", "i", "j", "side")
    found = tables.write(tiles.mapInArrow(lambda b: search_strips(b, k + 1), "query long, score double, least long, node long"), "strips")

    best = found.repartition("query").sortWithinPartitions("query").mapInArrow(lambda b: merged(b, k + 1), "query long, score double, node long")
    entries = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id"), F.col("node").alias("node")))
    best = best.join(nodes.select("node", "ids"), "node").select("query", entries.alias("near")).groupBy("query").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = best.select(F.col("query").alias("node"), F.slice(F.array_sort("near"), 1, k + 1).alias("near"))
    out = queries.join(best, "node").select("id", F.slice(F.expr("filter(near, p -> p.id <> id or p.node <> node)"), 1, k).alias("near"))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "p"))
    return tables.result(out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.id").alias(id_col), (-F.col("p.minus")).alias("score")), "nearest")
