"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

Vectors are compared only within a label, by angle. Equal vectors of a label are one node. First, nodes that lie within
the limit of another one join its ball: leaves of a random hyperplane tree, cut into blocks, pick leaders, and leaders
merge in later trees, so that a group of copies of any size is soon a few balls. Each ball is a node of the neighbour
graph, with its farthest member's angle as radius. The graph starts from the leaves of more trees and is refined by
NN-descent: the neighbours of each ball, in either direction, are compared with each other. Neighbours rank by angle
less their radius. A list whose last entry may still hold a link is saturated: it is enlarged to GROW times its length, and
descent goes on until no list is saturated. What the lists keep are the pairs of balls that may hold links.

Links are then counted in double precision. Members within half the limit of their ball's leader are linked with each
other by the triangle inequality and need no comparison, so a tight group costs no more than its size. The others are
compared in blocks with the members of their ball, and those near enough to the leader of an adjacent ball with its members.
Every vector whose id is divisible by ``audit_every`` is compared with all vectors of its label, in blocks; while fewer
links than RECALL of those are found, trees and rounds are added; below LEAST_RECALL an error is raised.

Defined results: vectors that are null, zero or hold null or non-finite components, and those with a null label, link
with nothing and are their own component; vectors of different lengths never link; repeated rows count as vectors of
their own; null ids are counted as partners but never name a component unless it has no other; other columns are
ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.arrays import make_room
from edgelake.llm.near_dedup import sorted_groups
from edgelake.llm.shared import Tables, bound_batches, connected_components, small

#: Neighbours in a list to begin with, how much a saturated list grows, trees, vectors of a leaf about, and rows of a block.
K, GROW, TREES, LEAF, BLOCK = 8, 4, 12, 192, 512
#: Rounds that merge balls, and rounds of NN-descent before lists are looked at; the share of changes that ends either.
COVER_ROUNDS, ROUNDS, CHANGED = 5, 3, 0.002
#: Recall of links asked for in the audit, the least that is accepted, and how often trees are added for it.
RECALL, LEAST_RECALL, AUDIT_ROUNDS = 0.995, 0.9, 2
#: Room for rounding: of angles in single precision (graph), and in double precision (certain links).
ROUGH, FINE = 2e-3, 1e-6


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """The rows of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to length 1 by their largest component first, so that no square overflows or vanishes; null if they can't be, or have no label."""
    make_room()
    for batch in batches:
        lists = batch.column("vector")
        length = np.where(batch.column("label").is_null().to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        some = np.flatnonzero(length)
        lists = lists.take(pa.array(some))
        flat, length = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64), length[some]
        first = np.cumsum(length) - length
        most = np.maximum.reduceat(np.abs(flat), first) if len(some) else np.zeros(0)  # not finite if a component isn't
        good = np.isfinite(most) & (most > 0)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            flat = flat / np.repeat(most, length)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, first)) if len(some) else most, length)
        keep = np.repeat(good, length)
        bounds = np.zeros(batch.num_rows + 1, np.int32)
        bounds[some + 1] = np.where(good, length, 0)
        none = np.ones(batch.num_rows, bool)
        none[some[good]] = False
        vector = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds, dtype=np.int32)), pa.array(flat[keep]), mask=pa.array(none))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vector], ["id", "label", "vector"])


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def by_length(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Rows of equally long vectors together."""
    size = batch.column("size").to_numpy()
    if not len(size):
        return []
    return [batch] if (size == size[0]).all() else [batch.filter(pa.array(size == s)) for s in np.unique(size)]


def planes(seed: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((bits, size)).astype(np.float32)


def shapes_of(rows: DataFrame, tables: Tables) -> DataFrame:
    """One row (label, size, depth, centre) for each label and length of vectors: planes a tree needs, and the mean vector."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch):
                x, label = matrix(part.column("vector")), part.column("label")
                codes = label.dictionary_encode()
                at = codes.indices.to_numpy()
                total = np.zeros((len(codes.dictionary), x.shape[1]))
                np.add.at(total, at, x)
                bounds = pa.array(np.arange(len(total) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [codes.dictionary, pa.array([x.shape[1]] * len(total), pa.int32()), pa.array(np.bincount(at, minlength=len(total))), pa.ListArray.from_arrays(bounds, pa.array(total.ravel()))],
                    ["label", "size", "n", "total"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    parts = tables.write(rows.select("label", "size", "vector").mapInArrow(sums, f"label {kind}, size int, n long, total array<double>"), "sums")
    n = parts.groupBy("label", "size").agg(F.sum("n").alias("n"))
    means = parts.select("label", "size", F.posexplode("total")).groupBy("label", "size", "pos").agg(F.sum("col").alias("col"))
    means = means.groupBy("label", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda c: c["col"]).alias("total"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int").alias("depth")
    return tables.write(means.join(n, ["label", "size"]).select("label", "size", depth, F.transform("total", lambda c: (c / F.col("n")).cast("float")).alias("centre")), "shapes")


def leaf_rows(rows: DataFrame, trees: range, tables: Tables) -> DataFrame:
    """Rows (node, label, size, radius, vector) with tree, leaf and block: leaves that planes can't split are cut into blocks at random."""
    names = ["node", "label", "size", "radius", "vector"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch):
                x = matrix(part.column("vector"), np.float32) - matrix(part.column("centre"), np.float32)
                depth = part.column("depth").to_numpy()
                most = int(depth.max())
                codes = np.zeros((len(x), len(trees)), np.int64)
                for t, tree in enumerate(trees):
                    side = (x @ planes(tree * 1000 + x.shape[1], most, x.shape[1]).T > 0) & (np.arange(most)[None, :] < depth[:, None])
                    codes[:, t] = (side.astype(np.int64) << np.arange(most)[None, :]).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(trees), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "codes"])

    shapes = small(shapes_of(rows, tables))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    coded = tables.write(rows.select(*names).join(shapes, ["label", "size"]).mapInArrow(code, f"{schema}, codes array<long>"), "codes")
    keys = ["label", "size", "tree", "leaf"]
    coded = coded.select(*names, F.posexplode("codes").alias("at", "leaf")).withColumn("tree", F.col("at") + trees.start).drop("at")
    large = tables.write(coded.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 4 * LEAF), "leaves")
    blocks = F.coalesce(F.ceil(F.col("rows") / (2 * LEAF)), F.lit(1))
    return coded.join(small(large), keys, "left").withColumn("block", F.pmod(F.xxhash64("node", "tree"), blocks).cast("int")).drop("rows")


def leaders(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """(ball, into): in each block, the balls whose leader lies within the limit of an earlier leader, and the nearest such one."""
    for part in sorted_groups(batches, ["label", "size", "tree", "leaf", "block"]):
        x, node = matrix(part.column("vector").chunk(0), np.float32), part.column("node").to_numpy()
        near = x @ x.T >= np.cos(limit)
        free = near.sum(1) > 1
        chosen = []
        for i in np.flatnonzero(free).tolist():
            if free[i]:
                chosen.append(i)
                free &= ~near[i]
        if chosen:
            cosine = x @ x[chosen].T
            nearest = cosine.argmax(1)
            moved = cosine[np.arange(len(x)), nearest] >= np.cos(limit)
            moved[chosen] = False
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[np.array(chosen)[nearest[moved]]])], ["ball", "into"])


def cover(nodes: DataFrame, limit: float, tables: Tables) -> DataFrame:
    """(node, ball, angle): the ball of every node, named by its leader, and the angle to that leader, at most ``limit``."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a member that the other leader doesn't reach is a leader itself again
        for batch in batches:
            for part in by_length(batch):
                node, into = part.column("node").to_numpy(), part.column("into").to_numpy()
                angle = angles(np.einsum("ij,ij->i", matrix(part.column("vector")), matrix(part.column("other"))))
                ok = angle <= limit - FINE
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.where(ok, into, node)), pa.array(np.where(ok, angle, 0.0))], ["node", "ball", "angle"])

    balls = nodes.select("node", F.col("node").alias("ball"), F.lit(0.0).alias("angle"))
    single = nodes.withColumn("radius", F.lit(0.0).cast("float"))
    reps = single
    for round_ in range(COVER_ROUNDS):
        rows = leaf_rows(reps, range(1000 + round_, 1001 + round_), tables)
        keys = ["label", "size", "tree", "leaf", "block"]
        found = rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda b: leaders(b, limit), "ball long, into long")
        moves = tables.write(found, "moves")
        if moves.isEmpty():
            break
        by_name = small(moves)
        leader = nodes.select(F.col("node").alias("into"), F.col("vector").alias("other"))
        moved = balls.join(by_name, "ball").select("node", "into").join(nodes.select("node", "size", "vector"), "node").join(leader, "into").select("node", "into", "size", "vector", "other")
        balls = tables.write(balls.join(by_name, "ball", "left_anti").select("node", "ball", "angle").union(moved.mapInArrow(reached, "node long, ball long, angle double")), "balls")
        reps = single.join(balls.select(F.col("ball").alias("node")).distinct(), "node")
        if moves.count() <= CHANGED * reps.count():
            break
    return balls


EDGES = "node long, neighbour long, slack float"


def nearest(part: pa.Table, name: str, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, slack) of a group: the k nearest of each row, by angle less the neighbour's radius."""
    x, node, radius = matrix(part.column("vector").chunk(0), np.float32), part.column(name).to_numpy(), part.column("radius").to_numpy()
    slack = angles(x @ x.T) - radius[None, :]
    slack[node[:, None] == node[None, :]] = 9
    most = min(int(k.max()), len(node))
    at = np.argpartition(slack, most - 1, 1)[:, :most]
    value = np.take_along_axis(slack, at, 1)
    if most > K:
        order = np.argsort(value, 1)
        at, value = np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)
    keep = (value < 8) & ((np.arange(most)[None, :] < k[:, None]) if most > K else True)
    return np.repeat(node, most).reshape(-1, most)[keep], node[at][keep], value[keep].astype(np.float32)


def edge_batches(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for edges in found:
        held.append(edges)
        n += len(edges[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["node", "neighbour", "slack"])
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["node", "neighbour", "slack"])


def best(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """Each node's nearest of the edges found: K, or as many as ``lists`` (node, k) says. One shuffle; sorts may spill."""
    order = Window.partitionBy("node").orderBy("slack", "neighbour")
    rows = edges.repartition("node").groupBy("node", "neighbour").agg(F.min("slack").alias("slack")).withColumn("rank", F.row_number().over(order))
    return rows.join(small(lists), "node", "left").where(F.col("rank") <= F.coalesce("k", F.lit(K))).select("node", "neighbour", "slack")


def leaf_edges(reps: DataFrame, trees: range, tables: Tables) -> DataFrame:
    """Edges between balls of the same leaf of a tree, at most K of each ball, tree and block."""
    keys = ["label", "size", "tree", "leaf", "block"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return edge_batches(nearest(part, "node", np.full(part.num_rows, K)) for part in sorted_groups(batches, keys))

    return leaf_rows(reps, trees, tables).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(match, EDGES)


def descend(graph: DataFrame, reps: DataFrame, lists: DataFrame, salt: int, tables: Tables) -> DataFrame:
    """One round: the neighbours of each ball, in either direction, are compared with each other and with it."""
    both = graph.select("node", "neighbour").union(graph.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))).distinct()
    # a ball with very many neighbours meets them in parts of about 4 K, which differ from round to round
    wide = tables.write(both.groupBy("node").agg(F.ceil(F.count("*") / (4 * K)).cast("int").alias("parts")).where("parts > 1"), "wide")
    met = both.join(small(wide), "node", "left").withColumn("part", F.pmod(F.xxhash64("neighbour", F.lit(salt)), F.coalesce("parts", F.lit(1))).cast("int")).select("node", "part", "neighbour")
    met = met.union(met.select("node", "part", F.col("node").alias("neighbour"))).distinct()
    lengths = lists.select(F.col("node").alias("neighbour"), "k")
    met = met.join(reps.select(F.col("node").alias("neighbour"), "radius", "vector"), "neighbour").join(small(lengths), "neighbour", "left").withColumn("k", F.coalesce("k", F.lit(K)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return edge_batches(nearest(part, "neighbour", part.column("k").to_numpy()) for part in sorted_groups(batches, ["node", "part"]) if part.num_rows > 1)

    return met.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(work, EDGES)


def enlarged(graph: DataFrame, reps: DataFrame, lists: DataFrame, limit: float) -> DataFrame:
    """(node, k): the saturated lists, whose last entry may still hold a link, GROW times as long."""
    last = graph.groupBy("node").agg(F.count("*").alias("n"), F.max("slack").alias("last")).join(reps.select("node", "radius"), "node")
    last = last.join(small(lists), "node", "left").withColumn("k", F.coalesce("k", F.lit(K)))
    return last.where((F.col("n") >= F.col("k")) & (F.col("last") <= limit + ROUGH + F.col("radius"))).select("node", (GROW * F.col("k")).cast("int").alias("k"))


def adjacent(reps: DataFrame, graph: DataFrame | None, trees: range, limit: float, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph after NN-descent, and the pairs (a, b) of balls that may hold links."""
    lists = tables.write(reps.select("node", F.lit(K).alias("k")).where("false"), "lists")
    edges = leaf_edges(reps, trees, tables)
    graph = tables.write(best(edges if graph is None else graph.union(edges), lists), "graph")
    n, salt = reps.count(), 0
    while True:
        for _ in range(ROUNDS):
            salt += 1
            new = tables.write(best(graph.union(descend(graph, reps, lists, salt, tables)), lists), "graph")
            changed = new.join(graph, ["node", "neighbour"], "left_anti").count()
            tables.drop(graph)
            graph = new
            if changed <= CHANGED * K * n:
                break
        full = tables.write(enlarged(graph, reps, lists, limit), "full")
        if full.isEmpty():
            break
        lists = tables.write(lists.join(full, "node", "left_anti").union(full), "lists")
    a, b = reps.select("node", "radius"), reps.select(F.col("node").alias("neighbour"))
    close = graph.join(a, "node").join(b, "neighbour").where(F.col("slack") <= limit + ROUGH + F.col("radius"))
    return graph, tables.write(close.select(F.least("node", "neighbour").alias("a"), F.greatest("node", "neighbour").alias("b")).distinct(), "adjacent")


def count_links(members: DataFrame, balls: DataFrame, pairs: DataFrame, threshold: float, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(node, links) counted by comparison, and (a, b): balls that a link joins.

    members: (node, ball, angle, weight, vector); balls: (ball, radius, cores, shells, vector of the leader). A ball is
    cut into blocks, cores (members within half the limit) apart from shells; a pair of blocks is a group of its own,
    but for two blocks of cores of one ball, whose members are all linked.
    """
    limit = float(np.arccos(threshold))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    shape = tables.write(balls.select("ball", "radius", blocks("cores").alias("cb"), (blocks("cores") + blocks("shells")).alias("nb"), "vector"), "shape")
    inner = small(tables.write(shape.where("nb > cb").select("ball", "cb", "nb"), "inner"))
    here = F.col("angle") <= limit / 2 - FINE
    at = lambda low, n: (low + F.pmod(F.xxhash64("node", F.lit("block")), n)).cast("int")
    rows = members.join(inner, "ball")
    rows = rows.withColumn("u", F.when(here, at(F.lit(0), F.col("cb"))).otherwise(at(F.col("cb"), F.col("nb") - F.col("cb"))))
    rows = rows.withColumn("v", F.explode(F.sequence(F.when(here, F.col("cb")).otherwise(F.lit(0)), F.col("nb") - 1)))
    i, j = F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")
    rows = rows.select(F.col("ball").alias("a"), F.col("ball").alias("b"), i, j, F.when(F.col("u") == F.col("v"), 2).when(F.col("u") < F.col("v"), 0).otherwise(1).alias("side"), "node", "weight", "vector")

    # members of adjacent balls: only those that the other ball's radius may reach
    end = lambda own, other: pairs.select(F.col(own).alias("ball"), F.col(other).alias("other"), F.lit(own == "b").alias("second"))
    far = shape.select(F.col("ball").alias("other"), F.col("radius").alias("far"), F.col("nb").alias("other_blocks"), F.col("vector").alias("leader"))
    ends = tables.write(end("a", "b").union(end("b", "a")).join(shape.select("ball", F.col("nb").alias("own_blocks")), "ball").join(far, "other"), "ends")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch):
                angle = angles(np.einsum("ij,ij->i", matrix(part.column("vector")), matrix(part.column("leader"))))
                ok = pa.array(angle <= limit + part.column("far").to_numpy() + FINE)
                names = ["ball", "other", "second", "own_blocks", "other_blocks", "node", "weight", "vector"]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(ok) for c in names], names)

    cross = members.withColumn("size", F.size("vector")).join(small(ends), "ball")
    cross = cross.mapInArrow(reached, "ball long, other long, second boolean, own_blocks int, other_blocks int, node long, weight long, vector array<double>")
    cross = cross.withColumn("u", at(F.lit(0), F.col("own_blocks"))).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    flip = F.col("second")
    cross = cross.select(
        F.when(flip, F.col("other")).otherwise(F.col("ball")).alias("a"), F.when(flip, F.col("ball")).otherwise(F.col("other")).alias("b"),
        F.when(flip, F.col("v")).otherwise(F.col("u")).alias("i"), F.when(flip, F.col("u")).otherwise(F.col("v")).alias("j"), F.col("second").cast("int").alias("side"), "node", "weight", "vector",
    )
    keys = ["a", "b", "i", "j"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, joined = [], []

        def batch_of() -> pa.RecordBatch:
            node, links = (np.concatenate(c) for c in zip(*counted, strict=True)) if counted else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n, m = len(node), len(joined)
            none = lambda size: pa.nulls(size, pa.int64())
            ends = np.array(joined, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(node), none(m)]), pa.concat_arrays([pa.array(links), none(m)]), pa.concat_arrays([none(n), pa.array(ends[:, 0])]), pa.concat_arrays([none(n), pa.array(ends[:, 1])])],
                ["node", "links", "a", "b"],
            )

        for part in sorted_groups(batches, keys):
            x, node, weight, side = matrix(part.column("vector").chunk(0)), *(part.column(c).to_numpy() for c in ("node", "weight", "side"))
            if side[0] == 2:
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                counted.append((node, hit @ weight))
            else:
                p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                hit = x[p] @ x[q].T >= threshold
                if hit.any():
                    counted += [(node[p], hit @ weight[q]), (node[q], hit.T @ weight[p])]
                    a, b = part.column("a")[0].as_py(), part.column("b")[0].as_py()
                    if a != b:
                        joined.append((a, b))
            if len(counted) > 500:
                yield batch_of()
                counted, joined = [], []
        if counted:
            yield batch_of()

    made = tables.write(rows.union(cross).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "node long, links long, a long, b long"), "counted")
    counts = made.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    return counts, made.where("node is null").select("a", "b").distinct()


def audit(nodes: DataFrame, found: DataFrame, threshold: float, tables: Tables) -> float:
    """Share of the links of the nodes that are asked for (``asked``), against all of their label, that ``found`` (node, links) has."""
    keys = ["label", "size"]
    ask = F.col("asked")
    shape = nodes.groupBy(*keys).agg(F.ceil(F.count_if(ask) / BLOCK).cast("int").alias("qb"), F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("rb")).where("qb > 0")
    rows = nodes.join(small(tables.write(shape, "asked")), keys)
    names = [*keys, "i", "j", "query", "node", "weight", "vector"]
    part = lambda n: F.pmod(F.xxhash64("node", F.lit("audit")), F.col(n)).cast("int")
    queries = rows.where(ask).withColumns({"i": part("qb"), "j": F.explode(F.sequence(F.lit(0), F.col("rb") - 1)), "query": F.lit(True)}).select(*names)
    others = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("qb") - 1)), "j": part("rb"), "query": F.lit(False)}).select(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, [*keys, "i", "j"]):
            x, node, weight, query = matrix(group.column("vector").chunk(0)), *(group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "query"))
            y, other, w = x[~query], node[~query], weight[~query]
            hit = (x[query] @ y.T >= threshold) & (node[query][:, None] != other[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(node[query]), pa.array(hit @ w)], ["node", "all_links"])

    by = [*keys, "i", "j"]
    true = queries.union(others).repartition(*by).sortWithinPartitions(*by).mapInArrow(work, "node long, all_links long").groupBy("node").agg(F.sum("all_links").alias("all_links"))
    links, hit = true.where("all_links > 0").join(found, "node", "left").agg(F.sum("all_links"), F.sum(F.least("all_links", F.coalesce("links", F.lit(0))))).first()
    return hit / links if links else 1.0


def components(
    table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", audit_every: int = 50
) -> DataFrame:
    """Per row: ``id_col``, n_links (other vectors linked directly), component_id (smallest reachable id) and kept."""
    bound_batches(table.sparkSession)
    tables, limit = Tables(), float(np.arccos(threshold))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(unit_rows, schema).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    rows = tables.write(rows, "rows")
    asked = F.max(F.coalesce(F.expr("try_cast(id as bigint)") % audit_every == 0, F.lit(False)))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("id").alias("least"), asked.alias("asked"))
    nodes = tables.write(nodes.select("node", "label", F.size("vector").alias("size"), "vector", "weight", "least", "asked"), "nodes")

    balls = cover(nodes, limit, tables)
    members = tables.write(balls.join(nodes.select("node", "weight", "vector"), "node").select("node", "ball", "angle", "weight", "vector"), "members")
    core = F.col("angle") <= limit / 2 - FINE
    shape = members.groupBy("ball").agg(F.max("angle").alias("radius"), F.count_if(core).alias("cores"), F.count_if(~core).alias("shells"), F.sum(F.when(core, F.col("weight"))).alias("core_weight"))
    leader = nodes.select(F.col("node").alias("ball"), "label", "size", "vector")
    shape = tables.write(shape.join(leader, "ball"), "shape")
    reps = tables.write(shape.select(F.col("ball").alias("node"), "label", "size", F.col("radius").cast("float").alias("radius"), F.transform("vector", lambda x: x.cast("float")).alias("vector")), "reps")
    inside = members.join(shape.select("ball", "core_weight"), "ball").select("node", "weight", (F.when(core, F.col("core_weight")).otherwise(F.col("weight")) - 1).alias("own"))

    graph, first, more = None, 0, TREES
    for attempt in range(1 + AUDIT_ROUNDS):
        graph, pairs = adjacent(reps, graph, range(first, first + more), limit, tables)
        counts, joined = count_links(members, shape, pairs, threshold, tables)
        found = tables.write(inside.join(counts, "node", "left").select("node", (F.col("own") + F.coalesce("links", F.lit(0))).alias("links"), "weight"), "found")
        recall = audit(nodes, found.select("node", (F.col("links") - F.col("weight") + 1).alias("links")), threshold, tables)
        logging.getLogger(__name__).info("recall of links %.4f, attempt %d", recall, attempt)
        if recall >= RECALL:
            break
        first, more = first + more, 2 * more
    if recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the links of the audited vectors were found")

    parts = connected_components(joined, tables)
    named = balls.join(parts.select(F.col("node").alias("ball"), "component"), "ball", "left").select("node", F.coalesce("component", "ball").alias("component"))
    named = tables.write(named.join(nodes.select("node", "least"), "node"), "named")
    least = tables.write(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_node = named.join(small(least), "component").join(found, "node").select("node", "component_id", F.col("links").alias("n_links"))
    out = rows.select("id", "node").join(tables.write(by_node, "by_node"), "node", "left")
    lone = F.col("node").isNull()
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return tables.result(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())).withColumnRenamed("id", id_col), "vectors")
