"""Near-duplicate documents by SetSketch registers, with links confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles. Every shingle emits points of a Poisson process over REGISTERS
registers, and a register keeps the smallest value, truncated, as a power of BASE: sketches of parts merge by maxima,
and equal registers tell of similar sets. Bands of registers give candidates: within a band's bucket every set is paired
with one hub, never with all others. The joint likelihood of a pair's registers, given both set sizes, drops pairs
whose similarity is most likely far below the limit; the rest are compared as full sets. Buckets that then still hold
more than one component get another hub, drawn at random from their largest one, for all sets outside it, ROUNDS times: work in
proportion to their sets. What is left outside the largest component of a bucket is compared with it and with each other in blocks,
so that no link is lost to the choice of hubs; members of the largest component are never compared with each other. Where more than a block
of sets is left and SCATTERED times the largest component, as of texts made from one template, a bucket is parted first: sets can only be linked if they share one
of their rarest shingles, so many that the others are too few for a link, and those that do are a smaller bucket each. Two
sets with a similarity of 0.85 share no bucket with probability below 1e-7 (0.8: 1e-5), and the likelihood drops such
a pair with probability below 1e-5 (0.8: 1e-4).

Sets are classes of equal shingles, named by a 64-bit hash; copies are one class and are never paired. Only narrow
class rows, candidate pairs and the sets of candidates move.

Defined results: texts that are null, empty or without a word have an empty set, are linked with nothing and are
their own component; fewer than five words are one shingle; each of repeated rows gets the result of its text; null
ids join components but never name them unless a component has no other (then it is null and the row is kept); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.arrays import chunks, gather, hash_spans, lower, make_room, mix, word_spans
from edgelake.llm.shared import Tables, bound_batches, connected_components, small

WORDS = 5
REGISTERS, BAND = 96, 4
BASE = 1.001
#: ln of the largest value that a register holds; with 16 bits it reaches down by 65 nats.
TOP = 10.0
#: Pairs are dropped if their likelihood falls from so far below the limit on.
MARGIN = 0.17
#: Further hubs of buckets with several components, and members of a bucket that are compared with as many others at once.
ROUNDS, BLOCK = 2, 256
#: Unlinked sets of a bucket for each of its largest component from which on it is parted; a pair may meet in several parts, but in one bucket only.
SCATTERED = 8
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles end to end, and n + 1 offsets by text."""
    raw = lower(raw)
    starts, ends, bounds = word_spans(raw, off)
    words = hash_spans(raw, starts, ends)
    n = np.diff(bounds)
    size = np.where(n >= WORDS, n - (WORDS - 1), np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), size)
    first = np.cumsum(size) - size
    at = bounds[:-1][doc] + np.arange(len(doc)) - first[doc]
    short = (n < WORDS)[doc]
    total = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        part = padded[at + k]
        if short.any():
            part = np.where(short & (k >= n[doc]), np.uint64(0), part)
        total = (total + part) * STEP
    shingles = mix(total + np.minimum(n, WORDS).astype(np.uint64)[doc])
    new = ~pd.Series(shingles ^ mix(doc.astype(np.uint64) + np.uint64(1))).duplicated().to_numpy()
    return shingles[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def set_names(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, whatever the order of its shingles."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(shingles ^ STEP))])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) + np.diff(bounds).astype(np.uint64) * STEP)


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) of unsigned 16-bit registers."""
    n = np.diff(bounds)
    low = np.full(len(n) * REGISTERS, np.inf)
    doc = np.repeat(np.arange(len(n)), n)
    # nearly every register gets a point below this value; one that gets none is 0
    most = (np.log(REGISTERS) + 5) / np.maximum(n, 1)
    state, value, limit = shingles, np.zeros(len(shingles)), most[doc]
    while len(state):
        state = mix(state + STEP)
        value = value - np.log(((state >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / REGISTERS
        keep = value < limit
        state, value, limit, doc = state[keep], value[keep], limit[keep], doc[keep]
        register = ((mix(state ^ STEP) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        np.minimum.at(low, doc * REGISTERS + register.astype(np.int64), value)
    filled = np.isfinite(low)
    power = np.zeros(len(low))
    power[filled] = np.clip(np.floor(1 + (TOP - np.log(low[filled])) / np.log(BASE)), 1, 65535)
    return power.astype("<u2").reshape(len(n), REGISTERS)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, node, n, registers) of every row; key is a hash of the text, node names the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for rows, raw, off in chunks(batches):
            shingles, bounds = shingle_hashes(raw, off)
            found = registers(shingles, bounds)
            column = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(np.arange(len(found) + 1, dtype=np.int32) * (2 * REGISTERS)), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(set_names(shingles, bounds).view(np.int64)), pa.array(np.diff(bounds)), column],
                ["id", "key", "node", "n", "registers"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return rows.mapInArrow(work, f"id {kind}, key long, node long, n long, registers binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the classes ``wanted`` (node, id, key): their texts are read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for rows, raw, off in chunks(batches, text=0):
            shingles, bounds = shingle_hashes(raw, off)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_names(shingles, bounds).view(np.int64)), lists], ["node", "shingles"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    other = small(wanted.select("key", F.col("id").alias("_id")))
    rows = rows.join(other, (rows["key"] == other["key"]) & rows["id"].eqNullSafe(other["_id"]), "left_semi").select("text")
    return rows.mapInArrow(work, "node long, shingles array<long>")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, floor: float) -> np.ndarray:
    """Whether the joint likelihood of two rows of registers still rises at a similarity of ``floor``."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    u = na / (na + nb)
    v = 1 - u
    c, ln = (BASE - 1) / BASE, np.log(BASE)
    x, y = u - v * floor, v - u * floor
    ok = (x > 0) & (y > 0)
    x, y = np.where(ok, x, 0.1), np.where(ok, y, 0.1)
    p, q = -np.log1p(-c * x) / ln, -np.log1p(-c * y) / ln
    dp, dq = c / ln / (1 - c * x), c / ln / (1 - c * y)
    slope = same * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) - more * v * dp / p - less * u * dq / q
    return ok & (slope >= 0)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def likely_pairs(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) of nodes that the likelihood leaves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k) for k in batch.schema.names}
            ok = likely(matrix(c["ra"]), matrix(c["rb"]), c["na"].to_numpy(), c["nb"].to_numpy(), floor)
            yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(ok)), c["b"].filter(pa.array(ok))], ["a", "b"])

    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, tables: Tables) -> DataFrame:
    """Written pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = tables.write(classes.join(nodes, "node", "left_semi").select("node", "id", "key"), "wanted")
    sets = tables.write(full_sets(docs, wanted, id_col, text_col), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    out = tables.write(both.select("a", "b", shared.alias("shared"), total.alias("total")).where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b").distinct(), "links")
    tables.drop(wanted, sets)
    return out


def bands_of(classes: DataFrame) -> DataFrame:
    """(node, band, key): a row for each band of each class."""
    keys = F.array(*(F.xxhash64(F.substring("registers", i * 2 * BAND + 1, 2 * BAND), F.lit(i)) for i in range(REGISTERS // BAND)))
    return classes.select("node", F.posexplode(keys).alias("band", "key"))


def mixed_buckets(open_: DataFrame, labels: DataFrame, salt: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Members (key, band, node, label) of buckets with several components; and of each such bucket its largest component
    (main), the sets in it (inside) and outside, and a random set of it (hub)."""
    members = open_.join(labels, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("label"))
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key", F.lit(salt)).alias("h"), "node")).alias("hub"))
    buckets = by_label.groupBy("key").agg(F.max(F.struct("n", "label", "hub")).alias("m"), F.sum("n").alias("size"), F.count("*").alias("labels")).where("labels > 1")
    main = buckets.select("key", F.col("m.label").alias("main"), F.col("m.n").alias("inside"), (F.col("size") - F.col("m.n")).alias("outside"), F.col("m.hub.node").alias("hub"))
    main = tables.write(main, "mixed")
    return members.join(main.select("key"), "key", "left_semi"), main


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of buckets (key, first, inside, outside, label, node, …), dealt so that each pair of blocks is one group (key, i, j).

    Blocks of members that are ``first`` (outside) come first and meet all blocks; those of the others (inside) don't meet each other.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    out, total = blocks("outside"), blocks("outside") + blocks("inside")
    own = F.when(F.col("first"), F.pmod(F.xxhash64("node", F.lit("block")), out)).otherwise(out + F.pmod(F.xxhash64("node", F.lit("block")), blocks("inside"))).cast("int")
    rows = members.withColumn("block", own)
    other = F.sequence(F.lit(0), F.when(F.col("block") < out, total).otherwise(out) - 1)
    rows = rows.withColumn("_k", F.explode(other)).withColumns({"i": F.least("_k", "block"), "j": F.greatest("_k", "block")}).drop("_k", "first", "inside", "outside")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def block_pairs(part: pa.Table, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): likely pairs across components of a group, each in the first band only that the two share."""
    label, n, side = (part.column(k).to_numpy() for k in ("label", "n", "block"))
    r = matrix(part.column("registers"))
    bands = r.view("<u8")  # of a parted bucket none counts
    i, j, band = (part.column(k)[0].as_py() for k in ("i", "j", "band"))
    rows, columns = np.flatnonzero(side == i), np.flatnonzero(side == j)  # block j may be empty
    for a in rows:
        b = columns[(label[columns] != label[a]) & ((i != j) | (columns > a))]
        if len(b):
            b = b[(bands[b] == bands[a]).argmax(1) == band] if band >= 0 else b
            b = b[likely(r[[a]], r[b], n[a], n[b], floor)]
            if len(b):
                yield int(a), b


def parted(members: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, tables: Tables) -> DataFrame:
    """Members (key, band, node, label, first, inside, outside) of buckets by rare shingles, in place of large buckets.

    Shingles are ordered by the number of these nodes that hold them, then by hash; those of one node come first and make no
    bucket. Of a linked pair the sets share at least c = percent % of the larger set, and c' = 2 percent / (100 + percent) of the
    smaller one. So their first common shingle is one of the n - c + 1 first of the larger and of the n - c' + 1 first of the smaller.
    A node meets all of a bucket (``first``) where its place is within the latter, else only those; or those outside the
    bucket's largest component do, if they are fewer. Rows are as many as the nodes' shingles at most.
    """
    nodes = tables.write(members.select("node", "label").distinct(), "nodes")
    wanted = tables.write(classes.join(nodes, "node").select("node", "label", "n", "id", "key"), "wanted")
    sets = full_sets(docs, wanted.select("node", "id", "key"), id_col, text_col).dropDuplicates(["node"])
    tokens = tables.write(sets.select("node", F.explode("shingles").alias("shingle")), "tokens")
    held = tokens.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    some = tokens.join(held, "shingle").join(wanted.select("node", "label", "n"), "node")
    own = Window.partitionBy("node")
    some = some.withColumns({"rank": F.row_number().over(own.orderBy("held", "shingle")), "many": F.count("*").over(own)})
    place, n = F.col("n") - F.col("many") + F.col("rank"), F.col("n")
    rows = some.where(place <= n - F.ceil(percent * n / 100) + 1).withColumn("first", place <= n - F.ceil(2 * percent * n / (100 + percent)) + 1)
    rows = tables.write(rows.select(F.xxhash64("shingle", F.lit("rare")).alias("key"), F.lit(-1).alias("band"), "node", "label", "first"), "rare")
    # a pair across components also has a member outside the largest one: whichever are fewer meet all
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.count_if("first").alias("front"))
    sizes = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.sum("front").alias("front"), F.count("*").alias("labels")).where("labels > 1 and front > 0")
    by_place = F.col("front") <= F.col("n") - F.col("m.n")
    outside = F.when(by_place, F.col("front")).otherwise(F.col("n") - F.col("m.n"))
    sizes = sizes.select("key", F.when(~by_place, F.col("m.label")).alias("main"), outside.alias("outside"), (F.col("n") - outside).alias("inside"))
    rows = rows.join(sizes, "key").withColumn("first", F.coalesce(F.col("label") != F.col("main"), F.col("first")))
    return rows.select("key", "band", "node", "label", "first", "inside", "outside")


def cross_members(members: DataFrame, floor: float) -> DataFrame:
    """(key, node) of members that have a likely partner in another component of the bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["key", "i", "j"]):
            hit = np.zeros(part.num_rows, bool)
            for a, b in block_pairs(part, floor):
                hit[a] = hit[b] = True
            if hit.any():
                yield part.select(["key", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()[0]

    return in_blocks(members).mapInArrow(work, "key long, node long").distinct()


def cross_links(members: DataFrame, floor: float, percent: int) -> DataFrame:
    """Confirmed links (a, b) across components: of each group no more than join its components. members hold ``shingles``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["key", "i", "j"]):
            node, label, n = (part.column(k).to_numpy() for k in ("node", "label", "n"))
            lists = part.column("shingles").chunk(0)
            codes, distinct = pd.factorize(lists.flatten().to_numpy())
            first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            mark = np.zeros(len(distinct), bool)
            root = {x: x for x in label.tolist()}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found = []
            for a, b in block_pairs(part, floor):
                own = codes[first[a] : first[a + 1]]
                mark[own] = True
                length = first[b + 1] - first[b]
                shared = np.add.reduceat(mark[codes[gather(first[b], length)]], np.cumsum(length) - length, dtype=np.int64)
                mark[own] = False
                for other in b[100 * shared >= percent * (n[a] + n[b] - shared)].tolist():
                    x, y = find(int(label[a])), find(int(label[other]))
                    if x != y:
                        root[x] = y
                        found.append((node[a], node[other]))
            if found:
                pairs = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    return in_blocks(members).mapInArrow(work, "a long, b long").distinct()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys in sorted record batches, each as a table, whatever the batches' borders."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if rest:
                change[0] |= rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        at = 0
        for to in [*np.flatnonzero(change).tolist(), batch.num_rows]:
            if to > at or (to == 0 and rest):
                if to > at:
                    rest.append(batch.slice(at, to - at))
                if to < batch.num_rows:
                    yield pa.Table.from_batches(rest).combine_chunks()
                    rest = []
                at = to
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def components(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id (the smallest id reachable over links), kept and text_hash."""
    bound_batches(docs.sparkSession)
    tables, floor = Tables(), percent / 100 - MARGIN
    rows = tables.write(sketch(docs, id_col, text_col), "sketches")
    some = rows.where("n > 0")
    own = F.min(F.struct("id", "key"))
    classes = tables.write(
        some.groupBy("node").agg(F.first("n").alias("n"), F.first("registers").alias("registers"), own.alias("o"), F.min("id").alias("least")).select("node", "n", "registers", "o.id", "o.key", "least"),
        "classes",
    )
    bands = bands_of(classes)
    buckets = tables.write(bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    stars = bands.join(buckets, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = tables.write(likely_pairs(stars, classes, floor), "pairs")
    links = confirmed(pairs, classes, docs, id_col, text_col, percent, tables)
    labels = tables.write(connected_components(links, tables), "labels")

    # buckets of three or more that hold several components
    open_ = tables.write(bands.join(buckets.where("size > 2"), "key").select("key", "band", "node"), "open")
    tables.drop(pairs, buckets)
    for round_ in range(ROUNDS):
        members, main = mixed_buckets(open_, labels, round_, tables)
        stars = members.join(main, "key").where("label <> main").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        pairs = tables.write(likely_pairs(stars, classes, floor), "pairs")
        if pairs.isEmpty():
            break
        links = tables.write(links.union(confirmed(pairs, classes, docs, id_col, text_col, percent, tables)), "links")
        labels = tables.write(connected_components(links, tables), "labels")
    members, main = mixed_buckets(open_, labels, ROUNDS, tables)
    scattered = F.col("outside") > F.greatest(F.lit(BLOCK), SCATTERED * F.col("inside"))
    large = members.join(main.where(scattered).select("key"), "key", "left_semi")
    left = members.join(main.where(~scattered), "key").withColumn("first", F.col("label") != F.col("main")).drop("main", "hub")
    if not large.isEmpty():
        left = left.unionByName(parted(large, classes, docs, id_col, text_col, percent, tables))
    members = tables.write(left.join(classes.select("node", "n", "registers"), "node"), "members")
    near = tables.write(cross_members(members, floor), "near")
    if not near.isEmpty():
        wanted = tables.write(classes.join(near.select("node").distinct(), "node", "left_semi").select("node", "id", "key"), "wanted")
        sets = tables.write(full_sets(docs, wanted, id_col, text_col), "sets")
        members = members.join(near, ["key", "node"]).join(sets.dropDuplicates(["node"]), "node")
        links = tables.write(links.union(cross_links(members, floor, percent)), "links")
        labels = tables.write(connected_components(links, tables), "labels")

    named = labels.join(classes.select("node", "least"), "node")
    least = tables.write(named.groupBy("component").agg(F.min("least").alias("least")), "least")
    named = labels.join(small(least), "component").select("node", F.col("least").alias("component_id"))
    by_class = tables.write(classes.select("node", "least").join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "named")
    out = rows.select("id", "node", "n", "key").join(by_class, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("text_hash"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return tables.result(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"), "text_hash"), "near")
