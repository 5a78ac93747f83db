"""k-means, resampling and vector search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgelake.llm import centroids, resampling, vector_search
from edgelake.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
ODD = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 1.0, 2.0, 3.0]]


@pytest.mark.parametrize("name", ["op11_centroids", "op12_resampling", "op13_vector_search"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df, want = queries()[name](spark, SMALL), duck.execute(oracle_sql()[name])
    order = [[c[0] for c in want.description].index(c) for c in df.columns]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


# search ------------------------------------------------------------------------------------------------------------


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def search_by_brute_force(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    out = []
    for q, x in rows:
        if q % every == 0:
            found = []
            for c, y in rows:
                if len(y) == len(x) and (c, y) != (q, x):
                    score = 0.0
                    for a, b in zip(x, y, strict=True):
                        score += a * b
                    found.append((-score, c))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def searched(spark, rows, k=20, every=20):
    table = spark.createDataFrame([(i, v, "x", 1.5, 7) for i, v in rows], "vec_id long, embedding array<double>, node string, score double, rank int").repartition(5)
    return sorted(map(tuple, vector_search.nearest(table, k, every).collect()))


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "STRIP", 60)
    monkeypatch.setattr(vector_search, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(90)]  # a third are copies of one vector, queries among them
    rows += [(400 + i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(60)]  # ties
    rows += [(500 + i, (rng.standard_normal(4) * 10.0 ** rng.integers(-6, 7)).tolist()) for i in range(40)]  # another length, all sizes
    rows += [(600 + i, v) for i, v in enumerate(ODD)] + [(None, rows[0][1]), (20, rows[20][1]), (20, rows[21][1]), (40, [-x for x in rows[40][1]])]
    for k in (3, 20):
        assert searched(spark, rows, k) == search_by_brute_force(rows, k, 20)


def test_search_of_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0]), (20, [4.0])]
    assert searched(spark, rows) == [(0, 1, 1, 4.0), (20, 1, 2, 12.0)]
    assert searched(spark, [(0, [1.0])]) == searched(spark, []) == []


def test_search_of_long_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(2500) * (1000 if i % 3 else 1)).tolist()) for i in range(40)]
    assert searched(spark, rows, 4, 10) == search_by_brute_force(rows, 4, 10)


def tile_batch(i, side, node, x):
    n, size = len(node), x.shape[1]
    lists = pa.array(x.tolist(), pa.list_(pa.float64()))
    rows = next(vector_search.quantised(iter([pa.RecordBatch.from_arrays([pa.array(node), pa.array([size] * n, pa.int32()), pa.array(node), lists], ["node", "size", "least", "vector"])])))
    whole = lambda v: pa.array([v] * n, pa.int32())
    return pa.RecordBatch.from_arrays([whole(i), whole(0), whole(side), *rows.columns], ["i", "j", "side", *vector_search.ROW])


@pytest.mark.parametrize("kind", ["spread", "near copies", "one large component"])
def test_tiles_leave_the_best(monkeypatch, kind):
    """Also where bounds exclude nothing: near copies beyond 8 bits, and vectors whose largest component hides the others."""
    monkeypatch.setattr(vector_search, "TILE", 640)
    monkeypatch.setattr(vector_search, "PAIRS", 50)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16)) * np.exp(rng.standard_normal(700))[:, None]
    if kind == "near copies":
        x[20:500] = x[0] * (1 + 1e-5 * rng.standard_normal((480, 16)))
    if kind == "one large component":
        x[5:, 0] = 1e6
        x[:5, 0] = 0
    taken, plain = [], vector_search.in_order
    monkeypatch.setattr(vector_search, "in_order", lambda a, b: (taken.append(len(a)), plain(a, b))[1])
    batches = [tile_batch(0, 0, np.arange(5), x[:5]), tile_batch(0, 1, np.arange(300), x[:300]), tile_batch(0, 1, np.arange(300, 700), x[300:]), tile_batch(1, 1, np.arange(9), x[:9])]
    found = pa.Table.from_batches(vector_search.search_strips(iter(batches), 11)).to_pandas()
    exact = x[:5] @ x.T
    assert len(found) == 5 * 11
    for q in range(5):
        assert found["node"][found["query"] == q].tolist() == np.argsort(-exact[q], kind="stable")[:11].tolist()
    assert kind != "spread" or sum(taken) < 0.1 * 5 * 700


# k-means -----------------------------------------------------------------------------------------------------------


def clusters_by_brute_force(rows, k, rounds, seed, size, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for t in range(rounds + 1):
        at = [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in kept]
        if t < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
                if mine:
                    centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    distance = [far(v, centres[a]) for (_, v), a in zip(kept, at, strict=True)]
    inertia = Counter()
    for a, x in zip(at, distance, strict=True):
        inertia[a] += x
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, x, inertia[a], sum(distance), names[a]) for (i, _), a, x in zip(kept, at, distance, strict=True)), key=str)


def clustered(spark, rows, k=8, rounds=10, size=4, scale=16):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(3)
    return sorted(map(tuple, centroids.cluster(table, k, rounds, 3, size, scale).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(100)]  # copies of one vector: a third of all rows
    rows += [(400 + i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(80)]  # ties
    rows += [(600 + i, v) for i, v in enumerate(ODD)] + [(None, [1.0, 2.0, 3.0, 4.0]), (5, rows[5][1]), (5, [0.5] * 4), (700, [1.0] * 5)]
    for k, rounds in ((8, 10), (3, 1), (1, 2), (5, 0)):
        assert clustered(spark, rows, k, rounds) == clusters_by_brute_force(rows, k, rounds, 3, 4, 16)


def test_few_vectors(spark):
    rows = [(1, [1.0] * 4), (2, [1.0] * 4), (3, [-2.0] * 4)]
    assert clustered(spark, rows) == clusters_by_brute_force(rows, 8, 10, 3, 4, 16)  # equal centroids: the smaller number has all, the other stays empty
    assert clustered(spark, []) == clustered(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="exceeds"):
        clustered(spark, [(1, [1e30] * 4)])


def test_bounds_spare_most_distances(monkeypatch):
    """Rounds over random centroid paths, some of which return: same result as all distances, far fewer taken."""
    rng, taken = np.random.default_rng(6), []
    plain = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda x, c: (taken.append(len(x)), plain(x, c))[1])
    x = (rng.standard_normal((3000, 8)) * 100 + rng.integers(0, 6, (3000, 1)) * 700).astype(np.int64)
    base = np.stack([np.full(8, 700 * j) for j in range(6)])
    history = [base + (rng.integers(-40, 40, base.shape) if t % 2 else 0) for t in range(12)]
    at = np.stack([plain(x, c) for c in history[0]], 1)
    when, cluster = np.zeros(at.shape, np.int16), at.argmin(1)
    for now in range(1, 12):
        drift = np.sqrt(((np.stack(history[: now + 1]) - history[now]) ** 2).sum(2)) * (1 + centroids.ROOM)
        cluster, distance = centroids.assign(x, cluster, at, when, drift, history[now], now)
        all_ = np.stack([plain(x, c) for c in history[now]], 1)
        assert (cluster == all_.argmin(1)).all() and ((distance < 0) | (distance == all_.min(1))).all()
    assert sum(taken) < 0.3 * 11 * 6 * len(x)


# resampling --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 399), st.integers(1, 400)), min_size=1, max_size=20))
def test_span_crcs_equal_zlib(data, spans):
    spans = [(min(a, len(data) - 1), n) for a, n in spans]
    starts = np.array([a for a, _ in spans])
    ends = np.minimum(starts + np.array([n for _, n in spans]), len(data))
    got = resampling.crc_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]


def test_very_long_spans():
    data = np.random.default_rng(7).integers(0, 256, 1_000_003).astype(np.uint8)
    ends = np.array([64, 65, 128, 64 * 128 + 1, 1_000_003])
    assert resampling.crc_spans(data, np.zeros(5, np.int64), ends).tolist() == [zlib.crc32(data[:b].tobytes()) for b in ends]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text, ngrams):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


def resampled_by_brute_force(rows, target, percent, ngrams, buckets, seed, least):
    s, t = (Counter(f % buckets for x in texts for f in features_of(x, ngrams)) for texts in ([x for _, x in rows], target))
    a, b = sum(s.values()), sum(t.values())
    gain = lambda j: math.floor(1000 * math.log((t[j] + 1.0) * (a + buckets) / ((s[j] + 1.0) * (b + buckets))))
    out = []
    for i, text in rows:
        f = features_of(text, ngrams)
        weight = sum(gain(x % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted(map(tuple, out), key=str)


def resampled(spark, rows, target, **how):
    docs = spark.createDataFrame([(i, x, "a", 1, 2.0) for i, x in rows], "doc_id long, text string, id string, rank int, score double").repartition(4)
    return sorted(map(tuple, resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **how).collect()), key=str)


def texts():
    rng, vocabulary = random.Random(8), ["Alpha", "beta", "g4mma", "délta", "дом", "日本", "x" * 70, "y" * 5000, "a-b", "it's"]
    rows = [(i, " ".join(rng.choice(vocabulary[:6] + vocabulary[8:]) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(300, None), (301, ""), (302, "... --- \x00 \x7f"), (303, " ".join(vocabulary) * 300), (None, rows[4][1]), (7, rows[7][1]), (7, rows[8][1])]
    return rows, [" ".join(rng.choice(vocabulary[2:5]) for _ in range(30)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("ngrams", [1, 2])
def test_resampling_equals_brute_force(spark, ngrams):
    rows, target = texts()
    for percent, least in ((10, 20), (100, 0), (33, 5)):
        want = resampled_by_brute_force(rows, target, percent, ngrams, 500, 2024, least)
        assert resampled(spark, rows, target, percent=percent, ngrams=ngrams, buckets=500, least_words=least) == want


def test_equal_scores_go_to_smaller_ids(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(resampling, "noise", lambda id_, seed: F.lit(0).cast("long"))
    rows = [(i, "one two three") for i in range(100)]
    got = resampled(spark, rows, ["four"], percent=10, least_words=3)
    assert sorted((r[4], r[0]) for r in got if r[4]) == [(i + 1, i) for i in range(10)]


def test_resampling_of_empty_tables(spark):
    assert resampled(spark, [], ["a b"]) == []
    rows, _ = texts()
    assert resampled(spark, rows, [], buckets=500) == resampled_by_brute_force(rows, [], 10, 1, 500, 2024, 20)
