"""Near-duplicates, vectors, passages and the pipeline against brute force."""

import collections
import pathlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgelake.llm import embedding_dedup, near_dedup, shared, substring_dedup
from edgelake.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
VOCABULARY = [f"w{i}" for i in range(3000)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(texts, percent=85):
    sets = {k: shingles(t) for k, t in texts.items()}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(keys, links)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(VOCABULARY)
    return out


def corpus():
    """Groups whose members are linked to some of their group only, copies, short and empty texts."""
    rng, texts = random.Random(7), {}
    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(12):
            texts[len(texts)] = " ".join(edited(rng, base, rng.choice([0, 1, len(base) // 60, len(base) // 25])))
    texts |= {500: "", 501: None, 502: "one two", 503: "One TWO", 504: "one two three", 505: " \n", 506: texts[0], 507: (texts[1] + " ") * 200, 508: "É a b c d e", 509: "é a b c d e"}
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, kept string").repartition(5)
    sets, root = brute(texts)
    for r in near_dedup.components(docs).collect():
        k = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[k]), root[k], root[k] == k)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(3)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    texts = {i: " ".join(edited(rng, base, rng.choice([2, 3, 5]))) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, root = brute(texts)
    for rounds in (0, 2):
        monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.components(docs).collect()} == root


def test_members_of_large_components_do_not_meet_in_blocks(spark):
    """Of 5,000 near copies in a bucket and 20 sets outside, each moves once for the block of the 20."""
    rows = spark.range(5_020).select(
        F.lit(1).alias("key"), F.lit(0).alias("band"), F.col("id").alias("node"), F.when(F.col("id") < 5_000, F.lit(-1)).otherwise(F.col("id")).alias("label"),
        (F.col("id") >= 5_000).alias("first"), F.lit(5_000).alias("inside"), F.lit(20).alias("outside"),
    )
    dealt = near_dedup.in_blocks(rows)
    assert dealt.where("label = -1").count() == 5_000
    # one group for the 20 among themselves, and one for each block of the others
    assert dealt.where("label <> -1").groupBy("node").count().where(f"count <> {1 + -(-5_000 // near_dedup.BLOCK)}").isEmpty()
    assert dealt.groupBy("i", "j").agg(F.countDistinct("node")).count() == 1 + -(-5_000 // near_dedup.BLOCK)


def test_texts_of_one_template_move_in_proportion(spark, monkeypatch):
    """5,000 texts of one template at a similarity of about 0.7, 150 with a near copy: the links are found, and blocks hold few rows a text."""
    rng = random.Random(13)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    texts = [edited(rng, base, 3) for _ in range(4_850)]
    texts += [edited(rng, texts[i], 1) for i in range(0, 3_000, 20)]
    moved, plain = [], near_dedup.in_blocks
    monkeypatch.setattr(near_dedup, "in_blocks", lambda members: (moved.append(plain(members).count()), plain(members))[1])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(docs).collect()}
    sets = [shingles(" ".join(w)) for w in texts]
    held = collections.defaultdict(list)
    for k, x in enumerate(sets):
        for shingle in x:
            held[shingle].append(k)
    # intersections of all pairs: of frequent shingles by a product, of others one by one
    common = [docs for docs in held.values() if len(docs) > 60]
    has = np.zeros((len(texts), len(common)), np.float32)
    for column, docs_ in enumerate(common):
        has[docs_, column] = 1
    shared_ = has @ has.T
    for docs_ in (d for d in held.values() if len(d) <= 60):
        for a in docs_:
            shared_[a, docs_] += 1
    size = np.array([len(x) for x in sets], np.float32)
    a, b = np.nonzero(100 * shared_ >= 85 * (size[:, None] + size[None, :] - shared_))
    links = [(int(x), int(y)) for x, y in zip(a, b, strict=True) if x < y]
    assert len(links) >= 150 and got == components(list(range(len(texts))), links)
    assert len(set(got.values())) > 3_000
    assert max(moved) <= 40 * len(texts), moved


def test_large_group_of_near_copies_equals_brute_force(spark):
    """5,000 copies of one text with up to two words replaced, some beyond the limit of the smallest id's."""
    rng = random.Random(12)
    base = [rng.choice(VOCABULARY) for _ in range(120)]
    texts = {i: edited(rng, base, 0 if i == 7 else rng.choice([1, 2, 3])) for i in range(5_000)}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")).collect()}
    sets = {k: shingles(" ".join(w)) for k, w in texts.items()}
    linked = [k for k in texts if 100 * len(sets[k] & sets[7]) >= 85 * len(sets[k] | sets[7])]  # all of these are one component
    rest = [k for k in texts if k not in set(linked)]
    pairs = [(a, 7) for a in linked] + [(a, b) for a in rest for b in texts if a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == components(list(texts), pairs)


def test_near_duplicates_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sets, root = brute(texts)
    rows = queries()["op3_near_dedup"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"]) for r in rows)


def test_near_duplicate_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words stand here now"), (None, "a b c d e f"), (None, "lone text with no id"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.components(docs).collect())
    assert got == {(1, 2, 1, True): 2, (1, 1, 1, True): 1, (None, 2, 1, False): 1, (None, 1, None, True): 1, (2, 0, 2, True): 1}
    assert near_dedup.components(docs.where("false")).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 4000).astype(np.uint64), rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    x, y = a, np.concatenate([a[:3000], b])  # similarity 0.6
    r = near_dedup.registers(np.concatenate([x, y]), np.array([0, 4000, 8000]))
    assert abs((r[0] == r[1]).mean() - 0.6) < 0.2
    n = np.array([4000])
    assert near_dedup.likely(r[[0]], r[[0]], n, n, 0.68)[0] and not near_dedup.likely(r[[0]], r[[1]], n, n, 0.95)[0]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in shared.connected_components(edges, shared.Tables()).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert shared.connected_components(edges.where("false"), shared.Tables()).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in range(3):
        for size in (1, 1, 1, 2, 5, 40):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((k, (centre + 0.06 * rng.standard_normal(16)).tolist(), label))
                k += 1
    rows += [(k, rows[-1][1], 2), (k + 1, None, 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] * 16, 1), (k + 4, [None, 1.0], 1), (k + 5, rows[0][1], None), (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0), (k + 8, [], 0), (k + 9, [float("inf"), 1.0], 0), (k + 10, [1e-200, 2e-200], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v, float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    unit = {i: v / np.abs(v).max() for i, (v, _) in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.98]
    root = components([i for i, _, _ in rows], links)
    degree = collections.Counter(x for pair in links for x in pair)
    got = embedding_dedup.components(table).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], root[i], root[i] == i)
    assert embedding_dedup.components(table.where("false")).count() == 0


def vectors_by_brute_force(rows):
    x, label = np.array([v for _, v, _ in rows]), np.array([k for _, _, k in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    return linked.sum(1), components(range(len(x)), zip(*np.nonzero(np.triu(linked)), strict=True))


def test_saturated_lists(spark):
    """By label: 12 clusters of 60, two by two at a cosine of 0.985; hubs with 60 spokes that are no neighbours of each other, a chain, and
    a bridge between two hubs; vectors at equal angles."""
    rng, rows = np.random.default_rng(1), []
    add = lambda v, label: rows.append((len(rows), v.tolist(), label))
    for _ in range(6):
        a, b = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        for centre in (a, 0.985 * a + np.sqrt(1 - 0.985**2) * b):
            for _ in range(60):
                add(centre + 0.002 * rng.standard_normal(48), 0)
    hubs = []
    for _ in range(4):
        c = rng.standard_normal(48)
        c /= np.linalg.norm(c)
        hubs.append(c)
        for _ in range(60):
            u = rng.standard_normal(48)
            u -= u @ c * c
            turn = np.deg2rad(rng.uniform(9, 11.4))
            add(np.cos(turn) * c + np.sin(turn) * u / np.linalg.norm(u), 1)
        add(c, 1)
    u, v = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
    for i in range(32):
        add(np.cos(np.deg2rad(11.2 * i)) * u + np.sin(np.deg2rad(11.2 * i)) * v, 1)
    # from the first hub to the second in steps under the limit
    side = hubs[1] - hubs[1] @ hubs[0] * hubs[0]
    whole = np.arccos(hubs[0] @ hubs[1])
    for turn in np.linspace(0, whole, int(whole / np.deg2rad(11)) + 2)[1:-1]:
        add(np.cos(turn) * hubs[0] + np.sin(turn) * side / np.linalg.norm(side), 1)
    for i in range(40):
        add(np.eye(48)[i], 2)
    degree, root = vectors_by_brute_force(rows)
    got = {r["vec_id"]: r for r in embedding_dedup.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (degree[i], root[i], root[i] == i) for i in range(len(rows)))


def test_low_recall_raises(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit", lambda *_: 0.5)
    monkeypatch.setattr(embedding_dedup, "AUDIT_ROUNDS", 0)
    rows = [(i, np.random.default_rng(i // 2).standard_normal(8).tolist(), 0) for i in range(20)]
    with pytest.raises(RuntimeError, match="0.500"):
        embedding_dedup.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def test_audit_counts_what_is_missing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(16)[i % 5] + 0.01 * rng.standard_normal(16)).tolist(), i % 5) for i in range(40)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, i % 5, 16, x[i].tolist(), 1, i < 20) for i in range(40)], "node long, label int, size int, vector array<double>, weight long, asked boolean")
    found = spark.createDataFrame([(i, 7 if i % 2 else 0) for i in range(40)], "node long, links long")
    assert embedding_dedup.audit(nodes, found, 0.98, shared.Tables()) == 0.5


def test_vectors_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    usable = [r for r in table if r["label"] is not None and r["embedding"]]
    at = {r["vec_id"]: i for i, r in enumerate(usable)}
    degree, root = vectors_by_brute_force([(r["vec_id"], r["embedding"], hash(r["label"])) for r in usable])
    rows = queries()["op10_embeddings"](spark, SMALL).collect()
    assert len(rows) == len(table)
    for r in rows:
        i = at.get(r["vec_id"])
        assert r["n_links"] == (0 if i is None else degree[i])
        assert r["component_id"] == (r["vec_id"] if i is None else min(x["vec_id"] for x, y in zip(usable, root.values(), strict=True) if y == root[i]))


def test_vector_cases(spark):
    """Clashing columns, long vectors, ids that aren't numbers, and null ids."""
    rows = [("a", [1.0, 0.0, 0.0], "x", 1, 1), ("b", [5.0, 0.0, 0.0], "x", 1, 1), (None, [1.0, 0.0, 1e-3], "x", 1, 1), ("c", [0.0] * 4999 + [1.0], "x", 1, 1), ("d", [1e-3] + [0.0] * 4998 + [1.0], "x", 1, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.components(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string, node long, kept int")).collect()}
    assert got == {"a": (2, "a", True), "b": (2, "a", False), None: (2, "a", False), "c": (1, "c", True), "d": (1, "c", False)}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(11)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    passage = fresh(80)
    texts = {i: fresh(100) + (edited(rng, passage, 3) if i % 3 == 0 else []) + fresh(60) for i in range(30)}
    return {k: " ".join(w) for k, w in texts.items()}, set(range(3, 30, 3)), passage


def test_passages_are_found(spark, passages):
    texts, repeated, passage = passages
    rows = [(k, t, "y") for k, t in texts.items()] + [(None, texts[0], "y"), (90, None, "y"), (91, "", "y"), (92, "short", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = substring_dedup.passages(docs).collect()
    assert {r["doc_id"] for r in found} == repeated | {None}
    covered = collections.defaultdict(set)
    assert all(r["source_id"] == 0 and (r["start"], r["end"]) == (0, 240) for r in found if r["doc_id"] is None)
    for r in [r for r in found if r["doc_id"] is not None]:
        assert r["source_id"] < r["doc_id"] and r["source_id"] % 3 == 0 and r["end"] - r["start"] >= 50 and r["n_same"] >= 0.8 * (r["end"] - r["start"])
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    assert all(len(c & set(range(100, 180))) >= 74 and len(c - set(range(100, 180))) <= 4 for c in covered.values())
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs).collect()}
    assert left.keys() == {r[0] for r in rows} - {None}
    for k, t in texts.items():
        assert (left[k] == t) == (k not in repeated)
        if k in repeated:
            assert 158 <= len(left[k].split()) <= 172
    assert substring_dedup.passages(docs.where("false")).count() == 0


def test_passages_of_copies_and_long_texts(spark, passages):
    texts = passages[0]
    long = " ".join(" ".join(random.Random(i).choices(VOCABULARY, k=200)) for i in range(200))
    rows = [(1, long), (2, long), (2, long), (3, texts[1]), (4, "x " + texts[1] + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.passages(docs).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(2, 1), (4, 3)}
    left = substring_dedup.cut(docs).collect()
    assert sorted((r["doc_id"], len(r["text"].split())) for r in left) == [(1, 40_000), (3, 160), (4, 2)]


def aligned(a, b):
    """Whether two lists of words have a common stretch of 50 words of which 80 % agree, by trying all diagonals and stretches."""
    for shift in range(-len(a), len(b)):
        hit = [i for i in range(max(0, -shift), min(len(a), len(b) - shift)) if a[i] == b[i + shift]]
        if len(hit) >= 40 and any(hit[j] - hit[i] >= 49 and j - i + 1 >= 0.8 * (hit[j] - hit[i] + 1) for i in range(len(hit)) for j in range(i + 39, len(hit))):
            return True
    return False


def test_fuzzy_passages_are_found(spark):
    """Passages of 50 to 80 words with 5 to 18 % of their words replaced: nine in ten of each kind are found, and nothing else."""
    rng = random.Random(20)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    rows, kinds = [], collections.defaultdict(set)
    for size in (50, 55, 60, 80):
        for rate in (5, 10, 15, 18):
            while len(kinds[size, rate]) < 40:
                passage = fresh(size)
                a, b = fresh(50) + passage + fresh(30), fresh(20) + [rng.choice(VOCABULARY) if rng.random() < rate / 100 else w for w in passage] + fresh(70)
                if not aligned(b, a):
                    continue
                kinds[size, rate].add(len(rows) + 1)
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["source_id"] == r["doc_id"] - 1 and r["end"] - r["start"] >= 50 and r["n_same"] >= 0.8 * (r["end"] - r["start"]) for r in found)
    by_doc = {r["doc_id"] for r in found}
    assert all(len(wanted & by_doc) >= 0.9 * len(wanted) for wanted in kinds.values()), {k: len(w & by_doc) / len(w) for k, w in kinds.items()}


@pytest.mark.parametrize("parts", [2, 3])
def test_fuzzy_passages_of_several_earlier_parts_are_found(spark, parts):
    """Each part stood alone in an earlier document, all together in one; nine in ten with 5 to 15 % of words replaced are covered."""
    rng = random.Random(21 + parts)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    rows, kinds = [], collections.defaultdict(dict)
    add = lambda words: rows.append((len(rows), " ".join(words)))
    for size in (50, 60, 80):
        for rate in (5, 10, 15):
            while len(kinds[size, rate]) < 40:
                passage = fresh(size)
                changed = [rng.choice(VOCABULARY) if rng.random() < rate / 100 else w for w in passage]
                if not aligned(changed, passage):
                    continue
                for i in range(parts):
                    add(fresh(40) + passage[size * i // parts : size * (i + 1) // parts] + fresh(40))
                add(fresh(50) + passage + fresh(30))
                add(fresh(20) + changed + fresh(70))
                kinds[size, rate][len(rows) - 1] = set(range(20, 20 + size))
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = collections.defaultdict(set)
    for r in found:
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    assert set(covered) <= {d for docs in kinds.values() for d in docs}
    recall = {k: sum(len(covered[d] & w) >= 0.75 * len(w) for d, w in docs.items()) / len(docs) for k, docs in kinds.items()}
    assert min(recall.values()) >= 0.9, recall


def test_texts_that_repeat_a_source_are_searched_whole(spark):
    """A passage of the source that stands several times in one text is found at each place."""
    rng = random.Random(23)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    passage = fresh(55)
    texts = [fresh(30) + passage + fresh(30), sum((passage + fresh(7) for _ in range(20)), [])]
    found = substring_dedup.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    covered = {x for r in found for x in range(r["start"], r["end"])}
    assert all(r["doc_id"] == 1 and r["source_id"] == 0 for r in found)
    assert all(set(range(62 * i, 62 * i + 55)) <= covered for i in range(20))


def test_the_longest_similar_stretch_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        agree = rng.random(rng.integers(1, 60)) < rng.uniform(0.3, 1)
        x, y = substring_dedup.longest(agree)
        every = [j - i for i in range(len(agree)) for j in range(i + 1, len(agree) + 1) if agree[i] and agree[j - 1] and agree[i:j].sum() >= 0.8 * (j - i)]
        assert y - x == max(every, default=0) and (y == x or (agree[x] and agree[y - 1] and agree[x:y].sum() >= 0.8 * (y - x) - 1e-9))


def with_many_sources(rng, rate, several=4):
    """Rows of passages of 60 words of which both halves stood in ``several`` earlier documents each, and what is to be found of whom."""
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    rows, wanted = [], {}
    for _ in range(30):
        passage = fresh(60)
        changed = passage
        while changed == passage or not aligned(changed, passage):
            changed = [rng.choice(VOCABULARY) if rng.random() < rate else w for w in passage] + ["last"]
        for part in (passage[:30], passage[30:]):
            rows += [(len(rows) + i, " ".join(fresh(40) + part + fresh(40))) for i in range(several)]
        rows += [(len(rows), " ".join(fresh(50) + passage + fresh(30))), (len(rows) + 1, " ".join(fresh(20) + changed + fresh(70)))]
        wanted[len(rows) - 1] = len(rows) - 2
    return rows, wanted


@pytest.mark.parametrize("rate", [0, 0.1])
@pytest.mark.parametrize("block", [1 << 14, 3])
def test_passages_of_parts_with_many_sources_are_found(spark, monkeypatch, rate, block):
    """A seed is matched with all earlier documents where that leads to a passage, in one block or several."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rows, wanted = with_many_sources(random.Random(31), rate)
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} <= set(wanted)
    covered = collections.defaultdict(set)
    for r in found:
        assert r["source_id"] == wanted[r["doc_id"]]
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    recall = sum(len(covered[d] & set(range(20, 80))) >= 50 for d in wanted) / len(wanted)
    assert recall >= 0.9, recall


def test_passages_of_parts_with_many_sources_are_cut(spark):
    rows, wanted = with_many_sources(random.Random(31), 0.1)
    left = {r["doc_id"]: len(r["text"].split()) for r in substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(left[k] == len(t.split()) for k, t in rows if k not in wanted)
    assert sum(left[k] <= 105 for k in wanted) >= 0.9 * len(wanted)


def test_later_places_in_the_only_earlier_document_are_found(spark):
    """A seed that stands several times in its first document is matched with all these places."""
    rng = random.Random(37)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    rows = []
    for k in range(0, 60, 2):
        passage = fresh(60)
        changed = passage
        while changed == passage or not aligned(changed, passage):
            changed = [rng.choice(VOCABULARY) if rng.random() < 0.1 else w for w in passage]
        first = fresh(40) + passage[:30] + fresh(80) + passage[30:] + fresh(80) + passage + fresh(40)
        rows += [(k, " ".join(first)), (k + 1, " ".join(fresh(20) + changed + fresh(70)))]
    covered = collections.defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    assert set(covered) <= {k + 1 for k, _ in rows[::2]}
    assert sum(len(covered[k + 1] & set(range(20, 80))) >= 50 for k, _ in rows[::2]) >= 27


@pytest.mark.parametrize("vocabulary", [2, 40, 4000])
def test_surroundings_of_repeated_seeds_lose_no_diagonal(vocabulary):
    """Every pair that agrees on the seed's diagonal is found, or one of the same two texts and diagonal where the run begins; of 1 found in each document others may follow."""
    rng = np.random.default_rng(vocabulary)
    shift, middle = substring_dedup.SHIFT, substring_dedup.REACH
    rows = []
    for d in range(40):
        text = rng.integers(2, 2 + vocabulary, 300).astype(np.uint16)
        run = int(rng.integers(1, 30))
        text[100 : 104 + run] = 1
        if d % 3:
            text[104 + run :] = np.arange(196 - run) % 97 + 9
            text[104 + run :][rng.random(196 - run) < 0.15] = 3
        rows += [(d, p, text[p - middle : p + 5 + middle]) for p in range(100, 100 + run)]
    doc, place, words = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    none = np.zeros(len(doc), int)
    found = {(int(a), int(b)) for x in substring_dedup.chainable(words, doc, none - 1, none, 10_000) for a, b, _ in zip(*x, strict=True)}
    own = words[:, shift:-shift]
    wanted = {(i, j) for i in range(len(doc)) for j in np.flatnonzero(doc < doc[i]).tolist() if substring_dedup.stretch(own[i : i + 1], own[j : j + 1], 1)[0]}
    diagonals = {(doc[i], doc[j], place[j] - place[i]) for i, j in found}
    assert wanted and {(doc[i], doc[j], place[j] - place[i]) for i, j in wanted} <= diagonals
    assert len(found & wanted) < len(wanted)
    for i, j in wanted - found:
        assert any((doc[a], doc[b], place[b] - place[a]) == (doc[i], doc[j], place[j] - place[i]) and place[a] < place[i] for a, b in found)


@pytest.mark.parametrize("vocabulary", [4, 40, 4000])
def test_similar_surroundings_lose_no_pair(vocabulary):
    """Every pair with a stretch of 50 words around the seed of which 40 agree, at a shift beyond some word, is found."""
    rng = np.random.default_rng(vocabulary)
    shift, far = substring_dedup.SHIFT, substring_dedup.FAR
    base = rng.integers(1, vocabulary, (12, 400))
    words = np.zeros((300, 2 * substring_dedup.REACH + substring_dedup.WORDS), np.uint16)
    for w in words:
        w[:] = np.where(rng.random(w.shape) < rng.uniform(0, 0.5), rng.integers(1, vocabulary, w.shape), base[rng.integers(12), : len(w)])
        at = rng.integers(substring_dedup.REACH + 5, len(w) - 1)
        if rng.random() < 0.5:  # words that one text has more
            w[at:] = np.roll(w[at:], rng.integers(0, shift))
        w[: rng.integers(0, 80) // 2] = 0
        w[substring_dedup.REACH :][: substring_dedup.WORDS] = range(1, 6)
    doc, side = np.arange(300), np.arange(300) % 2
    free = rng.random(300) < 0.5
    after = np.where(free, rng.integers(-1, 100, 300), 1 << 60)
    own = words[:, shift:-shift]
    wanted = set()
    for i in np.flatnonzero(free):
        hit = np.any([(own[i] == words[:, k : k + own.shape[1]]) & (own[i] > 0) for k in range(2 * shift + 1)], 0)
        many = np.lib.stride_tricks.sliding_window_view(hit, 50, 1).sum(2)
        inside = np.lib.stride_tricks.sliding_window_view(own[i] > 0, 50).all(1)
        assert many.shape[1] == far + 1
        wanted |= {(int(i), int(j)) for j in np.flatnonzero((many * inside >= 40).any(1)) if after[i] < j < i}
    for sides in (np.zeros(300, int), side):
        get = lambda first: [(int(a), int(b), bool(c)) for x in substring_dedup.similar(words, doc, after, sides, first) for a, b, c in zip(*x, strict=True)]
        found = {(i, j) for i, j, _ in get(1000)}
        assert found >= {(i, j) for i, j in wanted if not sides.any() or side[i] != side[j]} and wanted
        some = get(3)
        assert {(i, j) for i, j, _ in some} == {(i, j) for i, j in found if sum(x == i and y < j for x, y in found) < 3}
        assert all(more == (sum(x == i and y < j for x, y in found) == 2) for i, j, more in some)


def test_passages_query(spark):
    """Every row found is what it claims, and no pair of texts that agree word for word over 50 words is left out."""
    texts = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries()["op1_passages"](spark, SMALL).collect()
    covered = collections.defaultdict(set)
    for r in rows:
        a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["source_id"]][r["source_start"] : r["source_end"]]
        assert r["source_id"] < r["doc_id"] and len(a) >= 50 and r["n_same"] >= 0.8 * len(a)
        assert len(b) and len(set(a) & set(b)) >= 0.5 * len(set(a))
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    first, wanted = {}, collections.defaultdict(set)
    for doc in sorted(texts):
        for i in range(len(texts[doc]) - 49):
            if first.setdefault(tuple(texts[doc][i : i + 50]), doc) < doc:
                wanted[doc].update(range(i, i + 50))
    assert wanted and all(len(wanted[d] & covered[d]) >= 0.98 * len(wanted[d]) for d in wanted)


def test_pairs_in_spans_equal_pairs_in_one(spark, monkeypatch):
    rng = random.Random(5)
    shared_ = spark.createDataFrame([(1, 3 * i + rng.randrange(3), rng.randrange(4), rng.randrange(100), rng.random() < 0.5) for i in range(400)], "doc long, place int, source long, source_place int, open boolean")
    whole = collections.Counter(map(tuple, substring_dedup.find_pairs(shared_).collect()))
    monkeypatch.setattr(substring_dedup, "SPAN", 64)
    assert collections.Counter(map(tuple, substring_dedup.find_pairs(shared_).collect())) == whole


def test_rows_that_share_an_id_are_documents(spark, passages):
    """A text under an id of two texts, and one without id, are searched too; one under a repeated row is one document."""
    texts = passages[0]
    rows = [(0, texts[0]), (0, texts[3]), (None, texts[6]), (8, texts[9]), (8, texts[9])]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == len(rows)
    # one of the four texts is the source of the others
    assert len(found) >= 3 and sum(len(r["text"].split()) in (240,) for r in left) in (1, 2)


def test_a_passage_with_two_sources_is_cut_whole(spark):
    """The first 45 of 90 words stand in document 0, all of them in 1: 2 loses all."""
    rng = random.Random(4)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    passage = fresh(90)
    rows = [(0, fresh(60) + passage[:45] + fresh(60)), (1, fresh(70) + passage + fresh(50)), (2, fresh(40) + passage + fresh(80))]
    found = substring_dedup.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect()
    covered = {x for r in found if r["doc_id"] == 2 for x in range(r["start"], r["end"])}
    assert len(covered & set(range(40, 130))) >= 86
    assert not [r for r in found if r["doc_id"] == 1]


def test_passages_whose_parts_have_earlier_sources_are_found(spark):
    """Two parts of 40 words, three of 25, and three of 24 of which each two neighbours stand together earlier."""
    rng = random.Random(6)
    fresh = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    rows, wanted = [], {}

    def add(words, source=None):
        before = fresh(50)
        if source is not None:
            wanted[len(rows)] = (source, range(50, 50 + len(words)))
        rows.append((len(rows), " ".join(before + words + fresh(50))))
        return len(rows) - 1

    for sizes, together in (((40, 40), 1), ((25, 25, 25), 1), ((24, 24, 24), 2)):
        parts = [fresh(n) for n in sizes]
        for i in range(len(parts) - together + 1):
            add(sum(parts[i : i + together], []))
        source = add(sum(parts, []))
        add(sum(parts, []), source)
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(wanted)
    for doc, (source, words) in wanted.items():
        covered = {x for r in found if r["doc_id"] == doc and r["source_id"] == source for x in range(r["start"], r["end"])}
        assert len(covered & set(words)) >= len(words) - 2 and len(covered - set(words)) <= 4


def naive_chain(q, r):
    best = [0.0] * len(q)
    for i in range(len(q)):
        best[i] = substring_dedup.GAIN + max([0.0, *(best[j] - substring_dedup.COST * (q[i] - q[j] + r[i] - r[j]) for j in range(i) if q[j] < q[i] and r[j] < r[i])])
    return max(best)


def test_chains_equal_the_quadratic_recurrence():
    rng = random.Random(2)
    for _ in range(50):
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        q, r = [p[0] for p in pairs], [p[1] for p in pairs]
        found = substring_dedup.chains(q, r)
        for c in found:
            assert all(q[a] < q[b] and r[a] < r[b] for a, b in zip(c, c[1:], strict=False))
        if found:
            c = found[0]
            score = substring_dedup.GAIN * len(c) - substring_dedup.COST * (q[c[-1]] - q[c[0]] + r[c[-1]] - r[c[0]])
            assert abs(score - naive_chain(q, r)) < 1e-6


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.write_table(stage(spark, docs, SMALL), "stage")
        own = {r["doc_id"] for r in out.collect()}
        assert own <= ids and len(own) > 0.4 * len(ids), name
        if name == "minhash_near_dedup":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert own == {k for k, v in brute(texts, 80)[1].items() if k == v}
        if name != "best_fit_packing":
            assert out.columns == columns
            docs, ids = out, own
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()} == own


def test_stages_take_odd_rows(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    extra = ["_id", "node", "score", "lang_pred", "kept", "c0", "doc", "_key", "start"]
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + "".join(f", {k} long" for k in extra)
    text = " ".join(VOCABULARY[:60])
    rows = [(None, text, None, None, None), (5, None, None, None, None), (6, "", "en", "s", 0), (7, text, "en", "s", 9), (7, text, "en", "s", 9), (8, "1 2 3", "en", "s", 5)]
    odd = spark.createDataFrame([(*r, *[1] * len(extra)) for r in rows], schema)
    own = lambda rows: collections.Counter((r["doc_id"], r["text"]) for r in rows.collect())
    whole, words = {(None, text): 1, (7, text): 2}, {(5, None): 1, (6, ""): 1, (8, "1 2 3"): 1}
    want = {"language_id": whole, "quality_rules": whole, "minhash_near_dedup": words | {(7, text): 1}}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.where("false"), SMALL).count() == 0, name
        out = stage(spark, odd, SMALL)
        if name in want:
            assert own(out) == want[name], name
        elif name == "substring_dedup":
            assert own(out) in (words | {(7, text): 2}, words | {(None, text): 1})
        else:
            assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r[0] for r in rows)
        if name != "best_fit_packing":
            assert out.columns == odd.columns


def test_passages_whose_differing_words_stand_together_are_found(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 1 << 40, n)]
    rows, first = [], 100
    for k in range(20):
        source = word(first + 50)
        copy = list(source[first:])
        at = np.arange(1, 21, 2) if k % 2 else np.arange(29, 49, 2)  # every other word on one side: 40 of 50 agree
        for j, other in zip(at, word(len(at)), strict=True):
            copy[j] = other
        rows += [(k, " ".join(source + word(100))), (1000 + k, " ".join(word(80) + copy + word(80)))]
    found = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["source_id"] for x in found} == {1000 + k: k for k in range(20)}
    assert all(x["start"] <= 82 and x["end"] >= 128 and x["n_same"] >= 0.8 * (x["end"] - x["start"]) for x in found)


def test_chains_looked_at_at_once_are_those_that_align_finds():
    rng = np.random.default_rng(6)
    x, y, q, r = [], [], [], []
    for _ in range(600):
        a = rng.integers(0, 1 << 30, 220).astype(np.int32)
        b, at = [], []
        for j, w in enumerate(a):
            at.append(len(b))
            b += [] if rng.random() < 0.02 else [rng.integers(0, 1 << 30)] if rng.random() < rng.choice([0.1, 0.3]) else [w]
        b = np.array(b, np.int32)
        seeds = [j for j in np.sort(rng.choice(np.arange(80, 120), rng.integers(1, 5), False)) if at[j] < len(b)]
        x.append(a), y.append(b), q.append(np.array(seeds, np.int32)), r.append(np.array([at[j] for j in seeds], np.int32))
    lists = lambda parts: (np.cumsum([0, *map(len, parts)]), np.concatenate(parts))
    one = {k: np.zeros(len(x), np.int64) for k in ("qa", "ra")}
    look, known = substring_dedup.straight_passages(np.arange(len(x) + 1), [lists(q), lists(r)], one, lists(x), lists(y))
    more = 0
    for k, (a, b, c, d) in enumerate(zip(x, y, q, r, strict=True)):
        exact = [(s, e, u, n) for s, e, u, _, n in substring_dedup.align(a, b, c, d)]
        if exact:
            assert look[k] and known.get(k, exact[0]) == exact[0]
        elif k in known:
            s, e, u, n = known[k]
            assert e - s >= 50 and n >= 0.8 * (e - s) and n == (a[s:e] == b[u : u + e - s]).sum() and s <= c[-1] and e >= c[0] + 5
            more += 1
    assert known and more and not look.all()


def test_shuffle_files_of_finished_steps_go(spark):
    """A driver with room in its heap leaves them until the end, several times the input."""
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 300))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p.name for d in local for p in pathlib.Path(str(d)).rglob("shuffle_*.data")}
    before = files()
    substring_dedup.passages(docs)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
