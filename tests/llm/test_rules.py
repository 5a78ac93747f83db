"""URL rules, language ID and quality rules."""

import collections
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgelake.llm import langid, quality, urls
from edgelake.llm.queries import URL_RULES, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def test_urls_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    got = sorted(map(tuple, queries()["op6_urls"](spark, SMALL).collect()))
    assert got == sorted(con.execute(oracle_sql()["op6_urls"]).fetchall())


@pytest.fixture(scope="module")
def pages(spark):
    canonical = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    rows = [
        (1, "http://EXAMPLE.com/en/a#x", "<p>", "r"), (2, "http://other.org/b", canonical("http://example.com/en/a"), "r"), (3, "http://third.org/c?q=1", canonical("http://other.org/b"), "r"),
        (4, "http://www.example.com/en/d", canonical("http://example.com/en/a"), "r"), (5, None, None, "r"), (6, "no scheme", "", "r"), (7, "http://a.net/fr/x", "", "r"), (8, "http://clean.org/", "", "r"),
        (9, "http://moved.org/old", '<META http-equiv="refresh" content="0; url=/new">', "r"), (10, "http://moved.org/new", canonical("//example.com/en/z?a=1&amp;b=2"), "r"), (1, "http://EXAMPLE.com/en/a#x", "<p>", "r"),
        (11, "http://example.com", None, "r"), (12, "x://notexample.com/en/", None, "r"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string")


def test_blocks_spread_over_links(pages):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, URL_RULES).collect()}
    assert got[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[2][2:] == got[3][2:] == (None, "block")
    assert got[4][3] == "allow"  # an explicit rule
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("net/fr/", "block") and got[8][3] == "allow"
    assert got[9][3] == got[10][3] == "block"
    assert got[11] == ("example.com", "", None, "allow") and got[12][2:] == ("com/", "allow")
    assert urls.judge(pages, URL_RULES).count() == 13
    assert urls.judge(pages.where("false"), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_links_match_sql(spark, pages, tmp_path):
    """All forms of links, through the operator and through its SQL."""
    more = [
        (20, "http://a.net/es/1", "<p>", "r"), (21, "http://q.org/1", "<LINK href='http://A.net/es/1' rel='canonical'>", "r"), (22, "http://q.org/d/2?x=1", '<link rel=canonical href=../1>', "r"),
        (23, "http://q.org/d/3#top", '<link rel="canonical" href="4">', "r"), (24, "http://q.org/d/4", "<meta http-equiv=refresh content='3;URL=http://q.org/1'>", "r"),
        (25, "http://q.org/5", '<link rel="stylesheet" href="http://a.net/es/1">', "r"), (26, "http://b.com/x", '<link rel="canonical" href="http://q.org/1">', "r"),
    ]
    table = pages.union(spark.createDataFrame(more, pages.schema))
    table.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    key = lambda row: tuple(map(str, row))
    got = sorted(map(tuple, queries()["op6_urls"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(con.execute(oracle_sql()["op6_urls"]).fetchall(), key=key)
    verdicts = {r[0]: r[4] for r in got}
    assert [verdicts[k] for k in (21, 23, 24, 25, 26)] == ["block", "block", "block", "allow", "allow"]


def test_many_rules_equal_few(spark, pages, monkeypatch):
    few = sorted(map(str, urls.judge(pages, URL_RULES).collect()))
    # rules of equal length on host and path: the longer host decides, then allow
    ties = [("block", "third.org", "/c"), ("allow", "third.org", "/c"), ("block", "org", "/"), *URL_RULES]
    tied = sorted(map(str, urls.judge(pages, ties).collect()))
    monkeypatch.setattr(urls, "MOST_LITERALS", 0)
    assert sorted(map(str, urls.judge(pages, URL_RULES).collect())) == few
    assert sorted(map(str, urls.judge(pages, ties).collect())) == tied
    monkeypatch.setattr(urls, "MOST_LITERALS", 500)
    rest = [("block", f"host{i}.test", "/") for i in range(5_001)]
    assert sorted(map(str, urls.judge(pages, [*URL_RULES, *rest]).collect())) == few
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "http://x.host5000.test/", "<p>" * 300_000)], "page_id long, url string, html string"), rest).collect()} == {"block"}


def test_links_of_repeated_urls_add_up(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(1, "http://x.org/", link("http://y.org/")), (2, "http://x.org/", link("http://a.net/fr/")), (3, "http://y.org/", None)]
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()} == {"block"}


def test_url_links_given(spark, pages):
    links = spark.createDataFrame([("http://clean.org/", "http://a.net/fr/x")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, URL_RULES, links).collect()}
    assert got[8] == "block"


def test_language(spark):
    rows = {r["doc_id"]: r for r in queries()["op2_langid"](spark, SMALL).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in rows.items())
    held = [k for k, r in rows.items() if r["held_out"]]
    assert sum(rows[k]["lang_pred"] == docs[k]["lang"] for k in held) >= 0.95 * len(held)


def test_a_rare_language_is_learned(spark):
    """Five labelled rows among 60,000."""
    many = spark.range(60_000).select(F.lit("en").alias("lang"), F.concat(F.lit("the cat and the dog of house "), F.col("id").cast("string")).alias("text"))
    few = spark.range(5).select(F.lit("fr").alias("lang"), F.concat(F.lit("le chat et la maison du chien "), F.col("id").cast("string")).alias("text"))
    model = langid.fit(many.union(few))
    assert model.languages == ["en", "fr"]
    docs = spark.createDataFrame([(1, "la maison du chat"), (2, "the house of the cat")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()} == {1: "fr", 2: "en"}


def test_language_cases(spark):
    train = spark.createDataFrame([("en", "the cat and the dog of the house")] * 20 + [("fr", "le chat et la maison du chien")] * 20 + [(None, "x"), ("en", None)], "lang string, text string")
    model = langid.fit(train)
    cases = [(1, "the house", 0.0), (2, "la maison", 0.0), (3, None, 0.0), (4, "", 0.0), (5, "123 !?", 0.0), (6, "the dog " * 40_000, 0.0), (None, "le chien", 0.0), (1, "the house", 0.0), (7, "日本", 0.0)]
    docs = spark.createDataFrame(cases, "doc_id long, text string, score double")
    got = langid.predict(docs, model).collect()
    by = collections.Counter((r["doc_id"], r["lang_pred"]) for r in got)
    assert by[1, "en"] == 2 and by[2, "fr"] == by[3, "und"] == by[4, "und"] == by[5, "und"] == by[6, "en"] == by[None, "fr"] == 1 and len(got) == 9
    assert langid.fit(train.where("false")) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0
    # languages that code a text equally long: the first by name
    twins = langid.fit(spark.createDataFrame([(k, "one text for both") for k in ("b", "a")], "lang string, text string"))
    assert [r["lang_pred"] for r in langid.predict(docs.limit(1), twins).collect()] == ["a"]


class PlainPpm:
    """Prediction by partial matching as it is defined, byte by byte."""

    def __init__(self, texts):
        self.counts = collections.defaultdict(collections.Counter)
        for text in texts:
            b = b"   " + text.encode()
            for i in range(3, len(b)):
                for k in range(4):
                    self.counts[b[i - k : i]][b[i]] += 1

    def probability(self, context, byte):
        lower = (lambda x: self.probability(context[1:], x)) if context else (lambda x: 1 / 256)
        if context not in self.counts:
            return lower(byte)
        counts = self.counts[context]
        n, d, left = sum(counts.values()), len(counts), 1 - sum(lower(x) for x in counts)
        if byte in counts:
            return counts[byte] / (n + d if left > 1e-9 else n)
        return d / (n + d) * lower(byte) / left

    def nats(self, text):
        b = b"   " + text.encode()
        return -sum(np.log(self.probability(b[i - 3 : i], b[i])) for i in range(3, len(b)))


@pytest.mark.parametrize("dense", [24 << 20, 1])
def test_code_lengths_equal_plain_prediction(spark, monkeypatch, dense):
    """With and without a dense table: every context of every language counts, none is cut."""
    monkeypatch.setattr(langid, "DENSE_BYTES", dense)
    rows = [(r["lang"], r["text"][:300]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and text is not null").limit(40).collect()]
    batches = langid.grams(iter([pa.RecordBatch.from_pydict({"lang": [k for k, _ in rows], "text": [t for _, t in rows]})]))
    counted = pd.concat([b.to_pandas() for b in batches]).groupby(["lang", "gram"], as_index=False)["n"].sum()
    model = langid.build(counted, sorted({k for k, _ in rows}))
    plain = {k: PlainPpm([t for x, t in rows if x == k]) for k in model.languages}
    texts = ["the house", "日本 x", "", "zz~~ £ qq", rows[3][1][:120], rows[7][1][50:150]]
    raw, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert np.allclose(model.code_lengths(raw, off), [[plain[k].nats(t) for k in model.languages] for t in texts], atol=1e-3)


def test_unknown_languages_are_rejected(spark):
    import corpus_pipeline

    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    alien = base.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit("Быстрая лиса прыгает через ленивую собаку и бежит дальше. " * 20), "lang": F.lit(None).cast("string")})
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, base.union(alien), SMALL).collect()}
    with_letters = {r["doc_id"] for r in base.where(F.col("text").rlike("\\p{L}")).collect()}
    assert 10**9 not in kept and len(with_letters - kept) <= 0.01 * len(with_letters)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \n\t", "a", "x " * 7, "x " * 8, "x " * 9, "a b c d e f g h i a b c d e f g h", "one\n\n one\none\n two #|<", "é\u00a0ü z", "long" * 50_000, "w%d " % 1 * 30 + "\nq"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "x", 9), (3, "a", 9)], "doc_id long, text string, kept int")
    rows = quality.judge(docs, []).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"])
    assert quality.judge(docs.where("false"), []).count() == 0


def test_quality_query(spark):
    """Counts, base rules and the learned list of the query, replayed in plain Python."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = quality.fit(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = queries()["op9_quality"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = counts(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and replay(rules, docs[r["doc_id"]]))


def replay(rules, text):
    n, chars, symbols, lines, repeated = counts(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars = max(n, 1), max(chars, 1)
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
    value = {
        "words": len(words), "word_length": chars / n if words else 0, "symbols": symbols / chars, "repeated_lines": lines / n, "repeated_words": repeated / n,
        "distinct_words": len(set(words)) / n, "capitals": upper / chars, "exclamations": (text or "").count("!") / chars, "bars": (text or "").count("|") / chars,
    }
    return not any(all((value[c.statistic] >= c.threshold) == c.above for c in rule) for rule in rules)


def test_decision_list(spark):
    words = " ".join(f"word{i}" for i in range(40))
    good, bad = [(i, words + f" tail{i}") for i in range(200)], [(1000 + i, words + " ### %%% " * (5 + i % 5)) for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (5, None), (99999, 0)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    kept = {r["doc_id"] for r in docs.where(quality.stays(docs["text"], rules)).collect()}
    assert kept == {i for i, _ in good}
    assert quality.fit(docs, labels.where("false")) == [] == quality.fit(docs.where("false"), labels)
    assert "Python" not in quality.judge(docs, rules)._jdf.queryExecution().toString()


def test_rules_of_several_conditions_in_order(spark):
    """Bad are texts with both symbols and capitals, and very short words; each alone with symbols or capitals is good."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1200):
        symbols, capitals, short = rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.2
        words = [("ab" if short else f"word{rng.integers(10**6)}x") + str(k) for k in range(40)]
        words = [("#" if symbols and k % 4 == 0 else "") + (w.upper() if capitals and k % 3 == 0 else w) for k, w in enumerate(words)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not (symbols and capitals or short))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(rules) >= 2 and any(len(rule) > 1 for rule in rules)
    kept = {r["doc_id"] for r in docs.where(quality.stays(docs["text"], rules)).collect()}
    assert kept == {i for i, text in rows if replay(rules, text)}
    assert sum((i in kept) == bool(y) for i, y in labels) >= 0.97 * len(labels)


def test_conditions_that_do_not_hold_out_are_pruned():
    """A second condition that helps while growing only goes: the held-out rows don't speak for it."""
    names, cuts = ["a", "b"], {"a": [1.0], "b": [1.0]}
    grow = [(True, True, (1, 1), 40), (True, False, (1, 0), 1), (True, False, (0, 0), 100), (True, False, (0, 1), 100)]
    prune = [(False, True, (1, 0), 30), (False, True, (1, 1), 1), (False, False, (0, 0), 60)]
    rules = quality.cover(grow + prune, names, cuts)
    assert rules[0] == (quality.Condition("a", True, 1.0),)
