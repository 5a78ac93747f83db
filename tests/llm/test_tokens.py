"""Encoding, counting, files and packing against the tokenizers library."""

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgelake.llm import bpe, packing, token_counts, token_files
from edgelake.llm.shared import new_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "a", "it's we'll 'tis '' 's  x\n\n y  \n", "don't've''s 123 4５6 éß ñ ΑΣ", "<|endoftext|> a <|endoftext|>b", "ab" * 3000, "\t\ttab \r\n x", "😀 hi 日本語", "İstanbul ΣΑΣ é", "x <|startoftext|>",
    "the same", "the same", "\x1c \x85 z", "word " * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", -i) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 0), (3, TEXTS[3], "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


@functools.cache
def library(path):
    made = Tokenizer.from_file(path)
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def test_encode_and_decode(docs):
    ids, made = library(BYTES), Tokenizer.from_file(BYTES)
    rows = bpe.encode_decode(docs, BYTES).collect()
    assert len(rows) == len(TEXTS) + 2
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        want = ids(text[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == made.decode(want, skip_special_tokens=False)


def test_counts(docs):
    ids, text = library(BYTES), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts.count_tokens(docs, BYTES).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (len(ids(text[r["doc_id"]])), len((text[r["doc_id"]] or "").encode()))
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, WORDS)


RARE = "😀 hi👩‍👩‍👧 x1 ٣४5 𝟘𝟙 日本語 한국어 Ἀθῆναι İstanbul ΣΑΣ ﬁ \u0378 ꟊa 𐕰b 𞤀 \u3000z\u2028q ''s 😀's it'ꟊ"


def test_no_text_goes_whole_to_the_library(monkeypatch):
    """Emoji, newer scripts and unassigned code points, with the library's encoders out of reach."""
    want, counted = library(BYTES)(RARE), len(library(BYTES)(RARE))
    vocab = bpe.Vocabulary(BYTES)
    monkeypatch.setattr(bpe.Vocabulary, "library", property(lambda _: pytest.fail("the library was asked")))
    raw = np.frombuffer(RARE.encode(), np.uint8)
    off = np.array([0, len(raw)])
    assert bpe.Encoder(vocab, bpe.by_tree)(raw, off)[0].tolist() == want
    assert token_counts.TokenCounter(vocab)(raw, off).tolist() == [counted]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_code_points(text):
    raw = np.frombuffer(text.encode(errors="ignore"), np.uint8)
    text, off = raw.tobytes().decode(), np.array([0, len(raw)])
    for path, ways in ((BYTES, (bpe.by_tree,)), (WORDS, (bpe.by_tree, bpe.by_library))):
        want = library(path)(text)
        for way in ways:
            assert bpe.Encoder(bpe.vocabulary(path), way)(raw, off)[0].tolist() == want
    assert int(token_counts.TokenCounter(bpe.vocabulary(BYTES))(raw, off)[0]) == len(library(BYTES)(text))


def test_memo_is_bounded():
    memo, made = bpe.Memo(most=10, most_ids=1000), []

    def take(keys):
        def make(at):
            made.extend(keys[i] for i in at)
            return np.array([keys[i] % 4 for i in at]), np.concatenate([np.full(keys[i] % 4, keys[i], np.uint32) for i in at])

        first, length, flat = memo.take(np.array(keys, np.uint64), make)
        assert [flat[a : a + n].tolist() for a, n in zip(first, length, strict=True)] == [[k] * (k % 4) for k in keys]

    for at in range(0, 100, 5):
        take([99, *range(at, at + 5)] if at < 95 else [99])
        take([at, 99])
        assert len(memo.young.keys) <= 16
    assert made.count(99) == 1 and made.count(3) == 1  # what is used stays
    take([3])
    assert made.count(3) == 2


def test_files(spark, docs):
    path, ids = new_path(spark, "test"), library(BYTES)
    shards = token_files.write_files(docs, path, BYTES, 0)
    rows = token_files.read_files(spark, path, shards).orderBy("start").collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted([(-1 if i is None else i) for i in [*text, 3]])
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in rows] == order
    start = 0
    for r in rows:
        want = [*ids(text[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (start, len(want), want)
        start += len(want)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert bpe.encode_decode(none, BYTES).count() == token_counts.count_tokens(none, BYTES).count() == 0
    path = new_path(spark, "none")
    assert token_files.read_files(spark, path, token_files.write_files(none, path, BYTES, 0)).count() == 0
    assert packing.cut_and_pack(none, WORDS, 1, 16).count() == 0


def test_packing(docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    once = docs.dropDuplicates(["doc_id"])
    check_packed(packing.cut_and_pack(once, WORDS, end_id=1, max_tokens=64).collect(), text, 64)
    pieces = lambda rows: sum(r["length"] for r in rows)
    twice = packing.cut_and_pack(docs, WORDS, end_id=1, max_tokens=64).collect()
    assert pieces(twice) == pieces(packing.cut_and_pack(once.union(docs.where("doc_id = 3").limit(1)), WORDS, end_id=1, max_tokens=64).collect())


def test_packing_limits(spark):
    """Limits on documents and attention cost that bind, through pack(); and many tiny pieces in several groups."""
    rows = spark.createDataFrame([(i, 10 if i % 3 else 60, i) for i in range(300)], "doc_id long, length long, offset long")
    for by in ("dot", "norm"):
        got = packing.pack(rows, 100, max_docs=4, max_cost=10_000.0, by=by).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t"), F.sum(F.col("length") ** 2).alias("c")).collect()
        assert all(r["n"] <= 4 and r["t"] <= 100 and r["c"] <= 10_000 for r in got) and sum(r["n"] for r in got) == 300
        assert len(got) <= 110
    with pytest.raises(ValueError):
        packing.pack(rows, 100, max_cost=5.0)


def test_tiny_pieces_are_dealt_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 50)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("length"))
    got = packing.pack(rows, 4096).collect()
    assert len({r["sequence_id"] for r in got}) > 1 and len(got) == 400


def plain_best_fit(lengths, tokens, docs, cost, weights, by):
    """Best fit as it is defined: all sequences stay open."""
    bins, out = [], []
    for length in lengths:
        need = np.array([length / tokens, 1 / docs, length**2 / cost])
        fit = [(k, left) for k, left in enumerate(bins) if (left - need >= -1e-9).all()]
        if fit:
            score = (lambda left: -(left * need * weights).sum()) if by == "dot" else (lambda left: ((left - need) ** 2 * weights).sum())
            k = min(fit, key=lambda x: round(score(x[1]), 9))[0]
        else:
            k = len(bins)
            bins.append(np.ones(3))
        bins[k] = bins[k] - need
        out.append(k)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.integers(2, 6), st.sampled_from(["dot", "norm"]), st.floats(10_000, 40_000))
def test_best_fit_needs_as_many_sequences_as_the_plain_one(lengths, docs, by, cost):
    lengths = np.sort(np.array(lengths, np.int64))[::-1]
    sequence, _ = packing.best_fit(lengths, 100, docs, cost, (1.0, 0.1, 0.1), by)
    # ties between sequences may fall otherwise
    assert abs(len(set(sequence.tolist())) - plain_best_fit(lengths.tolist(), 100, docs, cost, np.array([1.0, 0.1, 0.1]), by)) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 6), st.sampled_from(["dot", "norm"]), st.floats(10_000, 40_000))
def test_best_fit_respects_every_capacity(lengths, docs, by, cost):
    lengths = np.sort(np.array(lengths, np.int64))[::-1]
    sequence, offset = packing.best_fit(lengths, 100, docs, cost, (1.0, 0.1, 0.1), by)
    for s in set(sequence.tolist()):
        at = np.flatnonzero(sequence == s)
        assert lengths[at].sum() <= 100 and len(at) <= docs and (lengths[at] ** 2).sum() <= cost * (1 + 1e-6)
        assert sorted(offset[at]) == sorted((np.cumsum(lengths[at]) - lengths[at]).tolist())


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abst're mdl'v  \n\t1,.éßñ'<|endoftext|>", max_size=80))
def test_any_text(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(raw)])
    for path in (BYTES, WORDS):
        want = library(path)(text)
        for way in (bpe.by_tree, bpe.by_library):
            assert bpe.Encoder(bpe.vocabulary(path), way)(raw, off)[0].tolist() == want
    assert int(token_counts.TokenCounter(bpe.vocabulary(BYTES))(raw, off)[0]) == len(library(BYTES)(text))


def test_queries_give_the_contracts_columns(spark):
    from edgelake.llm.queries import queries

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids, made = library(BYTES), Tokenizer.from_file(BYTES)
    for r in queries()["op5_bpe"](spark, d).collect():
        want = ids(docs[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(made.decode(want, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for r in queries()["op7_token_files"](spark, d).orderBy("doc_id").collect():
        want = np.array([*ids(docs[r["doc_id"]]), 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    for r in queries()["op8_token_counts"](spark, d).collect():
        n = len(ids(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)
    check_packed(queries()["op4_packing"](spark, d).collect(), docs, 4096)


def check_packed(rows, docs, size):
    ids, by_doc, by_sequence = library(WORDS), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == docs.keys()
    for doc, pieces in by_doc.items():
        want = np.array([*ids(docs[doc]), 1], "<u4")
        assert sorted(pieces) == list(range(-(-len(want) // size)))
        for i, r in pieces.items():
            part = want[size * i : size * (i + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (size * i, len(part), zlib.crc32(part.tobytes()))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // size) + 2
