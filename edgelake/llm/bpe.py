"""Byte-pair encoding and decoding with public vocabulary files.

A chunk of texts becomes pre-tokens by array operations; each distinct pre-token is then encoded once. The
encoder here keeps a segment tree over the ranks of adjacent pairs: its root names the leftmost pair of lowest
rank, and each merge updates three leaves in logarithmic time, until no pair can be merged.

Defined results: null is the empty text (no ids); repeated rows give repeated results; a text without spaces is
one pre-token of any length; strings of special tokens inside a text become their ids, as the library does by
default. The class of a code point (letter, number, white, other) is learned once in each worker from the
vocabulary's own pre-tokenizer, so that it is the library's whatever the Unicode version. Pre-tokens are told apart
by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from edgelake.llm.arrays import CACHES, chunks, gather, hash_spans, make_room
from edgelake.llm.shared import bound_batches

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Distinct pre-tokens in each of the two generations that a worker remembers, about, and ids of all of them.
MEMO, MEMO_IDS = 300_000, 3_000_000


class Shelf:
    """Lists of ids by 64-bit key, as arrays: a few dozen bytes an entry."""

    def __init__(self):
        self.keys, self.first, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for those not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        """Add entries whose ids lie end to end in ``flat``; without ids, lengths are all that is kept."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        first = np.cumsum(length) - length + len(self.flat)
        self.keys, self.first, self.length = (np.insert(old, at, new[order]) for old, new in ((self.keys, keys), (self.first, first), (self.length, length)))
        self.flat = np.concatenate([self.flat, flat])


class Memo:
    """What is known of pre-tokens, bounded: when the young shelf is full it becomes the old one, and the old one goes."""

    def __init__(self, most: int = MEMO, most_ids: int = MEMO_IDS):
        self.most, self.most_ids, self.young, self.old = most, most_ids, Shelf(), Shelf()

    def take(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, length, flat) of different keys; ``make`` gives the lengths and ids of those at the given places."""
        if len(self.young.keys) > self.most or len(self.young.flat) > self.most_ids:
            self.old, self.young = self.young, Shelf()
        new = np.flatnonzero(self.young.index(keys) < 0)
        if len(new):
            at = self.old.index(keys[new])
            known = at[at >= 0]
            self.young.add(keys[new[at >= 0]], self.old.length[known], self.old.flat[gather(self.old.first[known], self.old.length[known])] if len(self.old.flat) else self.old.flat)
            if len(rest := new[at < 0]):
                self.young.add(keys[rest], *make(rest))
        at = self.young.index(keys)
        return self.young.first[at], self.young.length[at], self.young.flat


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids = model["vocab"]
        self.path = path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words_only = bool(self.suffix)
        self.first = [ids[letters[b]] for b in range(256)]
        self.last = [ids[letters[b] + self.suffix] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # the file's normalizer and pre-tokenizer, without its vocabulary
        bare = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": model | {"vocab": {}, "merges": []}}))
        self.normalize = bare.normalizer.normalize_str if bare.normalizer else str
        self.split = bare.pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.same: set[str] = set()  # characters that Python composes and lowers as the normalizer does
        self.other: set[str] = set()

    def model(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["model"]

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, id) of each pair of ids."""
        model, found = self.model(), {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            found[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        return found

    @cached_property
    def bytes(self) -> list[bytes]:
        """The bytes of each id."""
        back, found = {c: b for b, c in byte_letters().items()}, [b""] * self.size
        for token, i in self.model()["vocab"].items():
            found[i] = bytes(back[c] for c in token.removesuffix(self.suffix)) if not self.suffix else token.encode()
        for token, i in self.special.items():
            found[i] = token.encode()
        return found

    @cached_property
    def library(self) -> Tokenizer:
        """The library's merges alone, for pre-tokens that are normalized and split already."""
        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.normalizer = normalizers.Sequence([])
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return made

    def clean(self, text: str) -> str:
        """The text composed and in lower case, white space left alone; by the library itself if it has a character of which that isn't sure."""
        for c in set(text) - self.same - self.other:
            # compositions of characters as old as Unicode 3.2 are fixed
            sure = unicodedata.ucd_3_2_0.category(c) != "Cn" and (c.isspace() or self.normalize(c) == unicodedata.normalize("NFC", c).lower())
            (self.same if sure and c != "\u03a3" else self.other).add(c)
        return unicodedata.normalize("NFC", text).lower() if self.other.isdisjoint(text) else self.normalize(text)

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        """The classes of code points; those met for the first time are asked from the pre-tokenizer."""
        found = self.kinds[points]
        new = found == UNKNOWN
        if new.any():
            for point in np.unique(points[new]).tolist():
                self.kinds[point] = self.kind_of(chr(point))
            found = self.kinds[points]
        return found

    def kind_of(self, c: str) -> int:
        """A character's class, by what it forms one pre-token with."""
        if not self.split(c):
            return SPACE
        if len(self.split("a" + c)) == 1:
            return LETTER
        if len(self.split("!" + c)) == 1:
            return OTHER
        return NUMBER if len(self.split(c if self.words_only else "1" + c)) == 1 else SPACE

    def symbols(self, token: bytes) -> list[int]:
        out = [self.first[b] for b in token]
        out[-1] = self.last[token[-1]]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(path)


def merge_by_tree(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the leftmost lowest-rank pair until none is left, by a segment tree of minima over pair ranks."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = 1 << 60
    width = 1 << (n - 2).bit_length()
    # a leaf holds rank * width + position, so that equal ranks order by place
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if found := merges.get((symbols[i], symbols[i + 1])):
            tree[width + i] = found[0] * width + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    while (root := tree[1]) != none:
        at = root % width
        gone = after[at]
        symbols[at] = merges[symbols[at], symbols[gone]][1]
        follows = after[gone]
        after[at] = follows
        if gone < n - 1:
            put(gone, none)
        symbols[gone] = -1
        if follows < n:
            before[follows] = at
            found = merges.get((symbols[at], symbols[follows]))
            put(at, found[0] * width + at if found else none)
        else:
            put(at, none)
        if (left := before[at]) >= 0:
            found = merges.get((symbols[left], symbols[at]))
            put(left, found[0] * width + left if found else none)
    return [s for s in symbols if s >= 0]


def pre_tokens(raw: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of pre-tokens of texts laid end to end."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    head = raw[lead]
    kind = vocab.kinds_of(np.arange(128))[np.minimum(head, 127)]
    wide = np.flatnonzero(head >= 0x80)
    if len(wide):
        pad = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32) if len(raw) < 1 << 22 else None
        at, b = lead[wide], head[wide].astype(np.int32)
        tail = [((pad[at + k] if pad is not None else raw[np.minimum(at + k, len(raw) - 1)].astype(np.int32)) & 63) for k in (1, 2, 3)]
        point = np.where(b < 0xE0, (b & 31) << 6 | tail[0], np.where(b < 0xF0, (b & 15) << 12 | tail[0] << 6 | tail[1], (b & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        kind[wide] = vocab.kinds_of(point)
    n = len(lead)
    doc = np.searchsorted(lead, off)  # first character of each text
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[doc] = True
    edge[n] = True
    same = np.zeros(n, bool)  # of one class with the character before, in one text
    same[1:] = kind[1:] == kind[:-1]
    same[edge[:n]] = False
    start = ~same
    space = kind == SPACE
    quote = np.flatnonzero((head == 39) & start)
    if vocab.words_only:
        start |= kind == NUMBER
    else:
        joined = np.zeros(n, bool)  # the blank before goes with this run
        joined[1:] = (head[:-1] == 32) & ~space[1:] & ~edge[1:n]
        # the last white character before a run begins a token
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
        start = (start & ~joined) | last
        quote = quote[~joined[quote]]
    if len(quote):
        ends = np.append(doc, n)
        limit = ends[np.searchsorted(doc, quote, "right")]
        one = np.where(quote + 1 < limit, head[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 < limit, head[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        quote, limit, size = quote[short | long], limit[short | long], np.where(short, 2, 3)[short | long]
        start[quote + 1] = False
        rest = quote + size
        rest = rest[(rest < limit) & (kind[np.minimum(rest, n - 1)] == LETTER)]
        start[rest] = True
    first = np.flatnonzero(start)
    at = lead[first]
    to = np.append(at[1:], len(raw))
    if vocab.words_only:
        keep = ~space[first]
        at, to = at[keep], to[keep]
    return at, to


class Encoder:
    """Encodes chunks of texts; remembers the ids of pre-tokens seen lately."""

    def __init__(self, vocab: Vocabulary, encode_missing: Callable[[Vocabulary, list[bytes]], list[list[int]]]):
        self.vocab, self.encode_missing, self.memo = vocab, encode_missing, Memo()

    def of_tokens(self, raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token's code, ids of all codes end to end, start by code, length by code)."""
        codes, distinct = pd.factorize(hash_spans(raw, at, to))

        def make(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            seen = np.full(len(distinct), -1)
            seen[codes[::-1]] = np.arange(len(codes))[::-1]
            place, data = seen[missing], raw.tobytes()
            made = self.encode_missing(self.vocab, [data[a:b] for a, b in zip(at[place].tolist(), to[place].tolist(), strict=True)])
            return np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), np.uint32)

        first, length, flat = self.memo.take(distinct, make)
        return codes, flat, first, length

    def _clean(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Texts as the vocabulary's normalizer leaves them."""
        out = [text.lower() if text.isascii() else self.vocab.clean(text.decode()).encode() for text in texts]
        return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a chunk of texts end to end, and n + 1 offsets by text."""
        v, n = self.vocab, len(off) - 1
        data = raw.tobytes()
        special = [i for i in range(n) for s in [data[off[i] : off[i + 1]]] if any(t.encode() in s for t in v.special)] if any(t.encode() in data for t in v.special) else []
        source_raw, source_off = raw, off
        if v.words_only:
            raw, off = self._clean([data[off[i] : off[i + 1]] for i in range(n)])
        at, to = pre_tokens(raw, off, v)
        codes, flat, first, length = self.of_tokens(raw, at, to)
        ids = flat[gather(first[codes], length[codes])]
        bounds = np.concatenate([[0], np.cumsum(length[codes])])[np.searchsorted(at, off)]
        if special:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
            for i in special:
                parts[i] = self._around_special(bytes(source_raw[source_off[i] : source_off[i + 1]]).decode())
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds

    def _around_special(self, text: str) -> np.ndarray:
        v, out = self.vocab, []
        for part in v.split_special.split(text):
            if part in v.special:
                out.append(np.array([v.special[part]], np.uint32))
            elif part:
                data = part.encode()
                out.append(self(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def by_tree(vocab: Vocabulary, tokens: list[bytes]) -> list[list[int]]:
    return [merge_by_tree(vocab.symbols(t), vocab.merges) for t in tokens]


def by_library(vocab: Vocabulary, tokens: list[bytes]) -> list[list[int]]:
    """Encode distinct pre-tokens, which are valid UTF-8, with the tokenizers library."""
    made = vocab.library.encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)
    return [e.ids for e in made]


@lru_cache(1)
def encoder(path: str, encode_missing: Callable) -> Encoder:
    """One encoder in each worker process, so that tasks share what it remembers."""
    return Encoder(vocabulary(path), encode_missing)


CACHES += [encoder, vocabulary]


def decoder(vocab: Vocabulary) -> Callable[[np.ndarray, np.ndarray], list[str]]:
    """A function from ids end to end and offsets by text to decoded texts; broken UTF-8 becomes U+FFFD."""
    flat = np.frombuffer(b"".join(vocab.bytes), np.uint8)
    length = np.fromiter(map(len, vocab.bytes), np.int64, vocab.size)
    first = np.cumsum(length) - length

    def decode(ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        data = flat[gather(first[ids], length[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(length[ids])])[bounds]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    return decode


def binary_slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of slices of an array."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_tokens, ids (binary, little-endian unsigned 32 bit) and decoded (string)."""
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(encoder, vocabulary)
        encode, decode = encoder(tokenizer, by_tree), decoder(vocabulary(tokenizer))
        for rows, raw, off in chunks(batches):
            ids, bounds = encode(raw, off)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(bounds), pa.int64()), binary_slices(ids.astype("<u4"), bounds), pa.array(decode(ids, bounds), pa.string())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(work, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
