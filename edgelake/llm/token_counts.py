"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a chunk are one ragged array of symbols. Each round finds every sequence's lowest pair
rank and merges all its occurrences at once, from the left; sequences without a mergeable pair leave. What
survives is counted.

Defined results: null is the empty text with 0 bytes and 0 tokens; a special string counts as one token, as in the
library's default; a text of any length is counted whole, also one without a space; each of repeated rows gets the
result of its text, ids may be null or repeated; columns of other names are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.arrays import CACHES, chunks, gather, hash_spans, make_room
from edgelake.llm.bpe import Memo, Vocabulary, pre_tokens, vocabulary
from edgelake.llm.shared import bound_batches

NONE = np.int64(1) << np.int64(60)


class Merger:
    """Merge ranks as sorted arrays, for batched lookup."""

    def __init__(self, vocab: Vocabulary):
        self.base = np.int64(vocab.size)
        keys = np.array([a * vocab.size + b for a, b in vocab.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = np.array([*vocab.merges.values()], np.int64).reshape(-1, 2)[order].T
        self.first = np.array(vocab.first, np.int64)

    def rank(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE), self.made[at]

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence after all merges."""
        out, own = lengths.copy(), np.arange(len(lengths))
        while len(own):
            first = np.cumsum(lengths) - lengths
            pairs = np.empty(len(symbols), np.int64)
            pairs[:-1] = symbols[:-1] * self.base + symbols[1:]
            rank, made = self.rank(pairs)
            rank[first + lengths - 1] = NONE  # a sequence's last symbol begins no pair
            low = np.minimum.reduceat(rank, first)
            open_ = low < NONE
            if not open_.all():
                out[own[~open_]] = lengths[~open_]
                keep = np.repeat(open_, lengths)
                symbols, rank, made = symbols[keep], rank[keep], made[keep]
                own, lengths, low = own[open_], lengths[open_], low[open_]
                if not len(own):
                    break
            hit = rank == np.repeat(low, lengths)
            # of a row of overlapping occurrences, every second one merges, from the left
            at = np.flatnonzero(hit)
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            head = np.flatnonzero(new)
            place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sequence = np.repeat(np.arange(len(own)), lengths)
            lengths = lengths - np.bincount(sequence[at], minlength=len(own))
            symbols = symbols[keep]
        return out


class TokenCounter:
    """Counts the tokens of chunks of texts; remembers the counts of pre-tokens seen lately."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.merger, self.known = vocab, Merger(vocab), Memo()
        self.specials = [t.encode() for t in vocab.special]

    def plain(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens by text, special strings taken as text."""
        at, to = pre_tokens(raw, off, self.vocab)
        codes, distinct = pd.factorize(hash_spans(raw, at, to))

        def make(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            seen = np.full(len(distinct), -1)
            seen[codes[::-1]] = np.arange(len(codes))[::-1]
            place = seen[missing]
            size = to[place] - at[place]
            return self.merger.count(self.merger.first[raw[gather(at[place], size)]], size), np.zeros(0, np.uint32)

        _, each, _ = self.known.take(distinct, make)
        return np.diff(np.concatenate([[0], np.cumsum(each[codes])])[np.searchsorted(at, off)])

    def with_special(self, text: bytes) -> int:
        """Tokens of one text that holds special strings."""
        total = 0
        for part in self.vocab.split_special.split(text.decode()):
            data = np.frombuffer(part.encode(), np.uint8)
            total += part in self.vocab.special or (int(self.plain(data, np.array([0, len(data)]))[0]) if len(data) else 0)
        return total

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, data = self.plain(raw, off), raw.tobytes()
        if any(t in data for t in self.specials):
            for i in range(len(n)):
                text = data[off[i] : off[i + 1]]
                if any(t in text for t in self.specials):
                    n[i] = self.with_special(text)
        return n


@lru_cache(1)
def counter(path: str) -> TokenCounter:
    """One counter in each worker process."""
    return TokenCounter(vocabulary(path))


CACHES.append(counter)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes and n_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    if vocabulary(tokenizer).words_only:
        raise ValueError("counts are for byte-level vocabularies without word ends")
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(counter, vocabulary)
        count = counter(tokenizer)
        for rows, raw, off in chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off), pa.int64()), pa.array(count(raw, off), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
