"""Numpy views of Arrow text columns: chunks of bounded size, word spans and 64-bit span hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own, and its hashes are made block by block.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []
#: Caches that tasks of an operator leave in a worker process, and how to empty them.
CACHES: list = []

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def make_room(*keep) -> None:
    """Called at the start of tasks: empty the caches that other operators' tasks left in this worker, but for
    ``keep``, and give unused memory back to the system."""
    for cache in CACHES:
        if cache not in keep:
            cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into slices of about ``limit`` bytes of text, each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for base in (BASE, inverse):
            table = np.full(CHUNK + 1, base, np.uint64)
            table[0] = 1
            _POW.append(np.multiply.accumulate(table))
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running polynomial sum, made block by block, then mixed."""
    power, inverse = _powers()
    head, tail = np.empty(len(starts), np.uint64), np.empty(len(ends), np.uint64)
    sums, carry, scale = np.empty(CHUNK + 1, np.uint64), np.uint64(0), np.uint64(1)
    undo, unscale = np.empty(len(starts), np.uint64), np.uint64(1)
    for at in range(0, max(len(raw), 1), CHUNK):
        block = raw[at : at + CHUNK]
        n = len(block)
        sums[0] = carry
        np.multiply(block.astype(np.uint64) + np.uint64(1), power[:n] * scale if at else power[:n], out=sums[1 : n + 1])
        np.add.accumulate(sums[: n + 1], out=sums[: n + 1])
        a, b = np.searchsorted(starts, (at, at + n if at + n < len(raw) else at + n + 1))
        head[a:b] = sums[starts[a:b] - at]
        undo[a:b] = inverse[starts[a:b] - at] * unscale
        a, b = np.searchsorted(ends, (at + (at > 0), at + n + 1))
        tail[a:b] = sums[ends[a:b] - at]
        carry, scale, unscale = sums[n], scale * power[CHUNK], unscale * inverse[CHUNK]
    return mix((tail - head) * undo)


def word_spans(raw: np.ndarray, off: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and n + 1 word offsets by text; ``between`` marks the
    bytes outside words, by default those of ``[\\x20\\x09-\\x0D]``."""
    inside = ~between[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper * np.uint8(32)).astype(np.uint8)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length of each span, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
