"""Importance resampling towards a target: documents are weighed by hashed n-gram counts of a target corpus against all
documents, and drawn without replacement by perturbed scores.

Features are runs of 1 to ``ngrams`` consecutive words, words being runs of ASCII letters, digits and characters beyond
ASCII with A-Z in lower case. A feature's bucket is the CRC-32 of its UTF-8 bytes. A CRC is linear: every byte adds a
contribution by XOR that depends on the byte and its distance from the feature's end only, and the length adds a
constant. Contributions are looked up in a table of REACH distances, gathered for all features of a block of text and
folded by ``bitwise_xor.reduceat``. Features longer than REACH bytes are cut into blocks from their end, and
neighbouring blocks are merged pairwise, the earlier one advanced by the later one's length, in log2 of their number steps.

Counts of all rows are summed in each task before they are shuffled, so a task sends ``buckets`` rows at most whatever it
reads; the gains, ``buckets`` numbers, are all that passes the driver. Scores are whole numbers in a range that follows
from the logarithms of the counts (some ten thousands), so ranks come from a histogram of scores and, within a score, from
the order of ids: no sort goes through one task.

Defined results: texts that are null or without a word have no feature and weight 0; a text may be of any length; repeated
rows count and are drawn as rows of their own; rows with a null id are counted in the corpus but have no score and are
never drawn; equal scores go to smaller ids; an empty table, or an empty target, gives counts of zero; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.arrays import chunks, gather, lower, make_room, word_spans
from edgelake.llm.shared import Tables, bound_batches, small

#: Distances from a feature's end that the table holds, and bytes of features that are gathered at once.
REACH, BLOCK = 64, 1 << 19

BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def single_bytes() -> np.ndarray:
    """What a byte at a feature's end adds to the CRC."""
    zero = zlib.crc32(b"\0")
    return np.array([zlib.crc32(bytes([b])) ^ zero for b in range(256)], np.uint32)


def advance(values: np.ndarray) -> np.ndarray:
    """Contributions after one more byte follows."""
    return (values >> np.uint32(8)) ^ LAST[values & np.uint32(255)]


LAST = single_bytes()


def position_table() -> np.ndarray:
    rows = [LAST]
    for _ in range(REACH - 1):
        rows.append(advance(rows[-1]))
    return np.stack(rows)


#: [distance from the end, byte] -> contribution; and the CRC of so many zero bytes, which holds the constant of a length.
POSITIONS = position_table()
CONSTANTS = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
#: [r][byte of a value, byte]: the value after REACH * 2**r more bytes, made when a feature first needs it.
_JUMPS: list[np.ndarray] = []


def jumped(values: np.ndarray, step: int) -> np.ndarray:
    """Contributions after REACH * 2**step more bytes."""
    while len(_JUMPS) <= step:
        bits = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
        if _JUMPS:
            bits = jumped(jumped(bits.ravel(), len(_JUMPS) - 1), len(_JUMPS) - 1).reshape(4, 256)
        else:
            for _ in range(REACH):
                bits = advance(bits)
        _JUMPS.append(bits)
    table = _JUMPS[step]
    return table[0, values & np.uint32(255)] ^ table[1, (values >> np.uint32(8)) & np.uint32(255)] ^ table[2, (values >> np.uint32(16)) & np.uint32(255)] ^ table[3, values >> np.uint32(24)]


def contributions(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the bytes of spans of 1 to REACH bytes add to their CRCs."""
    out = np.empty(len(starts), np.uint32)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
        length, first = lengths[at:to], bounds[at:to] - bounds[at]
        distance = np.repeat(first + length - 1, length) - np.arange(bounds[to] - bounds[at])
        out[at:to] = np.bitwise_xor.reduceat(POSITIONS[distance, raw[gather(starts[at:to], length)]], first)
        at = to
    return out


def crc_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte spans (not empty) of ``raw``; spans may overlap."""
    lengths = ends - starts
    long = np.flatnonzero(lengths > REACH)
    if not len(long):
        return contributions(raw, starts, lengths) ^ CONSTANTS[lengths]
    out = np.empty(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= REACH)
    out[short] = contributions(raw, starts[short], lengths[short]) ^ CONSTANTS[lengths[short]]
    # blocks from the end: only a span's first block may be shorter than REACH
    count = -(-lengths[long] // REACH)
    span = np.repeat(np.arange(len(long)), count)
    back = np.repeat(np.cumsum(count), count) - np.arange(len(span))
    end = ends[long][span] - (back - 1) * REACH
    start = np.maximum(starts[long][span], end - REACH)
    values, zeros, step = contributions(raw, start, end - start), lengths[long], 0
    while (count > 1).any():
        first = np.cumsum(count) - count
        values = np.insert(values, first[count % 2 == 1], np.uint32(0))  # an empty block in front adds nothing
        count = -(-count // 2)
        values = jumped(values[0::2], step) ^ values[1::2]
        step += 1
    out[long] = values ^ zero_crcs(zeros)
    return out


def zero_crcs(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes, the constant of a length."""
    distinct, at = np.unique(lengths, return_inverse=True)
    found = np.empty(len(distinct), np.uint32)
    for i, n in enumerate(distinct.tolist()):
        value = np.array([CONSTANTS[n % REACH] ^ np.uint32(0xFFFFFFFF)], np.uint32)
        for step in range((n // REACH).bit_length()):
            if (n // REACH) >> step & 1:
                value = jumped(value, step)
        found[i] = value[0] ^ np.uint32(0xFFFFFFFF)
    return found[at]


def features(raw: np.ndarray, off: np.ndarray, ngrams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of the features of texts laid end to end, the text of each, and the number of words by text."""
    raw = lower(raw)
    starts, ends, bounds = word_spans(raw, off, BETWEEN)
    words, text = np.diff(bounds), np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    if ngrams == 1:
        return crc_spans(raw, starts, ends), text, words
    # words joined by one space: a run of words is a span of this
    lengths, source = ends - starts, starts
    joined = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    mask = np.ones(len(joined), bool)
    mask[ends] = False
    joined[mask] = raw[gather(source, lengths)]
    found, of = [], []
    for n in range(1, ngrams + 1):
        at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
        found.append(crc_spans(joined, starts[at], ends[at + n - 1]))
        of.append(text[at])
    return np.concatenate(found), np.concatenate(of), words


def bucket_counts(texts: DataFrame, text_col: str, ngrams: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows by bucket, summed in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        total = np.zeros(buckets, np.int64)
        for _, raw, off in chunks(batches, text=0):
            crc, _, _ = features(raw, off, ngrams)
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """By bucket, 1000 times the log ratio of the smoothed shares of ``target`` and ``raw`` (bucket, n), rounded down."""
    s, t = raw.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()  # ``buckets`` rows at most
    a, b = np.zeros(buckets), np.zeros(buckets)
    for r in both:
        a[r["bucket"]], b[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((b + 1) * (a.sum() + buckets) / ((a + 1) * (b.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, ngrams: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: weight is the mean of the gains of its features, rounded down."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for rows, raw, off in chunks(batches):
            crc, text, words = features(raw, off, ngrams)
            n = np.bincount(text, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, text, gains[crc % np.uint32(len(gains))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """1000 times a draw from the Gumbel distribution, rounded down, from a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(rows: DataFrame, percent: int, least_words: int, tables: Tables) -> DataFrame:
    """Add rank (1, 2, … from the highest score; null if not drawn) to a written table (id, n_words, n_features, weight, score)."""
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    scores = tables.write(rows.where(able).groupBy("score").agg(F.count("*").alias("n")), "scores")
    most = percent * (scores.agg(F.sum("n")).first()[0] or 0) // 100
    # a row for each distinct score
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = tables.write(scores.withColumn("before", before).where(F.col("before") < most).select("score", "before"), "high")
    ranked = rows.where(able).join(small(high), "score")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id", "weight", "n_features"))
    names = ["id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.withColumn("place", place).select(*names, F.when(F.col("place") <= most, F.col("place")).cast("long").alias("rank"))
    lowest = high.agg(F.min("score")).first()[0]
    low = rows.where(~F.coalesce(able & (F.col("score") >= F.lit(lowest)), F.lit(False))) if lowest is not None else rows
    return ranked.union(low.select(*names, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_features, weight, score, rank (null if not drawn) and n_words.

    ``percent`` of the rows with ``least_words`` words are drawn, rounded down; ``target`` holds texts in ``text_col``.
    """
    bound_batches(docs.sparkSession)
    tables = Tables()
    gains = bucket_gains(bucket_counts(docs, text_col, ngrams, buckets), bucket_counts(target, text_col, ngrams, buckets), buckets)
    rows = tables.write(weights(docs, gains, id_col, text_col, ngrams).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    out = drawn(rows, percent, least_words, tables)
    return tables.result(out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words"), "resampled")
