"""Best-fit packing of tokenized documents into sequences, over several capacities at once.

Documents become pieces of at most ``max_tokens`` ids. Pieces are dealt evenly into groups of about GROUP sequences,
so no task grows with the input; a group's last sequences are all that is lost against one packing of everything.
Within a group, longest first, each piece goes to the open sequence that fits it best: of the sequences whose
residual tokens, documents and attention cost (the sum of squared lengths) all suffice, the one with the largest
weighted dot product of demand and residual, or the one that is left with the smallest weighted residual norm.

Defined results: null text is empty and is a piece of the end id alone; repeated rows are packed each; ids may be
null; pieces of equal length are taken in any order; an empty table gives an empty result; a text of any length is cut,
nothing else is; cut() ignores other columns, pack() keeps them but replaces sequence_id and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.arrays import chunks, make_room
from edgelake.llm.bpe import binary_slices, by_library, encoder, vocabulary
from edgelake.llm.shared import Tables, bound_batches

#: Full sequences that a group of pieces would fill, and pieces of a group at most, about.
GROUP, PIECES = 1024, 100_000


def cut(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids: ``id_col``, piece, start, length, ids (binary, little-endian unsigned 32 bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(encoder, vocabulary)
        encode = encoder(tokenizer, by_library)
        for rows, raw, off in chunks(batches):
            ids, bounds = encode(raw, off)
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            n = -(-np.diff(bounds) // max_tokens)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * max_tokens
            at = bounds[doc] + start
            length = np.minimum(max_tokens, bounds[doc + 1] - at)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), binary_slices(ids, np.append(at, bounds[-1]))],
                ["id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights: tuple[float, float, float], by: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece; lengths must not increase."""
    need = np.stack([lengths / max_tokens, np.full(len(lengths), 1 / max_docs), lengths.astype(float) ** 2 / max_cost], 1)
    left, used = np.ones((64, 3)), np.zeros(64, np.int64)
    name, opened, live = np.zeros(64, np.int64), 0, 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    w, slack = np.array(weights), 1e-9
    least = need.min(0) if len(need) else w
    for i, d in enumerate(need):
        room = left[:live] - d
        fits = (room >= -slack).all(1)
        if fits.any():
            score = -(left[:live] @ (w * d)) if by == "dot" else (room * room) @ w
            at = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            if live == len(left):
                left, used, name = np.concatenate([left, np.ones_like(left)]), np.concatenate([used, np.zeros_like(used)]), np.concatenate([name, np.zeros_like(name)])
            at = live
            left[at], used[at], name[at] = 1, 0, opened
            live, opened = live + 1, opened + 1
        sequence[i], offset[i] = name[at], used[at]
        left[at] -= d
        used[at] += lengths[i]
        if (left[at] < least - slack).any():  # no piece fits any more
            live -= 1
            left[at], used[at], name[at] = left[live], used[live], name[live]
    return sequence, offset


def pack(
    pieces: DataFrame,
    max_tokens: int,
    max_docs: int | None = None,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    by: str = "norm",
) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with a column ``length``.

    Unless given, the limits on documents and attention cost are those that the tokens imply.
    """
    total, n = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, round((total or 0) / (max_tokens * GROUP)), -(-n // PIECES))
    docs_limit, cost_limit = max_docs or max_tokens, max_cost or float(max_tokens) ** 2
    if cost_limit < max_tokens**2:
        raise ValueError("a sequence must be able to hold one whole piece")
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length", ascending=False, kind="stable")
        sequence, offset = best_fit(pdf["length"].to_numpy(), max_tokens, docs_limit, cost_limit, weights, by)
        group = int(pdf["_group"].iloc[0]) if len(pdf) else 0
        return pdf[names].assign(sequence_id=group * (1 << 32) + sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    dealt = pieces.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("_group"))
    return dealt.groupBy("_group").applyInPandas(work, schema)


def cut_and_pack(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset. The ids are not kept; cut() gives them again."""
    pieces = cut(docs, tokenizer, end_id, max_tokens, id_col, text_col).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    tables = Tables()
    return tables.result(pack(tables.write(pieces, "pieces"), max_tokens, **limits), "packed")
