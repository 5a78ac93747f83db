"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

A data set is a folder of shards in ascending document order. ``NNNNN.bin`` holds ids end to end as little-endian
unsigned 16-bit integers, or 32-bit ones for vocabularies over 65,536. ``NNNNN.idx`` holds, as little-endian
64-bit integers, the width of an id in bytes, the number of documents n, n document ids and n + 1 offsets counted
in ids within the shard. A shard's base, the ids of all shards before it, is a prefix sum over the shards' totals.

A task writes its shard under another name and renames it at the end, so a task that runs twice, or whose executor
is lost, leaves one whole shard. Defined results: null text is empty and gets the end id alone; null ids come first
and are kept as the smallest 64-bit integer in the file, which as a real id reads back as null; repeated rows are
repeated documents, and documents of one id are ordered by a hash of their text; a text of any length is written whole;
other columns are ignored whatever their names; an empty table gives no shards. Ids must be integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from edgelake.llm.arrays import chunks, make_room
from edgelake.llm.bpe import binary_slices, by_library, encoder, vocabulary
from edgelake.llm.shared import bound_batches

NO_ID = -(1 << 63)
#: Ids read back at once.
READ_IDS = 1 << 20


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[Row]:
    """Encode every text, append ``end_id`` and write the shards; return (shard, n_docs, n_tokens, base) of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(encoder, vocabulary)
        vocab = vocabulary(tokenizer)
        encode, kind = encoder(tokenizer, by_library), np.dtype("<u2" if vocab.size <= 1 << 16 else "<u4")
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name, own = f"{folder}/{shard:05d}", f"{folder}/_{shard:05d}-{uuid.uuid4().hex[:8]}"
        ids_of, ends, total = [], [np.zeros(1, np.int64)], 0
        with store.open_output_stream(f"{own}.bin") as out:
            for rows, raw, off in chunks(batches):
                ids, bounds = encode(raw, off)
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                out.write(ids.astype(kind).tobytes())
                ids_of.append(rows.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                ends.append(total + bounds[1:])
                total += int(bounds[-1])
        n = sum(map(len, ids_of))
        if not n:
            store.delete_file(f"{own}.bin")
            return
        with store.open_output_stream(f"{own}.idx") as out:
            for part in (np.array([kind.itemsize, n]), *ids_of, *ends):
                out.write(part.astype("<i8").tobytes())
        for end in ("bin", "idx"):
            store.move(f"{own}.{end}", f"{name}.{end}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": n, "n_tokens": total}])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]  # rows of one id may be dealt to several shards
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, "shard long, n_docs long, n_tokens long").collect()
    base, out = 0, []
    for row in sorted(made, key=lambda r: r.shard):  # as many rows as shards
        out.append(Row(shard=row.shard, n_docs=row.n_docs, n_tokens=row.n_tokens, base=base))
        base += row.n_tokens
    return out


def read_files(spark: SparkSession, path: str, shards: list[Row]) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32 bit)."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    table = spark.createDataFrame(shards, "shard long, n_docs long, n_tokens long, base long")
    if not shards:
        return spark.createDataFrame([], schema)

    def read(store, name: str, kind: str) -> np.ndarray:
        if isinstance(store, pafs.LocalFileSystem):
            return np.memmap(name, kind, "r")
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read(), kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{row['shard']:05d}"
                index = read(store, f"{name}.idx", "<i8")
                width, n = int(index[0]), int(index[1])
                doc, off = index[2 : 2 + n], index[2 + n :]
                ids = read(store, f"{name}.bin", f"<u{width}")
                at = 0
                while at < n:
                    to = max(at + 1, min(n, int(np.searchsorted(off, off[at] + READ_IDS, "right")) - 1))
                    bounds = np.asarray(off[at : to + 1])
                    some = np.asarray(doc[at:to])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == NO_ID), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), binary_slices(ids[bounds[0] : bounds[-1]].astype("<u4"), bounds - bounds[0])],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = to

    return table.repartition(len(shards), "shard").mapInArrow(work, schema)
