"""Best-fit packing of token sequences with a bounded number of open bins.

Documents become pieces: a longer one is cut into pieces of the full length, the last may be shorter. Within
a task pieces come longest first; each goes into the open bin with the least free space that still holds it. Open
bins are found in a bitset keyed by free space. If no bin fits and as many as allowed are open, the fullest closes and
a new one opens. Bins that stay half empty when a task's pieces end are packed once
more by the same rule, so the last bins of different tasks share sequences.

Null text: empty, one piece with the end id. Repeated rows are pieces of their own. Ties in length go by id and piece; an
empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import keeping, map_batches, slices, stored
from tidebar.llm.records import END_ID, VOCABULARY
from tidebar.llm.tokens import encoder

SEQUENCE = 4096
OPEN_BINS = 512
#: Left-over bins that one task packs.
REMAINDERS = 200_000


class OpenBins:
    """Open bins by free space: bit f of the bitset is set if a bin with f free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = self.open = self.made = 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return chosen

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            chosen, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(chosen)
            self.bits |= 1 << left
            self.open += 1
        return chosen, self.capacity - free

    def remaining(self) -> dict[int, int]:
        """Free places of the bins still open."""
        return {b: free for free, bins in self.by_free.items() for b in bins}


def pieces(documents: DataFrame, capacity: int = SEQUENCE, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and with_ids its ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = encode(part.column(1), END_ID)
                rows = [
                    (doc_id, k, s - a, min(s + capacity, b) - s, ids[s : min(s + capacity, b)].astype("<u4").tobytes())
                    for doc_id, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())
                    for k, s in enumerate(range(a, b, capacity))
                ]
                doc, piece, start, length, data = zip(*rows)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(zlib.crc32, data), pa.int64())]
                columns += [pa.array(data, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(rows, keeping(run, "encoder"), schema)


def _pack(rows: DataFrame, capacity: int, most: int) -> DataFrame:
    """rows with task, bin and offset; each task packs its rows, the longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        task, bins = TaskContext.get().partitionId(), OpenBins(capacity, most)
        for batch in batches:
            placed = [bins.place(size) for size in batch.column("length").to_pylist()]
            out, offset = zip(*placed) if placed else ((), ())
            added = [pa.array([task] * len(placed), pa.int64()), pa.array(out, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "task", "bin", "offset"])

    longest = rows.sortWithinPartitions(F.desc("length"), *[c for c in rows.columns if c != "length"])
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return map_batches(longest, run, f"{schema}, task long, bin long, offset long")


def pack(items: DataFrame, capacity: int = SEQUENCE, most: int = OPEN_BINS) -> DataFrame:
    """items (any columns, with length) and their sequence_id and offset."""
    placed = stored(_pack(items.repartition(F.xxhash64(*[F.col(c) for c in items.columns])), capacity, most), "packed")
    bins = placed.groupBy("task", "bin").agg(F.sum("length").alias("length"))
    # Bins that are half empty can share a sequence; a task that packs the longest first leaves few of them.
    rest = bins.where(F.col("length") * 2 <= capacity).select(F.col("task").alias("t"), F.col("bin").alias("b"), "length")
    rest = stored(rest, "half-empty")
    shares = 1 + rest.count() // REMAINDERS
    joined = _pack(rest.repartition(shares, "t", "b"), capacity, most)
    joined = joined.select(F.col("t").alias("_t"), F.col("b").alias("_b"), F.struct("task", "bin").alias("_into"), F.col("offset").alias("_base"))
    found = placed.join(joined, (F.col("task") == F.col("_t")) & (F.col("bin") == F.col("_b")), "left")
    number = F.shiftleft(F.col("task"), 32) + F.col("bin")
    merged = F.shiftleft(F.col("_into.task"), 32) + F.col("_into.bin") + F.lit(1 << 62)
    return found.select(
        *items.columns, F.coalesce(merged, number).alias("sequence_id"), (F.col("offset") + F.coalesce("_base", F.lit(0))).cast("long").alias("offset")
    )


def packed_documents(documents: DataFrame, capacity: int = SEQUENCE, most: int = OPEN_BINS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(stored(pieces(documents, capacity, vocabulary), "pieces"), capacity, most)


def sequences(documents: DataFrame, capacity: int = SEQUENCE, most: int = OPEN_BINS, vocabulary: str = VOCABULARY) -> DataFrame:
    """sequence_id, ids of every packed sequence: its pieces in order, at most capacity ids."""
    packed = pack(stored(pieces(documents, capacity, vocabulary, with_ids=True), "pieces"), capacity, most)
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
