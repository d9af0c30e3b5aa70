"""Token ids as length-delimited binary records with a separate offset index.

A data file is a sequence of frames: length of the payload (8 bytes, little-endian), masked CRC-32 of
these 8 bytes (4), payload, masked CRC-32 of the payload (4). A payload is one byte with the width of
an id, 2 or 4 bytes, and the ids as little-endian unsigned integers of that width, the smaller where every id of the record fits. The index file beside it has a fixed-size entry for each frame: document id, offset
of the frame, number of ids (three 8-byte integers), so a reader can go to any record in any order. Files hold ascending
ranges of document ids. Each task writes its own files under names no other attempt uses; the table
of files that the successful attempts return says which of them count, so a task that is run again leaves nothing
double.

Null text: empty, a record of the end id alone. Repeated rows are repeated records. Rows without an id come first.
A very long text is one long record. An empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.llm.common import keeping, map_batches, shared_path, slices, stored
from tidebar.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
FILE_BYTES = 256 << 20
MASK = 0xA282EAD8


def masked(crc: int) -> int:
    """A checksum that stays sound if the data it covers holds checksums: rotated by 15 bits, plus a constant."""
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(read) -> bytes | None:
    """The next payload of read(n), None at the end; a wrong checksum or a cut frame is an error."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record head")
    size = struct.unpack("<Q", head[:8])[0]
    body = read(size + 4)
    if len(body) < size + 4 or masked(zlib.crc32(body[:size])) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return body[:size]


def opened(path: str, mode: str):
    """A file of the shared folder: a plain path or file: URI here, any other scheme through Arrow's file systems."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        plain = "/" + rest.lstrip("/") if colon else path
        if "w" in mode:
            os.makedirs(os.path.dirname(plain), exist_ok=True)
        return open(plain, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def payload_of(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if small else (b"\x04" + ids.astype("<u4").tobytes())


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


class _Writer:
    def __init__(self, folder: str):
        self.path = f"{folder}/part-{uuid.uuid4().hex}"
        self.data, self.index = opened(self.path + ".rec", "wb"), opened(self.path + ".idx", "wb")
        self.offset = self.records = self.ids = 0
        self.first = None

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.first = doc_id if self.records == 0 else self.first
        framed = frame(payload_of(ids))
        self.data.write(framed)
        self.index.write(struct.pack("<qqq", -(1 << 63) if doc_id is None else doc_id, self.offset, len(ids)))
        self.offset += len(framed)
        self.records += 1
        self.ids += len(ids)

    def close(self) -> tuple:
        self.data.close()
        self.index.close()
        return self.path, self.first, self.records, self.ids, self.offset


#: Files a reading task takes once there are more files than tasks for all cores.
FILES_PER_TASK = 16
FILES = "task int, file int, path string, first_id long, records long, ids long, bytes long"


def write_records(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of every text in ascending id order under folder; returns the table of files (FILES), stored."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode, writer, made = encoder(vocabulary).encode, None, []
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = encode(part.column(1), END_ID)
                for doc_id, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    writer = writer or _Writer(folder)
                    writer.add(doc_id, ids[a:b])
                    if writer.offset >= file_bytes:
                        made.append(writer.close())
                        writer = None
        if writer:
            made.append(writer.close())
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist(
            [{"task": task, "file": i, "path": m[0], "first_id": m[1], "records": m[2], "ids": m[3], "bytes": m[4]} for i, m in enumerate(made)],
            pa.schema([("task", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]),
        )

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    return stored(map_batches(ordered, keeping(run, "encoder"), FILES), "record-files")


def read_records(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32 and ids (as 32-bit integers) of every record, checksums verified.

    Files are dealt out by their place among all files, a few to a task whatever their number; where a file's ids begin is a running sum over the table of files, which has a row for each
    FILE_BYTES.
    """
    order = Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.where("records > 0").withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path + ".rec", "rb") as data, opened(path + ".idx", "rb") as index:
                    rows, size = [], 0
                    while True:
                        payload = unframe(data.read)
                        entry = index.read(24)
                        if payload is None and not entry:
                            break
                        if payload is None or len(entry) != 24:
                            raise ValueError(f"index and data of {path} differ")
                        doc_id, _, n = struct.unpack("<qqq", entry)
                        ids = ids_of(payload)
                        if n != len(ids):
                            raise ValueError(f"index and data of {path} differ")
                        rows.append((None if doc_id == -(1 << 63) else doc_id, before, n, zlib.crc32(ids), ids.tobytes() if with_ids else None))
                        before += n
                        size += 4 * n * with_ids
                        if size > 4 << 20 or len(rows) >= 5_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    count, cores = files.count(), files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(4 * cores, count // FILES_PER_TASK)))
    dealt = placed.select("path", "before").repartition(tasks, "path")
    return map_batches(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_record(path: str, number: int) -> tuple[int, np.ndarray]:
    """Record number of a file by its index alone."""
    with opened(path + ".idx", "rb") as index, opened(path + ".rec", "rb") as data:
        index.seek(24 * number)
        doc_id, offset, _ = struct.unpack("<qqq", index.read(24))
        data.seek(offset)
        return doc_id, ids_of(unframe(data.read))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def record_digests(spark: SparkSession, documents: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    return read_records(write_records(documents, folder or shared_path(spark, "records"), vocabulary), with_ids=False).drop("ids")
