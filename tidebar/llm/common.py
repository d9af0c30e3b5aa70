"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.session import carry_code, shared_dir

SLICE_BYTES = 4 << 20
#: Module that holds what a Python worker keeps between tasks; code that travels with a task is new in each.
WORKER_STORE = "tidebar_worker_store"


def kept_by_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What make gives, made once in this Python process whichever task asks."""
    store = sys.modules.setdefault(WORKER_STORE, types.ModuleType(WORKER_STORE)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def forget_all_but(kinds: Iterable[str]) -> None:
    """Empty the worker's store but for what the next task uses, by the first part of its key; the short tables of powers stay."""
    store = sys.modules.setdefault(WORKER_STORE, types.ModuleType(WORKER_STORE)).__dict__
    for key in [k for k in store if isinstance(k, tuple) and k[0] != "powers" and k[0] not in kinds]:
        del store[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_of(id_column: str, modulus: int) -> Column:
    """The fold of a row: crc32 of the decimal id."""
    return (F.crc32(F.col(id_column).cast("string")) % modulus).cast("int")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidebar-llm/{label}-{uuid.uuid4().hex}"


#: Lets go of an execution's shuffle files at its end. A write plans its own exchanges, so no later step reads them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write the rows as Parquet; what they were shuffled through is off the disks when the table is there, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: the lineage ends here, so a lost executor re-runs nothing before it."""
    path = shared_path(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keeping(fn: Callable, *kinds: str) -> Callable:
    """The task function, marked with the kinds of stored things that its tasks use."""
    fn.keeps = kinds
    return fn


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of a few thousand rows, with this package's code sent along.

    Of what the worker keeps from earlier tasks only the kinds named by `keeping` stay in memory; memory not in use is given back at the end.
    """
    carry_code()
    keeps = getattr(fn, "keeps", ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        forget_all_but(keeps)
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts fill up to limit bytes; a longer text is a run of its own."""
    text = batch.column(column)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    start = 0
    while start < len(text):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, min(end, len(text)) - start)
        start = min(end, len(text))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a run of texts, and where each text begins and ends in them (null: empty)."""
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_key(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Column:
    """The id; for rows without one, where there are any, a hash of the text above all ids, so equal texts share a key and ids go first."""
    own = documents[id_column]
    most, nameless = documents.agg(F.max(own.cast("long")), F.count_if(own.isNull())).first()
    if not nameless:
        return own
    base = max(0 if most is None else most + 1, 0)
    room = (1 << 63) - base
    if room < 1 << 61:
        raise ValueError(f"{id_column} up to {most} leaves no room for keys of rows without one")
    text = F.coalesce(documents[text_column].cast("string"), F.lit(""))
    return F.coalesce(own.cast("long"), F.pmod(F.xxhash64(text), F.lit(min(room, (1 << 63) - 1))) + F.lit(base))


def without(documents: DataFrame, decide: Callable[[DataFrame], DataFrame], label: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents but those that decide, given their keys as doc_id and their text, returns under doc_id."""
    key = row_key(documents, id_column, text_column)
    found = decide(documents.select(key.alias("doc_id"), documents[text_column].alias("text")))
    found = stored(found.select(F.col("doc_id").alias("_id")).distinct(), label)
    return documents.join(found, key == found["_id"], "left_anti")
