"""A stateful pass over each sorted series, streamed over Arrow batches.

Spark shuffles and sorts; the pass sees one batch at a time and keeps only the
state of the series it is in.  Results come out as the pass goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidebar.session import carry_code


class Series(Protocol):
    def advance(self, part: pa.RecordBatch) -> Iterable[dict]: ...

    def finish(self) -> Iterable[dict]: ...


def fold_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[tuple], Series], result: str, keep: Sequence[str] | None = None,
    together: Callable[[Iterator[tuple[tuple, pa.RecordBatch]]], Iterator[tuple[tuple, dict]]] | None = None, placed: bool = False,
) -> DataFrame:
    """Run ``start(key)`` over every series of ``df``.

    The pass yields blocks: dicts of equally long columns; a missing column is null.
    The columns of ``keep`` (default: keys) lead the result.  ``together`` takes all (key, part) of a task
    in the place of one ``start(key)`` a series.  ``placed`` rows already lie by key, so they are sorted only.
    """
    keys, keep = list(keys), list(keys if keep is None else keep)
    carry_code()
    ordered = (df if placed else placed_by(df, keys)).sortWithinPartitions(*keys, *order)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = StructType.fromDDL(f"{head}, {result}")
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = together(_parts(batches, keys)) if together else _blocks(batches, keys, start)
        yield from _joined((_batch(dict(zip(keys, key)), block, shape) for key, block in blocks), shape)

    return ordered.mapInArrow(run, schema)


def placed_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key over the tasks of a fold; windows inside a key keep that place, so a fold may follow them without another exchange."""
    return df.repartition(_tasks(df), *keys)


def _tasks(df: DataFrame) -> int:
    """An explicit count: the step costs time per row, so tasks must not merge because their bytes are few."""
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)


def _parts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of one key, cut where batches end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in keys]
        edge = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            edge |= codes[1:] != codes[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            yield tuple(c[first].as_py() for c in columns), batch.slice(first, last - first)


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str], start: Callable[[tuple], Series]) -> Iterator[tuple[tuple, dict]]:
    series, current = None, None
    for key, part in _parts(batches, keys):
        if series is None or current != key:
            if series is not None:
                yield from ((current, block) for block in series.finish())
            current = key
            series = start(current)
        for block in series.advance(part):
            yield current, block
    if series is not None:
        yield from ((current, block) for block in series.finish())


#: Rows a batch of results should have: a few rows from each of many series travel together.
RESULT_ROWS = 8192


def _joined(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RESULT_ROWS:
            yield from pa.Table.from_batches(held, schema=shape).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held, schema=shape).combine_chunks().to_batches()


def _batch(key: dict, block: dict, shape: pa.Schema) -> pa.RecordBatch:
    count = len(next(iter(block.values())))
    arrays = []
    for field in shape:
        if field.name in block:
            values = block[field.name]
            arrays.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, type=field.type))
        elif key.get(field.name) is None:
            arrays.append(pa.nulls(count, field.type))
        else:
            arrays.append(pa.repeat(pa.scalar(key[field.name], field.type), count))
    return pa.RecordBatch.from_arrays(arrays, schema=shape)


def numeric(part: pa.RecordBatch, name: str) -> np.ndarray:
    """Values with NaN for null, so every comparison with a missing value is false."""
    return part.column(name).to_numpy(zero_copy_only=False).astype(float)


def floats(part: pa.RecordBatch, name: str) -> list[float]:
    return numeric(part, name).tolist()


def truths(part: pa.RecordBatch, name: str) -> np.ndarray:
    """Booleans, a missing one false."""
    return part.column(name).to_numpy(zero_copy_only=False).astype(bool)


def micros(part: pa.RecordBatch, name: str) -> list[int]:
    return part.column(name).cast(pa.int64()).to_pylist()
