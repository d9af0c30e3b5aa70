"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

A document's fingerprint is the bitwise majority over the XXH64 of its word shingles. Every bit place gets a vector
of radius + 1 bits; a table belongs to each non-zero vector v and looks only at the places whose vector
has an odd product with v. The vectors of any `radius` places span less than the whole space, so some v is
orthogonal to all of them: two fingerprints that differ in those places alone collide in v's table.

Only distinct fingerprints go into the tables. Buckets of up to SMALL members are compared pair by pair (at most
SMALL - 1 comparisons for a member). In larger buckets neighbours in order are compared, and what then is still in a bucket of
several components meets at midpoints: each lists all fingerprints within half the radius of it, and two fingerprints are within
the radius exactly when they share one, as the radius is even. All who share a midpoint are linked with the least of them where
they are not joined yet, so a crowded bucket costs rows in proportion to its members, and no link between components is lost.

Null text: no words, like an empty text: fingerprint zero, linked like any other. Fewer words than a shingle has: the
whole sequence is the one shingle. Repeated rows and equal texts share a fingerprint. Ties go to the smallest id; a row
without an id takes part, and a component of such rows alone has no component_id. An empty table gives an empty result.
Other columns than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import map_batches, slices, stored
from tidebar.llm.graph import connected
from tidebar.llm.words import LOWER, word_ranges

BITS = 64
#: Seed of the shingle hash.
SEED = 42
#: Members of a bucket that are compared pair by pair; larger buckets meet at midpoints. Up to here the pairs of a member in all 31
#: tables of radius 4 are no more than its 2,081 midpoints, and only pairs within the radius are rows.
SMALL = 128


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def masks(radius: int) -> list[int]:
    """One mask of bits for each non-zero vector of radius + 1 bits; the place vectors take all non-zero values in turn."""
    values = (1 << radius + 1) - 1
    place = [1 + i % values for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (place[i] & v).bit_count() & 1) for v in range(1, values + 1)]


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every run of hashes the bits set in over half of them (uint64); zero for an empty run."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # Counts of up to 255 hashes fit a byte; those are then summed up for each run.
    parts = -(-sizes[rows] // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(bounds[:-1][rows] - 255 * first, parts) + 255 * np.arange(parts.sum())
    counts = np.add.reduceat(np.add.reduceat(bits, starts, axis=0, dtype=np.uint8), first, axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > sizes[rows][:, None], axis=1)
    out[rows] = np.ascontiguousarray(packed).view(">u8").ravel()
    return out


def _fingerprints(text: pa.Array, n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    data, offsets, starts, ends = word_ranges(text)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    # All words behind one another, one space between: a shingle is then a range of bytes.
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - (lengths + 1)
    spaced = np.full(int((lengths + 1).sum()), 32, np.uint8)
    spaced[np.repeat(places - starts, lengths) + _ranges(starts, lengths)] = LOWER[data[_ranges(starts, lengths)]]
    shingles = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    begin = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], shingles)
    last = begin + np.repeat(np.minimum(words, n), shingles) - 1
    raw = spaced.tobytes()
    at = zip(places[begin].tolist(), (places[last] + lengths[last]).tolist())
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in at), np.uint64, int(bounds[-1]))
    return majority(hashes, bounds)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + lengths, lengths)


def fingerprint_rows(n: int):
    """Batches of (id, text) to (id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_fingerprints(part.column(1), n).view(np.int64))], ["doc_id", "print"])

    return run


def close_links(prints: DataFrame, radius: int, small: int = SMALL) -> DataFrame:
    """Links (a, b) that join every two fingerprints (column print, distinct) within an even radius, each itself within it."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even and positive")
    tables = F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])).alias("table", "key")
    rows = prints.select("print", tables)
    buckets = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stored(rows.join(buckets.hint("merge"), ["table", "key"]), "covering-buckets")
    few = met.where(F.col("members") <= small)
    left, right = few.select("table", "key", F.col("print").alias("a")), few.select("table", "key", F.col("print").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right.hint("merge"), ["table", "key"]).where("a < b").where(close).select("a", "b")
    crowded = stored(met.where(F.col("members") > small).select("table", "key", "print"), "covering-crowded")
    if crowded.isEmpty():
        return stored(pairs.distinct(), "covering-links")
    order = Window.partitionBy("table", "key").orderBy("print")
    next_to = crowded.select(F.col("print").alias("a"), F.lead("print").over(order).alias("b")).where(close)
    links = stored(pairs.unionByName(next_to).distinct(), "covering-links")
    labels = stored(connected(links).toDF("print", "component"), "covering-labels")
    rows = crowded.join(labels, "print", "left").select("table", "key", "print", F.coalesce("component", "print").alias("component"))
    split = rows.groupBy("table", "key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h")
    rows = rows.join(split, ["table", "key"], "left_semi").select("print", "component").distinct()
    return stored(links.unionByName(_at_midpoints(rows, radius)).distinct(), "covering-links")


def _at_midpoints(crowded: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint (print, component) with the least of those that share a midpoint with it, where these are of several components."""
    near = crowded.repartition(F.col("print")).select("print", "component", F.col("print").alias("mid"), F.lit(-1).alias("last"))
    for _ in range(radius // 2):  # one more place above the last is flipped, or none (place BITS)
        near = near.select("print", "component", "mid", F.explode(F.sequence(F.least(F.col("last") + 1, F.lit(BITS)), F.lit(BITS))).alias("last"))
        near = near.select("print", "component", F.expr(f"CASE WHEN last < {BITS} THEN mid ^ shiftleft(1L, last) ELSE mid END").alias("mid"), "last")
    near = near.select("print", "component", "mid")
    groups = near.groupBy("mid").agg(F.min("print").alias("least"), F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("mid", "least")
    return near.join(groups.hint("merge"), "mid").where("print <> least").select(F.col("least").alias("a"), F.col("print").alias("b"))


def near_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, radius: int = 4, small: int = SMALL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most radius bits)."""
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = stored(map_batches(texts, fingerprint_rows(shingle), "doc_id long, print long"), "fingerprints")
    classes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    labels = connected(close_links(classes.select("print"), radius, small)).withColumnRenamed("node", "print")
    linked = stored(classes.join(labels.hint("merge"), "print"), "linked-fingerprints")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(linked.select("print", "component").join(least.hint("merge"), "component").hint("merge"), "print", "left")
    named = named.select("print", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named.hint("merge"), "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
