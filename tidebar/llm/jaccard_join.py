"""Similarity join of shingle sets by universe-partition pigeonhole, exact for any Jaccard threshold.

Two sets with Jaccard similarity of at least p/q differ in at most H elements, H growing with their
size. Sizes fall into bands. For each band the universe of hashed shingles is cut into segments, each
worth one unit (indexed by the subset of a set that falls into it) or two (indexed by that subset and by all
its one-deletion neighbours, so that a difference of one still meets). A pair that differs in H
elements or fewer can miss at most H units, so with more than H units it meets somewhere. What a set emits,
and how often it must emit an empty subset, is priced for each band, and the cheapest allocation is taken.

Documents with equal sets are one class. Links between classes are found in rounds: each class of
a bucket proposes one neighbour, proposals are verified on the sets, linked classes become one component,
and only buckets that still hold several components propose again, in order of how many such buckets a class is in, which brings
copies with equally many edits together. The last round takes all pairs of different components in such buckets of up to SMALL classes. Of the
classes in larger ones it takes the pairs that are in different components and have one of their rarest elements in common, at a place
that leaves both enough elements to be similar; a similar pair meets in a bucket of one kind or the other, so no
link between components is lost, and copies are never expanded into pairs. New links are joined up as links of components.

Null text: no words, an empty set, linked with nothing. Repeated rows count as copies. Fewer words than a shingle
has: the whole sequence is the one shingle. Ties go to the smallest id. An empty table gives an empty result. Other
columns than id and text are not looked at; ids must not be null (rows without an id are left out).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import keeping, kept_by_worker, map_batches, slices, stored
from tidebar.llm.graph import connected
from tidebar.llm.words import mix, shingle_sets

_U = np.uint64
BAND_RATIO = 1.4
#: Partitions that a set goes through until its empty subsets can't matter; those of the last are emitted.
ROUNDS = 5
#: Longs of a set's parity: each element flips one of the bits, so two sets differ in as many elements as parity bits at least.
PARITY = [f"p{k}" for k in range(8)]
#: Rows of a bucket that the last round still pairs one by one; members of larger ones meet on their rarest elements.
SMALL = 16
#: Price of another turn, as a multiple of its rows: the set is hashed, sorted and cut again.
TURN_PRICE = 10.0


def max_difference(lo: int, hi: int, p: int, q: int) -> int:
    """Most elements in which two sets can differ that hold p/q, the smaller having lo to hi elements."""
    top = hi + hi * q // p
    return max(t - 2 * -(-p * t // (p + q)) for t in range(max(2 * lo, top - 4 * (p + q)), top + 1))


def band_of(size: int) -> tuple[int, int]:
    lo = 1
    while True:
        hi = max(lo, int(lo * BAND_RATIO))
        if size <= hi:
            return lo, hi
        lo = hi + 1


def allocation(lo: int, hi: int, p: int, q: int) -> tuple[int, int, int]:
    """(exact segments, one-deletion segments, H) of the band, at the least price.

    A record with n elements emits a row for each exact segment and 1 + its subset for each one-deletion
    segment, and all of that again under another partition if its empty subsets are worth as many units as there are to spare.
    """
    h = max_difference(lo, hi, p, q)
    if h == 0:
        return 0, 0, 0  # such sets are equal, and equal sets are one class
    n, best = (lo + hi) / 2, None
    for deletions in sorted({0, 1, 2, 3, (h + 1) // 2, h // 2 + 1}):
        for spare in sorted({0, 1, 2, 3, 4, 6, 8, 12, 16, h // 16, h // 12, h // 8, h // 6, h // 5, h // 4}):
            exact = max(0, h + 1 + spare - 2 * deletions)
            units, segments = exact + 2 * deletions, exact + deletions
            if not segments or units <= h:
                continue
            # The universe is cut in proportion to the units a segment is worth.
            per_unit = n / units
            empty = exact * math.exp(-per_unit) + 2 * deletions * math.exp(-2 * per_unit) * (1 + 2 * per_unit)
            if segments == 1 and lo > 1:
                empty = 0.0  # the whole set is in it
            over = 1.0 - sum(math.exp(k * math.log(empty + 1e-300) - empty - math.lgamma(k + 1)) for k in range(min(units - h, int(10 * empty) + 60)))
            rows = exact + deletions * (1 + 2 * per_unit)
            price = rows * (1 + TURN_PRICE * max(0.0, over))
            if best is None or price < best[0]:
                best = (price, exact, deletions)
    return best[1], best[2], h


class Partition:
    """How one band cuts the universe: exact segments first, then one-deletion segments of twice the width."""

    def __init__(self, lo: int, hi: int, p: int, q: int):
        self.exact, self.deletions, h = allocation(lo, hi, p, q)
        self.worth = np.concatenate([np.ones(self.exact, np.int64), np.full(self.deletions, 2, np.int64)])
        units = int(self.worth.sum())
        self.spare = units - h
        edges = np.cumsum(self.worth)[:-1].tolist()
        self.cuts = np.array([((1 << 64) - 1) * e // units for e in edges], _U)
        self.salt = mix(np.arange(len(self.worth), dtype=_U) + _U(lo << 20))


def partitions(size: int, p: int, q: int) -> tuple[Partition, ...]:
    """Of the band of a size, and of every lower band with sizes it can be similar to; kept by the worker for each size."""
    return kept_by_worker(("partitions", size, p, q), lambda: _partitions(size, p, q))


def _partitions(size: int, p: int, q: int) -> tuple[Partition, ...]:
    least = -(-p * size // q)
    lo, hi = band_of(size)
    out = [_partition(lo, hi, p, q)]
    while lo > least:
        lo, hi = band_of(lo - 1)
        out.append(_partition(lo, hi, p, q))
    return tuple(x for x in out if len(x.worth))


def _partition(lo: int, hi: int, p: int, q: int) -> Partition:
    """A band has one partition, kept by the worker; there are as many as bands, some log of the largest size."""
    return kept_by_worker(("partition", lo, hi, p, q), lambda: Partition(lo, hi, p, q))


def signatures(elements: np.ndarray, bounds: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of many sets (each ascending within its bounds), and where each set's keys begin.

    A set emits a key for each subset but the empty ones. Where its empty subsets are worth as many units as there are to
    spare, a partner as hollow as itself might meet it on nothing else, so both emit keys under the next partition too,
    and under the last one for empty subsets as well. Any other partner meets it in the first.
    """
    keys, rows = [], []
    todo = [(row, part) for row, size in enumerate(np.diff(bounds).tolist()) if size for part in partitions(size, p, q)]
    for turn in range(ROUNDS):
        if not todo:
            break
        made, owner, todo = _keys(elements, bounds, todo, turn, turn == ROUNDS - 1)
        keys.append(made)
        rows.append(owner)
    if not keys:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return keys[order], np.searchsorted(rows[order], np.arange(len(bounds)))


def _keys(elements: np.ndarray, bounds: np.ndarray, todo: list, turn: int, last: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """Keys of (set, partition) jobs in one turn, their sets, and the jobs that need another turn."""
    if turn:  # another partition: the same cuts over hashes that are hashed once more
        only = sorted({row for row, _ in todo})
        place = {row: k for k, row in enumerate(only)}
        moved = [np.sort(mix(elements[bounds[row] : bounds[row + 1]] + _U(turn))) for row in only]
        elements, bounds = np.concatenate(moved), np.concatenate([[0], np.cumsum([len(x) for x in moved])])
    else:
        place = None
    starts, ends, salts, worths, jobs = [], [], [], [], []
    for row, part in todo:
        k = row if place is None else place[row]
        a, b = int(bounds[k]), int(bounds[k + 1])
        cuts = elements[a:b].searchsorted(part.cuts, "right") + a
        starts.append(np.append(a, cuts))
        ends.append(np.append(cuts, b))
        salts.append(part.salt)
        worths.append(part.worth)
        jobs.append((row, len(part.worth), part.spare, part.deletions))
    starts, ends, salts, worths = (np.concatenate(x) for x in (starts, ends, salts, worths))
    job = np.array(jobs, np.int64)
    owner = np.repeat(np.arange(len(job)), job[:, 1])
    with np.errstate(over="ignore"):
        salts = salts + _U(turn << 40)
        values = mix(elements ^ _U(0xA5A5A5A5A5A5A5A5))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
        subset = sums[ends] - sums[starts]
        counts = ends - starts
        keys = mix(subset + salts)
        # Units with which a subset can meet another on nothing at all.
        hollow = np.bincount(owner, np.where(counts < worths, worths, 0), len(job)) >= job[:, 2]
        keep = (counts > 0) | (hollow[owner] & last)
        out, rows = [keys[keep]], [job[owner[keep], 0]]
        if job[:, 3].any():
            two = np.flatnonzero(worths == 2)
            inner = np.repeat(two, counts[two])
            at = np.arange(len(inner)) - np.repeat(np.cumsum(counts[two]) - counts[two], counts[two]) + starts[inner]
            left_out = mix(subset[inner] - values[at] + salts[inner])
            keep = (counts[inner] > 1) | (hollow[owner[inner]] & last)
            out.append(left_out[keep])
            rows.append(job[owner[inner[keep]], 0])
    return np.concatenate(out), np.concatenate(rows), [job_ for job_, more in zip(todo, hollow.tolist()) if more and not last]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _longs(values))


def set_identities(n: int):
    """Batches of (id, text) to (id, n_shingles, set identity in two longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                elements, bounds = shingle_sets(part.column(1), n)
                totals = []
                with np.errstate(over="ignore"):
                    for salt in (_U(0x5BD1E9955BD1E995), _U(0x27D4EB2F165667C5)):
                        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(elements ^ salt), dtype=_U)])
                        totals.append(_longs(sums[bounds[1:]] - sums[bounds[:-1]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), *totals], ["id", "n_shingles", "set_a", "set_b"])

    return run


def set_rows(n: int, p: int, q: int):
    """Batches of (id, text) to (id, n, index keys). Keys are many times the size of a text, so only texts of classes come here and keys go to their buckets at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                elements, bounds = shingle_sets(part.column(1), n)
                keys = _lists(*signatures(elements, bounds, p, q))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), keys], ["id", "n", "keys"])

    return run


def parities(elements: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For every set the bits that an odd number of its elements have as their lowest, as columns of longs."""
    bits = 64 * len(PARITY)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    odd = np.bincount(rows * bits + (elements & _U(bits - 1)).astype(np.int64), minlength=bits * (len(bounds) - 1)) & 1
    packed = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, len(PARITY))
    return [np.ascontiguousarray(packed[:, k]) for k in range(len(PARITY))]


def set_elements(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                elements, bounds = shingle_sets(part.column(1), n)
                columns = [pa.array(np.diff(bounds)), _lists(elements, bounds), *map(pa.array, parities(elements, bounds))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n", "elements", *PARITY])

    return run


def _apart(n_a: str, n_b: str, p: int, q: int) -> str:
    """That two sets with their parities under a and b differ in no more bits than similar sets of their sizes may in elements."""
    return f"{p + q} * ({' + '.join(f'bit_count({c}a ^ {c}b)' for c in PARITY)}) <= {q - p} * ({n_a} + {n_b})"


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) with whether their sets hold p/q. Elements move only for pairs whose sizes and parities allow it."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.col("n").alias("n" + x), *[F.col(c).alias(c + x) for c in PARITY])

    near = F.expr(f"{q} * least(na, nb) >= {p} * greatest(na, nb) AND {_apart('na', 'nb', p, q)}")
    seen = stored(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", near.alias("near")), "near-pairs")
    a, b = sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    joined = seen.where("near").select("a", "b").join(a, "a").join(b, "b")
    held = joined.select("a", "b", (q * common >= p * (F.size("x") + F.size("y") - common)).alias("linked"))
    return held.unionByName(seen.where("NOT near").select("a", "b", F.lit(False).alias("linked")))


def _open_rows(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows (key, id, n, component) of the buckets that hold several components, with the rows of the bucket (held)."""
    rows = buckets.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    split = rows.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count(F.lit(1)).alias("held")).where("l <> h").select("key", "held")
    return rows.join(split, "key")


def _small_bucket_pairs(rows: DataFrame, p: int, q: int) -> DataFrame:
    """All pairs of different components within a bucket of at most SMALL rows whose sizes allow it, each once."""
    after = Window.partitionBy("key").orderBy("n", "id").rowsBetween(1, SMALL - 1)
    others = rows.where(F.col("held") <= SMALL).withColumn("others", F.collect_list(F.struct(F.col("id").alias("other"), F.col("n").alias("m"), F.col("component").alias("c"))).over(after))
    met = others.select("id", "n", "component", F.explode("others").alias("o")).where(F.expr(f"o.other <> id AND o.c <> component AND {q} * n >= {p} * o.m"))
    return met.select(F.least("id", "o.other").alias("a"), F.greatest("id", "o.other").alias("b")).distinct()


def _neighbours(rows: DataFrame, by_buckets: bool) -> DataFrame:
    """For every class one other of another component: the one it is next to in most buckets, in order of size or of the buckets it is in."""
    order = Window.partitionBy("key").orderBy("n", "id")
    if by_buckets:
        rows = rows.withColumn("held_by", F.count(F.lit(1)).over(Window.partitionBy("id")))
        order = Window.partitionBy("key").orderBy("held_by", "n", "id")
    near = rows.select("id", "component", F.lag("id").over(order).alias("other"), F.lag("component").over(order).alias("c"))
    pairs = near.where("c <> component").groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.groupBy("id").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _rare_meetings(rows: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """All pairs of different components that can be similar, for the classes of crowded buckets.

    Of two similar sets with their elements from rare to common, the first n - ceil(n * p / q) + 1 of each hold a common one.
    Behind the first they have in common lie all others, so from its place on both must hold as many as similar sets of their sizes share;
    and their parities differ in no more bits than the sets may in elements. Among near copies whose edits differ, an edited set's first
    elements are its own alone, and of the rest the parities leave few pairs but the similar ones.
    """
    ids = rows.select("id", "component").distinct()
    # Elements move by themselves; what else the pairs are told apart by joins those of the first places.
    members = sets.join(ids.select("id"), "id", "left_semi").select("id", "n", F.explode("elements").alias("e"))
    uses = members.groupBy("e").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    # Elements of one set alone come first and match nothing; only their number counts.
    common = members.join(uses, "e")
    ranked = common.select("*", F.row_number().over(Window.partitionBy("id").orderBy("uses", "e")).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("id")).alias("held"))
    first = ranked.where(F.col("place") + F.col("n") - F.col("held") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1)
    first = first.select("e", "id", (F.col("held") - F.col("place") + 1).alias("rest"))
    known = sets.select("id", "n", *PARITY).join(ids, "id")
    first = stored(first.join(known, "id").select("e", "id", "n", "component", *PARITY, "rest"), "rare-elements")
    split = first.groupBy("e").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("e")
    first = first.join(split, "e", "left_semi")
    left, right = (first.select("e", F.col("id").alias(x), F.col("n").alias("n" + x), F.col("component").alias("c" + x), F.col("rest").alias("r" + x), *[F.col(c).alias(c + x) for c in PARITY]) for x in "ab")
    near = F.expr(f"a < b AND ca <> cb AND {q} * least(na, nb) >= {p} * greatest(na, nb) AND {p + q} * least(ra, rb) >= {p} * (na + nb) AND {_apart('na', 'nb', p, q)}")
    return left.join(right, "e").where(near).select("a", "b").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after new links (a, b): only pairs of the components they join are linked up."""
    of = labels.select("id", "component")
    ends = links.join(of.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(of.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = stored(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "component-links")
    least = stored(connected(ends).toDF("node", "least"), "joined-components")
    old = of.join(least, F.col("component") == F.col("node"), "left").select("id", F.coalesce("least", "component").alias("component"))
    fresh = least.join(of, F.col("node") == F.col("id"), "left_anti").select(F.col("node").alias("id"), F.col("least").alias("component"))
    return stored(old.unionByName(fresh), "labels")


def similar_components(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links of at least percent/100), class_id, n_links.

    class_id is the smallest id with the same set; n_links counts the verified links of the class with other classes
    that joined its component together.
    """
    g = math.gcd(percent, 100)
    p, q = percent // g, 100 // g
    texts = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = stored(map_batches(texts, set_identities(shingle), "id long, n_shingles long, set_a long, set_b long"), "sets")
    identity = ["n_shingles", "set_a", "set_b"]
    classes = stored(rows.where("n_shingles > 0").groupBy(*identity).agg(F.min("id").alias("class_id")), "classes")
    firsts = texts.join(classes.select(F.col("class_id").alias("id")), "id", "left_semi")
    index = map_batches(firsts, keeping(set_rows(shingle, p, q), "partitions", "partition"), "id long, n long, keys array<long>").select("id", "n", F.explode("keys").alias("key"))
    order = Window.partitionBy("key").orderBy("n", "id")
    met = index.select("key", "id", "n", F.lag("id").over(order).alias("p"), F.lead("id").over(order).alias("s")).where("p <> id OR s <> id").select("key", "id", "n")
    buckets = stored(met.distinct(), "buckets")
    wanted = buckets.select("id").distinct()
    sets = stored(map_batches(texts.join(wanted, "id", "left_semi"), set_elements(shingle), "id long, n long, elements array<long>, " + ", ".join(f"{c} long" for c in PARITY)).dropDuplicates(["id"]), "elements")
    labels, tried = documents.sparkSession.createDataFrame([], "id long, component long"), None
    for step in range(4):
        rows_now = _open_rows(buckets, labels)
        if step == 3:  # what was tried and not linked is few, and tried once more
            still = stored(rows_now, "open")
            small = _small_bucket_pairs(still, p, q)
            pairs = small.unionByName(_rare_meetings(still.where(F.col("held") > SMALL), sets, p, q)).distinct()
        else:
            pairs = _neighbours(rows_now, step > 0)
            if tried is not None:
                pairs = stored(pairs, "proposed").join(tried.select("a", "b"), ["a", "b"], "left_anti")
        found = stored(_verified(pairs, sets, p, q), f"links-{step}")
        tried = found if tried is None else tried.unionByName(found)
        labels = _joined(labels, found.where("linked").select("a", "b"))
    links = tried.where("linked").select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = classes.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").join(degree.withColumnRenamed("id", "class_id"), "class_id", "left")
    return rows.join(classes, identity, "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "class_id", "id").alias("component_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
