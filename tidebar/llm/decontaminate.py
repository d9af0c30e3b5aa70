"""Benchmark decontamination by SimHash of item-sized windows.

A document's word shingles (five words of letters and digits, lower-cased) that may belong to the benchmark are found by a join
with a table of slots of bounded size, then with the shingles. Only their places go on, and later the texts that have a window. Around those places, windows as long as an item of the benchmark get a 64-bit
SimHash; a document shorter than the item is one window, whole. A window with fewer shingles of items of its length than the similarity asks for can't be similar to one. Fingerprints are cut into BLOCKS blocks.
Two that differ in RADIUS bits or fewer differ in at most RADIUS // BLOCKS bits in some block, so windows meet items on equal blocks or
blocks one bit apart, and every item within the radius is found. The similarity of a pair that meets is then exact: shared shingles over all
shingles, each as often as it occurs.

Only DataFrame functions run on the rows. Null and empty texts, and items of fewer words than a shingle, match nothing. Repeated rows
are one document. Of equally similar windows of a document and an item the first counts. Empty tables give an empty result. Columns
other than ids and texts are not looked at; rows without an id are left out of the result, but drop_contaminated judges them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import stored, without

SHINGLE, PERCENT = 5, 80
RADIUS, BLOCKS = 15, 8
#: Slots of the tables that shingles and documents are first held against: 256 for each hash, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 23


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def once(value: Column, name: str) -> Column:
    """The value as a generated column, so that what is built on it reads it and doesn't compute it again for each use."""
    return F.explode(F.array(value)).alias(name)


def shingles(words_column: str, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    w = F.col(words_column)
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))


def with_simhash(rows: DataFrame, hashes: str) -> DataFrame:
    """rows with print: each bit set if more than half of the hashes have it. Four bits are counted in each of sixteen sums."""

    def total_of(g: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, g).bitwiseAND(F.lit(0x0001000100010001)))

    summed = rows.select("*", once(F.array(*[total_of(g) for g in range(16)]), "_sums"))
    half, bits = F.size(hashes).cast("long"), []
    for g in range(16):
        for lane in range(4):
            count, bit = F.shiftrightunsigned(F.col("_sums")[g], 16 * lane).bitwiseAND(F.lit(0xFFFF)), 16 * lane + g
            bits.append(F.when(count * 2 > half, F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.withColumn("print", F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))).drop("_sums")


def blocks(fingerprint: Column, near: bool) -> Column:
    """(block number, block value) of a fingerprint; near: with all values one bit apart."""
    bits = 64 // BLOCKS
    flips = [0] + [1 << b for b in range(bits)] * near * (RADIUS // BLOCKS)
    value = [F.shiftrightunsigned(fingerprint, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(BLOCKS)]
    return F.array(*[F.struct(F.lit(k).alias("block"), v.bitwiseXOR(F.lit(f)).cast("long").alias("value")) for k, v in enumerate(value) for f in flips])


def slot_table(hashes: DataFrame, column: str, label: str) -> tuple[DataFrame, int]:
    """Rows (block, bits) of 64 slots each, a bit set where a hash falls, and the number of slots; at most MOST_SLOTS / 64 rows."""
    size = LEAST_SLOTS
    while size < min(MOST_SLOTS, 256 * hashes.count()):
        size *= 2
    slot = hashes.select(F.col(column).bitwiseAND(F.lit(size - 1)).alias("slot"))
    bits = slot.groupBy(F.shiftright("slot", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
    return stored(bits, label), size


def in_slots(rows: DataFrame, column: str, table: DataFrame, size: int) -> DataFrame:
    """The rows whose hash falls into a taken slot: all that were asked for, and few others. The table is bounded, so it is broadcast."""
    block = F.shiftright(rows[column].bitwiseAND(F.lit(size - 1)), 6)
    taken = F.expr(f"shiftrightunsigned(bits, cast({column} & 63 AS int)) & 1 = 1")
    return rows.join(F.broadcast(table), block == F.col("block")).where(taken).drop("block", "bits")


def contaminations(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, start_word (from 0), n_words, distance (bits), similarity of the most similar window, at percent/100 or more."""
    items = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("long").alias("item_id"), once(words(F.col(text_column)), "w"))
    items = items.select("item_id", once(shingles("w", shingle), "h")).where(F.size("h") > 0).select("item_id", F.size("h").alias("n"), "h").distinct()
    items = stored(with_simhash(items, "h"), "benchmark-items")
    texts = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # An id may have several texts; copies of a text under an id are one document.
    texts = texts.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "key", once(words(F.col("text")), "w")).select("doc_id", "key", once(shingles("w", shingle), "h"))

    # A similar window of m shingles holds that many of its item's n, so a window, and its document, needs as many hits.
    def need(n: Column, m: Column) -> Column:
        return F.ceil((n + m) * percent / (100 + percent))

    least = items.agg(F.min(F.ceil(F.col("n") * percent / 100))).first()[0] or 1
    table, size = slot_table(items.select(F.explode("h").alias("x")), "x", "benchmark-slots")
    found = hashed(texts).where(F.size("h") >= F.lit(least)).select("doc_id", "key", F.size("h").alias("size"), F.posexplode("h").alias("at", "x"))
    lengths = stored(items.select("n", F.explode("h").alias("x")).distinct(), "benchmark-lengths")
    # m is the size of the windows for items of n shingles: the whole document where it is shorter.
    m = F.least("n", "size").alias("m")
    hits = in_slots(found, "x", table, size).join(lengths, "x").select("doc_id", "key", "size", "n", m, (F.col("at") + 1).alias("at"))
    window = ["doc_id", "key", "size", "n", "m"]
    hits = hits.groupBy(*window).agg(F.collect_set("at").alias("at")).where(F.size("at") >= need(F.col("n"), F.col("m"))).select(*window, F.explode("at").alias("at"))
    # Every window of that size over enough hits, within the document.
    starts = hits.select(*window, F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("m") + 1), F.col("at"))).alias("start"))
    starts = starts.groupBy(*window, "start").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= need(F.col("n"), F.col("m")))
    starts = stored(starts.where(F.col("start") + F.col("m") - 1 <= F.col("size")).select("doc_id", "key", "n", "m", "start"), "window-starts")
    # Of the texts only those with a window move; the arrays of hashes are made where the text arrives.
    both = F.xxhash64("doc_id", "key").alias("both")
    table, size = slot_table(starts.select(both).distinct(), "both", "window-slots")
    few = in_slots(texts.select("*", both), "both", table, size).groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    cut = once(F.slice("h", F.col("start"), F.col("m")), "h")
    windows = starts.join(hashed(few).hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "n", "start", cut)
    # The expression of a fingerprint is used eight times behind; stored, it is computed once.
    windows = stored(with_simhash(windows, "h"), "windows")
    place = ["doc_id", "key", "n", "start"]
    keyed = windows.select(*place, "print", F.explode(blocks(F.col("print"), False)).alias("b")).select(*place, "print", "b.*")
    index = items.select("item_id", "n", F.col("print").alias("item_print"), F.explode(blocks(F.col("print"), True)).alias("b")).select("item_id", "n", "item_print", "b.*")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = keyed.join(index, ["n", "block", "value"]).where(distance <= RADIUS).select(*place, "item_id", distance.alias("distance")).distinct()
    pairs = near.join(windows.drop("print").hint("merge"), place).join(items.select("item_id", F.col("h").alias("g")).withColumnRenamed("item_id", "_item"), F.col("item_id") == F.col("_item"))

    def occurrences(column: str, x: Column) -> Column:
        return F.size(F.filter(F.col(column), lambda y: y == x))

    common = F.aggregate(F.array_intersect("h", "g"), F.lit(0), lambda acc, x: acc + F.least(occurrences("h", x), occurrences("g", x)))
    scored = pairs.select("doc_id", "item_id", F.size("h").alias("n"), "start", "distance", common.cast("long").alias("common"), (F.size("h") + F.size("g")).cast("long").alias("both"))
    scored = scored.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common")))
    similarity = F.col("common") / (F.col("both") - F.col("common"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n", "distance", similarity.alias("similarity")), F.struct(similarity, -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", (F.col("b.start") - 1).cast("long").alias("start_word"), (F.col("b.n") + shingle - 1).cast("long").alias("n_words"), F.col("b.distance").cast("long").alias("distance"), F.col("b.similarity").alias("similarity"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents in which no window is similar to a benchmark item."""
    return without(documents, lambda rows: contaminations(rows, benchmark), "contaminated", id_column, text_column)
