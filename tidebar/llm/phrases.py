"""Phrase collocations by best-first growth: words to pairs to longer phrases, only where a bound says it can matter.

A phrase of 2 to 4 words with a count a has, for each cut into a first part and a rest, the score
2,000,000 * a / (count of the first part + count of the rest); its lowest cut counts. An extension of a prefix p holds
p's first word as a first part and has a count of at most p's, and at most that of the pair that would follow, so with
x as the lesser of both, 2,000,000 * x / (count of the first word + x) bounds every score behind p.

Words and then pairs of frequent words are counted in full. From there on each wave looks at the score of the language's
2000th phrase so far and counts, in one pass over the texts, only what can still change the answer:
all extensions of prefixes whose bound reaches that score, extensions by a word to either side of phrases that reach it (a longer
phrase with most of its occurrences drops a phrase) unless the pairs beside it are too rare to matter, and parts of a phrase that its score needs.
When nothing open reaches the 2000th score, ties included, the result is settled. A language with
fewer phrases grows until nothing is open.

What a wave counts is named to the tasks by bit filters of a fixed size (FILTER_BITS each). A filter lets everything through that was asked for and
maybe more; whether a phrase is counted depends on the phrase alone, so every count is whole. A word is a
64-bit hash of language and letters, and phrases are tuples of those: every distinct word is compared with its hash, and a
hash that stands for two words starts the work again with another hash.

A null text is empty, a null language is `und`; language and text are otherwise taken as they are. Repeated rows count again.
Ties go by higher count, then by the phrase's UTF-8 bytes. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import map_batches, slices, stored, text_bytes
from tidebar.llm.words import LOWER, hashed, mix, word_ranges

_U = np.uint64
#: Least count of a phrase.
LEAST = 30
#: A longer phrase with this share (in percent) of a phrase's count drops it.
SHARE = 80
#: Phrases returned for each language.
TOP = 2000
SCALE = 2_000_000
#: Bits of a filter; a power of two. Five filters at most are held at a time.
FILTER_BITS = 1 << 24
#: Bytes of text whose phrases are counted together before they leave a task.
RUN_BYTES = 6 << 20
#: A wave also grows what reaches the score of this rank, which saves waves.
AHEAD = 3000

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD_BYTES = ~PIECE_ENDS
WORD_BYTES[[32, 9]] = False
W = ["w1", "w2", "w3", "w4"]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (language, text) with some RUN_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, 1):
            held.append(part)
            size += part.nbytes
            if size >= RUN_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Words:
    """The words of a run of texts as hashes, and whether the next word follows in the same piece."""

    def __init__(self, part: pa.RecordBatch, salt: int):
        self.data, offsets, self.starts, self.ends = word_ranges(part.column(1), WORD_BYTES)
        self.lower = LOWER[self.data]
        letters = np.roll(np.arange(256, dtype=np.uint8), 37 * salt)  # other bytes for the same letters: another hash
        first = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(part.num_rows), np.diff(first))
        names, at = text_bytes(part.column(0))
        language = mix(hashed(letters[names], at[:-1], at[1:]))  # mixed first, or `en` in es would be `es` in en
        self.hashes = mix(hashed(letters[self.lower], self.starts, self.ends) ^ language[self.rows])
        stops = np.flatnonzero(PIECE_ENDS[self.data])
        self.follows = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.follows[:-1] = (np.searchsorted(stops, self.starts[1:]) == np.searchsorted(stops, self.ends[:-1])) & (self.rows[1:] == self.rows[:-1])


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def word_rows(salt: int):
    """Batches of (language, text) to (word, language, letters, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in _gathered(batches):
            words = Words(part, salt)
            distinct, at, counts = np.unique(words.hashes, return_index=True, return_counts=True)
            raw = words.lower.tobytes()
            letters = [raw[a:b].decode() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
            language = part.column(0).take(pa.array(words.rows[at]))
            yield pa.RecordBatch.from_arrays([_long(distinct), language, pa.array(letters, pa.string()), pa.array(counts)], ["word", "lang", "letters", "n"])

    return run


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples and how often each stands there."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return (values << _U(by)) | (values >> _U(64 - by))


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = _U(FILTER_BITS - 1)
    found = np.ones(len(keys), bool)
    for place in (keys & mask, (keys >> _U(32)) & mask):
        found &= (bits[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1
    return found


def pair_rows(salt: int, filters):
    """Batches of (language, text) to (w1, w2, n), both words let through by the filter `word`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part in _gathered(batches):
            words = Words(part, salt)
            known = _held(filters.value["word"], words.hashes)
            at = np.flatnonzero(words.follows[:-1] & known[:-1] & known[1:])
            columns, n = _counted([words.hashes[at], words.hashes[at + 1]])
            yield pa.RecordBatch.from_arrays([*map(_long, columns), pa.array(n)], ["w1", "w2", "n"])

    return run


def longer_rows(salt: int, filters):
    """Batches of (language, text) to (w1, w2, w3, w4 or null, n) of the phrases of three and four words that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        asked = filters.value
        none = np.zeros(FILTER_BITS // 64, _U)
        right_2, left_2, right_3, left_3, whole_3 = (asked.get(k, none) for k in ("right2", "left2", "right3", "left3", "whole3"))
        for part in _gathered(batches):
            words = Words(part, salt)
            w, size = words.hashes, len(words.hashes)
            second, third = _turned(w, 21), _turned(w, 42)
            pair = np.zeros(size + 3, bool)
            at = np.flatnonzero(words.follows)
            pair[at] = _held(asked["pair"], w[at] ^ second[at + 1])
            three = np.flatnonzero(pair[:size] & pair[1 : size + 1])
            key, rest = w[three] ^ second[three + 1], w[three + 1] ^ second[three + 2]
            whole = key ^ third[three + 2]
            grown = _held(right_2, key)
            found = three[grown | _held(left_2, rest) | _held(whole_3, whole)]
            columns, n = _counted([w[found + k] for k in range(3)])
            yield pa.RecordBatch.from_arrays([*map(_long, columns), pa.nulls(len(n), pa.int64()), pa.array(n)], [*W, "n"])
            more = pair[three + 2]
            four = three[more]
            rest = w[four + 1] ^ second[four + 2] ^ third[four + 3]
            found = four[grown[more] | _held(right_3, whole[more]) | _held(left_3, rest)]
            columns, n = _counted([w[found + k] for k in range(4)])
            yield pa.RecordBatch.from_arrays([*map(_long, columns), pa.array(n)], [*W, "n"])

    return run


def _key(*columns: str) -> Column:
    """The filter key of a phrase, as the tasks make it."""
    parts = [columns[0], *(f"(shiftleft({c}, {21 * k}) | shiftrightunsigned({c}, {64 - 21 * k}))" for k, c in enumerate(columns[1:], 1))]
    return F.expr(" ^ ".join(parts))


def _filters(keys: DataFrame):
    """Bit filters by kind from rows (kind, key), as a broadcast variable of at most FILTER_BITS bits a kind."""
    places = F.explode(F.expr(f"array(key & {FILTER_BITS - 1}L, shiftrightunsigned(key, 32) & {FILTER_BITS - 1}L)")).alias("place")
    bits = keys.select("kind", places).groupBy("kind", F.expr("shiftright(place, 6)").alias("block"))
    found = bits.agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")).toArrow()
    out = {}
    kinds = found["kind"].to_numpy()
    for kind in set(kinds):
        here = kinds == kind
        out[kind] = np.zeros(FILTER_BITS // 64, _U)
        out[kind][found["block"].to_numpy()[here]] = found["bits"].to_numpy()[here].view(_U)
    return keys.sparkSession.sparkContext.broadcast(out)


def _score(a: str, *parts: str) -> str:
    return f"CAST({SCALE} AS DECIMAL(38, 0)) * {a} DIV ({' + '.join(parts)})"


def _words(texts: DataFrame) -> tuple[DataFrame, int]:
    """word, lang, letters, n of every distinct word, under a hash that tells all of them apart; and its number."""
    for salt in range(8):
        rows = map_batches(texts, word_rows(salt), "word long, lang string, letters string, n long")
        words = stored(rows.groupBy("word", "lang", "letters").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("word").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty():
            return words, salt
    raise RuntimeError("no hash of 64 bits told all words apart")


def _pairs(texts: DataFrame, words: DataFrame, salt: int) -> DataFrame:
    """lang, w1, w2, a, f1, f2 of frequent pairs, with the highest counts of pairs before (`before`) and behind (`behind`) it."""
    frequent = words.where(F.col("n") >= LEAST).select("word", "lang", "n")
    filters = _filters(frequent.select(F.lit("word").alias("kind"), F.col("word").alias("key")).unionByName(_no_keys(texts)))
    pairs = map_batches(texts, pair_rows(salt, filters), "w1 long, w2 long, n long")
    pairs = stored(pairs.groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST), "phrase-pairs")
    first = frequent.select(F.col("word").alias("w1"), "lang", F.col("n").alias("f1"))
    second = frequent.select(F.col("word").alias("w2"), F.col("n").alias("f2"))
    behind = pairs.groupBy(F.col("w1").alias("w2")).agg(F.max("a").alias("behind"))
    before = pairs.groupBy(F.col("w2").alias("w1")).agg(F.max("a").alias("before"))
    whole = pairs.join(first, "w1").join(second, "w2").join(behind, "w2", "left").join(before, "w1", "left")
    return stored(whole.fillna(0, ["behind", "before"]).select("lang", "w1", "w2", "a", "f1", "f2", "before", "behind"), "phrase-pair-parts")


def _no_keys(df: DataFrame) -> DataFrame:
    """No rows of (kind, key) but a kind for each filter, so that an empty one is there too."""
    return df.sparkSession.createDataFrame([("word", 0), ("pair", 0)], "kind string, key long")


def _longest(rows: DataFrame, *sides: list[str]) -> DataFrame:
    """The highest count among the counted phrases one word longer, by the phrase's words."""
    parts = [rows.select(*[F.col(c).alias(w) for c, w in zip(side, W)], F.col("n").alias("longer")) for side in sides]
    return parts[0].unionByName(parts[1]).groupBy(*W[: len(sides[0])]).agg(F.max("longer").alias("longer"))


def candidates(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """All phrases counted so far: lang, m, w1-w4, a, l, r, score, bound of extensions, dropped, neighbours' counts and missing parts.

    score is null while a part is not counted yet; limit is then the highest it can be.
    """
    three, four = grams.where("w4 IS NULL").drop("w4"), grams.where("w4 IS NOT NULL")
    null = F.lit(None).cast("long")
    two = pairs.join(_longest(three, ["w1", "w2"], ["w2", "w3"]), ["w1", "w2"], "left")
    two = two.select("lang", F.lit(2).alias("m"), "w1", "w2", null.alias("w3"), null.alias("w4"), "a", "f1", "before", "behind", "longer", F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r"))).alias("cuts"))
    head = pairs.select("lang", "w1", "w2", "f1", F.col("a").alias("f12"), "before")
    tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"), "behind")
    third = three.withColumnRenamed("n", "a").join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    third = third.join(_longest(four, ["w1", "w2", "w3"], ["w2", "w3", "w4"]), ["w1", "w2", "w3"], "left")
    cuts = F.expr("array(struct(f1 AS l, f23 AS r), struct(f12 AS l, f3 AS r))").alias("cuts")
    third = third.select("lang", F.lit(3).alias("m"), "w1", "w2", "w3", null.alias("w4"), "a", "f1", "before", "behind", "longer", cuts)
    last = pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("a").alias("f34"), F.col("f2").alias("f4"))
    prefix = three.withColumnRenamed("n", "f123")
    suffix = three.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("n").alias("f234"))
    fourth = four.withColumnRenamed("n", "a").join(head, ["w1", "w2"]).join(last, ["w3", "w4"])
    fourth = fourth.join(prefix, ["w1", "w2", "w3"], "left").join(suffix, ["w2", "w3", "w4"], "left")
    cuts = F.expr("array(struct(f1 AS l, f234 AS r), struct(f12 AS l, f34 AS r), struct(f123 AS l, f4 AS r))").alias("cuts")
    zero = F.lit(0).cast("long")
    fourth = fourth.select("lang", F.lit(4).alias("m"), *W, "a", "f1", zero.alias("before"), zero.alias("behind"), null.alias("longer"), cuts)
    rows = two.unionByName(third).unionByName(fourth)
    # The lowest cut, ties to the first; a part not counted yet has the phrase's count at least.
    scores = F.expr(f"transform(cuts, c -> {_score('a', 'coalesce(c.l, a)', 'coalesce(c.r, a)')})")
    rows = rows.withColumn("scores", scores).withColumn("limit", F.array_min("scores"))
    rows = rows.withColumn("cut", F.expr("cuts[cast(array_position(scores, limit) - 1 AS int)]"))
    known = F.expr("NOT exists(cuts, c -> c.l IS NULL OR c.r IS NULL)")
    most = F.least("a", "behind")
    return rows.select(
        "lang", "m", *W, "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "limit",
        F.when(known, F.col("limit")).alias("score"),
        F.when((F.col("m") < 4) & (most >= LEAST), F.expr(_score("least(a, behind)", "f1", "least(a, behind)"))).otherwise(-1).alias("bound"),
        F.coalesce(100 * F.col("longer") >= SHARE * F.col("a"), F.lit(False)).alias("dropped"),
        ((F.col("m") < 4) & (100 * F.col("before") >= SHARE * F.col("a"))).alias("left_open"),
        ((F.col("m") < 4) & (100 * F.col("behind") >= SHARE * F.col("a"))).alias("right_open"),
        ((F.col("m") == 4) & F.expr("cuts[2].l IS NULL")).alias("wants_prefix"),
        ((F.col("m") == 4) & F.expr("cuts[0].r IS NULL")).alias("wants_suffix"),
    )


def levels(found: DataFrame, top: int, ahead: int) -> DataFrame:
    """lang, stop, near: the scores of the top-th and ahead-th phrase of a language that is not dropped; 0 where there are fewer."""
    tally = found.where("score IS NOT NULL AND NOT dropped").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("many"))
    order = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tally = tally.select("lang", "score", F.sum("many").over(order).alias("upto"))
    return tally.groupBy("lang").agg(*[F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias(name) for rank, name in ((top, "stop"), (ahead, "near"))])


def _open(found: DataFrame, asked: DataFrame | None) -> DataFrame:
    """What could be counted next: lang, kind, w1, w2, w3, reach (no score above it depends on it)."""
    m, score = F.col("m").cast("string"), F.col("score")
    alive = F.when(~F.col("dropped"), score)
    nothing = F.lit(None).cast("long")

    def item(kind: Column, reach: Column, words: list[str]) -> Column:
        return F.struct(kind.alias("kind"), *[(F.col(c) if c else nothing).alias(w) for c, w in zip(words, W)], reach.alias("reach"))

    own = ["w1", "w2", "w3"]
    right = item(F.concat(F.lit("right"), m), F.greatest("bound", F.when(F.col("right_open"), alive)), own)
    left = item(F.concat(F.lit("left"), m), F.when(F.col("left_open"), alive), own)
    prefix = item(F.lit("whole3"), F.when(F.col("wants_prefix"), F.col("limit")), own)
    suffix = item(F.lit("whole3"), F.when(F.col("wants_suffix"), F.col("limit")), ["w2", "w3", "w4"])
    items = found.select("lang", F.explode(F.array(right, left, prefix, suffix)).alias("i")).select("lang", "i.*").where("reach >= 0")
    items = items.groupBy("lang", "kind", "w1", "w2", "w3").agg(F.max("reach").alias("reach"))
    if asked is None:
        return items
    keys = ["kind", "w1", "w2", "w3"]
    items = items.fillna(0, ["w3"]).join(asked.fillna(0, ["w3"]), keys, "left_anti")
    # All that stands behind a pair was counted with it.
    grown = asked.where("kind = 'right2'").select(F.lit("right3").alias("kind"), "w1", "w2")
    return items.join(grown, ["kind", "w1", "w2"], "left_anti")


def collocations(
    documents: DataFrame, lang_column: str = "lang", text_column: str = "text", top: int = TOP, ahead: int = AHEAD
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by score."""
    texts = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    words, salt = _words(texts)
    pairs = _pairs(texts, words, salt)
    grams = documents.sparkSession.createDataFrame([], "w1 long, w2 long, w3 long, w4 long, n long")
    pair_keys = pairs.select(F.lit("pair").alias("kind"), _key("w1", "w2").alias("key")).unionByName(_no_keys(texts))
    asked = None
    while True:
        found = stored(candidates(pairs, grams), "phrases")
        level = stored(levels(found, top, max(top, ahead)), "phrase-levels")
        due = _open(found, asked).join(level, "lang", "left")
        due = stored(due.where("reach >= coalesce(near, 0)").select("kind", "w1", "w2", "w3", (F.col("reach") >= F.coalesce("stop", F.lit(0))).alias("must")).distinct(), "phrase-due")
        if due.where("must").isEmpty():
            break
        long = F.col("kind").endswith("3")
        keys = due.select("kind", F.when(long, _key("w1", "w2", "w3")).otherwise(_key("w1", "w2")).alias("key"))
        filters = _filters(keys.unionByName(pair_keys))
        rows = map_batches(texts, longer_rows(salt, filters), "w1 long, w2 long, w3 long, w4 long, n long")
        counted = rows.groupBy(*W).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        grams = stored(grams.unionByName(counted).groupBy(*W).agg(F.max("n").alias("n")), "phrase-grams")
        filters.unpersist()
        due = due.select("kind", "w1", "w2", "w3")
        asked = due if asked is None else asked.unionByName(due)
    kept = found.where("score IS NOT NULL AND NOT dropped").join(level, "lang").where("score >= stop")
    for k, w in enumerate(W):
        kept = kept.join(words.select(F.col("word").alias(w), F.col("letters").alias(f"t{k}")), w, "left")
    kept = kept.select("lang", F.concat_ws(" ", *[f"t{k}" for k in range(4)]).alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
