"""License scan: exact phrases, and fuzzy search for short notices.

A text becomes its words (lower-cased A-Z; runs of digits, letters and any character beyond ASCII) joined by single
spaces. A notice may be there with up to its number of edits k. Cut into k + 1 pieces, one piece of it is there
unchanged, so an automaton over all pieces finds every place to look at; the regex library's bounded-error
matching then verifies the edits there and gives the span. Base phrases are found by their words exactly.

Null text: empty, no words. Repeated rows are scanned each by itself; an empty table gives an empty result; a very long text is
scanned whole, with candidates merged where they overlap. Ties between readings of one place go to fewer edits, then the
notice listed first. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import keeping, kept_by_worker, map_batches, slices
from tidebar.llm.words import LOWER, hashed, word_ranges

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

# The phrases that are searched exactly, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Short notices (as words) with their labels and the number of edits allowed, about one for twelve characters.
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache-2", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under a creative commons attribution noncommercial", "cc-by-nc", 4),
    ("this work is licensed under the gnu general public license", "gpl", 4),
    ("it under the terms of the gnu general public license", "gpl", 4),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 6),
    ("all rights reserved", "all-rights-reserved", 1),
)
EDGE = 12


def pieces(notice: str, errors: int) -> list[tuple[str, int]]:
    """The notice in errors + 1 consecutive pieces of like length, each with its offset; one is intact in any copy with that many edits."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


def compiled(notices: tuple):
    """Seeds and patterns of the notices, made once by each worker."""
    return kept_by_worker(("licenses", notices), lambda: _compiled(notices))


def _compiled(notices: tuple):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for number, (words, _, errors) in enumerate(notices):
        for piece, offset in pieces(words, errors):
            seeds.setdefault(piece, []).append((number, offset))
    automaton = ahocorasick.Automaton()
    for piece, places in seeds.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    some = [rf"(?:{regex.escape(words)}){{e<={errors}}}" for words, _, errors in notices]
    return automaton, [(regex.compile(x), regex.compile("(?b)" + x)) for x in some]


def readings(patterns: tuple, words: str, start: int, end: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of every stretch between start and end that patterns (any reading, the best one) match; none has more than size characters.

    Of readings that overlap the best one counts; what lies before it and behind it is searched by the same rule.
    """
    leftmost, best = patterns
    while start < end and (first := leftmost.search(words, start, end)):
        start = first.start()
        reach = min(end, start + 2 * size)
        match = best.search(words, start, reach) or first
        # A reading that overlaps this one may be better still.
        while match.end() + size > reach < end:
            reach = min(end, match.end() + size)
            better = best.search(words, start, reach)
            if not better or sum(better.fuzzy_counts) >= sum(match.fuzzy_counts):
                break
            match = better
        yield from readings(patterns, words, start, match.start(), size)
        yield match.start(), match.end(), sum(match.fuzzy_counts)
        start = max(match.end(), start + 1)


def fuzzy_matches(words: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in a text of words, every stretch that holds a notice within its edits once."""
    automaton, patterns = compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, places) in automaton.iter(words):
        for number, offset in places:
            errors, whole = notices[number][2], len(notices[number][0])
            at = end + 1 - size - offset
            a, b = max(0, at - errors), min(len(words), at + whole + errors)
            held = windows.setdefault(number, [])
            if held and a <= held[-1][1]:
                held[-1][1] = max(b, held[-1][1])
            else:
                held.append([a, b])
    found = []
    for number, held in windows.items():
        # A window that later windows reach back into is merged with them.
        merged: list[list[int]] = []
        for a, b in sorted(held):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            found += [(number, *reading) for reading in readings(patterns[number], words, a, b, len(notices[number][0]) + notices[number][2])]
    return sorted(found, key=lambda m: (m[1], m[3], m[0]))


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, character span in the words text, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        one = [word_ranges(pa.array([words]), WORD) for words, _ in base]
        wanted = [hashed(data, a, b) for data, _, a, b in one]
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 1):
                n = len(part)
                data, offsets, begin, end = word_ranges(part.column(1), WORD)
                data = LOWER[data]
                hashes, first = hashed(data, begin, end), np.searchsorted(begin, offsets)
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set] = [set() for _ in range(n)]
                for (_, label), phrase in zip(base, wanted):
                    hit = np.ones(max(0, len(hashes) - len(phrase) + 1), bool)
                    for j, h in enumerate(phrase):
                        hit &= hashes[j : len(hashes) - len(phrase) + 1 + j] == h
                    at = np.flatnonzero(hit)
                    owner = np.searchsorted(first, at, "right") - 1
                    inside = at + len(phrase) <= first[owner + 1]
                    at, owner = at[inside], owner[inside]
                    np.add.at(n_base, owner, 1)
                    np.minimum.at(low, owner, at - first[owner])
                    np.maximum.at(high, owner, at - first[owner])
                    for row in np.unique(owner).tolist():
                        labels[row].add(label)
                raw = np.where(WORD[data], data, 32).astype(np.uint8).tobytes()
                rows = []
                for row in range(n):
                    words = " ".join(filter(None, raw[offsets[row] : offsets[row + 1]].decode("utf-8", "replace").split(" ")))
                    found = fuzzy_matches(words, notices)
                    best = max((1 - edits / (notices[k][2] + 1) for k, _, _, edits in found), default=0.0)
                    rows.append(
                        {
                            "labels": ",".join(sorted(labels[row] | {notices[k][1] for k, *_ in found})),
                            "score": 1.0 if labels[row] else best,
                            "matches": [{"label": notices[k][1], "start": a, "end": b, "edits": e} for k, a, b, e in found],
                        }
                    )
                seen = n_base > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(n_base), pa.array(low, mask=~seen), pa.array(high, mask=~seen),
                        pa.array([",".join(sorted(x)) for x in labels]), pa.array([r["labels"] for r in rows]), pa.array([r["score"] for r in rows], pa.float64()), pa.array([r["matches"] for r in rows], span),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long, edits: int>>"
    return map_batches(rows, keeping(run, "licenses"), schema)
