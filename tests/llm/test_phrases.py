"""Phrase collocations against a count of every phrase, with short lists so that bounds decide, and on awkward rows."""

import collections
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from tidebar.llm import common, phrases, words

SCHEMA = "doc_id long, text string, lang string, rank long, n long, word long, phrase string"
FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(given, top):
    found = collections.defaultdict(collections.Counter)
    for text, lang in given:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    found["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in found.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= 30}
        longest = collections.Counter()
        for p, a in known.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rows = []
        for p, a in known.items():
            if p in longest and 100 * longest[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return sorted(out)


def frame(spark, given):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "x") for i, (t, lang) in enumerate(given)], SCHEMA).repartition(3)


def got(spark, given, top):
    found = phrases.collocations(frame(spark, given), top=top, ahead=top)
    assert set(FIELDS) <= set(found.columns)
    return sorted(tuple(r) for r in found.select(FIELDS).collect())


def corpus(seed, rows=500):
    """Zipf words, with fixed expressions of two to six words mixed in at many rates."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    fixed = [rng.choices(vocabulary, k=rng.randint(2, 6)) for _ in range(25)]
    out = []
    for _ in range(rows):
        words = []
        while len(words) < 40:
            words += rng.choice(fixed[: rng.randint(1, 25)]) if rng.random() < 0.4 else rng.choices(vocabulary, weights, k=rng.randint(1, 4))
            if rng.random() < 0.1:
                words[-1] += rng.choice(".,;:!?\n\r")
        out.append((" ".join(words), rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("seed,top", [(1, 5), (2, 25), (3, 2000)])
def test_equals_a_count_of_every_phrase(spark, seed, top):
    given = corpus(seed)
    want = plain(given, top)
    assert len(want) > 10
    assert got(spark, given, top) == want


def test_awkward_rows(spark):
    long = ("New York City is  Big\tand BIG. " * 3000) + "É é"
    given = [(None, "en"), ("", None), (" \t .,\n", "en"), (long, "en"), ("a b c d e " * 40, None), ("a b, " * 40, "und"), ("ß ẞ 日本 語\x0b" * 31, "ja"), ("x y" * 29, "zz")]
    given += [("same row again", "en")] * 31
    want = plain(given, 2000)
    assert {r[0] for r in want} == {"en", "und", "ja"}
    assert got(spark, given, 2000) == want


def test_ties_at_the_last_rank_go_by_count_then_bytes(spark):
    given = [(f"{a} {b}", "en") for a, b in (("b", "é"), ("b2", "z"), ("a", "q"))] * 30 + [("k l", "en")] * 40
    want = plain(given, 3)
    assert [r[2] for r in want] == ["k l", "a q", "b é"]
    assert got(spark, given, 3) == want


def test_empty_table(spark):
    assert got(spark, [], 10) == []


def test_hashing_a_run_needs_tables_of_a_block():
    rng = np.random.default_rng(3)
    text = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 700_000)), "x" * 3000, "", "é a"])
    data, _, starts, ends = words.word_ranges(text)
    sys.modules.pop(common.WORKER_STORE, None)
    found = words.hashed(data, starts, ends)
    assert len(common.kept_by_worker(("powers",), dict)["up"]) <= 2 * words.BLOCK_BYTES < len(data)
    raw = data.tobytes()
    seen = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), found.tolist()):
        assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen)
    alone = words.hashed(data[starts[-3] : ends[-3]], np.array([0]), np.array([3000]))
    assert alone[0] == found[-3] and len(words.hashed(data, starts[:0], ends[:0])) == 0
