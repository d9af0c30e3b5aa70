"""Tokenizer alignment and covering near-duplicates against brute force, on given documents and awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidebar.llm import alignment, covering
from tidebar.llm.common import table
from tidebar.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "long words of a very long text. " * 4_000
AWKWARD = [
    (1, "a b c d"), (2, None), (3, ""), (4, "  \t\n "), (5, "a  b\nc d"), (5, "a  b\nc d"), (6, LONG), (7, LONG), (8, "A B C D"), (9, "x"),
    (10, "it's <|endoftext|> 12ab!!&&& é 日本語, 😀"), (None, "a b c d"), (None, "no id here"), (11, "<s> </s> ▁ x▁y"), (12, " " * 300 + "x" * 3000), (13, "ﬁ ① ﾊ​\x00z"),
]
SCHEMA = "doc_id long, text string, id long, print long, pair long, row long, component long, key string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 9, 1, 2, 3, 4, "k") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(found):
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def sides():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(given):
    a_side, b_side = sides()
    letter = alignment.byte_letters()
    a_bytes = {i: bytes(letter[c] for c in t) for t, i in a_side.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    documents, holders = [], collections.Counter()
    for i, text in given:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        x, y = [a_bytes[t] for t in a], [piece(t) for t in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            a, b, x, y = [], [], [], []
        ax, by = np.cumsum([0, *map(len, x)]), np.cumsum([0, *map(len, y)])
        links = [(a[p], b[q]) for p in range(len(a)) for q in range(int(np.searchsorted(by, ax[p], "right")) - 1, int(np.searchsorted(by, ax[p + 1])))]
        ends = sorted(set(ax[1:].tolist()) & set(by[1:].tolist()))
        groups, p, q = [], 0, 0
        for e in ends:
            p2, q2 = int(np.searchsorted(ax, e)), int(np.searchsorted(by, e))
            groups.append(",".join(map(str, a[p:p2])) + "|" + ",".join(map(str, b[q:q2])))
            p, q = p2, q2
        documents.append((i, a, b, groups, links))
        holders.update(set(links))
    highest = {}
    for (x, _), n in holders.items():
        highest[x] = max(highest.get(x, 0), n)
    return [
        (
            i, len(a), len(b), len(groups), len(links), sum(holders[k] == highest[k[0]] for k in links), sum(holders[k] for k in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for i, a, b, groups, links in documents
    ]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_a_plain_one(spark, awkward, broadcast_pairs):
    given = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").limit(60).collect()] + AWKWARD
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert by_id(alignment.align(df, broadcast_pairs=broadcast_pairs).collect()) == by_id(plain_alignment(given))


def test_alignment_awkward_and_empty(awkward, empty):
    assert by_id(alignment.align(awkward).collect()) == by_id(plain_alignment(AWKWARD))
    assert alignment.align(empty).collect() == []


def test_byte_tokens_equal_the_tokenizer(spark):
    texts = [r[0] for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    a_side, _ = sides()
    work = alignment.aligner(alignment.BYTE_VOCABULARY, alignment.PIECE_VOCABULARY)
    rng = np.random.default_rng(1)
    texts += ["".join(chr(c) for c in rng.integers(1, 0x2FF, 40)) for _ in range(500)] + [" " * 5000, "\n" * 50 + "a", "'s 'T don't"]
    assert [x.tolist() for x in work.a.encode(texts)] == [x.ids for x in a_side.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Least id reachable for (id, print) rows; None where no row of a component has an id."""
    distinct = np.unique(np.array([p for _, p in prints], np.uint64))
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[k + 1 :] ^ distinct[k]) <= radius).tolist():
            x, y = sorted((find(k), find(k + 1 + j)))
            root[y] = x
    of = {int(p): find(k) for k, p in enumerate(distinct)}
    least = {}
    for i, p in prints:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return [least.get(of[p]) for _, p in prints]


@pytest.mark.parametrize("small", [covering.SMALL, 2])
def test_near_copies_equal_all_pairs(spark, small):
    given = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()] + AWKWARD
    base, rng = given[0][1].split()[:300], np.random.default_rng(3)
    for k in range(120):  # near copies of one text: crowded buckets
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(1, 6)), replace=False):
            words[at] = f"edit{k}x{at}"
        given.append((90_000 - k, " ".join(words)))
    found = covering.near_copies(spark.createDataFrame(given, "doc_id long, text string"), small=small).collect()
    prints = [(i, plain_print(t)) for i, t in given]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints, 4))]
    assert by_id(found) == by_id(want)


def test_links_join_every_pair_within_the_radius(spark):
    rng = np.random.default_rng(7)
    centre = [int(x) for x in rng.integers(0, 1 << 64, 40, dtype=np.uint64)]
    prints = set(centre)
    for c in centre[:20]:
        for _ in range(30):
            flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            prints.add(c ^ sum(1 << int(f) for f in flips))
    for radius, small in ((4, 8), (2, 3), (4, 100)):
        df = spark.createDataFrame([(covering.signed(p),) for p in prints], "print long")
        links = covering.close_links(df, radius, small).collect()
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in links)
        ids = {covering.signed(p): k for k, p in enumerate(sorted(prints))}
        root = list(range(len(ids)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in links:
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
        assert [find(k) for k in range(len(ids))] == plain_components([(k, p) for k, p in enumerate(sorted(prints))], radius)


def test_every_difference_within_the_radius_has_a_free_mask():
    rng = np.random.default_rng(2)
    for radius in (2, 4, 6):
        masks = covering.masks(radius)
        assert len(masks) == (1 << radius + 1) - 1 and all(masks)
        for _ in range(500):
            difference = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not m & difference for m in masks)


def test_majority_counts_long_runs():
    hashes = np.array([1] * 700 + [3] * 300 + [6] * 2, np.uint64)
    assert covering.majority(hashes, np.array([0, 1000, 1000, 1002])).tolist() == [1, 0, 6]
    assert covering.majority(np.zeros(0, np.uint64), np.array([0])).tolist() == []


def test_near_copies_awkward_and_empty(awkward, empty):
    prints = [(i, plain_print(t)) for i, t in AWKWARD]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints, 4))]
    assert by_id(covering.near_copies(awkward).collect()) == by_id(want)
    assert covering.near_copies(empty).collect() == []


def test_queries_read_whole_tables(spark):
    assert pa is not None
    total = table(spark, SF, "documents").count()
    for name in ("op12_tokenizer_alignment", "op13_simhash_near_dedup"):
        assert QUERIES[name](spark, SF).count() == total


def test_crowded_buckets_list_midpoints_only_where_components_are_left(spark, monkeypatch):
    """Members of one table's bucket that are joined already, or few enough to compare, make no midpoints."""
    listed, at_midpoints = [], covering._at_midpoints

    def counted(crowded, radius):
        listed.append(crowded.count())
        return at_midpoints(crowded, radius)

    monkeypatch.setattr(covering, "_at_midpoints", counted)
    prints = sorted({covering.signed(0x0F0F << 40 | 1 << a | 1 << b) for a in range(20) for b in range(20)})
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    ids = {frozenset((a, b)) for a, b in covering.close_links(df.limit(60), 4).collect()}
    assert ids and listed == []
    links = covering.close_links(df, 4, small=16).collect()
    assert sum(listed) < len(prints) // 4
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[find(a)] = find(b)
    assert len({find(p) for p in prints}) == 1
