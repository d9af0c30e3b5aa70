"""Corpus operators against brute force, round trips and held-out labels, on small tables and awkward rows."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebar.llm import chat, common, decontaminate, exact_dedup, jaccard_join, licenses, packing, quality, records, tokens, toxicity, words, wrappers
from tidebar.llm.common import split_of, table
from tidebar.llm.queries import PROBE, QUERIES, SQL

SF = "/root/testdata/sf0.001"
LONG = "long words of a very long text. " * 20_000
AWKWARD = [(1, "a b c d"), (2, None), (3, ""), (4, "  \t\n "), (5, "a  b\nc d"), (5, "a  b\nc d"), (6, LONG), (7, LONG), (8, "A B C D"), (9, "x"), (10, "it's <|endoftext|> 12ab!!&&& é 日本語, 😀")]
SCHEMA = "doc_id long, text string, id long, key string, label int, component long, node string, _id long, __copy_id long, ids string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, 9, "k", 1, 2, "n", 3, 4, "q") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def rows(df):
    return [tuple(r) for r in df.collect()]


def shingle_set(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(given, n, percent):
    """doc_id -> (n_shingles, smallest id reachable), from all pairs."""
    sets = {}
    for i, t in given:
        sets[i] = shingle_set(t, n)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent,n", [(90, 3), (80, 5)])
def test_jaccard_join_equals_all_pairs(spark, documents, percent, n):
    base = rows(documents.select("doc_id", "text"))
    rng = np.random.default_rng(3)
    seed = [w for _, t in base[:6] for w in t.split()][:240]
    near = []
    for k in range(60):  # near copies of one text, each with edits of its own, around the threshold
        w = list(seed)
        for at in rng.choice(len(w), int(rng.integers(1, 10)), replace=False):
            w[at] = f"edit{k}x{at}"
        near.append((100_000 + k, " ".join(w)))
    tiny = [(200_000 + k, " ".join(f"t{x}" for x in range(k % 13))) for k in range(40)]
    given = base + near + tiny
    df = spark.createDataFrame(given, "doc_id long, text string")
    found = {r[0]: (r[1], r[2]) for r in rows(jaccard_join.similar_components(df, shingle=n, percent=percent))}
    assert found == components(given, n, percent)


def near_copies_of_one_text(many: int) -> list[tuple[int, str]]:
    """Texts with one to four edits of their own each; two of them link only where few words differ."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    out = []
    for k in range(many):
        words = list(base)
        for at in rng.choice(150, 1 + k % 4, replace=False):
            words[at] = f"edit{k}x{at}"
        out.append((k + 1, " ".join(words)))
    return out


def test_last_round_tries_few_pairs_of_near_copies(spark, monkeypatch):
    tried, verified = [], jaccard_join._verified

    def counted(pairs, sets, p, q):
        tried.append(pairs.count())
        return verified(pairs, sets, p, q)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    docs = near_copies_of_one_text(240)
    found = {r[0]: (r[1], r[2]) for r in rows(jaccard_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=90))}
    assert found == components(docs, 3, 90)
    assert tried[-1] < 5 * len(docs)


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), size, replace=False)) for size in (0, 1, 50, 51, 700)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = np.stack(jaccard_join.parities(np.concatenate(sets), bounds), axis=1).view(np.uint64)
    for x, a in zip(sets, bits):
        for y, b in zip(sets, bits):
            assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))


def test_similar_sets_share_an_index_key():
    rng = np.random.default_rng(5)
    for p, q in ((4, 5), (9, 10)):
        for t in range(1500):
            size = int(rng.integers(1, 300 if t % 2 else 40))
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, size // 4 + 1)))
            b = np.unique(np.concatenate([rng.permutation(a)[min(drop, len(a) - 1) :], rng.integers(0, 1 << 64, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            union = len(a) + len(b) - common
            if q * common >= p * union and common != union:
                keys, at = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), p, q)
                assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


def test_jaccard_join_awkward_and_empty(spark, awkward, empty):
    found = {r[0]: (r[1], r[2]) for r in rows(jaccard_join.similar_components(awkward, shingle=3, percent=90))}
    assert found == components(AWKWARD, 3, 90)
    assert rows(jaccard_join.similar_components(empty)) == []


def test_exact_dedup_groups_equal_texts(awkward, empty):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for fingerprint in (F.xxhash64, lambda c: F.length(c).cast("long")):  # the second gives one fingerprint to different chunks
        found = rows(exact_dedup.exact_groups(awkward, fingerprint=fingerprint).drop("first_rows"))
        expected = []
        for i, t in AWKWARD:
            group = [j for j, u in AWKWARD if norm(u) == norm(t)]
            expected.append((i, min(group), len(group), i == min(group), hashlib.sha256(norm(t).encode()).hexdigest()))
        assert sorted(found) == sorted(expected)
    assert rows(exact_dedup.exact_groups(empty)) == []


def test_drop_copies_keeps_one_row_and_all_columns(awkward, empty):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6, 8, 9, 10]
    assert {r["__copy_id"] for r in kept.collect()} == {4}
    assert rows(exact_dedup.drop_copies(empty)) == []


def test_word_encoder_equals_the_tokenizer():
    encode = tokens.encoder(records.VOCABULARY)
    texts = [t for _, t in AWKWARD if t != LONG] + ["A  b\tc", "<|endoftext|> x<|startoftext|>y", "it's THE end's don't!!!s 'S", "x\x1cz\x85 q", "İ K ﬁ", "́a b́,"]
    ids, bounds = encode.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encode.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_on_letters_that_normalise_to_marks():
    encode = tokens.encoder(records.VOCABULARY)
    texts = ["DENİZLİ, İ. İ K", "\u0958. \u0959! \u095c, \u0915\u093c.", "café, ÉTÉ. cafe\u0301, \ufb01.", "\u09dc? DENİZLİ x\u0307,"]
    ids, bounds = encode.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    tracked = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before, kept = tracked.size(), spark.conf.get(common.SHUFFLE_CLEANUP, "false")
    common.write_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "t"))
    for _ in range(50):
        if tracked.size() <= before:
            break
        time.sleep(0.1)
    assert tracked.size() <= before and spark.conf.get(common.SHUFFLE_CLEANUP, "false") == kept
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7


def test_index_keys_are_in_no_table(spark, tmp_path, monkeypatch):
    made, own = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label: made.append((label, df.columns)) or own(df, label))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y"), (1, "q r s"), (4, None)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs, shingle=2, percent=90).collect())
    assert found == [(1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 0, 4)]
    assert made[0] == ("sets", ["id", "n_shingles", "set_a", "set_b"]) and not any("keys" in columns for _, columns in made)


def test_word_encoder_learns_letters_once_and_normalises_them_together(monkeypatch):
    import public_tokenizers

    encode, calls = tokens.Encoder(public_tokenizers.path(records.VOCABULARY)), []

    class Counted:
        def __init__(self, own):
            self.own = own

        def normalize_str(self, text):
            calls.append(text)
            return self.own.normalize_str(text)

    class Held:
        def __init__(self, own):
            self.own, self.normalizer, self.encode_batch_fast = own, Counted(own.normalizer), own.encode_batch_fast

    own = encode.tokenizer
    monkeypatch.setattr(encode, "tokenizer", Held(own))
    texts = ["été, été. été! naïf ñandú", "abc abc, abc. (abc) a-b a-b, ,,, abc,,", None, ""]
    ids, bounds = encode.encode(pa.array(texts))
    assert len(calls) == 1  # three words of other letters than a to z, normalised in one text
    assert encode.parts == 1 + 4 + 4 + 4  # nothing; été naïf ñandú abc; , . ! ,,; (abc) a-b a-b, ,,,
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.encode(text or "", add_special_tokens=False).ids


def expected_ids(given):
    tokenizer = tokens.encoder(records.VOCABULARY).tokenizer
    return [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in given]


def test_records_read_back(spark, awkward, empty, tmp_path):
    found = sorted(rows(records.record_digests(spark, awkward, folder=str(tmp_path / "r"))))
    start, want = 0, []
    for i, ids in sorted(expected_ids(AWKWARD), key=lambda x: x[0]):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == sorted(want)
    assert rows(records.record_digests(spark, empty, folder=str(tmp_path / "e"))) == []


def test_records_index_and_checksums(spark, awkward, tmp_path):
    files = records.write_records(awkward, str(tmp_path / "r"), file_bytes=1000).orderBy("task", "file").collect()
    assert sum(f["records"] for f in files) == len(AWKWARD) and len(files) > 1
    doc_id, ids = records.read_record(files[0]["path"], 0)
    assert (doc_id, ids.tolist()) == (1, dict(expected_ids(AWKWARD[:1]))[1].tolist())
    framed = bytearray(records.frame(b"payload"))
    framed[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(__import__("io").BytesIO(bytes(framed)).read)


def test_packing_is_gapless_and_tight(spark, documents, awkward, empty):
    given = AWKWARD + rows(documents.select("doc_id", "text").where("doc_id > 100"))
    df = spark.createDataFrame(given, "doc_id long, text string")
    found = rows(packing.packed_documents(df))
    ids = sorted((i, x.tolist()) for i, x in expected_ids(given))
    want = sorted((i, k, a, min(4096, len(x) - a), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for i, x in ids for k, a in enumerate(range(0, len(x), 4096)))
    assert sorted(r[:5] for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r[3] for r in want) // 4096) + 2
    assert rows(packing.packed_documents(empty)) == []
    assert sum(len(bytes(r["ids"])) for r in packing.sequences(awkward).collect()) == 4 * sum(len(x) for _, x in expected_ids(AWKWARD))


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(s) for s in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(s)[0] for s in (9, 8, 7, 2, 1)] == [0, 1, 2, 1, 2]


def accuracy(spark, name, label, sf):
    labels = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    return sum(a == b for a, b in held) / len(held)


def test_held_out_accuracy(spark):
    assert accuracy(spark, "op1_toxicity", "toxic", "/root/testdata/sf0.1") > 0.97
    assert accuracy(spark, "op2_line_field_quality", "quality", "/root/testdata/sf0.1") > 0.97


def test_toxicity_locates_sentences():
    text = [f"clean words number {i}. plain talk." for i in range(60)] + [f"some good talk. you are an awful idiot. number {i} ends." for i in range(30)]
    model = toxicity.fit(pa.array(text), np.array([0] * 60 + [1] * 30))
    score, spans = toxicity.score_batch(model, pa.array(["nice day. such an awful idiot. bye", "nice day.", "", None]))
    assert score[0] > 0.7 > 0.3 > max(score[1:])
    assert ["nice day. such an awful idiot. bye"[s["start"] : s["end"]] for s in spans[0]] == [" such an awful idiot."] and not spans[1]


def test_long_clean_documents_are_not_toxic(spark):
    text = [f"clean words number {i}. plain talk." for i in range(60)] + [f"some good talk. you are an awful idiot. number {i} ends." for i in range(30)]
    unlearned = toxicity.fit(pa.array([], pa.string()), np.array([]))
    model = toxicity.fit(pa.array(text), np.array([0] * 60 + [1] * 30))
    clean = "clean words stand here. plain talk!\n" * 30_000
    score, spans = toxicity.score_batch(model, pa.array([clean, clean[:36_000] + "such an awful idiot. " + clean[36_000:]]))
    assert score[0] < 0.3 and not spans[0] and score[1] > 0.7 and len(spans[1]) == 1
    assert toxicity.score_batch(unlearned, pa.array([clean]))[0][0] < 0.3


def test_long_clean_documents_take_part_in_the_fit(spark):
    clean, toxic = "Words é stand here. " * 5_000, "you idiot. " * 5_000
    given = [(1, "short one."), (2, clean), (3, toxic), (4, "bad idiot"), (5, None)]
    labels = spark.createDataFrame([(i, int(i in (3, 4))) for i, _ in given], "doc_id long, toxic int")
    text, label, n_sentences = toxicity.labelled_bags(spark.createDataFrame(given, "doc_id long, text string"), labels, F.lit(True))
    assert label.tolist() == [0, 0, 1] and n_sentences.tolist() == [0, 5_001, 0]
    assert text.to_pylist()[::2] == ["short one.", "bad idiot"] and len(text[1].as_py()) == toxicity.SAMPLE_BYTES // 4 and text[1].as_py() in clean
    short = ["clean words number here. plain talk."] * 60 + ["some good talk. you are an awful idiot. so it ends."] * 30
    bags = [toxicity.fit(pa.array(short), np.array([0] * 60 + [1] * 30), np.array([n] + [0] * 89)).bias for n in (0, 50_000)]
    assert bags[1] < bags[0]


def test_classifiers_on_awkward_rows(spark, awkward, empty, documents):
    labels, learn = table(spark, SF, "labels"), split_of("doc_id", 3) != 1
    for operator in (toxicity.toxicity, quality.quality):
        for known in (labels, labels.limit(0)):
            found = operator(awkward, known, learn).collect()
            assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
        assert operator(empty, labels, learn).collect() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    score, transition = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 7])
    p, expected = quality.marginals(score, first, transition)
    total = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        weight, good = 0.0, np.zeros(b - a)
        moves = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] * v for i, v in enumerate(y)) + sum(transition[u, v] for u, v in zip(y, y[1:])))
            weight += w
            good += w * np.array(y)
            for u, v in zip(y, y[1:]):
                moves[u, v] += w
        assert np.allclose(p[a:b], good / weight)
        total += moves / weight
    assert np.allclose(expected, total)


def plain_scan(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan_equals_plain_search(spark, documents, awkward, empty):
    more = [(900, "Released UNDER the\nMIT-License; under the MIT licence. Apache License, Version 2.0 and CC-BY NC"), (901, "under the mit"), (902, "under the mit license under the mit license")]
    given = AWKWARD + more + rows(documents.select("doc_id", "text"))
    found = licenses.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=repr) == sorted(((i, *plain_scan(t)) for i, t in given), key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)
    assert licenses.scan(empty).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_fuzzy_search_finds_every_edited_notice():
    rng = np.random.default_rng(4)
    for number, (notice, _, most) in enumerate(licenses.NOTICES):
        for _ in range(10):
            text = list(notice)
            for _ in range(int(rng.integers(0, most + 1))):
                at = int(rng.integers(0, len(text)))
                [lambda: text.pop(at), lambda: text.insert(at, "z"), lambda: text.__setitem__(at, "z")][int(rng.integers(0, 3))]()
            edited = "".join(text)
            found = [m for m in licenses.fuzzy_matches("ab cd " + edited + " ef gh") if m[0] == number]
            assert found and all(m[3] <= most for m in found)
    assert licenses.fuzzy_matches("nothing of that kind stands here") == []


def test_fuzzy_search_finds_edited_notices_beside_better_copies():
    spans = lambda text: [(m[1], m[2], m[3]) for m in licenses.fuzzy_matches(text) if m[0] == 0]
    assert spans("releasd under the mit license x released under the mit license") == [(0, 29, 1), (32, 62, 0)]
    exact, one, two = "released under the mit license", "releasd under the mit license", "releasd under the mit licnse"
    for order in itertools.permutations([exact, one, two, one]):
        text, want = "", []
        for copy in order:
            text += "x "
            want.append((len(text), len(text) + len(copy), 30 - len(copy)))
            text += copy + " "
        assert spans(text) == want


def test_wrappers_extract_articles(spark, empty):
    body = "<html><body><nav><ul><li>Home</li><li>News</li></ul></nav><div class='cookie notice'>We use cookies {0}</div><div id=main><h1>Title &amp; {0}</h1><p>First <b>bold</b>\n  text {0}.</p>{1}<p>Last {0}</p><aside>Related {0}</aside></div><div class=comments><p>reader {0}</p></div><footer>&copy; {0}</footer></body></html>"
    pages = [(i, f"http://h.example/{i}", body.format(f"number {i}", "<ul><li>x</li><li>y</li></ul>" if i % 2 else "")) for i in range(6)]
    pages += [(50, "http://one.example/", pages[0][2]), (51, None, None), (52, "x", ""), (53, "http://h.example/", "plain & text")]
    found = {r[0]: r for r in rows(wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert found[1][2] == "Title & number 1\nFirst bold text number 1.\nx\ny\nLast number 1"
    assert found[50][2] == "Title & number 0\nFirst bold text number 0.\nLast number 0"
    assert found[51][2:] == ("", 0) and found[52][2:] == ("", 0) and found[53][2] == "plain & text"
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_wrappers_keep_all_changing_text_and_see_every_page(spark):
    shared = "<html><body><div class=top>Always here</div><div id=page-{0}><h1>Title {0}</h1><p>intro {0}</p><div class=body><p>" + "much text {0} " * 60 + "</p></div></div></body></html>"
    rare = "<html><body><section class=box>Always here</section><section class=text><h2>Rare {0}</h2><p>words {0}</p></section></body></html>"
    long = "<html><body><div class=top>Always here</div><main><p>" + "long page {0}. " * 40_000 + "</p></main></body></html>"
    pages = [(i, f"http://two.example/{i}", shared.format(i)) for i in range(60)] + [(100 + i, f"http://two.example/{i}", rare.format(i)) for i in range(2)]
    pages += [(200 + i, f"http://long.example/{i}", long.format(i)) for i in range(2)]
    found = {r[0]: r[2] for r in rows(wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    for i in range(60):
        assert found[i] == f"Title {i}\nintro {i}\n" + " ".join([f"much text {i}"] * 60)
    assert [found[100 + i] for i in range(2)] == [f"Rare {i}\nwords {i}" for i in range(2)]
    assert [found[200 + i] for i in range(2)] == [" ".join([f"long page {i}."] * 40_000) for i in range(2)]
    outside = [f"<body><div>by {i}</div><div class=body><p>text {i}</p></div></body>" for i in range(3)]
    assert wrappers.main_element(wrappers.infer(outside)) == "body."
    assert wrappers.main_element(wrappers.infer([x.replace("<body>", "").replace("</body>", "") for x in outside])) == ""
    assert wrappers.main_element(wrappers.infer(outside[:1])) is None


def test_wrappers_on_given_pages(spark):
    def article(page):
        blocks = re.split("</?(?:p|h1)>", re.search("(?s)<article>(.*?)</article>", page)[1])
        clean = (" ".join(__import__("html").unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in blocks)
        return "\n".join(b for b in clean if b)

    given = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    assert {r["page_id"]: r["text"] for r in wrappers.extract(table(spark, SF, "pages")).collect()} == {i: article(h) for i, h in given.items()}


def test_jaccard_small_buckets_need_no_rare_elements(spark, monkeypatch):
    docs = []
    for g in range(8):  # alike by a passage, not enough to be linked
        passage = [f"p{g}_{k}" for k in range(80)]
        docs += [(10 * g + k, " ".join([*passage, *(f"o{g}_{k}_{j}" for j in range(25))])) for k in range(4)]
    copy = docs[5][1].split()
    copy[3] = "changed"
    docs.append((900, " ".join(copy)))
    taken, rare, kept = [], jaccard_join._rare_meetings, jaccard_join._small_bucket_pairs

    def seen(rows, sets, p, q):
        taken.append(rows.count())
        return rare(rows, sets, p, q)

    monkeypatch.setattr(jaccard_join, "_rare_meetings", seen)
    given = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r[0]: r[1] for r in rows(jaccard_join.similar_components(given, shingle=5, percent=80).select("doc_id", "component_id"))}
    assert found == {i: c for i, (_, c) in components(docs, 5, 80).items()} and found[900] == docs[5][0]
    assert taken == [0]
    # Of a bucket up to the limit every pair of components whose sizes allow it; of a larger one none.
    near = [("k", i, 100 + i, i, 3) for i in range(3)] + [("same", i, 100, 7, 2) for i in (1, 2)] + [("wide", 5, 100, 5, 2), ("wide", 6, 200, 6, 2)] + [("large", i, 100, i, jaccard_join.SMALL + 1) for i in range(20, 21 + jaccard_join.SMALL)]
    pairs = kept(spark.createDataFrame(near, "key string, id long, n long, component long, held long"), 4, 5)
    assert sorted(rows(pairs)) == [(0, 1), (0, 2), (1, 2)]


def test_jaccard_moves_elements_only_of_pairs_that_can_be_similar(spark):
    sets = jaccard_join.map_batches(
        spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i x"), (3, "q r s t u v w x y z"), (4, "a b")], "id long, text string"),
        jaccard_join.set_elements(1), "id long, n long, elements array<long>, " + ", ".join(f"{c} long" for c in jaccard_join.PARITY),
    )
    found = jaccard_join._verified(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long"), sets, 4, 5)
    assert sorted(rows(found)) == [(1, 2, True), (1, 3, False), (1, 4, False)]
    table = next(f for f in found.inputFiles() if "near-pairs" in f).rsplit("/", 1)[0]
    assert sorted(rows(spark.read.parquet(table.replace("file://", "")))) == [(1, 2, True), (1, 3, False), (1, 4, False)]


def chat_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(r, t)[0]) for r, t in turns)


def test_chat_round_trip_and_shared_nodes(spark):
    given = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<b>"), (2, 0, "user", "hi"), (2, 1, "assistant", PROBE), (2, 2, "user", None), (3, 0, "tool>x", "[1]"), (3, None, None, "q"), (4, 0, "user", "hi"), (4, 0, "user", "hi")]
    nodes, paths = chat.build_tree(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"))
    found = {r[0]: r[1:] for r in rows(chat.read_back(nodes, paths))}
    want = {}
    for conv in {g[0] for g in given}:
        turns = sorted((g for g in given if g[0] == conv), key=lambda g: (g[1] is not None, g[1] or 0, g[2] or "", g[3] or ""))
        want[conv] = chat_digest([(r or "", t or "") for _, _, r, t in turns])
    assert found == want
    held = {bytes(r["node"]): r for r in nodes.collect()}
    assert len(held) == 7  # "hi" is written once
    assert sorted(r["place"] for r in held.values()) == list(itertools.accumulate([0] + [r["n_tokens"] for r in sorted(held.values(), key=lambda r: r["place"])]))[:-1]
    for r in chat.attention(nodes, paths).collect():
        own = held[bytes(r["node"])]
        assert r["intervals"][-1]["from"] == own["place"] and sum(i["to"] - i["from"] for i in r["intervals"]) == own["position"] + own["n_tokens"]
        assert all(a["to"] <= b["from"] for a, b in zip(r["intervals"], r["intervals"][1:]))  # depth-first: ancestors come before
    assert rows(chat.read_back(*chat.build_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))) == []


def test_chat_keeps_rows_without_an_id_and_places_every_turn(spark):
    given = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (None, 1, "assistant", "no"), (None, 0, "user", "hi"), (None, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes")]
    nodes, paths = chat.build_tree(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: r for r in chat.read_turns(nodes, paths).collect()}
    assert {i: r["n_turns"] for i, r in found.items()} == {1: 2, 2: 2, None: 3}
    turns = [("user", "hi"), ("assistant", "no"), ("user", "more")]
    assert tuple(found[None])[1:6] == chat_digest(turns)
    assert nodes.where("place IS NOT NULL").count() == 4
    lengths = [len(chat.format_turn(r, t)[0]) for r, t in turns]
    assert found[None]["positions"] == [0, lengths[0], lengths[0] + lengths[1]]
    last = {r["conv_id"]: r["intervals"] for r in chat.attention(nodes, paths).orderBy("step").collect()}
    assert {i: r["spans"] for i, r in found.items()} == last and last[1] == last[2] and last[1][0] == last[None][0]


def test_chat_places_of_long_conversations_are_depth_first(spark):
    rng = np.random.default_rng(4)
    given = [(c, t, "user" if t % 2 else "assistant", f"t{t}" if t < c % 7 * 30 else f"{c % 23} {rng.integers(0, 2)}") for c in range(40) for t in range(3 + c * 5)]
    nodes, paths = chat.build_tree(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"))
    held = {bytes(r["node"]): r for r in nodes.collect()}
    assert "key" not in nodes.columns  # no row of a node grows with the turns above it
    under = {name: r["n_tokens"] for name, r in held.items()}
    for name in sorted(held, key=lambda n: -held[n]["depth"]):
        if held[name]["depth"]:
            under[bytes(held[name]["parent"])] += under[name]
    order = sorted(held.values(), key=lambda r: r["place"])
    assert [r["place"] for r in order] == [0, *itertools.accumulate(r["n_tokens"] for r in order)][:-1]
    for name, r in held.items():  # all below a node lies right behind it, within what they hold together
        if r["depth"]:
            up = held[bytes(r["parent"])]
            assert up["place"] + up["n_tokens"] <= r["place"] and r["place"] + under[name] <= up["place"] + under[bytes(r["parent"])]


def plain_windows(text, item, n=5):
    w, v = ([x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x] for t in (text, item))
    if len(v) < n:
        return 0.0
    grams = lambda a: [tuple(a[i : i + n]) for i in range(len(a) - n + 1)]
    target, best = grams(v), 0.0
    from collections import Counter

    t = Counter(target)
    for s in range(len(w) - len(v) + 1):
        c = Counter(grams(w[s : s + len(v)]))
        both = sum((c & t).values())
        best = max(best, both / (2 * len(target) - both))
    return best


def test_decontamination_against_all_windows(spark, empty):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(15, 50))))) for k in range(12)] + [(90, "too short"), (91, None)]
    docs = []
    for k in range(60):
        noise = list(rng.choice(vocabulary, 80))
        if k % 2:
            part = items[k % 12][1].split()
            for _ in range(k % 3):
                part[int(rng.integers(0, len(part)))] = "changed"
            noise[40:40] = part
        docs.append((k, " ".join(noise)))
    docs += [(700, None), (701, ""), (702, "w1"), (703, docs[1][1]), (703, docs[1][1])]
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, j): s for i, t in docs for j, u in items if (s := plain_windows(t, u)) >= 0.8}
    assert set(found) <= set(want) and all(abs(found[p] - want[p]) < 1e-9 for p in found)
    assert {p for p, s in want.items() if s == 1.0} <= set(found) and len(found) >= 0.95 * len(want)
    assert decontaminate.contaminations(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_decontamination_of_shortened_items(spark):
    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 10_000, 30 + k))) for k in range(8)]
    docs = []
    for k, text in items:
        w = text.split()
        docs += [(10 * k, " ".join(w[:-1])), (10 * k + 1, " ".join(w[2:])), (10 * k + 2, " ".join(w[: len(w) // 2])), (10 * k + 3, " ".join(["more", *w[:-2]]))]
    docs += [(900, items[0][1]), (900, " ".join(items[0][1].split()[:-1]))]  # one id, two texts
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def clipped(text, item):  # the window is no longer than the document
        w, v = text.split(), item.split()
        size = min(len(w), len(v))
        grams = lambda a: {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
        return max(len(grams(w[s : s + size]) & grams(v)) / len(grams(w[s : s + size]) | grams(v)) for s in range(len(w) - size + 1))

    want = {}
    for i, t in docs:
        for j, u in items:
            if (x := clipped(t, u)) >= 0.8:
                want[i, j] = max(x, want.get((i, j), 0))
    assert {k: r["similarity"] for k, r in found.items()} == pytest.approx(want) and len(want) == 25
    assert all(found[10 * k, k]["n_words"] == 29 + k and found[10 * k, k]["start_word"] == 0 for k in range(8))
    left = decontaminate.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {10 * k + 2 for k in range(8)}


def test_decontamination_moves_places_not_arrays(spark, monkeypatch):
    rng = np.random.default_rng(10)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 10_000, 30))) for k in range(8)]
    filler = [" ".join(f"u{x}" for x in rng.integers(0, 10_000, 400)) for _ in range(24)]
    docs = [(k, f"{t} {items[k // 3][1]} {t}" if k % 3 == 0 else t) for k, t in enumerate(filler)]
    held, store = {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: held.setdefault(label, (df, store(df, label)))[1])
    found = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(3 * k, k) for k in range(8)]
    # Hash arrays are kept of the benchmark and of single windows alone, never of a whole document.
    assert {label for label, (df, _) in held.items() if any(t.startswith("array") for _, t in df.dtypes)} <= {"benchmark-items", "windows"}
    assert held["windows"][1].agg(F.max(F.size("h"))).first()[0] == 26
    # No plan holds the slots themselves.
    assert "X'" not in found._jdf.queryExecution().toString() and all("X'" not in df._jdf.queryExecution().toString() for df, _ in held.values())


def test_slot_table_keeps_all_and_is_bounded(spark, monkeypatch):
    rows = spark.range(4000).select("id", F.xxhash64("id").alias("x"))
    table, size = decontaminate.slot_table(rows.where("id < 300"), "x", "slots")
    kept = {r["id"] for r in decontaminate.in_slots(rows, "x", table, size).collect()}
    assert set(range(300)) <= kept and len(kept) < 400
    monkeypatch.setattr(decontaminate, "MOST_SLOTS", 1 << 16)
    table, size = decontaminate.slot_table(rows, "x", "slots")
    assert size == 1 << 16 and table.count() <= 1 << 10 and decontaminate.in_slots(rows, "x", table, size).count() == 4000


def test_word_hashes_follow_words():
    hashes, bounds = words.word_hashes(pa.array(["Ab c\tab", "", None, "ab"]))
    assert bounds.tolist() == [0, 3, 3, 3, 4] and hashes[0] == hashes[2] == hashes[3] != hashes[1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "jaccard dedup", "decontamination", "packing"]
    docs = table(spark, SF, "documents")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(before)
            break
        assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.collect()}
        if name == "exact dedup":
            norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t)
            assert kept == {min(i for i, t in before.items() if norm(t) == x) for x in {norm(t) for t in before.values()}}
        elif name == "jaccard dedup":
            assert kept == {c for _, c in components(list(before.items()), 5, 80).values()}
        elif name == "decontamination":
            items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
            assert not kept & {i for i, t in before.items() if any(" ".join(x.split()) in " ".join(t.split()) for x in items)}
        docs = out
    assert given


def test_pipeline_stages_judge_rows_without_id(spark):
    import corpus_pipeline

    def kept(stage, given):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, spark.createDataFrame(given, "doc_id long, text string, _id long"), SF).select("doc_id", "text").collect()), key=repr)

    def plain(given):
        return sorted(((i, t) for i, t, _ in given), key=repr)

    name = [(2, "a b", 1), (None, "c d", 1), (None, "e", 1)]
    copies = kept(corpus_pipeline.exact_dedup, [*name, (None, "a  b", 1), (None, "c d", 1), (None, "c d", 2)])
    assert copies == plain(name)
    for fingerprint in (F.xxhash64, lambda c: F.length(c).cast("long")):
        df = spark.createDataFrame([*name, (None, "a  b", 1), (None, "x y", 1), (None, None, 1)], "doc_id long, text string, _id long")
        assert sorted((r["text_sha256"][:3], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df, fingerprint=fingerprint).collect()) == sorted(
            (hashlib.sha256(t.encode()).hexdigest()[:3], n, k) for t, n, k in [("a b", 2, True), ("a b", 2, False), ("c d", 1, True), ("e", 1, True), ("x y", 1, True), ("", 1, True)]
        )
    long = lambda k, end: " ".join(f"{k}{x}" for x in range(80)) + end
    near = [(7, long("p", ""), 1), (None, long("p", " end"), 1), (None, long("q", ""), 1), (None, long("q", " end"), 1), (None, None, 1)]
    found = kept(corpus_pipeline.jaccard_dedup, near)
    assert (7, near[0][1]) in found and (None, near[1][1]) not in found and (None, None) in found and len(found) == 3
    item = table(spark, SF, "benchmark").first()["text"]
    assert kept(corpus_pipeline.decontamination, [(1, long("p", ""), 1), (None, f"so {item} so", 1), (None, long("r", ""), 1)]) == plain([(1, long("p", ""), 1), (None, long("r", ""), 1)])
    known = [(r["doc_id"], r["text"], 1) for r in table(spark, SF, "documents").collect()]
    texts = kept(corpus_pipeline.toxicity, known + [(None, t, 1) for _, t, _ in known])
    assert sorted(t for i, t in texts if i is None) == sorted(t for i, t in texts if i is not None) and len(texts) < 2 * len(known)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    from compare import compare, duck

    text, good = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert good, text
