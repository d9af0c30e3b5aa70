"""Alignment of two tokenizers over the same texts, with how often each linked id pair is seen in the corpus.

A is a byte-level BPE over space + text, B a sentencepiece BPE over the text (which puts the space there itself). Both
cut the same bytes. A text whose joined token bytes differ from space + text on either side has no tokens here.
In a batch, pandas.merge_asof keyed by document finds for each token start the other side's token that covers
it; two tokens overlap where one of them covers the other's start, so the union of both directions is all
overlaps. Offsets where both sides end cut the tokens into groups.

Links become counts in two steps: a document's distinct id pairs with their number of uses are written once; document
counts of pairs are grouped from them, and each A id's highest count is joined on. A document's sums need its
pairs' counts: where the counted pairs are at most BROADCAST_PAIRS they are broadcast, else both sides are shuffled by pair.

Null and empty texts have no tokens and zeros. Control strings inside texts are plain text. Rows are independent: repeated rows are
documents of their own, each counted. A row without an id keeps a null doc_id. An empty table gives an empty result.
Other columns than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import keeping, kept_by_worker, map_batches, slices, stored, text_bytes

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Counted pairs that may be broadcast (three longs each); more are joined by shuffling both sides.
BROADCAST_PAIRS = 1_000_000
#: Bytes of text that are aligned in one go.
RUN_BYTES = 1 << 20
#: B ids are below this; a pair is A id * PAIR + B id.
PAIR = 1 << 20

NOTHING = np.zeros(0, np.int64)
FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, uses array<int>"


def _resolved(path: str) -> str:
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """The byte-level vocabulary of a tokenizers file, with tiktoken as the machine that merges.

    tiktoken merges by the id of the merged token; that is the file's order of merges only if each merge makes a new id above
    all before it, which is checked here.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(_resolved(path), encoding="utf-8") as file:
            model = json.load(file)
        letter = byte_letters()
        special = {t["id"] for t in model["added_tokens"]}
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if model.get("normalizer") or any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: its merges are not in the order of its ids")
        ranks = {bytes(letter[c] for c in token): i for token, i in vocabulary.items() if i not in special}
        self.bytes = np.empty(max(vocabulary.values()) + 1, object)
        self.bytes[:] = b""
        for token, i in ranks.items():
            self.bytes[i] = token
        self.machine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.machine.encode_ordinary(" " + text), np.int32) for text in texts]


class PieceTokens:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.machine = SentencePieceProcessor(model_file=_resolved(path))
        self.bytes = np.empty(self.machine.get_piece_size(), object)
        for i in range(len(self.bytes)):
            piece = self.machine.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.machine.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.machine.encode(texts, num_threads=1)]


class Side:
    """The tokens of a run of documents: ids, document numbers, and where they start and end in all documents' bytes."""

    def __init__(self, ids: list[np.ndarray], lengths: np.ndarray, bases: np.ndarray):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate(ids).astype(np.int64)
        self.documents = np.repeat(np.arange(len(ids)), self.counts)
        sizes = lengths[self.ids]
        ends = np.cumsum(sizes)
        first = np.concatenate([[0], ends])[np.cumsum(self.counts) - self.counts]
        self.ends = ends + np.repeat(bases - first, self.counts)
        self.starts = self.ends - sizes


def covering(left: Side, right: Side) -> np.ndarray:
    """For each token of left, the token of right that covers its start."""
    found = pd.merge_asof(
        pd.DataFrame({"start": left.starts, "document": left.documents}),
        pd.DataFrame({"start": right.starts, "document": right.documents, "other": np.arange(len(right.ids))}),
        on="start",
        by="document",
    )
    return found["other"].to_numpy(np.int64)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of a, token of b) whose bytes overlap, each once."""
    of_a, of_b = covering(a, b), covering(b, a)
    pairs = np.concatenate([np.arange(len(a.ids)) * (len(b.ids) + 1) + of_a, of_b * (len(b.ids) + 1) + np.arange(len(b.ids))])
    pairs.sort(kind="stable")
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs // (len(b.ids) + 1), pairs % (len(b.ids) + 1)


def _names(size: int, *behind: str) -> list[np.ndarray]:
    out = []
    for mark in behind:
        names = np.empty(size, object)
        names[:] = [f"{i}{mark}" for i in range(size)]
        out.append(names)
    return out


class Aligner:
    """Both vocabularies, kept by a worker."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.a_inside, self.a_last = _names(len(self.a.bytes), ",", "|")
        self.b_inside, self.b_last = _names(len(self.b.bytes), ",", ";")

    def encoded(self, text: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both sides and the lengths of space + text; nothing for texts that a side does not give back."""
        data, offsets = text_bytes(text)
        raw = data.tobytes()
        texts = [raw[x:y].decode() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        a, b = self.a.encode(texts), self.b.encode(texts)
        for k, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            whole = b" " + raw[x:y]
            if x == y or b"".join(self.a.bytes[a[k]]) != whole or b"".join(self.b.bytes[b[k]]) != whole:
                a[k] = b[k] = NOTHING
        return a, b, np.diff(offsets) + 1

    def align(self, ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
        a_ids, b_ids, lengths = self.encoded(text)
        bases = np.cumsum(lengths) - lengths
        a, b = Side(a_ids, self.a_lengths, bases), Side(b_ids, self.b_lengths, bases)
        a_ends, b_ends = np.isin(a.ends, b.ends, assume_unique=True), np.isin(b.ends, a.ends, assume_unique=True)
        groups = np.bincount(a.documents[a_ends], minlength=len(ids))
        of_a, of_b = overlaps(a, b)
        links = np.bincount(a.documents[of_a], minlength=len(ids))
        pairs, uses, bounds = self._distinct(a, b, of_a, of_b, len(ids))
        columns = [ids, *(pa.array(x.astype(np.int64)) for x in (a.counts, b.counts, groups, links)), pa.array(self._digests(a, b, a_ends, b_ends))]
        columns += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (pairs, uses)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FIELDS.split(", ")])

    @staticmethod
    def _distinct(a: Side, b: Side, of_a: np.ndarray, of_b: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct id pairs of each document, ascending, how often each is linked, and where each document's begin."""
        place = a.documents[of_a]
        pairs = a.ids[of_a] * PAIR + b.ids[of_b]
        order = np.lexsort((pairs, place))
        pairs, place = pairs[order], place[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(new)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place[at], minlength=documents))])
        return pairs[at], np.diff(np.append(at, len(pairs))).astype(np.int32), bounds

    def _digests(self, a: Side, b: Side, a_ends: np.ndarray, b_ends: np.ndarray) -> list[str]:
        """SHA-256 of the groups of each document written out; empty without tokens."""
        # Of tokens behind one another a group's A tokens come first; a token's place follows from the groups ended before it.
        before_a, before_b = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        a_total, b_total = np.concatenate([[0], np.flatnonzero(a_ends) + 1]), np.concatenate([[0], np.flatnonzero(b_ends) + 1])
        words = np.empty(len(a.ids) + len(b.ids), object)
        words[np.arange(len(a.ids)) + b_total[before_a]] = np.where(a_ends, self.a_last[a.ids], self.a_inside[a.ids])
        words[np.arange(len(b.ids)) + a_total[before_b + 1]] = np.where(b_ends, self.b_last[b.ids], self.b_inside[b.ids])
        out, at, words = [], 0, words.tolist()
        for count in (a.counts + b.counts).tolist():
            out.append(hashlib.sha256("".join(words[at : at + count])[:-1].encode()).hexdigest() if count else "")
            at += count
        return out


def aligner(a: str, b: str) -> Aligner:
    return kept_by_worker(("aligner", a, b), lambda: Aligner(a, b))


def aligned_rows(a: str, b: str):
    """Batches of (id, text) to rows of FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        work = aligner(a, b)
        for batch in batches:
            for part in slices(batch, 1, RUN_BYTES):
                yield work.align(part.column(0), part.column(1))

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents (rows that hold it), best (it has its A id's highest count)."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "pair-counts")
    a_id = F.expr(f"pair div {PAIR}").alias("a_id")
    highest = counts.groupBy(a_id).agg(F.max("documents").alias("highest"))
    return counts.select("*", a_id).join(highest, "a_id").select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def align(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = stored(map_batches(texts, keeping(aligned_rows(a, b), "aligner"), FIELDS).select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    counts = stored(pair_counts(rows), "pair-best")
    few = counts.count() <= broadcast_pairs
    used = rows.select("row", F.explode(F.arrays_zip("pairs", "uses")).alias("u")).select("row", F.col("u.pairs").alias("pair"), F.col("u.uses").alias("uses"))
    used = used.join(F.broadcast(counts) if few else counts.hint("shuffle_hash"), "pair")
    sums = used.groupBy("row").agg(F.sum(F.expr("uses * documents")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"))
    whole = rows.drop("pairs", "uses").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
