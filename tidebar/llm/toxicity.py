"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's score is the logistic of a sum over
the informative words and word beginnings it holds, a document's the noisy-or of its sentences: 1 - prod(1 - p). The
weights maximise the likelihood of the document labels under that noisy-or, so they are learned through
the sentences, and the trained sentence scores then say which sentences offend.

A sentence's hazard, -log(1 - p), counts by what it has above the level that only one in a thousand sentences of clean documents
exceeds, so ordinary sentences add nothing however many a document has, and no sentence lowers a score.

The fit uses at most SAMPLE_ROWS labelled documents, the first by a hash of their id; of a clean one of more than
SAMPLE_BYTES bytes a run of sentences from a place chosen by that hash, each standing for as many as the document has of
them. A run of a long toxic document may lack the sentence that offends, so those are not learned from. Scoring
reads every whole text. Null and empty texts have one empty sentence and get its low score. Labels that are null or
contradict each other (both values for one id) are not learned from; without a positive and a negative label the weights
are zero. Repeated rows are scored each by itself; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import map_batches, slices, text_bytes
from tidebar.llm.words import LOWER, hashed, word_ranges

SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16_384
VOCABULARY_SIZE, LEAST_DOCUMENTS, LEAST_Z = 3_000, 4, 4.0
PREFIXES = (4, 5, 6)
FIT_ROWS, CLASSES = 100, 4
STEPS, RATE, RIDGE = 1_200, 0.5, 1e-7
FLAG, BIAS = 0.5, -7.0
#: Share of sentences of clean documents whose hazard may lie above the level that is deducted, and the highest such level.
ABOVE, MOST_DEDUCTED = 1e-3, 0.05

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True  # line end ! . ?


@dataclass
class Model:
    words: np.ndarray  # ascending word hashes
    weights: np.ndarray
    bias: float
    deducted: float  # from the hazard of each sentence


def sentences(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all sentences of all texts and the first sentence of each text; every text has one at least."""
    data, offsets = text_bytes(text)
    ends = np.flatnonzero(STOP[data]) + 1
    starts = np.concatenate([offsets[:-1], ends])
    owner = np.concatenate([np.arange(len(text)), np.searchsorted(offsets, ends - 1, "right") - 1])
    inner = np.concatenate([np.ones(len(text), bool), ends < offsets[1:][owner[len(text) :]]])
    order = np.lexsort((starts[inner], owner[inner]))
    starts, owner = starts[inner][order], owner[inner][order]
    finish = np.append(starts[1:], offsets[-1])
    return starts, finish, np.searchsorted(owner, np.arange(len(text) + 1))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every feature of every text as its byte position and hash: lower-cased words, and the beginnings of longer ones."""
    data, _, begin, end = word_ranges(text, WORD)
    data, at, out = LOWER[data], [begin], [hashed(data, begin, end)]
    for size in PREFIXES:
        long = begin[end - begin > size]
        at.append(long)
        out.append(hashed(data, long, long + size) ^ np.uint64(size))
    return np.concatenate(at), np.concatenate(out)


def known_in_sentences(text: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence ranges, first sentences, and distinct pairs of a sentence and the place of one of its features in vocabulary."""
    starts, finish, first = sentences(text)
    if not len(vocabulary):
        return starts, finish, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, hashes = features(text)
    place = np.searchsorted(vocabulary, hashes)
    place[place == len(vocabulary)] = 0
    known = vocabulary[place] == hashes
    pair = np.unique((np.searchsorted(starts, at[known], "right") - 1) * len(vocabulary) + place[known])
    return starts, finish, first, pair // len(vocabulary), pair % len(vocabulary)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _informative(text: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Features whose document frequency differs most between the labels, by the z score of a proportion."""
    # Features are counted in classes of their hash, one after the other, which bounds the memory of the driver.
    words, in_all, in_toxic = [], [], []
    for kind in range(CLASSES):
        held = []
        for row in range(0, len(text), FIT_ROWS):
            part = text.slice(row, FIT_ROWS)
            at, hashes = features(part)
            some = hashes % np.uint64(CLASSES) == kind
            owner = np.searchsorted(text_bytes(part)[1], at[some], "right") - 1
            order = np.lexsort((owner, hashes[some]))
            hashes, owner = hashes[some][order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            held.append((hashes[new], toxic[row + owner[new]]))
        found, number = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        count = np.bincount(number)
        keep = count >= LEAST_DOCUMENTS
        words.append(found[keep])
        in_all.append(count[keep])
        in_toxic.append(np.bincount(number, np.concatenate([h[1] for h in held]))[keep])
    words, in_all, in_toxic = np.concatenate(words), np.concatenate(in_all), np.concatenate(in_toxic)
    share = toxic.mean()
    z = np.abs(in_toxic - share * in_all) / np.sqrt(share * (1 - share) * in_all)
    chosen = np.flatnonzero((in_all >= LEAST_DOCUMENTS) & (z >= LEAST_Z))
    return np.sort(words[chosen[np.argsort(-z[chosen], kind="stable")[:VOCABULARY_SIZE]]])


def fit(text: pa.Array, toxic: np.ndarray, n_sentences: np.ndarray | None = None) -> Model:
    """Weights that maximise the noisy-or likelihood of the document labels, by AdaGrad over all documents.

    n_sentences: how many sentences the documents have that the texts are runs of (0: the text is whole).
    """
    toxic = np.asarray(toxic, float)
    if not len(toxic) or not 0 < toxic.mean() < 1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), BIAS, float(np.logaddexp(0, BIAS)))
    vocabulary = _informative(text, toxic)
    firsts, ats, places, before = [], [], [], 0
    for row in range(0, len(text), FIT_ROWS):
        _, _, first, at, place = known_in_sentences(text.slice(row, FIT_ROWS), vocabulary)
        firsts.append(first[:-1] + before)
        ats.append(at + before)
        places.append(place)
        before += int(first[-1])
    first, at, place = np.concatenate([*firsts, [before]]), np.concatenate(ats), np.concatenate(places)
    document = np.repeat(np.arange(len(text)), np.diff(first))
    weights, bias = np.zeros(len(vocabulary)), BIAS
    slope, slope_bias = np.full(len(vocabulary), 1e-8), 1e-8
    # Only sentences with a known feature differ from each other; the rest of a document counts as that many times the bare sentence.
    some, at = np.unique(at, return_inverse=True)
    document, bare = document[some], np.diff(first) - np.bincount(document[some], minlength=len(text))
    times = np.maximum(1.0, (0 if n_sentences is None else n_sentences) / np.diff(first))
    bare = bare * times
    for _ in range(STEPS):
        score = np.bincount(at, weights[place], minlength=len(document)) + bias
        p, p_bare = _logistic(score), float(_logistic(np.array(bias)))
        clean = np.exp(-np.bincount(document, np.logaddexp(0, score) * times[document], minlength=len(text)) - bare * np.logaddexp(0, bias))
        pull = np.where(toxic > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)
        each = pull[document] * p * times[document]
        gradient = np.bincount(place, each[at], minlength=len(vocabulary)) - RIDGE * len(text) * weights
        slope += gradient**2
        weights = weights + RATE * gradient / np.sqrt(slope)
        down = each.sum() + float((pull * bare).sum()) * p_bare
        slope_bias += down**2
        bias = min(BIAS, bias + RATE * down / np.sqrt(slope_bias))
    score = np.bincount(at, weights[place], minlength=len(document)) + bias
    return Model(vocabulary, weights, bias, _deducted(np.logaddexp(0, score), times[document] * (toxic[document] < 1), float(bare[toxic < 1].sum()), float(np.logaddexp(0, bias))))


def _deducted(hazards: np.ndarray, times: np.ndarray, bare: float, bare_hazard: float) -> float:
    """The hazard that a share ABOVE of the sentences of clean documents exceeds: hazards times over, and bare sentences."""
    order = np.argsort(-hazards, kind="stable")
    above = np.cumsum(times[order])
    rank = int(np.searchsorted(above, ABOVE * (times.sum() + bare), "right"))
    level = hazards[order[rank]] if rank < len(order) else bare_hazard
    return float(max(bare_hazard, min(level, MOST_DEDUCTED)))


def score_batch(model: Model, text: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Noisy-or score of every text, and its offending sentences as character ranges with their score, in text order."""
    starts, finish, first, at, place = known_in_sentences(text, model.words)
    score = np.bincount(at, model.weights[place], minlength=len(starts)) + model.bias
    total = np.add.reduceat(np.maximum(0, np.logaddexp(0, score) - model.deducted), first[:-1]) if len(text) else np.zeros(0)
    data, offsets = text_bytes(text)
    p = _logistic(score)
    spans: list[list[dict]] = [[] for _ in range(len(text))]
    flagged = np.flatnonzero(p >= FLAG)
    if len(flagged):
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        owner = np.searchsorted(first, flagged, "right") - 1
        base = characters[offsets[owner]]
        for row, a, b, x in zip(owner.tolist(), (characters[starts[flagged]] - base).tolist(), (characters[finish[flagged]] - base).tolist(), p[flagged].tolist()):
            spans[row].append({"start": a, "end": b, "score": x})
    return -np.expm1(-total), spans


def _marks(labels: DataFrame, label: str, learn: Column, id_column: str, rows: int) -> DataFrame:
    """_id and label of at most rows ids, the first by their hash."""
    marks = labels.where(learn & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return marks.where("label = _most").orderBy(F.xxhash64(id_column), id_column).limit(rows).select(F.col(id_column).alias("_id"), "label")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most rows labelled documents, for a fit on the driver: at most rows * most_bytes bytes.

    learn says, on the id column, which labels may be looked at.
    """
    marks = _marks(labels, label, learn, id_column, rows)
    texts = documents.where(learn & (F.octet_length(F.col(text_column)) <= most_bytes)).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    found = texts.join(F.broadcast(marks), "_id").select(F.col("_text").cast("string").alias("text"), F.col("label").cast("int").alias("label"), "_id").orderBy("_id", "text").limit(2 * rows).toArrow()
    text = found.column("text").combine_chunks()
    return (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text), found.column("label").to_numpy()


def labelled_bags(documents: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, 0/1 labels and numbers of sentences for fit: whole texts (0 sentences) and runs of sentences of long clean ones."""
    marks = _marks(labels, "toxic", learn, id_column, SAMPLE_ROWS)
    text, run = F.col("_text"), SAMPLE_BYTES // 4
    texts = documents.where(learn).select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text")).where("_text IS NOT NULL")
    found = texts.join(F.broadcast(marks), "_id").withColumn("_long", F.octet_length(text) > SAMPLE_BYTES).where("NOT _long OR label = 0")
    start = F.pmod(F.xxhash64("_id"), F.length(text) - (run - 1)).cast("int") + 1
    stops = F.length(text) - F.length(F.translate(text, "\n.!?", "")) + F.when(text.rlike(r"[\n.!?]\z"), 0).otherwise(1)
    found = found.select(
        F.when(F.col("_long"), text.substr(start, F.lit(run))).otherwise(text).alias("text"), F.col("label").cast("int").alias("label"), F.when(F.col("_long"), stops).otherwise(0).cast("long").alias("n_sentences"), "_id"
    )
    found = found.orderBy("_id", "text").limit(2 * SAMPLE_ROWS).toArrow()
    texts = found.column("text").combine_chunks()
    return (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts), found.column("label").to_numpy(), found.column("n_sentences").to_numpy()


def toxicity(documents: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, spans (offending sentences) of every row of documents."""
    model = fit(*labelled_bags(documents, labels, learn, id_column, text_column))
    return scored(model, documents, id_column, text_column)


SPANS = "array<struct<start: long, end: long, score: double>>"


def scored(model: Model, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, 1):
                score, spans = score_batch(model, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id long, score double, spans {SPANS}")
