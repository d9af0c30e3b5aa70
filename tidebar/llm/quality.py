"""Document quality by a linear-chain conditional random field over lines.

A document is a chain of lines, each good or bad. A line's features are its own measures, those of the lines before and
behind it, and its likeness to them; neighbouring labels have a transition weight. Forward-backward gives every line's
marginal probability of being good, and a document's score is their mean weighted by line length.
The field is fitted to lines that carry their document's label, by the gradient of the conditional likelihood.

The fit uses at most SAMPLE_ROWS labelled documents of at most SAMPLE_BYTES bytes, the first by a hash of their id;
scoring reads every whole text. Null and empty texts are one empty line. Labels that are null or contradict each other are not learned
from; with only one kind of label the score is that label's side of one half everywhere. Repeated rows are
scored each by itself; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidebar.llm.common import map_batches, slices, text_bytes
from tidebar.llm.toxicity import FIT_ROWS, labelled_sample
from tidebar.llm.words import NOT_SPACE, hashed, word_ranges
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16_384
STEPS, RATE, RIDGE = 150, 0.2, 1e-3


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


UPPER, LOWER_CASE, DIGIT = _bytes((65, 90)), _bytes((97, 122)), _bytes((48, 57))
MARK = _bytes((33, 47), (58, 64), (91, 96), (123, 126))
PLAIN_MARK = _bytes((44, 44), (46, 46), (39, 39), (45, 45))
STOP, BAR, LATIN = _bytes((33, 33), (46, 46), (63, 63)), _bytes((124, 124)), _bytes((128, 255))


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the measures for the label good against bad
    transition: np.ndarray  # 2 x 2


def lines_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all lines (the line end belongs to no line) and the first line of each text; every text has one at least."""
    data, offsets = text_bytes(text)
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end_owner = np.concatenate([np.arange(len(text)), owner])
    order = np.lexsort((np.concatenate([np.zeros(len(text), np.int64), np.arange(1, len(breaks) + 1)]), end_owner))
    start, end_owner = start[order], end_owner[order]
    first = np.searchsorted(end_owner, np.arange(len(text) + 1))
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    last = first[1:] - 1
    end[last] = offsets[1:]
    return start, end, first


def _own(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each line by itself, its length in bytes, and the first line of each text."""
    data, offsets = text_bytes(text)
    start, end, first = lines_of(text)
    length = (end - start).astype(float)

    def counted(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return (sums[end] - sums[start]).astype(float)

    _, _, begin, finish = word_ranges(text, NOT_SPACE)
    words = hashed(data, begin, finish)
    a, b = np.searchsorted(begin, start), np.searchsorted(begin, end)
    n = (b - a).astype(float)
    sums = np.concatenate([[0, 0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1)
    again = np.where(n > 1, sums[np.maximum(b, 1)] - sums[np.minimum(a + 1, np.maximum(b, 1))], 0) if len(words) else np.zeros(len(n))
    width = np.concatenate([[0], np.cumsum((finish - begin) > 12)])
    full, letters = np.maximum(length, 1), np.maximum(counted(UPPER) + counted(LOWER_CASE), 1)
    odd = counted(MARK & ~PLAIN_MARK)
    measures = [
        np.log1p(length), np.log1p(n), counted(UPPER) / letters, counted(DIGIT) / full, odd / full, np.minimum(odd / np.maximum(n, 1), 3), counted(PLAIN_MARK) / np.maximum(n, 1),
        counted(BAR) / np.maximum(n, 1), counted(STOP) / np.maximum(n, 1), again / np.maximum(n - 1, 1), (width[b] - width[a]) / np.maximum(n, 1), counted(LATIN) / full, length / np.maximum(n, 1) / 10,
        (length == 0).astype(float), (odd / np.maximum(n, 1) > 0.5).astype(float), (counted(UPPER) / letters > 0.5).astype(float), (again / np.maximum(n - 1, 1) > 0.3).astype(float),
    ]
    return np.stack(measures, 1), length, first


def line_measures(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each line with those of its neighbours, line lengths, and the first line of each text."""
    own, length, first = _own(text)
    is_first, is_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    before, behind = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[is_first], behind[is_last] = own[is_first], own[is_last]
    like = -np.abs(own[:, :1] - before[:, :1]), -np.abs(own[:, :1] - behind[:, :1])
    return np.concatenate([own, before, behind, *like, is_first[:, None], is_last[:, None], np.ones((len(own), 1))], 1), length, first


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of good, and the expected 2 x 2 transition counts of all chains.

    score is a line's log-odds of good before its neighbours' say. Chains advance side by side, the longest first, in
    probabilities that are scaled to sum to one at each step.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    node = np.stack([1 - p, p], 1)
    move = np.exp(transition - transition.max())
    forward, backward = node.copy(), np.ones_like(node)
    active = [int(np.searchsorted(-counts, -t, "left")) for t in range(1, int(counts.max(initial=0)))]  # chains with more than t lines
    for t, k in enumerate(active, 1):
        at = begin[:k] + t
        now = (forward[at - 1] @ move) * node[at]
        forward[at] = now / now.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(active), 0, -1):
        at = begin[: active[t - 1]] + t
        ahead = node[at] * backward[at]
        both = forward[at - 1][:, :, None] * move[None] * ahead[:, None, :]
        expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        now = ahead @ move.T
        backward[at - 1] = now / now.sum(1, keepdims=True)
    out = forward * backward
    return out[:, 1] / out.sum(1), expected


def fit(text: pa.Array, good: np.ndarray) -> Field | None:
    """The field that makes the lines' labels likeliest; None without both labels."""
    good = np.asarray(good, int)
    if not len(good) or not 0 < good.mean() < 1:
        return None
    parts = [line_measures(text.slice(row, FIT_ROWS)) for row in range(0, len(text), FIT_ROWS)]
    before = np.cumsum([0, *[len(part[0]) for part in parts]])
    first = np.concatenate([*[part[2][:-1] + at for part, at in zip(parts, before)], before[-1:]])
    x = np.concatenate([part[0] for part in parts])
    mean, scale = x.mean(0), x.std(0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0.0, 1.0
    x = (x - mean) / scale
    y = np.repeat(good, np.diff(first))
    pairs = np.diff(first) - 1
    observed = np.diag([float(pairs[good == 0].sum()), float(pairs[good == 1].sum())])
    weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    slope, slope_t = np.full(len(weights), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        p, expected = marginals(x @ weights, first, transition)
        gradient = (y - p) @ x - RIDGE * len(x) * weights
        slope += gradient**2
        weights = weights + RATE * gradient / np.sqrt(slope)
        down = observed - expected - RIDGE * len(x) * transition
        slope_t += down**2
        transition = transition + RATE * down / np.sqrt(slope_t)
    return Field(mean, scale, weights, transition)


def score_batch(field: Field, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length-weighted mean of the lines' marginals for every text, the marginals, and the first line of each text."""
    x, length, first = line_measures(text)
    p, _ = marginals(((x - field.mean) / field.scale) @ field.weights, first, field.transition)
    weight = length + 1
    score = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    return np.clip(score, 0, 1), p, first


def quality(documents: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, n_lines, bad_lines of every row of documents."""
    text, good = labelled_sample(documents, labels, "quality", learn, id_column, text_column, SAMPLE_ROWS, SAMPLE_BYTES)
    field = fit(text, good)
    constant = 0.5 if not len(good) else (0.75 if good.mean() > 0.5 else 0.25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                if field is None:
                    n = len(part)
                    score, lines, bad = np.full(n, constant), np.zeros(n, np.int64), np.zeros(n, np.int64)
                else:
                    score, p, first = score_batch(field, part.column(1))
                    lines, bad = np.diff(first), np.add.reduceat((p < 0.5).astype(np.int64), first[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(lines), pa.array(bad)], ["doc_id", "score", "n_lines", "bad_lines"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double, n_lines long, bad_lines long")
