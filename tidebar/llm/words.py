"""Words and word shingles as 64-bit hashes, for a whole run of texts at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidebar.llm.common import kept_by_worker, text_bytes

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word is a run of bytes other than white space (space, tab and line ends).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _constants(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)) | _U(1)


BYTE_VALUE = _constants(11, 256)
PLACE = _constants(12, 64)
BASE = _U(0xD6E8FEB86659FD93)
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
#: Bytes hashed at a time.
BLOCK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; a worker keeps one pair of tables and doubles it when a block is longer."""
    tables = kept_by_worker(("powers",), dict)
    if len(tables.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                powers = np.full(size, base, _U)
                powers[0] = _U(1)
                tables[name] = np.multiply.accumulate(powers)
    return tables["up"], tables["down"]


def word_ranges(text: pa.Array, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a run of texts, where each text begins, and where its words begin and end."""
    data, offsets = text_bytes(text)
    inside = word_bytes[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[1:] &= ~inside[:-1]
        starts[first] = inside[first]
        ends[:-1] &= ~inside[1:]
        ends[first[1:] - 1] = inside[first[1:] - 1]
    return data, offsets, np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of bytes, one behind the other; taken in blocks, so the tables are as long as a block or the longest range."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        a = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, a + BLOCK_BYTES, "right")))
        size = int(ends[end - 1]) - a
        first, last = starts[at:end] - a, ends[at:end] - a
        up, down = _powers(size + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, _U)
            np.cumsum(BYTE_VALUE[data[a : a + size]] * up[:size], out=sums[1:])
            out[at:end] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U))
        at = end
    return out


def word_hashes(text: pa.Array, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, A-Z lower-cased, and where each text's words begin."""
    data, offsets, starts, ends = word_ranges(text, word_bytes)
    return hashed(LOWER[data], starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every n-word shingle and where each text's shingles begin; a shorter text is one shingle, one without words none."""
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            rolled = np.zeros(len(words) - n + 1, _U)
            for j in range(n):
                rolled += mix(words[j : len(words) - n + 1 + j] ^ PLACE[j]) * PLACE[j]
            rolled = mix(rolled)
        else:
            rolled = np.zeros(0, _U)
        many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
        out_bounds = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        source = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], many)
        out = np.zeros(out_bounds[-1], _U)
        short = np.repeat(counts < n, many)
        out[~short] = rolled[source[~short]]
        for row in np.flatnonzero((counts > 0) & (counts < n)):
            value = _U(counts[row])
            for j in range(counts[row]):
                value = value + mix(words[bounds[row] + j : bounds[row] + j + 1] ^ PLACE[j])[0] * PLACE[j]
            out[out_bounds[row]] = mix(np.array([value ^ PLACE[63]], _U))[0]
    return out, out_bounds


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, ascending within a text, and where each text's begin."""
    hashes, bounds = shingle_hashes(*word_hashes(text), n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
