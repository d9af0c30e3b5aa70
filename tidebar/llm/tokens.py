"""Token ids of whole texts, with each distinct word put through the tokenizer once for many uses.

For a tokenizer whose pre-tokenizer never spans white space and drops it (word_bpe_49k.json is one), the ids of
a text are the ids of its white-space separated words in order. Words are found and numbered in numpy;
only words that are new to the worker reach the tokenizers library. The store of known words is
emptied when it is full, which changes no result.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidebar.llm.common import kept_by_worker
from tidebar.llm.words import hashed, word_ranges

#: Words and parts of words that a worker keeps (about 250 bytes each).
KNOWN_WORDS = 900_000
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(string.punctuation.encode())] = True


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])


def _first_places(codes: np.ndarray, distinct: int) -> np.ndarray:
    """Where each of the numbers 0 to distinct - 1 comes first."""
    first = np.empty(distinct, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def _without_tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the words without the punctuation behind them; the start where a word is punctuation alone."""
    ends = ends.copy()
    todo = np.arange(len(ends))
    while len(todo):
        todo = todo[ends[todo] > starts[todo]]
        todo = todo[PUNCTUATION[data[ends[todo] - 1]]]
        ends[todo] -= 1
    return ends


class Encoder:
    """Words are kept as two parts, letters and the punctuation behind them, as those are separate pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.known: dict[int, int] = {}
        self.cores: dict[int, int] = {}
        self.tails: dict[str, int] = {}
        self.parts = 1  # the first is empty
        self.letters, self.tail = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store, self.used = np.zeros(1 << 20, np.uint32), 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each text. Words of letters are joined and told apart by their last id."""
        plain = bool(texts) and all(map(str.isalpha, texts))
        if plain and self.ends_word.any():
            joined = [" ".join(texts[k : k + 200]) for k in range(0, len(texts), 200)]
            ids = np.array([i for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids], np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(texts):  # each has one last id at least, so exactly one
                return ids, np.diff(ends, prepend=0)
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn_parts(self, texts: list[str]) -> int:
        """Number of the first of these parts; the others follow it."""
        before = self.parts
        for at in range(0, len(texts), 2_000):
            some = texts[at : at + 2_000]
            ids, lengths = self._ids(some)
            first = self.parts
            self.starts, self.lengths = _grown(self.starts, first + len(some)), _grown(self.lengths, first + len(some))
            self.store = _grown(self.store, self.used + len(ids))
            self.store[self.used : self.used + len(ids)] = ids
            self.starts[first : first + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(some)] = lengths
            self.used += len(ids)
            self.parts += len(some)
        return before

    def _splitting(self, cores: list[str]) -> list[bool]:
        """Whether these are letters that are still letters alone when normalised; a combining mark at their end would join the punctuation behind."""
        found, normalizer = list(map(str.isalpha, cores)), self.tokenizer.normalizer
        if normalizer is None:
            return found
        odd = [i for i, (core, good) in enumerate(zip(cores, found)) if good and not core.isascii()]
        for at in range(0, len(odd), 1_000):
            some = odd[at : at + 1_000]
            texts = [cores[i] for i in some]
            normal = normalizer.normalize_str(" ".join(texts)).split(" ")
            if len(normal) != len(texts):
                normal = list(map(normalizer.normalize_str, texts))
            for i, text in zip(some, normal):
                found[i] = text.isalpha()
        return found

    def _learn_cores(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The part of each core, -1 where it can't be parted from the punctuation behind it."""
        coded = pc.dictionary_encode(pa.array(hashes.view(np.int64)))
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy().tolist()
        new = [i for i, h in enumerate(distinct) if h not in self.cores]
        if new:
            at = _first_places(codes, len(distinct))[new]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            good = self._splitting(texts)
            self.cores.update((distinct[i], -1) for i, g in zip(new, good) if not g)
            first = self._learn_parts([x for x, g in zip(texts, good) if g])
            self.cores.update(zip([distinct[i] for i, g in zip(new, good) if g], range(first, self.parts)))
        return np.array(list(map(self.cores.__getitem__, distinct)), np.int64)[codes]

    def _learn(self, hashes: list[int], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """New words, each once, in the order of their places in the data."""
        raw = data.tobytes()
        core_ends = _without_tails(data, starts, ends)
        cored = np.flatnonzero(core_ends > starts)
        letters, tail = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        letters[cored] = self._learn_cores(hashed(data, starts[cored], core_ends[cored]), raw, starts[cored], core_ends[cored])
        tailed = np.flatnonzero((letters >= 0) & (core_ends < ends))
        behind = [raw[a:b].decode("ascii") for a, b in zip(core_ends[tailed].tolist(), ends[tailed].tolist())]
        fresh = list(dict.fromkeys(x for x in behind if x not in self.tails))
        first = self._learn_parts(fresh)
        self.tails.update(zip(fresh, range(first, self.parts)))
        tail[tailed] = [self.tails[x] for x in behind]
        whole = np.flatnonzero(letters < 0)
        first = self._learn_parts([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[whole].tolist(), ends[whole].tolist())])
        letters[whole] = np.arange(first, self.parts)
        first = len(self.known)
        self.letters, self.tail = _grown(self.letters, first + len(hashes)), _grown(self.tail, first + len(hashes))
        self.letters[first : first + len(hashes)], self.tail[first : first + len(hashes)] = letters, tail
        self.known.update(zip(hashes, range(first, first + len(hashes))))

    def encode(self, text: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32), each followed by end_id if given, and where each text's ids begin."""
        data, offsets, starts, ends = word_ranges(text)
        coded = pc.dictionary_encode(pa.array(hashed(data, starts, ends).view(np.int64)))
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        if len(self.known) + self.parts + len(distinct) > KNOWN_WORDS:
            self._empty()
        known = self.known.get
        slot = np.array([known(h, -1) for h in distinct.tolist()], np.int64)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            at = _first_places(codes, len(distinct))[missing]
            order = np.argsort(at)
            missing, at = missing[order], at[order]
            slot[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self._learn(distinct[missing].tolist(), data, starts[at], ends[at])
        parts = np.empty(2 * len(codes), np.int64)
        parts[::2], parts[1::2] = self.letters[slot][codes], self.tail[slot][codes]
        begin, length = self.starts[parts], self.lengths[parts]
        total = np.concatenate([[0], np.cumsum(length)])
        bounds = total[2 * np.searchsorted(starts, offsets)]
        ids = self.store[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        if end_id is None:
            return ids, bounds
        out = np.full(len(ids) + len(text), end_id, np.uint32)
        new_bounds = bounds + np.arange(len(bounds))
        keep = np.ones(len(out), bool)
        keep[new_bounds[1:] - 1] = False
        out[keep] = ids
        return out, new_bounds


def encoder(path: str) -> Encoder:
    """The worker's encoder; path may be a name that the public_tokenizers package resolves."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return kept_by_worker(("encoder", path), lambda: Encoder(path))
