"""Token ids of texts by a tokenizer file, each different word encoded once.

The public word tokenizer cuts at white space before anything else, so the ids of a text are those of
its words in order. Words are told apart by two fingerprints of 64 bits each. Tokenizers of which this
isn't true must not be used here; `splits_at_spaces` tests it on texts.
"""

from __future__ import annotations

import os

import numpy as np

from tablemill.llm.common import process_cache, slices, word_bounds, word_hashes

#: Words whose ids are remembered by a process: about 25 bytes each, all forgotten when there are more.
REMEMBERED = 1_500_000
#: Words in one call of the tokenizer.
BATCH = 1_000


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of pool[start : start + size], put together a slice at a time."""
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    if not edges[-1]:
        return pool[:0]
    out = np.empty(edges[-1], pool.dtype)
    for a, b in slices(edges):
        lo, hi = edges[a], edges[b]
        if b - a == 1:
            out[lo:hi] = pool[start[a] : start[a] + size[a]]
        else:
            out[lo:hi] = pool[np.repeat(start[a:b] - edges[a:b], size[a:b]) + np.arange(lo, hi)]
    return out


class Encoder:
    """Encodes words and remembers them, within bounds."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = load(path)
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.key, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint16)

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a batch, and n + 1 offsets into them."""
        ids, sizes, firsts = self.encode_by_word(body, offsets)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[firsts]

    def encode_by_word(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a batch, how many each word has, and n + 1 indexes of the documents' first words."""
        ids, sizes, firsts, before = [np.empty(0, np.uint16)], [np.empty(0, np.int64)], [np.zeros(1, np.int64)], 0
        for a, b in slices(offsets):
            got, size, first = self._slice(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(got)
            sizes.append(size)
            firsts.append(first[1:] + before)
            before += len(size)
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate(firsts)

    def _slice(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, firsts = word_bounds(body, offsets)
        key, check = word_hashes(body, starts, 1), word_hashes(body, starts, 2)
        unit, first, back = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check[first][back], check):
            raise ValueError("two words of a slice share a fingerprint; change the seed")
        start, size = self._units(body, unit, check[first], starts[first], ends[first])
        start, size = start[back], size[back]
        return gather(self.pool, start, size), size, firsts

    def _units(self, body, unit, check, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        at, known = self._find(unit, check)
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.key) + len(missing) > self.remembered:
                self.forget()
                missing = np.arange(len(unit))
            self._learn(body, unit[missing], check[missing], starts[missing], ends[missing])
            at, _ = self._find(unit, check)
        return self.start[at], self.size[at]

    def _find(self, unit: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(unit), np.int64), np.zeros(len(unit), bool)
        at = np.minimum(np.searchsorted(self.key, unit), len(self.key) - 1)
        same = self.key[at] == unit
        if not np.array_equal(self.check[at][same], check[same]):
            raise ValueError("two words share a fingerprint; change the seed")
        return at, same

    def _learn(self, body, unit, check, starts, ends) -> None:
        words = [body[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, sizes = self.encode_words(words)
        start = len(self.pool) + np.concatenate(([0], np.cumsum(sizes)))[:-1]
        if len(ids) and ids.max() >= 1 << 16 and self.pool.dtype == np.uint16:
            self.pool = self.pool.astype(np.uint32)
        self.pool = np.concatenate([self.pool, ids.astype(self.pool.dtype)])
        key = np.concatenate([self.key, unit])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.check = np.concatenate([self.check, check])[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, sizes])[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, and how many each word has."""
        ids, sizes = [], np.zeros(len(words), np.int64)
        for a in range(0, len(words), BATCH):
            part = words[a : a + BATCH]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.asarray(got.ids, np.uint32))
            of = np.asarray([-1 if x is None else x for x in got.word_ids], np.int64)
            if len(of) and of.min() < 0:
                one = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
                ids[-1] = np.asarray([i for x in one for i in x], np.uint32)
                sizes[a : a + len(part)] = [len(x) for x in one]
            else:
                sizes[a : a + len(part)] = np.bincount(of, minlength=len(part))
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), sizes


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    kept = process_cache("encoders", large=True)
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def splits_at_spaces(path: str, texts: list[str]) -> bool:
    """Whether the words' ids, in order, are the texts' ids."""
    one = Encoder(path)
    return all(
        one.encode_words(t.replace("\n", " ").split(" "))[0].tolist() == one.tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    )
