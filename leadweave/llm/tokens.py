"""Token ids of whole texts by a byte-pair tokenizer file, a slice of an Arrow batch at a time."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from leadweave.llm.words import LOWER, U, Words

#: words that one Python worker remembers
KNOWN = 400_000
#: words handed to the tokenizer at once
AT_ONCE = 8_000
#: ASCII letters are kind 1; marks that this tokenizer never joins with a letter, and that are in none of its special tokens, kind 2
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = 1
KINDS[list(b'.,;:!?()"')] = 2


class _Known:
    """Ids of words by two hashes of their bytes: a bounded memory of a worker. When it is full, words not met again are forgotten."""

    def __init__(self):
        self.hashes, self.second = np.zeros(0, U), np.zeros(0, U)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def find(self, u: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, u), max(0, len(self.hashes) - 1))
        hit = (self.hashes[at] == u) & (self.second[at] == second) if len(self.hashes) else np.zeros(len(u), bool)
        self.again[at[hit]] = True
        return at, hit

    def _keep(self, which: np.ndarray) -> None:
        self.flat = gather(self.flat, self.begin[which], self.size[which])
        self.hashes, self.second, self.size = self.hashes[which], self.second[which], self.size[which]
        self.begin, self.again = np.cumsum(self.size) - self.size, np.zeros(len(self.size), bool)

    def add(self, hashes: np.ndarray, second: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Words in order of their first hash, with the ids of all of them one after another."""
        if len(self.hashes) + len(hashes) > KNOWN:
            self._keep(self.again)
        if len(self.hashes) + len(hashes) > KNOWN:
            self.__init__()
        at = np.searchsorted(self.hashes, hashes)
        begin = len(self.flat) + np.cumsum(size) - size
        self.hashes, self.second, self.begin, self.size, self.again = (np.insert(a, at, b) for a, b in (
            (self.hashes, hashes), (self.second, second), (self.begin, begin), (self.size, size), (self.again, False)))
        self.flat = np.concatenate([self.flat, ids])


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin:begin + size] of all entries, one after another."""
    end = np.cumsum(size)
    return flat[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


@lru_cache(1)
def _tokenizer(path: str) -> tuple:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), _Known()


def _encode_words(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has."""
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), AT_ONCE):
        part = words[k:k + AT_ONCE]
        # one text of many words is encoded much faster than many texts; the places of the ids tell the words apart
        whole = tokenizer.encode(" ".join(part), add_special_tokens=False)
        place = np.fromiter(chain.from_iterable(whole.offsets), np.int64).reshape(-1, 2)[:, 0]
        size = np.array([len(w) + 1 for w in part])
        word = np.searchsorted(np.cumsum(size), place, "right")
        ids.append(np.array(whole.ids, np.uint32))
        sizes.append(np.bincount(word, minlength=len(part)))
        assert (np.diff(word) >= 0).all() and len(sizes[-1]) == len(part)
    return np.concatenate(ids), np.concatenate(sizes)


def encode(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of each text, as the tokenizer's ``encode(text, add_special_tokens=False)`` gives them.

    This tokenizer lower-cases, then splits at white space and between letters and marks, so a text's ids are its words' ids: distinct
    words of a batch, without the marks around them, are encoded once, and each worker remembers up to KNOWN of them. Words count as equal if two independent 64-bit hashes
    of their bytes are; a batch with two words that share one of the two is encoded text by text.
    """
    tokenizer, known = _tokenizer(path)
    w = Words(texts)
    if b"<|" not in w.data.tobytes():  # special tokens keep their case
        w.data = LOWER[w.data]
    w.split_between(KINDS)
    hashes, second = w.hashes(), w.hashes(again=True)
    u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if (second[first[inverse]] != second).any():
        return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
    second = second[first]
    at, hit = known.find(u, second)
    new = np.flatnonzero(~hit)
    ids, size = _encode_words(tokenizer, [w.text(k).decode() for k in first[new]])
    begins, sizes = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    begins[hit], sizes[hit] = known.begin[at[hit]], known.size[at[hit]]
    begins[new], sizes[new] = len(known.flat) + np.cumsum(size) - size, size
    flat = np.concatenate([known.flat, ids])
    out = gather(flat, begins[inverse], sizes[inverse])
    bounds = np.concatenate([[0], np.cumsum(sizes[inverse])])[w.at]
    known.add(u[new], second[new], ids, size)
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
