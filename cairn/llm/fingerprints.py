"""Winnowed fingerprints of texts: what near texts are, and which hashes they share for certain.

Near are two texts of which at most a fifth of the longer one's words was added, dropped or replaced. Such texts share
runs of words: with k words per fingerprint (4 for 20 words or more, 3 from 10, else 2) at least t fingerprints, so
that each must show one among its |fingerprints| - t + 1 first in any fixed order. The order is by rarity (class Order).
Where even these are common, near texts also share one of their n // 5 + 1 rarest words; a common fingerprint is then
replaced by its combinations with these words, so that a phrase that very many texts have doesn't bring all of them
together. Everything but reading the text works on arrays of whole batches.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

from cairn.functions import jsontext

#: Counters of words; of fingerprints there are as many as fingerprints, within these powers of two (a byte each).
WORD_BITS, LEAST_BITS, MOST_BITS = 16, 12, 22
#: A fingerprint is common from so many texts on, but only beyond so many times the mean of the counters.
COMMON, BEYOND_MEAN = 64, 4
_LINKS = re.compile(r"https?://\S+|www\.\S+", re.IGNORECASE)
_UNSEEN = re.compile(r"[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def post_text(content: str | None) -> str | None:
    """data.text of a content where data is one object, else None."""
    try:
        value = jsontext.unwrapped(content)
    except ValueError:
        return None
    data = value.get("data") if type(value) is dict else None
    text = data.get("text") if type(data) is dict else None
    return jsontext.storable(text) if type(text) is str else None


def words_of(text: str) -> list[str]:
    """The words of a text, leaving aside case, punctuation, links, HTML entities, Unicode form and spacing."""
    text = _LINKS.sub(" ", html.unescape(html.unescape(text)))
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).casefold()))


def edits_allowed(longer: int) -> int:
    return longer // 5


def print_size(longer: int) -> int:
    return 4 if longer >= 20 else 3 if longer >= 10 else 2


@lru_cache(maxsize=1 << 14)
def choice(words: int, k: int) -> int:
    """How many of its fingerprints of k words a text of so many words shows; 0 if no other near text uses k with it."""
    if not edits_allowed(words * 5 // 4) or all(print_size(n) != k for n in range(words, words * 5 // 4 + 1)):
        return 0
    shared = min((n - k + 1 - k * edits_allowed(n) for n in range(words, words * 5 // 4 + 1) if print_size(n) == k), default=1)
    return max(0, words - k + 1 - max(1, shared) + 1)


def near(a: list[str], b: list[str]) -> bool:
    """Whether at most a fifth of the longer one's words was added, dropped or replaced.

    The edit distance by bit vectors, one word of b a step, of which all rows of the table are bits of one number.
    """
    if len(a) > len(b):
        a, b = b, a
    most = edits_allowed(len(b))
    if len(b) - len(a) > most or sum((Counter(b) - Counter(a)).values()) > most:
        return False
    if not a:
        return len(b) <= most
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    every, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for left, w in zip(range(len(b) - 1, -1, -1), b):
        same = where.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (every & ~(diagonal | up)), up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        if score - left > most:
            return False
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(same | down | rise)) & every, rise & (same | down) & every
    return score <= most


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, first key first, and for each place of it how many rows before it have the same first keys.

    The last key only orders; the others make the groups.
    """
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), dtype=bool)
    for key in keys[:-1]:
        k = key[order]
        same[1:] &= k[1:] == k[:-1]
    at = np.arange(len(order))
    same[:1] = False
    return order, at - np.maximum.accumulate(np.where(same, 0, at))


@dataclass
class Texts:
    """Texts as arrays: the hashes of all words one after another, and the number of words of each text."""

    hashes: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[list[str]]) -> Texts:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
        known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
        return cls(known[coded.indices.to_numpy()] if len(known) else known, sizes)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit map of each text's words, as two numbers; an edit changes two bits at most."""
        bit = (_mix(self.hashes) >> np.uint64(57)).astype(np.uint64)
        full = np.flatnonzero(self.sizes)
        halves = []
        for low in (True, False):
            bits = np.where((bit < 64) == low, np.left_shift(np.uint64(1), bit & np.uint64(63)), np.uint64(0))
            out = np.zeros(len(self.sizes), dtype=np.uint64)
            if len(full):
                out[full] = np.bitwise_or.reduceat(bits, self.starts[full])
            halves.append(out.view(np.int64))
        return halves[0], halves[1]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all words; the n-th equal one of a text has a hash of its own."""
        return self.text, self._numbered(self.text, _mix(self.hashes + np.uint64(1)))

    @staticmethod
    def _numbered(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        order, nth = _ranks(text, hashes, np.zeros(len(text), dtype=np.int8))
        out = np.empty_like(hashes)
        out[order] = _mix(hashes[order] + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(1)
        return out

    def prints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, words in it, hash, how many of these to choose) of all fingerprints; repeats as in words()."""
        text, starts, parts = self.text, self.starts, []
        place = np.arange(len(text)) - starts[text]
        lengths, which = np.unique(self.sizes, return_inverse=True)
        for k in (2, 3, 4):
            choose = np.array([choice(int(n), k) for n in lengths], dtype=np.int64)[which] if len(lengths) else np.zeros(0, np.int64)
            at = np.flatnonzero((choose[text] > 0) & (place <= self.sizes[text] - k))
            h = np.full(len(at), k, dtype=np.uint64)
            for j in range(k):
                h = _mix(h * np.uint64(0x100000001B3) + self.hashes[at + j])
            parts.append((text[at], np.full(len(at), k, dtype=np.int8), self._numbered(text[at], h), choose[text[at]]))
        return tuple(np.concatenate(p) for p in zip(*parts))


def _quantised(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.ceil(8 * np.log2(1.0 + counts))).astype(np.uint8)


@dataclass
class Order:
    """How common fingerprints and words are in some texts, by counters of one byte; fixed once made."""

    common: int
    prints: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, prints: np.ndarray, words: np.ndarray) -> Order:
        common = max(COMMON, BEYOND_MEAN * float(prints.mean()))
        return cls(int(_quantised(np.array([common]))[0]), _quantised(prints), _quantised(words))

    @staticmethod
    def bits(prints: int) -> int:
        return min(MOST_BITS, max(LEAST_BITS, prints.bit_length()))

    def to_bytes(self) -> bytes:
        return bytes([self.common]) + self.words.tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Order:
        table = np.frombuffer(data, dtype=np.uint8)
        return cls(int(table[0]), table[1 + (1 << WORD_BITS) :], table[1 : 1 + (1 << WORD_BITS)])

    def chosen(self, texts: Texts, words: tuple, prints: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the keys that each text shows, of which near texts share one; words and prints are those of texts."""
        text, k, hashes, choose = prints
        often = self.prints[(hashes & np.uint64(len(self.prints) - 1)).astype(np.int64)]
        order, rank = _ranks(text, k, (often.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8)))
        kept = order[rank < choose[order]]
        text, hashes, often = text[kept], hashes[kept], often[kept]
        common = often >= self.common
        if not common.any():
            return text, hashes.view(np.int64)
        in_text, word = words
        rare = np.isin(in_text, np.unique(text[common]))
        in_text, word = in_text[rare], word[rare]
        often = self.words[(word & np.uint64(len(self.words) - 1)).astype(np.int64)]
        order, rank = _ranks(in_text, (often.astype(np.uint64) << np.uint64(56)) | (word >> np.uint64(8)))
        kept = order[rank <= texts.sizes[in_text[order]] // 5]
        in_text, word = in_text[kept], word[kept]  # in the order of texts
        first, last = np.searchsorted(in_text, text[common]), np.searchsorted(in_text, text[common], "right")
        each = last - first
        at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        both = _mix(np.repeat(hashes[common], each) * np.uint64(0x100000001B3) + word[at]) >> np.uint64(1)
        return np.concatenate([text[~common], np.repeat(text[common], each)]), np.concatenate([hashes[~common], both]).view(np.int64)


def counted(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(counter, count) of the texts' fingerprints, and of their words, whose counters are -1, -2 and so on."""
    prints, words = texts.prints()[2], texts.words()[1]
    at = [(prints & np.uint64((1 << bits) - 1)).astype(np.int64), -1 - (words & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)]
    return np.unique(np.concatenate(at), return_counts=True)
