"""Encoding and decoding of texts with a public byte-level BPE vocabulary, exact and in linear time.

A token sequence is the one that merging would give if and only if each pair of neighbours is what merging their bytes
gives. So the encoder walks along the text with the longest tokens that an Aho-Corasick automaton finds, checks each
new pair in a table of compatible pairs, takes the next shorter token where a pair doesn't fit, and steps back where
none fits; a place that turned out to lead nowhere is never tried again.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES, KEPT_PAIRS, LONGEST_KEPT = 400_000, 1_000_000, 48


class Codec:
    """One vocabulary: ids by rank, pieces by pattern. Tables are per worker process and of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in ranks.items():
            self.token[i] = t
        self.length = [len(t) for t in self.token]
        self.shorter: list[int] = [-1] * size
        for t, i in ranks.items():
            for n in range(len(t) - 1, 0, -1):
                if (s := ranks.get(t[:n])) is not None:
                    self.shorter[i] = s
                    break
        self.matches = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.matches.add_word(t.decode("latin-1"), i)
        self.matches.make_automaton()
        self.offsets = [0, *accumulate(self.length)]
        self.bytes = b"".join(self.token)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, the leftmost first, until none is left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.token)))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two; left -1 asks for the right one alone."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            before = b"" if left < 0 else self.token[left]
            known = self.pairs[key] = self.merged(before + self.token[right]) == ([right] if left < 0 else [left, right])
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if (whole := self.ranks.get(data)) is not None and self.fits(-1, whole):
            return (whole,)
        size, length, shorter, fits = len(data), self.length, self.shorter, self.fits
        longest = array("i", bytes(4 * size))
        for end, i in self.matches.iter(data.decode("latin-1")):
            longest[end - length[i] + 1] = i  # longer ones end later
        out: list[int] = []
        dead = bytearray(size + 1)
        at, t = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while t >= 0 and (dead[at + length[t]] or not fits(last, t)):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = longest[at] if at < size else -1
            else:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
                t = shorter[t]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        known, add = self.pieces, out.extend
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= LONGEST_KEPT:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            add(ids)
        return out

    def decode(self, ids: Iterable[int] | None) -> str | None:
        """The text of ids, by the table of offsets; None for null, or for an id out of range. Broken UTF-8 gives U+FFFD."""
        if ids is None:
            return None
        at, most = self.offsets, len(self.token)
        parts = [self.bytes[at[i] : at[i + 1]] if i is not None and 0 <= i < most else None for i in ids]
        return None if None in parts else b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec.load(path)


def encode(df: DataFrame, key: str, text: str, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids) of each row, without a shuffle; ids is an empty list where the text is empty or null.

    Rows keep their key as it is, repeated and null keys too. Texts are encoded whole, whatever their length. Other columns
    aren't carried. vocabulary is the path of a rank file that all executors can read.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                ids.extend(c.encode(text))
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, dtype="i4")), pa.array(np.frombuffer(ids, dtype="i4") if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    slim = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_count(text: Column, vocabulary: str = BYTE_BPE_50K) -> Column:
    """The number of tokens of a text; 0 for an empty or null one."""
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        c = codec(vocabulary)
        return pd.Series([len(c.encode(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return of(text)


def decode(ids: Column, vocabulary: str = BYTE_BPE_50K) -> Column:
    """The text of a list of ids; see Codec.decode."""
    @F.pandas_udf("string")
    def of(lists: pd.Series) -> pd.Series:
        c = codec(vocabulary)
        return pd.Series([c.decode(None if x is None else list(x)) for x in lists], dtype=object)

    return of(ids)
