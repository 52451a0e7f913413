"""Gzip bodies that must be reproduced byte for byte from their content: parameters, inference, codec (pandas UDFs).

Only stock zlib's deflate is at hand here. Archives of other deflate implementations (names go, zlib-ng) are told apart
as unsupported, never guessed at.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header and footer sizes, the sync marker, the known OS bytes, the bound of decompressed content.
HEADER, FOOTER, MARKER, SYSTEMS, MOST = 10, 8, b"\x00\x00\xff\xff", (3, 255), 256 << 20
COMPRESSORS = ("go", "zlib", "zlib-ng")


@dataclass(frozen=True)
class Params:
    compressor: str
    level: int
    mtime: int = 0
    os: int = 255
    flushes: tuple[int, ...] = ()
    extra_flushes: int = 0
    no_final_flush: bool = False

    def metadata(self) -> dict:
        """Only what differs from the defaults, besides compressor and level."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: list(v) if k == "flushes" else v for k, v in values.items() if k in ("compressor", "level") or v != Params("", 0).__getattribute__(k)}

    @classmethod
    def of(cls, metadata: dict) -> Params | None:
        """The parameters in a format's metadata, other keys ignored; None if they describe no archive."""
        try:
            known = {f.name: metadata[f.name] for f in fields(cls) if f.name in metadata}
            p = cls(**(known | {"flushes": tuple(known.get("flushes", ()))}))
        except TypeError:
            return None
        whole = lambda x, most: type(x) is int and 0 <= x <= most
        sound = p.compressor in COMPRESSORS and whole(p.level, 255) and whole(p.mtime, 2**32 - 1) and p.os in SYSTEMS and type(p.os) is int and whole(p.extra_flushes, 255) and type(p.no_final_flush) is bool
        return p if sound and all(whole(x, 2**32 - 1) for x in p.flushes) else None

    def reproducible(self) -> bool:
        """Whether the settings can be reproduced here: stock zlib, levels 0 to 9, ascending flushes after 0."""
        steps = all(a < b for a, b in zip((0, *self.flushes), self.flushes))
        return self.compressor == "zlib" and self.level <= 9 and not (self.no_final_flush and self.extra_flushes) and steps

    def fits(self, size: int) -> bool:
        return (not self.flushes or self.flushes[-1] < size) and size < 2**31 - 4096 - 5 * len(self.flushes)


def fast_byte(level: int) -> int:
    return {9: 2, 1: 4}.get(level, 0)


def reproduce(p: Params, content: bytes) -> bytes:
    """The archive that the parameters make of a content; they must be reproducible and fit."""
    cuts = [0, *p.flushes, len(content)]
    chunks = [content[a:b] for a, b in zip(cuts, cuts[1:])]
    squeeze = zlib.compressobj(p.level, zlib.DEFLATED, -15)
    body = b""
    for chunk in chunks[:-1] if p.no_final_flush else chunks:
        body += squeeze.compress(chunk) + squeeze.flush(zlib.Z_SYNC_FLUSH)
    for _ in range(p.extra_flushes):
        body += squeeze.compress(b"") + squeeze.flush(zlib.Z_SYNC_FLUSH)
    if p.no_final_flush:
        body += squeeze.compress(chunks[-1])
    body += squeeze.flush(zlib.Z_FINISH)
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 0, p.mtime, fast_byte(p.level), p.os)
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def decompress(data: bytes | None) -> str | None:
    """The UTF-8 text of one gzip member of at most 256 MiB, else None."""
    if data is None or data[:2] != b"\x1f\x8b":
        return None
    try:
        d = zlib.decompressobj(31)
        out = d.decompress(data, MOST + 1)
        return out.decode() if d.eof and not d.unused_data and len(out) <= MOST else None
    except (zlib.error, UnicodeDecodeError):
        return None


def flush_layout(archive: bytes, size: int) -> tuple[tuple[int, ...], int, bool] | None:
    """(content offsets of flushes, extra flushes at the end, no final flush), read from the sync markers; None if unfit."""
    body = archive[HEADER:-FOOTER]
    d, done, total, offsets = zlib.decompressobj(-15), 0, 0, []
    at = body.find(MARKER)
    try:
        while at >= 0:
            total += len(d.decompress(body[done : at + 4]))
            if d.unused_data or d.eof:
                return None
            done = at + 4
            offsets.append(total)
            at = body.find(MARKER, at + 1)
    except zlib.error:
        return None
    inner = [o for o in offsets if o < size]
    if any(a >= b for a, b in zip([0, *inner], inner)):
        return None
    trailing = len(offsets) - len(inner)
    return (tuple(inner), max(0, trailing - 1), trailing == 0) if trailing <= 256 else None


def infer(archive: bytes | None) -> Params | None:
    """The parameters that reproduce an archive exactly with stock zlib, levels 1 to 9; else None."""
    text = decompress(archive)
    if text is None or len(archive) < HEADER + FOOTER or archive[2:4] != b"\x08\x00" or archive[9] not in SYSTEMS:
        return None
    content = text.encode()
    if (layout := flush_layout(archive, len(content))) is None:
        return None
    mtime = struct.unpack_from("<I", archive, 4)[0]
    for level in range(1, 10):
        p = Params("zlib", level, mtime, archive[9], *layout)
        if fast_byte(level) == archive[8] and p.reproducible() and p.fits(len(content)) and reproduce(p, content) == archive:
            return p
    return None


def encode(content: str | None, metadata: str | None) -> bytes | None:
    """The archive of a content by a format object's metadata; the plain bytes where that is unsupported."""
    if content is None:
        return None
    data = content.encode()
    try:
        given = json.loads(metadata or "")
    except ValueError:
        given = None
    p = Params.of(given) if isinstance(given, dict) else None
    return reproduce(p, data) if p and p.reproducible() and p.fits(len(data)) else data


def _udf(returns: str, f: Callable) -> Callable[..., Column]:
    def column(*columns: Column) -> Column:
        if len(columns) == 1:

            @F.pandas_udf(returns)
            def one(a: pd.Series) -> pd.Series:
                return pd.Series([f(x) for x in a], dtype=object)

            return one(*columns)

        @F.pandas_udf(returns)
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b)], dtype=object)

        return two(*columns)

    return column


def _detected(data: bytes | None) -> str | None:
    p = infer(data)
    return None if p is None else json.dumps({"type": "gzip"} | p.metadata(), separators=(",", ":"))


decompressed = _udf("string", decompress)
detected = _udf("string", _detected)
encoded = _udf("binary", encode)
