"""Random numbers as hashes of where they are used: the same on any cluster and in the SQL twins."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normal

SPAN = float(1 << 32)


def hashed(*parts: Column | str | int) -> Column:
    """A number below 2^32 out of the parts' text."""
    text = F.concat_ws("|", *[(F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashes(texts: list[bytes], *parts: str | int) -> np.ndarray:
    """:func:`hashed` of the parts and each of the texts, inside a task."""
    head = "".join(f"{p}|" for p in parts).encode()
    if len(texts) >= MANY and len(head) + max(map(len, texts)) <= 55:
        return _first_words(head, texts)
    return np.frombuffer(b"".join([hashlib.md5(head + t).digest()[:4] for t in texts]), ">u4").astype(np.int64)


#: Texts from which on their MD5 is taken by columns, if all fit a block: a fraction of the time of a call for each.
MANY = 1000
_SINES = [int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def _first_words(head: bytes, texts: list[bytes], rows: int = 16_384) -> np.ndarray:
    """The first four bytes of the MD5 of ``head`` and each text, as numbers: RFC 1321 on columns of 32-bit words. 55 bytes at most."""
    found = []
    for at in range(0, len(texts), rows):
        own = texts[at : at + rows]
        size = np.fromiter(map(len, own), np.int64, len(own))
        block = np.zeros((len(own), 64), np.uint8)
        block[:, : len(head)] = np.frombuffer(head, np.uint8)
        if width := int(size.max()):
            block[:, len(head) : len(head) + width] = np.array(own, f"S{width}").view(np.uint8).reshape(len(own), width)
        block[np.arange(len(own)), len(head) + size] = 0x80
        block[:, 56:58] = (8 * (len(head) + size)).astype("<u2").view(np.uint8).reshape(-1, 2)
        words = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(own), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for k in range(64):
            turn = k // 16
            f = _mixed(turn, b, c, d)
            f += a
            f += words[(k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16]
            f += np.uint32(_SINES[k])
            left = _TURNS[turn][k % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(left)) | (f >> np.uint32(32 - left)))
        found.append((a + np.uint32(0x67452301)).astype("<u4").view(">u4").astype(np.int64))
    return np.concatenate(found)


def _mixed(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


def uniform(*parts: Column | str | int) -> Column:
    """In (0, 1)."""
    return (hashed(*parts) + 0.5) / SPAN


def gaussian(rows: DataFrame, name: str, *parts: Column | str | int) -> DataFrame:
    """``rows`` with a standard normal column."""
    return rows.withColumn("_u", uniform(*parts)).withColumn(name, normal.ppf("_u")).drop("_u")
