"""Work on the code points of many texts at once, for stages that would spend their time on single characters in Python.

The texts of a batch are joined by NUL and turned into an array of code points; character tables are then array
lookups, and words come out as 64-bit hashes without a string object for each.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SEP = "\x00"
LAST = 0x110000
DROP = np.uint32(LAST)


Table = tuple[np.ndarray, tuple[tuple[str, str], ...]]


def table(entries: dict[int, str | None]) -> Table:
    """Array form of a translation: ``DROP`` marks characters left out; the few that become several stand apart."""
    out = np.arange(LAST, dtype=np.uint32)
    several = []
    for code, to in entries.items():
        if to is not None and len(to) > 1:
            several.append((chr(code), to))
        else:
            out[code] = ord(to) if to else DROP
    return out, tuple(several)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def translated(text: str, by: Table) -> str:
    """As ``str.translate``, at the speed of array lookups."""
    if text.isascii():
        return text
    found = by[0][codes(text)]
    out = found[found != DROP].tobytes().decode("utf-32-le", "surrogatepass")
    for one, to in by[1]:
        out = out.replace(one, to)
    return out


def joined(texts: list[str | None]) -> str:
    """All texts in one string; a NUL inside of a text, like any other control character, stands between words."""
    return SEP.join(t.replace(SEP, " ") if t else "" for t in texts)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(LAST)), dtype=bool, count=LAST)


@cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(all_texts: str) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each run of letters and digits of texts put together by ``joined``."""
    c = codes(all_texts)
    alnum = _letters()[c]
    starts = alnum.copy()
    starts[1:] &= ~alnum[:-1]
    owner = np.cumsum(c == 0, dtype=np.int64)[starts]
    first = np.flatnonzero(starts[alnum])
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    inside = c[alnum].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(np.append(first, len(inside)))
    at = np.arange(len(inside)) - np.repeat(first, sizes)
    top = 1 << int(sizes.max() - 1).bit_length()
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mixed(inside) * _powers(top)[at], first)
        return owner, mixed(sums + sizes.astype(np.uint64))


def blocks(texts: list[str | None], chars: int = 1_000_000) -> list[tuple[int, int]]:
    """[start, stop) of runs of texts of about ``chars`` characters, so that the arrays of one stay small."""
    out, start, seen = [], 0, 0
    for k, t in enumerate(texts):
        seen += len(t) if t else 0
        if seen >= chars:
            out.append((start, k + 1))
            start, seen = k + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def decomposed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFD", text)
