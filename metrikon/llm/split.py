"""Splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over a window of words marks *landmarks*: positions that depend on the words around them
only. A cut is the first landmark beyond the minimum size, moved to the nearest natural boundary (heading,
paragraph, sentence, else line) inside the permitted range; only where there is none at all, a boundary below the
minimum is taken rather than a cut between two words. As landmarks do not depend on what lies far before
them, an edit changes the pieces around it and the later cuts fall into step again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters of Unicode's White_Space property.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = re.compile(f"[^{WHITE}]+")
BREAK = re.compile("\r\n|[\n\r\x0b\x0c" + chr(0x85) + chr(0x2029) + "]")
STOP = re.compile("[.!?…。！？][\"'’”»)\\]}*_]*$")
LAST = ".!?…。！？\"'’”»)]}*_"
HEADING = re.compile("#{1,6}$")
KINDS = ("word", "line", "sentence", "paragraph", "heading")

PIECE = T.StructType(
    [
        T.StructField("record_table", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("piece_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("overlap_words", T.IntegerType()),
        T.StructField("ends_at", T.StringType()),
    ]
)


@dataclass(frozen=True)
class SplitConfig:
    """Sizes in words. ``max_words`` bounds a piece with its overlap; ``mean_gap`` is the mean landmark distance."""

    max_words: int = 700
    overlap: int = 60
    min_words: int = 240
    window: int = 8
    mean_gap: int = 96

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.max_words:
            raise ValueError("overlap must be at least 0 and less than max_words")
        if not 0 < self.min_words <= self.max_words - self.overlap:
            raise ValueError("min_words must lie in 1..max_words - overlap")
        if self.window < 1 or self.mean_gap < 1:
            raise ValueError("window and mean_gap must be positive")


def boundary_ranks(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each word, the rank in ``KINDS`` of the boundary that follows it; the end of the text is a paragraph."""
    ranks = np.zeros(len(spans), dtype=np.int8)
    for i, (start, end) in enumerate(spans):
        if i + 1 == len(spans):
            ranks[i] = 3
            break
        after = spans[i + 1]
        breaks = len(BREAK.findall(text, end, after[0]))
        if breaks and text[after[0]] == "#" and HEADING.match(text[after[0] : after[1]]):
            ranks[i] = 4
        elif breaks > 1:
            ranks[i] = 3
        elif text[end - 1] in LAST and STOP.search(text[max(start, end - 8) : end]):
            ranks[i] = 2
        elif breaks:
            ranks[i] = 1
    return ranks


def landmarks(words: list[str], window: int, mean_gap: int) -> np.ndarray:
    """True after each word where the rolling hash of the last ``window`` words hits."""
    crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))
    rolled = np.zeros(len(words), dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(window):
            rolled[k:] += crc[: len(words) - k] * factor
            factor = factor * np.uint64(0x9E3779B97F4A7C15)
        mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hit = (mixed >> np.uint64(20)) % np.uint64(mean_gap) == 0
    hit[: window - 1] = False
    return hit


def cuts(ranks: np.ndarray, marks: np.ndarray, config: SplitConfig) -> list[tuple[int, str]]:
    """End positions (words, exclusive) of the pieces' new content and the kind of boundary at each."""
    n = len(ranks)
    if n <= config.max_words:
        return [(n, "end")] if n else []
    out: list[tuple[int, str]] = []
    start, room = 0, config.max_words - config.overlap
    natural = np.flatnonzero(ranks >= 2) + 1
    lines = np.flatnonzero(ranks == 1) + 1
    places = np.flatnonzero(marks) + 1
    while n - start > room:
        lo, hi = start + config.min_words, start + room
        if n - hi < config.min_words:  # what is left for the last piece is no less than the minimum either, where it fits
            hi = max(lo, n - config.min_words)
        seen = places[np.searchsorted(places, lo) : np.searchsorted(places, hi, "right")]
        target = int(seen[0]) if len(seen) else hi
        end, kind = target, "word"
        for options, low in ((natural, lo), (lines, lo), (natural, start + 1)):
            near = options[np.searchsorted(options, low) : np.searchsorted(options, hi, "right")]
            if len(near):
                distance = np.abs(near - target)
                best = np.lexsort((near, -ranks[near - 1], distance))[0]
                end = int(near[best])
                kind = KINDS[ranks[end - 1]]
                break
        out.append((end, kind))
        start = end
    out.append((n, "end"))
    return out


def pieces(text: str | None, config: SplitConfig) -> list[tuple[int, str, int, int, str]]:
    """(index from 1, text, words, words of overlap, kind of end) of one text. Null and blank texts have no piece."""
    spans = [m.span() for m in WORD.finditer(text)] if text else []
    if not spans:
        return []
    if len(spans) <= config.max_words:
        return [(1, text, len(spans), 0, "end")]
    words = [text[a:b] for a, b in spans]
    found, start, out = cuts(boundary_ranks(text, spans), landmarks(words, config.window, config.mean_gap), config), 0, []
    for k, (end, kind) in enumerate(found):
        first = max(0, start - config.overlap)
        out.append((k + 1, text[spans[first][0] : spans[end - 1][1]], end - first, start - first, kind))
        start = end
    return out


def split_oversized(df: DataFrame, record_table: str, id_col: str, text_col: str, config: SplitConfig | None = None) -> DataFrame:
    """Ordered pieces of every record whose text has more than ``max_words`` words; other records give no row.

    Columns: record_table, record_id, piece_index (from 1), text, n_words, overlap_words, ends_at. Each piece has
    at most ``max_words`` words and begins with the last ``overlap`` words of the one before. Null, empty and
    blank texts and texts up to the limit give no row, a null id a null record_id; a record delivered twice
    gives its pieces once; further columns are ignored, whatever their names. A text of n words needs at least
    2n - 1 characters, so shorter ones are filtered inside the JVM before any text goes to Python.
    """
    config = config or SplitConfig()
    long = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where(F.length("text") > 2 * config.max_words)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record, text in zip(batch["record_id"], batch["text"], strict=True):
                rows = pieces(text, config)
                if len(rows) > 1:
                    yield pd.DataFrame([(record_table, record, *row) for row in rows], columns=PIECE.names)

    return long.mapInPandas(cut, PIECE).dropDuplicates(["record_table", "record_id", "piece_index", "text"])
