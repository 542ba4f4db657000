"""Passages of test items inside a training corpus: n-gram seeds, then Smith-Waterman alignment.

The corpus is read once. A document that holds an n-gram of an item leaves the first pass as the words around it;
nothing else of it is written or sent. The n-grams of these passages are counted over the whole corpus; each
unbroken run of words that a passage and an item share then gives its rarest n-gram as the seed by which the two
meet, so no shared run is lost, however frequent its n-grams are. Around the seeds the passage and the item are aligned:
the score decides, the longest unbroken run tells the exact copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrikon.llm import codepoints
from metrikon.llm.lookalike import compared_hashes
from metrikon.session import staged

#: A matching word; a mismatch and a gap of one word cost 1.
MATCH = 2


def grams(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, 64-bit hash) of each run of ``n`` words; ``words`` holds those of texts of ``sizes`` words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = (pos + n <= sizes[row])[: len(out)]
    return row[: len(out)][whole], pos[: len(out)][whole], codepoints.mixed(out)[whole]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``size[0]`` values, then those of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class Side:
    """Many lists of words in one array: each begins at ``first`` and goes ``size`` words in the direction ``step``."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    step: np.ndarray

    def columns(self, which: np.ndarray, rows: int, fill: int, reverse: bool) -> np.ndarray:
        """Lists ``which`` as columns of ``rows`` words, filled up behind their end; upside down if ``reverse``."""
        at = np.arange(rows - 1, -1, -1)[:, None] if reverse else np.arange(rows)[:, None]
        place = self.first[which] + at * self.step[which]
        return np.where(at < self.size[which], self.words[np.clip(place, 0, len(self.words) - 1)], self.words.dtype.type(fill))


def extensions(docs: Side, items: Side, cells: int = 65_536) -> np.ndarray:
    """Best score with which an alignment that begins before the first words of both lists goes on.

    The words are codes that are multiples of 4, so that two of them differ in no bit or by 4 or more. Pairs of like
    size fill blocks of about ``cells`` values, whose anti-diagonals are computed from the two before. On the diagonal
    of i words of one and j of the other a score is held as score + i + j: the edge is then 0 and a gap costs nothing,
    a match gives 4 and a mismatch 1.
    """
    out = np.zeros(len(docs.first), dtype=np.int64)
    height = (items.size + 3) >> 2
    order = np.lexsort((docs.size, height))
    order = order[(items.size[order] > 0) & (docs.size[order] > 0)]
    ends = np.searchsorted(height[order], height[order], "right")
    code = docs.words.dtype
    start = 0
    while start < len(order):
        per = max(1, cells // (4 * int(height[order[start]])))
        block = order[start : min(start + per, int(ends[start]))]
        start += len(block)
        high, wide = int(items.size[block].max()), int(docs.size[block].max())
        kind = np.int16 if code == np.uint16 and 3 * min(high, wide) + high + wide < 32_000 else np.int32
        doc = docs.columns(block, wide, np.iinfo(code).max - 3, True).astype(np.dtype(kind).str.replace("i", "u"), copy=False)
        item = items.columns(block, high, np.iinfo(code).max - 7, False).astype(doc.dtype, copy=False)
        now, last, older = (np.zeros((high + 1, len(block)), dtype=kind) for _ in range(3))
        differs = np.zeros((high, len(block)), dtype=doc.dtype)
        three, four = np.full_like(differs, 3), np.full(differs.shape, 4, dtype=kind)  # arrays, for single values are slow
        best = np.zeros(len(block), dtype=kind)
        for t in range(wide + high - 1):
            lo, hi = max(0, t - wide + 1), min(high - 1, t) + 1
            new, d = now[lo + 1 : hi + 1], differs[lo:hi]
            # Reversed documents: the word that meets item word i on this diagonal stands at wide - 1 - t + i.
            np.bitwise_xor(doc[wide - 1 - t + lo : wide - 1 - t + hi], item[lo:hi], out=d)
            np.minimum(d, three[lo:hi], out=d)
            np.subtract(older[lo:hi], d.view(kind), out=new)
            np.add(new, four[lo:hi], out=new)
            np.maximum(new, last[lo + 1 : hi + 1], out=new)
            np.maximum(new, last[lo:hi], out=new)
            np.maximum(best, new.max(axis=0) - kind(t + 2), out=best)
            now, last, older = older, now, last
        out[block] = best
    return out


@dataclass
class Index:
    """One block of items: their coded words and, in order of hash, the places of every n-gram."""

    ids: list
    sizes: np.ndarray  # words of each item
    words: np.ndarray  # sorted hashes of all words; their places are the codes
    coded: np.ndarray  # the words of all items as codes times 4
    gram: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # places of gram g: first[g] .. first[g + 1] of the two below
    item: np.ndarray
    pos: np.ndarray
    before: np.ndarray  # words before an n-gram that an alignment through it can cover
    after: np.ndarray  # words behind its beginning, likewise

    @classmethod
    def of(cls, rows: list[tuple[object, np.ndarray]], n: int) -> Index:
        sizes = np.array([len(w) for _, w in rows], dtype=np.int64)
        flat = np.concatenate([w for _, w in rows]) if rows else np.zeros(0, dtype=np.uint64)
        words = np.unique(flat)
        item, pos, h = grams(flat, sizes, n)
        by = np.lexsort((pos, item, h))
        gram, first = np.unique(h[by], return_index=True)
        # An alignment through a seed has at most two points a word of the item on either side to spend on insertions.
        most = (lambda x: np.maximum.reduceat(x, first)) if len(gram) else (lambda x: x)
        before, after = most(3 * pos[by]), most(n + 3 * (sizes[item[by]] - pos[by] - n))
        kind = np.uint16 if len(words) < 16_000 else np.uint32
        coded = (4 * np.searchsorted(words, flat)).astype(kind)
        return cls([i for i, _ in rows], sizes, words, coded, gram, np.append(first, len(h)), item[by], pos[by], before, after)

    def find(self, sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Place of each value among the sorted ones, -1 if it is not there."""
        if not len(sorted_values):
            return np.full(len(values), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
        return np.where(sorted_values[at] == values, at, -1)


NUMBERS = (*(T.StructField(c, T.IntegerType()) for c in ("score", "longest_run", "item_words")), T.StructField("seed_places", T.LongType()))
PASSAGE = (T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("gram", T.ArrayType(T.IntegerType())))


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))


def passages(texts: list[str | None], index: Index, n: int) -> tuple[np.ndarray, pa.ListArray, pa.ListArray, pa.ListArray]:
    """(text, coded words, positions in them of the n-grams found, these n-grams) of all places that meet an item."""
    owner, words = compared_hashes(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    row, pos, h = grams(words, sizes, n)
    found = index.find(index.gram, h)
    keep = found >= 0
    row, pos, found = row[keep], pos[keep], found[keep]
    ends = np.cumsum(sizes)
    place = pos + (ends - sizes)[row]
    # Spans around all hits, in one numbering of the words of the batch; those that touch become one passage.
    a = np.maximum((ends - sizes)[row], place - index.before[found])
    z = np.minimum(ends[row], place + index.after[found])
    # Texts follow each other, so the furthest end so far never lies beyond the text at hand.
    z = np.maximum.accumulate(z) if len(row) else z
    begins = np.ones(len(row), dtype=bool)
    begins[1:] = (row[1:] != row[:-1]) | (a[1:] > z[:-1])
    head = np.flatnonzero(begins)
    low = np.minimum.reduceat(a, head) if len(head) else a
    high = z[np.append(head[1:], len(row)) - 1] if len(head) else z
    width = high - low
    of = np.cumsum(begins) - 1
    coded = index.find(index.words, words[_ranges(low, width)]) if len(head) else place
    hit_ends = np.append(head, len(row))
    return row[head], _lists(coded, np.append(0, np.cumsum(width))), _lists(place - low[of] if len(head) else place, hit_ends), _lists(found, hit_ends)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each list begins, and the end of the last)."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), off - off[0]


def aligned(batch: pa.RecordBatch, index: Index, seen: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(passage, item, score, longest run, places of the rarest seed) of every passage and item that share ``n`` words in a row."""
    words, begin = _flat(batch.column("words"))
    at, hit_begin = _flat(batch.column("at"))
    gram = batch.column("gram").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(begin)
    row = np.repeat(np.arange(batch.num_rows), np.diff(hit_begin))
    many = index.first[gram + 1] - index.first[gram]
    where = _ranges(index.first[gram], many)
    row, at, gram = np.repeat(row, many), np.repeat(at, many).astype(np.int64), np.repeat(gram, many)
    item = index.item[where]
    diagonal = at - index.pos[where]
    by = np.lexsort((at, diagonal, item, row))
    row, at, gram, item, diagonal = row[by], at[by], gram[by], item[by], diagonal[by]
    if not len(row):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    # A run of shared words is a run of neighbouring hits on one diagonal; its rarest n-gram is its seed.
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    run_words = np.diff(np.append(first, len(row))) + n - 1
    rarest = np.minimum.reduceat(seen[gram], first)
    row, item, at, place = row[first], item[first], at[first], (at - diagonal)[first]
    # The seed extends to its run without an edit, and from both ends of the run by alignment.
    after = place + run_words
    doc_first, item_first = begin[row] + at, (np.cumsum(index.sizes) - index.sizes)[item]
    ahead = index.sizes[item] - after
    kind = index.coded.dtype
    coded = np.where(words < 0, len(index.words), words).astype(kind) * kind.type(4)
    step = np.repeat([-1, 1], len(row))
    both = lambda a, b: np.concatenate((a, b))
    docs = Side(coded, both(doc_first - 1, doc_first + run_words), both(np.minimum(at, 3 * place), np.minimum(size[row] - at - run_words, 3 * ahead)), step)
    items = Side(index.coded, both(item_first + place - 1, item_first + after), both(place, ahead), step)
    grown = extensions(docs, items)
    score = MATCH * run_words + grown[: len(row)] + grown[len(row) :]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    return row[first], item[first], np.maximum.reduceat(score, first), np.maximum.reduceat(run_words, first), np.minimum.reduceat(rarest, first)


def _item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words): the hashed words of every item, each item with each of its texts once."""
    schema = T.StructType([T.StructField("item_id", items.schema[item_col].dataType), T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, words = compared_hashes(b.column("text").to_pylist())
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=b.num_rows)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists], names=schema.names)

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, schema).distinct()


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", n: int = 6, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, longest_run, item_words, seed_places): documents that share ``n`` consecutive words with an item.

    Words are those of ``lookalike.compared_hashes``. ``score`` is the best local alignment (2 for a matching word,
    -1 for each edit) of the item with the document through a shared run: it tells edited copies from shared phrases.
    An alignment with a positive score has at most two points for each word of the item beside the run to spend on
    insertions, and as much of the document is looked at, so the score is exact however much is inserted.
    ``longest_run`` is the greatest number of consecutive words that both hold; ``seed_places`` says how many passages of
    the corpus hold the rarest n-gram the two share: many for a stock phrase, few for a leak.

    The items are taken in blocks of about ``block_words`` words, and a block meets all documents: what goes to the
    workers is bounded whatever the number of items. Null texts and ids give no row, nor do items of fewer than ``n``
    words; an id under two texts gives its best row; columns of other names are ignored.
    """
    test = staged(_item_words(items, item_col, text_col).where(F.size("words") >= n), "items")
    blocks = max(1, math.ceil((test.agg(F.sum(F.size("words"))).first()[0] or 0) / block_words))
    corpus = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = [_block(corpus, test.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k), n) for k in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "longest_run", "item_words")), F.min("seed_places").alias("seed_places"))


def _block(corpus: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """``leaks`` for a block of items, which is collected: its size is bounded by the number of blocks."""
    item_type = test.schema["item_id"].dataType
    rows = sorted(((r["item_id"], np.array(r["words"], dtype=np.int64).view(np.uint64)) for r in test.collect()), key=lambda r: (r[0], r[1].tobytes()))
    sc = corpus.sparkSession.sparkContext
    index = sc.broadcast(Index.of(rows, n))
    cut = T.StructType([T.StructField("doc_id", corpus.schema["doc_id"].dataType), *PASSAGE])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for start, stop in codepoints.blocks(texts):
                of, *lists = passages(texts[start:stop], index.value, n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of + start)), *lists], names=cut.names)

    met = staged(corpus.mapInArrow(meet, cut), "passages")
    seen = np.zeros(len(index.value.gram), dtype=np.int64)
    for r in met.select(F.explode("gram").alias("g")).groupBy("g").count().toLocalIterator():  # at most one row an n-gram of the block
        seen[r["g"]] = r["count"]
    often = sc.broadcast(seen)
    found = T.StructType([cut["doc_id"], T.StructField("item_id", item_type), *NUMBERS])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(index.value.ids) if index.value.ids else None
        for b in batches:
            of, item, score, run, places = aligned(b, index.value, often.value, n)
            if len(of):
                numbers = [pa.array(x.astype(t)) for x, t in zip((score, run, index.value.sizes[item], places), (np.int32, np.int32, np.int32, np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), ids.take(pa.array(item)), *numbers], names=found.names)

    return met.mapInArrow(align, found)
