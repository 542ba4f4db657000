"""Byte-level BPE of a public vocabulary, as Spark expressions.

A text is cut by the tokenizer's pattern. A word that is itself in the vocabulary is one lookup. Every other distinct
word is folded once, however often it occurs: its bytes merge pair by pair, the best-ranked pair first, until no pair
has a rank. The rank map is a literal of the plan, an array of small buckets addressed by the hash of the piece, so
a lookup reads a handful of entries and no join or Python worker is needed. The folded words then return to their
texts: the most frequent of them as a second literal, so that no word is hot, all others by a join. Both
literals are bounded, by the vocabulary and by ``kept_words``.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrikon.session import staged

# Fixed value: the characters of Unicode's White_Space property.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Fixed value: the pattern that cuts a text into words.
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = 2**31 - 1
#: Distinct words of more bytes merge by a heap instead, for the fold's work grows with the square of a word's length.
LONGEST = 4096


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Piece -> rank of a rank file (base64 piece and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


Buckets = tuple[Column, int]


def literal_map(entries: dict[bytes, object], value: str) -> Buckets:
    """(array of buckets as one literal, number of buckets) holding ``entries``; ``value`` is the SQL type of the values."""
    n = max(1, len(entries))
    buckets: list[dict[str, list]] = [{"k": [], "v": []} for _ in range(n)]
    for k, v in entries.items():
        # As pmod(xxhash64(k), n) in Spark, whose hash is signed.
        h = xxhash.xxh64_intdigest(k, seed=42)
        bucket = buckets[(h - (1 << 64) if h >> 63 else h) % n]
        bucket["k"].append(base64.b64encode(k).decode())
        bucket["v"].append(v)
    return F.from_json(F.lit(json.dumps(buckets)), f"array<struct<k:array<binary>,v:array<{value}>>>"), n


def lookup(buckets: Buckets, key: Column) -> Column:
    """Value of the bytes ``key``, null if there is none."""
    table, n = buckets
    return _let(F.get(table, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), lambda b: F.get(b["v"], (F.array_position(b["k"], key) - 1).cast("int")))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: Buckets) -> Column:
    """Ids of a word of two bytes or more: the fold of ranked merges over its array of pieces.

    Beside the pieces goes an array of ranks, whose entry j is that of pieces j - 1 and j, with an entry that has none at
    either end; a merge looks up the two pairs that are new.
    """
    size = F.length(word)
    rank = lambda piece: F.coalesce(lookup(ranks, piece), F.lit(NONE))
    none = F.array(F.lit(NONE))
    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
    paired = F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank(F.substring(word, i, F.lit(2))))
    start = F.struct(pieces.alias("p"), F.concat(none, paired, none).alias("r"))

    def merge(s: Column, _: Column) -> Column:
        p, r = s["p"], s["r"]

        def at(j: Column) -> Column:
            def put(new: Column) -> Column:
                around = F.array(rank(F.concat(F.get(p, j - 2), new)), rank(F.concat(new, F.get(p, j + 1))))
                merged = F.concat(F.slice(p, F.lit(1), j - 1), F.array(new), F.slice(p, j + 2, F.size(p)))
                return F.struct(merged.alias("p"), F.concat(F.slice(r, F.lit(1), j - 1), around, F.slice(r, j + 3, F.size(r))).alias("r"))

            return _let(F.concat(F.get(p, j - 1), F.get(p, j)), put)

        return _let(F.array_min(r), lambda best: F.when(best == NONE, s).otherwise(_let((F.array_position(r, best) - 1).cast("int"), at)))

    done = F.aggregate(F.sequence(F.lit(1), size - 1), start, merge)
    return F.transform(done["p"], lambda p: lookup(ranks, p))


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word of any length: merges from a heap over a linked list, n log n."""
    if word in ranks:
        return [ranks[word]]
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    nxt, prv = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes, bytes]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < len(piece) and (r := ranks.get(piece[i] + piece[j])) is not None:
            heapq.heappush(heap, (r, i, piece[i], piece[j]))

    for i in range(len(word) - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if piece[i] is not None else len(piece)
        if piece[i] != a or j >= len(piece) or piece[j] != b:
            continue
        piece[i], piece[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[i] < len(piece):
            prv[nxt[i]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return [ranks[p] for p in piece if p is not None]


def folded_words(words: DataFrame, ranks: Buckets, by_piece: dict[bytes, int], longest: int = LONGEST) -> DataFrame:
    """``words`` (w, count), distinct and each of two bytes or more, with their ``ids``."""
    spark = words.sparkSession
    size = F.length(F.col("w").cast("binary"))
    short = words.where(size <= longest).select("w", "count", _let(ranks[0], lambda t: fold_merges(F.col("w").cast("binary"), (t, ranks[1]))).alias("ids"))
    shared = spark.sparkContext.broadcast(by_piece)
    out = T.StructType([words.schema["w"], words.schema["count"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def heaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ids=[merge_bytes(w.encode("utf-8"), shared.value) for w in b["w"]])

    return short.unionByName(words.where(size > longest).mapInPandas(heaped, out))


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, kept_words: int = 8192, longest: int = LONGEST) -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens, which count as ordinary text.

    Null and empty texts give an empty list; blank texts are encoded as they stand; one row for each row of
    ``df``, repeated rows included; further columns are ignored; an empty table gives no row.
    """
    by_piece = load_ranks(vocabulary)
    ranks = literal_map(by_piece, "int")
    words = F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))

    # The only pass over the texts. Words that are one token become its id; the others leave a gap and stay in order.
    def cut(words: Column) -> Column:
        def of(ids: Column) -> Column:
            gaps = F.filter(F.transform(ids, lambda i, k: F.when(i.isNull(), k)), lambda k: k.isNotNull())
            return _let(gaps, lambda g: F.struct(ids.alias("ids"), g.alias("gaps"), F.transform(g, lambda k: F.get(words, k)).alias("open")))

        return _let(_let(ranks[0], lambda t: F.transform(words, lambda w: lookup((t, ranks[1]), w.cast("binary")))), of)

    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _let(words, cut).alias("t"))
    texts = staged(texts.select("row", "id", "t.ids", "t.gaps", "t.open"), "words")
    counted = texts.select(F.explode("open").alias("w")).groupBy("w").count()
    folded = staged(folded_words(counted, ranks, by_piece, longest), "folded")
    # Frequent words, a bounded number, go to all tasks; each other word is rare by count and meets its texts in a join.
    top = folded.orderBy(F.desc("count"), "w").limit(kept_words).collect()
    often = literal_map({r["w"].encode("utf-8"): n for n, r in enumerate(top)}, "int")
    pieces = F.from_json(F.lit(json.dumps([list(r["ids"]) for r in top])), "array<array<int>>")
    numbers = _let(often[0], lambda t: F.transform("open", lambda w: lookup((t, often[1]), w.cast("binary"))))
    # The outer form, for from the inner one Catalyst infers filters that evaluate the list twice more.
    gap = F.posexplode_outer(_let(numbers, lambda n: F.transform("open", lambda w, k: F.when(F.get(n, k).isNull(), w))))
    met = texts.select("row", gap.alias("at", "w")).where("w IS NOT NULL").join(folded.select("w", F.col("ids").alias("piece")), "w")
    rare = met.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "piece"))).alias("rare"))
    whole = texts.select("row", "id", "ids", "gaps", numbers.alias("numbers")).join(rare, "row", "left")
    known = _let(pieces, lambda p: F.transform("numbers", lambda n, k: F.when(n.isNull(), F.try_element_at("rare", k)).otherwise(F.get(p, n))))
    ids = F.when(F.size("gaps") == 0, F.col("ids")).otherwise(fill("ids", "gaps", known))
    return whole.select(F.col("id").alias(id_col), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def fill(ids: str, gaps: str, pieces: Column) -> Column:
    """The array ``ids`` with the places ``gaps`` taken by ``pieces``, in time linear in all."""

    def parts(by: Column) -> Column:
        def part(end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(gaps, k - 1) + 1, F.lit(0))
            return F.concat(F.slice(ids, start + 1, end - start), F.get(by, k))

        last = F.element_at(gaps, -1)
        return F.concat(F.flatten(F.transform(gaps, part)), F.slice(ids, last + 2, F.size(ids)))

    return _let(pieces, parts)


def decode(df: DataFrame, ids_col: str, out_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``out_col``: the text of the ids, their binary pieces put together. Null ids give null, none the empty text.

    The pieces are joined in hexadecimal, the form in which a list of binaries can be joined in one go.
    """
    by_piece = load_ranks(vocabulary)
    pieces = [""] * (max(by_piece.values()) + 1)
    for k, v in by_piece.items():
        pieces[v] = k.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform(ids_col, lambda i: F.get(table, i)), "")
    return df.withColumn(out_col, F.decode(F.unhex(joined), "UTF-8"))


def corpus_counts(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(documents, tokens, longest): sums over all documents."""
    sizes = [F.count("*").alias("documents"), F.sum(F.size(ids_col)).alias("tokens"), F.max(F.size(ids_col)).alias("longest")]
    return encoded.agg(*sizes)
