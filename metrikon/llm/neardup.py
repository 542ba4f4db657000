"""Near-duplicate records: a multi-index Hamming join on sparse b-bit signatures, exact for a Jaccard threshold.

The signature of a text has one bit for each of 2**64 word hashes, set for its words, so the Hamming distance of
two signatures is the number of words in one text only. A text of n words has distance n(1 - J)/J at most to any text
of Jaccard >= J.

Signatures are split by a hash into m chunks, m by size band. By the pigeonhole principle a pair with d errors agrees
in m - d chunks or more, so a text that allows t errors need not send all of its chunks: it leaves out the m - t - 1
hottest of them, in an order of hotness that is the same for all texts. Of the chunks in which a pair agrees the
coldest can be among those left out by neither text, for there are too many hotter ones; so every pair under the
distance still shares a key, and chunks that are empty or hold frequent words only are hardly ever sent.
The order comes from a bounded sample of texts; whatever it is, no pair is lost.

Keys that are still frequent are split: in a chunk in which two texts agree there is no error, so their other words
obey the same bound, and a second split of these by another hash gives keys within the key.

A folded 64-bit signature (its distance never exceeds the full one) rejects most candidates in the join, and
the remaining pairs are compared exactly. A chunk value is the XOR of its words' hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrikon.session import staged

WORD = r"[\p{L}\p{N}]+"
KEYS = "key long, sid long, n int, sig long"


def word_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sid, n, words): distinct lower-cased words as sorted 64-bit hashes; sid identifies the set.

    Texts without words, null texts and null ids are left out; repeated rows give one row.
    """
    words = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))))
    rows = df.select(F.col(id_col).cast("string").alias("id"), words.alias("words")).where("id IS NOT NULL AND size(words) > 0")
    return rows.select("id", F.xxhash64("words").alias("sid"), F.size("words").alias("n"), "words")


def most_errors(n: np.ndarray | int, num: int, den: int, partner: int | None = None):  # noqa: ANN201
    """Greatest distance for J = num/den of a text of ``n`` words to any other, or to one of at most ``partner`` words."""
    return n * (den - num) // num if partner is None else (n + partner) * (den - num) // (den + num)


def chunks_of(band: int, num: int, den: int, spare: float) -> int:
    """Chunks of the band of 2**band to 2**(band + 1) - 1 words: one more than its errors, or ``spare`` times its words."""
    top = 2 ** (band + 1) - 1
    return max(int(most_errors(top, num, den)) + 1, math.ceil(spare * top))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def _chunk_values(mixed: np.ndarray, word: np.ndarray, row: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts ``row`` cut into ``m`` chunks each: (row, chunk, XOR of the words in it), empty chunks included."""
    first = np.concatenate(([0], np.cumsum(m)))
    out = np.zeros(first[-1], dtype=np.uint64)
    np.bitwise_xor.at(out, first[row] + (mixed % m[row].astype(np.uint64)).astype(np.int64), word)
    owner = np.repeat(np.arange(len(m)), m)
    return owner, np.arange(first[-1]) - first[owner], out


def chunk_keys(sets: DataFrame, num: int, den: int, spare: float, hot: np.ndarray | None = None, within: bool = False) -> DataFrame:
    """The keys of every text (see the module): of the chunks of each band it belongs to, the coldest one more than its errors.

    ``hot`` has the hot keys in order of hotness, hottest last; without it all chunks are sent. ``within`` adds a split
    of the words outside of the chunk that ``sets`` has a column ``key`` for: one chunk more than the errors.
    """
    hot = np.zeros(0, dtype=np.int64) if hot is None else hot
    by_key = np.argsort(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            sig = np.zeros(len(n), dtype=np.uint64)
            np.bitwise_xor.at(sig, row, np.uint64(1) << (_mixed(word, 2) % np.uint64(64)))
            own, low = (np.floor(np.log2(x)).astype(np.int64) for x in (n, np.maximum(1, -(-n * num // den))))
            outer = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) if within else None
            for band in np.unique(np.concatenate((own, low))).tolist():
                pick = np.flatnonzero((own == band) | (low == band))
                # In the band below its own a text meets those of that band only.
                errors = np.where(own[pick] == band, most_errors(n[pick], num, den), most_errors(n[pick], num, den, 2 ** (band + 1) - 1))
                m = chunks_of(band, num, den, spare)
                new = np.full(len(n), -1)
                new[pick] = np.arange(len(pick))
                use = new[row] >= 0
                bits, of = word[use], new[row[use]]
                if within:
                    m = int(most_errors(2 ** (band + 1) - 1, num, den)) + 1
                owner, chunk, value = _chunk_values(_mixed(bits, 6 if within else 1), bits, of, np.full(len(pick), m))
                key = _mixed(value ^ _mixed(np.uint64(band) << np.uint64(32) | chunk.astype(np.uint64), 7 if within else 5), 4)
                if within:
                    key = _mixed(key ^ outer[pick][owner], 8)
                heat = np.zeros(len(key), dtype=np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, key.view(np.int64), sorter=by_key), len(hot) - 1)
                    place = by_key[at]
                    heat = np.where(hot[place] == key.view(np.int64), place + 1, 0)
                if len(hot) or within:
                    order = np.lexsort((key, heat, owner))
                    send = order[(np.arange(len(key)) % m) <= errors[owner]]
                    key, owner = key[send], owner[send]
                who = pick[owner]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("sid").take(pa.array(who)), pa.array(n[who].astype(np.int32)), pa.array(sig.view(np.int64)[who])], names=["key", "sid", "n", "sig"])

    return sets.select("sid", "n", "words", *(["key"] if within else [])).mapInArrow(emit, KEYS)


def hot_keys(sets: DataFrame, rows: int, num: int, den: int, spare: float, sample_sets: int, kept: int) -> np.ndarray:
    """The at most ``kept`` most frequent chunk values of about ``sample_sets`` texts, picked by a hash, hottest last."""
    share = min(1.0, sample_sets / max(1, rows))
    some = sets.where(F.pmod(F.xxhash64("sid"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counted = chunk_keys(some, num, den, spare).groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(kept)
    return np.array([r["key"] for r in counted.collect()][::-1], dtype=np.int64)


def similar_sets(sets: DataFrame, num: int = 4, den: int = 5, spare: float = 0.3, sample_sets: int = 20_000, kept: int = 5_000, most: int = 1_000, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """(sid_a, sid_b, shared, n_a, n_b) of all pairs of different word sets with Jaccard >= num/den.

    ``sets`` has one row a set and is best staged, for it is read several times. Keys of more than ``most`` texts are
    split once more, and what is then still as frequent is salted. The list of such keys is broadcast up to
    ``broadcast_rows`` of them and joined beyond.
    """
    hot = hot_keys(sets, sets.count(), num, den, spare, sample_sets, kept)
    keys = staged(chunk_keys(sets, num, den, spare, hot if len(hot) else np.zeros(1, dtype=np.int64)), "keys")

    def crowded(of: DataFrame) -> tuple[DataFrame, int]:
        found = staged(of.groupBy("key").count().where(F.col("count") > most).select("key"), "crowded")
        size = found.count()
        return F.broadcast(found) if size <= broadcast_rows else found, size

    def met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        total = F.col("a.n") + F.col("b.n")
        near = (F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) * (den + num) <= total * (den - num)) & (F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num)
        same = F.col("a.sid") < F.col("b.sid")
        for c in ("key", *on):
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        return a.join(b, same & near).select(F.col("a.sid").alias("sid_a"), F.col("b.sid").alias("sid_b"))

    many, size = crowded(keys)
    if not size:
        pairs = met(keys, keys)
    else:
        calm = keys.join(many, "key", "left_anti")
        inner = staged(chunk_keys(keys.join(many, "key", "left_semi").select("key", "sid").join(sets, "sid"), num, den, spare, within=True), "inner-keys")
        packed, left = crowded(inner)
        pairs = met(calm, calm)
        if not left:
            pairs = pairs.unionByName(met(inner, inner))
        else:
            loose, dense = inner.join(packed, "key", "left_anti"), inner.join(packed, "key", "left_semi")
            spread = dense.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            pairs = pairs.unionByName(met(loose, loose)).unionByName(met(dense.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(salts)).cast("int")), spread, "salt"))
    pairs = pairs.distinct()
    left = sets.select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("words").alias("words_a"))
    right = sets.select(F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.col("words").alias("words_b"))
    both = pairs.join(left, "sid_a").join(right, "sid_b").withColumn("shared", F.size(F.array_intersect("words_a", "words_b")))
    return both.where((F.col("n_a") + F.col("n_b") - F.col("shared")) * num <= F.col("shared") * den).select("sid_a", "sid_b", "shared", "n_a", "n_b")


def staged_sets(df: DataFrame, id_col: str, text_col: str, label: str, broadcast_rows: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (id, sid), sets (sid, n, words), copied (sid, rep)): distinct rows, one row a word set, sets of several ids.

    No group of copies is ever gathered: the row of the smallest id stands for its set, and the others are left
    out by a join with ``copied``, broadcast after a check of its size and otherwise done once.
    """
    rows = staged(word_sets(df, id_col, text_col).dropDuplicates(["id", "sid"]), label)
    copied = staged(rows.groupBy("sid").agg(F.count("*").alias("c"), F.min("id").alias("rep")).where("c > 1").select("sid", "rep"), f"{label}-copied")
    few = copied.count() <= broadcast_rows
    sets = rows.join(F.broadcast(copied) if few else copied, "sid", "left").where("rep IS NULL OR id = rep").select("sid", "n", "words")
    return rows.select("id", "sid"), sets if few else staged(sets, f"{label}-sets"), copied


def near_duplicates(df: DataFrame, record_table: str, id_col: str, text_col: str, num: int = 4, den: int = 5) -> DataFrame:
    """(record_table, id_a, id_b): all pairs of different ids whose texts share num/den or more of their distinct words.

    Ids come out as strings, id_a before id_b by code point. Texts equal under two ids are a pair. Null, empty
    and wordless texts take no part; an id delivered twice with its text counts once (with two texts it may be
    paired by either); further columns are ignored; an empty table gives no row.
    """
    members, sets, copied = staged_sets(df, id_col, text_col, f"sets-{record_table}")
    linked = similar_sets(sets, num, den).select("sid_a", "sid_b")
    a = members.select(F.col("id").alias("x"), F.col("sid").alias("sid_a"))
    b = members.select(F.col("id").alias("y"), F.col("sid").alias("sid_b"))
    across = linked.join(a, "sid_a").join(b, "sid_b").where("x <> y")
    several = copied.select(F.col("sid").alias("sid_a"))
    same = a.join(several, "sid_a", "left_semi").join(b.withColumnRenamed("sid_b", "sid_a"), "sid_a").where("x < y")
    pairs = across.select("x", "y").unionByName(same.select("x", "y"))
    return pairs.select(F.lit(record_table).alias("record_table"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, num: int = 4, den: int = 5) -> DataFrame:
    """(id, class_id, copies, links): one row a record with words, without expanding copies into pairs.

    class_id is the smallest id with the same word set, copies their number, links the number of other
    classes at least num/den similar. Nulls, empty tables and repeated rows as in ``near_duplicates``.
    """
    members, sets, _ = staged_sets(df, id_col, text_col, "sets-classes")
    linked = similar_sets(sets, num, den)
    links = linked.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    classes = members.groupBy("sid").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return members.join(classes, "sid").join(links, "sid", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
