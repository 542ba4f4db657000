"""One consistent form for texts that look the same.

Outside of letters a table is enough: width, kinds of single spaces, invisible characters. For runs of letters
the vocabulary of the corpus decides: the runs in one script are put into tries, and a weighted edit automaton
walks a trie with the letters of a suspect run: nothing is paid from a letter to one drawn like it or past an
ignorable character, 1 for any other change. Letters drawn like several others (a palochka is an I or an l) are what
the trie settles: the vocabulary tells which of them makes a word. Of the spellings reached at no cost, a
Latin one wins, then the most frequent, then the smallest; if none is reached, the run is rewritten by table. Tries
hold slices of the vocabulary in order of a key that no free edit changes, so none grows with the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrikon.llm import codepoints
from metrikon.llm.joins import skew_safe_join
from metrikon.session import staged

# Letters drawn alike, foreign ones first, the Latin ones they look like second.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԚԜӀҮаеорсухѕіјһԁӏԛԝ", "ABESIJKMHOPCTYXQWIYaeopcyxsijhdlqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj")
LATIN = ("ɡɑı", "gai")
# The same letters with case set aside, for comparisons that ignore case.
CYRILLIC_CASELESS = ("авекмнорстухѕіјһԁӏԛԝү", "abekmhopctyxsijhdlqwy")
GREEK_CASELESS = ("αβεζηικμνορτυχϲϳ", "abezhikmnoptyxcj")
INVISIBLE = (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF)
# Letters drawn like a second Latin one.
ALSO = {"Ӏ": "l", "ӏ": "I"}
MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿"
RUN = re.compile(f"(?:[^\\W\\d_]|[{MARKS}])+")


def _table() -> dict[int, str | None]:
    """Characters outside of letters to their consistent form, from their properties."""
    out: dict[int, str | None] = dict.fromkeys(INVISIBLE)
    for c in (*range(0xFF01, 0xFFEF), 0x3000):
        if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>")):
            out[c] = unicodedata.normalize("NFKC", chr(c))
    for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        out[c] = " "
    return out


_BASE = _table()
_TO_LATIN = {ord(a): b for foreign, latin in (CYRILLIC, GREEK, LATIN) for a, b in zip(foreign, latin, strict=True)}
_BACK = {name: {ord(b): a for a, b in reversed(list(zip(*pair, strict=True)))} for name, pair in (("C", CYRILLIC), ("G", GREEK))}
_EARLY = {ord(a): b for foreign, latin in (LATIN, ("ӏӀ", "lI"), ("ον", "ov")) for a, b in zip(foreign, latin, strict=True)}
_LATE = {ord(a): b for foreign, latin in (CYRILLIC_CASELESS, GREEK_CASELESS) for a, b in zip(foreign, latin, strict=True)}
_ALNUM = re.compile(r"[^\W_]+")
#: Any character for which comparison needs more than lower case: outside of Latin, punctuation, arrows to dingbats, Han and emoji.
_FOREIGN = re.compile("[^\x00-\xac\xae-\u0130\u0132-\u024f\u2010-\u2029\u202f-\u205f\u2190-\u27ff\u3001-\u3098\u309b-\u9fff\U0001f000-\U0001faff]")



def base_form(text: str) -> str:
    """Width, spaces and invisible characters by table, accents composed; letters keep their script."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_BASE))


def base_forms(texts: list[str | None]) -> list[str | None]:
    """``base_form`` of many texts at once."""
    out = list(texts)
    for start, stop in codepoints.blocks(texts):
        at = [k for k in range(start, stop) if texts[k] and not texts[k].isascii()]
        plain = [k for k in at if codepoints.SEP not in texts[k]]
        if plain:
            form = codepoints.composed(codepoints.translated(codepoints.SEP.join(texts[k] for k in plain), _arrays()[0]))
            for k, f in zip(plain, form.split(codepoints.SEP), strict=True):
                out[k] = f
        for k in at:
            if codepoints.SEP in texts[k]:
                out[k] = base_form(texts[k])
    return out


def script(c: str) -> str:
    """L, C or G of a letter, else empty."""
    o = ord(c)
    if o < 0x250 or 0x250 <= o < 0x2B0 or 0x1E00 <= o < 0x1F00 or 0x2C60 <= o < 0x2C80 or 0xA720 <= o < 0xA800:
        return "L" if c.isalpha() else ""
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "C"
    return "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else ""


def skeleton(run: str) -> str:
    """What all spellings that look like ``run`` have in common: every letter as the Latin one it is drawn like."""
    if run.isascii():
        return run
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", run).translate(_TO_LATIN))


def table_form(run: str) -> str:
    """Spelling by table, the same for all runs of one skeleton: Cyrillic or Greek if a letter of only that
    script is left in the skeleton and no letter of only the Latin one, else the skeleton itself."""
    sk = skeleton(run)
    if sk.isascii():
        return sk
    apart = unicodedata.normalize("NFD", sk)
    scripts = {script(c) for c in apart} - {""}
    for name, back in _BACK.items():
        if name in scripts and scripts <= {name, "L"} and all(ord(c) in back for c in apart if script(c) == "L"):
            return unicodedata.normalize("NFC", apart.translate(back))
    return sk


def is_suspect(run: str) -> bool:
    """Not plainly spelled: in more scripts than one, or foreign letters that all look Latin, or otherwise off its table form."""
    return not run.isascii() and table_form(run) != run


def one_script(run: str) -> bool:
    return len({script(c) for c in unicodedata.normalize("NFD", run)} - {""}) == 1


class Trie:
    """Words with their counts, walked by a weighted edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = (word, count)

    @staticmethod
    def cost(a: str, b: str) -> int:
        """0 from a letter to itself or one drawn like it, 1 to any other."""
        if a == b:
            return 0
        one, two = _TO_LATIN.get(ord(a), a), _TO_LATIN.get(ord(b), b)
        return 0 if one == two or ALSO.get(a, one) == two or one == ALSO.get(b, two) else 1

    def reached(self, run: str, limit: int = 0) -> list[tuple[str, int, int]]:
        """(word, count, cost) of all words at a cost of at most ``limit`` from ``run``."""
        states = self._filled({id(self.root): (self.root, 0)}, limit)
        for c in unicodedata.normalize("NFD", run):
            if ord(c) in _BASE and _BASE[ord(c)] is None:
                continue
            after: dict[int, tuple[dict, int]] = {}
            for node, paid in states.values():
                for edge, child in node.items():
                    if edge:
                        self._offer(after, child, paid + self.cost(c, edge), limit)
                self._offer(after, node, paid + 1, limit)
            states = self._filled(after, limit)
            if not states:
                return []
        return [(*node[""], paid) for node, paid in states.values() if "" in node]

    @staticmethod
    def _offer(states: dict[int, tuple[dict, int]], node: dict, paid: int, limit: int) -> bool:
        """Keep the cheapest way to a node within the limit."""
        if paid > limit or (id(node) in states and states[id(node)][1] <= paid):
            return False
        states[id(node)] = (node, paid)
        return True

    def _filled(self, states: dict[int, tuple[dict, int]], limit: int) -> dict[int, tuple[dict, int]]:
        """``states`` and those behind letters that the run leaves out, each at 1."""
        todo = list(states.values()) if limit else []
        while todo:
            node, paid = todo.pop()
            todo += [(child, paid + 1) for edge, child in node.items() if edge and self._offer(states, child, paid + 1, limit)]
        return states


def canonical(run: str, reached: list[tuple[str, int, int]]) -> str:
    """Latin before others, then the most frequent, then the smallest; by table if nothing was reached."""
    if not reached:
        return table_form(run)
    return min(reached, key=lambda x: (script(x[0][0]) != "L", -x[1], x[0]))[0]


def slice_key(run: str) -> str:
    """What no free edit of a run changes: its skeleton, letters that share a drawing taken as one."""
    return skeleton(run).replace("I", "l")


#: A letter without which no run is suspect: Greek, Cyrillic, or a Latin one drawn like another.
_ODD = re.compile("[" + LATIN[0] + "\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]")


def based(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, form, suspects): base form, null where it is the text itself, and distinct suspect runs of each text."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("text", T.StringType()), T.StructField("form", T.StringType()), T.StructField("suspects", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            texts = b.column("text").to_pylist()
            forms, suspects = base_forms(texts), []
            for form in forms:
                found = []
                if form and not form.isascii() and _ODD.search(form):
                    for r in set(RUN.findall(form)):
                        if not r.isascii():
                            odd = known.get(r)
                            if odd is None:
                                if len(known) > 200_000:
                                    known.clear()
                                odd = known[r] = is_suspect(r)
                            if odd:
                                found.append(r)
                suspects.append(sorted(found))
            changed = [None if f == t else f for f, t in zip(forms, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(changed, pa.string()), pa.array(suspects, pa.list_(pa.string()))], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def spellings(base: DataFrame, slice_rows: int = 20_000) -> DataFrame:
    """(run, spelling) of every suspect run whose canonical spelling differs from it; ``base`` has whole forms.

    The runs are sorted by ``slice_key`` in the partitions of its hash; a trie takes about ``slice_rows`` of them, up
    to where the key changes.
    """
    runs = F.regexp_extract_all("form", F.lit(rf"[\p{{L}}{MARKS}]+"), F.lit(0))
    vocabulary = base.select(F.explode(runs).alias("run")).groupBy("run").count()
    suspects = base.select(F.explode("suspects").alias("run")).distinct().withColumn("count", F.lit(-1).cast("long"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [n < 0 or one_script(r) for r, n in zip(b["run"], b["count"], strict=True)]
            b = b[keep]
            yield pd.DataFrame({"run": b["run"], "count": b["count"], "key": [slice_key(r) for r in b["run"]]})

    rows = vocabulary.unionByName(suspects).mapInPandas(keyed, "run string, count long, key string")
    wanted = rows.where("count < 0").select("key").distinct()
    rows = rows.join(wanted, "key", "left_semi").repartition("key").sortWithinPartitions("key")

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        trie, out = Trie(), []
        for r, n in zip(pdf["run"], pdf["count"], strict=True):
            if n >= 0:
                trie.add(r, int(n))
        for r in pdf.loc[pdf["count"] < 0, "run"]:
            s = canonical(r, trie.reached(r))
            if s != r:
                out.append((r, s))
        return pd.DataFrame(out, columns=["run", "spelling"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat((held, b), ignore_index=True)
            if len(held) >= slice_rows:
                last = held["key"] == held["key"].iloc[-1]
                if not last.all():
                    yield walked(held[~last])
                    held = held[last]
        if held is not None:
            yield walked(held)

    return rows.mapInPandas(walk, "run string, spelling string")


def normalize_texts(df: DataFrame, id_col: str, text_col: str, slice_rows: int = 20_000, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """(id, text, form): every text with its consistent form; equal-looking texts have equal forms.

    Null gives null, empty stays empty; one row for each row of ``df``; further columns are ignored; an empty
    table gives no row. Spellings come from the texts given, so forms compare within one call. Rows of a null
    or repeated id are kept apart by a row number of their own.
    """
    stored = staged(based(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "base")
    base = stored.withColumn("form", F.coalesce("form", "text"))
    odd = base.where(F.size("suspects") > 0)
    table = staged(spellings(base, slice_rows), "spellings")
    # A run may stand in a third of all texts.
    found = skew_safe_join(odd.select("row", F.explode("suspects").alias("run")), table, ["run"], "row", "inner", broadcast_rows, salts)
    found = found.groupBy("row").agg(F.collect_list(F.struct("run", "spelling")).alias("edits"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = []
            for form, edits in zip(b["form"], b["edits"], strict=True):
                if edits is not None and len(edits):
                    new = {e["run"]: e["spelling"] for e in edits}
                    form = unicodedata.normalize("NFC", RUN.sub(lambda m, new=new: new.get(m[0], m[0]), form))
                forms.append(form)
            yield pd.DataFrame({"id": b["id"], "text": b["text"], "form": forms})

    out = T.StructType([stored.schema["id"], stored.schema["text"], stored.schema["form"]])
    rewritten = odd.join(found, "row", "left").select("id", "text", "form", "edits").mapInPandas(rewrite, out)
    return base.where(F.size("suspects") <= 0).select("id", "text", "form").unionByName(rewritten)


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """(id_a, id_b), id_a < id_b: texts that look alike but are not the same characters.

    Null, empty and invisible texts (nothing but spaces and ignorable characters) take no part. Exact copies
    are no pair of each other, and each of them is paired with every text that looks like it: the pairs are
    found between distinct texts, then given to their members. Repeated rows give one row.
    """
    forms = normalize_texts(df, id_col, text_col, broadcast_rows=broadcast_rows, salts=salts).where(F.col("form").rlike(r"(?U)\S"))
    members = staged(forms.where("id IS NOT NULL").select("id", F.md5("form").alias("key"), F.md5("text").alias("exact")).distinct(), "forms")
    classes = members.select("key", "exact").distinct()
    several = classes.groupBy("key").count().where("count > 1").select("key")
    some = classes.join(several, "key", "left_semi")
    linked = some.select("key", F.col("exact").alias("e1")).join(some.select("key", F.col("exact").alias("e2")), "key").where("e1 < e2").select("key", "e1", "e2")
    linked = staged(linked, "linked")
    # A boilerplate text may have a third of all rows as its copies.
    one = skew_safe_join(members.select(F.col("id").alias("x"), "key", F.col("exact").alias("e1")), linked, ["key", "e1"], "x", "inner", broadcast_rows, salts)
    two = members.select(F.col("id").alias("y"), "key", F.col("exact").alias("e2"))
    pairs = one.join(two, ["key", "e2"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def compared_words(text: str | None) -> list[str]:
    """Words for comparison across scripts and cases: look-alike letters, case, marks and spacing set aside."""
    return [] if not text else _ALNUM.findall(_compared(text))


def _compared(text: str) -> str:
    if text.isascii() or not _FOREIGN.search(text):
        return text.lower()
    base, early, late = _arrays()
    form = codepoints.translated(codepoints.composed(codepoints.translated(text, base)), early).lower()
    return codepoints.composed(codepoints.translated(codepoints.decomposed(form), late))


def compared_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of the words of ``compared_words`` of all texts at once."""
    foreign = [k for k, t in enumerate(texts) if t and not t.isascii() and _FOREIGN.search(t)]
    if foreign:
        texts = list(texts)
        for k, t in zip(foreign, _compared(codepoints.joined([texts[k] for k in foreign])).split(codepoints.SEP), strict=True):
            texts[k] = t
    return codepoints.word_hashes(codepoints.joined(texts).lower())


@cache
def _arrays() -> tuple[codepoints.Table, codepoints.Table, codepoints.Table]:
    return codepoints.table(_BASE), codepoints.table(_EARLY), codepoints.table(_LATE)
