"""Defective question-answer pairs, each with one defect.

Responses and the sentences of all contexts are sorted by text over range partitions; a response whose successor
begins with it is a shortened version of that successor (whatever extends a text sorts directly behind it). Spikes in
the histogram of response lengths show a length limit. With this evidence the rules decide: empty, copy, refusal,
other language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metrikon.llm.joins import skew_safe_join
from metrikon.session import staged

# Words after which an answer cannot end, by language.
DANGLING = {
    "en": "a an the of to in on at by for from with within without after before once unless while until because and or as per than that which whose each every through following under over between into onto is are was were be been being has have had do does did not cannot at its their his her",
    "de": "der die das den dem des ein eine einen einem einer eines für nach von vom mit ohne und oder binnen höchstens sobald zu zur zum bei beim in im am aus durch seit laut so siehe wenn dass kann wird ist sind nicht jedem jeder jede",
    "fr": "le la les un une des du de d' l' à au aux en et ou après avant pour par sur avec sans dans que qui dont dès chaque selon comme pendant moins ne pas plus est sont se sa son ses",
    "es": "el la los las un una unos unas de del a al en y o tras para por con sin sobre que cada según como cuando durante menos no más es son su sus lo",
    "ru": "и или в во на с со к по из за от до для без при после перед через не что как только если чтобы под над о об у более менее",
}
# Frequent words that tell the languages apart.
MARKERS = {
    "en": "the of to and in is are for with after by on at that from when does do what which who how long many soon well under whose where following once unless has have keeps can cannot be been as set per may into through an",
    "de": "der die das den dem des ein eine einen einem einer und ist für nach von mit ohne nicht wer was wie wann welche wenn sobald binnen höchstens im siehe sagt zur zum wird kann muss viel laut bei über behält erneuert schickt nimmt weiter",
    "fr": "le la les l d du des une et est pour après avec sans dans que qui quel quelle quels dès chaque selon comme ne pas au aux par sous combien doit voir moins plus peut sur quand",
    "es": "el los las una del y es para tras con sin que cada según como cuando quién qué cuánto antes debe en menos no puede al por cuál véase indica se lo su",
    "ru": "и в на с не что как для после по без кто когда чтобы только из от до при более",
}
# Stand-ins for "no value".
NO_VALUE = "none null nil nan n/a na tbd tba tbc empty blank missing unknown undefined void no-value no-answer no-data keine kein ninguno ninguna aucun aucune нет"
# Fixed value: answers of fewer characters may be names or numbers and need a function word to count as cut.
LABEL = 12
# Phrases by which a speaker declines.
REFUSAL = (
    r"\bi(?: am|['’]m| was)? (?:unable|not able|not allowed|not permitted) to\b",
    r"\b(?:i|we) (?:cannot|can not|can['’]t|could not|couldn['’]t|won['’]t|will not|must not) (?:be able to |possibly )?(?:answer|help|assist|provide|say|respond|comment|share|tell|give|determine|find|discuss|offer|comply|fulfil|do that)",
    r"\bi (?:must|have to|need to|would rather|['’]d rather) (?:decline|refuse|not answer)",
    r"\b(?:i|we) (?:do not|don['’]t) (?:know|have (?:enough|any|the|access|sufficient))",
    r"not something i can\b",
    r"gives? me no way to (?:answer|tell|respond)",
    r"(?:isn['’]t|is not|not) enough (?:information|context|detail)",
    r"(?:is|are) not available to me\b",
    r"(?:insufficient|no) (?:information|context) (?:is |was )?(?:available|provided|given)? ?(?:for me|to answer)",
    r"kann ich (?:leider )?nicht (?:helfen|beantworten|sagen|weiterhelfen|antworten|dienen)",
    r"ich kann (?:leider )?(?:\w+ ){0,5}(?:nicht|keine|nichts) ?(?:\w+ ){0,4}(?:helfen|beantworten|sagen|antworten|geben|weiterhelfen)?",
    r"darf ich (?:leider )?(?:nichts|nicht|keine)",
    r"reicht mir (?:\w+ ){0,4}nicht",
    r"ich (?:muss|möchte) (?:\w+ ){0,3}ablehnen",
    r"ich wei(?:ß|ss) (?:es |das )?nicht",
    r"(?:fehlt|fehlen) mir\b",
    r"\bje ne (?:peux|sais|suis|dispose|saurais)\b",
    r"ne (?:me|nous) permet(?:tent)? pas de",
    r"je (?:dois|préfère) (?:refuser|décliner|ne pas)",
    r"il m['’]est impossible",
    r"\bno (?:puedo|podré|sé|dispongo|tengo)\b",
    r"no me (?:es posible|permiten?|está permitido)",
    r"(?:debo|tengo que|prefiero) (?:declinar|rechazar|no responder)",
    r"me falta\b",
    r"\bя не (?:могу|смогу|знаю|вправе|в состоянии)",
    r"не (?:могу|смогу) (?:ответить|помочь|сказать|ничего)",
    r"не позволяет (?:мне )?ответить",
)
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
_UNSEEN = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_LABEL = re.compile(r"^\W*(?:question|query|frage|pregunta|answer|antwort|réponse|respuesta|input|prompt|вопрос|ответ|q|a|f|p|r)\s*[:：.\-–—)]\s+", re.IGNORECASE)
_REFUSAL = re.compile("|".join(REFUSAL), re.IGNORECASE)
_NO_VALUE = frozenset(NO_VALUE.split())
_DANGLING = {k: frozenset(v.split()) for k, v in DANGLING.items()}
_MARKERS = {k: frozenset(v.split()) for k, v in MARKERS.items()}
_MARKED = {w: tuple((k, 1.0) for k, v in _MARKERS.items() if w in v) for w in frozenset().union(*_MARKERS.values())}
_ANY_DANGLING = frozenset().union(*_DANGLING.values())
_MARKS = " .!?…。！？"
_MORE = tuple(",;:([{«„“‘–—-/&+=#")
DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("language", T.StringType()), T.StructField("n", T.LongType())])
FOUND = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("defect", T.StringType()), T.StructField("evidence", T.StringType())])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows as an Arrow batch of a schema."""
    types = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], schema=types)


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def plain(text: str | None) -> str:
    """Without invisible characters, in NFKC, with single spaces; null gives the empty string."""
    if not text:
        return ""
    if not text.isascii():
        if _UNSEEN.search(text):
            text = text.translate(INVISIBLE)
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split())


def is_empty(answer: str) -> bool:
    bare = answer.strip(" .!?…-–—_()[]{}<>\"'*/\\|:;,#~`“”«»").lower()
    if not any(c.isalnum() for c in answer):
        return True
    return bare.replace(" ", "-") in _NO_VALUE or bare in _NO_VALUE


def known_words(lexicon: Iterable[tuple[str, str, float]]) -> dict[str, tuple[tuple[str, float], ...]]:
    """Word -> ((language, weight), ...): the marker words with those of a lexicon, rows (word, language, share)."""
    return _MARKED | {word: (*_MARKED.get(word, ()), (name, share)) for word, name, share in lexicon}


def language(text: str, known: Mapping[str, tuple[tuple[str, float], ...]]) -> tuple[str, float, float]:
    """Language of a text by its known words: (language, its score, the runner-up's)."""
    return language_of(_LETTERS.findall(text), known)


def language_of(words: list[str], known: Mapping[str, tuple[tuple[str, float], ...]]) -> tuple[str, float, float]:
    score = dict.fromkeys(MARKERS, 0.0)
    for word in words:
        low = word.lower()
        for name, weight in known.get(low, ()):
            score[name] += weight
        if "Ѐ" <= low[0] <= "ӿ":
            score["ru"] += 1
    ranked = sorted(score.items(), key=lambda x: (-x[1], x[0]))
    return ranked[0][0], ranked[0][1], ranked[1][1]


def is_copy(question: str, answer: str) -> bool:
    """The answer holds (nearly) only words of the question and (nearly) all of them, besides labels."""
    while (m := _LABEL.match(answer)) and m.end() < len(answer):
        answer = answer[m.end() :]
    q, a = Counter(_WORD.findall(question.lower())), Counter(_WORD.findall(answer.lower()))
    if not q or not a:
        return False
    foreign = sum(n for w, n in a.items() if w not in q)
    covered = sum(min(n, a[w]) for w, n in q.items()) / sum(q.values())
    return foreign <= 0.1 * sum(a.values()) and covered >= 0.7


def is_open(answer: str) -> bool:
    """A bracket or quotation that is opened and never closed; a straight mark before a word and after a space opens."""
    for a, b in ("()", "[]", "{}", "«»", "„“", "“”"):
        if answer.count(a) > answer.count(b) and not (a == "“" and "„" in answer):
            return True
    return answer.count('"') % 2 == 1 or bool(re.search(r'(?:^|[\s(])"[^\W_][^"]*$', answer))


def is_label(answer: str) -> bool:
    """A short answer that is whole as it stands, though a longer response may begin with it.

    So are a single word, a name or a number ("Yes", "New York", "Level 3") and what has its end mark; with a
    function word among others it is the beginning of a sentence ("The old mil").
    """
    if len(answer) >= LABEL:
        return False
    words = [w.lower() for w in _LETTERS.findall(answer)]
    return len(words) < 2 or bool(re.search(r"[.!?]\W*$", answer)) or not any(w in m for m in _MARKERS.values() for w in words)


def stops_early(answer: str, context: str) -> bool | None:
    """Whether the context goes on where the answer stops; None if the context does not hold the answer.

    True if it goes on in the middle of a word, or if the answer begins a sentence that is not yet at its end.
    """
    body = answer.rstrip(_MARKS)
    at, held = context.find(body), None
    if at < 0:
        low, context = body.lower(), context.lower()
        at, body = context.find(low), low
    while at >= 0 and body:
        end = at + len(body)
        rest = context[end:]
        before = context[:at].rstrip()
        starts = not before or before[-1] in ".!?…:\"”»"
        inside = bool(rest) and rest[0].isalnum() and body[-1].isalnum()
        done = not rest or rest[0] in ".!?…" and (len(rest) == 1 or not rest[1].isalnum())
        if not inside and (not starts or done):
            return False
        held = True
        at = context.find(body, at + 1)
    return held


def verdict(question: str, answer: str, context: str | None, blank_is_right: bool, shortened: bool, at_limit: bool, known: Mapping[str, tuple[tuple[str, float], ...]]) -> tuple[str, str] | None:
    """(defect, evidence) of one pair of plain texts, or None. ``context`` is None if it is unknown."""
    if is_empty(answer):
        return None if blank_is_right else ("empty", "nothing said")
    if is_copy(question, answer):
        return "copy", "words of the question"
    held = context is not None and (answer.rstrip(_MARKS) in context or answer.rstrip(_MARKS).lower() in context.lower())
    if not held and _REFUSAL.search(re.sub(r'"[^"]*"', " ", answer)):
        return "refusal", "declines"
    if not held:
        own, won, second = language(answer, known)
        asked, score, runner = language(f"{question} {context or ''}", known)
        if own != asked and won >= 2 and won > second and score > runner:
            return "other_language", f"{own} for {asked}"
    core = answer.rstrip(_MARKS)
    early = stops_early(answer, context) if context is not None else None
    if shortened and early is not False and answer[:1].isupper() and not is_label(answer):
        return "truncated", "a longer text begins with it"
    if re.search(r"(?:\.\.\.|…|\[\.\.\.\]|\[…\])\W*$", answer):
        return "truncated", "ellipsis"
    if core.endswith(_MORE) or is_open(answer):
        return "truncated", "open mark"
    if early:
        return "truncated", "context goes on"
    last = _WORD.findall(core)[-1:]
    if last and last[0] in _ANY_DANGLING and last[0].islower():
        own = language(f"{core} {question}", known)[0]
        # Where the context holds the answer, a German particle may end a clause ("weist ... ab", "nimmt ... an").
        if last[0] in _DANGLING[own] and (early is None or own != "de"):
            return "truncated", "needs more"
    if at_limit and early is None and answer[:1].isupper() and len(_WORD.findall(core)) >= 4 and not re.search(r"[.!?]\W*$", answer):
        return "truncated", "ends at a length limit"
    return None


def with_successor(texts: DataFrame, text_col: str = "t") -> DataFrame:
    """Distinct texts with ``shortened``: whether the next text in sort order begins with them.

    Range partitions keep the order over all data without one task for all; only the first text of each
    partition, one row a partition, crosses over to settle the last text of the one before.
    """
    one = T.StructType([T.StructField(text_col, T.StringType()), T.StructField("shortened", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType())])
    ordered = texts.where(F.col(text_col).isNotNull()).distinct().repartitionByRange(text_col).sortWithinPartitions(text_col)
    ordered = ordered.select(text_col, F.spark_partition_id().alias("part"))

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: str | None = None
        part = 0
        for batch in batches:
            rows = []
            for text, part in zip(batch[text_col], batch["part"], strict=True):  # noqa: B007
                if held is None:
                    rows.append((text, None, part, "first"))
                else:
                    rows.append((held, text.startswith(held), part, None))
                held = text
            yield pd.DataFrame(rows, columns=one.names)
        if held is not None:
            yield pd.DataFrame([(held, None, part, "last")], columns=one.names)

    return ordered.mapInPandas(neighbours, one)


def shortened_texts(texts: DataFrame, text_col: str = "t") -> DataFrame:
    """The distinct texts that some other text continues (column ``text_col``), the range edges settled."""
    seen = staged(with_successor(texts, text_col), "neighbours")
    inner = seen.where("edge IS NULL AND shortened").select(text_col)
    edges = seen.where("edge IS NOT NULL").select("part", "edge", F.col(text_col).alias("e")).orderBy("part", "edge").collect()  # two rows a partition
    firsts = [r for r in edges if r["edge"] == "first"]
    lasts = {r["part"]: r["e"] for r in edges if r["edge"] == "last"}
    crossing = [(lasts[a["part"]],) for a, b in zip(firsts, firsts[1:], strict=False) if b["e"].startswith(lasts[a["part"]])]
    spark = texts.sparkSession
    return inner.union(spark.createDataFrame(crossing, T.StructType([T.StructField(text_col, T.StringType())])))


def length_limits(lengths: DataFrame, factor: float = 6.0, least: int = 20, span: int = 3) -> list[int]:
    """Lengths at which far more responses end than at those around: the marks of a length limit.

    ``lengths`` has a column ``n``. The histogram meets its neighbours in a join; only the spikes come to the
    driver, and as each takes ``least`` texts of its length, S of them need about ``least`` * S * S / 2 characters.
    """
    counts = lengths.where("n IS NOT NULL").groupBy("n").count()
    near = F.explode(F.array(*(F.lit(d) for d in range(-span, span + 1) if d)))
    around = counts.select("count", near.alias("d"), "n").groupBy((F.col("n") + F.col("d")).alias("n")).agg(F.sum("count").alias("near"))
    usual = F.greatest(F.lit(1.0), F.coalesce("near", F.lit(0)) / F.lit(2.0 * span))
    spikes = counts.where(F.col("count") >= least).join(around, "n", "left").where(F.col("count") > F.lit(factor) * usual)
    return sorted(r["n"] for r in spikes.select("n").collect())


def learn_lexicon(examples: DataFrame, least: int = 3, held: int = 200_000) -> DataFrame:
    """(word, language, share) learned from all rows whose context is labelled by its marker words.

    A word of ``least`` rows or more belongs to the language of at least nine tenths of them. Each task counts its
    words by language and hands the counts on at ``held`` of them, so only sums are shuffled.
    """
    known = examples.where("expected_context IS NOT NULL AND query_text IS NOT NULL").select("query_text", "expected_context")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {name: Counter() for name in MARKERS}

        def counted() -> pa.RecordBatch:
            rows = [(w, name, n) for name, c in seen.items() for w, n in c.items() if w.islower() and len(w) > 1]
            for c in seen.values():
                c.clear()
            return _batch(rows, COUNTS)

        for b in batches:
            for question, context in zip(*_columns(b), strict=True):
                words = _LETTERS.findall(plain(context))
                name, won, second = language_of(words, _MARKED)
                if won >= 4 and won >= 1.5 * second:
                    seen[name].update({*words, *_LETTERS.findall(plain(question))})
            if sum(map(len, seen.values())) > held:
                yield counted()
        yield counted()

    counts = known.mapInArrow(count, COUNTS).groupBy("word", "language").agg(F.sum("n").alias("n"))
    words = counts.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "language")).alias("most"))
    kept = words.where((F.col("total") >= least) & (F.col("most.n") >= F.lit(0.9) * F.col("total")))
    return kept.select("word", "most.language", (F.lit(0.8) * F.col("most.n") / F.col("total")).alias("share"))


class Asked(dict):
    """Stands for the known words where the lexicon is not at hand, and keeps the words that are looked up."""

    def get(self, word: str, default: object = None) -> object:
        self[word] = None
        return _MARKED.get(word, default)


def sentences(contexts: DataFrame, text_col: str = "t") -> DataFrame:
    """The sentences (column ``t``) of the texts of ``contexts``."""
    return contexts.select(F.explode(F.split(F.col(text_col), r"(?<=[.!?…])[\"”»)]*\s+")).alias("t"))


def defective_pairs(examples: DataFrame, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """(query_id, defect, evidence) of the defective pairs, each query_id at most once per defect found.

    Reads query_id, query_text, category, expected_answer, expected_context; other columns are ignored. A null
    answer is ``empty`` unless the category, however spelled, is out_of_context; a null question equals an
    empty one, so its answer is never a copy. Every answer is compared with its neighbours in sort order, among all
    answers and all sentences of contexts; a context that holds the answer confirms or rejects what they say, and with
    another or a null context they and the rules on the answer decide. A null query_id gives a null one; repeated rows
    give one row; an empty table none. Shortened texts are broadcast up to ``broadcast_rows`` of them; beyond, both
    sides are salted, for one answer may stand in a third of all rows. So is the lexicon; beyond, the words of the rows
    whose verdict asks for a language meet it in a join.
    """
    cols = ["query_id", "query_text", "category", "expected_answer", "expected_context"]
    rows = examples.select(*cols)
    lexicon = staged(learn_lexicon(rows), "lexicon")
    answers = rows.where("expected_answer <> ''").select(F.col("expected_answer").alias("t"))
    limits = frozenset(length_limits(answers.select(F.length("t").alias("n"))))
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, _UNSEEN.pattern, ""), r"(?U)\s+", " "))
    bare = lambda c: F.regexp_replace(c, r"[\s.!?…]+$", "")
    # Several questions are asked on one context.
    contexts = rows.select(F.col("expected_context").alias("t")).where("t IS NOT NULL").distinct().select(flat("t").alias("t"))
    told = answers.select(flat("t").alias("t")).unionByName(sentences(contexts)).select(bare("t").alias("t")).where("t <> ''")
    longer = staged(shortened_texts(told).select(F.md5("t").alias("s"), F.lit(True).alias("shortened")), "longer")
    right = F.regexp_replace(F.lower(F.trim("category")), r"[\s-]+", "_") == "out_of_context"
    keyed = rows.withColumn("s", F.md5(bare(flat("expected_answer"))))
    flagged = skew_safe_join(keyed, longer, ["s"], "query_id", "left", broadcast_rows, salts)
    both = flagged.drop("s").withColumn("shortened", F.coalesce("shortened", F.lit(False))).withColumn("right", F.coalesce(right, F.lit(False))).drop("category")

    texts = ["query_id", "query_text", "expected_answer", "expected_context", "shortened", "right"]
    both = both.select(*texts)

    def judged(q: str | None, a: str | None, c: str | None, s: bool, ok: bool, known: Mapping) -> tuple[str, str] | None:
        return verdict(plain(q), plain(a), None if c is None else plain(c), ok, s, a is not None and len(a) in limits, known)

    if lexicon.count() <= broadcast_rows:
        known = known_words((r["word"], r["language"], r["share"]) for r in lexicon.collect())

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _batch([(i, *found) for i, *row in zip(*_columns(b), strict=True) if (found := judged(*row, known))], FOUND)

        return both.mapInArrow(judge, FOUND).dropDuplicates(["query_id", "defect"])

    first = T.StructType([*FOUND.fields, *(T.StructField(c, both.schema[c].dataType) for c in texts[1:]), T.StructField("words", T.ArrayType(T.StringType()))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, *row in zip(*_columns(b), strict=True):
                asked = Asked()
                found = judged(*row, asked)
                if asked:
                    out.append((i, None, None, *row, list(asked)))
                elif found:
                    out.append((i, *found, *[None] * 5, None))
            yield _batch(out, first)

    def judge_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, *row, own in zip(*_columns(b), strict=True):
                found = judged(*row, known_words((w["word"], w["language"], w["share"]) for w in own or ()))
                if found:
                    out.append((i, *found))
            yield _batch(out, FOUND)

    seen = staged(both.mapInArrow(ask, first).withColumn("uid", F.monotonically_increasing_id()), "asked")
    asked = seen.where("words IS NOT NULL")
    met = skew_safe_join(asked.select("uid", F.explode("words").alias("word")), lexicon, ["word"], "uid", "inner", broadcast_rows, salts)
    own = met.groupBy("uid").agg(F.collect_list(F.struct("word", "language", "share")).alias("own"))
    late = asked.join(own, "uid", "left").select(*texts, "own").mapInArrow(judge_asked, FOUND)
    return seen.where("words IS NULL").select(*FOUND.names).unionByName(late).dropDuplicates(["query_id", "defect"])
