"""Judges: is a retrieved text relevant to an expected one? Column expressions, or Arrow batches for outside models."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrikon.functions.text import NEGATIONS, STOPWORDS, content_tokens, let, literal_texts, norm, tokens
from metrikon.operators.providers import make_provider, provider_name  # noqa: F401
from metrikon.schema import ValidationError, require_positive


@dataclass(frozen=True)
class JudgmentContext:
    """One question, a text that would answer it and a text that was found."""

    query: str
    expected_text: str
    retrieved_text: str


class Judge(Protocol):
    """A judge adds the boolean column ``relevant`` to contexts (query, expected_text, retrieved_text)."""

    name: str

    def judged(self, contexts: DataFrame) -> DataFrame: ...


class OneByOne:
    """The same judgments for contexts at hand: they become a small frame of the active session."""

    def batch_judge(self, contexts: Sequence[JudgmentContext]) -> list[bool]:
        if not contexts:
            return []
        rows = [(i, c.query, c.expected_text, c.retrieved_text) for i, c in enumerate(contexts)]
        frame = SparkSession.builder.getOrCreate().createDataFrame(rows, "i int, query string, expected_text string, retrieved_text string")
        found = {r["i"]: bool(r["relevant"]) for r in self.judged(frame).select("i", "relevant").collect()}
        return [found[i] for i in range(len(rows))]

    def judge(self, context: JudgmentContext) -> bool:
        return self.batch_judge([context])[0]

    async def ajudge(self, context: JudgmentContext) -> bool:
        return await asyncio.to_thread(self.judge, context)

    async def abatch_judge(self, contexts: Sequence[JudgmentContext]) -> list[bool]:
        return await asyncio.to_thread(self.batch_judge, contexts)


class ColumnJudge(OneByOne):
    """A judge that is a Column expression and stays inside the plan."""

    name = "column"

    def column(self, query: Column, expected: Column, retrieved: Column) -> Column:
        raise NotImplementedError

    def judged(self, contexts: DataFrame) -> DataFrame:
        return contexts.withColumn("relevant", self.column(F.col("query"), F.col("expected_text"), F.col("retrieved_text")))


def _weight(t: Column) -> Column:
    """Weight of a token in hundredths, so that sums are exact: digits, short ones, long ones, others."""
    return F.when(t.rlike("^[0-9]+$"), 150).when(F.length(t) <= 2, 75).when(F.length(t) >= 8, 135).otherwise(100)


def _weights(a: Column) -> Column:
    return F.aggregate(F.transform(a, _weight), F.lit(0), lambda x, y: x + y)


@dataclass(frozen=True)
class TokenOverlapJudge(ColumnJudge):
    """Weighted overlap of content tokens, with short cuts for equal, negated and contained texts.

    In this order: equal normalised texts 1; a negation on one side only 0; one text contained in the other 1;
    fewer than ``min_tokens`` shared content tokens 0; else the share of the expected tokens' weight, plus a
    bonus for a common phrase and one if a shared token stands in the query.
    """

    min_tokens: int = 15
    overlap_ratio: float = 0.6
    query_boost: bool = True
    stopwords: tuple[str, ...] = field(default=tuple(STOPWORDS))

    name = "token_overlap"

    def __post_init__(self) -> None:
        require_positive(self.min_tokens, "min_tokens")
        if not 0.0 <= self.overlap_ratio <= 1.0:
            raise ValidationError("overlap_ratio must lie in 0..1")
        object.__setattr__(self, "stopwords", tuple(self.stopwords))

    def _phrase(self, content: Column, text: Column) -> Column:
        """0.05 for each word beyond the first of the longest common phrase of 2 to 4 expected content tokens."""

        def hit(n: int) -> Column:
            starts = F.when(F.size(content) >= n, F.sequence(F.lit(1), F.size(content) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.when(F.exists(starts, lambda i: F.contains(text, F.array_join(F.slice(content, i, F.lit(n)), " "))), F.lit(0.05 * (n - 1)))

        return F.coalesce(hit(4), hit(3), hit(2), F.lit(0.0))

    def score(self, query: Column, expected: Column, retrieved: Column) -> Column:
        q, e, r = (F.coalesce(c, F.lit("")) for c in (query, expected, retrieved))
        negations = literal_texts(NEGATIONS)

        def overlap(content: Column) -> Column:
            wanted = F.array_distinct(content)

            def of_shared(s: Column) -> Column:
                base = _weights(s).cast("double") / F.nullif(_weights(wanted), F.lit(0)).cast("double")
                boost = F.when(F.size(F.array_intersect(s, content_tokens(q, self.stopwords))) > 0, 0.1).otherwise(0.0) if self.query_boost else F.lit(0.0)
                total = F.coalesce(base, F.lit(0.0)) + self._phrase(content, norm(r)) + boost
                return F.when(F.size(s) < self.min_tokens, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))

            return let(F.array_intersect(wanted, content_tokens(r, self.stopwords)), of_shared)

        def short_cuts(n: Column) -> Column:
            en, rn = n["e"], n["r"]
            negated = F.arrays_overlap(tokens(e), negations) != F.arrays_overlap(tokens(r), negations)
            contained = (en != "") & (rn != "") & (F.contains(en, rn) | F.contains(rn, en))
            return F.when(en == rn, 1.0).when(negated, 0.0).when(contained, 1.0).otherwise(let(content_tokens(e, self.stopwords), overlap))

        return let(F.struct(norm(e).alias("e"), norm(r).alias("r")), short_cuts)

    def column(self, query: Column, expected: Column, retrieved: Column) -> Column:
        return self.score(query, expected, retrieved) >= self.overlap_ratio


def token_ratio_judge(min_shared_tokens: int = 15, min_overlap_ratio: float = 0.6) -> Callable[[Column, Column, Column], Column]:
    """A judge (query, label, candidate) by the plain share of label tokens, relaxed to 3/4 if a shared one is asked for."""
    require_positive(min_shared_tokens, "min_shared_tokens")
    if not 0.0 <= min_overlap_ratio <= 1.0:
        raise ValidationError("min_overlap_ratio must lie in 0..1")

    def judge(query: Column, label: Column, candidate: Column) -> Column:
        wanted = F.array_distinct(tokens(F.coalesce(label, F.lit(""))))
        shared = F.array_intersect(wanted, tokens(F.coalesce(candidate, F.lit(""))))
        ratio = F.size(shared) / F.nullif(F.size(wanted), F.lit(0))
        asked = F.size(F.array_intersect(shared, tokens(F.coalesce(query, F.lit(""))))) > 0
        enough = (ratio >= min_overlap_ratio) | (asked & (ratio >= min_overlap_ratio * 0.75))
        return F.coalesce((F.size(shared) >= min_shared_tokens) & enough, F.lit(False))

    return judge


def default_relevance(query: Column, label: Column, candidate: Column) -> Column:
    """Equal texts; else containment, if either text has a space; else the plain share of tokens."""
    space = F.contains(label, F.lit(" ")) | F.contains(candidate, F.lit(" "))
    within = F.contains(label, candidate) | F.contains(candidate, label)
    return F.coalesce((label == candidate) | (space & within) | token_ratio_judge()(query, label, candidate), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


@dataclass(frozen=True)
class SemanticJudge(OneByOne):
    """Cosine of the texts' embeddings against a threshold; ``encode`` turns a list of texts into vectors, batch by batch."""

    encode: Callable[[list[str]], Iterable[Iterable[float]]]
    threshold: float = 0.75

    name = "semantic"

    def __post_init__(self) -> None:
        if not 0.0 <= self.threshold <= 1.0:
            raise ValidationError("threshold must lie in 0..1")

    def judged(self, contexts: DataFrame) -> DataFrame:
        encode = self.encode

        @F.pandas_udf("array<double>")
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

        similar = F.coalesce(cosine(vector("expected_text"), vector("retrieved_text")) >= self.threshold, F.lit(False))
        return contexts.withColumn("relevant", similar)


def relevance_prompt(query: Column, expected: Column, retrieved: Column) -> Column:
    """Prompt that asks a model for YES or NO."""
    return F.concat(
        F.lit("Question asked: "), query, F.lit("\nText that would answer it: "), expected, F.lit("\nText that was found: "), retrieved,
        F.lit("\nDoes the text that was found say the same as the text that would answer the question? Wording does not count. Reply YES or NO."),
    )


def parse_relevance(response: Column) -> Column:
    """A reply as a boolean: by how it begins, else by the words it holds."""
    r = F.lower(F.trim(F.coalesce(response, F.lit(""))))
    has = lambda words: F.lit(False) if not words else F.coalesce(r.rlike("|".join(words)), F.lit(False))
    good = has(["relevant", "match", "correct", "accurate", "true"])
    bad = has(["irrelevant", "mismatch", "incorrect", "inaccurate", "false"])
    return F.when(r.startswith("yes"), True).when(r.startswith("no"), False).otherwise(good & ~bad)


class CompletionProvider(Protocol):
    """What a language model must offer: one reply for a prompt."""

    def complete(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class LLMJudge(OneByOne):
    """Asks ``complete`` about each context, ``width`` prompts of a batch at a time, with ``max_retries`` tries."""

    complete: Callable[[str], str]
    width: int = 8
    max_retries: int = 3

    name: str = "llm"

    @classmethod
    def from_provider(cls, provider: str = "openai", model: str | None = None, api_key: str | None = None, temperature: float = 0.0, max_retries: int = 3, width: int = 8) -> LLMJudge:
        """A judge that asks a model of this provider; its replies are bounded to a few tokens."""
        p = make_provider(provider, model, api_key, temperature, max_retries, max_tokens=10)
        return cls(p.complete, width, max_retries, f"llm({provider}:{p.model})")

    def judged(self, contexts: DataFrame) -> DataFrame:
        complete, width, tries = self.complete, require_positive(self.width, "width"), require_positive(self.max_retries, "max_retries")

        def ask(prompt: str) -> str:
            for attempt in range(tries):
                try:
                    return complete(prompt)
                except Exception:
                    if attempt + 1 == tries:
                        raise
            return ""

        @F.pandas_udf("string")
        def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from concurrent.futures import ThreadPoolExecutor

            with ThreadPoolExecutor(width) as pool:
                for prompts in batches:
                    yield pd.Series(list(pool.map(ask, prompts)), index=prompts.index)

        asked = relevance_prompt(F.col("query"), F.col("expected_text"), F.col("retrieved_text"))
        return contexts.withColumn("relevant", parse_relevance(replies(asked)))


@dataclass(frozen=True)
class BatchJudge(OneByOne):
    """A user's judge: ``judge`` gets a pandas frame of contexts and returns one boolean a row."""

    judge: Callable[[pd.DataFrame], Iterable[bool]]
    name: str = "batch"

    def judged(self, contexts: DataFrame) -> DataFrame:
        judge = self.judge

        @F.pandas_udf("boolean")
        def run(query: pd.Series, expected_text: pd.Series, retrieved_text: pd.Series) -> pd.Series:
            return pd.Series(list(judge(pd.DataFrame({"query": query, "expected_text": expected_text, "retrieved_text": retrieved_text}))))

        return contexts.withColumn("relevant", run("query", "expected_text", "retrieved_text"))
