"""Generated evaluation examples: prompts, parsing of responses, validation, de-duplication, conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrikon.functions.text import collapse, norm, strip
from metrikon.operators.chunk import ChunkingConfig, chunk_documents
from metrikon.operators.order import numbered
from metrikon.operators.providers import make_provider
from metrikon.schema import require_positive

# The categories of examples; the last is answered by nothing.
ANSWERABLE = ("direct_fact", "paraphrase", "keyword_search", "specific_detail", "broad_summary")
UNANSWERABLE = "out_of_context"
ITEM = "array<struct<category:string,query_text:string,expected_answer:string>>"


def prompt(doc_id: Column, metadata: Column, text: Column, num_examples: int = 6) -> Column:
    """Prompt that asks for ``num_examples`` questions on one chunk, metadata with sorted keys."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))
    ask = (
        f"\n\nWrite {require_positive(num_examples, 'num_examples')} questions that test whether a search system finds the passage above. "
        f"Spread them over these kinds: {', '.join(ANSWERABLE)}, {UNANSWERABLE}. Copy each answer word for word from the passage; "
        f"a question of kind {UNANSWERABLE} fits the subject, is not answered by the passage and has an empty answer. "
        'Reply with nothing but a JSON array of objects with the fields "category", "query_text" and "expected_answer".'
    )
    return F.concat(F.lit("Passage id: "), doc_id, F.lit("\nMetadata: "), F.coalesce(ordered, F.lit("{}")), F.lit("\nPassage:\n"), text, F.lit(ask))


def unfenced(response: Column) -> Column:
    """The response without code fences around it."""
    r = strip(F.coalesce(response, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(r, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(r.startswith("```"), bare).otherwise(r)


def parse_items(response: Column, strict: bool = True) -> Column:
    """The array of items in a response; a blank response is an empty array.

    Anything but a JSON array is an error, or null if ``strict`` is off. A text that goes on behind the array
    is no array, hence the check of its end.
    """
    r = unfenced(response)
    ok = r.startswith("[") & r.endswith("]") & F.try_parse_json(r).isNotNull()
    bad = F.raise_error(F.lit("the response must be a JSON array")) if strict else F.lit(None)
    return F.when(r == "", F.array().cast(ITEM)).when(ok, F.from_json(r, ITEM)).otherwise(bad.cast(ITEM))


def valid_items(items: DataFrame) -> DataFrame:
    """Rows (chunk_id, chunk_text, item_pos, category, query_text, expected_answer) that hold, with context and gold ids.

    Kept are items of a known category with a question; an unanswerable one has a blank answer, any other an
    answer that the chunk contains, white space and case aside. Nulls count as blank.
    """
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    t = items.withColumns({c: text(c) for c in ("category", "query_text", "expected_answer")})
    blank, none = F.col("expected_answer") == "", F.col("category") == UNANSWERABLE
    held = F.contains(norm(F.coalesce("chunk_text", F.lit(""))), norm(F.col("expected_answer")))
    t = t.where((F.col("query_text") != "") & ((none & blank) | (F.col("category").isin(*ANSWERABLE) & ~blank & held)))
    gold = F.when(none, F.array().cast("array<string>")).otherwise(F.array("chunk_id"))
    return t.withColumn("expected_context", F.when(none, "").otherwise(F.col("chunk_text"))).withColumn("expected_doc_ids", gold)


def first_of_query(items: DataFrame, order: tuple[str, str] = ("chunk_pos", "item_pos")) -> DataFrame:
    """The first item of each question (white space and case aside), with ids q1, q2, ... in global order."""
    w = Window.partitionBy("_key").orderBy(*order)
    first = items.withColumn("_key", norm(F.col("query_text"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")
    return numbered(first, list(order), "_n").withColumn("query_id", F.concat(F.lit("q"), F.col("_n").cast("string"))).drop("_n")


def examples_of(responses: DataFrame, strict: bool = True) -> DataFrame:
    """EXAMPLES rows from (chunk_pos, chunk_id, chunk_text, response)."""
    items = responses.select("chunk_pos", "chunk_id", "chunk_text", F.posexplode(parse_items(F.col("response"), strict)).alias("item_pos", "i"))
    flat = items.select("chunk_pos", "chunk_id", "chunk_text", "item_pos", "i.category", "i.query_text", "i.expected_answer")
    return first_of_query(valid_items(flat)).select("query_id", "query_text", "category", "expected_answer", "expected_context", "expected_doc_ids")


def query_examples(examples: DataFrame) -> DataFrame:
    """Examples as evaluation queries: gold answers as lists, an empty one for a blank answer."""
    answers = F.when(F.coalesce(strip(F.col("expected_answer")), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("expected_answer"))
    return examples.select("query_id", "query_text", F.coalesce("expected_doc_ids", F.array().cast("array<string>")).alias("expected_doc_ids"), answers.alias("expected_answers"))


def document_examples(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "text", "metadata")


def dataset_dict(examples: DataFrame, chunks: DataFrame) -> dict[str, list[dict[str, object]]]:
    """A generated dataset as one dict of lists, for JSON: it comes to the driver, as a file of it would."""
    q = query_examples(examples).join(examples.select("query_id", "category", "expected_context"), "query_id")
    queries = [{c: r[c] for c in ("query_id", "query_text", "expected_answers", "category", "expected_context", "expected_doc_ids")} for r in q.collect()]
    documents = [{"doc_id": r["doc_id"], "text": r["text"], "metadata": dict(r["metadata"] or {})} for r in document_examples(chunks).collect()]
    return {"queries": sorted(queries, key=lambda x: (len(x["query_id"]), x["query_id"])), "documents": documents}


class DatasetGenerator:
    """Chunks -> prompts -> completions -> validated, de-duplicated examples. ``complete`` maps a prompt to a response."""

    def __init__(self, complete: Callable[[str], str], *, chunking: ChunkingConfig | None = None, examples_per_chunk: int = 6, show_progress: bool = True) -> None:
        self.complete = complete
        self.chunking = chunking or ChunkingConfig()
        self.examples_per_chunk = require_positive(examples_per_chunk, "examples_per_chunk")
        self.show_progress = show_progress
        self._answered = None

    @classmethod
    def from_provider(cls, provider: str, *, model: str | None = None, api_key: str | None = None, temperature: float = 0.2, max_retries: int = 3, **options: object) -> DatasetGenerator:
        """A generator that asks a model of this provider; ``options`` are those of the constructor."""
        return cls(make_provider(provider, model, api_key, temperature, max_retries, max_tokens=4096).complete, **options)

    @property
    def answered(self) -> int:
        """Chunks answered so far, those of tasks that were tried again counted again; 0 without ``show_progress``."""
        return self._answered.value if self._answered is not None else 0

    def generate(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(examples, chunks). The model is called once a chunk, on the executors."""
        chunks = chunk_documents(sources, self.chunking)
        asked = chunks.withColumn("prompt", prompt(F.col("doc_id"), F.col("metadata"), F.col("text"), self.examples_per_chunk))
        complete = self.complete
        done = self._answered = sources.sparkSession.sparkContext.accumulator(0) if self.show_progress else None

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[["chunk_pos", "chunk_id", "chunk_text"]].assign(response=[complete(p) for p in b["prompt"]])
                if done is not None:
                    done.add(len(b))

        rows = asked.select(F.struct("doc_index", "chunk_index").alias("k"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), "prompt")
        placed = numbered(rows.select(F.col("k.doc_index").alias("a"), F.col("k.chunk_index").alias("b"), "chunk_id", "chunk_text", "prompt"), ["a", "b"], "chunk_pos")
        responses = placed.select("chunk_pos", "chunk_id", "chunk_text", "prompt").mapInPandas(answer, "chunk_pos long, chunk_id string, chunk_text string, response string")
        return examples_of(responses), chunks
