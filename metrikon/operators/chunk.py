"""Structure-aware chunking: sections, greedy packing, overlap, stable ids, merging of short chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrikon.functions.text import collapse, falsy_or, let, strip, uuid5, word_count, words
from metrikon.operators.order import numbered
from metrikon.schema import ValidationError

NO_TEXTS = "array<string>"
HEADING = r"(?U)(?m)^(?=#{1,6}[^\S\n]+[^\n])"
HEAD_LINE = r"(?U)^(#{1,6})[^\S\n]+([^\n]+)\n?"


@dataclass(frozen=True)
class ChunkingConfig:
    """Sizes in words."""

    target_min_tokens: int = 250
    target_max_tokens: int = 450
    max_tokens: int = 700
    overlap_tokens: int = 60
    min_tokens: int = 80

    def __post_init__(self) -> None:
        if min(self.target_min_tokens, self.target_max_tokens, self.max_tokens, self.min_tokens) <= 0:
            raise ValidationError("sizes must be greater than 0")
        if self.target_min_tokens > self.target_max_tokens:
            raise ValidationError("target_min_tokens must not exceed target_max_tokens")
        if self.target_max_tokens > self.max_tokens:
            raise ValidationError("target_max_tokens must not exceed max_tokens")
        if self.overlap_tokens < 0:
            raise ValidationError("overlap_tokens must not be negative")
        if self.overlap_tokens >= self.max_tokens:
            raise ValidationError("overlap_tokens must be less than max_tokens")


def empty_texts() -> Column:
    return F.array().cast(NO_TEXTS)


def sections(text: Column) -> Column:
    """array<struct<path, body>>: the text under each heading with the headings above it.

    A heading of level n keeps the first n - 1 headings of the path before it. A text of headings only is one
    section with the whole text and no path. Blank sections are left out.
    """
    lines = strip(F.regexp_replace(text, r"\R|[\x1c-\x1e]", "\n"))
    parts = F.split(lines, HEADING)
    zero = F.struct(empty_texts().alias("path"), F.array().cast("array<struct<path:array<string>,body:string>>").alias("out"), F.lit(False).alias("any"))

    def step(s: Column, part: Column) -> Column:
        level = F.length(F.regexp_extract(part, HEAD_LINE, 1))
        title = strip(F.regexp_extract(part, HEAD_LINE, 2))
        path = F.when(level > 0, F.concat(F.slice(s["path"], F.lit(1), level - 1), F.array(title))).otherwise(s["path"])
        rest = F.regexp_replace(part, HEAD_LINE, "")
        body = strip(rest)
        out = F.when(body != "", F.array_append(s["out"], F.struct(path.alias("path"), body.alias("body")))).otherwise(s["out"])
        return F.struct(path.alias("path"), out.alias("out"), (s["any"] | (rest != "")).alias("any"))

    whole = F.array(F.struct(empty_texts().alias("path"), strip(text).alias("body")))
    return F.aggregate(parts, zero, step, lambda s: F.when(s["any"], s["out"]).otherwise(whole))


def pack(parts: Column, limit: int, glue: str) -> Column:
    """Consecutive parts joined by ``glue`` as long as a group has at most ``limit`` words; a longer part stands alone."""
    zero = F.struct(F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"), empty_texts().alias("out"))

    def step(s: Column, x: Column) -> Column:
        p, n = x["p"], x["n"]
        fits = s["cur"].isNull() | (s["n"] + n <= limit)
        cur = F.when(s["cur"].isNull(), p).when(fits, F.concat(s["cur"], F.lit(glue), p)).otherwise(p)
        total = F.when(s["cur"].isNotNull() & fits, s["n"] + n).otherwise(n)
        out = F.when(fits, s["out"]).otherwise(F.array_append(s["out"], s["cur"]))
        return F.struct(cur.alias("cur"), total.alias("n"), out.alias("out"))

    counted = F.transform(parts, lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))
    return F.aggregate(counted, zero, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def pieces_of(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Word windows of ``size``, each ``size - overlap`` words further (at least one); the last may lie within the one before."""
    def cut(t: Column) -> Column:
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t), F.lit(max(size - overlap, 1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))

    return let(words(text), cut)


def sentences(text: Column, config: ChunkingConfig) -> Column:
    """Packed sentences; a piece beyond ``max_tokens`` becomes word windows."""
    packed = pack(pieces_of(text, r"(?U)(?<=[.!?])\s+"), config.target_max_tokens, " ")
    cut = F.transform(packed, lambda s: F.when(word_count(s) <= config.max_tokens, F.array(s)).otherwise(windows(s, config.target_max_tokens, config.overlap_tokens)))
    return F.flatten(cut)


def overlapped(chunks: Column, overlap: int) -> Column:
    """Each chunk after the first with the last ``overlap`` words of the one before in front, unless it begins with them."""
    if overlap == 0:
        return chunks

    def tail(c: Column) -> Column:
        return let(words(c), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - overlap + 1), F.lit(overlap)), " "))

    def joined(c: Column, before: Column) -> Column:
        return F.when((before != "") & ~F.startswith(c, before), F.concat(before, F.lit("\n\n"), c)).otherwise(c)

    def add(every: Column) -> Column:
        return F.transform(every, lambda c, i: F.when(i > 0, let(tail(F.get(every, i - 1)), lambda before: joined(c, before))).otherwise(c))

    return let(chunks, add)


def section_chunks(body: Column, config: ChunkingConfig) -> Column:
    """A section of up to ``max_tokens`` as it is; a longer one as packed paragraphs with overlap."""
    groups = pack(pieces_of(body, r"(?U)\n\s*\n"), config.target_max_tokens, "\n\n")
    cut = F.flatten(F.transform(groups, lambda g: F.when(word_count(g) <= config.max_tokens, F.array(g)).otherwise(sentences(g, config))))
    return F.when(word_count(body) <= config.max_tokens, F.array(body)).otherwise(overlapped(cut, config.overlap_tokens))


def source_name(source: Column) -> Column:
    """Last part of a path, of either kind; with both kinds of slash only the POSIX one counts."""
    s = strip(source)
    posix = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(s, "/"), lambda p: ~p.isin("", "."))), -1)
    windows_ = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(F.regexp_replace(s, "^[A-Za-z]:", ""), r"\\"), lambda p: ~p.isin("", "."))), -1)
    return F.when(F.contains(s, F.lit("/")), posix).when(F.contains(s, F.lit("\\")), windows_).otherwise(s)


def chunk_id(source: Column, doc_index: Column, chunk_index: Column, text: Column) -> Column:
    """Stable id from the source's name, both positions and the text with white space collapsed."""
    name = F.coalesce(falsy_or(source_name(source)), F.concat(F.lit("document_"), doc_index.cast("string")))
    return uuid5(F.concat_ws("\n", name, doc_index.cast("string"), chunk_index.cast("string"), collapse(text)))


def chunk_rows(sources: DataFrame, config: ChunkingConfig | None = None, blank: str = "error") -> DataFrame:
    """(doc_index, chunk_index, doc_id, text, source, heading_path, metadata) before merging, chunk_index from 0 a document.

    A null source, which is that of a text given alone, is named by its position. A null or blank text and a blank
    source are errors; with ``blank="skip"`` such texts give no chunk and such sources are named by position too.
    Each row of ``sources`` is one document, so ``doc_index`` must tell them apart.
    """
    if blank not in ("error", "skip"):
        raise ValidationError("blank must be error or skip")
    config = config or ChunkingConfig()
    source = F.coalesce(falsy_or(strip(F.col("source"))), F.concat(F.lit("document_"), F.col("doc_index").cast("string")))
    if blank == "error":
        fail = lambda what: F.raise_error(F.concat(F.lit(f"{what} must not be blank, document "), F.col("doc_index").cast("string"))).cast("string")
        source = F.when(strip(F.col("source")) == "", fail("source")).otherwise(source)
        told = F.when(F.coalesce(strip(F.col("text")), F.lit("")) == "", fail("text")).otherwise(F.col("text"))
        sources = sources.withColumn("text", told)
    found = F.flatten(F.transform(sections(F.col("text")), lambda s: F.transform(section_chunks(s["body"], config), lambda c: F.struct(s["path"].alias("path"), c.alias("text")))))
    base = sources.where(strip(F.col("text")) != "").select("doc_index", source.alias("source"), "metadata", F.posexplode(F.filter(found, lambda c: strip(c["text"]) != "")).alias("chunk_index", "c"))
    rows = base.select("doc_index", "chunk_index", chunk_id(F.col("source"), F.col("doc_index"), F.col("chunk_index"), F.col("c.text")).alias("doc_id"), F.col("c.text").alias("text"), "source", F.col("c.path").alias("heading_path"), "metadata")
    own = F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("source"), F.col("source"), F.lit("heading_path"), F.to_json("heading_path"), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    reserved = ("doc_id", "source", "heading_path", "chunk_index")
    user = F.coalesce(F.map_filter("metadata", lambda k, _: ~k.isin(*reserved)), F.create_map().cast("map<string,string>"))
    return rows.withColumn("metadata", F.map_concat(user, own))


def merge_short(chunks: DataFrame, config: ChunkingConfig | None = None, order: tuple[str, str] = ("doc_index", "chunk_index")) -> DataFrame:
    """Chunks under ``min_tokens`` go into the one before of the same source and path, up to ``max_tokens`` together.

    A left fold in the order of all chunks. Only short chunks merge, so the fold is cut before every other
    chunk and wherever source or path changes: what is left are short runs, each folded on its own.
    """
    config = config or ChunkingConfig()
    placed = numbered(chunks.withColumn("n", word_count(F.col("text"))), list(order), "at")
    before = placed.select((F.col("at") + 1).alias("at"), F.col("source").alias("s0"), F.col("heading_path").alias("p0"))
    linked = placed.join(before, "at", "left")
    same = F.coalesce((F.col("source") == F.col("s0")) & (F.col("heading_path") == F.col("p0")), F.lit(False))
    runs = numbered(linked.withColumn("cut", F.when(same & (F.col("n") < config.min_tokens), 0).otherwise(1)).drop("s0", "p0"), ["at"], "run", "cut")
    one = F.struct("at", "n", *[c for c in chunks.columns])
    by_place = lambda a, b: (a["at"] - b["at"]).cast("int")
    groups = runs.groupBy("run").agg(F.array_sort(F.collect_list(one), by_place).alias("c"))
    kind = groups.schema["c"].dataType.simpleString()

    def step(out: Column, c: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (c["n"] < config.min_tokens) & (F.try_element_at(out, F.lit(-1))["n"] + c["n"] <= config.max_tokens)
        merged = last.withField("text", strip(F.concat(last["text"], F.lit("\n\n"), c["text"]))).withField("n", last["n"] + c["n"])
        return F.when(joins, F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), merged)).otherwise(F.array_append(out, c))

    folded = groups.select(F.explode(F.aggregate("c", F.array().cast(kind), step)).alias("c"))
    return folded.select(*(F.col(f"c.{c}").alias(c) for c in chunks.columns))


def chunk_documents(sources: DataFrame, config: ChunkingConfig | None = None, blank: str = "error") -> DataFrame:
    """The chunks of all documents, short ones merged; see ``chunk_rows`` and ``merge_short``."""
    return merge_short(chunk_rows(sources, config, blank), config)


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 0) -> DataFrame:
    """(id_col, window_index, text): plain word windows of each text; null and blank texts give none."""
    return df.select(id_col, F.posexplode(windows(F.coalesce(F.col(text_col), F.lit("")), size, overlap)).alias("window_index", "text"))
