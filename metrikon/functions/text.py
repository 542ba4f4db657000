"""Text primitives as Column expressions, with Unicode's white space everywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Words without content.
STOPWORDS = (
    "a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by "
    "can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further "
    "had hadn hadn't has hasn hasn't have haven haven't having he her here hers herself him himself his how "
    "i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now "
    "o of off on once only or other our ours ourselves out over own re s same shan shan't she she's should should've shouldn shouldn't so some such "
    "t than that that'll the their theirs them themselves then there these they this those through to too under until up ve very "
    "was wasn wasn't we were weren weren't what when where which while who whom why will with won won't wouldn wouldn't "
    "y you you'd you'll you're you've your yours yourself yourselves"
).split()
# Words that negate.
NEGATIONS = "no not never none without cannot can't".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def collapse(c: Column) -> Column:
    """Stripped, runs of white space as one space; case is kept."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def norm(c: Column) -> Column:
    """Stripped, lower-cased, runs of white space as one space."""
    return collapse(F.lower(c))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def words(c: Column) -> Column:
    """The text cut at white space."""
    return F.filter(F.split(c, SPACES), lambda t: t != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def literal_texts(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def content_tokens(c: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Tokens without stopwords, in order, repeated ones kept."""
    stop = list(stopwords)
    return F.filter(tokens(c), lambda t: ~t.isin(stop)) if stop else tokens(c)


def distinct_texts(a: Column) -> Column:
    """Stripped, non-blank elements, each once, first wins; a null array gives an empty one."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(a, strip), lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def falsy_or(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """UUID version 5 of ``name`` in ``namespace`` (hex; the default is that of URLs)."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
