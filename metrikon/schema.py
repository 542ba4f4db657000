"""Canonical schemas, errors and argument checks.

Long tables: queries(query_id, query_text, expected_doc_ids, expected_answers), documents(doc_id, text, metadata),
run(query_id, rank, doc_id, score), qrels(query_id, doc_id, grade). Rank is list position from 1, never score.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())
_M = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


QUERIES = _struct(query_id=_S, query_text=_S, expected_doc_ids=_A, expected_answers=_A, query_pos=T.LongType())
DOCUMENTS = _struct(doc_id=_S, text=_S, metadata=_M, doc_pos=T.LongType())
RUN = _struct(query_id=_S, rank=T.IntegerType(), doc_id=_S, score=T.DoubleType(), metadata=_M)
QRELS = _struct(query_id=_S, doc_id=_S, grade=T.DoubleType())
SOURCES = _struct(doc_index=T.IntegerType(), text=_S, source=_S, metadata=_M)
CHUNKS = _struct(doc_id=_S, text=_S, source=_S, heading_path=_A, chunk_index=T.IntegerType(), metadata=_M)
EXAMPLES = _struct(query_id=_S, query_text=_S, category=_S, expected_answer=_S, expected_context=_S, expected_doc_ids=_A)


class MetrikonError(Exception):
    """Base of this library's errors."""


class ValidationError(MetrikonError, ValueError):
    """Bad argument or bad input data."""


class MissingDependencyError(MetrikonError, ImportError):
    """An optional package is not installed."""


def require_text(value: object, name: str) -> str:
    """``value`` as stripped text; blank or None is an error."""
    text = "" if value is None else str(value).strip()
    if not text:
        raise ValidationError(f"{name} must not be blank")
    return text


def require_positive(value: object, name: str) -> int:
    """``value`` as an int above 0; the text "5" counts."""
    try:
        number = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError) as e:
        raise ValidationError(f"{name} must be an integer") from e
    if number <= 0:
        raise ValidationError(f"{name} must be greater than 0")
    return number


def require_file(path: str | os.PathLike) -> str:
    if not os.path.isfile(path):
        raise ValidationError(f"no such file: {path}")
    return os.fspath(path)


def parent_made(path: str | os.PathLike) -> str:
    """``path`` after making its folder."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return os.fspath(path)


def unique_texts(values: Iterable[object]) -> list[str]:
    """Stripped, non-blank values, each once, in order of first appearance."""
    return list(dict.fromkeys(t for v in values if v is not None and (t := str(v).strip())))


def grades(values: Mapping[object, object]) -> dict[str, int]:
    """Grades by stripped id; blank ids are dropped."""
    return {t: int(v) for k, v in values.items() if (t := str(k).strip())}  # type: ignore[call-overload]


def repeated(values: Iterable[str]) -> set[str]:
    """Values seen more than once."""
    return {v for v, n in Counter(values).items() if n > 1}
