import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
SKIP_PREFIX = tuple(f"p{i}_" for i in (1, 3, 4, 5, 6, 7, 8))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(SKIP_PREFIX)])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    found = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [cols.index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", ["chunk_documents"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_core_without_llm():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "metrikon"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            names = [n for node in ast.walk(ast.parse(path.read_text())) for n in ([a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else [])]
            assert not any(n.startswith("metrikon.llm") for n in names), path
