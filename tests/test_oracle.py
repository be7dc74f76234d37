"""Every registered query with SQL gives DuckDB's rows."""

import datetime
import math
import os

import pytest

from codeloam.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return int(v) if isinstance(v, bool) else v


@pytest.fixture(scope="module")
def db(data_dir):
    c = duckdb.connect()
    for f in os.listdir(data_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, data_dir, name):
    df = registry.queries()[name](spark, data_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want


#: Queries that SQL cannot express, with what their rows must be.
CHECKS = {
    "extracted_chunks": lambda rows: all(r["start_line"] <= r["end_line"] and r["code_hash"] and r["symbol"] and len(r["id"]) == 32 for r in rows) and {r["type"] for r in rows} <= {"function", "class", "method", "file"},
    "extracted_ranges": lambda rows: all(0 < r["start_line"] <= r["end_line"] for r in rows) and len({(r["project"], r["file"], r["symbol"], r["start_line"]) for r in rows}) == len(rows),
    "extracted_edges": lambda rows: all(r["src"] and r["dst"] for r in rows) and len({(r["project"], r["file"], r["src"], r["dst"]) for r in rows}) == len(rows),
    "embedded_chunks": lambda rows: all(len(r["vector"]) == 384 and abs(sum(x * x for x in r["vector"]) - 1) < 1e-3 for r in rows if any(r["vector"])) and len({(r["project"], r["id"]) for r in rows}) == len(rows),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_are_sound(spark, data_dir, name):
    rows = registry.queries()[name](spark, data_dir).collect()
    assert len(rows) > 20 and CHECKS[name](rows)
