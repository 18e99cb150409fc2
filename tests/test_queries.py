"""Every registered query with SQL against DuckDB on the smallest tables, where they are present."""

import ast
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    got = entry.queries()[name](spark, str(DATA))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_theta_emission_has_the_whole_panel(spark):
    got = entry.queries()["haploid_emission_theta_panel"](spark, str(DATA))
    assert got.select("hap_idx").distinct().count() == 32


def test_the_rest_stands_alone():
    """Nothing outside the text operators imports them, but for the guarded entry."""
    root = Path(entry.__file__).parent
    for p in (root / "haploframe").rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            names += [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any({"llm", "corpus_pipeline"} & set(n.split(".")) for n in names), p
