"""Every registered query against its SQL at the smallest scale."""

import math
from collections import Counter

import pytest

from gridwitness.plans import records, registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 9)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), Counter(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


def duck(sql):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con.sql(sql).df()


QUERIES, ORACLES = registry.QUERIES | records.QUERIES, registry.ORACLES | records.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert rows(got.toPandas()) == rows(duck(ORACLES[name]))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and not set(registry.QUERIES) & set(records.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["server_id", "dimension", "x", "z", "status", "state_digest", "id", "observed_at", "contributors"]


def test_the_library_stands_without_the_corpus_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    from .conftest import ROOT

    for gone in (("gridwitness/llm",), ("gridwitness/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
        for name in gone:
            path = copy / name
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                os.remove(path)
        code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*sorted(e.queries()))"
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
        assert said.stdout.split() == sorted(QUERIES)
