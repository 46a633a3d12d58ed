"""Every registered query against its SQL, and the package without its optional part."""

import decimal
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessellum import queries

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    assert got
    if name in queries.ORACLES:
        r = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(x[names.index(c)]) for c in columns]) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.QUERIES) <= set(e.queries())


def test_entry_without_the_optional_part(tmp_path):
    """A copy of the repository without the training-data operators still imports and lists its other queries."""
    for p in ("tessellum", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tessellum" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('tessellum.queries').queries.QUERIES))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
