"""Every query of the core that has SQL, against that SQL on the smallest tables; and what the entry module promises."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from palimpsest.plans import registry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int) or hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, tables, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = tables.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0


def test_core_needs_no_optional_part():
    """The core is importable, and lists its queries, without the subpackage of the training-data operators."""
    code = "import sys; sys.modules['palimpsest.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_does_not_mention_it():
    for f in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "palimpsest").parts:
            assert "palimpsest.llm" not in f.read_text()
