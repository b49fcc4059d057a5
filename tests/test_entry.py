"""Every query with SQL against DuckDB on the smallest tables, and the shape of the entry module."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402

TABLES = "api_snapshot type_decl exec_decl field_decl bc_report api_json known_type documents test_item doc_label".split()
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = Counter(str(tuple(r)) for r in df.select(*cols).collect())
    assert got == Counter(str(r) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["lib", "ver", "fqn", "change"] and df.count() > 0


def test_nothing_else_imports_the_text_operators(tmp_path):
    code = (
        "import sys; sys.modules['evolvent.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p6_ids' not in q, sorted(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
