"""Every registered query over the smallest tables, against its SQL where it has one."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from trailspark.plans import registry

TABLES = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(TABLES).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def table(names, rows):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, TABLES)
    got = table(df.columns, df.collect())
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name])
        assert got == table([d[0] for d in want.description], want.fetchall())


def test_every_sql_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_the_registry_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT, check=True, timeout=120)


def test_the_library_stands_without_its_optional_subpackage():
    for f in (ROOT / "trailspark").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
