"""The driver's contract: every core query runs, and equals its SQL on the smallest tables."""

import collections
import os

import pytest

import __spark_entry__ as entry
from opslens import queries_core, queries_ref

SMALL = "/root/testdata/sf0.001"
CORE = {**queries_core.QUERIES, **queries_ref.QUERIES}
SQL = {**queries_core.ORACLE, **queries_ref.ORACLE}
TABLES = ("artifacts", "nodes", "edges", "message_codes", "case_cards", "log_lines", "incident_updates", "documents", "benchmark", "mix_targets", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["log_path", "first_line", "last_line", "ts_sec", "severity", "code"]
    assert set(SQL) <= set(CORE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, SMALL)
    rows = df.collect()
    if name not in SQL:
        return
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    want = collections.Counter(tuple(repr(near(x[names.index(c)])) for c in df.columns) for x in res.fetchall())
    got = collections.Counter(tuple(repr(near(v)) for v in r) for r in rows)
    assert got == want
