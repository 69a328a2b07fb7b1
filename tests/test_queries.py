"""Every query against its SQL twin, on the smallest tables; and what the rest of the library may import."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
Q, O = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if isinstance(v, int | str | bool | type(None)) else str(v)


@pytest.mark.parametrize("name", sorted(O))
def test_matches_sql(spark, db, name):
    df = Q[name](spark, SF)
    cols = sorted(df.columns)
    r = db.execute(O[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    got = [tuple(plain(x[c]) for c in cols) for x in df.collect()]
    key = lambda t: [(x is None, str(x)) for x in t]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(n for n in set(Q) - set(O) if not re.match(r"p\d_", n)))
def test_runs(spark, name):
    assert Q[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_imports_the_llm_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "narrata")
    for f in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "narrata.llm" not in open(f).read(), f
