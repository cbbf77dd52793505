import math

import duckdb
import pytest

import __spark_entry__ as entry
from gapweave.functions.text import osa_distance
from gapweave.plans import from_source, kernels  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    got = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries()) and kernels.QUERIES


def test_osa():
    assert [osa_distance(*x) for x in (("", "ab"), ("ab", "ba"), ("ca", "abc"), ("fix", "fxi"), ("check", "chekc"))] == [2, 1, 3, 1, 1]
