"""Every registered query with SQL gives the rows that DuckDB gives."""

import datetime as dt
import math
import os
from pathlib import Path

import duckdb
import pytest

from docloom.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("DOCLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = rows(columns, found.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert [r for r in zip(got, want) if r[0] != r[1]][:3] == []


def test_without_sql():
    """These have no SQL; test_dedup, test_spans, test_search, test_stateful and
    test_stems compare them with a plain loop over the whole table."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"J16_greedy_dedup", "X15_spans_without_overlap", "R05_cell_recall", "D01_lease_stream", "F05_region_stems"}
