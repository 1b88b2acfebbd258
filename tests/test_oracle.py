"""Every registered query of history against its SQL on DuckDB, over the same files."""

import math
from pathlib import Path

import duckdb
import pytest

from waymark.plans import catalog, edits, ledger, library, shown  # noqa: F401  register their queries too

SF = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(x[i]) for i in order) for x in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    got = rows(df.columns, df.collect())
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, want.fetchall())
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.SQL])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0
