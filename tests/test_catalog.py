"""Every query that has SQL, against it, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from murmurate.plans.catalog import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("MURMURATE_TESTDATA", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    """A value as (kind, text): null, booleans, numbers and texts are never equal to each other."""
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return ("number", "nan" if math.isnan(v) else f"{float(v):.5f}")
    if isinstance(v, (list, tuple)):
        return ("list", str([_plain(x) for x in v]))
    return (type(v).__name__, str(v))


@pytest.mark.parametrize(("one", "other"), [(None, "null"), (None, "nan"), (None, ""), (True, "True"), (True, 1), (1, "1.00000"), (float("nan"), None)])
def test_the_comparison_tells_kinds_apart(one, other):
    assert _plain(one) != _plain(other) and _plain(one) == _plain(one)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect())
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(map(_plain, r)) for r in want)
