"""Every query with SQL against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from graupel.plans import layer_queries, point_queries, queries  # noqa: F401  all register
from graupel.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(frame):
    cols = sorted(frame.columns)
    def norm(v):
        if v is None or v != v or str(v) in ("NaT", "<NA>"):
            return ""
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            try:
                return f"{float(v):.9g}"
            except (TypeError, ValueError):
                pass
        return str(v)[:19].removesuffix(" 00:00:00")
    return cols, sorted(tuple(map(norm, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    assert _rows(QUERIES[name](spark, DATA).toPandas()) == _rows(tables.execute(SQL[name]).df())
