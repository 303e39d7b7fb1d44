"""What SQL can tell of the corpus queries is what DuckDB tells."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from pagegauge.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, DATA)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall())
    assert Counter(tuple(r[c] for c in sorted(columns)) for r in df.collect()) == want
