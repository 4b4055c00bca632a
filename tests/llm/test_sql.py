"""The operators that SQL can state against that SQL in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

pytest.importorskip("folioflow.llm")

from folioflow.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    want = Counter(map(plain, found.fetchall()))
    frame = QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(names)
    assert Counter(plain(r) for r in frame.select(*names).collect()) == want and want
