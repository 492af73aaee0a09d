"""Study queries against their SQL on the test tables."""

import math

import duckdb
import pytest

from depscape import study_queries
from depscape.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == study_queries.__name__ and n in ORACLE)


def _plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert got == want and got
