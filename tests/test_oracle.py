"""Every registered query with an oracle matches DuckDB at sf0.001."""
import pytest

import __spark_entry__ as E
from tools.oracle_check import canon
from paths import SF_SMALL

#: Fits of every model on the prepared table: minutes each, checked by tools/oracle_check.py.
SLOW = ("e_classifiers_", "e_regressors_", "f5_every_")
SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith((*SLOW, "op"))))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    c1, r1 = canon(got)
    c2, r2 = canon(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "precision" in df.columns
