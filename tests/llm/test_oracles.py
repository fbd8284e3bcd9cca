"""The numbered queries against their SQL, and the SQL's own patterns."""

import re

import duckdb
import pytest

from cinderframe.llm import licenses, oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_is_the_sql(spark, duck, name):
    b = duck.sql(oracles.oracle_sql()[name]).df()
    a = queries.queries()[name](spark, SF).toPandas()
    key, names = b.columns[0], list(b.columns)
    assert sorted(a.columns) == sorted(names) and len(a) == len(b) > 0
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (a, b))
    for n in names:
        assert ((a[n] == b[n]) | (a[n].isna() & b[n].isna())).all(), n


def test_registered():
    assert oracles.oracle_sql().keys() <= queries.queries().keys() and queries.oracle_sql() == oracles.oracle_sql()


def test_patterns():
    p = re.compile(" " + oracles.pattern("keep [[ this | that <<1>> ]] wording <<2>> exact"))
    for text, fits in (("keep wording x exact", True), ("keep that one wording x exact", True), ("keep that wording x exact", False), ("keep wording exact", False)):
        assert bool(p.search(f" {text} ")) == fits == licenses.Automaton("keep [[ this | that <<1>> ]] wording <<2>> exact").holds(text.split())
