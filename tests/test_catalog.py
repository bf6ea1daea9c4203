"""Every registered query of the content engine against its SQL on the smallest tables."""

import datetime
import decimal
import re

import duckdb
import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


#: Queries whose sums and roundings need more rows than the smallest tables have.
LARGER = ("article_scores", "content_quality", "event_ranking", "fulltext_quality", "greedy_clusters", "rebalance_pairs", "rule_scores", "signature_pairs")


@pytest.fixture(scope="module")
def duck():
    def opened(sf):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return con

    known = {}
    return lambda sf: known.setdefault(sf, opened(sf))


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize(("name", "sf"), [*((n, SF) for n in sorted(registry.ORACLE)), *((n, "/root/testdata/sf0.01") for n in LARGER)])
def test_query_equals_sql(spark, duck, name, sf):
    df = registry.QUERIES[name](spark, sf)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck(sf).execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert got == want


def test_docstrings_name_no_operator_that_is_not_built():
    named = {code for f in registry.QUERIES.values() for code in re.findall(r"\b[A-Z][0-9]{2}\b", f.__doc__ or "")}
    assert named and named.isdisjoint({"V21", "F10", "A03", "A36"})


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    """What they compute is held against plain models in test_eventing and test_reading."""
    assert registry.QUERIES[name](spark, SF).count() > 0
