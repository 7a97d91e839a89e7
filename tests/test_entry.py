import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["token_estimate", "split_paragraphs", "tfidf_scores", "prune_conversations"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_names_of_the_package():
    import sievewright

    assert all(callable(getattr(sievewright, n)) for n in sievewright.__all__)
    with pytest.raises(AttributeError):
        sievewright.nothing  # noqa: B018
