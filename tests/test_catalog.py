"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from veilspan.operators import evaluation
from veilspan.plans import catalog, fixtures

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(repr(tuple(int(v) if isinstance(v, float) and v == int(v) else round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    assert values(catalog.queries()[name](spark, str(DATA)).toPandas()) == values(c.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_every_row_feeds_the_queries(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    n = read("documents").count()
    assert {r.texts for r in catalog.queries()["overlap_retention"](spark, str(DATA)).collect()} == {n}
    assert catalog.queries()["overlap_regions"](spark, str(DATA)).select("doc_id").distinct().count() == n
    assert catalog.queries()["fidelity_division"](spark, str(DATA)).count() == read("events").selectExpr("event_id % 900").distinct().count()
    assert fixtures.frame(spark, str(DATA), "releases").count() == n


def test_escapes_pass_where_nothing_got_out(spark):
    planted = spark.createDataFrame([(1, "hidden", "SECRET", "PERSON"), (1, "shown", "SECRET", "PERSON")], "case_id int, value string, sensitivity string, semantic_type string")
    releases = spark.createDataFrame([(1, "a", "all is shown"), (1, "b", "nothing")], "case_id int, sink_id string, body string")
    assert sorted(tuple(r) for r in evaluation.escapes(planted, releases).collect()) == [(1, "a", 2, 1, "fail"), (1, "b", 2, 0, "pass")]
