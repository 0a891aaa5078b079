"""Every query with SQL against DuckDB over the tables that the driver compares, the others for shape."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from webgrain.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in data), key=repr)
    got, exp = rows(df.collect(), df.columns), rows(want.fetchall(), names)
    assert len(got) == len(exp)
    assert got == exp


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) > 0


def test_every_sql_has_its_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_structured_extract_reads_references_as_its_sql_does(spark, tmp_path):
    """Titles that were cut off within a reference."""
    titles = ["and&amp", "a&amp;b", "x &am", "y &", "&quot;q&quot", "&copy 2 &copy; &middot;", "&ampx;", "AT&T", "a&amp;amp"]
    page = "<html><head><title>{0}</title></head><body><script>a && b</script><!-- & --><article><h1>{0}</h1><p>{0}</p></article><footer>&copy; site.example.com 2024</footer></body></html>"
    rows = [(n, "https://a.example.com/", page.format(t)) for n, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(catalog.SQL["structured_extract"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["structured_extract"](spark, str(tmp_path)).collect())) == sorted(want)


def test_references_without_a_semicolon_are_read_as_html_does():
    from webgrain.html.dom import parse

    page = "<title>and&amp</title><script>a && b</script><a title='R&ampD'>&copy;</a>"
    assert parse(page).text() == "and&a && b©"
    assert parse(page, bare_references=False).text() == "and&ampa && b©"
