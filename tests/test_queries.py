"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quietspan.plans import qa_queries, registry  # noqa: F401 - adds its queries


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    if name in registry.SQL:
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert got == sorted(map(repr, db.sql(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall()))
    assert got or name == "shadow_diff"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def against_sql(spark, folder, name, table, rows, schema):
    """A query over one small table, and its SQL over the same."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    return sorted(map(repr, map(tuple, df.select(*columns).collect()))), sorted(map(repr, con.sql(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall()))


def test_html_text_reads_no_reference_without_semicolon(spark, tmp_path):
    pages = ["<h1>a&amp</h1>b&amp;&lt;c", "<p>x &am</p>&amp", "<p>&lt&gt;</p>&copy 1", "<p>&ampx; &#39 &#39;</p>&", "<!-- &amp --><p>&&amp;amp</p>"]
    got, want = against_sql(spark, tmp_path, "html_text", "pages", [(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    assert got == want and any("a&amp" in r for r in got)


def test_line_endings_where_a_return_meets_a_feed(spark, tmp_path):
    texts = ["x a\ny", " a a\n\n a", "a\r\nb\rc\n", "\n\n", "\r a\r\n", "", None]
    got, want = against_sql(spark, tmp_path, "line_endings", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want
