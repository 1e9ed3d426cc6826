"""Every query with SQL gives the same rows as DuckDB."""

import base64
import collections
import zlib

import duckdb
import pytest

from lodestrata import catalogue, catalogue_more  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.SQL[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    left = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    right = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert len(left) > 0 and left == right


def test_armor_lines_hold_every_byte(spark, tmp_path):
    def brute(rows):
        want = []
        for i, text in rows:
            data = (text or "").encode()
            for at in range(0, len(data), 45):
                head = f"S{at:09x}:{base64.urlsafe_b64encode(data[at : at + 45]).decode().rstrip('=')}"
                want.append((i, f"{head}:{zlib.crc32(head.encode()):08x}"))
        return collections.Counter(want)

    rows = [(1, "x" * 45), (2, "é" * 200), (3, ""), (4, None), (5, "a"), (6, "y" * 46)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), DIR):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        assert collections.Counter(map(tuple, catalogue.QUERIES["armor_lines"](spark, d).collect())) == brute(docs)


def test_references_of_odd_pages(spark, tmp_path):
    html = ["cut off &amp</title>", "?a=1&copy=2&amp;b", "&quot &quot;&#65; &lt;&nbsp;", "&amp;amp;quot; &&amp; &ampx;", "&", "", None, "none"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(catalogue.SQL["references_undone"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["references_undone"](spark, str(tmp_path)).collect())) == sorted(want)
