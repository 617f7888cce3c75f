"""Registered text queries on the smallest tables: SQL where there is some, brute force or an invariant elsewhere."""

import collections
import html
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from meterloom.llm.common import table
from meterloom.llm.queries import QUERIES, SQL
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    assert sorted(columns) == sorted(df.columns) and rows_of(df.columns, df.collect()) == want


def test_toxicity_query(spark):
    rows = QUERIES["op8_toxicity"](spark, FOLDER).collect()
    assert len(rows) == table(spark, FOLDER, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_main_text_query(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, FOLDER, "pages").collect()}
    for r in QUERIES["op9_html"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?p>|</?h1>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        assert kept.columns == docs.columns and kept.schema.names == docs.schema.names, name
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    ids = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert max(ids.values()) == 1
    assert not kept.where(r"text rlike '(?i)token = .[0-9a-f]{40}'").count()
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
