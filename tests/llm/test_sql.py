"""The corpus queries that SQL can express, on whole tables."""

from __future__ import annotations

import math
import os
import random

import pytest

from caseloom.llm import queries
from tests.conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_odd_rows_equal_sql(name, spark, odd, tmp_path):
    import duckdb

    kept = odd.where("doc_id is not null")
    if name in ("op6_jaccard_join", "op8_substring_dedup"):
        kept = kept.dropDuplicates(["doc_id"])  # their SQL tells rows apart by doc_id
    kept.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    urls = ["http://a.b.co.uk/1", "http://a.b.co.uk/2?x", "http://c.b.co.uk/3/", "HTTP://d.com/4", "http://d.com/5.html", "x://e.f.d.com/6#t", "x://co.uk/7", "x://com/8", "x://./9", "x:///1", None, "", "none", "http://q.example.net/en/3", "http://q.net/3", "http://é.org/fr/2", "x://" + "w" * 9000 + ".org/2"]
    spark.createDataFrame([(k % 15, u, 1) for k, u in enumerate(urls + urls[:3])], "page_id bigint, url string, host int").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(k, q, t) for k, (q, t) in enumerate([(1, 0), (1, 0), (0, 0), (1, 1), (None, 0), (1, None), (0, 1), (1, 0), (1, 0)])] + [(1, 0, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    r = random.Random(13)
    vectors = [[r.gauss(0, 0.3) for _ in range(32)] for _ in range(90)]
    vectors[3][5], vectors[4][0], vectors[5][31], vectors[6] = None, math.nan, -math.inf, None
    vectors[20] = vectors[21] = vectors[80]  # equal entries, of which the first is taken
    rows = [(k * 7 % 90 - 4, v, None if k % 9 == 0 else k % 4, "x") for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    same_as_sql(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name])


def test_all_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert os.path.basename(queries.__file__) == "queries.py"
