"""Queries that must reach every row, not a part that happens to be small."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import inference, ranking
from caseloom.plans import catalog
from caseloom.plans.analogues import scored
from caseloom.sources.tables import table


def test_every_event_has_its_status(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("event_id")
    got = catalog.QUERIES["J5_status_as_of_all"](spark, sf_dir).select("event_id")
    assert got.count() == ids.count() and ids.exceptAll(got).count() == 0


def test_every_id_is_compared(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = catalog.QUERIES["S22_manifest_compare_all"](spark, sf_dir)
    renamed = docs.where("doc_id % 15 = 0").select("doc_id")
    assert renamed.count() > 0 and renamed.join(kinds.where("kind = 'missing'"), "doc_id", "left_anti").count() == 0
    counts = {r["kind"]: r["n"] for r in catalog.QUERIES["J27_reconcile_all"](spark, sf_dir).collect()}
    assert counts["both"] + counts["differ"] + counts["only left"] == table(spark, sf_dir, "orders").count()
    assert counts["only left"] == counts["only right"] == table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 11 == 0).count()


def test_every_id_is_loaded_in_order(spark, sf_dir):
    rows = catalog.QUERIES["J23_ordered_load_all"](spark, sf_dir).collect()
    n = table(spark, sf_dir, "documents").count()
    assert sorted(r["pos"] for r in rows) == list(range(1, n + 1))
    known = {r["o_orderkey"] for r in table(spark, sf_dir, "orders").select("o_orderkey").collect()}
    assert all(r["found"] == (r["case_id"] in known) == (r["total"] is not None) for r in rows)


def test_an_id_without_a_case_is_reported(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "orders").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "b"), (10**9, "a"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(catalog.QUERIES["J23_ordered_load_all"](spark, str(tmp_path)).collect())
    assert [(r["pos"], r["case_id"], r["found"]) for r in rows] == [(1, 3 * 10**9, False), (2, 3, True), (3, 6, True)]


def test_places_of_texts(spark):
    r = random.Random(3)
    texts = [None, "", "a", "aé", "b" * 1200, "b" * 1200 + "a", *("".join(r.choice("abé") for _ in range(r.randint(1, 4))) for _ in range(30))]
    values = [(r.choice(texts), k) for k in range(3000)]
    df = ranking.global_row_number_of_texts(spark.createDataFrame(values, "t string, k int").repartition(5), ["t", "k"], "pos")
    want = sorted(values, key=lambda v: (v[0] is None, (v[0] or "").encode(), v[1]))
    assert [(x["t"], x["k"], x["pos"]) for x in df.orderBy("pos").collect()] == [(*v, k + 1) for k, v in enumerate(want)]


def test_bootstrap_reaches_all_rows(spark, sf_dir):
    got = {r["split"]: r for r in catalog.QUERIES["A3_exact_bootstrap"](spark, sf_dir).collect()}
    want = {r["split"]: r for r in scored(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit3").cast("double")).alias("mean")).collect()}
    assert max(r["n"] for r in want.values()) > 400
    assert {k: r["n"] for k, r in got.items()} == {k: r["n"] for k, r in want.items()}
    assert all(got[k]["mean"] == pytest.approx(want[k]["mean"]) and got[k]["low"] <= got[k]["mean"] <= got[k]["high"] for k in want)


def test_bootstrap_by_counts_is_that_of_the_list():
    rows = np.repeat([0.0, 1.0, 2.0], [90, 50, 60])
    drawn = rows[np.random.default_rng(1).integers(0, len(rows), (2000, len(rows)))].mean(1)  # each resample row by row
    mean, low, high = rows.mean(), *np.quantile(drawn, [0.025, 0.975])
    counted = inference.bootstrap_counts([0.0, 1.0, 2.0], [90, 50, 60])
    assert counted == pytest.approx((mean, low, high), abs=0.02) and counted[0] == pytest.approx(mean)
    assert np.isnan(inference.bootstrap_counts([], [])).all()
