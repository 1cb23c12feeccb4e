"""The raw store and the processed table on small folders."""

from __future__ import annotations

import json

import pytest

from caseloom.sources import store

RECORD = "number: string, day: string, split: string"


@pytest.fixture
def raw(tmp_path):
    pages = {
        ("2001-01", "a"): [{"number": "1", "day": "d1", "split": "dev"}, None, {"number": "2", "day": "d1", "split": "dev"}],
        ("2001-02", "a"): [{"number": "1", "day": "d2", "split": "open"}, {"day": "d2"}],
        ("2001-03", "a"): [],
    }
    for (month, page), data in pages.items():
        (folder := tmp_path / "raw" / f"month={month}").mkdir(parents=True, exist_ok=True)
        (folder / f"{page}.json").write_text(json.dumps({"data": data}))
    return str(tmp_path / "raw")


def test_raw_records_opens_only_wanted_months(spark, raw):
    all_rows = store.raw_records(spark, raw, RECORD)
    assert sorted((r.month, r.place, r.number) for r in all_rows.collect() if r.number) == [("2001-01", 0, "1"), ("2001-01", 2, "2"), ("2001-02", 0, "1")]
    some = store.raw_records(spark, raw, RECORD, ["2001-02"])
    assert {r.month for r in some.collect()} == {"2001-02"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2001-02" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_build_keeps_the_newest_copy_and_writes_its_counts(spark, raw, tmp_path):
    rows = store.newest(store.raw_records(spark, raw, RECORD), "number", ["month"])
    assert sorted((r.number, r.split) for r in rows.collect()) == [("1", "open"), ("2", "dev")]
    excluded = spark.createDataFrame([("no date", 1)], "reason string, n long")
    meta = store.write_processed(rows, excluded, str(tmp_path / "out"))
    assert meta == {"rows": 2, "counts_by_split": {"dev": 1, "open": 1}, "excluded": {"no date": 1}}
    assert json.loads(spark.read.text(str(tmp_path / "out/cases.meta.json")).first()[0]) == meta
    assert spark.read.parquet(str(tmp_path / "out/cases.parquet")).count() == 2


def test_fence_refuses_withheld_cases(spark):
    wanted, sealed = spark.range(5), spark.range(4, 9)
    with pytest.raises(store.Refused, match="sealed: 4"):
        store.fence(wanted, sealed, "id", "sealed")
    assert store.fence(wanted, spark.range(7, 9), "id", "held out").count() == 5


def test_a_damaged_page_stops_the_job(spark, raw):
    from pathlib import Path

    (Path(raw) / "month=2001-02" / "a.json").write_text('{"data": [{"number": "1", "day"')
    with pytest.raises(Exception, match="damaged page 2001-02/a.json"):
        store.raw_records(spark, raw, RECORD).collect()
    assert store.raw_records(spark, raw, RECORD, ["2001-01"]).count() == 3 - 1


def test_null_splits_and_reasons_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "dev"), (3, None)], "number long, split string")
    meta = store.write_processed(rows, spark.createDataFrame([(None, 2), ("null", 1), ("late", 1)], "reason string, n long"), str(tmp_path / "out"))
    assert meta == {"rows": 3, "counts_by_split": {"null": 2, "dev": 1}, "excluded": {"null": 3, "late": 1}}


def _pages(spark, pages):
    return spark.createDataFrame([(m, p, c if isinstance(c, str) else json.dumps({"data": c})) for m, p, c in pages], "month string, page string, content string")


def test_months_are_staged_and_committed_once(spark, tmp_path):
    s = store.RawStore(spark, str(tmp_path / "raw"))
    months = spark.createDataFrame([("2001-01",), ("2001-02",), ("2001-03",)], "month string")
    assert s.records(RECORD).count() == 0 and s.missing(months).count() == 3
    first = _pages(spark, [("2001-01", "p1", [{"number": "1", "day": "a", "split": "dev"}, None]), ("2001-01", "p2", [{"number": "2"}]), ("2001-02", "p1", [])])
    assert s.add(first, "t1") == 2
    assert s.add(first, "t2") == 0  # a rerun appends nothing
    assert s.manifest().count() == 2 and [r.month for r in s.missing(months).collect()] == ["2001-03"]
    # A fetch that broke off before its line was written is invisible.
    _pages(spark, [("2001-03", "p1", [{"number": "9"}])]).write.partitionBy("month").parquet(str(tmp_path / "raw/pages/fetch=broken"))
    assert sorted((r.month, r.page, r.place, r.number) for r in s.records(RECORD).collect()) == [("2001-01", "p1", 0, "1"), ("2001-01", "p2", 0, "2")]
    # A month fetched again replaces what it had; others stay.
    assert s.add(_pages(spark, [("2001-01", "p1", [{"number": "7"}])]), "t3", refresh=True) == 1
    assert [(r.month, r.number) for r in s.records(RECORD).collect()] == [("2001-01", "7")]
    assert s.records(RECORD, ["2001-02"]).count() == 0 and s.manifest().count() == 3
    latest = {r.month: (r.fetched_at, r.records) for r in s.latest().collect()}
    assert latest == {"2001-01": ("t3", 1), "2001-02": ("t1", 0)}


@pytest.mark.parametrize(("harm", "said"), [("changed", "p1: changed"), ("missing", "p1: missing"), ("extra", "p9: not in the manifest"), ("cut", "damaged page 2001-01/p1")])
def test_a_month_that_is_not_as_written_stops_the_job(spark, tmp_path, harm, said):
    s = store.RawStore(spark, str(tmp_path / "raw"))
    s.add(_pages(spark, [("2001-01", "p1", '{"data": [{"numb' if harm == "cut" else [{"number": "1"}]), ("2001-01", "p2", [])]), "t1")
    fetch = s.manifest().first().fetch
    place = f"{s.folder}/pages/fetch={fetch}/month=2001-01"
    if harm != "cut":
        pages = {"p1": json.dumps({"data": [{"number": "2" if harm == "changed" else "1"}]}), "p2": json.dumps({"data": []})} | ({"p9": "{}"} if harm == "extra" else {})
        if harm == "missing":
            pages.pop("p1")
        spark.createDataFrame(list(pages.items()), "page string, content string").write.mode("overwrite").parquet(place)
    with pytest.raises(Exception, match=said):
        s.records(RECORD).collect()
    if harm == "changed":
        assert s.records(RECORD, verify=False).count() == 1


def test_build_takes_the_first_reason(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("1", 1, "dev"), ("1", 2, "open"), ("2", 1, None), (None, 1, "dev"), ("3", 1, "x")], "number string, at long, split string")
    kept, excluded = store.build(rows, "number", ["at"], [("no split", F.col("split").isNull()), ("odd split", ~F.col("split").isin("dev", "open"))])
    assert [tuple(r) for r in kept.collect()] == [("1", 2, "open")]
    assert {r.reason: r.n for r in excluded.collect()} == {"no split": 1, "odd split": 1, "no key": 1, "older copy": 1}


def test_a_checkpoint_made_anew_has_batches_of_its_own(spark, tmp_path):
    import shutil

    from caseloom.streaming import nightly

    schema = "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string, value double"
    at = lambda lo, hi: spark.range(lo, hi).selectExpr("id as user_id", "id as event_id", "timestamp_ntz'2024-01-01' as ts", "'x' as event_type", "1.0D as value")
    table, check = nightly.Store(str(tmp_path / "table")), str(tmp_path / "check")
    for k, (lo, hi) in enumerate([(0, 20), (20, 50)]):
        at(lo, hi).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        nightly.run(spark, str(tmp_path / f"in{k}"), spark.createDataFrame([], schema).schema, table, check)
        shutil.move(check, f"{check}-old{k}")
    assert table.read(spark).count() == 50


def test_cases_that_are_not_there_are_refused(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    wanted = spark.createDataFrame([(2, 0), (1, 1)], "id long, place int")
    assert [r.v for r in store.load_cases(wanted, cases, "id", "place").orderBy("place").collect()] == ["b", "a"]
    with pytest.raises(store.Refused, match="no such case: 9"):
        store.load_cases(wanted.union(spark.createDataFrame([(9, 2)])), cases, "id", "place")
    assert store.refuse_dangling(wanted, cases, "id", "closures").count() == 2
    with pytest.raises(store.Refused, match="closures without a case: 7"):
        store.refuse_dangling(spark.createDataFrame([(7,)], "id long"), cases, "id", "closures")


def test_listing_text_and_document_ids(spark):
    from pyspark.sql import functions as F

    from caseloom.sources import listing

    df = spark.createDataFrame([("<b>A &amp; B</b>&nbsp; &lt;i&gt; &#39;x&quot; &amp;lt;", "/d/12/?q=1#z"), ("", ""), (None, None)], "m string, h string")
    got = [tuple(r) for r in df.select(listing.plain_text(F.col("m")), listing.document_id(F.col("h"))).collect()]
    assert got == [("A & B <i> 'x\" &lt;", "12"), ("", None), (None, None)]


def test_withheld_paths(spark):
    from pyspark.sql import functions as F

    from caseloom.functions import paths

    withheld = ["a[0].b", "c.d.e", "text"]
    own = ["a", "a[].b", "a[3].b.c", "a[].bb", "c.d", "c.dd", "c.d.e[].f", "text", "texts", "x"]
    df = spark.createDataFrame([(p,) for p in own], "p string").select("p", paths.overlaps_any(F.col("p"), withheld).alias("o"))
    assert {r.p: r.o for r in df.collect()} == {p: any(paths.overlap(p, w) for w in withheld) for p in own}
    paths.refuse_withheld({"make": "a[0].bb", "day": "c.dd"}, withheld)
    with pytest.raises(ValueError, match="withheld text: cause, whole"):
        paths.refuse_withheld({"cause": "c.d.e.f", "whole": "a", "make": "x"}, withheld)
