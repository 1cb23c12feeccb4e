"""The board and the ledger: what fails leaves what was there."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseloom.sources import board, ledger

ENTRY = "case_number string, grade string"


def _board(spark, cases, fail=None):
    df = spark.createDataFrame(cases, "case_number string, grade string").repartition(3)
    body = F.to_json(F.struct("case_number", "grade", F.struct(F.lit(1).alias("steps")).alias("trail")))
    if fail:
        body = F.when(F.col("case_number") == fail, F.raise_error(F.lit("lost"))).otherwise(body)
    return df.select("case_number", F.to_json(F.struct("case_number", "grade")).alias("entry"), body.alias("body"))


def test_index_and_cases_appear_together(spark, tmp_path):
    path = str(tmp_path / "board")
    assert board.index(path) is None and board.entries(spark, path, ENTRY).count() == 0
    first = [(f"A{k}", "right") for k in range(20)]
    board.export(_board(spark, first), path, {"built_at": "t1"})
    read = lambda: sorted(map(tuple, board.entries(spark, path, ENTRY).collect()))
    assert read() == sorted(first) and board.index(path)["cases"] == 20 and board.index(path)["stamp"] == {"built_at": "t1"}
    # A task fails after others have written their files: the old board is what readers find.
    with pytest.raises(Exception, match="lost"):
        board.export(_board(spark, [(f"B{k}", "wrong") for k in range(30)], fail="B7"), path)
    assert read() == sorted(first)
    before = board.index(path)["version"]
    second = [(f"A{k}", "wrong") for k in range(5)]
    board.export(_board(spark, second), path)
    assert read() == sorted(second)
    assert {board.index(path)["version"], before} <= {x.name for x in Path(path, "versions").iterdir()}  # readers of the old one can end
    whole = board.bodies(spark, path, f"{ENTRY}, trail struct<steps int>").collect()
    assert sorted((r.case_number, r.grade, r.trail.steps) for r in whole) == [(a, b, 1) for a, b in second]
    board.export(_board(spark, []), path)
    assert before not in {x.name for x in Path(path, "versions").iterdir()}
    assert read() == [] and board.index(path)["cases"] == 0


def test_board_refuses_odd_numbers(spark, tmp_path):
    path = str(tmp_path / "board")
    with pytest.raises(ValueError, match="two rows of case A"):
        board.export(_board(spark, [("A", "x"), ("A", "y")]), path)
    with pytest.raises(Exception, match="not a case number"):
        board.export(_board(spark, [("../A", "x")]), path)
    assert board.index(path) is None


def _manifests(spark, **bodies):
    return spark.createDataFrame([(k, v) for k, v in bodies.items()], "key string, body string")


def test_rewritten_manifests_are_appended(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    one = _manifests(spark, a="1", b="2")
    assert book.append(one, "t1") == 2
    assert book.append(one, "t2") == 0  # nothing new, no batch
    two = _manifests(spark, a="1", b="22", c="")
    assert book.append(two, "t3") == 2
    assert sorted((r.batch, r.key, r.size, r.appended_at) for r in book.lines().collect()) == [(1, "a", 1, "t1"), (1, "b", 1, "t1"), (2, "b", 2, "t3"), (2, "c", 0, "t3")]
    assert {r.key: r.batch for r in book.latest().collect()} == {"a": 1, "b": 2, "c": 2}
    assert book.problems(two).count() == 0
    assert [tuple(r) for r in book.problems(_manifests(spark, b="2", c="")).collect()] == [(1, "a", "manifest is missing"), (2, "b", "manifest differs from the ledger")]
    # An append that broke off before its seal isn't read, and is written over.
    spark.createDataFrame([(3, "z", "x", 1, "t")], ledger.LINE).write.json(str(tmp_path / "ledger/lines/part=3"))
    assert book.lines().count() == 4
    assert book.append(_manifests(spark, d="4"), "t4") == 1 and {r.key for r in book.lines().where("batch = 3").collect()} == {"d"}


@pytest.mark.parametrize("harm", ["edit", "remove", "add"])
def test_changed_lines_are_found(spark, tmp_path, harm):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    book.append(_manifests(spark, a="1", b="2"), "t1")
    book.append(_manifests(spark, a="3"), "t2")
    rows = [json.loads(x) for f in Path(tmp_path, "ledger/lines/part=1").glob("*.json") for x in f.read_text().splitlines()]
    if harm == "edit":
        rows[0]["sha256"] = "0" * 64
    rows = rows[1:] if harm == "remove" else [*rows, rows[0] | {"key": "q"}] if harm == "add" else rows
    spark.createDataFrame([tuple(r[c.split()[0]] for c in ledger.LINE.split(", ")) for r in rows], ledger.LINE).write.mode("overwrite").json(str(tmp_path / "ledger/lines/part=1"))
    first = book.problems(_manifests(spark, a="3", b="2")).first()
    assert (first.batch, first.key, first.problem) == (1, None, "its lines aren't those that were sealed")
