"""The keyed state of the nightly run, fed in pieces."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseloom.plans import catalog
from caseloom.streaming import watch
from tests.conftest import rows_of


@pytest.fixture
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _feed(spark, pieces, tmp_path, days=3):
    """Each piece is a file that comes after a run of the stream ended: every run is a restart."""
    source, table = tmp_path / "in", watch.WatchTable(str(tmp_path / "table"))
    for k, piece in enumerate(pieces):
        piece.coalesce(1).write.parquet(str(tmp_path / "in" / f"n{k}"))
        raw = spark.readStream.schema("user_id bigint, event_id bigint, ts timestamp_ntz, event_type string").parquet(str(source / "*"))
        watch.run(spark, raw.select(F.col("user_id").alias("key"), F.to_date("ts").alias("run"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("status")), table, str(tmp_path / "check"), "view", days)
    return table


def _as_w5(table, spark):
    return rows_of(table.read(spark).select(F.col("key").alias("user_id"), "run", "status", "watch_until"))


@pytest.mark.parametrize("order", ["in order", "late and split"])
def test_pieces_give_the_rows_of_the_whole(spark, sf_dir, events, tmp_path, order):
    # By night, or so that nights come late and in two parts.
    piece = F.floor(F.dayofmonth("ts") / 11) if order == "in order" else F.pmod(F.xxhash64("event_id"), F.lit(3))
    cut = events.select("user_id", "event_id", "ts", "event_type", piece.alias("piece"))
    table = _feed(spark, [cut.where(F.col("piece") == k).drop("piece") for k in range(3)], tmp_path)
    assert _as_w5(table, spark) == rows_of(catalog.QUERIES["W5_status_tail"](spark, sf_dir))
    ended = {(r["key"], r["run"]) for r in table.read(spark, "released").collect()}
    assert ended <= {(r["key"], r["watch_until"]) for r in table.read(spark).collect() if r["watch_until"]} | ended


def _rows(spark, rows):
    return spark.createDataFrame([(u, e, dt.datetime(2024, 1, d, 12), s) for u, e, d, s in rows], "user_id bigint, event_id bigint, ts timestamp_ntz, event_type string")


def test_tail_timer_and_repeats(spark, tmp_path):
    first = [(1, 1, 1, "view"), (1, 2, 2, "click"), (2, 3, 2, "click")]
    again = [*first, (1, 4, 3, "click")]  # a piece that comes twice changes nothing
    back = [(1, 5, 9, "view")]
    late = [(2, 6, 1, "view")]  # an earlier night: the tail of key 2 begins after all
    table = _feed(spark, [_rows(spark, x) for x in (first, again, back, late)], tmp_path)
    got = {(r["key"], r["run"].day): (r["status"], r["old"], r["absent_run"] and r["absent_run"].day, r["watch_until"] and r["watch_until"].day) for r in table.read(spark).collect()}
    assert got == {(1, 1): ("view", None, None, None), (1, 2): ("click", "view", 1, 5), (1, 3): ("click", "click", 2, 5), (1, 9): ("view", "click", 3, None), (2, 1): ("view", None, None, None), (2, 2): ("click", "view", 1, 5)}
    # The timer of the tail that lies in the past ends it, once.
    assert [(r["key"], r["run"].day) for r in table.read(spark, "released").collect() if r["key"] == 1] == [(1, 5)]


def test_nights_equal_a_plain_loop():
    r = random.Random(1)
    for _ in range(200):
        seen = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), r.choice(["view", "a", "b"])) for k in sorted(r.sample(range(40), r.randint(1, 20)))]
        whole = watch.nights(seen, None, "view", 3)
        cut = r.randint(0, len(seen))
        head = watch.nights(seen[:cut], None, "view", 3)
        before = (head[-1][0], head[-1][1], head[-1][4]) if head else None
        assert head + watch.nights(seen[cut:], before, "view", 3) == whole
        for (run, status, old, _, until), (was, prev) in zip(whole[1:], seen):
            assert old == prev
            if status != "view" and prev == "view":
                assert until == run + dt.timedelta(days=3)


def test_empty_table(spark, tmp_path):
    assert watch.WatchTable(str(tmp_path / "none")).read(spark).count() == 0
