"""Operators over groups, records and inputs of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseloom.operators import census, pools, selection
from caseloom.sources import board, ledger
from caseloom.sources.places import shared_folder
from caseloom.sources.tables import table

from .analogues import CASES, SCORED, cases, lines, scored
from .registry import ORACLES, query


@query("A25_percentiles_by_selection", ORACLES["A25_nearest_rank_percentiles"])
def percentiles_by_selection(spark, d):
    """A25 without a group in one task."""
    return selection.quantiles(cases(spark, d), ["split"], "total", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, least=3)


@query("A76_interpolated_by_selection", ORACLES["A76_interpolated_quantiles"])
def interpolated_by_selection(spark, d):
    wide = selection.quantiles(cases(spark, d), ["priority"], "total", {"median": 0.5, "p90": 0.9}, interpolated=True)
    return wide.select("priority", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query("A77_leaf_paths", """WITH l AS (SELECT l_orderkey AS k, l_discount AS disc, l_returnflag AS flag FROM lineitem)
SELECT 'case' AS path, count(*) AS n FROM orders UNION ALL SELECT 'who.customer', count(*) FROM orders UNION ALL SELECT 'who.clerk', count(*) FROM orders
UNION ALL SELECT 'lines[].part', count(*) FROM lineitem UNION ALL SELECT 'lines[].price.gross', count(*) FROM lineitem
UNION ALL SELECT 'lines[].price.off', count(*) FROM l WHERE disc > 0 UNION ALL SELECT 'lines[].tags[][]', 2 * count(*) FROM l WHERE flag = 'R' UNION ALL SELECT 'lines[].tags[][].deep.er', count(*) FROM l WHERE flag = 'R'""")
def leaf_paths(spark, d):
    """How often each leaf path of nested records occurs, arrays in arrays and a level of depth six included."""
    part = F.struct(
        F.col("l_partkey").alias("part"), F.struct(F.col("l_extendedprice").alias("gross"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("off")).alias("price"),
        F.when(F.col("l_returnflag") == "R", F.from_json(F.lit('[["a", 1], [{"deep": {"er": null}}, {}]]'), "array<array<string>>")).alias("tags"),
    )
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(part).alias("lines"))  # an order has a few lines
    record = F.to_json(F.struct(F.col("o_orderkey").alias("case"), F.struct(F.col("o_custkey").alias("customer"), F.lit("x").alias("clerk")).alias("who"), "lines"))
    # Strings that hold JSON become JSON: tags are nested anew.
    whole = F.regexp_replace(F.regexp_replace(record, r'"(\{.*?\})"', "$1"), r'\\"', '"')
    return census.leaf_paths(table(spark, d, "orders").join(own, "o_orderkey", "left").select(F.parse_json(whole).alias("record")), "record").select("path", "n")


@query("T1_most_common_as_met", """WITH e AS (SELECT user_id, event_type, row_number() OVER () AS pos FROM events), c AS (SELECT user_id, event_type, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL)
SELECT user_id, event_type, n, rank FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 3""")
def most_common_as_met(spark, d):
    """The three commonest values of each key, equal counts in the order in which they were met in the input."""
    rows = table(spark, d, "events").select("user_id", "event_type", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return pools.commonest(rows, ["user_id"], "event_type", 3, tie=[F.min("place")])


_CARD = f"""{SCORED}, k AS (SELECT case_id, list({{'seq': seq, 'code': code, 'mark': linestatus}} ORDER BY seq, code, linestatus) AS codes, count(*) AS n_calls, round(sum(price), 2) AS spent FROM lines GROUP BY case_id),
card AS (SELECT 'C' || lpad(CAST(case_id AS VARCHAR), 9, '0') AS case_number, CASE WHEN failed THEN 'not coded' WHEN abstained THEN 'abstained' WHEN hit1 THEN 'same' WHEN hit3 THEN 'other order' ELSE 'different' END AS grade, truth, guesses, codes, n_calls, spent FROM scored JOIN k USING (case_id) WHERE split = 'open')"""


def _cards(spark, d):
    code = F.struct("seq", "code", F.col("linestatus").alias("mark"))
    k = lines(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(code)).alias("codes"), F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("price"), 2).alias("spent"))  # a case has a few lines
    grade = F.when(F.col("failed"), "not coded").when(F.col("abstained"), "abstained").when(F.col("hit1"), "same").when(F.col("hit3"), "other order").otherwise("different")
    number = F.concat(F.lit("C"), F.lpad(F.col("case_id").cast("string"), 9, "0"))
    return scored(spark, d).where("split = 'open'").join(k, "case_id").select(number.alias("case_number"), grade.alias("grade"), "truth", "guesses", "codes", "n_calls", "spent")


@query("J25_nested_cards", f"""WITH {_CARD} SELECT case_number, grade, truth, guesses, CAST(to_json(codes) AS VARCHAR) AS codes, n_calls, spent FROM card""")
def nested_cards(spark, d):
    """One nested record a case: grade, answers, its codes as structs and its calls."""
    return _cards(spark, d).withColumn("codes", F.to_json("codes"))


@query("S21_board_index", f"""WITH {_CARD} SELECT case_number, grade, truth, n_calls FROM card""")
def board_index(spark, d):
    """The index of a board that was exported and read back: one entry and one file a case."""
    cards = _cards(spark, d)
    path = shared_folder(spark, f"board-{uuid.uuid4().hex}")
    entry = F.to_json(F.struct("case_number", "grade", "truth", "n_calls"))
    board.export(cards.select("case_number", entry.alias("entry"), F.to_json(F.struct(*cards.columns)).alias("body")), path, {"format_of": "cards"})
    return board.entries(spark, path, "case_number string, grade string, truth string, n_calls bigint")


@query("S23_ledger_lines", f"""WITH {CASES}, m AS (SELECT customer, max(event_date) AS last, count(*) AS n FROM cases GROUP BY customer), m2 AS (SELECT customer, max(event_date) AS last, count(*) AS n FROM cases WHERE event_date < DATE '2000-01-01' GROUP BY customer),
b AS (SELECT customer AS k, sha256(CAST(last AS VARCHAR) || ' ' || n) AS h FROM m), b2 AS (SELECT customer AS k, sha256(CAST(last AS VARCHAR) || ' ' || n) AS h FROM m2)
SELECT 1 AS batch, CAST(k AS VARCHAR) AS key, h AS sha256 FROM b2 UNION ALL SELECT 2, CAST(b.k AS VARCHAR), b.h FROM b LEFT JOIN b2 ON b.k = b2.k WHERE b.h IS DISTINCT FROM b2.h""")
def ledger_lines(spark, d):
    """A ledger to which two states of all manifests were appended: only new and rewritten ones have a second line."""
    book = ledger.Ledger(spark, shared_folder(spark, f"ledger-{uuid.uuid4().hex}"))
    body = F.concat_ws(" ", F.max("event_date").cast("string"), F.count(F.lit(1)).cast("string"))
    own = cases(spark, d)
    for at, rows in (("t1", own.where("event_date < date '2000-01-01'")), ("t2", own)):
        book.append(rows.groupBy(F.col("customer").cast("string").alias("key")).agg(body.alias("body")), at)
    return book.lines().select(F.col("batch").cast("int").alias("batch"), "key", "sha256")
