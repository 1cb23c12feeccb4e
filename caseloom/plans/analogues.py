"""The case collection as it appears in the star schema.

An order is a case, its lines are the coded events: ``code`` (6 digits: phase, then
event) and ``finding`` (10 digits). Lines that were returned are the defining ones.
The same tables are spelt in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.codes import top_distinct
from caseloom.sources.tables import table


def split_of(year):
    """Cases are split by the year of the event."""
    return F.when(year <= 1998, "dev").when(year <= 2000, "heldout").otherwise("open")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        day.alias("event_date"), split_of(F.year(day)).alias("split"), F.col("o_totalprice").alias("total"),
        (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000.0).alias("confidence"), (F.col("o_orderkey") % 17 == 0).alias("abstained"), (F.col("o_orderkey") % 29 == 0).alias("failed"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("seq"), (F.col("l_returnflag") == "R").alias("defining"),
        F.concat(pad(part % 47, 3), pad(supp % 93, 3)).alias("code"), F.concat(pad(part, 6), pad(supp, 4)).alias("finding"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("linestatus"), F.to_date("l_shipdate").alias("shipped"), part.alias("part"), supp.alias("supplier"),
    )


#: What orders the lines of a case: defining ones first, then their sequence; the rest settles ties.
LINE_ORDER = ("rest", "seq", "finding", "price")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a case with lines: truth, up to 3 guesses, and finding sets."""
    rows = lines(spark, sf_dir).withColumn("rest", ~F.col("defining"))
    per = rows.groupBy("case_id").agg(
        F.min_by("code", F.struct(*LINE_ORDER)).alias("truth"),
        F.collect_list(F.struct("price", "code")).alias("ranked"),
        F.array_sort(F.collect_set(F.when(F.col("defining"), F.col("finding")))).alias("true_findings"),
        F.array_sort(F.collect_set(F.when(F.col("quantity") >= 25, F.col("finding")))).alias("guessed_findings"),
    )
    return per.withColumn("guesses", top_distinct(F.col("ranked"), "price", "code", 3)).drop("ranked")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their answers; an abstained or failed case keeps its truth."""
    joined = cases(spark, sf_dir).join(answers(spark, sf_dir), "case_id")
    gone = F.col("abstained") | F.col("failed")
    return joined.withColumn("hit1", ~gone & (F.get("guesses", F.lit(0)) == F.col("truth"))).withColumn("hit3", ~gone & F.array_contains("guesses", F.col("truth")))


CASES = """cases AS (SELECT o_orderkey AS case_id, o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS priority,
  CAST(o_orderdate AS DATE) AS event_date,
  CASE WHEN year(o_orderdate) <= 1998 THEN 'dev' WHEN year(o_orderdate) <= 2000 THEN 'heldout' ELSE 'open' END AS split,
  o_totalprice AS total, ((o_orderkey * 7919) % 1000) / 1000.0 AS confidence, o_orderkey % 17 = 0 AS abstained, o_orderkey % 29 = 0 AS failed
  FROM orders)"""
LINES = """lines AS (SELECT l_orderkey AS case_id, l_linenumber AS seq, l_returnflag = 'R' AS defining, l_returnflag <> 'R' AS rest,
  lpad(CAST(l_partkey % 47 AS VARCHAR), 3, '0') || lpad(CAST(l_suppkey % 93 AS VARCHAR), 3, '0') AS code,
  lpad(CAST(l_partkey AS VARCHAR), 6, '0') || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS finding,
  l_quantity AS quantity, l_extendedprice AS price, l_linestatus AS linestatus, CAST(l_shipdate AS DATE) AS shipped, l_partkey AS part, l_suppkey AS supplier FROM lineitem)"""
ANSWERS = f"""{LINES},
firsts AS (SELECT case_id, code AS truth FROM (SELECT case_id, code, row_number() OVER (PARTITION BY case_id ORDER BY rest, seq, finding, price) AS r FROM lines) WHERE r = 1),
tops AS (SELECT case_id, list(code ORDER BY r) AS guesses FROM (
  SELECT case_id, code, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, code) AS r FROM (SELECT case_id, code, max(price) AS p FROM lines GROUP BY ALL)) WHERE r <= 3 GROUP BY case_id),
answers AS (SELECT l.case_id, any_value(truth) AS truth, any_value(guesses) AS guesses,
  coalesce(list_sort(list(DISTINCT finding) FILTER (defining)), []) AS true_findings, coalesce(list_sort(list(DISTINCT finding) FILTER (quantity >= 25)), []) AS guessed_findings
  FROM lines l JOIN firsts USING (case_id) JOIN tops USING (case_id) GROUP BY l.case_id)"""
SCORED = f"""{CASES}, {ANSWERS},
scored AS (SELECT *, NOT (abstained OR failed) AND guesses[1] = truth AS hit1, NOT (abstained OR failed) AND list_contains(guesses, truth) AS hit3 FROM cases JOIN answers USING (case_id))"""
