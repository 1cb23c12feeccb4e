"""Pools of coded cases: co-occurrence counts, modal answers and habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a task that puts cases together.
TASK_ROWS = 500_000


def by_case(rows: DataFrame, n: int, case: str = "case_id") -> DataFrame:
    """``rows`` with each case in one task, as many tasks as ``n`` rows ask for: what a task holds doesn't grow with the table.
    Tables dealt for the same ``n`` are joined, and grouped by case, where they lie."""
    return rows.repartition(-(-n // TASK_ROWS) or 1, case)


def code_sets(rows: DataFrame, case: str = "case_id", code: str = "code") -> DataFrame:
    """Distinct (case, code): a code counts once for a case."""
    return rows.select(case, code).distinct()


def pair_counts(sets: DataFrame, case: str = "case_id", code: str = "code") -> DataFrame:
    """Unordered pairs a < b of the codes of one case, with the number of cases.

    Pairs are made inside the case's own (short) code array, so nothing is joined."""
    arrays = sets.groupBy(case).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    pairs = F.flatten(F.transform("codes", lambda a, i: F.transform(F.slice("codes", i + 2, F.greatest(F.size("codes") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return arrays.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def commonest(rows: DataFrame, key: list[str], value: str, k: int, tie: list[Column] | None = None) -> DataFrame:
    """The k commonest values of each key. Equal counts: by ``tie`` (aggregates), else by value."""
    ties = {f"__tie{i}": t for i, t in enumerate(tie or [])}
    counted = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"), *[t.alias(name) for name, t in ties.items()])
    order = [F.desc("n"), *ties, value]
    line = Window.partitionBy(*key).orderBy(*order) if key else Window.orderBy(*order)
    return counted.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).drop(*ties)


def leave_one_out(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """For each row: whether its value is the commonest among the other rows of its
    group, ties to the smallest value; groups of one have no others.

    The winner without a row is one of the group's two best values, so that counts
    by (group, value) and a top two decide every row of a value at once. Returns one
    row for each (group, value): n rows and ``agrees``.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy(*group)
    best = counts.withColumn("rank", F.row_number().over(line.orderBy(F.desc("n"), value))).withColumn("size", F.sum("n").over(line))
    first = F.max(F.when(F.col("rank") == 1, F.struct("n", value))).over(line)
    second = F.max(F.when(F.col("rank") == 2, F.struct("n", value))).over(line)
    best = best.withColumn("first", first).withColumn("second", second).where("size > 1")
    own = F.col("n") - 1
    rival = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    wins = (own > 0) & (rival.isNull() | (own > rival["n"]) | ((own == rival["n"]) & (F.col(value) < rival[value])))
    # Between the two best there is no third that could win: it has at most the second's count and a larger value.
    return best.select(*group, value, "n", "size", wins.alias("agrees"))


def commonest_as_of(rows: DataFrame, at: str, value: str, probes: DataFrame) -> DataFrame:
    """(at, value, n): how often each value occurs strictly before each of the times ``probes`` (at), values that don't left out.

    Counts by value and time are summed along time once; the probe times, a list as long as a calendar, are put between them."""
    daily = rows.where(F.col(value).isNotNull()).groupBy(value, at).agg(F.count(F.lit(1)).alias("n"))
    times = probes.select(at).where(F.col(at).isNotNull()).distinct().agg(F.collect_list(at).alias("__times"))
    asked = daily.select(value).distinct().join(F.broadcast(times), F.lit(True)).select(value, F.explode("__times").alias(at))  # one row of times
    both = daily.withColumn("__asked", F.lit(0)).unionByName(asked.withColumn("n", F.lit(0).cast("bigint")).withColumn("__asked", F.lit(1)))
    before = Window.partitionBy(value).orderBy(at, F.desc("__asked")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("n", F.sum("n").over(before)).where("__asked = 1 and n > 0").select(at, value, "n")


def top(counted: DataFrame, keys: list[str], k: int, value: str = "code", n: str = "n") -> DataFrame:
    """The k rows of each key with the greatest counts, equal ones by value."""
    return counted.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), value))).where(F.col("__rank") <= k).drop("__rank")
