"""Exact quantiles of groups of any size, by distributed selection.

The aggregates for exact quantiles hold a group's distinct values in one task. Here each pass counts a group's values in bins between known bounds, and
only the bin with the wanted rank is looked into further: its least and greatest value are the next bounds. Once it holds few
rows these are sorted. Tasks and the driver hold bins, never a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.sources.places import written

#: Bins of a pass, and the rows of a bin that are sorted rather than counted again.
BINS, FEW = 4096, 100_000


def values_at(rows: DataFrame, group: list[str], value: str, ranks: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``ranks`` (group, rank; 1 is the least value) with ``found``, the value at that rank of its group. Null values aren't counted; a rank beyond a
    group finds null; a null in the group's columns is a group as any other."""
    key = F.struct(*group).alias("__g")  # structs with nulls in equal places are equal
    found = _values_at(rows.select(key, F.col(value)), ["__g"], value, ranks.select(key, "rank"), bins, few)
    return found.select("__g.*", "rank", "found")


def _values_at(rows: DataFrame, group: list[str], value: str, ranks: DataFrame, bins: int, few: int) -> DataFrame:
    own = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    bounds = own.groupBy(*group).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("n"))
    state = ranks.select(*group, "rank").distinct().join(bounds, group).where("rank between 1 and n").withColumn("below", F.lit(0).cast("bigint"))
    state = written(state, "selection")
    number = lambda c: F.col(c).cast("double")
    while not state.where((F.col("n") > few) & (F.col("lo") < F.col("hi"))).isEmpty():
        bin_ = F.when(F.col("lo") < F.col("hi"), F.least(F.floor((number("__v") - number("lo")) / (number("hi") - number("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
        held = own.join(state, group).where(F.col("__v").between(F.col("lo"), F.col("hi"))).withColumn("__bin", bin_)
        counts = held.groupBy(*group, "rank", "below", "__bin").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*group, "rank").orderBy("__bin")) + F.col("below")  # ``bins`` rows at most
        counts = counts.withColumn("__upto", upto).where((F.col("__upto") >= F.col("rank")) & (F.col("__upto") - F.col("n") < F.col("rank")))
        state = written(counts.select(*group, "rank", "lo", "hi", "n", (F.col("__upto") - F.col("n")).alias("below")), "selection")
    single = state.where(F.col("lo") == F.col("hi")).select(*group, "rank", F.col("lo").alias("found"))
    some = own.join(state.where(F.col("lo") < F.col("hi")), group).where(F.col("__v").between(F.col("lo"), F.col("hi")))
    place = F.row_number().over(Window.partitionBy(*group, "rank").orderBy("__v")) + F.col("below")  # ``few`` rows at most
    picked = some.withColumn("__place", place).where(F.col("__place") == F.col("rank")).select(*group, "rank", F.col("__v").alias("found"))
    return ranks.join(single.unionByName(picked), [*group, "rank"], "left")


def quantiles(rows: DataFrame, group: list[str], value: str, wanted: dict[str, float], interpolated: bool = False, least: int = 1, bins: int = BINS, few: int = FEW) -> DataFrame:
    """One row a group: group, n (values that aren't null), and a column for each wanted share; null for fewer than ``least`` values.

    Nearest rank, or ``interpolated`` between the two values around the place share * (n - 1)."""
    rows, group = rows.select(F.struct(*group).alias("__g"), F.col(value)), ["__g"]
    counts = rows.groupBy(*group).agg(F.count(value).alias("n"))
    shares = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("q")) for k, q in wanted.items()])).alias("w")
    asked = counts.where("n > 0").select(*group, "n", shares).select(*group, "n", "w.*")
    at = F.round(F.col("q") * (F.col("n") - 1), 9) if interpolated else F.greatest(F.ceil(F.round(F.col("q") * F.col("n"), 9)), F.lit(1)) - 1
    asked = asked.withColumn("at", at.cast("double")).withColumn("part", F.col("at") - F.floor("at"))
    asked = written(asked.select(*group, "name", "part", F.explode(F.array_distinct(F.array(F.floor("at") + 1, F.ceil("at") + 1))).alias("rank")), "selection-asked")
    found = asked.join(_values_at(rows, group, value, asked.select(*group, "rank").distinct(), bins, few), [*group, "rank"])
    ends = found.groupBy(*group, "name", "part").agg(F.min("found").alias("a"), F.max("found").alias("b"))
    value_at = ends.select(*group, "name", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("v") if interpolated else F.col("a").alias("v"))
    wide = value_at.groupBy(*group).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted])
    return counts.join(wide, group, "left").select("__g.*", "n", *[F.when(F.col("n") >= least, F.col(k)).alias(k) for k in wanted])
