"""Ranks over a whole table without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number", slices: int = 1024) -> DataFrame:
    """1, 2, ... over the whole table in ``order``, ties settled by its last columns.

    The first column's quantiles cut the table into slices, whose sizes are summed
    up to each slice's offset; rows are then numbered inside their slice. The sums see
    one row a slice. All rows with one value of the first column are one slice.
    """
    first = order[0]
    edges = df.agg(F.percentile_approx(F.col(first).cast("double"), [k / slices for k in range(1, slices)], slices * 10).alias("edges"))
    cut = F.coalesce(F.aggregate(F.col("edges"), F.lit(0), lambda a, e: a + F.when(F.col(first).cast("double") > e, 1).otherwise(0)), F.lit(-1))
    cut_rows = df.join(F.broadcast(edges), F.lit(True)).withColumn("__slice", cut).drop("edges")  # one row of edges
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    return cut_rows.withColumn("__in", inside).join(F.broadcast(sizes), "__slice").withColumn(name, F.col("__in") + F.col("__before")).drop("__slice", "__in", "__before")


#: Sampled rows that cut a table into slices, and the characters of a string that an edge holds.
_DRAWN, _EDGE_CHARS = 2048, 1000


def global_row_number_of_texts(df: DataFrame, order: list[str], name: str = "row_number", slices: int = 256) -> DataFrame:
    """1, 2, ... over the whole table in ``order``, which may begin with strings; nulls last.

    Edges are rows drawn by a hash, in order, with strings cut to their first characters: rows compare with them as
    with any other key, so every row is numbered exactly, and rows with one first string are parted by the next
    columns. Only rows that share a string's first _EDGE_CHARS characters, and are longer, stay in one slice.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in order}
    short = [F.substring(c, 1, _EDGE_CHARS).alias(c) if kinds[c] == "string" else F.col(c) for c in order]
    placed = lambda cols: F.struct(*(x for k, c in enumerate(cols) for x in (c.isNull().alias(f"n{k}"), c.alias(f"v{k}"))))
    drawn = df.select(*short).withColumn("__unit", F.xxhash64(*order)).orderBy("__unit", *order).limit(_DRAWN)
    sorted_keys = F.sort_array(F.collect_list(placed([F.col(c) for c in order])))
    edges = drawn.agg(sorted_keys.alias("__all")).select(F.expr(f"filter(__all, (e, k) -> k % {max(1, _DRAWN // slices)} = 0)").alias("__edges"))
    cut = F.size(F.filter("__edges", lambda e: placed([F.col(c) for c in order]) > e))
    cut_rows = df.join(F.broadcast(edges), F.lit(True)).withColumn("__slice", cut).drop("__edges")  # one row of edges
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    return cut_rows.withColumn("__in", inside).join(F.broadcast(sizes), "__slice").withColumn(name, F.col("__in") + F.col("__before")).drop("__slice", "__in", "__before")


def global_ntile(df: DataFrame, k: int, order: list[str], name: str = "tile") -> DataFrame:
    """n-tiles over the whole table: sizes differ by one at most, the larger ones first."""
    numbered = global_row_number(df, order, "__row", 64)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    r, n = F.col("__row") - 1, F.col("__total")
    size, larger = F.floor(n / k), n % k
    tile = F.when(r < larger * (size + 1), F.floor(r / (size + 1))).otherwise(larger + F.floor((r - larger * (size + 1)) / F.greatest(size, F.lit(1))))
    return numbered.join(F.broadcast(total), F.lit(True)).withColumn(name, (tile + 1).cast("int")).drop("__row", "__total")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows a group in each task before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def even_draw(df: DataFrame, stratum: str, order: list, n: int) -> DataFrame:
    """``n`` rows dealt over the strata as evenly as possible, the first in ``order`` of each; what doesn't divide goes to the first strata in
    order. A stratum with fewer rows gives all it has; rows without a stratum aren't drawn."""
    known = df.where(F.col(stratum).isNotNull())
    strata = known.select(stratum).distinct()
    quota = strata.withColumn("__i", F.row_number().over(Window.orderBy(stratum))).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy()))  # a row a stratum
    each = quota.select(stratum, (F.floor(F.lit(n) / F.col("__m")) + F.when(F.col("__i") <= F.lit(n) % F.col("__m"), 1).otherwise(0)).alias("__quota"))
    return top_per_group(known, [stratum], order, n, "__rank").join(each, stratum).where("__rank <= __quota").drop("__rank", "__quota")
