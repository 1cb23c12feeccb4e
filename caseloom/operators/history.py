"""Interval history: change detection, as-of lookups, diffs, islands, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before (null-safe). A first row without a
    value is silent; a value that goes is a change."""
    line = Window.partitionBy(*key).orderBy(order)
    seen = rows.withColumn("old", F.lag(value).over(line)).withColumn("absent_run", F.lag(order).over(line))
    first = F.col("absent_run").isNull()
    return seen.where(F.when(first, F.col(value).isNotNull()).otherwise(~F.col(value).eqNullSafe(F.col("old"))))


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, since: str, old: str, new: str, name: str) -> DataFrame:
    """The value in force at each probe: the latest version's ``new`` up to it, else the
    earliest later version's ``old``, else null.

    Both sides go through one exchange by key and are merged in time order; a version
    never meets more than its key's neighbours, and no range join is made.
    """
    def wrapped(c: str) -> Column:  # so that a version whose value is null still counts as one
        return F.struct(F.col(c))

    kinds = {c: versions.select(wrapped(c).alias(c)).schema[c].dataType for c in (old, new)}
    asked = probes.withColumns({"__t": F.col(at), "__kind": F.lit(1), "__new": F.lit(None).cast(kinds[new]), "__old": F.lit(None).cast(kinds[old])})
    columns = [F.col(key) if c == key else F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns]
    known = versions.select(*columns, F.col(since).alias("__t"), F.lit(0).alias("__kind"), wrapped(new).alias("__new"), wrapped(old).alias("__old"))
    line = Window.partitionBy(key).orderBy("__t", "__kind")
    back = F.last("__new", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__old", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    both = asked.unionByName(known).withColumn("__back", back).withColumn("__ahead", ahead)
    return both.where("__kind = 1").select(*probes.columns, F.when(F.col("__back").isNotNull(), F.col("__back")[new]).otherwise(F.col("__ahead")[old]).alias(name))


def within_days(left: DataFrame, right: DataFrame, key: str, after: str, at: str, days: int) -> DataFrame:
    """Rows of ``left`` for which ``right`` has a row of the same key with
    after < at <= after + days.

    Buckets as wide as the window make it an equi-join on (key, bucket): a left row
    looks into its own bucket and the next one, so that a hot key is cut by time.
    """
    span = days * 86400
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    a = left.withColumn("__lo", seconds(F.col(after))).withColumn("__b", F.explode(F.array(F.floor(F.col("__lo") / span), F.floor(F.col("__lo") / span) + 1)))
    b = right.select(F.col(key).alias("__key"), seconds(F.col(at)).alias("__at"), F.col(at).alias("__when")).withColumn("__rb", F.floor(F.col("__at") / span))
    hit = (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__rb")) & (F.col("__when") > F.col(after)) & (F.col("__when") <= F.col(after) + F.expr(f"interval {days} days"))
    return a.join(b, hit, "left_semi").drop("__lo", "__b").dropDuplicates()


def listing_diff(before: DataFrame, now: DataFrame, key: list[str], value: str, known: DataFrame | None = None) -> DataFrame:
    """Each entry of two listings: appeared, returning, revised, unchanged or disappeared.

    ``known`` has the keys that were ever seen; an entry that is back is returning."""
    a, b = before.select(*key, F.col(value).alias("was"), F.lit(True).alias("a")), now.select(*key, F.col(value).alias("is"), F.lit(True).alias("b"))
    both = a.join(b, key, "full_outer")
    if known is not None:
        both = both.join(known.select(*key).distinct().withColumn("seen", F.lit(True)), key, "left")
    seen = F.col("seen") if known is not None else F.lit(None).cast("boolean")
    kind = F.when(F.col("b").isNull(), "disappeared").when(F.col("a").isNull() & seen, "returning").when(F.col("a").isNull(), "appeared").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("revised")
    return both.select(*key, kind.alias("kind"), "was", "is")


def islands(rows: DataFrame, key: list[str], order: list[str], condition: Column, name: str = "streak") -> DataFrame:
    """How many rows in a row, up to and with each, meet the condition; a row that doesn't resets it."""
    line = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("__ok", condition).withColumn("__reset", F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "__reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(F.col("__ok").cast("int")).over(inside)).drop("__ok", "__reset")


def admit(rows: DataFrame, key: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """Greedy admission in order: the first row that breaks the cap ends it; later rows
    aren't admitted even if they would fit."""
    line = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.withColumn("total", F.sum(size).over(line))
    return total.withColumn("admitted", ~F.max(F.col("total") > cap).over(line))
