"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounding of every published share, so that sums in another order print alike.
PLACES = 6


def rounded(c: Column, places: int = PLACES) -> Column:
    return F.round(c, places)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of hits out of n; (0, 0) when n is 0."""
    n = n.cast("double")
    p, zz = hits / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    safe = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(c)
    return safe(F.greatest(F.lit(0.0), mid - half)), safe(F.least(F.lit(1.0), mid + half))


def share(hits: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(hits / n)


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """Equal bins over [0, 1]; the last one holds 1 itself."""
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")


def nearest_rank(column: str, q: float, least: int = 3) -> Column:
    """Aggregate: the nearest-rank quantile, null for fewer than ``least`` rows."""
    return F.when(F.count(column) >= least, F.expr(f"percentile_disc({q}) within group (order by {column})"))


def hits(condition: Column) -> Column:
    return F.count_if(condition)


def md5_unit(c: Column) -> Column:
    """A number in [0, 1) out of the first 8 hex digits of the md5 of a string."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: The Wilson bounds of columns h and n, in SQL.
def wilson_sql(h: str, n: str, z: str = "1.96") -> tuple[str, str]:
    mid = f"(({h})::DOUBLE/({n}) + {z}*{z}/(2.0*({n}))) / (1 + {z}*{z}/({n}))"
    p = f"(({h})::DOUBLE/({n}))"
    half = f"{z} * sqrt({p}*(1-{p})/({n}) + {z}*{z}/(4.0*({n})*({n}))) / (1 + {z}*{z}/({n}))"
    return f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE round(greatest(0.0, {mid} - {half}), 6) END", f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE round(least(1.0, {mid} + {half}), 6) END"
