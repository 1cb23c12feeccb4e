"""Column functions over ranked codes, prefixes and code sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixes(codes: Column, digits: int) -> Column:
    """The distinct prefixes of an array of codes."""
    return F.array_distinct(F.transform(codes, lambda c: F.substring(c, 1, digits)))


def top_distinct(ranked: Column, weight: str, code: str, k: int) -> Column:
    """Of structs (weight, code) the k first distinct codes by weight descending, then code."""
    ordered = F.array_sort(F.transform(ranked, lambda x: F.struct((-x[weight]).alias("w"), x[code].alias("c"))))
    return F.slice(F.array_distinct(F.transform(ordered, lambda x: x["c"])), 1, k)


def precision(predicted: Column, true: Column, abstained: Column) -> Column:
    """Share of predicted codes that are true: null without a prediction, but 0 where
    the answer was withheld although there is a truth."""
    both = F.size(F.array_intersect(predicted, true))
    return F.when(abstained, F.when(F.size(true) > 0, F.lit(0.0))).when(F.size(predicted) > 0, both / F.size(predicted))


def recall(predicted: Column, true: Column, abstained: Column) -> Column:
    """Share of true codes that were predicted; null without a truth."""
    both = F.when(abstained, F.lit(0)).otherwise(F.size(F.array_intersect(predicted, true)))
    return F.when(F.size(true) > 0, both / F.size(true))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def deepest_shared(truth: Column, guesses: Column, depths=(10, 8, 6, 3)) -> Column:
    """The most leading digits that any guess shares with the truth; 0 for none."""
    found = F.lit(0)
    for d in sorted(depths):
        found = F.when(_some_shares(guesses, truth, d), F.lit(d)).otherwise(found)
    return found


def _some_shares(guesses: Column, truth: Column, digits: int) -> Column:
    return F.exists(guesses, lambda g: F.substring(g, 1, digits) == F.substring(truth, 1, digits))
