"""Mixing sources to target weights.

Rows get hash-random keys; within each source the keys are cut into ranges and
sorted, prefix sums of token counts run over the ranges and then inside each
range, and every source is cut at its exact budget. A budget above a source's
size repeats the source in whole epochs before the cut. All that sees one slim row
for each different document; the cut itself is one key a source, against which every
document, with its text or without, is held where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, count_words, materialize, small_side, table, unused

#: Documents that one key range of a source holds on average.
RANGE_ROWS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, total: float | None = None) -> DataFrame:
    """Targets from ``sizes`` (source, source_size, n_docs): one row a source.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``total`` (all sizes when None). A target stops at ``max_epochs`` times its
    source's size and the excess is shared again by weight, which is the level
    ``L`` with sum(min(max_epochs * size, L * weight)) = total: sources sorted by
    cap / weight fill up one after the other, so running sums find it. The
    sorts see one row a source, never a document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    fill = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rated = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    goal = F.lit(float(total)) if total is not None else F.sum("source_size").over(whole).cast("double")
    before = F.coalesce(F.sum("cap").over(fill), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    rated = rated.withColumn("level", (goal - before) / left).withColumn("place", F.row_number().over(filling))
    # The first source, in fill order, whose cap lies above its share sets the level of all after it.
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(whole)
    rated = rated.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rated.select("source", "source_size", "n_docs", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_key"))


def _place(key: Column, doc_id: Column, row_key: Column) -> Column:
    """What orders documents within a source; null ids come first."""
    return F.struct(key, doc_id.isNotNull(), F.coalesce(doc_id.cast("string"), F.lit("")), row_key)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), "source", count_words(F.col("text")).alias("size"))


def cut_points(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row a source of ``sized`` (doc_id, row_key, source, size): source, source_size, target, epochs (whole
    passes over the source), and the document that the budget ends in: key, doc_id,
    row_key, ``n``, its equal rows, and ``rest``, the words taken from those in the last pass. A budget of whole
    passes ends in none: key is null.
    """
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, max_epochs)
    # The key's top bits choose the range; a source with a third of all rows has a third of the ranges.
    unit = F.shiftrightunsigned(_key(seed), 11) / F.lit(float(1 << 53))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(RANGE_ROWS)))
    # Equal rows are one, however many: each task combines them first.
    equal = sized.groupBy("source", "doc_id", "row_key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    keyed = equal.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    keyed = keyed.select("doc_id", "row_key", "size", "n", F.col("d.source").alias("source"), (goal - epochs * F.col("source_size")).alias("left"), _key(seed).alias("key"), F.floor(unit * ranges).alias("range"))
    budgets = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = budgets.select("source", "range", F.coalesce(F.sum("range_size").over(before(Window.partitionBy("source").orderBy("range"))), F.lit(0)).alias("range_start"))
    inside = before(Window.partitionBy("source", "range").orderBy(_place(F.col("key"), F.col("doc_id"), F.col("row_key"))))
    placed = keyed.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("k").join(
        starts.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k.range") == F.col("s.range"))
    )
    begin = F.col("range_start") + F.col("offset")
    ends = placed.where((begin <= F.col("left")) & (F.col("left") < begin + F.col("size")) & (F.col("left") > 0))
    ends = ends.select(F.col("k.source").alias("source"), "key", "doc_id", "row_key", "n", (F.col("left") - begin).alias("rest"))
    cuts = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    return cuts.select(F.col("t.source").alias("source"), "source_size", "target", epochs.alias("epochs"), "key", "doc_id", "row_key", "n", "rest")


def _taken(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, row_key, source, size and more) with source_size, target and taken.

    Rows before a source's cut are taken once more than its whole passes, those after
    it aren't; equal rows at the cut share what is left evenly. Nothing is shuffled if the sources are few."""
    cuts = cuts.select(F.struct("*").alias("cut"))
    joined = rows.join(small_side(cuts, cuts.count(), 200), F.col("source").eqNullSafe(F.col("cut.source")))
    own, end = _place(_key(seed), F.col("doc_id"), F.col("row_key")), _place(F.col("cut.key"), F.col("cut.doc_id"), F.col("cut.row_key"))
    # Without a cut document the budget is whole passes.
    last = F.when(F.col("cut.key").isNull() | (own > end), F.lit(0)).when(own < end, F.col("size")).otherwise(F.floor(F.col("cut.rest") / F.col("cut.n")))
    taken = (F.col("size") * F.col("cut.epochs") + last).cast("long")
    return joined.select(*rows.columns, F.col("cut.source_size").alias("source_size"), F.col("cut.target").alias("target"), taken.alias("taken"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, row_key, size, source, source_size, target, taken.

    ``taken`` counts the words that the mix takes from the document, repeats
    counted; within a source they sum to the target rounded down, so that only
    the document at the cut is taken in part. Null text has size 0 and is never
    taken; an empty table gives an empty mix; rows that share a doc_id are told apart by a
    hash of their text, so that a rerun cuts at the same word. Equal rows are taken
    alike: those at the cut share the last words evenly, which leaves fewer words over than there are such rows.
    Other columns are ignored.
    """
    sized = materialize(_sized(docs), "mix-sizes")
    return _taken(sized, materialize(cut_points(sized, weights, max_epochs, seed), "mix-cuts"), seed).select("doc_id", "row_key", "size", "source", "source_size", "target", "taken")


def op4_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs, all columns, as the mix takes them: a row for each whole copy, then one with
    the words up to the cut for the document that the budget ends in.

    Texts without a word aren't taken; equal rows are taken alike, as in mix_sources; an
    empty table stays empty. Texts stay where they are, unless the list of sources is too long to be broadcast.
    """
    cuts = materialize(cut_points(materialize(_sized(docs), "mix-sizes"), weights, max_epochs, seed), "mix-cuts")
    row = unused(docs, "row")
    rows = docs.select(F.struct(*docs.columns).alias(row), "doc_id", "source", F.xxhash64("text").alias("row_key"), count_words(F.col("text")).alias("size"))
    taken = _taken(rows, cuts, seed).where("taken > 0")
    part = F.col("taken") % F.col("size")
    copies = ((F.col("taken") - part) / F.col("size")).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    cut = taken.select(F.col(row).alias("row"), F.explode(pieces).alias("words"))
    # A text's words up to the n-th, one space between them; only the text at a cut is taken apart.
    some = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    return cut.select(F.col("row").withField("text", F.when(F.col("words") < 0, F.col("row.text")).otherwise(some)).alias("row")).select("row.*")


def apply_mix(docs: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """mix_documents by the weights of mix_sources; ``mixed`` isn't needed."""
    return mix_documents(docs)
