"""BM25 over an index whose statistics are those of each query's own past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str, words: str, date: str, until: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, word, tf, length, __d, __until) of each distinct word of a document that is among ``asked`` (word), with the document's
    date and the first date after it at which a query is asked (``until``: __t, __until, a row a date); documents that no query follows have none."""
    dated = docs.join(F.broadcast(until), F.col(date) == F.col("__t"))
    each = dated.select(doc, F.col(date).alias("__d"), "__until", F.size(words).alias("length"), F.explode(words).alias("word")).join(asked, "word", "left_semi")
    return each.groupBy(doc, "word").agg(F.count(F.lit(1)).alias("tf"), *[F.first(c).alias(c) for c in ("length", "__d", "__until")])


def as_of_scores(docs: DataFrame, queries: DataFrame, doc: str, query: str, date: str, words: str, stop_share: float | None = None) -> DataFrame:
    """(query, doc, score) for documents strictly earlier than the query's date that share a word.

    N and average length as of a date are running sums over dates, of all documents; a word's df as of a
    date is a running count over its own postings, which count from the first date on that a query asks after them: a row a word and
    such date. Only words that a query holds are shuffled. The pairs come from an equi-join on the
    word; no document meets a query with which it shares nothing.
    """
    days = docs.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(words)).alias("len"))
    probes = queries.select(query, F.col(date).alias("__at"), F.array_distinct(words).alias("__words"))
    none = F.lit(0).cast("long")
    marks = days.select(F.col(date).alias("__t"), "n", "len", F.lit(False).alias("__asks")).unionByName(probes.select(F.col("__at").alias("__t"), none.alias("n"), none.alias("len"), F.lit(True).alias("__asks")).distinct())
    by_day = marks.groupBy("__t").agg(F.sum("n").alias("n"), F.sum("len").alias("len"), F.bool_or("__asks").alias("__asks"))
    past = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)  # one row a date
    stats = by_day.select(F.col("__t").alias("__at"), F.sum("n").over(past).alias("N"), (F.sum("len").over(past) / F.sum("n").over(past)).alias("avg"))
    later = Window.orderBy(F.desc("__t")).rowsBetween(Window.unboundedPreceding, -1)  # one row a date
    until = by_day.select("__t", F.min(F.when(F.col("__asks"), F.col("__t"))).over(later).alias("__until")).where("__until is not null")
    wanted = probes.select(query, "__at", F.explode("__words").alias("word"))
    index = postings(docs, doc, words, date, until, wanted.select("word").distinct())
    df = index.select("word", F.col("__until").alias("__t"), F.lit(1).alias("c")).unionByName(wanted.select("word", F.col("__at").alias("__t")).distinct().withColumn("c", F.lit(0)))
    df = df.groupBy("word", "__t").agg(F.sum("c").alias("c"))
    df = df.select("word", F.col("__t").alias("__at"), F.coalesce(F.sum("c").over(Window.partitionBy("word").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("df"))
    asked = wanted.join(df, ["word", "__at"]).join(stats, "__at").where("df > 0")
    if stop_share is not None:
        asked = asked.where(F.col("df") <= stop_share * F.col("N"))
    met = asked.join(index, "word").where("__d < __at")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    return met.groupBy(query, doc).agg(F.sum(gain).alias("score"))
