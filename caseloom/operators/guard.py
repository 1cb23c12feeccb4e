"""Leakage: withheld sentences found in other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T

from . import automaton

#: Words of the key that a needle and a haystack must share before they are compared.
KEY_WORDS = 3
#: Characters by which a needle of few words is found.
SHORT_KEY = 12
#: Bits of the filter that runs pass before they leave their row: 512 KB.
FILTER_BITS = 1 << 22


def needles(withheld: DataFrame, key: str, column: str, least: int = 20, fold=T.fold, without: str | None = None) -> DataFrame:
    """(key, needle, whole): each text's sentences of ``least`` characters, and the folded whole text.

    ``fold`` folds texts (T.fold, or T.fold_forms for compatibility forms); sentences that match ``without`` (T.NOTICE) are
    none, but a whole text is searched whatever it says."""
    rows = withheld.select(key, fold(F.col(column)).alias("__folded"))
    bare = T.trim_marks(F.col("__folded"))
    parts = rows.select(key, F.explode(T.sentences_of(F.col("__folded"), least, without)).alias("needle"), bare.alias("__whole"))
    sentences = parts.where("needle <> __whole").select(key, "needle", F.lit(False).alias("whole"))
    return rows.select(key, bare.alias("needle"), F.lit(True).alias("whole")).where(F.length("needle") >= least).unionByName(sentences)


def leaks(haystacks: DataFrame, doc: str, column: str, found: DataFrame, key: str, fold=T.fold) -> DataFrame:
    """(doc, key, needle, whole) for each needle that a text contains.

    Needles of a checked size travel to the tasks, which look for all of them at once in one pass over the texts. More of
    them are joined by a key, so that texts only meet needles that they can contain: a
    needle may begin and end inside a word, hence its key is the words between its first and last one, KEY_WORDS at most,
    among the runs of as many words of the texts; needles of one or two words are found by their first SHORT_KEY characters at
    every place. A filter of fixed size keeps most runs that are no key in their row.
    """
    hay = haystacks.select(doc, fold(F.col(column)).alias("__hay"))
    if automaton.sendable(found, "needle"):
        met = automaton.containing(hay, doc, "__hay", found, "needle")
        return met.join(found, "needle").select(doc, key, "needle", "whole").distinct()
    return _joined(hay, doc, found, key)


def _joined(hay: DataFrame, doc: str, found: DataFrame, key: str) -> DataFrame:
    words = F.split("needle", " ")
    inner = F.least(F.size(words) - 2, F.lit(KEY_WORDS))
    between = F.array_join(F.slice(words, F.lit(2), F.greatest(inner, F.lit(0))), " ")
    keyed = found.withColumn("__n", F.greatest(inner, F.lit(0))).withColumn("__key", F.when(inner > 0, between).otherwise(F.substring("needle", 1, SHORT_KEY)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    # 65,536 numbers of 64 bits, whatever the number of keys.
    parts = keyed.select(place("__key").alias("at")).distinct().groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    filled = parts.sparkSession.range(FILTER_BITS >> 6).join(parts, F.col("id") == F.col("word"), "left")
    bits = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("__bits"))
    filtered = hay.join(F.broadcast(bits), F.lit(True))  # one row of 512 KB
    pairs = None
    for n in range(KEY_WORDS + 1):
        own = keyed.where(F.col("__n") == n)
        runs = T.word_runs(F.col("__hay"), n) if n else T.char_runs(F.col("__hay"), SHORT_KEY)
        may = F.filter(runs, lambda r: F.expr("__bits") [F.shiftright(place(r), 6).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), place(r).bitwiseAND(F.lit(63)).cast("int"))) != 0)
        met = filtered.select(doc, F.explode(may).alias("__key")).join(own, "__key").select(doc, key, "needle", "whole")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct().join(hay, doc).where(F.contains("__hay", F.col("needle"))).select(doc, key, "needle", "whole").distinct()


# Sentences of these sources aren't looked for in texts of these roles.
EXEMPT = (("weather_metar", "factual_narrative"), ("docket_documents", "factual_narrative"))


def case_leaks(evidence: DataFrame, withheld: DataFrame, codes: DataFrame, case: str, least: int = 20, exempt=EXEMPT) -> DataFrame:
    """(case, role, kind, source, fragment) of what a case's evidence (case, role, text) holds of the case's own withheld
    texts (case, source, text) and ``codes`` (case, code): kind is text, sentence or code.

    Evidence and needles meet by case, each side as one row a role or source; codes count as whole words. Null and empty texts, and codes of spaces, hold
    and are nothing."""
    hay = evidence.select(case, "role", T.fold_forms(F.col("text")).alias("__hay")).where("__hay <> ''")
    rows = withheld.select(case, "source", T.fold_forms(F.col("text")).alias("__folded")).where("__folded <> ''")
    bare = T.trim_marks(F.col("__folded"))
    sentence = F.transform(F.filter(T.sentences_of(F.col("__folded"), least, T.NOTICE), lambda s: s != bare), lambda s: F.struct(F.lit("sentence").alias("kind"), s.alias("needle")))
    text = F.filter(F.array(F.struct(F.lit("text").alias("kind"), bare.alias("needle"))), lambda n: F.length(n["needle"]) >= least)
    sides = rows.select(case, "source", F.concat(text, sentence).alias("__needles"))
    spared = F.lit(False)
    for role, source in exempt:
        spared = spared | ((F.col("role") == role) & (F.col("source") == source))
    inside = F.filter("__needles", lambda n: F.contains(F.col("__hay"), n["needle"]) & ~((n["kind"] == "sentence") & spared))
    found = hay.join(sides, case).select(case, "role", "source", F.explode(inside).alias("n")).select(case, "role", F.col("n.kind").alias("kind"), "source", F.col("n.needle").alias("fragment"))
    own = codes.where(F.trim("code") != "").groupBy(case).agg(F.collect_set("code").alias("__codes"))
    # A code is compared with folded text as it is: one with a capital letter can't be found, as in the texts all letters are small.
    whole = F.filter("__codes", lambda c: F.regexp_like(F.col("__hay"), F.concat(F.lit("(?U)\\b\\Q"), c, F.lit("\\E\\b"))))
    coded = hay.join(own, case).select(case, "role", F.lit("code").alias("kind"), F.lit("codes").alias("source"), F.explode(whole).alias("fragment"))
    return found.unionByName(coded)


def screened(found: DataFrame, marked=(("docket_documents", "analysis_narrative"),)) -> DataFrame:
    """case_leaks with ``route``: sentences of the marked (role, source) pairs are marks, all else leaks, which refuse the case."""
    mark = F.lit(False)
    for role, source in marked:
        mark = mark | ((F.col("kind") == "sentence") & (F.col("role") == role) & (F.col("source") == source))
    return found.withColumn("route", F.when(mark, "mark").otherwise("leak"))


def routed(matches: DataFrame, doc: str, key: str, total: DataFrame) -> DataFrame:
    """Per (doc, key): found needles, their share of all the key's, and whether it is a
    leak (the whole text, or half of the sentences) or only a mark."""
    m = matches.groupBy(doc, key).agg(F.count(F.lit(1)).alias("n_found"), F.bool_or("whole").alias("whole"))
    share = F.col("n_found") / F.col("n_needles")
    return m.join(total, key).select(doc, key, "n_found", share.alias("share"), F.when(F.col("whole") | (share >= 0.5), "leak").otherwise("mark").alias("kind"))
