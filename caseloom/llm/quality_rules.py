"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document. Its failure sets one bit; the
measurements it read are kept beside the bits. A policy is a named version of
a bit mask, so that a change of policy, or the ablation of one rule, is integer
arithmetic over the ledger and never touches a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, let, table

SYMBOLS = "[#*$%&|<>]"
SPAN = 3


def _spans_covered(w: Column) -> Column:
    """Words of the array ``w`` in SPAN-word windows that occur twice or more in it.

    Windows are packed as 44 bits of hash and 20 bits of position, so that one
    sort of longs brings equal windows side by side in order of position; each
    neighbour with the same bits is then compared word by word. A text with a
    collision of those bits, or with 2^20 words or more, sorts the windows'
    strings instead.
    """
    at = F.sequence(F.lit(0), F.size(w) - SPAN)
    low = (1 << 20) - 1
    word = lambda i, k: F.get(w, (i + k).cast("int"))
    place = lambda x: x.bitwiseAND(F.lit(low))
    bits = lambda x: F.shiftright(x, 20)

    def spread(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(SPAN), (F.get(p, j + 1) - x).cast("int")), F.lit(SPAN)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def beside(flags: Column, item) -> Column:
        """Sorted places whose window equals the one before (flag 1) or after."""
        hit = F.transform(flags, lambda f, j: F.when((f == 1) | (F.get(flags, j + 1) == 1), item(j)))
        return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

    def by_hash(p: Column) -> Column:
        def flag(x: Column, j: Column) -> Column:
            y = F.get(p, j - 1)
            same = (word(place(x), 0) == word(place(y), 0)) & (word(place(x), 1) == word(place(y), 1)) & (word(place(x), 2) == word(place(y), 2))
            return F.when(bits(x) != bits(y), F.lit(0)).when(same, F.lit(1)).when(y.isNull(), F.lit(0)).otherwise(F.lit(2))

        def judge(flags: Column) -> Column:
            return F.when(F.array_contains(flags, 2), by_string()).otherwise(let(beside(flags, lambda j: place(F.get(p, j))), spread))

        return let(F.transform(p, flag), judge)

    def by_string() -> Column:
        grams = F.transform(at, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SPAN)]).alias("g"), i.cast("long").alias("i")))
        flags = lambda s: F.transform(s, lambda x, j: F.when(F.get(s, j - 1)["g"] == x["g"], F.lit(1)).otherwise(F.lit(0)))
        return let(F.sort_array(grams), lambda s: let(flags(s), lambda f: let(beside(f, lambda j: F.get(s, j)["i"]), spread)))

    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SPAN)]))
    packed = lambda h: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    # Equal windows have equal hashes: where all hashes differ there is nothing to sort.
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(F.size(h) > low, by_string()).otherwise(let(packed(h), by_hash))
    return F.when(F.size(w) < SPAN, F.lit(0)).otherwise(let(hashes, some))


def measurements(text: Column) -> Column:
    """Struct of counts over the whole text; null and empty texts measure 0.

    Everything is computed inside the row, in n log n of the text's length, and
    nothing is shuffled.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\\n"), lambda x: x.rlike(WORD))
    long = lambda c, name: c.cast("long").alias(name)
    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: let(
            lines,
            lambda x: F.struct(
                long(F.size(w), "n_words"),
                long(F.length(F.array_join(w, "")), "word_chars"),
                long(F.regexp_count(text, F.lit(SYMBOLS)), "n_symbols"),
                long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"),
                long(_spans_covered(w), "n_repeat_words"),
                long(F.size(x), "n_lines"),
                long(F.regexp_count(text, F.lit("[A-Z]")), "n_upper"),
            ),
        ),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: A rule's place in this tuple is its bit for good: append, never reorder.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_spans", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("shouting", "n_upper * 2 > word_chars"),
    Rule("no_words", "n_words = 0"),
)
#: Policy versions: the rules that reject.
POLICIES = {
    "v1": ("too_few_words", "repeated_spans"),
    "v2": ("too_few_words", "repeated_spans", "symbol_heavy", "duplicate_lines", "word_length", "shouting", "no_words"),
}


def mask(names) -> int:
    known = [r.name for r in RULES]
    return sum(1 << known.index(n) for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: one row for every row of docs.

    Nulls measure as empty text, repeated rows stay, other columns are ignored.
    """
    read = docs.select("doc_id", measurements(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return read.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, those that fail nothing
    else, and those that would be kept without it.

    The ledger shrinks to one count for each distinct mask before the rules are
    looked at, so the shuffle carries at most 2^rules rows from a task.
    """
    wanted = mask(POLICIES[version])
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(wanted)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in RULES]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[version]]))
    each = masks.select("bits", "n", rules.alias("r"))
    hit, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total(hit)("n_failed"), total(hit & (rest == 0))("n_only"), total(rest == 0)("n_kept_without"))


def op1_quality_rules(spark, sf_dir):
    kept = apply_policy(ledger(table(spark, sf_dir, "documents")), "v2")
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["v1"]))) != 0
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
cov AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN n_upper * 2 > word_chars THEN 32 ELSE 0 END)
    + (CASE WHEN n_words = 0 THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
