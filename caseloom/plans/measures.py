"""Whole score rows and reports, precedents with their controls, sentences inside other texts, withheld paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions import codes, paths, stats
from caseloom.functions import text as T
from caseloom.functions.stats import rounded
from caseloom.operators import census, inference, pools
from caseloom.sources.tables import table

from .analogues import SCORED, lines, scored
from .registry import query
from .scoring import slice_labels
from .texts import _BM, _bm25

_PART = "list_distinct(list_transform({0}, lambda x: substr(x, 1, {1})))"


def _pr_sql(guess: str, truth: str, digits: int, name: str) -> str:
    g, t = _PART.format(guess, digits), _PART.format(truth, digits)
    both = f"len(list_intersect({g}, {t}))"
    return f"""CASE WHEN abstained THEN CASE WHEN len({t}) > 0 THEN 0.0 END WHEN len({g}) > 0 THEN {both} / len({g}) END AS p{name}, CASE WHEN len({t}) > 0 THEN CASE WHEN abstained THEN 0.0 ELSE {both} / len({t}) END END AS r{name}"""


#: Every column of a scored case; a case that failed has none. Pairs are seen if some development case has the code as its truth.
_SCORES = f"""{SCORED}, every AS (SELECT case_id, list(DISTINCT finding) AS all_findings, round(sum(price) / 1e6, 9) AS cost FROM lines GROUP BY case_id),
seen AS (SELECT DISTINCT truth AS code FROM scored WHERE split = 'dev'),
x AS (SELECT s.case_id, split, total, priority, status, failed, cost, abstained, confidence, NOT abstained AND guesses[1] = truth AS top1, NOT abstained AND list_contains(guesses, truth) AS top3,
  NOT abstained AND substr(guesses[1], 4) = substr(truth, 4) AS event_match, seen.code IS NULL AS pair_unseen,
  {_pr_sql('guessed_findings', 'true_findings', 10, '10')}, {_pr_sql('guessed_findings', 'true_findings', 8, '8')}, {_pr_sql('guessed_findings', 'true_findings', 6, '6')}, {_pr_sql('guessed_findings', 'all_findings', 10, 'all')}
  FROM scored s JOIN every USING (case_id) LEFT JOIN seen ON seen.code = s.guesses[1])"""
_VALUES = ("p10", "r10", "p8", "r8", "p6", "r6", "pall", "rall")


def score_columns(spark, d):
    """The scoring columns of each case beside its group columns. An abstained case isn't right and has precision and recall 0, not null,
    where the truth has codes."""
    rows = scored(spark, d)
    # A case has a few lines.
    every = lines(spark, d).groupBy("case_id").agg(F.collect_set("finding").alias("all_findings"), F.round(F.sum("price") / 1e6, 9).alias("cost"))
    seen = rows.where("split = 'dev'").select(F.col("truth").alias("code")).distinct().withColumn("known", F.lit(True))
    first, answered = F.get("guesses", F.lit(0)), ~F.col("abstained")
    event = lambda c: F.substring(c, 4, 3)
    out = []
    for truth, digits, name in (("true_findings", 10, "10"), ("true_findings", 8, "8"), ("true_findings", 6, "6"), ("all_findings", 10, "all")):
        g, t = codes.prefixes(F.col("guessed_findings"), digits), codes.prefixes(F.col(truth), digits)
        out += [codes.precision(g, t, F.col("abstained")).alias(f"p{name}"), codes.recall(g, t, F.col("abstained")).alias(f"r{name}")]
    joined = rows.join(every, "case_id").join(seen, first == F.col("code"), "left")
    return joined.select(
        "case_id", "split", "total", "priority", "status", "failed", "cost", "abstained", "confidence", (answered & (first == F.col("truth"))).alias("top1"), (answered & F.array_contains("guesses", F.col("truth"))).alias("top3"),
        (answered & (event(first) == event(F.col("truth")))).alias("event_match"), F.col("known").isNull().alias("pair_unseen"), *out,
    )


@query("A7_score_columns", f"""WITH {_SCORES} SELECT case_id, top1, top3, event_match, pair_unseen, {', '.join(f'round({v}, 6) AS {v}' for v in _VALUES)}, abstained, confidence FROM x WHERE NOT failed""")
def score_rows(spark, d):
    """All fourteen scoring columns of every scored case."""
    return score_columns(spark, d).where(~F.col("failed")).select("case_id", "top1", "top3", "event_match", "pair_unseen", *[rounded(F.col(v)).alias(v) for v in _VALUES], "abstained", "confidence")


_SHARES = (("top1", "top1", "true"), ("top3", "top3", "true"), ("event_match", "event", "true"), ("pair_unseen", "unseen", "true"), ("abstained", "abstain", "true"), ("top1", "answered", "NOT abstained"))


def _share_sql() -> str:
    out = []
    for flag, name, where in _SHARES:
        h, n = f"count(*) FILTER (NOT failed AND {where} AND {flag})", f"count(*) FILTER (NOT failed AND {where})"
        lo, hi = stats.wilson_sql(f"h_{name}", f"n_{name}")
        out.append((f"{h} AS h_{name}, {n} AS n_{name}", f"round(h_{name} / n_{name}, 6) AS {name}, {lo} AS {name}_low, {hi} AS {name}_high"))
    return ", ".join(x[0] for x in out), ", ".join(x[1] for x in out)


_MEANS = tuple(v for v in _VALUES if v != "pall")


@query("A13_report_columns", f"""WITH {_SCORES}, sl AS (SELECT x.*, unnest(['all', CASE WHEN total > 250000 THEN 'fatal' ELSE 'non-fatal' END, 'class ' || substr(priority, 1, 1), 'flavour ' || status]) AS slice FROM x),
g AS (SELECT slice, count(*) FILTER (NOT failed) AS n, {_share_sql()[0]}, {', '.join(f'round(avg({v}) FILTER (NOT failed), 6) AS {v}, count({v}) FILTER (NOT failed) AS n_{v}' for v in _MEANS)}, count(*) FILTER (failed) AS n_failed, count(*) AS n_all, round(avg(cost), 6) AS cost FROM sl GROUP BY slice)
SELECT slice, n, {_share_sql()[1]}, {', '.join(f'{v}, n_{v}' for v in _MEANS)}, n_failed, n_all, cost FROM g""")
def report_columns(spark, d):
    """All columns of the report, one row a slice: shares with their intervals, means with their counts, failures and cost. Each case
    is read once and goes into its four slices after it is scored."""
    rows = score_columns(spark, d).withColumn("slice", F.explode(slice_labels(F.col("total"), F.col("priority"), F.col("status"))))
    fine = ~F.col("failed")
    aggs = [F.count_if(fine).alias("n")]
    for flag, name, where in _SHARES:
        base = fine & F.expr(where)
        aggs += [F.count_if(base & F.col(flag)).alias(f"h_{name}"), F.count_if(base).alias(f"n_{name}")]
    for v in _MEANS:
        own = F.when(fine, F.col(v))
        aggs += [rounded(F.avg(own)).alias(v), F.count(own).alias(f"n_{v}")]
    g = rows.groupBy("slice").agg(*aggs, F.count_if("failed").alias("n_failed"), F.count(F.lit(1)).alias("n_all"), rounded(F.avg("cost")).alias("cost"))
    shares = []
    for _, name, _ in _SHARES:
        low, high = stats.wilson(F.col(f"h_{name}"), F.col(f"n_{name}"))
        shares += [rounded(F.col(f"h_{name}") / F.col(f"n_{name}")).alias(name), rounded(low).alias(f"{name}_low"), rounded(high).alias(f"{name}_high")]
    return g.select("slice", "n", *shares, *[c for v in _MEANS for c in (v, f"n_{v}")], "n_failed", "n_all", "cost")


@query("A4_paired_interval")
def paired_interval(spark, d):
    """Mean difference of two runs over the same cases with the percentile interval of 2,000 resamples."""
    rows = scored(spark, d)
    run = lambda c: rows.select("case_id", "split", F.col(c).cast("double").alias("v"))
    return inference.paired_interval(run("hit1"), run("hit3"), "case_id", "split", "v")


_CODE = "lpad(CAST({0} % 47 AS VARCHAR), 3, '0') || lpad(CAST({0} % 93 AS VARCHAR), 3, '0')"


def _code(c):
    return F.concat(F.lpad((c % 47).cast("string"), 3, "0"), F.lpad((c % 93).cast("string"), 3, "0"))


_POOL = f"""pool AS (SELECT day, {_CODE.format('doc_id')} AS code FROM d), ask AS (SELECT item_id, day, {_CODE.format('item_id')} AS truth, substr({_CODE.format('(item_id + 1)')}, 1, 3) AS phase FROM q)"""


@query("R2_precedent_measures", f"""WITH {_BM}, {_POOL},
t AS (SELECT item_id, doc_id, {_CODE.format('doc_id')} AS code, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s), five AS (SELECT * FROM t WHERE r <= 5),
m AS (SELECT item_id, code FROM (SELECT item_id, code, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, min(r)) AS o FROM five GROUP BY item_id, code) WHERE o = 1),
h AS (SELECT a.item_id, coalesce(bool_or(f.code = truth), false) AS found, coalesce(bool_or(f.code = truth AND r = 1), false) AS nearest, coalesce(bool_or(m.code = truth), false) AS majority, coalesce(bool_or(substr(f.code, 4) = substr(truth, 4)), false) AS event
  FROM ask a LEFT JOIN five f ON f.item_id = a.item_id LEFT JOIN m ON m.item_id = a.item_id GROUP BY a.item_id),
c AS (SELECT a.item_id, p.code, count(*) AS n, substr(p.code, 1, 3) = a.phase AS inside FROM ask a JOIN pool p ON p.day < a.day GROUP BY ALL),
k AS (SELECT item_id, code FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, code) AS o FROM c) WHERE o <= 5), ki AS (SELECT item_id, code FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, code) AS o FROM c WHERE inside) WHERE o <= 5)
SELECT h.*, EXISTS (SELECT 1 FROM k WHERE k.item_id = h.item_id AND k.code = a.truth) AS control, EXISTS (SELECT 1 FROM ki WHERE ki.item_id = h.item_id AND ki.code = a.truth) AS phase_control FROM h JOIN ask a USING (item_id)""")
def precedent_measures(spark, d):
    """Of each query: whether its code is among those of the five nearest earlier documents, the nearest one's, the commonest of the five
    (of equally common ones the best ranked), or shares its event; and whether it is among the five commonest codes of all earlier documents, or of those of the answer's phase."""
    ask = table(spark, d, "benchmark").select("item_id", ((F.col("item_id") + 1) * 2).alias("day"), _code(F.col("item_id")).alias("truth"), F.substring(_code(F.col("item_id") + 1), 1, 3).alias("phase"))
    line = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    five = _bm25(spark, d).withColumn("r", F.row_number().over(line)).where("r <= 5").select("item_id", "r", _code(F.col("doc_id")).alias("code"))
    each = five.groupBy("item_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r"))
    of = each.groupBy("item_id").agg(F.collect_set("code").alias("codes"), F.min_by("code", "r").alias("first"), F.min_by("code", F.struct(-F.col("n"), F.col("r"))).alias("most"))  # five at most
    past = pools.commonest_as_of(table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("day"), _code(F.col("doc_id")).alias("code")), "day", "code", ask.select("day"))
    commonest = lambda rows, keys: pools.top(rows, keys, 5)
    known = ask.join(past, "day").select("item_id", "truth", "phase", "code", "n")
    hit = lambda rows, name: commonest(rows, ["item_id"]).groupBy("item_id").agg(F.bool_or(F.col("code") == F.col("truth")).alias(name))
    out = ask.join(of, "item_id", "left").join(hit(known, "control"), "item_id", "left").join(hit(known.where(F.substring("code", 1, 3) == F.col("phase")), "phase_control"), "item_id", "left")
    yes = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    event = lambda c: F.substring(c, 4, 3)
    return out.select(
        "item_id", yes(F.array_contains("codes", F.col("truth")), "found"), yes(F.col("first") == F.col("truth"), "nearest"), yes(F.col("most") == F.col("truth"), "majority"),
        yes(F.exists("codes", lambda c: event(c) == event(F.col("truth"))), "event"), yes(F.col("control"), "control"), yes(F.col("phase_control"), "phase_control"),
    )


_INNER = r"""trim(regexp_replace(translate(translate({0}, '‘’‚‛“”„‟', '''''''''""""'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+', ' ', 'g'))"""


@query("A59_sentences_inside", rf"""WITH f AS (SELECT doc_id, {_INNER.format('text')} AS folded FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, folded, list_filter(string_split(regexp_replace(regexp_replace(folded, '([.!?;]) ', '\1' || chr(1), 'g'), '([.!?])([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(x) >= 40) AS parts FROM f)
SELECT a.doc_id, CAST(len(a.parts) AS INTEGER) AS n_sentences, round(CASE WHEN len(a.parts) = 0 THEN 0.0 ELSE len(list_filter(a.parts, lambda x: contains(b.folded, x))) / len(a.parts) END, 6) AS share FROM s a JOIN f b ON b.doc_id = a.doc_id + 1""")
def sentences_inside(spark, d):
    """Of each document, the share of its long sentences that the following document holds word for word, wherever they begin there."""
    folded = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.fold(F.col("text")).alias("folded"))
    parts = F.filter(F.split("folded", T.SENTENCE_END), lambda s: F.length(s) >= 40)
    one = folded.select("doc_id", parts.alias("parts"))
    other = folded.select((F.col("doc_id") - 1).alias("doc_id"), F.col("folded").alias("other"))
    n = F.size("parts")
    held = F.size(F.filter("parts", lambda s: F.contains(F.col("other"), s)))
    return one.join(other, "doc_id").select("doc_id", n.alias("n_sentences"), rounded(F.when(n == 0, F.lit(0.0)).otherwise(held / n)).alias("share"))


@query("P2_withheld_paths", """WITH p(path, n) AS (SELECT 'case', count(*) FROM orders UNION ALL SELECT 'who.customer', count(*) FROM orders UNION ALL SELECT 'who.cust', count(*) FROM orders UNION ALL SELECT 'lines[].part', count(*) FROM lineitem UNION ALL SELECT 'lines[].price.gross', count(*) FROM lineitem UNION ALL SELECT 'lines', n FROM (SELECT count(*) AS n FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey) WHERE n > 0)
SELECT path, n, path IN ('who.cust', 'lines', 'lines[].price.gross') AS withheld FROM p""")
def withheld_paths(spark, d):
    """Which leaf paths of nested records overlap a withheld path either way: lines' prices (and lines that are null), and who.cust, but not who.customer."""
    part = F.struct(F.col("l_partkey").alias("part"), F.struct(F.col("l_extendedprice").alias("gross")).alias("price"))
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(part).alias("lines"))
    record = F.struct(F.col("o_orderkey").alias("case"), F.struct(F.col("o_custkey").alias("customer"), F.lit(1).alias("cust")).alias("who"), "lines")
    found = census.leaf_paths(table(spark, d, "orders").join(own, "o_orderkey", "left").select(F.to_variant_object(record).alias("record")), "record")
    return found.select("path", "n", paths.overlaps_any(F.col("path"), ["lines[0].price", "who.cust.name"]).alias("withheld"))
