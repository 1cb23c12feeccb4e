"""Lookups over a pool of coded cases, habits, agreement by digits and misses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions.stats import rounded
from caseloom.operators import pools, ranking, selection
from caseloom.operators.ranking import top_per_group
from caseloom.sources.tables import table

from .analogues import CASES, LINES, SCORED, cases, lines, scored
from .registry import query


def _sets(spark, d):
    """Distinct (case, code) with whether the code defines the case somewhere."""
    return lines(spark, d).groupBy("case_id", "code").agg(F.bool_or("defining").alias("defining"))


_SETS = f"""{LINES}, sets AS (SELECT case_id, code, bool_or(defining) AS defining FROM lines GROUP BY ALL)"""


@query("R5_occurrence_usage", f"""WITH {_SETS}, u AS (SELECT code, count(*) AS present, count(*) FILTER (defining) AS defining FROM sets GROUP BY code),
ph AS (SELECT substr(code, 4) AS event, substr(code, 1, 3) AS phase, count(*) AS n FROM sets WHERE defining GROUP BY ALL), top AS (SELECT event, list(phase || ':' || n ORDER BY r) AS phases FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY n DESC, phase) AS r FROM ph) WHERE r <= 3 GROUP BY event)
SELECT code, present, defining, round(defining / present, 6) AS share, coalesce(array_to_string(phases, ' '), '') AS phases FROM u LEFT JOIN top ON top.event = substr(u.code, 4)""")
def occurrence_usage(spark, d):
    """Of each code: how many cases have it, how many it defines, and the phases in which its event defines most often."""
    sets = _sets(spark, d)
    used = sets.groupBy("code").agg(F.count(F.lit(1)).alias("present"), F.count_if("defining").alias("defining"))
    phases = sets.where("defining").groupBy(F.substring("code", 4, 3).alias("event"), F.substring("code", 1, 3).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    three = top_per_group(phases, ["event"], [F.desc("n"), "phase"], 3)
    told = three.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "phase", F.col("n").cast("string")).alias("t")))).alias("x"))  # three at most
    text = F.coalesce(F.array_join(F.transform("x", lambda x: x["t"]), " "), F.lit(""))
    return used.join(told, F.substring("code", 4, 3) == F.col("event"), "left").select("code", "present", "defining", rounded(F.col("defining") / F.col("present")).alias("share"), text.alias("phases"))


@query("R5_usage_pairs", f"""WITH {_SETS} SELECT a.code AS a, b.code AS b, count(*) AS n_both, count(*) FILTER (a.defining) AS a_defining, count(*) FILTER (b.defining) AS b_defining FROM sets a JOIN sets b ON a.case_id = b.case_id AND a.code < b.code GROUP BY ALL HAVING count(*) >= 2""")
def usage_pairs(spark, d):
    """Pairs of codes that two cases or more hold: how many hold both, and how often each is the defining one."""
    sets = pools.by_case(lines(spark, d), table(spark, d, "lineitem").count()).groupBy("case_id", "code").agg(F.bool_or("defining").alias("defining"))
    own = sets.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("code", "defining"))).alias("codes"))  # a case has a few codes
    pair = F.flatten(F.transform("codes", lambda x, i: F.transform(F.slice("codes", i + 2, F.greatest(F.size("codes") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = own.select(F.explode(pair).alias("p")).groupBy(F.col("p.x.code").alias("a"), F.col("p.y.code").alias("b"))
    return rows.agg(F.count(F.lit(1)).alias("n_both"), F.count_if("p.x.defining").alias("a_defining"), F.count_if("p.y.defining").alias("b_defining")).where("n_both >= 2")


@query("R5_past_findings", f"""WITH {_SETS}, ev AS (SELECT DISTINCT case_id, substr(code, 4) AS event FROM sets WHERE defining), n AS (SELECT event, count(*) AS n_cases FROM ev GROUP BY event),
f AS (SELECT event, finding, count(*) AS n FROM ev JOIN (SELECT DISTINCT case_id, finding FROM lines WHERE quantity >= 25) USING (case_id) GROUP BY ALL)
SELECT event, finding, n, CAST(r AS INTEGER) AS rank, round(n / n_cases, 6) AS share, n_cases < 20 AS few FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY n DESC, finding) AS r FROM f) JOIN n USING (event) WHERE r <= 10""")
def past_findings(spark, d):
    """The ten commonest flagged findings of the cases that an event defines, with their share and a warning for fewer than 20 cases."""
    events = _sets(spark, d).where("defining").select("case_id", F.substring("code", 4, 3).alias("event")).distinct()
    flagged = lines(spark, d).where("quantity >= 25").select("case_id", "finding").distinct()
    n = events.groupBy("event").agg(F.count(F.lit(1)).alias("n_cases"))
    counted = events.join(flagged, "case_id").groupBy("event", "finding").agg(F.count(F.lit(1)).alias("n"))
    ten = top_per_group(counted, ["event"], [F.desc("n"), "finding"], 10).join(n, "event")
    return ten.select("event", "finding", "n", "rank", rounded(F.col("n") / F.col("n_cases")).alias("share"), (F.col("n_cases") < 20).alias("few"))


@query("R6_habits_at_60", f"""WITH {LINES}, c AS (SELECT substr(code, 4) AS event, CASE WHEN defining THEN 'first' ELSE 'later' END AS v, count(*) AS n FROM lines GROUP BY ALL), g AS (SELECT event, arg_min(v, (-n, v)) AS best, max(n) AS best_n, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY event),
w AS (SELECT arg_min(v, (-n, v)) AS common FROM (SELECT v, sum(n) AS n FROM c GROUP BY v))
SELECT event, best, best_n, total, CASE WHEN total < 20 THEN 'too few' WHEN 10 * best_n >= 6 * total THEN 'clear' ELSE 'plain' END AS habit, best = common AS toward_common FROM g, w""")
def habits_at_60(spark, d):
    """Of each event its commonest place, and whether that is a clear habit (60 of 100 in at least 20, by whole numbers), and the
    commonest one over all."""
    c = lines(spark, d).groupBy(F.substring("code", 4, 3).alias("event"), F.when(F.col("defining"), "first").otherwise("later").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("event").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("best"), F.max("n").alias("best_n"), F.sum("n").alias("total"))
    common = c.groupBy("v").agg(F.sum("n").alias("n")).agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("common"))
    habit = F.when(F.col("total") < 20, "too few").when(10 * F.col("best_n") >= 6 * F.col("total"), "clear").otherwise("plain")
    return g.join(F.broadcast(common), F.lit(True)).select("event", "best", "best_n", "total", habit.alias("habit"), (F.col("best") == F.col("common")).alias("toward_common"))  # one row


@query("A43_agreement_by_digits", f"""WITH {SCORED}, f AS (SELECT customer, true_findings[1] AS finding FROM scored WHERE len(true_findings) > 0), x AS (SELECT CAST(digits AS INTEGER) AS digits, customer, substr(finding, 1, digits) AS prefix, count(*) AS n FROM f, (SELECT unnest([10, 8, 6, 3]) AS digits) GROUP BY ALL),
own AS (SELECT digits, sum(n * (n - 1) // 2) AS same FROM x GROUP BY digits), grp AS (SELECT digits, sum(n * (n - 1) // 2) AS pairs, sum(n) AS total, count(*) FILTER (n = 1) AS singles FROM (SELECT digits, customer, sum(n) AS n FROM x GROUP BY ALL) GROUP BY digits),
pool AS (SELECT digits, sum(n * (n - 1) // 2) AS same FROM (SELECT digits, prefix, sum(n) AS n FROM x GROUP BY ALL) GROUP BY digits)
SELECT digits, CAST(grp.pairs AS BIGINT) AS n_pairs, CAST(own.same AS BIGINT) AS n_same, CAST(singles AS BIGINT) AS n_singles, round(own.same / grp.pairs, 6) AS share, round((pool.same - own.same) / (total * (total - 1) / 2 - grp.pairs), 6) AS control FROM own JOIN grp USING (digits) JOIN pool USING (digits)""")
def agreement_by_digits(spark, d):
    """How often two cases of one group have the same first finding at 10, 8, 6 and 3 digits, and how often two of different groups do.

    Cases are read once; counts of (digits, group, prefix) give groups, pool and the pool less each group's own pairs."""
    f = scored(spark, d).where(F.size("true_findings") > 0).select("customer", F.get("true_findings", F.lit(0)).alias("finding"))
    each = f.select("customer", F.explode(F.array(*[F.struct(F.lit(k).alias("digits"), F.substring("finding", 1, k).alias("prefix")) for k in (10, 8, 6, 3)])).alias("x"))
    x = each.groupBy("x.digits", "customer", "x.prefix").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) div 2"))
    own = x.groupBy("digits").agg(pairs("n").alias("same"))
    groups = x.groupBy("digits", "customer").agg(F.sum("n").alias("n")).groupBy("digits").agg(pairs("n").alias("pairs"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n_singles"))
    pool = x.groupBy("digits", "prefix").agg(F.sum("n").alias("n")).groupBy("digits").agg(pairs("n").alias("pooled"))
    joined = own.join(groups, "digits").join(pool, "digits")
    others = F.col("total") * (F.col("total") - 1) / 2 - F.col("pairs")
    return joined.select("digits", F.col("pairs").alias("n_pairs"), F.col("same").alias("n_same"), "n_singles", rounded(F.col("same") / F.col("pairs")).alias("share"), rounded((F.col("pooled") - F.col("same")) / others).alias("control"))


_GROUPS = "CASE WHEN failed THEN 'failed' WHEN abstained THEN 'abstained' WHEN hit1 THEN 'right' WHEN hit3 THEN 'lower' WHEN substr(guesses[1], 1, 3) = substr(truth, 1, 3) THEN 'same phase' WHEN substr(guesses[1], 4) = substr(truth, 4) THEN 'same event' ELSE 'other' END"


@query("A23_miss_groups", f"""WITH {SCORED}, g AS (SELECT {_GROUPS} AS kind, confidence, len(guesses) AS n_guesses FROM scored)
SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 6) AS rate, round(quantile_cont(confidence, 0.5), 6) AS median_confidence, count(*) FILTER (n_guesses = 1) AS one_guess, count(*) FILTER (n_guesses = 2) AS two_guesses, count(*) FILTER (n_guesses >= 3) AS three_guesses FROM g GROUP BY kind""")
def miss_groups(spark, d):
    """Each miss group's rate, its answers by length and its median confidence; the median by selection, so that no task holds a group."""
    first = F.get("guesses", F.lit(0))
    kind = (
        F.when(F.col("failed"), "failed").when(F.col("abstained"), "abstained").when(F.col("hit1"), "right").when(F.col("hit3"), "lower")
        .when(F.substring(first, 1, 3) == F.substring("truth", 1, 3), "same phase").when(F.substring(first, 4, 3) == F.substring("truth", 4, 3), "same event").otherwise("other")
    )
    rows = scored(spark, d).select(kind.alias("kind"), "confidence", F.size("guesses").alias("k"))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 1).alias("one_guess"), F.count_if(F.col("k") == 2).alias("two_guesses"), F.count_if(F.col("k") >= 3).alias("three_guesses"))
    medians = selection.quantiles(rows, ["kind"], "confidence", {"median": 0.5}, interpolated=True).select("kind", rounded(F.col("median")).alias("median_confidence"))
    rate = rounded(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("rate")  # a row a group
    return counts.join(medians, "kind").select("kind", "n", rate, "median_confidence", "one_guess", "two_guesses", "three_guesses")


@query("T14_even_draw", f"""WITH {CASES}, k AS (SELECT priority, row_number() OVER (ORDER BY priority) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT priority FROM cases)), r AS (SELECT priority, case_id, row_number() OVER (PARTITION BY priority ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS r FROM cases),
fk AS (SELECT total > 250000 AS fatal, row_number() OVER (PARTITION BY total > 250000 ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS r, case_id FROM cases)
SELECT 'priority ' || priority AS stratum, case_id FROM r JOIN k USING (priority) WHERE r <= 62 // m + CASE WHEN i <= 62 % m THEN 1 ELSE 0 END UNION ALL SELECT CASE WHEN fatal THEN 'fatal' ELSE 'other' END, case_id FROM fk WHERE r <= CASE WHEN fatal THEN 12 ELSE 13 END""")
def even_draw(spark, d):
    """62 cases dealt over the priorities as evenly as possible, and 25 over fatal and other ones, in a keyed order."""
    own = cases(spark, d)
    order = [F.md5(F.col("case_id").cast("string")), F.col("case_id")]
    by_priority = ranking.even_draw(own.select("priority", "case_id"), "priority", order, 62).select(F.concat(F.lit("priority "), "priority").alias("stratum"), "case_id")
    kind = F.when(F.col("total") > 250000, "fatal").otherwise("other")
    # The remainder goes to the first stratum by name; here it is to be the other one.
    by_kind = ranking.even_draw(own.select(F.when(kind == "other", 0).otherwise(1).alias("k"), "case_id"), "k", order, 25).select(F.when(F.col("k") == 0, "other").otherwise("fatal").alias("stratum"), "case_id")
    return by_priority.unionByName(by_kind)


@query("T4_model_order", f"""WITH {LINES}, o AS (SELECT case_id, code, floor(quantity / 10) / 10 AS p, seq, 0 AS none FROM lines UNION ALL SELECT DISTINCT case_id, 'none', 0.3, 0, 1 FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, none DESC, seq, code) AS r FROM o)
SELECT case_id, list(code ORDER BY r) AS ranked FROM r WHERE r <= 3 GROUP BY case_id""")
def model_order(spark, d):
    """The three likeliest answers: equal chances in the model's order, but none of these before any other."""
    rows = lines(spark, d)
    given = rows.select("case_id", "code", (F.floor(F.col("quantity") / 10) / 10).alias("p"), "seq", F.lit(0).alias("none"))
    none = rows.select("case_id").distinct().select("case_id", F.lit("none").alias("code"), F.lit(0.3).alias("p"), F.lit(0).alias("seq"), F.lit(1).alias("none"))
    three = top_per_group(given.unionByName(none), ["case_id"], [F.desc("p"), F.desc("none"), "seq", "code"], 3)
    return three.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("ranked"))  # three at most


@query("A47_admissible_cut", r"""WITH w AS (SELECT lang, source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_words FROM documents GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_words DESC, source) AS r FROM w),
c AS (SELECT *, min(CASE WHEN n_docs < 5 THEN r END) OVER (PARTITION BY lang) AS stop FROM o) SELECT lang, source, n_docs, n_words, CAST(r AS INTEGER) AS rank, stop IS NULL OR r < stop AS admitted FROM c""")
def admissible_cut(spark, d):
    """Sources of a language from the largest down, admitted until the first that has too few documents; what comes after it isn't, however many it has."""
    words = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n_words")
    w = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), words)
    line = Window.partitionBy("lang").orderBy(F.desc("n_words"), F.asc_nulls_last("source"))  # a row a source
    o = w.withColumn("rank", F.row_number().over(line))
    stop = F.min(F.when(F.col("n_docs") < 5, F.col("rank"))).over(Window.partitionBy("lang"))
    return o.withColumn("stop", stop).select("lang", "source", "n_docs", "n_words", "rank", (F.col("stop").isNull() | (F.col("rank") < F.col("stop"))).alias("admitted"))


@query("A53_grades", f"""WITH {SCORED}, g AS (SELECT CASE WHEN failed THEN 'not coded: failed' WHEN abstained THEN 'not coded: abstained' WHEN hit1 THEN 'same' WHEN hit3 THEN 'other order' ELSE 'different' END AS grade, event_date FROM scored WHERE status = 'F')
SELECT grade, count(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day, count(DISTINCT event_date) AS n_days FROM g GROUP BY grade""")
def grades(spark, d):
    """Closed cases by grade, with the kinds of those that weren't coded, and the nights over which they closed."""
    grade = F.when(F.col("failed"), "not coded: failed").when(F.col("abstained"), "not coded: abstained").when(F.col("hit1"), "same").when(F.col("hit3"), "other order").otherwise("different")
    g = scored(spark, d).where("status = 'F'").groupBy(grade.alias("grade"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"), F.countDistinct("event_date").alias("n_days"))
