"""Scoring: hit rates with intervals, set precision, slices, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions import codes, stats
from caseloom.functions.stats import rounded, share, wilson, wilson_sql
from caseloom.operators import selection

from .analogues import ANSWERS, CASES, LINES, SCORED, answers, cases, scored
from .registry import query

_LO, _HI = wilson_sql("hits", "n")


def _with_bounds(df, h="hits", n="n"):
    lo, hi = wilson(F.col(h), F.col(n))
    return df.withColumn("share", rounded(share(F.col(h), F.col(n)))).withColumn("low", rounded(lo)).withColumn("high", rounded(hi))


@query("A2_hit_rate_wilson", f"""WITH {SCORED}, g AS (SELECT split, count(*) AS n, count(*) FILTER (hit1) AS hits FROM scored GROUP BY split)
SELECT split, n, hits, round(hits / n, 6) AS share, {_LO} AS low, {_HI} AS high FROM g""")
def hit_rate(spark, d):
    """First-guess hit rate of each split with its Wilson interval."""
    return _with_bounds(scored(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), stats.hits(F.col("hit1")).alias("hits")))


@query("A1_build_counts", f"""WITH {CASES}, k AS (SELECT split, CASE WHEN event_date IS NULL THEN 'no date' WHEN status = 'P' THEN 'not completed' WHEN priority = '5-LOW' THEN 'not watched' WHEN year(event_date) < 1996 THEN 'too early' END AS reason FROM cases)
SELECT split, coalesce(reason, 'kept') AS reason, count(*) AS n FROM k GROUP BY ALL""")
def build_counts(spark, d):
    """Cases by split and by the first reason that excludes them."""
    reason = F.coalesce(
        F.when(F.col("event_date").isNull(), "no date"), F.when(F.col("status") == "P", "not completed"), F.when(F.col("priority") == "5-LOW", "not watched"),
        F.when(F.year("event_date") < 1996, "too early"), F.lit("kept"),
    )
    return cases(spark, d).groupBy("split", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_PR = """pr AS (SELECT case_id, k, abstained, list_distinct(list_transform(guessed_findings, lambda x: substr(x, 1, k))) AS g, list_distinct(list_transform(true_findings, lambda x: substr(x, 1, k))) AS t
  FROM scored, (SELECT unnest([10, 8, 6]) AS k)),
pr2 AS (SELECT case_id, k, CASE WHEN abstained THEN CASE WHEN len(t) > 0 THEN 0.0 END WHEN len(g) > 0 THEN len(list_intersect(g, t)) / len(g) END AS p,
  CASE WHEN len(t) > 0 THEN CASE WHEN abstained THEN 0.0 ELSE len(list_intersect(g, t)) / len(t) END END AS r FROM pr)"""


@query("A6_prefix_precision_recall", f"""WITH {SCORED}, {_PR}
SELECT CAST(k AS INTEGER) AS digits, count(p) AS n_precision, count(r) AS n_recall, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM pr2 GROUP BY k""")
def prefix_precision_recall(spark, d):
    """Mean precision and recall of finding sets at 10, 8 and 6 digits; null rows don't count."""
    rows = scored(spark, d)
    at = []
    for k in (10, 8, 6):
        g, t = codes.prefixes(F.col("guessed_findings"), k), codes.prefixes(F.col("true_findings"), k)
        at.append(F.struct(F.lit(k).alias("digits"), codes.precision(g, t, F.col("abstained")).alias("p"), codes.recall(g, t, F.col("abstained")).alias("r")))
    each = rows.select(F.explode(F.array(*at)).alias("x")).select("x.*")
    return each.groupBy("digits").agg(F.count("p").alias("n_precision"), F.count("r").alias("n_recall"), rounded(F.avg("p")).alias("precision"), rounded(F.avg("r")).alias("recall"))


@query("A7_score_case", f"""WITH {SCORED}
SELECT case_id, truth, guesses[1] AS first_guess, hit1, hit3, NOT (abstained OR failed) AND substr(guesses[1], 4, 3) = substr(truth, 4, 3) AS event_hit,
  CAST(len(guesses) AS INTEGER) AS n_guesses, CAST(len(list_intersect(guessed_findings, true_findings)) AS INTEGER) AS findings_right FROM scored""")
def score_case(spark, d):
    """The scoring columns of every case."""
    event = lambda c: F.substring(c, 4, 3)
    first = F.get("guesses", F.lit(0))
    return scored(spark, d).select(
        "case_id", "truth", first.alias("first_guess"), "hit1", "hit3", (~(F.col("abstained") | F.col("failed")) & (event(first) == event(F.col("truth")))).alias("event_hit"),
        F.size("guesses").alias("n_guesses"), F.size(F.array_intersect("guessed_findings", "true_findings")).alias("findings_right"),
    )


@query("A8_rescore_reordered", f"""WITH {SCORED}, r AS (SELECT *, guesses[len(guesses)] AS last FROM scored)
SELECT case_id, CASE WHEN abstained THEN false ELSE last = truth END AS rescored, hit3 AS any_hit FROM r""")
def rescore(spark, d):
    """Scores after the guesses are turned round: an abstained case stays unanswered."""
    last = F.element_at("guesses", -1)
    return scored(spark, d).select("case_id", F.when(F.col("abstained"), F.lit(False)).otherwise(last == F.col("truth")).alias("rescored"), F.col("hit3").alias("any_hit"))


@query("A10_reliability_ece", f"""WITH {SCORED}, b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CASE WHEN hit3 THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored WHERE NOT abstained GROUP BY 1),
e AS (SELECT round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 6) AS ece FROM b)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy, ece FROM range(10) AS r(i) LEFT JOIN b ON b.bin = r.i, e""")
def reliability(spark, d):
    """Ten confidence bins, empty ones kept, and the expected calibration error."""
    rows = scored(spark, d).where(~F.col("abstained"))
    bins = rows.groupBy(stats.bin_of(F.col("confidence")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("hit3").cast("double")).alias("a"))
    all_bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    ece = F.sum(F.coalesce(F.col("n") * F.abs(F.col("c") - F.col("a")), F.lit(0.0))).over(Window.partitionBy()) / F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())
    return all_bins.join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), rounded(F.col("c")).alias("mean_confidence"), rounded(F.col("a")).alias("accuracy"), rounded(ece).alias("ece"))


@query("A11_stated_actual_agreement", f"""WITH {SCORED}, s AS (SELECT CASE WHEN confidence >= 0.66 THEN 1 WHEN confidence >= 0.33 THEN 0 ELSE -1 END AS stated, CASE WHEN hit1 THEN 1 WHEN hit3 THEN 0 ELSE -1 END AS actual FROM scored),
m AS (SELECT v, (SELECT count(*) FROM s WHERE stated = v) / (SELECT count(*) FROM s) AS ps, (SELECT count(*) FROM s WHERE actual = v) / (SELECT count(*) FROM s) AS pa FROM (SELECT unnest([-1, 0, 1]) AS v))
SELECT (SELECT count(*) FROM s) AS n, round((SELECT count(*) FROM s WHERE stated = actual) / (SELECT count(*) FROM s), 6) AS agreement, round(sum(ps * pa), 6) AS by_chance FROM m""")
def agreement(spark, d):
    """How often the stated level equals the actual one, and what chance alone gives."""
    c = F.col("confidence")
    s = scored(spark, d).select(F.when(c >= 0.66, 1).when(c >= 0.33, 0).otherwise(-1).alias("stated"), F.when(F.col("hit1"), 1).when(F.col("hit3"), 0).otherwise(-1).alias("actual"))
    count = lambda col, v: F.count_if(F.col(col) == v)
    g = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stated") == F.col("actual")).alias("same"), *[count(x, v).alias(f"{x}{v + 1}") for x in ("stated", "actual") for v in (-1, 0, 1)])
    chance = sum((F.col(f"stated{v}") * F.col(f"actual{v}") for v in range(3)), F.lit(0)) / (F.col("n") * F.col("n"))
    return g.select("n", rounded(F.col("same") / F.col("n")).alias("agreement"), rounded(chance).alias("by_chance"))


_SLICES = """sl AS (SELECT s.*, unnest(['all', CASE WHEN total > 250000 THEN 'fatal' ELSE 'non-fatal' END, 'class ' || substr(priority, 1, 1), 'flavour ' || status]) AS slice FROM scored s)"""


def slice_labels(total, priority, status):
    """The overlapping groups that a case belongs to."""
    return F.array(F.lit("all"), F.when(total > 250000, "fatal").otherwise("non-fatal"), F.concat(F.lit("class "), F.substring(priority, 1, 1)), F.concat(F.lit("flavour "), status))


@query("A12_slices", f"""WITH {SCORED}, {_SLICES}, g AS (SELECT slice, count(*) AS n, count(*) FILTER (hit1) AS hits FROM sl GROUP BY slice)
SELECT slice, n, hits, round(hits / n, 6) AS share, {_LO} AS low, {_HI} AS high FROM g""")
def slices(spark, d):
    """Hit rates of overlapping slices: each case goes into each of its four."""
    rows = scored(spark, d).select("hit1", F.explode(slice_labels(F.col("total"), F.col("priority"), F.col("status"))).alias("slice"))
    return _with_bounds(rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit1").alias("hits")))


@query("A13_summary_report", f"""WITH {SCORED}, {_SLICES}
SELECT slice, count(*) AS n, count(*) FILTER (abstained) AS n_abstained, count(*) FILTER (failed) AS n_failed, count(*) FILTER (hit1) AS n_hit1, count(*) FILTER (hit3) AS n_hit3,
  round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN NOT abstained THEN confidence END), 6) AS answered_confidence, count(DISTINCT truth) AS n_codes, round(avg(len(true_findings)), 6) AS mean_true, round(avg(len(guessed_findings)), 6) AS mean_guessed FROM sl GROUP BY slice""")
def summary(spark, d):
    """One report row a slice."""
    rows = scored(spark, d).withColumn("slice", F.explode(slice_labels(F.col("total"), F.col("priority"), F.col("status"))))
    return rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("n_abstained"), F.count_if("failed").alias("n_failed"), F.count_if("hit1").alias("n_hit1"), F.count_if("hit3").alias("n_hit3"),
        rounded(F.avg("confidence")).alias("mean_confidence"), rounded(F.avg(F.when(~F.col("abstained"), F.col("confidence")))).alias("answered_confidence"), F.countDistinct("truth").alias("n_codes"),
        rounded(F.avg(F.size("true_findings"))).alias("mean_true"), rounded(F.avg(F.size("guessed_findings"))).alias("mean_guessed"),
    )


_CURVE = """steps AS (SELECT CAST(i AS INTEGER) AS step, i * 5 / 100.0 AS threshold FROM range(1, 20) AS r(i)),
curve AS (SELECT step, threshold, sum(CASE WHEN abstained OR failed OR confidence < threshold THEN 0 WHEN hit3 THEN 1 ELSE -1 END) / count(*) AS value FROM scored, steps GROUP BY ALL)"""


def _curve(spark, d):
    """Mean of +1 (right), -1 (wrong), 0 (not answered) at each threshold, over all cases.

    Cases are first counted by confidence step, so that the thresholds meet at most 20 rows."""
    c = F.col("confidence")
    step = F.least(F.floor(F.round(c * 20, 9)), F.lit(20)).cast("int")
    gone = F.col("abstained") | F.col("failed")
    counted = scored(spark, d).groupBy(step.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(gone, 0).when(F.col("hit3"), 1).otherwise(-1)).alias("gain"))
    steps = spark.range(1, 20).select(F.col("id").cast("int").alias("step"))
    joined = steps.join(F.broadcast(counted), F.lit(True))  # 19 by at most 21 rows
    return joined.groupBy("step").agg((F.sum(F.when(F.col("at") >= F.col("step"), F.col("gain")).otherwise(0)) / F.sum("n")).alias("value")).withColumn("threshold", F.col("step") * 5 / 100.0)


@query("A14_threshold_curve", f"""WITH {SCORED}, {_CURVE} SELECT step, threshold, round(value, 6) AS value FROM curve""")
def threshold_curve(spark, d):
    return _curve(spark, d).select("step", "threshold", rounded(F.col("value")).alias("value"))


@query("A14_best_threshold", f"""WITH {SCORED}, {_CURVE} SELECT step, threshold, round(value, 6) AS value FROM curve ORDER BY round(value, 9) DESC, step LIMIT 1""")
def best_threshold(spark, d):
    """The smallest threshold of the greatest value."""
    best = _curve(spark, d).agg(F.max_by(F.struct("step", "threshold", "value"), F.struct(F.round("value", 9), -F.col("step"))).alias("b"))
    return best.select("b.step", "b.threshold", rounded(F.col("b.value")).alias("value"))


@query("A15_failures_by_reason", """WITH f AS (SELECT event_type || ':' || CAST(user_id % 5 AS VARCHAR) AS error FROM events WHERE event_type IN ('error', 'view'))
SELECT split_part(error, ':', 1) AS reason, count(*) AS n, count(DISTINCT error) AS kinds FROM f GROUP BY 1""")
def failures(spark, d):
    """Failures by what stands before the colon of their message."""
    from caseloom.sources.tables import table

    error = F.concat_ws(":", "event_type", (F.col("user_id") % 5).cast("string"))
    rows = table(spark, d, "events").where(F.col("event_type").isin("error", "view")).select(error.alias("error"))
    return rows.groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("error").alias("kinds"))


@query("A5_stratified_headline", f"""WITH {SCORED}, g AS (SELECT total > 250000 AS fatal, avg(CASE WHEN hit3 THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM scored GROUP BY 1)
SELECT round(sum(a * CASE WHEN fatal THEN 727 / 4241.0 ELSE 3514 / 4241.0 END), 6) AS weighted, CAST(sum(n) AS BIGINT) AS n FROM g""")
def headline(spark, d):
    """The hit rate reweighted to the population's share of the two strata."""
    g = scored(spark, d).groupBy((F.col("total") > 250000).alias("fatal")).agg(F.avg(F.col("hit3").cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("fatal"), F.lit(727 / 4241)).otherwise(F.lit(3514 / 4241))
    return g.agg(rounded(F.sum(F.col("a") * weight)).alias("weighted"), F.sum("n").alias("n"))


@query("A9_movement", """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, day, sum(n) AS t FROM c GROUP BY ALL),
p AS (SELECT user_id, day, event_type, n / t AS p FROM c JOIN t USING (user_id, day)), days AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM t),
u AS (SELECT d.user_id, d.day, p.event_type, p.p AS now, 0.0 AS was FROM days d JOIN p ON p.user_id = d.user_id AND p.day = d.day WHERE before IS NOT NULL
  UNION ALL SELECT d.user_id, d.day, p.event_type, 0.0, p.p FROM days d JOIN p ON p.user_id = d.user_id AND p.day = d.before)
SELECT user_id, day, round(0.5 * sum(abs(x)), 6) AS moved FROM (SELECT user_id, day, event_type, sum(now) - sum(was) AS x FROM u GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT user_id, day, 0.0 FROM days WHERE before IS NULL""")
def movement(spark, d):
    """Half the summed change of each step's distribution over the union of its and the
    step's before it; a first step moves 0."""
    from caseloom.sources.tables import table

    c = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id", "day")))
    maps = p.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("now"))  # one entry a type
    was = F.lag("now").over(Window.partitionBy("user_id").orderBy("day"))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    keys = F.array_union(F.map_keys("now"), F.map_keys("was"))
    total = F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.abs(at(F.col("now"), k) - at(F.col("was"), k)))
    return maps.withColumn("was", was).select("user_id", "day", F.when(F.col("was").isNull(), F.lit(0.0)).otherwise(rounded(0.5 * total)).alias("moved"))


@query("A22_miss_groups", f"""WITH {SCORED}
, m AS (SELECT CASE WHEN failed THEN 'failed' WHEN abstained THEN 'abstained' WHEN hit1 THEN 'right' WHEN hit3 THEN 'in top three' WHEN len(list_filter(guesses, lambda g: substr(g, 4, 3) = substr(truth, 4, 3))) > 0 THEN 'same event' WHEN len(list_filter(guesses, lambda g: substr(g, 1, 3) = substr(truth, 1, 3))) > 0 THEN 'same phase' ELSE 'elsewhere' END AS grp, confidence FROM scored)
SELECT grp, count(*) AS n, round(quantile_cont(confidence, 0.5), 6) AS median_confidence FROM m GROUP BY grp""")
def miss_groups(spark, d):
    """Every case in the first group that fits, with the group's interpolated median confidence."""
    near = lambda at: F.exists("guesses", lambda g: F.substring(g, at, 3) == F.substring(F.col("truth"), at, 3))
    grp = F.when(F.col("failed"), "failed").when(F.col("abstained"), "abstained").when(F.col("hit1"), "right").when(F.col("hit3"), "in top three").when(near(4), "same event").when(near(1), "same phase").otherwise("elsewhere")
    medians = selection.quantiles(scored(spark, d).select(grp.alias("grp"), "confidence"), ["grp"], "confidence", {"median": 0.5}, interpolated=True)
    return medians.select("grp", "n", rounded(F.col("median")).alias("median_confidence"))


@query("A22_finding_depth", f"""WITH {SCORED}, t AS (SELECT case_id, guessed_findings, unnest(true_findings) AS f FROM scored)
SELECT CAST(CASE WHEN len(list_filter(guessed_findings, lambda g: g = f)) > 0 THEN 10 WHEN len(list_filter(guessed_findings, lambda g: substr(g,1,8) = substr(f,1,8))) > 0 THEN 8 WHEN len(list_filter(guessed_findings, lambda g: substr(g,1,6) = substr(f,1,6))) > 0 THEN 6 WHEN len(list_filter(guessed_findings, lambda g: substr(g,1,3) = substr(f,1,3))) > 0 THEN 3 ELSE 0 END AS INTEGER) AS depth, count(*) AS n FROM t GROUP BY 1""")
def finding_depth(spark, d):
    """How many leading digits of each true finding some guess shares."""
    rows = answers(spark, d).join(cases(spark, d).select("case_id"), "case_id").select("guessed_findings", F.explode("true_findings").alias("f"))
    return rows.groupBy(codes.deepest_shared(F.col("f"), F.col("guessed_findings")).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("A23_commonest_miss_pairs", f"""WITH {SCORED} SELECT truth, guesses[1] AS guess, count(*) AS n FROM scored WHERE NOT hit1 AND NOT abstained AND NOT failed GROUP BY ALL ORDER BY n DESC, truth, guess LIMIT 20""")
def miss_pairs(spark, d):
    """The 20 commonest (truth, first guess) misses."""
    rows = scored(spark, d).where(~F.col("hit1") & ~F.col("abstained") & ~F.col("failed"))
    return rows.groupBy("truth", F.get("guesses", F.lit(0)).alias("guess")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "truth", "guess").limit(20)


@query("A25_nearest_rank_percentiles", f"""WITH {CASES} SELECT split, count(*) AS n, CASE WHEN count(*) >= 3 THEN quantile_disc(total, 0.5) END AS p50, CASE WHEN count(*) >= 3 THEN quantile_disc(total, 0.9) END AS p90, CASE WHEN count(*) >= 3 THEN quantile_disc(total, 0.99) END AS p99 FROM cases GROUP BY split""")
def percentiles(spark, d):
    """Nearest-rank quantiles; suppressed for fewer than 3 cases."""
    return cases(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[stats.nearest_rank("total", q).alias(name) for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])


@query("A26_shape_scan", """WITH d AS (SELECT source, lang, n_chars, CASE WHEN n_chars < 50 THEN 'scan' WHEN n_chars > 300 THEN 'born digital' ELSE 'partial' END AS kind FROM documents)
SELECT lang, kind, count(*) AS n, quantile_disc(n_chars, 0.5) AS median_chars, CAST(max(n_chars) AS BIGINT) AS most_chars, count(DISTINCT source) AS n_sources FROM d GROUP BY ALL""")
def shape_scan(spark, d):
    """Documents by stratum and readability kind, with their sizes."""
    from caseloom.functions.text import document_kind
    from caseloom.sources.tables import table

    rows = table(spark, d, "documents").select("lang", document_kind(F.col("n_chars")).alias("kind"), "n_chars", "source")
    sizes = rows.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most_chars"), F.countDistinct("source").alias("n_sources"))
    medians = selection.quantiles(rows, ["lang", "kind"], "n_chars", {"median_chars": 0.5}).select(F.col("lang").alias("l"), F.col("kind").alias("k"), "median_chars")
    return sizes.join(medians, F.col("lang").eqNullSafe(F.col("l")) & F.col("kind").eqNullSafe(F.col("k"))).select("lang", "kind", "n", "median_chars", "most_chars", "n_sources")


@query("A28_three_groups", f"""WITH {SCORED}, g AS (SELECT ntile(3) OVER (ORDER BY confidence, case_id) AS grp, confidence, hit3 FROM scored WHERE NOT abstained), h AS (SELECT grp, count(*) AS n, count(*) FILTER (hit3) AS hits, avg(confidence) AS c FROM g GROUP BY grp)
SELECT CAST(grp AS INTEGER) AS grp, n, hits, round(c, 6) AS mean_confidence, {wilson_sql("hits", "n", "2.3939797998")[0]} AS low, {wilson_sql("hits", "n", "2.3939797998")[1]} AS high FROM h""")
def three_groups(spark, d):
    """Three equal groups by confidence, bounds at the level shared among them.

    The n-tile comes from a range partitioning: each partition's offset is a prefix sum
    over partition sizes, so that no single task sorts all cases."""
    from caseloom.operators.ranking import global_ntile

    rows = scored(spark, d).where(~F.col("abstained")).select("case_id", "confidence", "hit3")
    g = global_ntile(rows, 3, ["confidence", "case_id"], "grp").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit3").alias("hits"), F.avg("confidence").alias("c"))
    lo, hi = wilson(F.col("hits"), F.col("n"), 2.3939797998)
    return g.select("grp", "n", "hits", rounded(F.col("c")).alias("mean_confidence"), rounded(lo).alias("low"), rounded(hi).alias("high"))


@query("A30_outcome_ladder", """WITH o AS (SELECT o_orderpriority AS metric, avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END) - 0.5 AS mean, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT metric, mean, mean - 1.96 * sqrt(0.25 / n) AS low, mean + 1.96 * sqrt(0.25 / n) AS high FROM o)
SELECT metric, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 THEN 'beats' WHEN low > -0.06 THEN 'matches' WHEN high < 0 THEN 'worse' ELSE 'undecided' END AS outcome FROM b""")
def outcome_ladder(spark, d):
    """What a difference and its interval mean, the first rule that holds."""
    from caseloom.sources.tables import table

    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg((F.col("o_totalprice") > 250000).cast("double")) - 0.5).alias("mean"), F.count(F.lit(1)).alias("n"))
    half = 1.96 * F.sqrt(F.lit(0.25) / F.col("n"))
    rows = rows.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)
    outcome = F.when(F.col("low") > 0, "beats").when(F.col("low") > -0.06, "matches").when(F.col("high") < 0, "worse").otherwise("undecided")
    return rows.select("metric", rounded(F.col("mean")).alias("mean"), rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), outcome.alias("outcome"))


@query("A29_failure_policy", f"""WITH {SCORED}, p AS (SELECT split, CASE WHEN failed AND case_id % 2 = 0 THEN NULL WHEN failed THEN 0.0 WHEN hit3 THEN 1.0 ELSE 0.0 END AS v FROM scored) SELECT split, count(v) AS n, count(*) - count(v) AS removed, round(avg(v), 6) AS mean FROM p GROUP BY split""")
def failure_policy(spark, d):
    """Refused cases leave the metric, other failures count as wrong."""
    v = F.when(F.col("failed") & (F.col("case_id") % 2 == 0), F.lit(None)).when(F.col("failed"), F.lit(0.0)).otherwise(F.col("hit3").cast("double"))
    return scored(spark, d).select("split", v.alias("v")).groupBy("split").agg(F.count("v").alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("removed"), rounded(F.avg("v")).alias("mean"))


@query("A67_live_outcomes", f"""WITH {SCORED}, k AS (SELECT split, CASE WHEN failed THEN 'not coded' WHEN status = 'P' THEN 'awaiting' WHEN abstained THEN 'abstained' WHEN hit1 THEN 'right' ELSE 'wrong' END AS outcome FROM scored), g AS (SELECT split, count(*) FILTER (outcome <> 'awaiting') AS n, count(*) FILTER (outcome = 'right') AS hits, count(*) FILTER (outcome = 'awaiting') AS awaiting FROM k GROUP BY split)
SELECT split, n, hits, awaiting, round(hits / n, 6) AS share, {_LO} AS low, {_HI} AS high FROM g""")
def live_outcomes(spark, d):
    """Outcomes where only cases with a verdict count: those not coded count as wrong."""
    outcome = F.when(F.col("failed"), "not coded").when(F.col("status") == "P", "awaiting").when(F.col("abstained"), "abstained").when(F.col("hit1"), "right").otherwise("wrong")
    k = scored(spark, d).select("split", outcome.alias("outcome"))
    g = k.groupBy("split").agg(F.count_if(F.col("outcome") != "awaiting").alias("n"), F.count_if(F.col("outcome") == "right").alias("hits"), F.count_if(F.col("outcome") == "awaiting").alias("awaiting"))
    return _with_bounds(g)


@query("A68_confidence_bands", f"""WITH {SCORED} SELECT CASE WHEN confidence < 0.25 THEN 'below .25' WHEN confidence < 0.5 THEN '.25-.5' WHEN confidence < 0.75 THEN '.5-.75' ELSE '.75 and above' END AS band, count(*) FILTER (hit3) AS n_right, count(*) FILTER (NOT hit3) AS n_wrong FROM scored GROUP BY 1""")
def confidence_bands(spark, d):
    """Right and wrong answers by band of confidence; the last one is open above."""
    c = F.col("confidence")
    band = F.when(c < 0.25, "below .25").when(c < 0.5, ".25-.5").when(c < 0.75, ".5-.75").otherwise(".75 and above")
    return scored(spark, d).groupBy(band.alias("band")).agg(F.count_if("hit3").alias("n_right"), F.count_if(~F.col("hit3")).alias("n_wrong"))


@query("A73_crosstab_margins", f"""WITH {CASES} SELECT coalesce(split, 'all') AS split, coalesce(priority, 'all') AS priority, count(*) AS n, round(avg(total), 4) AS mean_total FROM cases GROUP BY CUBE (split, priority)""")
def crosstab(spark, d):
    """Two-way counts and means with both margins and the grand total."""
    return cases(spark, d).cube("split", "priority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 4).alias("mean_total")).select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("priority", F.lit("all")).alias("priority"), "n", "mean_total")


@query("A76_interpolated_quantiles", f"""WITH {CASES} SELECT priority, round(quantile_cont(total, 0.5), 4) AS median, round(quantile_cont(total, 0.9), 4) AS p90 FROM cases GROUP BY priority""")
def interpolated(spark, d):
    return cases(spark, d).groupBy("priority").agg(F.round(F.percentile("total", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("total", F.lit(0.9)), 4).alias("p90"))


@query("A78_range_conformance", f"""WITH {CASES} SELECT split, count(*) FILTER (event_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') AS n_outside, min(event_date) AS first_date, max(event_date) AS last_date FROM cases GROUP BY split""")
def range_conformance(spark, d):
    outside = ~F.col("event_date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    return cases(spark, d).groupBy("split").agg(F.count_if(outside).alias("n_outside"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@query("A79_cost_scenarios", f"""WITH {CASES}, {LINES}, t AS (SELECT split, CAST(sum(CAST(quantity AS BIGINT)) AS BIGINT) AS tokens FROM cases JOIN lines USING (case_id) GROUP BY split), p AS (SELECT unnest(['low', 'mid', 'high']) AS plan, unnest([0.5, 1.25, 5.0]) AS price)
SELECT split, plan, tokens, round(tokens * price / 1000000, 6) AS cost, tokens * price / 1000000 > 1 AS over_cap FROM t, p""")
def cost_scenarios(spark, d):
    """Every stratum under every price: three rows of prices are crossed with three strata."""
    from .analogues import lines

    t = cases(spark, d).select("case_id", "split").join(lines(spark, d).select("case_id", "quantity"), "case_id").groupBy("split").agg(F.sum(F.col("quantity").cast("long")).alias("tokens"))
    prices = spark.createDataFrame([("low", 0.5), ("mid", 1.25), ("high", 5.0)], "plan string, price double")
    cost = F.col("tokens") * F.col("price") / 1000000
    return t.join(F.broadcast(prices), F.lit(True)).select("split", "plan", "tokens", rounded(cost).alias("cost"), (cost > 1).alias("over_cap"))
