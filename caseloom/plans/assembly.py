"""Builds, paired runs, exports and draws that join what the other plans compute."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions.stats import rounded
from caseloom.sources import store
from caseloom.sources.tables import table

from .analogues import CASES, LINES, SCORED, cases, lines, scored
from .history import SNAPS, snapshots
from .registry import query
from .texts import _BM, _bm25

_LADDER = "CASE WHEN event_date IS NULL THEN 'no date' WHEN status = 'P' THEN 'not completed' WHEN priority = '5-LOW' THEN 'not watched' WHEN year(event_date) < 1996 THEN 'too early' END"


@query("S9_build_processed", f"""WITH {CASES}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY event_date DESC, case_id) AS r FROM cases) WHERE r = 1) SELECT customer, case_id, event_date, split, status FROM n WHERE {_LADDER} IS NULL""")
def build_processed(spark, d):
    """The processed table: the newest copy of each key, if no reason of the ladder excludes it."""
    rows = store.newest(cases(spark, d).withColumn("first", -F.col("case_id")), "customer", ["event_date", "first"])
    return rows.where(F.expr(_LADDER).isNull()).select("customer", "case_id", "event_date", "split", "status")


@query("S9_build_excluded", f"""WITH {CASES}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY event_date DESC, case_id) AS r FROM cases) WHERE r = 1) SELECT {_LADDER} AS reason, count(*) AS n FROM n WHERE {_LADDER} IS NOT NULL GROUP BY 1""")
def build_excluded(spark, d):
    """What the build leaves out, by first reason."""
    rows = store.newest(cases(spark, d).withColumn("first", -F.col("case_id")), "customer", ["event_date", "first"])
    return rows.select(F.expr(_LADDER).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("J2_prelim_arrivals", f"""WITH {SNAPS}, e AS (SELECT user_id, CAST(ts AS DATE) AS run, bool_or(event_type = 'purchase') AS has FROM events GROUP BY ALL), l AS (SELECT *, lag(run) OVER (PARTITION BY user_id ORDER BY run) AS absent_run, min(run) OVER (PARTITION BY user_id) AS first_run FROM e),
f AS (SELECT user_id, min(run) AS run FROM e WHERE has GROUP BY user_id), c AS (SELECT user_id, min(run) AS closure FROM snaps WHERE status = 'error' GROUP BY user_id)
SELECT l.user_id, l.run, l.absent_run, date_diff('day', first_run, l.run) AS days, date_diff('day', first_run, absent_run) AS absent_days, CASE WHEN closure IS NULL THEN 'open' WHEN l.run < closure THEN 'before closure' ELSE 'after closure' END AS classification
FROM l JOIN f ON l.user_id = f.user_id AND l.run = f.run LEFT JOIN c ON c.user_id = l.user_id WHERE absent_run IS NOT NULL""")
def prelim_arrivals(spark, d):
    """First arrival of a key's first report with a known absent side: days after the key's first run on either side, and how it lies to the closure."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("run")).agg(F.bool_or(F.col("event_type") == "purchase").alias("has"))
    line = Window.partitionBy("user_id").orderBy("run")  # one row a key and day
    seen = F.count_if("has").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = e.select("user_id", "run", "has", F.lag("run").over(line).alias("absent_run"), F.first("run").over(line).alias("first_run"), seen.alias("before"))
    rows = rows.where("has and absent_run is not null and before = 0")
    closures = snapshots(spark, d).where("status = 'error'").groupBy("user_id").agg(F.min("run").alias("closure"))
    days = lambda c: F.datediff(c, "first_run").cast("long")
    kind = F.when(F.col("closure").isNull(), "open").when(F.col("run") < F.col("closure"), "before closure").otherwise("after closure")
    return rows.join(closures, "user_id", "left").select("user_id", "run", "absent_run", days("run").alias("days"), days("absent_run").alias("absent_days"), kind.alias("classification"))


@query("J19_first_code_changes", f"""WITH {SCORED}, a AS (SELECT case_id, guesses[1] AS c, guesses[1] = truth AS hit FROM scored WHERE NOT failed), b AS (SELECT case_id, guesses[len(guesses)] AS c, guesses[len(guesses)] = truth AS hit FROM scored WHERE NOT abstained)
SELECT count(*) AS shared, count(*) FILTER (a.c <> b.c) AS changed, count(*) FILTER (a.c <> b.c AND a.hit AND NOT b.hit) AS fixes, count(*) FILTER (a.c <> b.c AND b.hit AND NOT a.hit) AS breaks FROM a JOIN b USING (case_id)""")
def first_code_changes(spark, d):
    """Over the cases that both runs scored: first codes that differ, and of those the ones that one run alone has right."""
    s = scored(spark, d)
    first, last = F.get("guesses", F.lit(0)), F.element_at("guesses", -1)
    a = s.where(~F.col("failed")).select("case_id", first.alias("a"), (first == F.col("truth")).alias("a_hit"))
    b = s.where(~F.col("abstained")).select("case_id", last.alias("b"), (last == F.col("truth")).alias("b_hit"))
    changed = F.col("a") != F.col("b")
    return a.join(b, "case_id").agg(F.count(F.lit(1)).alias("shared"), F.count_if(changed).alias("changed"), F.count_if(changed & F.col("a_hit") & ~F.col("b_hit")).alias("fixes"), F.count_if(changed & F.col("b_hit") & ~F.col("a_hit")).alias("breaks"))


@query("J25_export_assembly", f"""WITH {SCORED}, k AS (SELECT case_id, list(CAST(seq AS VARCHAR) || ':' || code || ':' || linestatus ORDER BY seq, code, linestatus) AS codes, list(DISTINCT shipped ORDER BY shipped) AS calls FROM lines GROUP BY case_id)
SELECT case_id, event_date, CASE WHEN failed THEN 'not coded' WHEN abstained THEN 'abstained' WHEN hit1 THEN 'same' WHEN hit3 THEN 'other order' ELSE 'different' END AS grade, guesses AS beliefs, codes, list_transform(calls, lambda x: CAST(x AS VARCHAR)) AS calls FROM scored JOIN k USING (case_id)""")
def export_assembly(spark, d):
    """One nested record a case: its grade, its beliefs, its codes in order and the days of its calls."""
    code = F.struct("seq", "code", "linestatus")
    k = lines(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(code)).alias("codes"), F.array_sort(F.collect_set("shipped")).alias("calls"))  # a case has a few lines
    grade = F.when(F.col("failed"), "not coded").when(F.col("abstained"), "abstained").when(F.col("hit1"), "same").when(F.col("hit3"), "other order").otherwise("different")
    codes = F.transform("codes", lambda x: F.concat_ws(":", x["seq"].cast("string"), x["code"], x["linestatus"]))
    return scored(spark, d).join(k, "case_id").select("case_id", "event_date", grade.alias("grade"), F.col("guesses").alias("beliefs"), codes.alias("codes"), F.transform("calls", lambda x: x.cast("string")).alias("calls"))


@query("J26_pages_with_readings", """WITH r AS (SELECT doc_id, quality FROM labels) SELECT p.page_id, r.quality IS NOT NULL AS cached, r.quality AS reading FROM pages p LEFT JOIN r ON r.doc_id = p.page_id""")
def pages_with_readings(spark, d):
    """Every page with its cached reading; a page without one keeps a null."""
    r = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("reading"))
    return table(spark, d, "pages").select("page_id").join(r, "page_id", "left").select("page_id", F.col("reading").isNotNull().alias("cached"), "reading")


@query("J28_judge_against_codes", f"""WITH {SCORED}, j AS (SELECT case_id, status AS label FROM cases WHERE NOT failed), s AS (SELECT case_id, hit1 FROM scored WHERE NOT abstained)
SELECT coalesce(label, 'none') AS label, count(*) FILTER (hit1) AS top1_right, count(*) FILTER (NOT hit1) AS top1_wrong, count(*) FILTER (label IS NULL OR hit1 IS NULL) AS unpaired FROM j FULL JOIN s ON j.case_id = s.case_id GROUP BY 1""")
def judge_against_codes(spark, d):
    """The judge's label of a case against its code score, joined by the case's id; what has no partner is counted, never zipped away."""
    j = cases(spark, d).where(~F.col("failed")).select("case_id", F.col("status").alias("label"))
    both = j.join(scored(spark, d).where(~F.col("abstained")).select("case_id", "hit1"), "case_id", "full_outer")
    alone = F.col("label").isNull() | F.col("hit1").isNull()
    return both.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count_if("hit1").alias("top1_right"), F.count_if(~F.col("hit1")).alias("top1_wrong"), F.count_if(alone).alias("unpaired"))


@query("T5_smallest_first", """SELECT l_orderkey AS docket, list(l_linenumber ORDER BY l_quantity, l_linenumber) AS admitted FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey""")
def smallest_first(spark, d):
    """The documents of a docket that were read, by tokens and then place in the listing."""
    read = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    admitted = F.transform(F.array_sort(F.collect_list(F.struct("l_quantity", "l_linenumber"))), lambda x: x["l_linenumber"])
    return read.groupBy(F.col("l_orderkey").alias("docket")).agg(admitted.alias("admitted"))  # a docket has a few


@query("T13_disagreement_sample", f"""WITH {SCORED} SELECT case_id, status, hit1 FROM scored WHERE (status = 'F') <> hit1 ORDER BY md5(CAST(case_id AS VARCHAR)), case_id LIMIT 30""")
def disagreement_sample(spark, d):
    """Thirty cases in which judge and code score disagree, drawn by hash."""
    return scored(spark, d).where((F.col("status") == "F") != F.col("hit1")).select("case_id", "status", "hit1").orderBy(F.md5(F.col("case_id").cast("string")), "case_id").limit(30)


_STRATA = "CASE WHEN days < 400 THEN 0 WHEN days < 1200 THEN 1 WHEN days < 2000 THEN 2 ELSE 3 END"


@query("T14_day_strata", f"""WITH {CASES}, s AS (SELECT case_id, date_diff('day', event_date, DATE '2002-01-01') AS days FROM cases WHERE event_date IS NOT NULL), t AS (SELECT case_id, days, {_STRATA} AS stratum FROM s)
SELECT stratum, case_id, days FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS r FROM t) WHERE r <= 12 + CASE WHEN stratum < 2 THEN 1 ELSE 0 END""")
def day_strata(spark, d):
    """Fifty cases as evenly as possible over four strata of age: what is left over goes to the first ones. Each stratum's rows are one top-k."""
    s = cases(spark, d).where("event_date is not null").select("case_id", F.datediff(F.lit("2002-01-01").cast("date"), "event_date").cast("long").alias("days"))
    line = Window.partitionBy("stratum").orderBy(F.md5(F.col("case_id").cast("string")), "case_id")
    drawn = s.withColumn("stratum", F.expr(_STRATA)).withColumn("r", F.row_number().over(line)).where("r <= 13")  # cut in every task before the shuffle
    return drawn.where("r <= 12 + cast(stratum < 2 as int)").select("stratum", "case_id", "days")


_FLAGS = "CASE WHEN {0} % 3 = 0 THEN [] ELSE ['f' || CAST({0} % 2 AS VARCHAR), 'g' || CAST({0} % 5 AS VARCHAR)] END"
_RATED = "round(CASE WHEN {0} IS NOT NULL THEN len(list_intersect({0}, truth)) / len({0}) END, 6) AS {0}_precision, round(coalesce(len(list_intersect({0}, truth)) / 2, 0), 6) AS {0}_recall"


@query("R3_findings_of_five", f"""WITH {_BM}, t AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s), k AS (SELECT item_id, r, {_FLAGS.format('doc_id')} AS flags FROM t WHERE r <= 5),
c AS (SELECT item_id, flags, count(*) AS n, min(r) AS r FROM k WHERE len(flags) > 0 GROUP BY ALL), commonest AS (SELECT item_id, flags AS commonest FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, r) AS o FROM c) WHERE o = 1),
nearest AS (SELECT item_id, arg_min(flags, r) AS nearest FROM c GROUP BY item_id), w AS (SELECT item_id, code FROM (SELECT item_id, unnest(flags) AS code FROM k) GROUP BY ALL HAVING count(*) >= 2), twice AS (SELECT item_id, list(code ORDER BY code) AS twice FROM w GROUP BY item_id),
a AS (SELECT i.item_id, commonest, nearest, twice, ['f' || CAST(i.item_id % 2 AS VARCHAR), 'g' || CAST(i.item_id % 5 AS VARCHAR)] AS truth FROM (SELECT DISTINCT item_id FROM k) i LEFT JOIN commonest USING (item_id) LEFT JOIN nearest USING (item_id) LEFT JOIN twice USING (item_id))
SELECT item_id, commonest, nearest, twice, {', '.join(_RATED.format(x) for x in ('commonest', 'nearest', 'twice'))} FROM a""")
def findings_of_five(spark, d):
    """Findings guessed from the five nearest: their commonest non-empty set (of equally common ones the best-ranked), the
    nearest non-empty set, and the codes that two of them hold. Without a guess recall is 0 and precision null."""
    line = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    pair = lambda c: F.array(F.concat(F.lit("f"), (F.col(c) % 2).cast("string")), F.concat(F.lit("g"), (F.col(c) % 5).cast("string")))
    flags = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(pair("doc_id"))
    five = _bm25(spark, d).withColumn("r", F.row_number().over(line)).where("r <= 5").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("r", flags.alias("flags")))).alias("five"))
    held = F.filter(F.transform("five", lambda x: x["flags"]), lambda x: F.size(x) > 0)
    codes = F.flatten(F.col("held"))
    often = F.transform("held", lambda s: F.size(F.filter("held", lambda o: o == s)))
    rows = five.select("item_id", held.alias("held")).withColumn("often", often)
    rows = rows.withColumn("commonest", F.get("held", F.array_position("often", F.array_max("often")) - 1)).withColumn("nearest", F.get("held", F.lit(0)))
    twice = F.array_sort(F.array_distinct(F.filter(codes, lambda c: F.size(F.filter(codes, lambda o: o == c)) >= 2)))
    rows = rows.withColumn("twice", F.when(F.size(twice) > 0, twice))
    rated = []
    for x in ("commonest", "nearest", "twice"):
        right = F.size(F.array_intersect(x, pair("item_id")))
        rated += [rounded(F.when(F.col(x).isNotNull(), right / F.size(x))).alias(f"{x}_precision"), rounded(F.when(F.col(x).isNull(), 0.0).otherwise(right / 2)).alias(f"{x}_recall")]
    return rows.select("item_id", "commonest", "nearest", "twice", *rated)
