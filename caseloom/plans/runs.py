"""Comparison of runs, rules over their results, boards and draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions.stats import rounded
from caseloom.operators import inference, pools, selection
from caseloom.operators.ranking import top_per_group
from caseloom.sources.tables import table

from .analogues import CASES, LINES, SCORED, cases, lines, scored
from .history import SNAPS, snapshots
from .registry import query

_INT = "CAST({0} AS INTEGER)"


@query("A4_paired_difference", f"""WITH {SCORED}, r AS (SELECT split, CAST(hit3 AS INTEGER) - CAST(hit1 AS INTEGER) AS v, case_id, i AS resample, CAST(('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM scored, range(20) AS t(i)),
t AS (SELECT split, resample, v, {" + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in inference.POISSON_CUTS)} AS times FROM r), m AS (SELECT split, resample, sum(times * v) / sum(times) AS mean FROM t GROUP BY ALL) SELECT split, round(min(mean), 6) AS low, round(max(mean), 6) AS high FROM m GROUP BY split""")
def paired_difference(spark, d):
    """Range of the resampled mean differences between two answers to the same cases."""
    rows = scored(spark, d).select("split", "case_id", (F.col("hit3").cast("int") - F.col("hit1").cast("int")).alias("v"))
    return inference.poisson_bootstrap(rows, "split", "case_id", "v", 20).groupBy("split").agg(rounded(F.min("mean")).alias("low"), rounded(F.max("mean")).alias("high"))


@query("A16_share_bands", f"""WITH {SCORED}, s AS (SELECT case_id, len(list_intersect(guessed_findings, true_findings)) / greatest(1, len(true_findings)) AS share FROM scored), b AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS cut) SELECT cut, count(*) FILTER (share >= cut) AS n FROM s, b GROUP BY cut""")
def share_bands(spark, d):
    """Cases whose share of right findings reaches each cut (cumulative)."""
    share = F.size(F.array_intersect("guessed_findings", "true_findings")) / F.greatest(F.lit(1), F.size("true_findings"))
    cuts = (0.25, 0.5, 0.75, 1.0)
    wide = scored(spark, d).agg(*[F.count_if(share >= c).alias(f"n{k}") for k, c in enumerate(cuts)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"n{k}").alias("n")) for k, c in enumerate(cuts)])).alias("x")).select("x.*")


@query("A24_difference_patterns", f"""WITH {SCORED}, k AS (SELECT list_filter([CASE WHEN substr(guesses[1], 1, 3) <> substr(truth, 1, 3) THEN 'phase' END, CASE WHEN substr(guesses[1], 4, 3) <> substr(truth, 4, 3) THEN 'event' END, CASE WHEN len(guessed_findings) < len(true_findings) THEN 'fewer findings' END], lambda x: x IS NOT NULL) AS kinds FROM scored) SELECT array_to_string(kinds, '+') AS pattern, count(*) AS n FROM k GROUP BY 1""")
def difference_patterns(spark, d):
    """In which ways, several at once, an answer differs from the truth."""
    first = F.get("guesses", F.lit(0))
    part = lambda c, at: F.substring(c, at, 3)
    kinds = F.array_compact(F.array(
        F.when(part(first, 1) != part(F.col("truth"), 1), "phase"), F.when(part(first, 4) != part(F.col("truth"), 4), "event"), F.when(F.size("guessed_findings") < F.size("true_findings"), "fewer findings"),
    ))
    return scored(spark, d).groupBy(F.array_join(kinds, "+").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("A31_round_reading", f"""WITH {SCORED}, m AS (SELECT priority, avg(CAST(hit3 AS INTEGER)) - avg(CAST(hit1 AS INTEGER)) AS gain, count(*) AS n, count(*) FILTER (failed) AS bad FROM scored GROUP BY priority), b AS (SELECT *, gain - 1.96 * sqrt(0.25 / n) AS low, gain + 1.96 * sqrt(0.25 / n) AS high FROM m)
SELECT priority, CASE WHEN 20 * bad > n THEN 'drop: gate' WHEN high < 0 THEN 'drop: harm' WHEN low <= 0 THEN 'drop: no gain' WHEN gain <= 0.05 THEN 'drop: noise' ELSE 'keep' END AS reading FROM b""")
def round_reading(spark, d):
    """What a round's figures mean: gate, harm, gain and noise floor, in this order."""
    m = scored(spark, d).groupBy("priority").agg((F.avg(F.col("hit3").cast("int")) - F.avg(F.col("hit1").cast("int"))).alias("gain"), F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"))
    half = 1.96 * F.sqrt(F.lit(0.25) / F.col("n"))
    reading = F.when(20 * F.col("bad") > F.col("n"), "drop: gate").when(F.col("gain") + half < 0, "drop: harm").when(F.col("gain") - half <= 0, "drop: no gain").when(F.col("gain") <= 0.05, "drop: noise").otherwise("keep")
    return m.select("priority", reading.alias("reading"))


@query("A33_stage_spend", f"""WITH {CASES} SELECT stage, CAST(sum(CAST(round(total * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM cases JOIN (SELECT unnest(['0', 'a', 'f']) AS stage) s ON starts_with(md5(CAST(case_id AS VARCHAR)), stage) GROUP BY stage""")
def stage_spend(spark, d):
    """Spend of the stages whose commit prefix a run's id begins with: the first character is the join key."""
    stages = spark.createDataFrame([("0",), ("a",), ("f",)], "stage string")
    rows = cases(spark, d).select(F.round(F.col("total") * 100).cast("long").alias("c"), F.substring(F.md5(F.col("case_id").cast("string")), 1, 1).alias("stage"))
    return rows.join(F.broadcast(stages), "stage").groupBy("stage").agg(F.sum("c").alias("cents"), F.count(F.lit(1)).alias("n"))


@query("A34_billed_vs_computed", f"""WITH {CASES} SELECT split, CAST(sum(CASE WHEN case_id % 3 = 0 THEN CAST(round(total * 100) AS BIGINT) END) AS BIGINT) AS billed, CAST(sum(CAST(round(total * 100) AS BIGINT)) AS BIGINT) AS computed FROM cases GROUP BY split""")
def billed(spark, d):
    cents = F.round(F.col("total") * 100).cast("long")
    return cases(spark, d).groupBy("split").agg(F.sum(F.when(F.col("case_id") % 3 == 0, cents)).alias("billed"), F.sum(cents).alias("computed"))


@query("A43_finding_twin_sets", f"""WITH {SCORED}, g AS (SELECT customer AS grp, array_to_string(list_sort(list_distinct(list_transform(true_findings, lambda x: substr(x, 1, 3)))), ' ') AS v FROM scored), cnt AS (SELECT grp AS g, v, count(*) AS n FROM g GROUP BY ALL), tot AS (SELECT g, sum(n) AS size FROM cnt GROUP BY g),
per AS (SELECT c.g, c.v, c.n, (SELECT r.v FROM (SELECT c2.v, c2.n - CASE WHEN c2.v = c.v THEN 1 ELSE 0 END AS m FROM cnt c2 WHERE c2.g = c.g) r WHERE r.m > 0 ORDER BY r.m DESC, r.v LIMIT 1) AS winner FROM cnt c JOIN tot t ON t.g = c.g WHERE t.size > 1) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (winner = v), 0) AS BIGINT) AS n_agree FROM per""")
def twin_sets(spark, d):
    """Leave-one-out agreement of whole finding sets among a customer's cases; the empty set wins ties."""
    v = F.array_join(F.array_sort(F.array_distinct(F.transform("true_findings", lambda x: F.substring(x, 1, 3)))), " ")
    per = pools.leave_one_out(scored(spark, d).select(F.col("customer").alias("g"), v.alias("v")), ["g"], "v")
    return per.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)).alias("n_agree"))


@query("A50_belief_path", f"""WITH {SNAPS}, r AS (SELECT user_id, status = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY run) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM snaps), p AS (SELECT user_id, bool_or(ok) FILTER (k = 1) AS a, bool_or(ok) FILTER (k = (n + 1) // 2) AS b, bool_or(ok) FILTER (k = n) AS c FROM r GROUP BY user_id) SELECT a AS at_first, b AS midway, c AS at_last, count(*) AS n FROM p GROUP BY ALL""")
def belief_path(spark, d):
    """Right or wrong at three checkpoints of each key's path."""
    line = Window.partitionBy("user_id")
    r = snapshots(spark, d).withColumn("k", F.row_number().over(line.orderBy("run"))).withColumn("n", F.count(F.lit(1)).over(line)).withColumn("ok", F.col("status") == "purchase")
    at = lambda k: F.bool_or(F.when(F.col("k") == k, F.col("ok")))
    p = r.groupBy("user_id").agg(at(F.lit(1)).alias("at_first"), at(F.floor((F.col("n") + 1) / 2)).alias("midway"), at(F.col("n")).alias("at_last"))
    return p.groupBy("at_first", "midway", "at_last").agg(F.count(F.lit(1)).alias("n"))


@query("A52_reply_budget", """WITH q AS (SELECT role, quantile_disc(length(text), 0.99) AS p99, max(length(text)) AS longest FROM conversations GROUP BY role), s AS (SELECT i * 1000 AS step FROM range(1, 60) AS r(i)) SELECT role, CAST(min(step) AS BIGINT) AS budget FROM q, s WHERE step >= 2 * p99 AND step > longest GROUP BY role""")
def reply_budget(spark, d):
    """The smallest step of 1,000 that is twice the 99th percentile and above every reply."""
    lengths = table(spark, d, "conversations").select("role", F.length("text").alias("chars"))
    q = selection.quantiles(lengths, ["role"], "chars", {"p99": 0.99}).join(lengths.groupBy("role").agg(F.max("chars").alias("longest")), "role")
    return q.select("role", (F.greatest(F.ceil(2 * F.col("p99") / 1000), F.floor(F.col("longest") / 1000) + 1) * 1000).cast("long").alias("budget"))


@query("A53_board_counts", f"""WITH {SCORED} SELECT event_date AS closed_on, count(*) AS n, count(*) FILTER (NOT failed AND NOT abstained) AS coded, count(*) FILTER (hit1) AS same FROM scored WHERE status = 'F' GROUP BY 1""")
def board_counts(spark, d):
    return scored(spark, d).where("status = 'F'").groupBy(F.col("event_date").alias("closed_on")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("failed") & ~F.col("abstained")).alias("coded"), F.count_if("hit1").alias("same"))


@query("A54_line_hits", r"""WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, line, count(*) AS n FROM a GROUP BY ALL), c AS (SELECT doc_id + 1 AS doc_id, line, n AS m FROM b) SELECT b.doc_id, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS n_hits, CAST(sum(n) AS BIGINT) AS n_lines FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.line = c.line GROUP BY b.doc_id""")
def line_hits(spark, d):
    """Multiset intersection of a document's lines with those of the one before it."""
    a = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.md5("line").alias("k"))
    b = a.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
    c = b.select((F.col("doc_id") + 1).alias("doc_id"), "k", F.col("n").alias("m"))
    return b.join(c, ["doc_id", "k"], "left").groupBy("doc_id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("n_hits"), F.sum("n").alias("n_lines"))


_RULES = (("all", "true"), ("long", "n_chars >= 300"), ("english", "lang = 'en'"), ("longer", "n_chars >= 1000"))


@query("A60_rule_choice", "WITH r AS (" + " UNION ALL ".join(f"SELECT {k} AS pos, '{n}' AS rule, count(*) FILTER ({c}) AS pages, coalesce(sum(n_chars) FILTER ({c}), 0) AS kept, sum(n_chars) AS total FROM documents" for k, (n, c) in enumerate(_RULES)) + ") SELECT rule, pages FROM r WHERE 10 * kept >= 9 * total ORDER BY pages, pos LIMIT 1")
def rule_choice(spark, d):
    """The rule that keeps 90% of the characters with the fewest pages; ties by rule order. One scan judges all rules."""
    aggs = [F.sum("n_chars").alias("total")]
    for k, (_, c) in enumerate(_RULES):
        aggs += [F.count_if(F.expr(c)).alias(f"p{k}"), F.coalesce(F.sum(F.when(F.expr(c), F.col("n_chars"))), F.lit(0)).alias(f"k{k}")]
    wide = table(spark, d, "documents").agg(*aggs)
    each = F.array(*[F.struct(F.col(f"p{k}").alias("pages"), F.lit(k).alias("pos"), F.lit(n).alias("rule"), (10 * F.col(f"k{k}") >= 9 * F.col("total")).alias("ok")) for k, (n, _) in enumerate(_RULES)])
    return wide.select(F.array_min(F.filter(each, lambda x: x["ok"])).alias("x")).select("x.rule", "x.pages")


@query("A61_push", f"""WITH {SNAPS}, r AS (SELECT user_id, arg_min(status, run) AS f, arg_max(status, run) AS l FROM snaps GROUP BY user_id), c AS (SELECT status, count(*) AS n FROM snaps GROUP BY status) SELECT count(*) FILTER (f <> l) AS n_changed, count(*) FILTER (f <> l AND cl.n > cf.n) AS toward_common, count(*) FILTER (f <> l AND l = 'purchase') AS fixes, count(*) FILTER (f <> l AND f = 'purchase') AS breaks FROM r JOIN c cf ON cf.status = f JOIN c cl ON cl.status = l""")
def push(spark, d):
    """First against last answers: how many changed, and toward the commoner one."""
    s = snapshots(spark, d)
    r = s.groupBy("user_id").agg(F.min_by("status", "run").alias("f"), F.max_by("status", "run").alias("l"))
    c = s.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    both = r.join(c.select(F.col("status").alias("f"), F.col("n").alias("nf")), "f").join(c.select(F.col("status").alias("l"), F.col("n").alias("nl")), "l")
    moved = F.col("f") != F.col("l")
    return both.agg(F.count_if(moved).alias("n_changed"), F.count_if(moved & (F.col("nl") > F.col("nf"))).alias("toward_common"), F.count_if(moved & (F.col("l") == "purchase")).alias("fixes"), F.count_if(moved & (F.col("f") == "purchase")).alias("breaks"))


@query("A62_universal_choice", f"""WITH {SCORED}, g AS (SELECT priority AS way, split, count(*) FILTER (hit3) - count(*) FILTER (hit1) AS gain FROM scored GROUP BY ALL) SELECT way, CAST(sum(gain) AS BIGINT) AS gain FROM g GROUP BY way HAVING bool_and(gain > 0)""")
def universal_choice(spark, d):
    """Ways that gain in every answer set."""
    g = scored(spark, d).groupBy(F.col("priority").alias("way"), "split").agg((F.count_if("hit3") - F.count_if("hit1")).alias("gain"))
    return g.groupBy("way").agg(F.sum("gain").alias("gain"), F.bool_and(F.col("gain") > 0).alias("every")).where("every").drop("every")


@query("A64_read_band", f"""WITH {SCORED}, k AS (SELECT case_id, len(list_filter(true_findings, lambda x: NOT list_contains(guessed_findings, x))) AS unread, hit3 FROM scored) SELECT CASE WHEN unread = 0 THEN 'all' WHEN unread <= 2 THEN 'most' ELSE 'few' END AS band, count(*) AS n, count(*) FILTER (hit3) AS hits FROM k GROUP BY 1""")
def read_band(spark, d):
    unread = F.size(F.array_except("true_findings", "guessed_findings"))
    return scored(spark, d).groupBy(F.when(unread == 0, "all").when(unread <= 2, "most").otherwise("few").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit3").alias("hits"))


@query("A65_outcome_by_slice", f"""WITH {SCORED}, o AS (SELECT split, CASE WHEN hit1 THEN 'right' WHEN hit3 THEN 'understood' WHEN len(true_findings) = 0 THEN 'thin evidence' ELSE 'misread' END AS outcome FROM scored) SELECT split, count(*) FILTER (outcome = 'right') AS "right", count(*) FILTER (outcome = 'understood') AS understood, count(*) FILTER (outcome = 'thin evidence') AS thin, count(*) FILTER (outcome = 'misread') AS misread FROM o GROUP BY split""")
def outcome_by_slice(spark, d):
    o = F.when(F.col("hit1"), "right").when(F.col("hit3"), "understood").when(F.size("true_findings") == 0, "thin").otherwise("misread")
    return scored(spark, d).groupBy("split").agg(*[F.count_if(o == k).alias(k) for k in ("right", "understood", "thin", "misread")])


@query("A66_scan_invariant", """SELECT lang, count(*) AS attempted, count(*) FILTER (n_chars < 50) AS failed, count(*) FILTER (n_chars >= 50) AS readable, bool_and(n_chars >= 10) AS all_long, bool_or(n_chars > 10000) AS any_huge FROM documents GROUP BY lang""")
def scan_invariant(spark, d):
    """Attempted less failed is readable, per stratum, with all/any flags."""
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(n < 50).alias("failed"), F.count_if(n >= 50).alias("readable"), F.bool_and(n >= 10).alias("all_long"), F.bool_or(n > 10000).alias("any_huge"))


@query("A69_exclusive_sort", f"""WITH {SCORED} SELECT CASE WHEN failed THEN 'failed' WHEN abstained THEN 'abstained' WHEN len(true_findings) = 0 THEN 'none flagged' ELSE 'judged' END AS kind, count(*) AS n FROM scored GROUP BY 1""")
def exclusive_sort(spark, d):
    kind = F.when(F.col("failed"), "failed").when(F.col("abstained"), "abstained").when(F.size("true_findings") == 0, "none flagged").otherwise("judged")
    return scored(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("A71_page_outcomes", r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS ids, html FROM pages) SELECT CASE WHEN html IS NULL THEN 'no page' WHEN NOT contains(html, '<ul>') THEN 'no block' WHEN len(ids) = 0 THEN 'empty' WHEN len(ids) <> len(list_distinct(ids)) THEN 'duplicate id' ELSE 'read' END AS outcome, count(*) AS n FROM p GROUP BY 1""")
def page_outcomes(spark, d):
    from caseloom.sources import listing

    p = table(spark, d, "pages").select("page_id", "html")
    parsed = listing.parse(p).join(p.select("page_id", F.col("html").isNull().alias("gone"), F.contains("html", F.lit("<ul>")).alias("block")), "page_id")
    o = F.when(F.col("gone"), "no page").when(~F.col("block"), "no block").when(F.size("hrefs") == 0, "empty").when(F.size("hrefs") != F.size(F.array_distinct("hrefs")), "duplicate id").otherwise("read")
    return parsed.groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("J18_compare_shared", f"""WITH {SCORED}, a AS (SELECT case_id, total > 250000 AS fatal, hit1 FROM scored WHERE NOT failed), b AS (SELECT case_id, hit3 FROM scored WHERE NOT abstained) SELECT fatal, count(*) AS n, count(*) FILTER (hit1) AS a_hits, count(*) FILTER (hit3) AS b_hits FROM a JOIN b USING (case_id) GROUP BY fatal""")
def compare_shared(spark, d):
    """Two runs over the cases that both scored, by stratum."""
    s = scored(spark, d)
    a = s.where(~F.col("failed")).select("case_id", (F.col("total") > 250000).alias("fatal"), "hit1")
    return a.join(s.where(~F.col("abstained")).select("case_id", "hit3"), "case_id").groupBy("fatal").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit1").alias("a_hits"), F.count_if("hit3").alias("b_hits"))


@query("J24_awaiting", """WITH c AS (SELECT o_custkey AS k, o_orderkey AS folder FROM orders WHERE o_orderstatus = 'O'), s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) SELECT k, min(folder) AS folder FROM c ANTI JOIN s USING (k) GROUP BY k""")
def awaiting(spark, d):
    """Coded keys that aren't settled, each in its earliest folder."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("folder"), "o_orderstatus", "o_totalprice")
    settled = o.where("o_orderstatus = 'P' and o_totalprice > 300000").select("k")
    return o.where("o_orderstatus = 'O'").join(settled, "k", "left_anti").groupBy("k").agg(F.min("folder").alias("folder"))


@query("R5_suggest_codes", f"""WITH {LINES}, p AS (SELECT DISTINCT case_id, substr(code, 4, 3) AS event FROM lines), n AS (SELECT event, count(*) AS n FROM p GROUP BY event), x AS (SELECT a.event AS event, b.event AS other, count(*) AS n_both FROM p a JOIN p b ON a.case_id = b.case_id AND a.event <> b.event GROUP BY ALL) SELECT event, other, n_both, CAST(r AS INTEGER) AS rank FROM (SELECT x.*, row_number() OVER (PARTITION BY x.event ORDER BY n_both DESC, other) AS r FROM x JOIN n ON n.event = x.event WHERE n.n >= 20) WHERE r <= 3""")
def suggest_codes(spark, d):
    """The events that most often accompany an event of at least 20 cases."""
    p = pools.code_sets(lines(spark, d).select("case_id", F.substring("code", 4, 3).alias("code")))
    both = pools.pair_counts(p)
    each = both.select(F.col("a").alias("event"), F.col("b").alias("other"), F.col("n").alias("n_both")).unionByName(both.select(F.col("b").alias("event"), F.col("a").alias("other"), F.col("n").alias("n_both")))
    often = p.groupBy(F.col("code").alias("event")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("event")
    return top_per_group(each.join(often, "event"), ["event"], [F.desc("n_both"), "other"], 3).select("event", "other", "n_both", "rank")


@query("W15_occurrence_marks", f"""WITH {LINES}, t AS (SELECT case_id, list(code ORDER BY rest, seq, finding, price) AS a, list(code ORDER BY price DESC, code) AS b FROM lines GROUP BY case_id), u AS (SELECT case_id, b, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM t) SELECT CASE WHEN b[i] = c THEN 'same place' WHEN list_contains(b, c) THEN 'other place' ELSE 'absent' END AS mark, count(*) AS n FROM u GROUP BY 1""")
def occurrence_marks(spark, d):
    """For each code of one sequence, whether the other has it at the same place."""
    order = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c, "code"))), lambda x: x["code"])
    t = lines(spark, d).withColumn("rest", ~F.col("defining")).withColumn("down", -F.col("price")).groupBy("case_id").agg(order("rest", "seq", "finding", "price").alias("a"), order("down").alias("b"))
    u = t.select("b", F.posexplode("a").alias("i", "c"))
    mark = F.when(F.get("b", F.col("i")) == F.col("c"), "same place").when(F.array_contains("b", F.col("c")), "other place").otherwise("absent")
    return u.groupBy(mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"))


@query("T4_probability_ranking", """WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, list(event_type ORDER BY r) AS ranking FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM p) WHERE r <= 3 GROUP BY user_id""")
def probability_ranking(spark, d):
    p = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("user_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "event_type"))), lambda x: x["event_type"]), 1, 3).alias("ranking"))  # one entry a type


@query("T6_queue", """SELECT o_custkey AS k, min(o_orderkey) AS closure FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey""")
def queue(spark, d):
    """Closures on or after the start whose key isn't done."""
    o = table(spark, d, "orders")
    done = o.where("o_orderstatus = 'P'").select("o_custkey")
    return o.where("o_orderdate >= timestamp_ntz '2000-01-01' and o_orderstatus = 'F'").join(done, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("closure"))


@query("T7_board_rows", f"""WITH {SCORED} SELECT case_id, event_date, CASE WHEN failed THEN 'not coded' WHEN abstained THEN 'abstained' WHEN status = 'P' THEN 'awaiting' WHEN hit1 THEN 'same' WHEN hit3 THEN 'same, other order' ELSE 'different' END AS grade FROM scored ORDER BY event_date DESC, case_id LIMIT 100""")
def board_rows(spark, d):
    """The newest 100 rows of the board with their grade."""
    grade = F.when(F.col("failed"), "not coded").when(F.col("abstained"), "abstained").when(F.col("status") == "P", "awaiting").when(F.col("hit1"), "same").when(F.col("hit3"), "same, other order").otherwise("different")
    return scored(spark, d).select("case_id", "event_date", grade.alias("grade")).orderBy(F.desc("event_date"), "case_id").limit(100)


@query("T11_fixed_draw", f"""WITH {CASES}, s AS (SELECT case_id, total > 250000 AS fatal, priority FROM cases), c AS (SELECT fatal, priority, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT fatal, priority, greatest(1, CAST(round_even(n * 100.0 / sum(n) OVER (PARTITION BY fatal), 0) AS BIGINT)) AS quota FROM c) SELECT fatal, priority, case_id FROM (SELECT s.fatal, s.priority, case_id, quota, row_number() OVER (PARTITION BY s.fatal, s.priority ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS r FROM s JOIN q ON s.fatal = q.fatal AND s.priority = q.priority) WHERE r <= quota""")
def fixed_draw(spark, d):
    """About 100 cases of either stratum, proportional over classes within it."""
    s = cases(spark, d).select("case_id", (F.col("total") > 250000).alias("fatal"), "priority")
    n = s.groupBy("fatal", "priority").agg(F.count(F.lit(1)).alias("n"))
    quota = n.withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("fatal")), 0).cast("long"))).drop("n")
    line = Window.partitionBy("fatal", "priority").orderBy(F.md5(F.col("case_id").cast("string")), "case_id")
    return s.withColumn("r", F.row_number().over(line)).join(F.broadcast(quota), ["fatal", "priority"]).where("r <= quota").select("fatal", "priority", "case_id")
