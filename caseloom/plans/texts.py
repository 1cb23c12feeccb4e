"""Texts: leakage, twins, redaction, retrieval, transcripts, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.stats import md5_unit, rounded
from caseloom.operators import guard, inference, ranking, retrieval, selection
from caseloom.sources.tables import table

from .analogues import CASES, LINES, SCORED, cases, lines, scored
from .registry import query

_FOLD = r"""trim(regexp_replace(translate(translate({0}, '‘’‚‛“”„‟', '''''''''""""'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+', ' ', 'g'))"""
_EDGE = r"""regexp_replace({0}, '^[ "''(\[{{]+|[ .!?;:,''")\]}}]+$', '', 'g')"""
_BENCH, _DOC = _FOLD.format("text"), _FOLD.format("text")
_NEEDLES = f"""b AS (SELECT item_id, {_BENCH} AS folded FROM benchmark), p AS (SELECT item_id, {_EDGE.format('folded')} AS whole, list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(folded, '([.!?;]) ', '\\1' || chr(1), 'g'), '([.!?])([a-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {_EDGE.format('s')}), lambda s: length(s) >= 20)) AS parts FROM b),
needles AS (SELECT item_id, whole AS needle, true AS is_whole FROM p WHERE length(whole) >= 20 UNION ALL SELECT item_id, s, false FROM (SELECT item_id, whole, unnest(parts) AS s FROM p) WHERE s <> whole),
h AS (SELECT doc_id, {_DOC} AS hay FROM documents), m AS (SELECT doc_id, item_id, needle, is_whole FROM h JOIN needles ON contains(hay, needle))"""


def _needles(spark, d):
    return guard.needles(table(spark, d, "benchmark"), "item_id", "text")


def _matches(spark, d):
    return guard.leaks(table(spark, d, "documents"), "doc_id", "text", _needles(spark, d), "item_id")


@query("J15_leakage_join", f"""WITH {_NEEDLES} SELECT doc_id, item_id, needle, is_whole AS whole FROM m""")
def leakage(spark, d):
    """Every withheld sentence, and whole text, that a document contains."""
    return _matches(spark, d)


@query("J16_screen", f"""WITH {_NEEDLES}, t AS (SELECT item_id, count(*) AS n FROM needles GROUP BY item_id), g AS (SELECT doc_id, item_id, count(*) AS n_found, bool_or(is_whole) AS w FROM m GROUP BY ALL) SELECT doc_id, item_id, n_found, round(n_found / n, 6) AS share, CASE WHEN w OR n_found / n >= 0.5 THEN 'leak' ELSE 'mark' END AS kind FROM g JOIN t USING (item_id)""")
def screen(spark, d):
    total = _needles(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_needles"))
    return guard.routed(_matches(spark, d), "doc_id", "item_id", total).withColumn("share", rounded(F.col("share")))


@query("A55_coverage_share", f"""WITH {_NEEDLES}, t AS (SELECT item_id, count(*) AS n FROM needles GROUP BY item_id), f AS (SELECT item_id, count(DISTINCT needle) AS k FROM m GROUP BY item_id) SELECT t.item_id, n AS n_needles, coalesce(k, 0) AS n_covered, round(coalesce(k, 0) / n, 6) AS share FROM t LEFT JOIN f USING (item_id)""")
def coverage_share(spark, d):
    """Of each item, the share of needles that some document has."""
    total = _needles(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_needles"))
    found = _matches(spark, d).groupBy("item_id").agg(F.countDistinct("needle").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return total.join(found, "item_id", "left").select("item_id", "n_needles", k.alias("n_covered"), rounded(k / F.col("n_needles")).alias("share"))


@query("A41_threshold_scan", f"""WITH {_NEEDLES}, t AS (SELECT unnest([20, 40, 60, 80, 120, 200]) AS least) SELECT CAST(least AS INTEGER) AS least, count(needle) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM t LEFT JOIN m ON length(needle) >= least GROUP BY least""")
def threshold_scan(spark, d):
    """Hits that remain at each least needle length; hits are counted by length before the thresholds meet them."""
    m = _matches(spark, d).withColumn("len", F.length("needle"))
    steps = [20, 40, 60, 80, 120, 200]
    aggs = []
    for s in steps:
        aggs += [F.count_if(F.col("len") >= s).alias(f"h{s}"), F.countDistinct(F.when(F.col("len") >= s, F.col("doc_id"))).alias(f"d{s}")]
    wide = m.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(s).alias("least"), F.col(f"h{s}").alias("n_hits"), F.col(f"d{s}").alias("n_docs")) for s in steps])).alias("x")).select("x.*")


@query("R4_exact_twins", r"""SELECT count(*) AS n_members, min(doc_id) AS first_doc FROM (SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS k FROM documents) GROUP BY k HAVING count(*) > 1""")
def exact_twins(spark, d):
    """Groups of documents with one token sequence; a digest is the key, so no text is shuffled."""
    k = F.md5(F.array_join(T.tokens(F.col("text")), " "))
    return table(spark, d, "documents").select("doc_id", k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_members"), F.min("doc_id").alias("first_doc")).where("n_members > 1").drop("k")


@query("R4_loose_twins", r"""SELECT count(*) AS n_members, min(doc_id) AS first_doc FROM (SELECT doc_id, md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')) AS k FROM documents) GROUP BY k HAVING count(*) > 1""")
def loose_twins(spark, d):
    """Groups with one token set."""
    k = F.md5(F.array_join(F.array_sort(F.array_distinct(T.tokens(F.col("text")))), " "))
    return table(spark, d, "documents").select("doc_id", k.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n_members"), F.min("doc_id").alias("first_doc")).where("n_members > 1").drop("k")


@query("A59_duplication_share", r"""WITH s AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40))) AS line FROM documents), o AS (SELECT line, count(*) AS n FROM s GROUP BY line) SELECT doc_id, count(*) AS n_lines, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM s JOIN o USING (line) GROUP BY doc_id""")
def duplication_share(spark, d):
    """Share of a document's long lines that other documents hold as well, by digest of the line."""
    s = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 40))).alias("line"))
    s = s.select("doc_id", F.md5("line").alias("k"))
    o = s.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return s.join(o, "k").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), rounded(F.avg((F.col("n") > 1).cast("double"))).alias("share"))


@query("A58_name_markers", r"""SELECT lang, CAST(sum(len(regexp_extract_all(text, '\+1 \('))) AS BIGINT) AS n_phone, CAST(sum(len(regexp_extract_all(text, '@'))) AS BIGINT) AS n_at, CAST(sum(len(regexp_extract_all(text, '[0-9]{4,}'))) AS BIGINT) AS n_numbers FROM documents GROUP BY lang""")
def markers(spark, d):
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    return table(spark, d, "documents").groupBy("lang").agg(count(r"\+1 \(").alias("n_phone"), count("@").alias("n_at"), count("[0-9]{4,}").alias("n_numbers"))


@query("A56_key_shapes", r"""SELECT regexp_replace(regexp_replace(props, '[0-9]', 'd', 'g'), 'd+', 'd', 'g') AS shape, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1""")
def shapes(spark, d):
    shape = F.regexp_replace(F.regexp_replace("props", r"\d", "d"), "d+", "d")
    return table(spark, d, "events").groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))


@query("A77_path_census", """SELECT unnest(json_keys(props)) AS path, count(*) AS n FROM events GROUP BY 1""")
def path_census(spark, d):
    """How often each key of the dynamic field occurs."""
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select(F.explode(keys).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("A47_weighted_word_share", r"""WITH w AS (SELECT lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents), s AS (SELECT lang, source, sum(n) AS n FROM w GROUP BY ALL) SELECT lang, source, CAST(n AS BIGINT) AS n_words, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM s""")
def word_share(spark, d):
    s = table(spark, d, "documents").groupBy("lang", "source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n_words"))
    return s.withColumn("share", rounded(F.col("n_words") / F.sum("n_words").over(Window.partitionBy("lang"))))


@query("A48_confusion", """SELECT quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM labels GROUP BY quality""")
def confusion(spark, d):
    return table(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1))).select("quality", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query("A57_behaviour_sequences", """WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS path FROM conversations GROUP BY conv_id) SELECT path, count(*) AS n FROM s GROUP BY path""")
def sequences(spark, d):
    """Whole role sequences of conversations and how often each occurs."""
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("path"))
    return s.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("J17_paired_runs", f"""WITH {SCORED}, a AS (SELECT case_id, split, hit1 AS x FROM scored), b AS (SELECT case_id, hit3 AS x FROM scored) SELECT split, count(*) AS n, round(avg(CAST(b.x AS INTEGER) - CAST(a.x AS INTEGER)), 6) AS mean_difference, count(*) FILTER (b.x AND NOT a.x) AS n_better, count(*) FILTER (a.x AND NOT b.x) AS n_worse FROM a JOIN b USING (case_id) GROUP BY split""")
def paired_runs(spark, d):
    """Two answers to the same cases; runs over different cases are refused."""
    s = scored(spark, d)
    a, b = s.select("case_id", "split", F.col("hit1").alias("a")), s.select("case_id", F.col("hit3").alias("b"))
    both = a.join(b, "case_id", "full_outer").withColumn("a", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the runs have different cases"))).otherwise(F.col("a")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("b").cast("int") - F.col("a").cast("int"))).alias("mean_difference"), F.count_if(F.col("b") & ~F.col("a")).alias("n_better"), F.count_if(F.col("a") & ~F.col("b")).alias("n_worse"))


@query("J20_read_agreement", """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05') SELECT count(*) FILTER (a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS n_both, count(*) FILTER (b.user_id IS NULL) AS n_first, count(*) FILTER (a.user_id IS NULL) AS n_second FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def read_agreement(spark, d):
    e = table(spark, d, "events")
    part = lambda cond, name: e.where(cond).select("user_id", "event_type").distinct().withColumn(name, F.lit(True))
    both = part("ts < timestamp_ntz '2024-01-03'", "a").join(part("ts >= timestamp_ntz '2024-01-03' and ts < timestamp_ntz '2024-01-05'", "b"), ["user_id", "event_type"], "full_outer")
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_first"), F.count_if(F.col("a").isNull()).alias("n_second"))


@query("J21_multiset_equality", """WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_type ORDER BY event_type) AS bag FROM events GROUP BY ALL) SELECT a.user_id, a.day FROM m a JOIN m b ON a.user_id = b.user_id AND b.day = a.day + 1 WHERE a.bag = b.bag""")
def multiset_equality(spark, d):
    """Days whose calls, as a multiset, equal the next day's."""
    m = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list("event_type")).alias("bag"))
    b = m.select("user_id", F.date_sub("day", 1).alias("day"), F.col("bag").alias("next"))
    return m.join(b, ["user_id", "day"]).where("bag = next").select("user_id", "day")


@query("J22_label_enrichment", f"""WITH {LINES} SELECT case_id, seq, code, coalesce(p_name, 'part ' || CAST(part AS VARCHAR)) AS label FROM lines LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON p_partkey = part""")
def labels(spark, d):
    """Codes with their label, or the code itself where there is none."""
    dim = table(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("part"), "p_name")
    return lines(spark, d).join(dim, "part", "left").select("case_id", "seq", "code", F.coalesce("p_name", F.concat(F.lit("part "), F.col("part").cast("string"))).alias("label"))


@query("J23_ordered_load", """WITH ids AS (SELECT doc_id * 3 AS case_id, row_number() OVER (ORDER BY text, doc_id) AS pos FROM documents WHERE doc_id < 300) SELECT pos, o_orderkey AS case_id, o_totalprice AS total FROM ids JOIN orders ON o_orderkey = case_id""")
def ordered_load(spark, d):
    """Cases of an id list with their place in it; the sort sees the list only."""
    ids = table(spark, d, "documents").where("doc_id < 300").select((F.col("doc_id") * 3).alias("case_id"), F.row_number().over(Window.orderBy("text", "doc_id")).cast("long").alias("pos"))
    return ids.join(cases(spark, d).select("case_id", "total"), "case_id").select("pos", "case_id", "total")


@query("J23_ordered_load_all", """WITH ids AS (SELECT doc_id * 3 AS case_id, row_number() OVER (ORDER BY text, doc_id) AS pos FROM documents) SELECT pos, case_id, o_totalprice AS total, o_orderkey IS NOT NULL AS found FROM ids LEFT JOIN orders ON o_orderkey = case_id""")
def ordered_load_all(spark, d):
    """Every id of the list with its place and its case; an id without a case is reported, not dropped."""
    ids = ranking.global_row_number_of_texts(table(spark, d, "documents").select("text", "doc_id"), ["text", "doc_id"], "pos").select((F.col("doc_id") * 3).alias("case_id"), F.col("pos").cast("long").alias("pos"))
    known = cases(spark, d).select("case_id", "total", F.lit(True).alias("found"))
    return ids.join(known, "case_id", "left").select("pos", "case_id", "total", F.coalesce("found", F.lit(False)).alias("found"))


@query("J27_reconcile", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0) SELECT CASE WHEN b.k IS NULL THEN 'only left' WHEN a.k IS NULL THEN 'only right' WHEN a.v = b.v THEN 'both' ELSE 'differ' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def reconcile(spark, d):
    """Two builds of one table, row by row."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    a, b = o.where("k % 11 <> 0").withColumnRenamed("v", "a"), o.where("k % 7 <> 0").select("k", F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("v")).alias("b"))
    kind = F.when(F.col("b").isNull(), "only left").when(F.col("a").isNull(), "only right").when(F.col("a") == F.col("b"), "both").otherwise("differ")
    return a.join(b, "k", "full_outer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("J27_reconcile_all", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), b AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders) SELECT CASE WHEN b.k IS NULL THEN 'only left' WHEN a.k IS NULL THEN 'only right' WHEN a.v = b.v THEN 'both' ELSE 'differ' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def reconcile_all(spark, d):
    """Two whole builds of one table: the second has some keys renamed and some values changed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"))
    b = o.select(F.when(F.col("k") % 11 == 0, -1 - F.col("k")).otherwise(F.col("k")).alias("k"), F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("a")).alias("b"))
    kind = F.when(F.col("b").isNull(), "only left").when(F.col("a").isNull(), "only right").when(F.col("a") == F.col("b"), "both").otherwise("differ")
    return o.join(b, "k", "full_outer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("J29_prefix_match", """WITH s AS (SELECT s_suppkey, substr(md5(CAST(s_suppkey AS VARCHAR)), 1, CAST(4 + s_suppkey % 3 AS INTEGER)) AS short FROM supplier), c AS (SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS full_id FROM customer) SELECT s_suppkey, c_custkey FROM s JOIN c ON starts_with(full_id, short)""")
def prefix_match(spark, d):
    """Short ids of four characters or more that are a prefix of a full one: an equi-join on
    the first four, then the rest."""
    md5 = lambda c: F.md5(F.col(c).cast("string"))
    s = table(spark, d, "supplier").select("s_suppkey", F.substring(md5("s_suppkey"), F.lit(1), (4 + F.col("s_suppkey") % 3).cast("int")).alias("short")).withColumn("k", F.substring("short", 1, 4))
    c = table(spark, d, "customer").select("c_custkey", md5("c_custkey").alias("full_id")).withColumn("k", F.substring("full_id", 1, 4))
    return s.join(c, "k").where(F.startswith("full_id", F.col("short"))).select("s_suppkey", "c_custkey")


@query("J30_prefix_habit_join", f"""WITH {LINES}, c AS (SELECT substr(finding, 1, 5) AS prefix, code, count(*) AS n FROM lines GROUP BY ALL), h AS (SELECT prefix, arg_min(code, (-n, code)) AS habit FROM c GROUP BY prefix) SELECT linestatus, count(*) AS n, count(*) FILTER (code = habit) AS n_habit FROM lines LEFT JOIN h ON h.prefix = substr(finding, 1, 5) GROUP BY linestatus""")
def prefix_habit(spark, d):
    rows = lines(spark, d).withColumn("prefix", F.substring("finding", 1, 5))
    h = rows.groupBy("prefix", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("prefix").agg(F.min_by("code", F.struct(-F.col("n"), "code")).alias("habit"))
    return rows.join(h, "prefix", "left").groupBy("linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code") == F.col("habit")).alias("n_habit"))


@query("A32_month_spend", f"""WITH {CASES} SELECT strftime(event_date, '%Y-%m') AS month, CAST(sum(CAST(round(total * 100) AS BIGINT) * CASE WHEN case_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS spent_half_cents, count(*) FILTER (case_id % 3 = 0) AS n_billed FROM cases WHERE status <> 'P' GROUP BY 1""")
def month_spend(spark, d):
    """Spend by month, in half cents: the billed sum where there is one, else half the
    computed one; one kind is left out. Whole numbers add up alike in any order."""
    billed = F.col("case_id") % 3 == 0
    return cases(spark, d).where("status <> 'P'").groupBy(F.date_format("event_date", "yyyy-MM").alias("month")).agg(F.sum(F.round(F.col("total") * 100).cast("long") * F.when(billed, 2).otherwise(1)).alias("spent_half_cents"), F.count_if(billed).alias("n_billed"))


@query("A45_case_groups", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY ALL), g AS (SELECT user_id, bool_and(ok) AS a, bool_or(ok) AS o, count(*) AS n FROM d GROUP BY user_id) SELECT CASE WHEN a THEN 'always' WHEN o THEN 'flipping' ELSE 'never' END AS grp, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_runs FROM g GROUP BY 1""")
def case_groups(spark, d):
    """Keys that are right in every run, in none, or in some."""
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("event_type") == "purchase").alias("ok")).groupBy("user_id").agg(F.bool_and("ok").alias("a"), F.bool_or("ok").alias("o"), F.count(F.lit(1)).alias("n"))
    return g.groupBy(F.when(F.col("a"), "always").when(F.col("o"), "flipping").otherwise("never").alias("grp")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_runs"))


@query("A49_win_loss", f"""WITH {SCORED} SELECT hit1 AS first_right, hit3 AS any_right, count(*) AS n FROM scored WHERE NOT failed GROUP BY ALL""")
def win_loss(spark, d):
    return scored(spark, d).where(~F.col("failed")).groupBy(F.col("hit1").alias("first_right"), F.col("hit3").alias("any_right")).agg(F.count(F.lit(1)).alias("n"))


@query("A51_token_ratio", """SELECT lang, quantile_disc(r, 0.5) AS p50, quantile_disc(r, 0.99) AS p99, CAST(floor(max(n_chars) / 1000) * 1000 AS BIGINT) AS ceiling FROM (SELECT lang, n_chars, round(length(text) / greatest(1, len(string_split(text, ' '))), 6) AS r FROM documents) GROUP BY lang""")
def token_ratio(spark, d):
    r = F.round(F.length("text") / F.greatest(F.lit(1), F.size(F.split("text", " "))), 6)
    rows = table(spark, d, "documents").select("lang", "n_chars", r.alias("r"))
    most = rows.groupBy("lang").agg((F.floor(F.max("n_chars") / 1000) * 1000).cast("long").alias("ceiling"))
    shares = selection.quantiles(rows, ["lang"], "r", {"p50": 0.5, "p99": 0.99}).withColumnRenamed("lang", "own")
    return most.join(shares, F.col("lang").eqNullSafe(F.col("own"))).select("lang", "p50", "p99", "ceiling")


@query("A3_poisson_bootstrap", f"""WITH {SCORED}, r AS (SELECT split, case_id, CAST(hit3 AS INTEGER) AS v, i AS resample, CAST(('0x' || substr(md5(CAST(case_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM scored, range(40) AS t(i)),
t AS (SELECT split, resample, v, {" + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in inference.POISSON_CUTS)} AS times FROM r) SELECT split, CAST(resample AS INTEGER) AS resample, round(sum(times * v) / sum(times), 6) AS mean FROM t GROUP BY ALL""")
def poisson(spark, d):
    """Forty resampled hit rates of each split."""
    rows = scored(spark, d).select("split", "case_id", F.col("hit3").cast("int").alias("v"))
    return inference.poisson_bootstrap(rows, "split", "case_id", "v").withColumn("mean", rounded(F.col("mean")))


@query("A3_exact_bootstrap")
def exact_bootstrap(spark, d):
    """The seeded bootstrap of all cases of each split: mean and percentile bounds of 2,000 resamples."""
    return inference.bootstrap(scored(spark, d).withColumn("v", F.col("hit3").cast("double")), "split", "v")


@query("A27_logistic_fit")
def logistic(spark, d):
    """Confidence against being right: intercept and slope."""
    a, b = inference.logistic_fit(scored(spark, d).where(~F.col("abstained")), "confidence", "hit3")
    return spark.createDataFrame([(round(a, 9), round(b, 9))], "intercept double, slope double")


_BM = r"""d AS (SELECT doc_id, doc_id // 10 AS day, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 6) AS words FROM documents), q AS (SELECT item_id, (item_id + 1) * 2 AS day, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 6)) AS words FROM benchmark),
p AS (SELECT doc_id, day, len, word, count(*) AS tf FROM (SELECT doc_id, day, len(words) AS len, unnest(words) AS word FROM d) GROUP BY ALL), qs AS (SELECT item_id, q.day, (SELECT count(*) FROM d WHERE d.day < q.day) AS n, (SELECT sum(len(words)) FROM d WHERE d.day < q.day) / (SELECT count(*) FROM d WHERE d.day < q.day) AS avg, unnest(words) AS word FROM q),
qd AS (SELECT qs.*, (SELECT count(*) FROM p WHERE p.word = qs.word AND p.day < qs.day) AS df FROM qs),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM qd JOIN p ON p.word = qd.word AND p.day < qd.day GROUP BY ALL)"""


# Queries dated over all documents, whatever their number: the last one follows every document.
_BM_WHOLE = _BM.replace("(item_id + 1) * 2 AS day", "(item_id + 1) * (SELECT max(doc_id // 10) + 1 FROM documents) // (SELECT max(item_id) + 1 FROM benchmark) AS day")


def _bm25(spark, d, whole=False):
    """``whole``: the queries' dates go over all documents; else only documents below 20 times the number of queries are earlier than one."""
    long_words = lambda c: F.filter(T.tokens(F.col(c)), lambda w: F.length(w) >= 6)
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).cast("long").alias("day"), long_words("text").alias("words"))
    items, day = table(spark, d, "benchmark"), (F.col("item_id") + 1) * 2
    if whole:
        items = items.join(F.broadcast(docs.agg(F.max("day").alias("last"))), F.lit(True)).join(F.broadcast(items.agg(F.max("item_id").alias("items"))), F.lit(True))  # one row each
        day = F.expr("(item_id + 1) * (last + 1) div (items + 1)")
    queries = items.select("item_id", day.alias("day"), long_words("text").alias("words"))
    return retrieval.as_of_scores(docs, queries, "doc_id", "item_id", "day", "words")


@query("R1_bm25_as_of", f"""WITH {_BM_WHOLE} SELECT item_id, doc_id, round(score, 5) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 5""")
def bm25(spark, d):
    """The five best earlier documents of each query, with statistics as of its date."""
    line = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return _bm25(spark, d, whole=True).withColumn("rank", F.row_number().over(line)).where("rank <= 5").select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("R2_found_at_5", f"""WITH {_BM}, t AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s), k AS (SELECT item_id, r, doc_id % 7 = item_id % 7 AS same FROM t WHERE r <= 5) SELECT count(DISTINCT item_id) AS n_queries, count(DISTINCT CASE WHEN same THEN item_id END) AS found_at_5, count(*) FILTER (same AND r = 1) AS nearest_at_1 FROM k""")
def found_at_5(spark, d):
    line = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    k = _bm25(spark, d).withColumn("r", F.row_number().over(line)).where("r <= 5").withColumn("same", F.col("doc_id") % 7 == F.col("item_id") % 7)
    return k.agg(F.countDistinct("item_id").alias("n_queries"), F.countDistinct(F.when(F.col("same"), F.col("item_id"))).alias("found_at_5"), F.count_if(F.col("same") & (F.col("r") == 1)).alias("nearest_at_1"))


@query("T12_md5_draw", f"""WITH {CASES} SELECT split, case_id FROM (SELECT split, case_id, row_number() OVER (PARTITION BY split ORDER BY md5(CAST(case_id AS VARCHAR)), case_id) AS r FROM cases) WHERE r <= 30""")
def md5_draw(spark, d):
    line = Window.partitionBy("split").orderBy(F.md5(F.col("case_id").cast("string")), "case_id")
    return cases(spark, d).withColumn("r", F.row_number().over(line)).where("r <= 30").select("split", "case_id")


@query("A46_exact_fraction_gate", f"""WITH {SCORED} SELECT split, count(*) FILTER (hit3) AS hits, count(*) AS n, 3 * count(*) FILTER (hit3) >= count(*) AS passes FROM scored GROUP BY split""")
def fraction_gate(spark, d):
    """Shares are tested as integers, never as rounded fractions."""
    return scored(spark, d).groupBy("split").agg(F.count_if("hit3").alias("hits"), F.count(F.lit(1)).alias("n")).withColumn("passes", 3 * F.col("hits") >= F.col("n"))


@query("A72_run_durations", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, date_diff('minute', min(date_trunc('minute', ts)), max(date_trunc('minute', ts))) AS minutes FROM events GROUP BY ALL) SELECT day, count(*) AS n, round(quantile_cont(minutes, 0.5), 4) AS median_minutes, CAST(max(minutes) AS BIGINT) AS most_minutes FROM s GROUP BY day""")
def run_durations(spark, d):
    minute = lambda f: F.unix_timestamp(F.date_trunc("minute", f("ts")).cast("timestamp"))
    s = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(((minute(F.max) - minute(F.min)) / 60).cast("long").alias("minutes"))
    medians = selection.quantiles(s, ["day"], "minutes", {"median": 0.5}, interpolated=True).select("day", F.round("median", 4).alias("median_minutes"))
    return s.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max("minutes").alias("most_minutes")).join(medians, "day").select("day", "n", "median_minutes", "most_minutes")


@query("X1_md5_units", """SELECT o_orderkey AS case_id, round(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0, 9) AS u FROM orders""")
def md5_units(spark, d):
    """The hash draw that stands in for a seeded generator wherever SQL must agree."""
    return cases(spark, d).select("case_id", F.round(md5_unit(F.col("case_id").cast("string")), 9).alias("u"))
