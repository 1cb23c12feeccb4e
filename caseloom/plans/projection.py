"""Sources, paths into dynamic JSON, roles, ladders and payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions import paths
from caseloom.sources import listing
from caseloom.sources.tables import newest_lines, overlay, table

from .analogues import CASES, LINES, cases, lines
from .registry import query


@query("P1_resolve_path", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(json_extract_string(props, '$.missing.deeper') AS VARCHAR) AS missing FROM events""")
def resolve_path(spark, d):
    """A dotted path into a JSON text; null for a missing hop."""
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", paths.at(v, "k", "string").alias("k"), paths.at(v, "missing.deeper", "string").alias("missing"))


@query("P3_text_role", """SELECT turn, conv_id, CASE WHEN trim(CASE WHEN turn % 4 = 0 THEN '   ' ELSE role END) <> '' THEN CASE WHEN turn % 4 = 0 THEN '   ' ELSE role END END AS role FROM conversations""")
def text_role(spark, d):
    """Blank text is null; other text keeps its spaces."""
    value = F.when(F.col("turn") % 4 == 0, F.lit("   ")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("turn", "conv_id", paths.text_role(value).alias("role"))


@query("P4_flag_fail_closed", """SELECT event_id, CASE WHEN json_extract(props, '$.flag') IS NULL OR CAST(json_extract(props, '$.flag') AS VARCHAR) = 'false' THEN event_type ELSE 'withheld' END AS shown
FROM (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN '{"k": 1}' WHEN 1 THEN '{"flag": false}' WHEN 2 THEN '{"flag": true}' ELSE '{"flag": "false"}' END AS props FROM events)""")
def flag_fail_closed(spark, d):
    """The value is shown only if the flag is absent or exactly false; the text "false" isn't."""
    raw = F.when(F.col("event_id") % 4 == 0, '{"k": 1}').when(F.col("event_id") % 4 == 1, '{"flag": false}').when(F.col("event_id") % 4 == 2, '{"flag": true}').otherwise('{"flag": "false"}')
    v = F.parse_json(raw)
    return table(spark, d, "events").select("event_id", F.when(paths.exactly_false_or_absent(v, "flag"), F.col("event_type")).otherwise("withheld").alias("shown"))


@query("P5_string_array_role", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['a', event_type] WHEN 1 THEN NULL ELSE [event_type] END AS strings FROM events""")
def string_array(spark, d):
    """Only the strings of an array; an array without one is null."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a", 1, "'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.lit("[1, 2]")).otherwise(F.concat(F.lit('["'), "event_type", F.lit('", null]')))
    return table(spark, d, "events").select("event_id", paths.strings_of(F.parse_json(raw)).alias("strings"))


@query("P6_first_match_lookup", f"""WITH {LINES}, m AS (SELECT case_id, quantity, row_number() OVER (PARTITION BY case_id ORDER BY seq, finding, price) AS r FROM lines WHERE linestatus = 'F')
SELECT case_id, CASE WHEN quantity > 5 THEN quantity END AS hours FROM m WHERE r = 1""")
def first_match(spark, d):
    """The first row of a kind decides, even where its value is no use."""
    first = lines(spark, d).where("linestatus = 'F'").groupBy("case_id").agg(F.min_by("quantity", F.struct("seq", "finding", "price")).alias("q"))
    return first.select("case_id", F.when(F.col("q") > 5, F.col("q")).alias("hours"))


@query("P7_phase", f"""WITH {LINES}, f AS (SELECT case_id, code, row_number() OVER (PARTITION BY case_id ORDER BY rest, seq, finding, price) AS r FROM lines) SELECT case_id, substr(code, 1, 3) AS phase FROM f WHERE r = 1""")
def phase(spark, d):
    """The phase of the first defining event, or of the first event if none defines."""
    rows = lines(spark, d).groupBy("case_id").agg(F.min_by("code", F.struct((~F.col("defining")).alias("rest"), "seq", "finding", "price")).alias("code"))
    return rows.select("case_id", F.substring("code", 1, 3).alias("phase"))


@query("P8_ordered_codes", f"""WITH {LINES} SELECT case_id, list(code ORDER BY rest, seq, finding, price) AS codes FROM lines GROUP BY case_id""")
def ordered_codes(spark, d):
    """Each case's codes, the defining ones first."""
    item = F.struct((~F.col("defining")).alias("rest"), "seq", "finding", "price", "code")
    ordered = F.array_sort(F.collect_list(item))
    return lines(spark, d).groupBy("case_id").agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))


@query("P9_finding_codes", f"""WITH {LINES} SELECT case_id, list(finding ORDER BY seq, finding, price) AS findings, coalesce(list(finding ORDER BY seq, finding, price) FILTER (defining), []) AS in_cause FROM lines GROUP BY case_id""")
def finding_codes(spark, d):
    item = F.struct("seq", "finding", "price", "defining")
    ordered = F.array_sort(F.collect_list(item))
    rows = lines(spark, d).groupBy("case_id").agg(ordered.alias("x"))
    return rows.select("case_id", F.transform("x", lambda x: x["finding"]).alias("findings"), F.transform(F.filter("x", lambda x: x["defining"]), lambda x: x["finding"]).alias("in_cause"))


@query("P10_split", f"""WITH {CASES} SELECT case_id, split FROM cases""")
def split(spark, d):
    return cases(spark, d).select("case_id", "split")


@query("P11_reason_ladder", f"""WITH {CASES} SELECT case_id, CASE WHEN event_date IS NULL THEN 'no date' WHEN status = 'P' THEN 'not completed' WHEN priority = '5-LOW' THEN 'not watched' WHEN year(event_date) < 1996 THEN 'too early' END AS reason FROM cases""")
def reasons(spark, d):
    """The first reason that excludes a case; null keeps it."""
    return cases(spark, d).select("case_id", F.coalesce(
        F.when(F.col("event_date").isNull(), "no date"), F.when(F.col("status") == "P", "not completed"), F.when(F.col("priority") == "5-LOW", "not watched"), F.when(F.year("event_date") < 1996, "too early"),
    ).alias("reason"))


@query("P12_investigation_class", """SELECT s_suppkey, nullif(regexp_extract(upper(substr(s_name, 1, 3)) || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || CASE WHEN s_suppkey % 3 = 0 THEN 'L' ELSE '7' END, '^[A-Z]{3}[0-9]{2}([A-Z])', 1), '') AS class FROM supplier""")
def investigation_class(spark, d):
    """A class letter out of a case number; null where the number has another form."""
    number = F.concat(F.upper(F.substring("s_name", 1, 3)), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.when(F.col("s_suppkey") % 3 == 0, "L").otherwise("7"))
    return table(spark, d, "supplier").select("s_suppkey", F.nullif(F.regexp_extract(number, r"^[A-Z]{3}\d{2}([A-Z])", 1), F.lit("")).alias("class"))


@query("P13_watchable", f"""WITH {CASES} SELECT case_id FROM cases WHERE status = 'O' AND priority IN ('1-URGENT', '2-HIGH') AND split = 'open'""")
def watchable(spark, d):
    return cases(spark, d).where(F.col("status").eqNullSafe("O") & F.col("priority").isin("1-URGENT", "2-HIGH") & (F.col("split") == "open")).select("case_id")


@query("P14_watched_keys", f"""WITH {CASES} SELECT customer, count(*) AS n FROM cases WHERE (status = 'O' OR event_date + INTERVAL 30 DAY >= DATE '2001-06-01') AND total > 100000 GROUP BY customer""")
def watched(spark, d):
    """Keys that are ongoing, or whose tail still runs, and that are watched."""
    tail = F.date_add("event_date", 30) >= F.lit("2001-06-01").cast("date")
    return cases(spark, d).where(((F.col("status") == "O") | tail) & (F.col("total") > 100000)).groupBy("customer").agg(F.count(F.lit(1)).alias("n"))


@query("P15_earliest_month", f"""WITH {CASES} SELECT min(strftime(event_date, '%Y-%m')) AS month FROM cases WHERE status = 'O'""")
def earliest_month(spark, d):
    return cases(spark, d).where("status = 'O'").agg(F.date_format(F.min("event_date"), "yyyy-MM").alias("month"))


@query("P16_day_mask", f"""WITH {CASES} SELECT case_id, CASE WHEN day(event_date) >= 14 THEN total END AS total, CASE WHEN day(event_date) >= 7 THEN priority END AS priority FROM cases""")
def day_mask(spark, d):
    """Columns that aren't known before a day are null until then."""
    day = F.dayofmonth("event_date")
    return cases(spark, d).select("case_id", F.when(day >= 14, F.col("total")).alias("total"), F.when(day >= 7, F.col("priority")).alias("priority"))


@query("P17_payload", """SELECT c_custkey, '{"balance_known":' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"name":"' || c_name || '"' END || ',"segment":"' || c_mktsegment || '"}' AS payload FROM customer""")
def payload(spark, d):
    """Allowed fields that aren't null, keys in order."""
    allowed = {"segment": F.col("c_mktsegment"), "name": F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), "balance_known": F.col("c_acctbal") > 0}
    return table(spark, d, "customer").select("c_custkey", paths.payload(allowed, set(allowed)).alias("payload"))


@query("P19_feed_filter", """SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS n_kept, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_other, count(*) FILTER (value IS NULL OR value < 0) AS n_bad FROM events GROUP BY user_id""")
def feed_filter(spark, d):
    """Rows of the wanted mode, others and unusable ones counted beside them."""
    kept = F.col("event_type").isin("click", "view")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_other"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("n_bad"))


@query("P20_redact_nested", f"""WITH {LINES} SELECT case_id, list(code || ':' || CAST(seq AS VARCHAR) ORDER BY seq, code, quantity, price) AS kept FROM lines GROUP BY case_id""")
def redact_nested(spark, d):
    """Owner fields go from every element of a nested array."""
    item = F.struct("seq", "code", "quantity", "price", F.col("supplier").alias("owner"))
    rows = lines(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("aircraft"))
    clean = rows.withColumn("aircraft", F.transform("aircraft", lambda x: x.dropFields("owner")))
    if paths.fields_named(clean.schema, {"owner"}):
        raise ValueError("an owner field is left")
    return clean.select("case_id", F.transform("aircraft", lambda x: F.concat_ws(":", x["code"], x["seq"].cast("string"))).alias("kept"))


@query("P21_document_admission", """SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars < 50 THEN 'photo only' WHEN lang <> 'en' THEN 'other language' WHEN n_chars > 20000 THEN 'too long' ELSE 'admitted' END AS status FROM documents""")
def admission(spark, d):
    status = F.when(F.col("n_chars").isNull(), "unknown").when(F.col("n_chars") < 50, "photo only").when(F.col("lang") != "en", "other language").when(F.col("n_chars") > 20000, "too long").otherwise("admitted")
    return table(spark, d, "documents").select("doc_id", status.alias("status"))


@query("P22_page_rule", """SELECT doc_id, CASE WHEN n_chars < 50 THEN true WHEN n_chars > 300 THEN false END AS image_only FROM documents""")
def page_rule(spark, d):
    """True, false, or null where the rule can't tell."""
    return table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 50, True).when(F.col("n_chars") > 300, False).alias("image_only"))


@query("P23_scrub", """SELECT c_custkey, regexp_replace(c_name || ' key=' || CAST(c_custkey AS VARCHAR), '#[0-9]+|key=[0-9]+', '***', 'g') AS message FROM customer""")
def scrub(spark, d):
    """Numbers and keys are struck from an error text."""
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(F.concat("c_name", F.lit(" key="), F.col("c_custkey").cast("string")), "#[0-9]+|key=[0-9]+", "***").alias("message"))


@query("S5_months_between", """SELECT CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)""")
def months_between(spark, d):
    o = table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    month = lambda c: F.to_date(F.date_trunc("month", c))
    return o.select(F.explode(F.sequence(month("a"), month("b"), F.expr("interval 1 month"))).alias("month"))


@query("S6_latest_entries", f"""WITH {CASES} SELECT month, case_id, total FROM (SELECT strftime(event_date, '%Y-%m') AS month, case_id, total, row_number() OVER (PARTITION BY strftime(event_date, '%Y-%m') ORDER BY event_date DESC, case_id) AS r FROM cases) WHERE r = 1""")
def latest_entries(spark, d):
    """The newest manifest line of each month; of equal times the first line."""
    rows = cases(spark, d).select(F.date_format("event_date", "yyyy-MM").alias("month"), "event_date", "case_id", "total")
    return newest_lines(rows, "month", "event_date", "case_id").select("month", "case_id", "total")


@query("S4_missing_months", """WITH m AS (SELECT CAST(unnest(generate_series(DATE '1994-06-01', DATE '1996-06-01', INTERVAL 1 MONTH)) AS DATE) AS month), have AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders) SELECT m.month FROM m ANTI JOIN have USING (month)""")
def missing_months(spark, d):
    """Months that no manifest line has yet."""
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit("1994-06-01").cast("date"), F.lit("1996-06-01").cast("date"), F.expr("interval 1 month"))).alias("month"))
    have = table(spark, d, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).distinct()
    return wanted.join(have, "month", "left_anti")


@query("S13_overlay", """SELECT coalesce(a.code, b.code) AS code, coalesce(b.label, a.label) AS label FROM (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS label FROM part) a FULL JOIN (SELECT CAST(p_partkey * 2 AS VARCHAR) AS code, p_brand AS label FROM part WHERE p_size < 10) b ON a.code = b.code""")
def dimension_overlay(spark, d):
    """Labels of codes with a supplement laid over them."""
    part = table(spark, d, "part")
    base = part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"))
    return overlay(base, part.where("p_size < 10").select((F.col("p_partkey") * 2).cast("string").alias("code"), F.col("p_brand").alias("label")))


@query("S7_verify_digests", """SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def digests(spark, d):
    """What a manifest would hold of each document."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("S16_listing_links", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS INTEGER) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs FROM pages""")
def listing_links(spark, d):
    """Title and list links of each page; what was counted must equal what was parsed."""
    return listing.parse(table(spark, d, "pages")).select("page_id", "n_links", "title", "hrefs")


@query("S23_hash_ledger", """WITH now AS (SELECT user_id AS k, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS h FROM events GROUP BY 1), was AS (SELECT user_id AS k, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS h FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT now.k, CASE WHEN was.k IS NULL THEN 'new' ELSE 'changed' END AS kind FROM now LEFT JOIN was USING (k) WHERE was.h IS DISTINCT FROM now.h""")
def hash_ledger(spark, d):
    """Manifests that are new or differ from the ledger's last line."""
    e = table(spark, d, "events")
    digest = lambda rows: rows.groupBy(F.col("user_id").alias("k")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("event_id")).cast("array<string>")), 256).alias("h"))
    was = digest(e.where("ts < timestamp_ntz '2024-01-30'")).withColumnRenamed("h", "was")
    joined = digest(e).join(was, "k", "left").where(~F.col("h").eqNullSafe(F.col("was")))
    return joined.select("k", F.when(F.col("was").isNull(), "new").otherwise("changed").alias("kind"))


@query("S22_manifest_compare", """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def manifest_compare(spark, d):
    """A folder against its manifest: missing, extra and changed files."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    a = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2(text, 256).alias("a"))
    b = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(text), 256).alias("b"))
    return a.join(b, "doc_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("kind"))


@query("S22_manifest_compare_all", """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE coalesce(text, '') END) AS h FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def manifest_compare_all(spark, d):
    """Every file against a manifest in which some are renamed and some changed: no id is left out of both sides."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", F.sha2(text, 256).alias("a"))
    b = docs.select(F.when(F.col("doc_id") % 5 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(text), 256).alias("b"))
    return a.join(b, "doc_id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed").alias("kind"))


@query("S21_export_rows", f"""WITH {CASES} SELECT split, count(*) AS n_cases, min(case_id) AS first_case, round(sum(total), 2) AS total FROM cases GROUP BY split""")
def export_index(spark, d):
    """The index of an export: what each part holds."""
    return cases(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_cases"), F.min("case_id").alias("first_case"), F.round(F.sum("total"), 2).alias("total"))


@query("W1_newest_copy", f"""WITH {CASES} SELECT customer, case_id, event_date FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY event_date DESC, case_id) AS r FROM cases) WHERE r = 1""")
def newest_copy(spark, d):
    """The newest copy of each key; of equal times the first seen. One max per key, combined before the shuffle."""
    best = F.max_by(F.struct("case_id", "event_date"), F.struct("event_date", -F.col("case_id")))
    return cases(spark, d).groupBy("customer").agg(best.alias("b")).select("customer", "b.case_id", "b.event_date")


@query("W2_duplicate_counters", f"""WITH {CASES}, r AS (SELECT customer, event_date, max(event_date) OVER (PARTITION BY customer ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM cases)
SELECT count(best) AS n_duplicates, count(*) FILTER (event_date > best) AS n_replaced FROM r""")
def duplicate_counters(spark, d):
    """Copies seen and copies that replaced an older one, in order of arrival."""
    before = Window.partitionBy("customer").orderBy("case_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = cases(spark, d).select("event_date", F.max("event_date").over(before).alias("best"))
    return rows.agg(F.count("best").alias("n_duplicates"), F.count_if(F.col("event_date") > F.col("best")).alias("n_replaced"))
