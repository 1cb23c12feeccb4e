"""The raw store, the nightly stream, redaction and names, each over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.stats import rounded
from caseloom.operators import automaton, guard
from caseloom.sources import listing, store
from caseloom.sources.places import shared_folder
from caseloom.sources.tables import append_jsonl, read_jsonl, table
from caseloom.streaming import watch

from .analogues import CASES
from .registry import ORACLES, query


@query("W5_status_tail_stream", ORACLES["W5_status_tail"])
def status_tail_stream(spark, d):
    """W5 by the keyed state of a stream that takes up what is there and ends."""
    events = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").parquet(f"{d.rstrip('/')}/events.parque[t]")  # a pattern, as the table may be one file
    place = shared_folder(spark, f"watch-{uuid.uuid4().hex}")
    rows = watch.WatchTable(f"{place}/rows")
    watch.run(spark, events.select(F.col("user_id").alias("key"), F.to_date("ts").alias("run"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("status")), rows, f"{place}/checkpoint", "view", 3)
    return rows.read(spark).select(F.col("key").alias("user_id"), "run", "status", "watch_until")


#: Records of a page.
PAGE = 500
RECORD = "case_id: bigint, day: string, status: string, total: double"


def raw_orders(spark, d):
    """A raw store fetched from the orders: a page holds up to PAGE neighbouring keys of a month."""
    o = table(spark, d, "orders")
    record = F.struct(F.col("o_orderkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    page = F.format_string("page-%05d.json", F.floor(F.col("o_orderkey") / (PAGE * 4)).cast("int"))
    pages = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), page.alias("page")).agg(F.to_json(F.struct(F.collect_list(record).alias("data"))).alias("content"))
    raw = store.RawStore(spark, shared_folder(spark, f"raw-{uuid.uuid4().hex}"))
    raw.add(pages, "2024-01-01T00:00:00")
    raw.add(pages, "2024-01-02T00:00:00")  # a rerun finds nothing missing
    return raw


@query("S8_raw_records", """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, o_totalprice AS total FROM orders""")
def raw_records(spark, d):
    """Every record of the latest fetch of each month, pages held against their digests."""
    return raw_orders(spark, d).records(RECORD).select("month", "case_id", "day", "status", "total")


@query("S4_staged_months", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS records FROM orders GROUP BY 1""")
def staged_months(spark, d):
    """The manifest's newest line of each month, after a rerun that appended nothing."""
    return raw_orders(spark, d).latest().select("month", "records")


@query("S9_processed_from_pages", f"""WITH {CASES}, j AS (SELECT *, CASE WHEN status = 'P' THEN 'pending' WHEN total < 1000 THEN 'small' END AS reason FROM cases)
SELECT 'split' AS kind, split AS name, count(*) AS n FROM j WHERE reason IS NULL GROUP BY split UNION ALL SELECT 'excluded', reason, count(*) FROM j WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'rows', 'all', count(*) FROM j WHERE reason IS NULL""")
def processed_from_pages(spark, d):
    """From raw pages to the processed file with its counts: newest copies, a ladder of reasons, one Parquet table and its meta."""
    records = raw_orders(spark, d).records(RECORD)
    kept, excluded = store.build(records, "case_id", ["month"], [("pending", F.col("status") == "P"), ("small", F.col("total") < 1000)])
    year = F.substring("day", 1, 4).cast("int")
    kept = kept.withColumn("split", F.when(year <= 1998, "dev").when(year <= 2000, "heldout").otherwise("open"))
    meta = store.write_processed(kept, excluded, shared_folder(spark, f"processed-{uuid.uuid4().hex}"))
    rows = [("split", k, n) for k, n in meta["counts_by_split"].items()] + [("excluded", k, n) for k, n in meta["excluded"].items()] + [("rows", "all", meta["rows"])]
    return spark.createDataFrame(rows, "kind string, name string, n bigint")  # a row a split and reason


@query("S12_guarded_lines", """SELECT c_custkey, c_name, c_acctbal FROM customer""")
def guarded_lines(spark, d):
    """JSON lines written and read back under a schema that every line must meet."""
    place = shared_folder(spark, f"lines-{uuid.uuid4().hex}")
    append_jsonl(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), place)
    return read_jsonl(spark, place, "c_custkey bigint, c_name string, c_acctbal double")


@query("P18_sample_refusals", """SELECT s.item_id, l.item_id IS NOT NULL AS refused FROM benchmark s LEFT JOIN (SELECT DISTINCT doc_id AS item_id FROM labels WHERE toxic = 1) l USING (item_id)""")
def sample_refusals(spark, d):
    """Of each wanted case, whether it is withheld; what is left of the sample passes the fence."""
    wanted, sealed = table(spark, d, "benchmark").select("item_id"), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id")).distinct()
    free = store.fence(wanted.join(sealed, "item_id", "left_anti"), sealed, "item_id", "sealed")
    return free.withColumn("refused", F.lit(False)).unionByName(wanted.join(sealed, "item_id", "left_semi").withColumn("refused", F.lit(True)))


@query("J15_folded_leakage")
def folded_leakage(spark, d):
    """J15 with compatibility forms folded and notices dropped, which SQL has no function for."""
    needles = guard.needles(table(spark, d, "benchmark"), "item_id", "text", fold=T.fold_forms, without=T.NOTICE)
    return guard.leaks(table(spark, d, "documents"), "doc_id", "text", needles, "item_id", T.fold_forms)


_VALUES = """v AS (SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS value FROM benchmark) WHERE regexp_full_match(value, '[a-z]{7,}')),
k AS (SELECT value, CASE WHEN length(value) % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM v)"""


@query("A70_counted_redaction", rf"""WITH {_VALUES}, t AS (SELECT doc_id, length(text) AS n, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, count(*) FILTER (kind = 'even') AS n_even, count(*) FILTER (kind = 'odd') AS n_odd, CAST(sum(length(value) - 3) AS BIGINT) AS gone FROM t JOIN k ON t.w = k.value GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_even, 0) AS n_even, coalesce(n_odd, 0) AS n_odd, CAST(length(text) - coalesce(gone, 0) AS INTEGER) AS n_left FROM documents d LEFT JOIN h USING (doc_id)""")
def counted_redaction(spark, d):
    """Words of a dictionary struck from every text, whole and in any case, with counts by kind."""
    # The dictionary is lower case and of single words, so that no two values overlap.
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("value")).where(F.col("value").rlike("^[a-z]{7,}$")).distinct()
    values = words.withColumn("kind", F.when(F.length("value") % 2 == 0, "even").otherwise("odd"))
    done = automaton.redact(table(spark, d, "documents").select("doc_id", "text"), "text", values, "value", "kind", "[#]")
    n = lambda k: F.coalesce(F.col("counts")[k], F.lit(0)).alias(f"n_{k}")
    return done.select("doc_id", n("even"), n("odd"), F.length("redacted").alias("n_left"))


@query("A70_name_coverage", r"""WITH names AS (SELECT 'part' AS field, trim(p_name) AS name FROM part UNION ALL SELECT 'customer', trim(c_name) FROM customer UNION ALL SELECT 'supplier', trim(s_name) FROM supplier UNION ALL SELECT 'key', CAST(s_suppkey AS VARCHAR) FROM supplier),
w AS (SELECT *, len(string_split(name, ' ')) AS n_words, lower(list_last(string_split(name, ' '))) AS surname, contains(upper(name), 'SUPPLIER') OR contains(upper(name), 'CUST') AS organisation, regexp_matches(name, '^[0-9]+$') AS digits FROM names WHERE name <> ''),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_type), '[a-z]+')) AS word FROM part),
s AS (SELECT DISTINCT field, surname FROM w WHERE NOT organisation AND n_words >= 2)
SELECT w.field, count(*) AS n_names, count(*) FILTER (organisation) AS n_organisations, count(*) FILTER (digits) AS n_digits, min(length(name)) AS shortest, max(n_words) AS most_words,
  round(avg(n_words), 6) AS mean_words, any_value(coalesce(x.n, 0)) AS n_surnames, any_value(coalesce(x.c, 0)) AS n_collisions
FROM w LEFT JOIN (SELECT field, count(*) AS n, count(word) AS c FROM s LEFT JOIN words ON s.surname = words.word GROUP BY field) x ON w.field = x.field GROUP BY w.field""")
def name_coverage(spark, d):
    """Of each field's names: how many bear an organisation's token or only digits, their lengths, and how many surnames are words as well."""
    part = table(spark, d, "part")
    of = lambda t, c, field: table(spark, d, t).select(F.lit(field).alias("field"), F.trim(F.col(c).cast("string")).alias("name"))
    names = of("part", "p_name", "part").unionByName(of("customer", "c_name", "customer")).unionByName(of("supplier", "s_name", "supplier")).unionByName(of("supplier", "s_suppkey", "key")).where("name <> ''")
    parts = F.split("name", " ")
    upper = F.upper("name")
    w = names.select("field", "name", F.size(parts).alias("n_words"), F.lower(F.element_at(parts, -1)).alias("surname"), (F.contains(upper, F.lit("SUPPLIER")) | F.contains(upper, F.lit("CUST"))).alias("organisation"), F.col("name").rlike("^[0-9]+$").alias("digits"))
    words = part.select(F.explode(F.regexp_extract_all(F.lower("p_type"), F.lit("[a-z]+"), F.lit(0))).alias("surname")).distinct().withColumn("known", F.lit(1))
    surnames = w.where(~F.col("organisation") & (F.col("n_words") >= 2)).select("field", "surname").distinct()
    met = surnames.join(words, "surname", "left").groupBy("field").agg(F.count(F.lit(1)).alias("n_surnames"), F.count("known").alias("n_collisions"))
    counts = w.groupBy("field").agg(F.count(F.lit(1)).alias("n_names"), F.count_if("organisation").alias("n_organisations"), F.count_if("digits").alias("n_digits"), F.min(F.length("name")).alias("shortest"), F.max("n_words").alias("most_words"), rounded(F.avg("n_words")).alias("mean_words"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(met, "field", "left").select(*counts.columns, none("n_surnames"), none("n_collisions"))


@query("S16_listing_entries", r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS labels FROM pages), e AS (SELECT page_id, unnest(range(len(hrefs))) AS position, hrefs, labels FROM p)
SELECT page_id, CAST(position AS INTEGER) AS position, hrefs[position + 1] AS href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(labels[position + 1], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0b\x0c\r]+', ' ', 'g')) AS label,
  nullif(regexp_extract(hrefs[position + 1], '([^/?#]*)/?(?:[?#].*)?$', 1), '') AS document FROM e""")
def listing_entries(spark, d):
    """Every listed document of every page, in order; a page that declares other rows than were parsed fails the job."""
    return listing.entries(table(spark, d, "pages")).select("page_id", "position", "href", "label", "document")
