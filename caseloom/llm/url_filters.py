"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are binomial counts for each host. Beta priors shrink
them level by level: all pages -> public suffix -> registered domain -> host.
At each level the prior's strength comes from the spread between the units
below (method of moments), so sparse hosts lean on their domain and well
observed hosts on themselves. A host is blocked where even the favourable end of its
posterior for the good share lies below the wanted share, by default a part of the
overall one, so that a corpus of poor pages doesn't lose all of its hosts. DataFrame functions
only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels that are told apart from a registered domain. A parameter.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A host is bad if its good share lies below this part of the overall share.
WANTED = 0.9


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, action), else null.

    ``rules`` are (``host/path`` prefix, ``allow`` or ``block``); a rule fits its
    host and every subdomain. Equal lengths: the longer host, then block, wins.
    """
    ranked = sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]), r[1] == "block", r[0]), reverse=True)
    kind = "struct<name:string,path:string,rule:string,action:string>"
    parts = [(t.partition("/")[0], "".join(t.partition("/")[1:]), t, action) for t, action in ranked]
    known = F.array(*[F.struct(*[F.lit(v) for v in part]).cast(kind) for part in parts]).cast(f"array<{kind}>")
    fits = lambda r: ((host == r["name"]) | F.endswith(host, F.concat(F.lit("."), r["name"]))) & F.startswith(path, r["path"])
    return let(F.get(F.filter(known, fits), 0), lambda hit: F.when(hit.isNotNull(), F.struct(hit["rule"].alias("rule"), hit["action"].alias("action"))))


def _labels(host: Column, suffixes: Sequence[str]) -> Column:
    """Labels of the host's public suffix."""
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.lit(2)).otherwise(F.lit(1))


def _last(host: Column, n: Column) -> Column:
    parts = F.split(host, "\\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the public suffix and one label more; a shorter host is its own domain."""
    return _last(host, _labels(host, suffixes) + 1)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: the last two labels if they are among ``suffixes``, else the last one."""
    return _last(host, _labels(host, suffixes))


def _strength(units: DataFrame, by: list[str]) -> DataFrame:
    """Beta prior strength by ``by``, from the counts (n, good) of the units below.

    Method of moments on the beta-binomial: with shares p, mean m and sizes n,
    the between-unit variance v = weighted variance less m(1-m)/n; strength is
    m(1-m)/v - 1, held in [1, 1000]. A single unit, or no spread, gives 1000.
    """
    sums = units.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("k"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("sq")
    )
    m = F.col("good") / F.col("n")
    between = (F.col("sq") - F.col("n") * m * m - (F.col("k") - 1) * m * (1 - m)) / F.greatest(F.col("n"), F.lit(1))
    raw = F.when((F.col("k") > 1) & (between > 0), m * (1 - m) / between - 1)
    return sums.select(*by, "n", "good", F.when(raw.isNull(), F.lit(1000.0)).otherwise(F.least(F.greatest(raw, F.lit(1.0)), F.lit(1000.0))).alias("strength"))


def host_reputation(outcomes: DataFrame, z: float = 1.96, hosts: DataFrame | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of the good share of every labelled host, and of every one in ``hosts``.

    ``outcomes``: host and good (0/1; null rows don't count). ``hosts``: host; repeats
    don't matter. Returns host, n, good, posterior mean and its bounds at ``z`` standard
    deviations, and ``overall``, the good share of all outcomes. A host without outcomes has its domain's prior, else its suffix's, else the
    overall one; without any outcome at all mean and bounds are null. Counts
    are summed on the map side first, so one host with a third of all pages sends
    one row from each task; every later level only sees one row a host.
    """
    counted = outcomes.where("host is not null and good is not null").select("host", F.lit(1).cast("long").alias("n"), F.col("good").cast("long").alias("good"))
    if hosts is not None:
        counted = counted.unionByName(hosts.where("host is not null").select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good")))
    hosts = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    # Strengths: the spread of hosts within a domain, of domains within a suffix, of suffixes within all.
    domains = _strength(hosts.where("n > 0"), ["domain", "suffix"]).withColumnRenamed("strength", "s_domain")
    ends = _strength(domains, ["suffix"]).withColumnRenamed("strength", "s_suffix")
    everything = _strength(ends, []).select(((F.col("good") + 1) / (F.col("n") + 2)).alias("m_all"), F.col("strength").alias("s_all"))
    ends = ends.crossJoin(F.broadcast(everything))  # one row: the grand total
    ends = ends.select("suffix", "s_suffix", ((F.col("good") + F.col("m_all") * F.col("s_all")) / (F.col("n") + F.col("s_all"))).alias("m_suffix"))
    domains = domains.join(ends, "suffix").select("domain", "s_domain", ((F.col("good") + F.col("m_suffix") * F.col("s_suffix")) / (F.col("n") + F.col("s_suffix"))).alias("m_domain"))
    judged = hosts.join(domains, "domain", "left").join(ends, "suffix", "left").crossJoin(F.broadcast(everything))
    m, s = F.coalesce("m_domain", "m_suffix", "m_all"), F.coalesce("s_domain", "s_suffix", "s_all")
    a = F.col("good") + m * s
    b = F.col("n") - F.col("good") + (1 - m) * s
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    # greatest and least skip nulls: a bound without a posterior stays null.
    known = lambda c: F.when(mean.isNotNull(), c)
    return judged.select("host", "n", "good", mean.alias("mean"), known(F.greatest(F.lit(0.0), mean - z * sd)).alias("low"), known(F.least(F.lit(1.0), mean + z * sd)).alias("high"), F.col("m_all").alias("overall"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), min_good: float | None = None, z: float = 1.96, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior for every page.

    ``outcomes`` has host and good. The wanted share is ``min_good``, or WANTED of the
    overall share. Unlabelled hosts are judged by their domain's,
    suffix's or the overall prior; empty ones are allowed: there's no evidence against
    them. Null urls have empty host and path; repeated
    rows stay; an empty table gives an empty result, and without outcomes only rules decide; columns of
    other names are ignored. The join is a plain equi-join on host, so that adaptive execution
    splits a hot host's pages.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = parts.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    known = host_reputation(outcomes, z, parts.where("host <> ''").select("host"), suffixes)
    judged = parts.join(known.select("host", "mean", "low", "high", "overall"), "host", "left")
    wanted = F.col("overall") * WANTED if min_good is None else F.lit(min_good)
    verdict = F.coalesce(F.col("hit.action"), F.when(F.col("high") < wanted, "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "mean", "low", "high")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose url ends in the number of a labelled document: good
    means quality 1 and not toxic. The tables name no page of a document otherwise: the number that ends
    a page's path runs over the documents' ids, so that a label of the document is one of its page."""
    number = F.regexp_extract(url_path(F.col("url")), "([0-9]{1,18})[^/0-9]*/?$", 1)
    numbered = pages.select(url_host(F.col("url")).alias("host"), number.alias("number"))
    numbered = numbered.where("number <> '' and host <> ''").select("host", F.col("number").cast("long").alias("doc_id"))
    good = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("good"))
    return numbered.join(good, "doc_id").select("host", "good")


#: The rules that the registered query applies.
QUERY_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    judged = filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), QUERY_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u),
good AS (SELECT doc_id, min(CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
o AS (
  SELECT host, good FROM (SELECT host, regexp_extract(path, '([0-9]{1,18})[^/0-9]*/?$', 1) AS number FROM p WHERE host <> '')
  JOIN good ON number <> '' AND try_cast(number AS BIGINT) = doc_id WHERE good IS NOT NULL),
parts AS (SELECT host, string_split(host, '.') AS w FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
named AS (
  SELECT host, w, CASE WHEN len(w) > 1 AND list_contains(['SUFFIXES'], w[-2] || '.' || w[-1]) THEN 2 ELSE 1 END AS k FROM parts),
h AS (
  SELECT named.host, array_to_string(w[greatest(1, len(w) - k):], '.') AS domain, array_to_string(w[greatest(1, len(w) - k + 1):], '.') AS suffix,
         count(o.good) AS n, coalesce(sum(o.good), 0) AS good
  FROM named LEFT JOIN o ON named.host = o.host GROUP BY ALL),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, count(*) AS k, sum(good * good / n) AS sq FROM h WHERE n > 0 GROUP BY domain, suffix),
d AS (SELECT *, good / n AS m, (sq - n * (good / n) * (good / n) - (k - 1) * (good / n) * (1 - good / n)) / greatest(n, 1) AS v FROM d1),
d2 AS (SELECT domain, suffix, n, good, coalesce(CASE WHEN k > 1 AND v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000) END, 1000) AS s FROM d),
x1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, count(*) AS k, sum(good * good / n) AS sq FROM d2 GROUP BY suffix),
x AS (SELECT *, good / n AS m, (sq - n * (good / n) * (good / n) - (k - 1) * (good / n) * (1 - good / n)) / greatest(n, 1) AS v FROM x1),
x2 AS (SELECT suffix, n, good, coalesce(CASE WHEN k > 1 AND v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000) END, 1000) AS s FROM x),
a1 AS (SELECT sum(n) AS n, sum(good) AS good, count(*) AS k, sum(good * good / n) AS sq FROM x2),
a AS (SELECT *, good / n AS m, (sq - n * (good / n) * (good / n) - (k - 1) * (good / n) * (1 - good / n)) / greatest(n, 1) AS v FROM a1),
a2 AS (SELECT (good + 1) / (n + 2) AS m, coalesce(CASE WHEN k > 1 AND v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1000) END, 1000) AS s FROM a),
xm AS (SELECT suffix, x2.s, (good + a2.m * a2.s) / (n + a2.s) AS m FROM x2, a2),
dm AS (SELECT domain, d2.s, (good + xm.m * xm.s) / (n + xm.s) AS m FROM d2 JOIN xm USING (suffix)),
j AS (SELECT host, n, good, coalesce(dm.m, xm.m, a2.m) AS m, coalesce(dm.s, xm.s, a2.s) AS s, a2.m AS overall
      FROM h LEFT JOIN dm USING (domain) LEFT JOIN xm USING (suffix), a2),
b AS (SELECT host, good + m * s AS a, n - good + (1 - m) * s AS b, overall FROM j),
r AS (SELECT host, least(1.0, a / (a + b) + 1.96 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS high, overall FROM b)
SELECT page_id, p.host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN high < overall * 0.9 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN r ON p.host = r.host
""".replace("SUFFIXES", "', '".join(SUFFIXES))
