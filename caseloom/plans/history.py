"""History of keys across runs: arrivals, as-of values, diffs, streaks, transitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions.stats import rounded
from caseloom.operators import history
from caseloom.sources.tables import table

from .registry import query

#: A day of events is a run; a user's last event of the day is its snapshot.
SNAPS = """snaps AS (SELECT user_id, CAST(ts AS DATE) AS run, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY ALL)"""


def snapshots(spark, d):
    last = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("run")).agg(F.max_by("event_type", last).alias("status"), F.max_by("value", last).alias("value"), F.count(F.lit(1)).alias("n"))


_CH = f"""{SNAPS}, lagged AS (SELECT user_id, run, status, lag(status) OVER w AS old, lag(run) OVER w AS absent_run FROM snaps WINDOW w AS (PARTITION BY user_id ORDER BY run)), ch AS (SELECT * FROM lagged WHERE absent_run IS NULL OR status IS DISTINCT FROM old)"""


def _changes(spark, d):
    return history.changes(snapshots(spark, d).select("user_id", "run", "status"), ["user_id"], "run", "status")


@query("W4_change_detection", f"""WITH {_CH} SELECT user_id, run, status, old, absent_run FROM ch""")
def change_detection(spark, d):
    """When each user's status changed, between which runs, and from what."""
    return _changes(spark, d).select("user_id", "run", "status", "old", "absent_run")


@query("W3_first_snapshot", f"""WITH {SNAPS} SELECT user_id, min(run) AS run, arg_min(status, run) AS status FROM snaps GROUP BY user_id""")
def first_snapshot(spark, d):
    return snapshots(spark, d).groupBy("user_id").agg(F.min("run").alias("run"), F.min_by("status", "run").alias("status"))


@query("A36_latest_snapshot", """SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""")
def latest_snapshot(spark, d):
    """The last value of each role of each key."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("J1_field_arrivals", f"""WITH {_CH}, first AS (SELECT user_id, min(run) AS first_run FROM snaps GROUP BY user_id) SELECT ch.user_id, ch.status, ch.run, ch.absent_run, date_diff('day', ch.absent_run, ch.run) AS width FROM ch JOIN first USING (user_id) WHERE ch.run > first_run""")
def field_arrivals(spark, d):
    """Values that arrived after a key's first run, with the width of the interval."""
    first = snapshots(spark, d).groupBy("user_id").agg(F.min("run").alias("first_run"))
    return _changes(spark, d).join(first, "user_id").where("run > first_run").select("user_id", "status", "run", "absent_run", F.datediff("run", "absent_run").cast("long").alias("width"))


@query("J3_first_sight_counts", f"""WITH {_CH}, first AS (SELECT user_id, min(run) AS first_run FROM snaps GROUP BY user_id) SELECT status, count(*) AS n FROM ch JOIN first ON ch.user_id = first.user_id AND ch.run = first_run GROUP BY status""")
def first_sight(spark, d):
    first = snapshots(spark, d).groupBy("user_id").agg(F.min("run").alias("run"))
    return _changes(spark, d).join(first, ["user_id", "run"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("J4_polls_by_run", f"""WITH {SNAPS} SELECT run, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_polls, count(*) FILTER (status = 'error') AS n_failed FROM snaps GROUP BY run""")
def polls(spark, d):
    return snapshots(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_polls"), F.count_if(F.col("status") == "error").alias("n_failed"))


@query("J5_status_as_of", f"""WITH {_CH}, probes AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 7 = 0)
SELECT event_id, p.user_id, day, CASE WHEN (SELECT count(*) FROM ch WHERE ch.user_id = p.user_id AND ch.run <= p.day) > 0 THEN (SELECT arg_max(status, run) FROM ch WHERE ch.user_id = p.user_id AND ch.run <= p.day) ELSE (SELECT arg_min(old, run) FROM ch WHERE ch.user_id = p.user_id AND ch.run > p.day) END AS in_force FROM probes p""")
def status_as_of(spark, d):
    """The status in force on a day: the last change up to it, else what the next one replaced."""
    probes = table(spark, d, "events").where("event_id % 7 = 0").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return history.as_of(probes, _changes(spark, d), "user_id", "day", "run", "old", "status", "in_force")


@query("J5_status_as_of_all", f"""WITH {_CH}, probes AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events)
SELECT event_id, p.user_id, day, CASE WHEN b.run IS NOT NULL THEN b.status ELSE a.old END AS in_force FROM probes p ASOF LEFT JOIN ch b ON b.user_id = p.user_id AND p.day >= b.run ASOF LEFT JOIN ch a ON a.user_id = p.user_id AND p.day < a.run""")
def status_as_of_all(spark, d):
    """The status in force on the day of each event, whatever its number; J5_status_as_of has the seventh that its SQL asks for."""
    probes = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return history.as_of(probes, _changes(spark, d), "user_id", "day", "run", "old", "status", "in_force")


@query("J6_arrival_class", f"""WITH {_CH}, closed AS (SELECT user_id, min(run) AS closed_run FROM ch WHERE status = 'purchase' GROUP BY user_id) SELECT CASE WHEN closed_run IS NULL THEN 'open' WHEN run < closed_run THEN 'before closure' WHEN run = closed_run THEN 'with closure' ELSE 'after closure' END AS class, count(*) AS n FROM ch LEFT JOIN closed USING (user_id) GROUP BY 1""")
def arrival_class(spark, d):
    """Arrivals before, with or after the first closure of their key."""
    ch = _changes(spark, d)
    closed = ch.where("status = 'purchase'").groupBy("user_id").agg(F.min("run").alias("closed_run"))
    c = F.when(F.col("closed_run").isNull(), "open").when(F.col("run") < F.col("closed_run"), "before closure").when(F.col("run") == F.col("closed_run"), "with closure").otherwise("after closure")
    return ch.join(closed, "user_id", "left").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("J7_feed_interval_match", """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase') SELECT event_id, user_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 DAY)""")
def feed_match(spark, d):
    """Views that a purchase of the same user follows within two days."""
    e = table(spark, d, "events")
    a, b = e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts")
    return history.within_days(a, b, "user_id", "ts", "ts", 2).select("event_id", "user_id")


@query("J8_referential_check", """SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem l ANTI JOIN orders o ON o.o_orderkey = l.l_orderkey) AS n_dangling""")
def referential(spark, d):
    """Rows whose case isn't there: a job refuses its input unless this is 0."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("known"))
    return table(spark, d, "lineitem").select("l_orderkey").join(keys, "l_orderkey", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("known").isNull()).alias("n_dangling"))


@query("J9_tail_arrivals", """WITH closed AS (SELECT user_id, min(ts) AS closed_at FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT e.user_id, count(*) AS n_after, count(DISTINCT event_type) AS kinds FROM events e JOIN closed USING (user_id) WHERE e.ts >= closed_at GROUP BY e.user_id""")
def tails(spark, d):
    """What still arrives at or after a key's closure. The closure is a running minimum: one exchange, no join."""
    e = table(spark, d, "events")
    closed = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))
    return e.withColumn("closed_at", closed).where("ts >= closed_at").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_after"), F.countDistinct("event_type").alias("kinds"))


@query("J10_false_vanish", """WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') SELECT event_id, user_id FROM v WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = v.user_id AND e.event_type = 'signup' AND e.ts > v.ts) OR user_id % 10 = 0""")
def false_vanish(spark, d):
    """Errors that a later signup of the same user, or the user itself, calls in doubt."""
    e = table(spark, d, "events")
    latest = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("latest"))  # some later one exists iff the latest is later
    v = e.where("event_type = 'error'").select("event_id", "user_id", "ts").join(latest, "user_id", "left")
    return v.where((F.col("latest") > F.col("ts")) | (F.col("user_id") % 10 == 0)).select("event_id", "user_id")


@query("J11_transitions", f"""WITH {_CH} SELECT old, status, count(*) AS n, round(avg(date_diff('day', absent_run, run)), 6) AS mean_gap FROM ch WHERE old IS NOT NULL GROUP BY ALL""")
def transitions(spark, d):
    return _changes(spark, d).where("old IS NOT NULL").groupBy("old", "status").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.datediff("run", "absent_run"))).alias("mean_gap"))


@query("J12_vanished", """WITH w AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-14'), s AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15') SELECT user_id FROM w ANTI JOIN s USING (user_id)""")
def vanished(spark, d):
    """Keys of one run that the next, cleanly fetched, run doesn't have."""
    day = lambda x: table(spark, d, "events").where(F.to_date("ts") == F.lit(x).cast("date")).select("user_id").distinct()
    return day("2024-01-14").join(day("2024-01-15"), "user_id", "left_anti")


_L = """l AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_max(round(value), (ts, event_id)) AS v FROM events GROUP BY ALL), a AS (SELECT user_id, event_type, v FROM l WHERE day = DATE '2024-01-14'), b AS (SELECT user_id, event_type, v FROM l WHERE day = DATE '2024-01-15'), known AS (SELECT DISTINCT user_id, event_type FROM l WHERE day < DATE '2024-01-14'),
diff AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN b.user_id IS NULL THEN 'disappeared' WHEN a.user_id IS NULL AND k.user_id IS NOT NULL THEN 'returning' WHEN a.user_id IS NULL THEN 'appeared' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'revised' END AS kind, a.v AS was, b.v AS is_
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type LEFT JOIN known k ON k.user_id = coalesce(a.user_id, b.user_id) AND k.event_type = coalesce(a.event_type, b.event_type))"""


def _diff(spark, d):
    l = table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max_by(F.round("value"), F.struct("ts", "event_id")).alias("v"))  # noqa: E741
    at = lambda op, x: l.where(F.expr(f"day {op} date '{x}'"))
    return history.listing_diff(at("=", "2024-01-14"), at("=", "2024-01-15"), ["user_id", "event_type"], "v", at("<", "2024-01-14"))


@query("J13_listing_diff", f"""WITH {_L} SELECT user_id, event_type, kind FROM diff""")
def listing_diff(spark, d):
    return _diff(spark, d).select("user_id", "event_type", "kind")


@query("J14_suspected_renumbers", f"""WITH {_L}, x AS (SELECT v, count(*) AS n FROM (SELECT was AS v FROM diff WHERE kind = 'disappeared') GROUP BY v), y AS (SELECT v, count(*) AS n FROM (SELECT is_ AS v FROM diff WHERE kind IN ('appeared', 'returning')) GROUP BY v) SELECT CAST(coalesce(sum(least(x.n, y.n)), 0) AS BIGINT) AS suspects FROM x JOIN y USING (v)""")
def renumbers(spark, d):
    """Entries that may only have changed their number: for each value the lesser of gone and new."""
    diff = _diff(spark, d)
    x = diff.where("kind = 'disappeared'").groupBy(F.col("was").alias("v")).agg(F.count(F.lit(1)).alias("x"))
    y = diff.where("kind in ('appeared', 'returning')").groupBy(F.col("is").alias("v")).agg(F.count(F.lit(1)).alias("y"))
    return x.join(y, "v").agg(F.coalesce(F.sum(F.least("x", "y")), F.lit(0)).alias("suspects"))


@query("W5_status_tail", f"""WITH {SNAPS}, g AS (SELECT user_id, run, status, CASE WHEN status <> 'view' AND lag(status) OVER w = 'view' THEN run + 3 END AS start, sum(CASE WHEN status = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY run) AS grp FROM snaps WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT user_id, run, status, CASE WHEN status = 'view' THEN NULL ELSE max(start) OVER (PARTITION BY user_id, grp ORDER BY run) END AS watch_until FROM g""")
def status_tail(spark, d):
    """A tail of 3 days begins when a key leaves 'view' and is cleared when it returns."""
    line = Window.partitionBy("user_id").orderBy("run")
    s = snapshots(spark, d).select("user_id", "run", "status")
    s = s.withColumn("start", F.when((F.col("status") != "view") & (F.lag("status").over(line) == "view"), F.date_add("run", 3)))
    s = s.withColumn("grp", F.sum((F.col("status") == "view").cast("int")).over(line))
    return s.select("user_id", "run", "status", F.when(F.col("status") != "view", F.max("start").over(Window.partitionBy("user_id", "grp").orderBy("run"))).alias("watch_until"))


@query("W6_vanish_marks", f"""WITH {SNAPS}, n AS (SELECT user_id, run, lead(run) OVER (PARTITION BY user_id ORDER BY run) AS next_run FROM snaps) SELECT user_id, run AS last_seen, next_run AS back_at FROM n WHERE date_diff('day', run, next_run) > 1""")
def vanish_marks(spark, d):
    """Gaps in which a key wasn't returned: one mark a gap, however many runs it lasts."""
    n = snapshots(spark, d).select("user_id", "run", F.lead("run").over(Window.partitionBy("user_id").orderBy("run")).alias("next_run"))
    return n.where(F.datediff("next_run", "run") > 1).select("user_id", F.col("run").alias("last_seen"), F.col("next_run").alias("back_at"))


@query("W7_step_gains", """SELECT event_id, user_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value), 6) AS gain FROM events""")
def step_gains(spark, d):
    """Each step's value less the one before; the first gains 0."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", "user_id", rounded(F.col("value") - F.coalesce(before, "value")).alias("gain"))


@query("W8_last_step", """SELECT conv_id, arg_max(role, (turn, length(text))) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id""")
def last_step(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", F.struct("turn", F.length("text"))).alias("role"), F.max("turn").alias("turn"))


@query("W9_cumulative_cost", """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM events""")
def cumulative_cost(spark, d):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.sum("value").over(line), 4).alias("so_far"))


_ISL = """e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'view') AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reset FROM e), s AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, reset ORDER BY ts, event_id) AS streak FROM g)"""


def _streaks(spark, d):
    return history.islands(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "view"))


@query("W10_circuit_breaker", f"""WITH {_ISL} SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, min(ts) FILTER (streak >= 5) AS tripped_at FROM s GROUP BY user_id""")
def circuit_breaker(spark, d):
    """When five failures in a row were first reached."""
    return _streaks(spark, d).groupBy("user_id").agg(F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= 5, F.col("ts"))).alias("tripped_at"))


@query("W11_empty_month_stop", f"""WITH {SNAPS}, days AS (SELECT u.user_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d)), m AS (SELECT days.user_id, day, snaps.run IS NULL AS empty FROM days LEFT JOIN snaps ON snaps.user_id = days.user_id AND snaps.run = days.day),
g AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day DESC) AS reset FROM m), s AS (SELECT *, sum(CASE WHEN empty THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, reset ORDER BY day DESC) AS streak FROM g) SELECT user_id, max(day) FILTER (streak >= 2) AS stopped_at FROM s GROUP BY user_id""")
def empty_stop(spark, d):
    """Going back in time, where two empty days in a row end the walk."""
    users = table(spark, d, "events").select("user_id").distinct()
    days = users.withColumn("day", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))))
    seen = snapshots(spark, d).select("user_id", F.col("run").alias("day"), F.lit(True).alias("seen"))
    m = days.join(seen, ["user_id", "day"], "left").withColumn("back", -F.unix_date("day"))
    s = history.islands(m, ["user_id"], ["back"], F.col("seen").isNull())
    return s.groupBy("user_id").agg(F.max(F.when(F.col("streak") >= 2, F.col("day"))).alias("stopped_at"))


@query("W12_last_clean_fetch", f"""WITH {SNAPS} SELECT user_id, run, max(CASE WHEN status <> 'error' THEN run END) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_clean FROM snaps""")
def last_clean(spark, d):
    line = Window.partitionBy("user_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return snapshots(spark, d).select("user_id", "run", F.max(F.when(F.col("status") != "error", F.col("run"))).over(line).alias("last_clean"))


@query("W13_greedy_admission", """WITH t AS (SELECT source, doc_id, n_chars // 4 AS tokens, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY n_chars // 4, doc_id) AS total FROM documents) SELECT source, doc_id, CAST(tokens AS BIGINT) AS tokens, NOT bool_or(total > 8000) OVER (PARTITION BY source ORDER BY tokens, doc_id) AS admitted FROM t""")
def admission(spark, d):
    """Smallest documents first until one breaks the cap; the rest stays out."""
    t = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return history.admit(t, ["source"], ["tokens", "doc_id"], "tokens", 8000).select("source", "doc_id", "tokens", "admitted")


@query("W14_failure_counters", f"""WITH {SNAPS}, o AS (SELECT run FROM snaps GROUP BY run HAVING count(*) FILTER (status <> 'error') > 0), f AS (SELECT s.* FROM snaps s JOIN o USING (run)), g AS (SELECT *, sum(CASE WHEN status = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY run) AS reset FROM f), c AS (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, reset ORDER BY run) AS failures FROM g)
SELECT user_id, run, CAST(failures AS BIGINT) AS failures, CASE WHEN failures >= 7 THEN 'final' WHEN failures >= 3 THEN 'alert' ELSE 'fine' END AS state FROM c""")
def failure_counters(spark, d):
    """Nightly failures in a row; a night on which everything failed doesn't count."""
    s = snapshots(spark, d).select("user_id", "run", "status")
    working = s.groupBy("run").agg(F.count_if(F.col("status") != "error").alias("ok")).where("ok > 0").select("run")
    c = history.islands(s.join(working, "run"), ["user_id"], ["run"], F.col("status") == "error", "failures")
    return c.select("user_id", "run", "failures", F.when(F.col("failures") >= 7, "final").when(F.col("failures") >= 3, "alert").otherwise("fine").alias("state"))


@query("W16_ledger_latest", """SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def ledger_latest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("A35_closure_runs", f"""WITH {_CH} SELECT user_id, min(run) AS closed_run, arg_min_null(old, run) AS was FROM ch WHERE status = 'purchase' AND old IS DISTINCT FROM 'signup' GROUP BY user_id""")
def closure_runs(spark, d):
    """The earliest transition that closes a key; a relabel between closures is none."""
    return _changes(spark, d).where((F.col("status") == "purchase") & ~F.col("old").eqNullSafe("signup")).groupBy("user_id").agg(F.min("run").alias("closed_run"), F.min_by("old", "run").alias("was"))


@query("A37_run_summaries", f"""WITH {SNAPS} SELECT run, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_events, CAST(coalesce(sum(CASE WHEN status = 'error' THEN n END), 0) AS BIGINT) AS n_error_events FROM snaps WHERE run < DATE '2024-01-30' GROUP BY run""")
def run_summaries(spark, d):
    """Summaries of the finished runs."""
    return snapshots(spark, d).where("run < date '2024-01-30'").groupBy("run").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_events"), F.coalesce(F.sum(F.when(F.col("status") == "error", F.col("n"))), F.lit(0)).alias("n_error_events"))


@query("A38_arrival_populations", f"""WITH {SNAPS}, f AS (SELECT user_id, min(run) FILTER (status = 'purchase') AS first_read, min(run) AS first_run FROM snaps GROUP BY user_id), a AS (SELECT s.user_id, max(s.run) AS last_absent FROM snaps s JOIN f USING (user_id) WHERE s.run < f.first_read GROUP BY s.user_id)
SELECT CASE WHEN first_read IS NULL THEN 'never' WHEN first_read = first_run THEN 'at first sight' WHEN date_diff('day', last_absent, first_read) = 1 THEN 'overnight' ELSE 'after a gap' END AS population, count(*) AS n, round(avg(date_diff('day', last_absent, first_read)), 6) AS mean_width FROM f LEFT JOIN a USING (user_id) GROUP BY 1""")
def arrival_populations(spark, d):
    """When a key was first read, by what is known about the run before."""
    s = snapshots(spark, d).select("user_id", "run", "status")
    first = F.min(F.when(F.col("status") == "purchase", F.col("run"))).over(Window.partitionBy("user_id"))
    g = s.withColumn("first_read", first).groupBy("user_id").agg(F.first("first_read").alias("first_read"), F.min("run").alias("first_run"), F.max(F.when(F.col("run") < F.col("first_read"), F.col("run"))).alias("last_absent"))
    width = F.datediff("first_read", "last_absent")
    p = F.when(F.col("first_read").isNull(), "never").when(F.col("first_read") == F.col("first_run"), "at first sight").when(width == 1, "overnight").otherwise("after a gap")
    return g.groupBy(p.alias("population")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(width)).alias("mean_width"))
