"""Order-dependent analytics over the event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.operators import ordered as O
from auralake.plans.base import Tables, query
from auralake.plans.stats_queries import r9

#: Each user's events in order: the place stands for the sample index.
HOPS = "hops AS (SELECT user_id, event_id, event_type, value, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
W = "WITH " + HOPS


def hops(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.select("user_id", "event_id", "event_type", "value", s.alias("s"), (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query(W + """, f AS (SELECT *, value > 40 AS f FROM hops), g AS (SELECT user_id, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS run FROM f WHERE f)
SELECT u.user_id, coalesce(max(n), 0)::BIGINT AS longest FROM (SELECT DISTINCT user_id FROM hops) u LEFT JOIN (SELECT user_id, run, count(*) AS n FROM g GROUP BY ALL) r USING (user_id) GROUP BY u.user_id""")
def longest_run(t: Tables) -> DataFrame:
    return O.longest_run(hops(t), ["user_id"], ["idx"], F.col("value") > 40)


@query(W + """, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS floor, lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS prev FROM hops)
SELECT user_id, idx, round(floor, 6) AS floor FROM m WHERE value - floor >= 25 AND coalesce(prev, floor) - floor < 25""")
def onset_candidates(t: Tables) -> DataFrame:
    """Rows that cross the median of those before them."""
    return O.rises(hops(t), ["user_id"], ["idx"], "value", 8, 25.0).select("user_id", "idx", r9(F.col("floor")).alias("floor"))


@query(W + """, c AS (SELECT user_id, s FROM hops WHERE event_type = 'click'),
r AS (WITH RECURSIVE k(user_id, s) AS (SELECT user_id, min(s) FROM c GROUP BY 1 UNION ALL SELECT k.user_id, (SELECT min(c.s) FROM c WHERE c.user_id = k.user_id AND c.s >= k.s + 86400) FROM k WHERE k.s IS NOT NULL) SELECT * FROM k WHERE s IS NOT NULL)
SELECT user_id, count(*) AS accepted, round(sum(s), 3) AS times FROM r GROUP BY user_id""")
def onsets(t: Tables) -> DataFrame:
    """Onsets with a refractory gap after each accepted one."""
    kept = O.refractory(hops(t).filter("event_type = 'click'"), ["user_id"], "s", 86400.0)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("accepted"), F.round(F.sum("s"), 3).alias("times"))


@query(W + """, a AS (SELECT *, event_type <> 'error' AND idx % 7 > 0 AS avail FROM hops), b AS (SELECT *, avail AND NOT coalesce(lag(avail) OVER (PARTITION BY user_id ORDER BY idx), true) AS back FROM a),
c AS (SELECT *, idx - max(CASE WHEN back THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS since FROM b) SELECT user_id, idx, since, round(CASE WHEN NOT avail THEN 0 ELSE least(1.0::DOUBLE, (coalesce(since, 5) + 1) / 5.0::DOUBLE) END, 6) AS gain FROM c""")
def reconnect_ramp(t: Tables) -> DataFrame:
    """The gain after each reconnect."""
    rows = hops(t).withColumn("avail", (F.col("event_type") != "error") & (F.col("idx") % 7 > 0))
    return O.since_reconnect(rows, ["user_id"], "idx", "avail", 5).select("user_id", "idx", "since", r9(F.col("gain")).alias("gain"))


@query(W + """, v AS (SELECT user_id, idx, min((idx % 11 > 0)::INT) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS valid FROM hops) SELECT user_id, (idx + 1) // 3 - 1 AS frame, valid FROM v WHERE (idx + 1) % 3 = 0""")
def frame_validity(t: Tables) -> DataFrame:
    """A frame is valid when its whole window is available."""
    return O.frame_validity(hops(t).withColumn("avail", F.col("idx") % 11 > 0), ["user_id"], "idx", "avail", 6, 3)


@query(W + " SELECT user_id, idx, min(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS floor, value - lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS step FROM hops")
def rolling_min(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("idx")
    return hops(t).select("user_id", "idx", F.min("value").over(w.rowsBetween(-15, 0)).alias("floor"), (F.col("value") - F.lag("value").over(w)).alias("step"))


@query(W + """, r AS (WITH RECURSIVE e(user_id, idx, y) AS (SELECT user_id, idx, value FROM hops WHERE idx = 0 UNION ALL SELECT h.user_id, h.idx, CASE WHEN h.value > e.y THEN 0.6::DOUBLE * e.y + (1 - 0.6::DOUBLE) * h.value ELSE 0.9::DOUBLE * e.y + (1 - 0.9::DOUBLE) * h.value END FROM e JOIN hops h ON h.user_id = e.user_id AND h.idx = e.idx + 1) SELECT * FROM e)
SELECT user_id, idx, round(y, 6) AS smooth FROM r""")
def ema_fold(t: Tables) -> DataFrame:
    """A smoother with an attack and a release."""
    return O.smoothed(hops(t), ["user_id"], "idx", "value", 0.6, 0.9).select("user_id", "idx", r9(F.col("smooth")).alias("smooth"))


@query(W + " SELECT user_id, idx, round(sum(value * value) OVER (PARTITION BY user_id ORDER BY idx DESC), 4) AS energy FROM hops")
def decay_curve(t: Tables) -> DataFrame:
    """Energy from each row to the end."""
    w = Window.partitionBy("user_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    return hops(t).select("user_id", "idx", F.round(F.sum(F.col("value") * F.col("value")).over(w), 4).alias("energy"))


@query(W + """, b AS (SELECT *, s - min(s) OVER (PARTITION BY user_id) AS a FROM hops), p AS (SELECT *, coalesce(sum(value * 600) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT user_id, idx, round(max(a - before) OVER (PARTITION BY user_id ORDER BY idx) + before + value * 600, 3) AS finish FROM p""")
def release_schedule(t: Tables) -> DataFrame:
    """When each item of a stream is done, served one at a time."""
    first = F.min("s").over(Window.partitionBy("user_id"))
    rows = hops(t).withColumn("a", F.col("s") - first).withColumn("work", F.col("value") * 600)
    return O.finish_times(rows, ["user_id"], ["idx"], "a", "work").select("user_id", "idx", F.round("finish", 3).alias("finish"))


@query(W + """, b AS (SELECT *, s - min(s) OVER (PARTITION BY user_id) AS a FROM hops), p AS (SELECT *, coalesce(sum(value * 600) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
f AS (SELECT user_id, idx, a, max(a - before) OVER (PARTITION BY user_id ORDER BY idx) + before + value * 600 AS finish FROM p), d AS (SELECT x.user_id, x.idx, count(*) AS depth FROM f x JOIN f y ON y.user_id = x.user_id AND y.idx <= x.idx AND y.finish > x.a GROUP BY ALL)
SELECT user_id, max(depth) AS deepest, count(CASE WHEN depth > 3 THEN 1 END) AS over FROM d GROUP BY user_id""")
def bounded_queue(t: Tables) -> DataFrame:
    """How deep each stream's queue gets, and how many items a bound of three would drop or bypass."""
    first = F.min("s").over(Window.partitionBy("user_id"))
    rows = hops(t).withColumn("a", F.col("s") - first).withColumn("work", F.col("value") * 600)
    done = O.finish_times(rows, ["user_id"], ["idx"], "a", "work").select("user_id", "idx", "a", "finish")
    deep = O.backlog(done, ["user_id"], ["idx"], "a", "finish")
    return deep.groupBy("user_id").agg(F.max("depth").alias("deepest"), F.count(F.when(F.col("depth") > 3, 1)).alias("over"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS missing FROM events QUALIFY missing > 0")
def gap_accounting(t: Tables) -> DataFrame:
    """Where indices are missing and how many."""
    return O.gaps(t.events, ["user_id"], "event_id", 1).select("user_id", "event_id", "missing")


@query(W + """, n AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY s), 1e18) > 21600 AS new FROM hops), k AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY s, idx) AS session FROM n)
SELECT user_id, session::BIGINT AS session, round(min(s), 3) AS start, round(max(s), 3) AS "end", count(*) AS n FROM k GROUP BY user_id, session""")
def session_merge(t: Tables) -> DataFrame:
    """Events no further apart than six hours are one session."""
    found = O.sessions(hops(t), ["user_id"], "s", 21600.0)
    return found.select("user_id", "session", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query(W + """, k AS (SELECT user_id, arg_max(idx, value * 1e9 - idx) AS at FROM hops GROUP BY 1) SELECT h.user_id, k.at::BIGINT AS at, count(*) AS n, round(avg(h.value), 6) AS mean FROM hops h JOIN k ON k.user_id = h.user_id AND h.idx BETWEEN k.at - 4 AND k.at + 4 GROUP BY ALL""")
def peak_window(t: Tables) -> DataFrame:
    """The rows around each stream's largest value."""
    h = hops(t)
    at = h.groupBy("user_id").agg(F.max_by("idx", F.struct("value", -F.col("idx"))).alias("at"))
    return h.join(at, "user_id").filter(F.col("idx").between(F.col("at") - 4, F.col("at") + 4)).groupBy("user_id", "at").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("value")).alias("mean"))


@query(W + """ SELECT user_id, idx // 8 AS hop, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, count(*) = 8 AS whole FROM hops GROUP BY ALL""")
def hop_frames(t: Tables) -> DataFrame:
    """Hops of eight samples, whatever chunks they came in; the last may be short."""
    return hops(t).groupBy("user_id", F.floor(F.col("idx") / 8).alias("hop")).agg(F.count(F.lit(1)).alias("n"), r9(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"), (F.count(F.lit(1)) == 8).alias("whole"))


@query(W + """ SELECT user_id, k AS frame, count(*) AS n, round(avg(value), 6) AS mean FROM hops, range(0, (SELECT max(idx) // 4 + 1 FROM hops)) r(k) WHERE idx >= k * 4 AND idx < k * 4 + 12 GROUP BY ALL""")
def sliding_frames(t: Tables) -> DataFrame:
    """Windows of twelve samples every four: each sample goes to the frames that hold it."""
    first, last = F.greatest(F.lit(0), F.ceil((F.col("idx") - 11) / 4)), F.floor(F.col("idx") / 4)
    rows = hops(t).select("user_id", "value", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("frame"))
    return rows.groupBy("user_id", "frame").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("value")).alias("mean"))


@query("""WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 6) AS total, bit_or(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END)::BIGINT AS flags FROM events GROUP BY ALL)
SELECT user_id, day::VARCHAR AS day, n, total, flags FROM b""")
def day_windows(t: Tables) -> DataFrame:
    """Tumbling windows with their flags."""
    kind = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0).cast("long")
    rows = t.events.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), r9(F.sum("value")).alias("total"), F.bit_or(kind).alias("flags")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", "total", "flags")


@query("""WITH span AS (SELECT min(date_diff('day', TIMESTAMP '2024-01-01', ts)) AS low, max(date_diff('day', TIMESTAMP '2024-01-01', ts)) AS high FROM events),
g AS (SELECT user_id, k FROM (SELECT DISTINCT user_id FROM events), span, range((SELECT low FROM span), (SELECT high + 1 FROM span)) r(k)), a AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS k, min(epoch(ts)) AS s FROM events GROUP BY ALL)
SELECT g.user_id, g.k, CASE WHEN a.s IS NULL THEN 'lost' WHEN a.s - epoch(TIMESTAMP '2024-01-01') - g.k * 86400 <= 43200 THEN 'on time' ELSE 'late' END AS route FROM g LEFT JOIN a USING (user_id, k)""")
def period_routing(t: Tables) -> DataFrame:
    """Every period of every stream, from the first to the last that any has: played on time, late or lost."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lit(1704067200.0)
    arrived = t.events.groupBy("user_id", F.floor(s / 86400).alias("k")).agg(F.min(s).alias("s"))
    span = arrived.agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first is not null")
    grid = t.events.select("user_id").distinct().crossJoin(F.broadcast(span)).select("user_id", F.explode(F.sequence("first", "last")).alias("k"))
    late = F.col("s") - F.col("k") * 86400
    return grid.join(arrived, ["user_id", "k"], "left").select("user_id", "k", F.when(F.col("s").isNull(), "lost").when(late <= 43200, "on time").otherwise("late").alias("route"))
