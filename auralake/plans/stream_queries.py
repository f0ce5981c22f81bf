"""State machines in batch and stream, windows over streams, replayable items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.plans.base import Tables, query
from auralake.plans.ordered_queries import HOPS, hops
from auralake.plans.stats_queries import H, U, r9
from auralake.streaming import hops as stream
from auralake.streaming import machines as M
from auralake.streaming import stateful

W = "WITH RECURSIVE " + HOPS


HYSTERESIS = W + """, b AS (SELECT user_id, idx, value < 30 AS bad FROM hops),
r(user_id, idx, valid, run) AS (SELECT user_id, -1::BIGINT, true, 0 FROM b WHERE idx = 0 UNION ALL
 SELECT b.user_id, b.idx, CASE WHEN b.bad = r.valid AND r.run + 1 >= CASE WHEN r.valid THEN 2 ELSE 3 END THEN NOT r.valid ELSE r.valid END,
  CASE WHEN b.bad = r.valid AND r.run + 1 < CASE WHEN r.valid THEN 2 ELSE 3 END THEN r.run + 1 ELSE 0 END FROM r JOIN b ON b.user_id = r.user_id AND b.idx = r.idx + 1)
SELECT user_id, idx, valid FROM r WHERE idx >= 0"""


@query(HYSTERESIS)
def channel_monitor(t: Tables) -> DataFrame:
    """Availability with hysteresis, over a batch."""
    return M.over_batch(hops(t).withColumn("bad", F.col("value") < 30), M.Hysteresis(2, 3), ["user_id"], "idx")


@query("""WITH RECURSIVE b AS (SELECT user_id, event_id, value < 30 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events),
""" + HYSTERESIS[HYSTERESIS.index("r(user_id"):HYSTERESIS.index("SELECT user_id, idx, valid FROM r")] + "SELECT r.user_id, b.event_id, r.valid FROM r JOIN b ON b.user_id = r.user_id AND b.idx = r.idx")
def stream_channel_monitor(t: Tables) -> DataFrame:
    """The same machine over a stream, its versioned state in the query's checkpoint."""
    rows = stream.events_stream(t.spark, t.sf_dir).withColumn("bad", F.col("value") < 30)
    return stream.drained(stateful.over_stream(rows, M.Hysteresis(2, 3), ["user_id"], "event_id"))


#: How late events arrive, in how many steps, and the delay of the watermark: a step and the lateness.
LATE, STEPS, DELAY = "1 day", 4, "9 days"
#: What the watermark has passed when all events have arrived.
PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 9 DAY FROM events)"


def late_events(t: Tables) -> DataFrame:
    """The events as a stream in which each arrives up to a day after its time."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.arriving(rows, "ts", "event_id", LATE, STEPS)


@query("WITH " + HOPS + f""", k AS (SELECT h.*, e.ts FROM hops h JOIN events e USING (event_id)),
v AS (SELECT user_id, idx, ts, min((value > 5)::INT) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS valid FROM k)
SELECT user_id, (idx + 1) // 3 - 1 AS frame, valid FROM v WHERE (idx + 1) % 3 = 0 AND ts <= {PASSED}""")
def stream_late_frames(t: Tables) -> DataFrame:
    """Frame validity over events that arrive out of order: the batch query's rows, up to the watermark."""
    rows = late_events(t).withColumn("available", F.col("value") > 5)
    out = stateful.over_late_stream(rows, M.FrameValidity(6, 3), ["user_id"], "ts", "event_id", DELAY)
    return stream.drained(out).filter("frame is not null").select("user_id", "frame", "valid")


@query("WITH " + HOPS + f""", a AS (SELECT h.*, e.ts, h.event_type <> 'error' AS avail FROM hops h JOIN events e USING (event_id)),
b AS (SELECT *, avail AND NOT coalesce(lag(avail) OVER (PARTITION BY user_id ORDER BY idx), true) AS back FROM a),
c AS (SELECT *, idx - max(CASE WHEN back THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS since FROM b)
SELECT user_id, event_id, since, round(CASE WHEN NOT avail THEN 0 ELSE least(1.0::DOUBLE, (coalesce(since, 5) + 1) / 5.0::DOUBLE) END, 6) AS gain FROM c WHERE ts <= {PASSED}""")
def stream_late_ramp(t: Tables) -> DataFrame:
    """The gain after each reconnect over events that arrive out of order, up to the watermark."""
    rows = late_events(t).withColumn("available", F.col("event_type") != "error")
    out = stateful.over_late_stream(rows, M.ReconnectRamp(5), ["user_id"], "ts", "event_id", DELAY)
    return stream.drained(out).select("user_id", "event_id", "since", r9(F.col("gain")).alias("gain"))


@query(W.replace("RECURSIVE ", "") + """ SELECT user_id, idx // 8 AS hop, round(sqrt(sum(value * value) / 8), 6) AS rms FROM hops GROUP BY ALL""")
def stream_hops(t: Tables) -> DataFrame:
    """Hops of eight samples from a stream of chunks of one to seven days; the last is padded with zeros."""
    chunks = hops(t).groupBy("user_id", F.floor(F.sqrt(F.col("idx") * 3.0)).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("samples"))
    ends = Window.partitionBy("user_id").orderBy(F.desc("chunk"))
    chunks = chunks.withColumn("last", F.row_number().over(ends) == 1)
    framed = stateful.frames(stream.written(chunks), ["user_id"], "chunk", "samples", 8, "last")
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x) / 8)
    return stream.drained(framed).select("user_id", "hop", r9(rms).alias("rms"))


@query(W + """, b AS (SELECT user_id, idx, value AS level FROM hops),
r(user_id, idx, speech, floor, hang) AS (SELECT user_id, idx, level > -90 AND level > level + 6 , level, 0 FROM b WHERE idx = 0 UNION ALL
 SELECT b.user_id, b.idx, b.level > CASE WHEN b.level < r.floor THEN b.level ELSE r.floor + 0.5::DOUBLE END + 6 OR r.hang > 0, CASE WHEN b.level < r.floor THEN b.level ELSE r.floor + 0.5::DOUBLE END,
  CASE WHEN b.level > CASE WHEN b.level < r.floor THEN b.level ELSE r.floor + 0.5::DOUBLE END + 6 THEN 2 ELSE greatest(r.hang - 1, 0) END FROM r JOIN b ON b.user_id = r.user_id AND b.idx = r.idx + 1)
SELECT user_id, idx, speech, round(floor, 6) AS floor FROM r""")
def speech_detector(t: Tables) -> DataFrame:
    """Speech by energy over a tracked floor."""
    out = M.over_batch(hops(t).withColumn("level", F.col("value")), M.SpeechDetector(6.0, 0.5, 2), ["user_id"], "idx")
    return out.withColumn("floor", r9(F.col("floor")))


FLOOR = "CASE WHEN b.level < r.floor THEN b.level ELSE r.floor + 0.5::DOUBLE END"
LOUD = f"b.level > {FLOOR} + 6"


@query(W + f""", b AS (SELECT user_id, idx, value AS level, value - CASE WHEN idx % 9 < 5 THEN 40 ELSE 5 END AS low FROM hops),
r(user_id, idx, floor, hang, active, run, gone, fallback, speech) AS (SELECT user_id, idx, level, 0, false, 0, 0, false, false FROM b WHERE idx = 0 UNION ALL
 SELECT b.user_id, b.idx, {FLOOR}, CASE WHEN {LOUD} THEN 2 ELSE greatest(r.hang - 1, 0) END,
  CASE WHEN r.active THEN r.gone > 1 ELSE ({LOUD} OR r.hang > 0) AND b.low < b.level - 25 AND r.run + 1 > 3 END,
  CASE WHEN r.active THEN CASE WHEN r.gone > 1 THEN r.run ELSE 0 END WHEN {LOUD} OR r.hang > 0 THEN CASE WHEN b.low < b.level - 25 AND r.run + 1 <= 3 THEN r.run + 1 ELSE 0 END ELSE r.run END,
  CASE WHEN r.active THEN r.gone - 1 WHEN ({LOUD} OR r.hang > 0) AND b.low < b.level - 25 AND r.run + 1 > 3 THEN 6 ELSE r.gone END,
  CASE WHEN r.active THEN r.gone > 1 ELSE ({LOUD} OR r.hang > 0) AND b.low < b.level - 25 AND r.run + 1 > 3 END, {LOUD} OR r.hang > 0
 FROM r JOIN b ON b.user_id = r.user_id AND b.idx = r.idx + 1)
SELECT user_id, idx, fallback, speech FROM r""")
def never_vanish(t: Tables) -> DataFrame:
    """Fallbacks where the output stays far below the input through speech."""
    rows = hops(t).select("user_id", "idx", F.col("value").alias("level"), (F.col("value") - F.when(F.col("idx") % 9 < 5, 40).otherwise(5)).alias("out_level"))
    return M.over_batch(rows, M.NeverVanish(25.0, 3, 6, M.SpeechDetector(6.0, 0.5, 2)), ["user_id"], "idx")


#: Whether a row speaks against the state it meets.
AGAINST = "CASE WHEN r.ok THEN b.corr > 0.97 AND b.ild < 1.0 ELSE b.corr < 0.9 OR b.ild > 2.0 END"


@query(W + f""", b AS (SELECT user_id, idx, CASE WHEN idx % 10 < 6 THEN 0.99 ELSE 0.5 END AS corr, abs(value / 50) AS ild, value < 5 AS silent FROM hops),
r(user_id, idx, ok, run) AS (SELECT user_id, -1::BIGINT, true, 0 FROM b WHERE idx = 0 UNION ALL
 SELECT b.user_id, b.idx, CASE WHEN NOT b.silent AND {AGAINST} AND r.run + 1 >= 2 THEN NOT r.ok ELSE r.ok END,
  CASE WHEN b.silent THEN r.run WHEN {AGAINST} AND r.run + 1 < 2 THEN r.run + 1 ELSE 0 END FROM r JOIN b ON b.user_id = r.user_id AND b.idx = r.idx + 1)
SELECT user_id, idx, ok AS informative FROM r WHERE idx >= 0""")
def informative_reference(t: Tables) -> DataFrame:
    """Whether a reference is more than a copy, with hysteresis and held through silence."""
    rows = hops(t).select("user_id", "idx", F.when(F.col("idx") % 10 < 6, 0.99).otherwise(0.5).alias("corr"), (F.col("value") / 50).alias("ild"), (F.col("value") < 5).alias("silent"))
    return M.over_batch(rows, M.Informative(hold_hops=2, back_hops=2), ["user_id"], "idx")


@query(W + """, b AS (SELECT user_id, idx, value > 80 AND event_type <> 'view' AS hit, event_type = 'error' AS blocked FROM hops),
h AS (SELECT *, max(hit::INT) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS burst FROM b),
s AS (SELECT *, idx - max(CASE WHEN burst OR blocked THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS open FROM h) SELECT user_id, idx, round(least(coalesce(open, 5), 5) / 5.0::DOUBLE, 6) AS gate, burst FROM s""")
def burst_gate(t: Tables) -> DataFrame:
    """A gate that bursts hold shut and that ramps open."""
    rows = hops(t).select("user_id", "idx", F.when(F.col("value") > 80, 20.0).otherwise(0.0).alias("jump"), (F.col("event_type") != "view").alias("far"), (F.col("event_type") == "error").alias("blocked"))
    return M.over_batch(rows, M.BurstGate(12.0, 3, 5), ["user_id"], "idx").withColumn("gate", r9(F.col("gate")))


@query(W + """, b AS (SELECT user_id, idx, value > 95 AS missed FROM hops), m AS (SELECT *, max(CASE WHEN missed THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS last FROM b)
SELECT user_id, idx, CASE WHEN idx - last < 2 THEN 'raw' WHEN idx - last = 2 THEN 'fade' ELSE 'processed' END AS mode, CASE WHEN idx - last < 2 THEN 0.0::DOUBLE WHEN idx - last = 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM m""")
def deadline_bypass(t: Tables) -> DataFrame:
    """Raw hops after a missed deadline, then a fade."""
    return M.over_batch(hops(t).withColumn("missed", F.col("value") > 95), M.Bypass(2), ["user_id"], "idx")


@query("SELECT event_type, date_trunc('day', ts)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, date_trunc('day', ts)")
def stream_windows(t: Tables) -> DataFrame:
    """Tumbling windows over a stream, complete each time."""
    grouped, start = stream.windowed(stream.events_stream(t.spark, t.sf_dir), ["event_type"], "ts", "1 day")
    rows = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", start.alias("start"), "n", "total")
    return stream.drained(rows, "complete").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT (date_trunc('day', ts) - k * INTERVAL 1 DAY)::VARCHAR AS day, count(*) AS n FROM events, range(2) r(k) GROUP BY 1")
def stream_sliding(t: Tables) -> DataFrame:
    """Windows of two days, one beginning each day."""
    grouped, start = stream.windowed(stream.events_stream(t.spark, t.sf_dir), [], "ts", "2 days", "1 day")
    rows = grouped.agg(F.count(F.lit(1)).alias("n")).select(start.alias("start"), "n")
    return stream.drained(rows, "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(t: Tables) -> DataFrame:
    """A stream read twice: each event once, within the watermark."""
    rows = stream.events_stream(t.spark, t.sf_dir)
    twice = rows.union(rows).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    return stream.drained(twice.select("event_id", "user_id", "event_type"))


@query(f"""WITH s AS (SELECT seq, seq // 500 AS epoch, seq % 500 AS i FROM range(1500) r(seq)) SELECT seq, epoch, i, {H.format("'9|pool|' || epoch || '|' || i")} % 7 AS pool, round(-5 + 20 * {U.format("'9|snr|' || epoch || '|' || i")}, 6) AS snr, {U.format("'9|fault|' || epoch || '|' || i")} < 0.1 AS fault FROM s""")
def replayable_items(t: Tables) -> DataFrame:
    """Items of a training stream: functions of seed, epoch and place."""
    return stream.items(t.spark, 9, 3, 500, 7).withColumn("snr", r9(F.col("snr")))


@query("SELECT date_trunc('day', ts)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_closed_windows(t: Tables) -> DataFrame:
    """Windows that the watermark has closed: appended once, the open one held back."""
    grouped, start = stream.windowed(stream.events_stream(t.spark, t.sf_dir), [], "ts", "1 day", delay="1 hour")
    rows = grouped.agg(F.count(F.lit(1)).alias("n")).select(start.alias("start"), "n")
    return stream.drained(rows).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")
