"""Signals, texts and closed-form functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import arrays as A
from auralake.plans.base import Tables, query
from auralake.plans.stats_queries import r9


def pairs(t: Tables) -> DataFrame:
    """Each vector as a clean signal with the next of its label as the estimate; one without an id comes last, as in the SQL."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.asc_nulls_last("vec_id"))
    x = A.doubles("embedding")
    return t.embeddings.select("vec_id", "label", x.alias("x"), F.lead(x).over(w).alias("y")).filter("y is not null")


PAIRS = "WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings QUALIFY y IS NOT NULL)"
E2 = "list_sum(list_transform({0}, lambda a: a * a))"


@query(PAIRS + f" SELECT vec_id, round(10 * log10(({E2.format('x')} + 1e-10) / (list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + 1e-10)), 6) AS snr FROM p")
def snr_db_array(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", r9(A.snr_db(F.col("x"), F.col("y"))).alias("snr"))


@query(PAIRS + f""", s AS (SELECT vec_id, list_dot_product(x, y) AS xy, {E2.format('x')} AS xx, {E2.format('y')} AS yy FROM p), c AS (SELECT *, xy / (xx + 1e-10) AS a FROM s)
SELECT vec_id, round(10 * log10((a * a * xx + 1e-10) / (greatest(yy - 2 * a * xy + a * a * xx, 0) + 1e-10)), 6) AS si_sdr FROM c""")
def si_sdr_array(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", r9(A.si_sdr_db(F.col("x"), F.col("y"))).alias("si_sdr"))


@query("WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, k AS frame, round(10 * log10(" + E2.format("x[k * 8 + 1:k * 8 + 8]") + " / 8 + 1e-10), 6) AS level FROM p, range(8) r(k)")
def envelope_frames(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode(A.envelope_db(A.doubles("embedding"), 8)).alias("frame", "level"))
    return rows.select("vec_id", F.col("frame").cast("long").alias("frame"), r9(F.col("level")).alias("level"))


@query("WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(20 * log10((list_max(list_transform(x, lambda a: abs(a))) + 1e-12) / (sqrt(" + E2.format("x") + " / len(x)) + 1e-12)), 6) AS crest FROM p")
def crest_factor(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r9(A.crest_db(A.doubles("embedding"))).alias("crest"))


@query("WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT vec_id, list_sort(list_transform(range(16), lambda k: " + E2.format("x[k * 4 + 1:k * 4 + 4]") + " / 4 + 1e-10)) AS l FROM p) SELECT vec_id, round(10 * log10(list_avg(l[13:16]) / l[1]), 6) AS snr FROM f")
def energy_snr(t: Tables) -> DataFrame:
    """The SNR that a signal's own frames suggest."""
    return t.embeddings.select("vec_id", r9(A.energy_snr_db(A.doubles("embedding"), 4)).alias("snr"))


@query("WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT vec_id, list_transform(range(8), lambda k: " + E2.format("x[k * 8 + 1:k * 8 + 8]") + " / 8) AS l FROM p) SELECT vec_id, round(list_avg(list_filter(l, lambda v: v >= list_max(l) * pow(10, -0.3))), 9) AS power FROM f")
def speech_power(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(A.speech_active_power(A.doubles("embedding"), 8, -3.0), 9).alias("power"))


@query(PAIRS + f""", g AS (SELECT vec_id, x, list_transform(y, lambda b: b * sqrt({E2.format('x')} / ({E2.format('y')} + 1e-12)) * pow(10, -0.25)) AS z FROM p), m AS (SELECT vec_id, list_transform(list_zip(x, z), lambda q: q[1] + q[2]) AS m FROM g)
SELECT vec_id, round(list_sum(m), 6) AS total, round({E2.format('m')}, 6) AS energy FROM m""")
def mix_at_snr(t: Tables) -> DataFrame:
    m = pairs(t).select("vec_id", A.mixed(F.col("x"), F.col("y"), 5.0).alias("m"))
    return m.select("vec_id", r9(A.total(F.col("m"))).alias("total"), r9(A.energy(F.col("m"))).alias("energy"))


@query("WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, list_max(list_transform(x, lambda a: abs(a))) > 0.2 AS knee, list_max(list_transform(x, lambda a: abs(a))) >= 0.3 AS rail, round(len(list_filter(x, lambda a: abs(a) >= 0.3)) / 64, 6) AS share FROM p")
def level_flags(t: Tables) -> DataFrame:
    f = A.level_flags(A.doubles("embedding"), 0.2, 0.3)
    return t.embeddings.select("vec_id", f.alias("f")).select("vec_id", "f.knee", "f.rail", r9(F.col("f.share")).alias("share"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(list_zip([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] || x[1:61], range(64)), lambda z: z[1] * z[2])), 6) AS delayed, round(list_sum(list_transform(x, lambda a: greatest(-0.1, least(0.1, a))::DOUBLE)), 6) AS clipped FROM p""")
def reference_faults(t: Tables) -> DataFrame:
    """Faults of a reference channel: a delay and a clip."""
    x = A.doubles("embedding")
    place = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    return t.embeddings.select("vec_id", r9(A.dot(A.shifted(x, 3), place)).alias("delayed"), r9(A.total(A.clipped(x, 0.1))).alias("clipped"))


@query(PAIRS + """, w AS (SELECT vec_id, x[1:60] || list_transform(range(1, 5), lambda i: x[60 + i] * (1 - i / 5) + y[i] * (i / 5)) || y[5:64] AS z FROM p) SELECT vec_id, len(z) AS n, round(list_sum(list_transform(list_zip(z, range(124)), lambda q: q[1] * q[2])), 6) AS moment FROM w""")
def crossfade_concat(t: Tables) -> DataFrame:
    z = pairs(t).select("vec_id", A.crossfaded(F.col("x"), F.col("y"), 4).alias("z"))
    place = F.transform(F.sequence(F.lit(0), F.lit(123)), lambda i: i.cast("double"))
    return z.select("vec_id", F.size("z").cast("long").alias("n"), r9(A.dot(F.col("z"), place)).alias("moment"))


@query(PAIRS + """, f AS (SELECT vec_id, k, 10 * log10(list_sum(list_transform(x[k * 8 + 1:k * 8 + 8], lambda a: a * a)) / 8 + 1e-10) AS level, 20 * log10(greatest(list_dot_product(x[k * 8 + 1:k * 8 + 8], y[k * 8 + 1:k * 8 + 8]) / (list_sum(list_transform(x[k * 8 + 1:k * 8 + 8], lambda a: a * a)) + 1e-12), 1e-4)) AS gain FROM p, range(8) r(k)),
a AS (SELECT *, level > max(level) OVER (PARTITION BY vec_id) - 6 AS active FROM f) SELECT vec_id, count(*) AS active, round(quantile_cont(gain, 0.5), 6) AS median_gain, count(CASE WHEN gain < -20 THEN 1 END) AS lost FROM a WHERE active GROUP BY vec_id""")
def speech_loss(t: Tables) -> DataFrame:
    """Per signal the active frames, their median gain and how many are lost."""
    g = pairs(t).select("vec_id", F.explode(A.loss_frames(F.col("x"), F.col("y"), 8, 6.0)).alias("g")).filter("g is not null")
    return g.groupBy("vec_id").agg(F.count(F.lit(1)).alias("active"), r9(F.percentile("g", F.lit(0.5))).alias("median_gain"), F.count(F.when(F.col("g") < -20, 1)).alias("lost"))


@query(PAIRS + """, e AS (SELECT vec_id, list_transform(range(16), lambda k: abs(10 * log10(list_sum(list_transform(x[k * 4 + 1:k * 4 + 4], lambda a: a * a)) / 4 + 1e-10) - 10 * log10(list_sum(list_transform(y[k * 4 + 1:k * 4 + 4], lambda a: a * a)) / 4 + 1e-10)) < 6) AS ok FROM p)
SELECT vec_id, coalesce(list_min(list_filter(range(2, 14), lambda k: ok[k + 1] AND ok[k + 2])) - 2, 'inf'::DOUBLE) * 4 / 16000.0::DOUBLE AS recovery FROM e""")
def recovery_time(t: Tables) -> DataFrame:
    """When a burst's envelope has come back to its twin's."""
    return pairs(t).select("vec_id", A.recovery_s(F.col("x"), F.col("y"), 2, 2, 4, 16000.0, 6.0).alias("recovery"))


@query("""SELECT url, regexp_extract(url, '(?:v=|youtu\\.be/|shorts/)([A-Za-z0-9_-]{11})', 1) AS video, regexp_extract(url, '^https?://([^/]+)', 1) AS host, split_part(regexp_replace(url, '^https?://', ''), '/', 2) AS top FROM pages""")
def id_regex(t: Tables) -> DataFrame:
    """Identifiers in addresses."""
    rest = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    return t.pages.select("url", S.youtube_id("url").alias("video"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.coalesce(F.get(rest, 1), F.lit("")).alias("top"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first, regexp_replace(p_brand, '[0-9]+$', '') AS family, regexp_replace(p_type, ' [^ ]*$', '') AS category, CASE WHEN p_brand LIKE '%1' THEN 'one' END AS mark FROM part""")
def split_fields(t: Tables) -> DataFrame:
    """Fields of composite names."""
    return t.part.select("p_partkey", F.split("p_name", " ")[0].alias("first"), F.regexp_replace("p_brand", "[0-9]+$", "").alias("family"), F.regexp_replace("p_type", " [^ ]*$", "").alias("category"), F.when(F.col("p_brand").endswith("1"), "one").alias("mark"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9'' ]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, len(w) AS n, len(list_distinct(w)) AS distinct_words, w[1] AS first FROM w""")
def word_tokens(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", S.words("text").alias("w"))
    return w.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), F.get("w", 0).alias("first"))


@query("""SELECT event_id, round(10 * log10(value + 1e-12), 6) AS db, round(pow(10, value / 20), 6) AS amplitude, CASE WHEN value < 10 THEN 'soft' WHEN value < 40 THEN 'normal' WHEN value < 70 THEN 'raised' ELSE 'loud' END AS effort,
  round(least(1.0::DOUBLE, (event_id % 500 + 1) / 100.0::DOUBLE) * 0.5 * (1 + cos(pi() * least(event_id % 500, 400) / 400.0::DOUBLE)), 6) AS rate, round(least(0.999::DOUBLE, (1 + event_id % 500) / (10.0::DOUBLE + event_id % 500)), 6) AS decay FROM events""")
def closed_forms(t: Tables) -> DataFrame:
    """Decibels, effort classes and schedules."""
    step = F.col("event_id") % 500
    effort = S.ladder("value", [(10.0, "soft"), (40.0, "normal"), (70.0, "raised")], "loud")
    return t.events.select("event_id", r9(S.db_power("value")).alias("db"), r9(S.from_db("value")).alias("amplitude"), effort.alias("effort"), r9(S.cosine_schedule(step, 100, 400)).alias("rate"), r9(S.ema_decay(0.999, step)).alias("decay"))


@query("""WITH f AS (SELECT p_partkey, p_size * 100.0::DOUBLE AS f FROM part) SELECT p_partkey, round(20 * log10((12194.0::DOUBLE * 12194 * f * f * f * f) / ((f * f + 20.6::DOUBLE * 20.6) * sqrt((f * f + 107.7::DOUBLE * 107.7) * (f * f + 737.9::DOUBLE * 737.9)) * (f * f + 12194.0::DOUBLE * 12194))) + 2.0, 6) AS a_weight FROM f""")
def a_weighting(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r9(S.a_weight_db(F.col("p_size") * 100.0)).alias("a_weight"))


@query()
def acoustics(t: Tables) -> DataFrame:
    """Absorption of air and the level of a blast, over a grid of frequencies and distances."""
    d = t.part.select("p_partkey", (F.col("p_size") * 100.0).alias("f"), (F.col("p_retailprice") / 10).alias("r"))
    return d.select("p_partkey", r9(S.air_absorption_db_per_m("f")).alias("absorption"), r9(S.blast_spl(F.lit(0.05), "r")).alias("spl"))


@query("""SELECT doc_id, regexp_replace(replace('ckpt:/work\\a/runs/' || source, '\\', '/'), '^(ckpt|cascade):(?:.*[/])?(runs[/])', '\\1:\\2') AS system, lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' True ' WHEN doc_id % 3 = 1 THEN '1.0' ELSE 'no' END)) IN ('true', '1', '1.0', 'yes') AS flag,
  TRY_CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE 'n/a' END AS DOUBLE) AS number FROM documents""")
def clean_values(t: Tables) -> DataFrame:
    """Names, flags and numbers as files spell them."""
    id = F.col("doc_id")
    flag = F.when(id % 3 == 0, " True ").when(id % 3 == 1, "1.0").otherwise("no")
    value = F.when(id % 2 == 0, F.col("n_chars").cast("string")).otherwise("n/a")
    return t.documents.select("doc_id", S.system_name(F.concat(F.lit("ckpt:/work\\a/runs/"), "source")).alias("system"), S.truthy(flag).alias("flag"), S.number(value).alias("number"))
