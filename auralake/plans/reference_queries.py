"""Faults and conditions of a reference channel, and level differences by frequency, over pairs of vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.operators import arrays as A
from auralake.operators import references as R
from auralake.plans.array_queries import PAIRS, pairs
from auralake.plans.base import Tables, query
from auralake.plans.stats_queries import U, r9

#: Clean signal ``c``, primary ``p`` (with noise) and reference ``r`` of each pair of vectors, 64 samples each.
CHANNELS = PAIRS + """, ch AS (SELECT vec_id, x AS c, list_transform(list_zip(x, y), lambda z: 0.8 * z[1] + 0.5 * z[2]) AS p, list_transform(list_zip(x, y), lambda z: 0.3 * z[1] + 0.6 * z[2]) AS r FROM p)"""
#: A convolution of ``{x}`` with the list ``{k}``, and a move by ``{d}`` samples.
CONVOLVED = "list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, least(i + 1, len({k}))), lambda j: {k}[j + 1] * {x}[i - j + 1])))"
MOVED = "list_transform(range(0, 64), lambda i: CASE WHEN i - {d} BETWEEN 0 AND 63 THEN {x}[(i - {d} + 1)::BIGINT] ELSE 0.0 END)"
PEAK = "list_max(list_transform({0}, lambda a: abs(a)))"
LOW = math.exp(-2 * math.pi * 800 / R.RATE)
OUT = "round(list_sum(list_transform(list_zip(z, range(64)), lambda q: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, q[1])) * (q[2] + 1))), 6) AS moment"


def channels(t: Tables) -> DataFrame:
    mix = lambda a, b: F.zip_with("x", "y", lambda u, v: a * u + b * v)
    return pairs(t).select("vec_id", F.col("x").alias("c"), mix(0.8, 0.5).alias("p"), mix(0.3, 0.6).alias("r"))


def told(rows: DataFrame, name: str) -> DataFrame:
    """Of each reference a moment that any moved sample changes, and how many samples are there."""
    place = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return rows.select("vec_id", name, r9(A.dot(F.col("reference"), place)).alias("moment"), F.size(F.filter("available", lambda a: a)).cast("long").alias("available"))


def condition_sql() -> str:
    made = {
        "present": ("r", 64), "absent": ("list_transform(r, lambda a: 0.0)", 0), "burst_dropout": ("list_transform(list_zip(r, range(64)), lambda q: CASE WHEN q[2] >= 16 AND q[2] < 24 OR q[2] >= 40 AND q[2] < 46 THEN 0.0 ELSE q[1] END)", 50),
        "gain_m12": ("list_transform(r, lambda a: a * pow(10, -0.6))", 64), "lowpass": (f"list_transform({CONVOLVED.format(x='r', k='low')}, lambda a: a * pow(10, -0.6))", 64), "delay": (MOVED.format(x="r", d=24), 64),
        "clipped": (f"list_transform(r, lambda a: greatest(-0.1 * {PEAK.format('r')}, least(0.1 * {PEAK.format('r')}, a)))", 64), "talker_leak": ("list_transform(list_zip(r, c), lambda q: q[1] + q[2] * pow(10, -0.1))", 64),
    }
    made |= {n: (f"list_transform(list_zip(p, c), lambda q: q[1] - q[2] + q[2] * pow(10, {float(n[4:])} / 20))", 64) for n in R.CONDITIONS if n.startswith("ild_")}
    rows = " UNION ALL ".join(f"SELECT vec_id, '{n}' AS cond, {z} AS z, {k} AS available FROM kernels" for n, (z, k) in made.items())
    return CHANNELS + f""", kernels AS (SELECT *, list_transform(range(0, 96), lambda k: (1 - {LOW}::DOUBLE) * pow({LOW}::DOUBLE, k)) AS low FROM ch), m AS ({rows})
SELECT vec_id, cond, {OUT}, available::BIGINT AS available FROM m"""


@query(condition_sql())
def all_conditions(t: Tables) -> DataFrame:
    """Every clip under all fifteen conditions of its reference."""
    made = F.explode(R.conditions(F.col("p"), F.col("r"), F.col("c"))).alias("k")
    return told(channels(t).select("vec_id", made).select("vec_id", "k.*"), "cond")


#: Ranges for signals of 64 samples at 64 samples a second; others are the fixed ones.
SHORT = R.FAULT_RANGES | {"delay_samples": (1, 12)}


def fault_sql() -> str:
    key = "'|' || vec_id"
    u = lambda what: U.format(f"'{what}' || {key}")
    between = lambda name, what=None: f"({SHORT[name][0]} + ({SHORT[name][1]} - {SHORT[name][0]})::DOUBLE * {u(what or name)})"
    whole = lambda name, what=None: f"floor({SHORT[name][0]} + {SHORT[name][1] - SHORT[name][0] + 1} * {u(what or name)})::BIGINT"
    total, below, kinds = sum(R.FAULT_WEIGHTS.values()), 0.0, ""
    for kind, weight in R.FAULT_WEIGHTS.items():
        below += weight
        kinds += f" WHEN {u('fault')} < {below / total!r}::DOUBLE THEN '{kind}'"
    spans = ", ".join(f"CASE WHEN {b} < {whole('bursts')} THEN [floor({u(f'burst_at{b}')} * greatest(64 - floor({between('burst_s', f'burst_s{b}')} * 64), 1))::BIGINT, floor({between('burst_s', f'burst_s{b}')} * 64)::BIGINT] END" for b in range(3))
    gone = "len(list_filter(spans, lambda s: s IS NOT NULL AND i - 1 >= s[1] AND i - 1 < s[1] + s[2])) > 0"
    noise = U.format(f"'noise' || {key} || '|' || i") + " + " + U.format(f"'noise2' || {key} || '|' || i") + " - 1"
    z = {
        "dropout": "list_transform(r, lambda a: 0.0)", "burst": f"list_transform(range(1, 65), lambda i: CASE WHEN {gone} THEN 0.0 ELSE r[i] END)", "delay": MOVED.format(x="r", d="shift"), "gain": "list_transform(r, lambda a: a * gain)",
        "polarity": "list_transform(r, lambda a: -a)", "clip": "list_transform(r, lambda a: greatest(-rail, least(rail, a)))", "noise": "list_transform(list_zip(r, tilted), lambda q: q[1] + q[2] * noise_scale)",
        "lowpass": f"list_transform({CONVOLVED.format(x='r', k='low')}, lambda a: a * low_gain)", "leak": f"list_transform(list_zip(r, {MOVED.format(x='c', d='leak_by')}), lambda q: q[1] + q[2] * leak_gain)",
    }
    square = "list_sum(list_transform({0}, lambda a: a * a)) / 64"
    return CHANNELS + f""", drawn AS (SELECT *, CASE{kinds} ELSE 'leak' END AS kind, [{spans}] AS spans, {whole('delay_samples')} * CASE WHEN {u('delay_sign')} < 0.5 THEN 1 ELSE -1 END AS shift,
  pow(10, CASE WHEN {u('gain_up')} < 0.2 THEN {between('gain_up_db')} ELSE {between('gain_db')} END / 20) AS gain, {PEAK.format('r')} * {between('clip_frac')} AS rail,
  list_transform(range(0, 64), lambda i: {noise}) AS white, list_transform(range(0, 96), lambda k: pow(0.99::DOUBLE * {u('noise_pole')}, k)) AS tilt,
  list_transform(range(0, 96), lambda k: (1 - exp(-2 * pi() * {between('lowpass_hz')} / 64)) * pow(exp(-2 * pi() * {between('lowpass_hz')} / 64), k)) AS low, pow(10, {between('lowpass_db')} / 20) AS low_gain,
  {whole('leak_delay')} AS leak_by, pow(10, CASE WHEN {u('leak_near')} < 0.5 THEN {between('leak_near_db')} ELSE {between('leak_db')} END / 20) AS leak_gain FROM ch),
toned AS (SELECT *, {CONVOLVED.format(x='white', k='tilt')} AS tilted FROM drawn),
scaled AS (SELECT *, sqrt({square.format('r')} + 1e-12) / (sqrt({square.format('tilted')} - pow(list_sum(tilted) / 64, 2)) + 1e-9) * pow(10, -{between('noise_snr_db')} / 20) AS noise_scale FROM toned),
m AS (SELECT vec_id, kind, CASE kind{"".join(f" WHEN '{k}' THEN {v}" for k, v in z.items())} END AS z,
  CASE kind WHEN 'dropout' THEN 0 WHEN 'burst' THEN len(list_filter(range(1, 65), lambda i: NOT ({gone}))) ELSE 64 END AS available FROM scaled)
SELECT vec_id, kind, {OUT}, available::BIGINT AS available FROM m"""


@query(fault_sql())
def drawn_faults(t: Tables) -> DataFrame:
    """One of nine faults of each reference, drawn by weight, its settings by hashes."""
    rows = channels(t).withColumn("kind", R.fault_kind(F.col("vec_id")))
    made = R.faulty(F.col("kind"), F.col("r"), F.col("c"), (F.col("vec_id"),), SHORT, 64.0)
    return told(rows.select("vec_id", "kind", made.alias("f")).select("vec_id", "kind", "f.*"), "kind")


@query(CHANNELS + f""", w AS (SELECT k, i, (0.5::DOUBLE - 0.5 * cos(2 * pi() * i / 16)) * cos(2 * pi() * k * i / 16) AS co, (0.5::DOUBLE - 0.5 * cos(2 * pi() * i / 16)) * sin(2 * pi() * k * i / 16) AS si FROM range(9) a(k), range(16) b(i)),
f AS (SELECT vec_id, f, k, sum(p[f * 8 + i + 1] * co) AS pr, sum(p[f * 8 + i + 1] * si) AS pi, sum(r[f * 8 + i + 1] * co) AS rr, sum(r[f * 8 + i + 1] * si) AS ri, sum(c[f * 8 + i + 1] * co) AS cr, sum(c[f * 8 + i + 1] * si) AS ci FROM ch, range(7) g(f), w GROUP BY ALL),
b AS (SELECT vec_id, 10 * log10((pr * pr + pi * pi + 1e-12) / (rr * rr + ri * ri + 1e-12)) AS ild, 10 * log10((cr * cr + ci * ci + 1e-12) / ((pr - cr) * (pr - cr) + (pi - ci) * (pi - ci) + 1e-12)) AS loc, pr * pr + pi * pi + 1e-12 AS pw,
  max(pr * pr + pi * pi + 1e-12) OVER (PARTITION BY vec_id) AS most FROM f)
SELECT vec_id, count(CASE WHEN loc > 3 THEN 1 END) AS speech_bins, count(CASE WHEN loc < -3 THEN 1 END) AS noise_bins, round(coalesce(sum(CASE WHEN loc > 3 THEN ild END), 0), 4) AS speech_ild, round(coalesce(sum(CASE WHEN loc < -3 THEN ild END), 0), 4) AS noise_ild
FROM b WHERE pw > most * 1e-5 GROUP BY vec_id""")
def bin_level_differences(t: Tables) -> DataFrame:
    """Level differences of two microphones by frequency, where speech rules and where noise does."""
    d = R.level_differences(F.col("p"), F.col("r"), F.col("c"), 16, clear_db=3.0)
    rows = channels(t).select("vec_id", d.alias("d"))
    count = lambda side: F.size(f"d.{side}").cast("long").alias(f"{side}_bins")
    ild = lambda side: F.round(A.total(F.col(f"d.{side}")), 4).alias(f"{side}_ild")
    return rows.select("vec_id", count("speech"), count("noise"), ild("speech"), ild("noise"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, 0.1::DOUBLE * (vec_id % 9) AS delay FROM embeddings), k AS (SELECT *, list_transform(range(0, 9), lambda j: j - 4 - delay) AS t FROM v), h AS (SELECT *, list_transform(t, lambda q: CASE WHEN abs(q) < 1e-12 THEN 1.0::DOUBLE ELSE sin(pi() * q) / (pi() * q) END * (0.5 + 0.5 * cos(2 * pi() * q / 10))) AS h FROM k) "
       + f"SELECT vec_id, round(list_sum(list_transform(list_zip({CONVOLVED.format(x='x', k='h')}, range(64)), lambda q: q[1] * (q[2] + 1))), 6) AS moment FROM h")
def fractional_delays(t: Tables) -> DataFrame:
    """Signals delayed by parts of a sample, by a short kernel."""
    place = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    rows = t.embeddings.select("vec_id", A.doubles("embedding").alias("x"), (0.1 * (F.col("vec_id") % 9)).alias("by"))
    return rows.select("vec_id", r9(A.dot(R.convolved(F.col("x"), R.fractional_delay(F.col("by"))), place)).alias("moment"))
