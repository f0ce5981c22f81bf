"""Queries of the numpy signal operators: embeddings stand for short signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import signals as G
from auralake.plans.array_queries import PAIRS, pairs
from auralake.plans.base import Tables, query
from auralake.plans.stats_queries import r9

RATE = 16000.0


@query()
def stationarity_class(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", G.over(lambda x: G.stationarity(x, 8), "string", "embedding").alias("noise_class"))


@query()
def signal_measures(t: Tables) -> DataFrame:
    """Active seconds, brick-wall ratio and modulation of each signal."""
    return t.embeddings.select(
        "vec_id", r9(G.over(lambda x: G.active_seconds(x, RATE, 8), "double", "embedding")).alias("active_s"),
        r9(G.over(lambda x: G.cutoff_ratio(x, RATE, 4000.0, 2000.0, 64), "double", "embedding")).alias("ratio"),
        r9(G.over(lambda x: G.modulation_index(x, 8, RATE, 2, 300.0), "double", "embedding")).alias("modulation"),
    )


@query()
def coherence_null(t: Tables) -> DataFrame:
    """The frequency at which two channels first lose coherence."""
    return pairs(t).select("vec_id", r9(G.over(lambda x, y: G.coherence_null(x, y, RATE, 16), "double", "x", "y")).alias("hz"))


@query("""WITH s AS (SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda a: a * a)) AS energy, list_sum(list_transform(embedding::DOUBLE[], lambda a, i: a * i)) AS moment FROM embeddings)
SELECT vec_id, round(energy, 6) AS energy, round(moment, 6) AS moment, round(energy, 6) AS energy_asymmetric, round(moment, 6) AS moment_asymmetric FROM s""")
def transform_round_trip(t: Tables) -> DataFrame:
    """Energy and first moment of what analysis and overlap-add give back, with symmetric and with asymmetric windows."""

    def measured(x: np.ndarray, analysis: np.ndarray, synthesis: np.ndarray, hop: int) -> list[float]:
        y = G.synthesise(G.analyse(x, len(analysis), hop, analysis), len(x), len(analysis), hop, synthesis)
        return [float(y @ y), float(y @ np.arange(1, len(y) + 1))]

    hann, (long, short) = G.root_hann(16), G.asymmetric_windows(32, 8, 12)
    rows = t.embeddings.select(
        "vec_id", G.over(lambda x: measured(x, hann, hann, 8), "array<double>", "embedding").alias("a"),
        G.over(lambda x: measured(x, long, short, 8), "array<double>", "embedding").alias("b"),
    )
    return rows.select("vec_id", *[r9(F.col(c)[i]).alias(n + end) for c, end in (("a", ""), ("b", "_asymmetric")) for i, n in enumerate(("energy", "moment"))])


@query()
def resample_signals(t: Tables) -> DataFrame:
    """Energy that is left after a third of the rate and back."""
    return t.embeddings.select("vec_id", r9(G.over(lambda x: float((G.interpolated(G.decimated(x, 3, 33), 3, 33)[: len(x)] ** 2).sum()), "double", "embedding")).alias("energy"))


@query("""WITH RECURSIVE walk AS (SELECT vec_id, embedding::DOUBLE[] AS x, 0 AS i, 1.0::DOUBLE AS gain, 0 AS held, 0.0::DOUBLE AS energy, 0.0::DOUBLE AS peak FROM embeddings
  UNION ALL SELECT vec_id, x, i, gain, held, energy + v * v * gain * gain, greatest(peak, abs(v) * gain) FROM (
    SELECT vec_id, x, i + 1 AS i, v, energy, peak, CASE WHEN need <= gain THEN need WHEN held > 0 THEN gain ELSE least(need, gain + 0.05::DOUBLE * (1 - gain)) END AS gain,
      CASE WHEN need <= gain THEN 4 ELSE greatest(held - 1, 0) END AS held
    FROM (SELECT *, x[i + 1] AS v, CASE WHEN x[i + 1] = 0 THEN 1 ELSE least(1.0::DOUBLE, 0.1::DOUBLE / abs(x[i + 1])) END AS need FROM walk WHERE i < len(x))))
SELECT vec_id, round(energy, 6) AS energy, round(peak, 6) AS peak, round(gain, 6) AS gain FROM walk WHERE i = len(x)""")
def limiter(t: Tables) -> DataFrame:
    """Energy, peak and last gain of a limited signal that comes in two parts, the second from the first one's state."""

    def measured(x: np.ndarray) -> list[float]:
        a, state = G.limited(x[:29], 0.1, 4, 0.05)
        b, (gain, _) = G.limited(x[29:], 0.1, 4, 0.05, state)
        y = np.concatenate([a, b])
        return [float(y @ y), float(np.abs(y).max()), gain]

    rows = t.embeddings.select("vec_id", G.over(measured, "array<double>", "embedding").alias("m"))
    return rows.select("vec_id", *[r9(F.col("m")[i]).alias(n) for i, n in enumerate(("energy", "peak", "gain"))])


@query()
def adaptive_filter(t: Tables) -> DataFrame:
    """What is left of a signal when an adaptive filter of another is taken out."""
    return pairs(t).select("vec_id", r9(G.over(lambda x, y: float((G.adaptive_residual(x, y, 8, 0.5)[0] ** 2).sum()), "double", "x", "y")).alias("residual"))


@query()
def post_filter(t: Tables) -> DataFrame:
    """Mean gain of a filter over a tracked noise floor."""
    gains = lambda x: float(G.noise_floor_gains(np.abs(G.spectra(x, 8, 4)) ** 2, 8).mean())
    return t.embeddings.select("vec_id", r9(G.over(gains, "double", "embedding")).alias("gain"))


@query(PAIRS + """, c AS (SELECT vec_id, k, corr(x[k + i], y[20 + i]) AS c FROM p, range(41) a(k), range(1, 25) b(i) GROUP BY ALL)
SELECT vec_id, arg_max(k, c)::INT AS lag, round(max(c), 6) AS correlation FROM c GROUP BY vec_id""")
def lag_search(t: Tables) -> DataFrame:
    """Where in a signal a piece of another fits best, and how well."""
    found = pairs(t).select("vec_id", G.over(lambda x, y: list(map(float, G.best_lag(y[20:44], x))), "array<double>", "x", "y").alias("m"))
    return found.select("vec_id", F.col("m")[0].cast("int").alias("lag"), r9(F.col("m")[1]).alias("correlation"))


@query()
def fractional_delay(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r9(G.over(lambda x: float(G.delayed(x, 2.5) @ np.arange(len(x))), "double", "embedding")).alias("moment"))


@query()
def synthetic_events(t: Tables) -> DataFrame:
    """Blast waves and wind gusts by seed."""
    peak = (1 + F.col("vec_id") % 5).cast("double")
    u = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: S.uniform("wind", F.col("vec_id"), i))
    rows = t.embeddings.select("vec_id", peak.alias("peak"), u.alias("u"))
    return rows.select("vec_id", r9(G.over(lambda p: float((G.blast_wave(RATE, 0.02, p) ** 2).sum()), "double", "peak")).alias("blast"), r9(G.over(lambda u: float(G.gusts(u, 0.8).mean()), "double", "u")).alias("wind"))


@query()
def word_error_rate(t: Tables) -> DataFrame:
    """Word errors of each turn against the one before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    words = t.conversations.select("conv_id", "turn", S.words("text").alias("h"))
    rows = words.withColumn("r", F.lag("h").over(w)).filter("r is not null")
    return rows.select("conv_id", "turn", r9(G.wer(F.col("h"), F.col("r"))).alias("wer"))


@query()
def diffuse_field(t: Tables) -> DataFrame:
    """Correlation of two channels of a diffuse field, near and far apart."""

    def r(x: np.ndarray, y: np.ndarray, d: float) -> float:
        a, b = G.diffuse_pair(x, y, d, RATE, 16)
        return float(np.corrcoef(a, b)[0, 1])

    return pairs(t).select("vec_id", r9(G.over(lambda x, y: r(x, y, 0.001), "double", "x", "y")).alias("near"), r9(G.over(lambda x, y: r(x, y, 0.5), "double", "x", "y")).alias("far"))


@query()
def transfer_and_wind(t: Tables) -> DataFrame:
    """Energy behind the head's shadow, and of wind noise shaped by a recursive filter."""
    wind = G.autoregressive(-20 * np.log10(1 + np.arange(33)), 5)
    return t.embeddings.select(
        "vec_id", r9(G.over(lambda x: float((G.head_transfer(x, RATE, -3.0, 0.0005, 12.0) ** 2).sum()), "double", "embedding")).alias("shadowed"),
        r9(G.over(lambda x: float((G.filtered_noise(x, wind) ** 2).sum()), "double", "embedding")).alias("wind"),
    )


@query()
def saturation_knee(t: Tables) -> DataFrame:
    """The knee that gives each level of distortion."""
    thd = (1 + F.col("vec_id") % 5) / 100.0
    return t.embeddings.select("vec_id", thd.alias("thd")).select("vec_id", "thd", r9(G.over(lambda x: G.knee_for(x), "double", "thd")).alias("knee"))


@query()
def hop_features(t: Tables) -> DataFrame:
    """Features of each frame of two channels."""
    rows = pairs(t).select("vec_id", F.posexplode(G.over(lambda x, y: G.frame_features(x, y, 16, 8).tolist(), "array<array<double>>", "x", "y")).alias("frame", "f"))
    return rows.select("vec_id", "frame", *[r9(F.col("f")[i]).alias(n) for i, n in enumerate(G.FEATURES)])


@query()
def band_masks(t: Tables) -> DataFrame:
    """An ideal ratio mask, as it is and averaged within auditory bands."""

    def masks(x: np.ndarray, y: np.ndarray) -> list[float]:
        a, b = (np.abs(G.spectra(v, 32, 16)) ** 2 for v in (x, y))
        m = np.sqrt(a / (a + b + 1e-12))
        return [float(m.mean()), float(G.band_projection(m, RATE, 6).mean())]

    rows = pairs(t).select("vec_id", G.over(masks, "array<double>", "x", "y").alias("m"))
    return rows.select("vec_id", r9(F.col("m")[0]).alias("mask"), r9(F.col("m")[1]).alias("banded"))
