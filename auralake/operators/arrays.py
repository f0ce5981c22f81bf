"""Signals as array columns: energies, distances, frames. All of it is built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralake.functions import scalars as S


def doubles(x: Column | str) -> Column:
    return S.col(x).cast("array<double>")


def total(x: Column) -> Column:
    """The sum of an array of doubles, in order."""
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def energy(x: Column) -> Column:
    return total(F.transform(x, lambda a: a * a))


def mean_square(x: Column) -> Column:
    return energy(x) / F.size(x)


def snr_db(clean: Column, estimate: Column) -> Column:
    """The clean signal's energy over that of what the estimate adds."""
    noise = F.zip_with(clean, estimate, lambda a, b: a - b)
    return 10 * F.log10((energy(clean) + 1e-10) / (energy(noise) + 1e-10))


def si_sdr_db(clean: Column, estimate: Column) -> Column:
    """As :func:`snr_db`, but against the clean signal scaled to fit: a gain costs nothing."""
    scale = dot(estimate, clean) / (energy(clean) + 1e-10)
    rest = energy(estimate) - 2 * scale * dot(estimate, clean) + scale * scale * energy(clean)
    return 10 * F.log10((scale * scale * energy(clean) + 1e-10) / (F.greatest(rest, F.lit(0.0)) + 1e-10))


def frames(x: Column, size: int, hop: int | None = None) -> Column:
    """Whole frames of ``size`` samples every ``hop``, as an array of arrays."""
    hop = hop or size
    count = F.floor((F.size(x) - size) / hop) + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.slice(x, (i * hop + 1).cast("int"), size))).otherwise(F.array().cast("array<array<double>>"))


def envelope_db(x: Column, size: int, floor: float = 1e-10) -> Column:
    """The level of each frame."""
    return F.transform(frames(x, size), lambda f: 10 * F.log10(mean_square(f) + floor))


def crest_db(x: Column) -> Column:
    """The peak over the root mean square."""
    return 20 * F.log10((F.array_max(F.transform(x, F.abs)) + 1e-12) / (F.sqrt(mean_square(x)) + 1e-12))


def energy_snr_db(x: Column, size: int) -> Column:
    """The loudest three tenths of the frames over the quietest tenth."""
    levels = F.array_sort(F.transform(frames(x, size), lambda f: mean_square(f) + 1e-10))
    n = F.size(levels)
    low, high = F.greatest(F.lit(1), F.floor(n / 10).cast("int")), F.greatest(F.lit(1), F.floor(n * 0.3).cast("int"))
    mean = lambda part, k: total(part) / k
    return 10 * F.log10(mean(F.slice(levels, n - high + 1, high), high) / mean(F.slice(levels, F.lit(1), low), low))


def speech_active_power(x: Column, size: int, below_db: float = -30.0) -> Column:
    """The mean power of frames within ``below_db`` of the loudest."""
    power = F.transform(frames(x, size), mean_square)
    loud = F.filter(power, lambda p: p >= F.array_max(power) * 10 ** (below_db / 10))
    return total(loud) / F.size(loud)


def shifted(x: Column, by: int) -> Column:
    """The signal delayed by whole samples, zeros in front."""
    n = F.size(x)
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), by), x), F.lit(1), n) if by >= 0 else F.concat(F.slice(x, F.lit(1 - by), n), F.array_repeat(F.lit(0.0), -by))


def clipped(x: Column, limit: Column | float) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.transform(x, lambda a: F.greatest(-limit, F.least(limit, a)))


def scaled_to_db(x: Column, level_db: float) -> Column:
    """The signal at a root mean square of ``level_db``."""
    gain = 10 ** (level_db / 20) / (F.sqrt(mean_square(x)) + 1e-9)
    return F.transform(x, lambda a: a * gain)


def mixed(x: Column, y: Column, snr: Column | float) -> Column:
    """``x`` with ``y`` scaled to lie ``snr`` decibels below it."""
    snr = snr if isinstance(snr, Column) else F.lit(snr)
    gain = F.sqrt(energy(x) / (energy(y) + 1e-12)) * F.pow(F.lit(10.0), -snr / 20)
    return F.zip_with(x, F.transform(y, lambda b: b * gain), lambda a, b: a + b)


def crossfaded(x: Column, y: Column, overlap: int) -> Column:
    """``x`` then ``y``, the last samples of one fading linearly into the first of the other."""
    n = F.size(x)
    weights = F.transform(F.sequence(F.lit(1), F.lit(overlap)), lambda i: i / (overlap + 1))
    fade = F.zip_with(F.zip_with(F.slice(x, n - overlap + 1, overlap), weights, lambda a, w: a * (1 - w)), F.zip_with(F.slice(y, F.lit(1), overlap), weights, lambda b, w: b * w), lambda a, b: a + b)
    return F.concat(F.slice(x, F.lit(1), n - overlap), fade, F.slice(y, F.lit(overlap + 1), F.size(y)))


def level_flags(x: Column, knee: float, rail: float) -> Column:
    """Whether the peak passes the knee and the rail, and the share of samples on the rail."""
    peak = F.array_max(F.transform(x, F.abs))
    share = F.size(F.filter(x, lambda a: F.abs(a) >= rail)) / F.size(x)
    return F.struct((peak > knee).alias("knee"), (peak >= rail).alias("rail"), share.alias("share"))


def loss_frames(clean: Column, estimate: Column, size: int, active_db: float = 30.0) -> Column:
    """Per frame the projection gain on the clean signal, in decibels, where it is active; null elsewhere."""
    level = envelope_db(clean, size)
    gain = F.zip_with(frames(clean, size), frames(estimate, size), lambda c, e: 20 * F.log10(F.greatest(dot(c, e) / (energy(c) + 1e-12), F.lit(1e-4))))
    return F.zip_with(level, gain, lambda v, g: F.when(v > F.array_max(level) - active_db, g))


def recovery_s(burst: Column, twin: Column, onset: int, hold: int, size: int, rate: float, within_db: float = 3.0) -> Column:
    """Seconds after the onset frame until the envelopes stay within ``within_db`` for ``hold`` frames; infinite if never."""
    close = F.zip_with(envelope_db(burst, size), envelope_db(twin, size), lambda a, b: F.abs(a - b) < within_db)
    starts = F.sequence(F.lit(onset), F.greatest(F.lit(onset), F.size(close) - hold - 1))
    first = F.array_min(F.filter(starts, lambda k: (k < F.size(close) - hold) & F.forall(F.slice(close, k + 1, hold), lambda ok: ok)))
    return F.coalesce((first - onset) * size / F.lit(rate), F.lit(S.INF))
