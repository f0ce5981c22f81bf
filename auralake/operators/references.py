"""Faults and conditions of a reference channel, and level differences by frequency, as expressions over array columns.

All of it runs in the JVM: a filter is a convolution with a short kernel, a spectrum a product with constant sines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import arrays as A

RATE = 16_000.0

# Kinds of faults by weight, and the ranges that their settings are drawn from.
FAULT_WEIGHTS = {"dropout": 1.0, "burst": 1.0, "delay": 1.0, "gain": 1.0, "polarity": 0.5, "clip": 1.0, "noise": 1.0, "lowpass": 1.0, "leak": 1.5}
FAULT_RANGES = {
    "burst_s": (0.1, 1.0), "bursts": (1, 3), "delay_samples": (1, 48), "gain_db": (-18.0, -6.0), "gain_up_db": (3.0, 8.0), "p_gain_up": 0.2, "clip_frac": (0.05, 0.4),
    "noise_snr_db": (-10.0, 10.0), "lowpass_hz": (300.0, 1500.0), "lowpass_db": (-20.0, -6.0), "leak_db": (-14.0, 1.0), "leak_delay": (0, 8), "leak_near_db": (-4.0, 1.0), "p_leak_near": 0.5,
}

# The conditions that every clip is scored under, and where bursts of the third lie in it.
CONDITIONS = ("present", "absent", "burst_dropout", "gain_m12", "lowpass", "delay", "clipped", "talker_leak", "ild_-14", "ild_-10", "ild_-8", "ild_-6", "ild_-4", "ild_-2", "ild_0")
BURSTS = ((0.25, 0.375), (0.625, 0.725))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, where it stands within functions of many elements."""
    return F.transform(F.array(value), body)[0]


def convolved(x: Column, kernel: Column) -> Column:
    """The signal through a filter of finite response, zeros before its start."""

    def filtered(signal: Column, taps: Column) -> Column:
        n = F.size(taps)
        known = lambda i: F.slice(signal, F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, n))
        return F.transform(F.sequence(F.lit(0), F.size(signal) - 1), lambda i: A.dot(F.reverse(known(i)), F.slice(taps, F.lit(1), F.least(i + 1, n))))

    return let(x, lambda signal: let(kernel, lambda taps: filtered(signal, taps)))


def one_pole(pole: Column, taps: int) -> Column:
    """The kernel of ``y[i] = pole * y[i-1] + (1 - pole) * x[i]``, as far as ``taps`` go."""
    return let(pole, lambda p: F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda k: (1 - p) * F.pow(p, k)))


def fractional_delay(by: Column, taps: int = 9) -> Column:
    """The kernel of a delay by part of a sample beyond ``taps // 2`` whole ones: a sinc under a raised cosine."""
    t = lambda k: (k - taps // 2).cast("double") - by
    sinc = lambda v: F.when(F.abs(v) < 1e-12, 1.0).otherwise(F.sin(math.pi * v) / (math.pi * v))
    return F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda k: sinc(t(k)) * (0.5 + 0.5 * F.cos(2 * math.pi * t(k) / (taps + 1))))


def delayed(x: Column, by: Column) -> Column:
    """The signal moved by a column's whole samples, later or earlier, zeros where nothing is."""
    inside = lambda i, d, n: (i - d >= 0) & (i - d < n)
    taken = lambda v, i, d, n: F.element_at(v, F.least(F.greatest(i - d + 1, F.lit(1)), n).cast("int"))
    moved = lambda v, d: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.when(inside(i, d, F.size(v)), taken(v, i, d, F.size(v))).otherwise(0.0))
    return let(x, lambda v: let(by, lambda d: moved(v, d)))


def gained(x: Column, db: Column | float) -> Column:
    gain = F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)
    return let(gain, lambda g: F.transform(x, lambda a: a * g))


def added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def without(x: Column, spans: Column) -> Column:
    """The signal with zeros in each span of ``spans`` (array of from and to, to not included)."""
    return let(spans, lambda every: F.transform(x, lambda a, i: F.when(F.exists(every, lambda s: (i >= s[0]) & (i < s[1])), 0.0).otherwise(a)))


def there(x: Column, spans: Column) -> Column:
    return let(spans, lambda every: F.transform(x, lambda a, i: ~F.exists(every, lambda s: (i >= s[0]) & (i < s[1]))))


def limited(x: Column, most: Column) -> Column:
    """The signal clipped to a level that is worked out once."""
    return let(most, lambda m: A.clipped(x, m))


def condition(name: str, primary: Column, reference: Column, clean: Column, taps: int = 96) -> tuple[Column, Column]:
    """The reference under a condition, limited to the range, and which samples are known to be there."""
    n, everywhere = F.size(reference), F.array().cast("array<array<int>>")
    spans = everywhere
    if name == "present":
        out = reference
    elif name == "absent":
        spans = F.array(F.array(F.lit(0), n))
        out = without(reference, spans)
    elif name == "burst_dropout":
        spans = F.array(*[F.array(F.floor(a * n).cast("int"), F.floor(b * n).cast("int")) for a, b in BURSTS])
        out = without(reference, spans)
    elif name == "gain_m12":
        out = gained(reference, -12.0)
    elif name == "lowpass":
        out = gained(convolved(reference, one_pole(F.lit(math.exp(-2 * math.pi * 800 / RATE)), taps)), -12.0)
    elif name == "delay":
        out = A.shifted(reference, 24)
    elif name == "clipped":
        out = limited(reference, 0.1 * F.array_max(F.transform(reference, F.abs)))
    elif name == "talker_leak":
        out = added(reference, gained(clean, -2.0))
    elif name.startswith("ild_"):
        out = added(F.zip_with(primary, clean, lambda a, b: a - b), gained(clean, float(name[4:])))
    else:
        raise ValueError(f"no condition {name}")
    return A.clipped(out, 1.0), there(reference, spans)


def conditions(primary: Column, reference: Column, clean: Column, names: tuple[str, ...] = CONDITIONS) -> Column:
    """An array of (cond, reference, available), one entry a condition."""
    made = [(n, *condition(n, primary, reference, clean)) for n in names]
    return F.array(*[F.struct(F.lit(n).alias("cond"), r.alias("reference"), a.alias("available")) for n, r, a in made])


def fault_kind(*key: Column | int | str) -> Column:
    """One of the nine kinds, drawn by weight from the hash of a key."""
    u, total, below, out = S.uniform("fault", *key), sum(FAULT_WEIGHTS.values()), 0.0, None
    for kind, weight in FAULT_WEIGHTS.items():
        below += weight
        out = F.when(u < below / total, kind) if out is None else out.when(u < below / total, kind)
    return out.otherwise(list(FAULT_WEIGHTS)[-1])


def fault(kind: str, reference: Column, clean: Column, key: tuple, ranges: dict = FAULT_RANGES, rate: float = RATE, taps: int = 96) -> tuple[Column, Column]:
    """The reference with a fault of a kind, its settings drawn from the hash of ``key``, and which samples are there.

    Only dropouts are known to the capture path; every other fault leaves a reference that is there and wrong.
    """
    u = lambda what: S.uniform(what, *key)
    between = lambda name, what=None: ranges[name][0] + (ranges[name][1] - ranges[name][0]) * u(what or name)
    whole = lambda name, what=None: F.floor(ranges[name][0] + (ranges[name][1] - ranges[name][0] + 1) * u(what or name)).cast("int")
    n = F.size(reference)
    spans = F.array().cast("array<array<int>>")
    if kind == "dropout":
        spans = F.array(F.array(F.lit(0), n))
        out = without(reference, spans)
    elif kind == "burst":
        count = whole("bursts")
        made = []
        for b in range(ranges["bursts"][1]):
            length = F.floor(between("burst_s", f"burst_s{b}") * rate).cast("int")
            start = F.floor(u(f"burst_at{b}") * F.greatest(n - length, F.lit(1))).cast("int")
            made.append(F.when(F.lit(b) < count, F.array(start, start + length)))
        spans = F.array_compact(F.array(*made))
        out = without(reference, spans)
    elif kind == "delay":
        out = delayed(reference, whole("delay_samples") * F.when(u("delay_sign") < 0.5, 1).otherwise(-1))
    elif kind == "gain":
        out = gained(reference, F.when(u("gain_up") < ranges["p_gain_up"], between("gain_up_db")).otherwise(between("gain_db")))
    elif kind == "polarity":
        out = F.transform(reference, lambda a: -a)
    elif kind == "clip":
        out = limited(reference, F.array_max(F.transform(reference, F.abs)) * between("clip_frac"))
    elif kind == "noise":
        white = F.transform(reference, lambda a, i: S.uniform("noise", *key, i) + S.uniform("noise2", *key, i) - 1)
        tilt = let(0.99 * u("noise_pole"), lambda pole: F.transform(F.sequence(F.lit(0), F.lit(taps - 1)), lambda k: F.pow(pole, k)))
        spread = lambda z: F.sqrt(A.mean_square(z) - F.pow(A.total(z) / n, 2))
        scale = lambda z: F.sqrt(A.mean_square(reference) + 1e-12) / (spread(z) + 1e-9) * F.pow(F.lit(10.0), -between("noise_snr_db") / 20)
        out = let(convolved(white, tilt), lambda z: let(scale(z), lambda by: F.zip_with(reference, z, lambda a, b: a + b * by)))
    elif kind == "lowpass":
        out = gained(convolved(reference, one_pole(F.exp(-2 * math.pi * between("lowpass_hz") / rate), taps)), between("lowpass_db"))
    elif kind == "leak":
        level = F.when(u("leak_near") < ranges["p_leak_near"], between("leak_near_db")).otherwise(between("leak_db"))
        out = added(reference, gained(delayed(clean, whole("leak_delay")), level))
    else:
        raise ValueError(f"no fault {kind}")
    return A.clipped(out, 1.0), there(reference, spans)


def faulty(kind: Column, reference: Column, clean: Column, key: tuple, ranges: dict = FAULT_RANGES, rate: float = RATE) -> Column:
    """(reference, available) of the fault that each row's ``kind`` names; a row without a kind stays as it is."""
    out = None
    for name in FAULT_WEIGHTS:
        made = F.struct(*[c.alias(n) for c, n in zip(fault(name, reference, clean, key, ranges, rate), ("reference", "available"))])
        out = F.when(kind == name, made) if out is None else out.when(kind == name, made)
    return out.otherwise(F.struct(reference.alias("reference"), F.transform(reference, lambda a: F.lit(True)).alias("available")))


def waves(size: int, bins: int | None = None) -> tuple[Column, Column]:
    """Constant cosines and sines of each bin, a frame long, under a raised cosine that adds up to one at half a frame's hop."""
    bins = size // 2 + 1 if bins is None else bins
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]
    rows = lambda f: F.array(*[F.array(*[F.lit(w * f(2 * math.pi * k * i / size)) for i, w in enumerate(window)]) for k in range(bins)])
    return rows(math.cos), rows(math.sin)


def bin_powers(x: Column, size: int, floor: float = 1e-12) -> Column:
    """The power of each bin of each frame of half-overlapping ``size`` samples, frame by frame in one array."""
    cosines, sines = waves(size)
    power = lambda f, co, si: F.zip_with(F.transform(co, lambda w: A.dot(f, w)), F.transform(si, lambda w: A.dot(f, w)), lambda re, im: re * re + im * im + floor)
    return let(cosines, lambda co: let(sines, lambda si: F.flatten(F.transform(A.frames(x, size, size // 2), lambda f: power(f, co, si)))))


def level_differences(primary: Column, reference: Column, clean: Column, size: int, live_db: float = -50.0, clear_db: float = 10.0) -> Column:
    """(speech, noise): level differences of both channels, in decibels, in bins that speech, or what is not speech, rules.

    Bins more than ``live_db`` below the primary's loudest count for neither.
    """
    ratio = lambda a, b: F.zip_with(a, b, lambda u, v: 10 * F.log10(u / v))

    def split(p: Column) -> Column:
        local = ratio(bin_powers(clean, size), bin_powers(F.zip_with(primary, clean, lambda a, b: a - b), size))
        bins = F.zip_with(F.zip_with(ratio(p, bin_powers(reference, size)), local, lambda a, b: F.struct(a.alias("ild"), b.alias("local"))), p, lambda b, w: F.struct(b["ild"].alias("ild"), b["local"].alias("local"), w.alias("power")))
        live = let(F.array_max(p) * 10 ** (live_db / 10), lambda least: F.filter(bins, lambda b: b["power"] > least))
        of = lambda kept, keep: F.transform(F.filter(kept, keep), lambda b: b["ild"])
        return let(live, lambda kept: F.struct(of(kept, lambda b: b["local"] > clear_db).alias("speech"), of(kept, lambda b: b["local"] < -clear_db).alias("noise")))

    return let(bin_powers(primary, size), split)
