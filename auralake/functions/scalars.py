"""Column expressions: hashes and draws, clean-up, identifiers in text, decibels and closed-form acoustics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Hashes and draws: pure functions of their arguments, so neither partitioning nor order ever changes them.


def stable_hash(text: Column | str) -> Column:
    """The first eight hexadecimal digits of the text's sha1, as a long."""
    return F.conv(F.substring(F.sha1(col(text).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def split_of(group: Column | str) -> Column:
    """train, val or test at 8 to 1 to 1, the same for all rows of a group."""
    h = stable_hash(group) % 10
    return F.when(h < 8, "train").when(h == 8, "val").otherwise("test")


def draw(*parts: Column | int | str) -> Column:
    """A long in [0, 2**32) from the parts' texts."""
    return stable_hash(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(*parts: Column | int | str) -> Column:
    """A double in [0, 1) from the parts' texts."""
    return draw(*parts) / F.lit(4294967296.0)


def pick(n: Column, *parts: Column | int | str) -> Column:
    """One of 0 .. n-1 from the parts' texts."""
    return draw(*parts) % n


# Clean-up.


def finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def scored(x: Column | str) -> Column:
    """NaN, which stands for not scored, as null: comparisons and means then treat it as missing."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def number(text: Column | str) -> Column:
    """A text as a double, null where it is none."""
    return scored(col(text).try_cast("double"))


def truthy(text: Column | str) -> Column:
    """Flags as files spell them: true, 1 and 1.0 in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(col(text).cast("string"))).isin("true", "1", "1.0", "yes"), F.lit(False))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(F.trim(col(text)), F.lit(""))


def posix(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


# Identifiers in text.


def youtube_id(url: Column | str) -> Column:
    """The eleven characters that name a video in a watch, short or share address; empty where there are none."""
    return F.regexp_extract(col(url), r"(?:v=|youtu\.be/|shorts/)([A-Za-z0-9_-]{11})", 1)


def query_value(url: Column | str, key: str, default: Column) -> Column:
    return F.coalesce(F.regexp_extract(col(url), rf"[?&]{key}=([^&#]+)", 1).try_cast("string"), default)


def first_match(text: Column | str, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col(text), p, 1), F.lit("")) for p in patterns])


def sound_id(source_id: Column | str) -> Column:
    """The number of a shared sound in a source's name, by the three ways that corpora write it; else null."""
    return first_match(source_id, [r"freesound[_/-](\d+)", r"/(\d{3,7})(?:_\d+)?$", r"-(\d{4,7})-[A-Z]-\d+$"])


#: Codes of licences that let anyone use a work for anything, if only its author is named.
FREE_LICENCES = ("zero", "by")


def licence_code(url: Column | str) -> Column:
    """The code in a public licence's address, such as ``by-nc`` or ``zero``; null where it has none."""
    return F.nullif(F.regexp_extract(F.lower(col(url)), "/(?:licenses|publicdomain)/([a-z+-]+)", 1), F.lit(""))


def licence_allows(url: Column | str, codes: tuple[str, ...] = FREE_LICENCES) -> Column:
    """Whether a licence's address has one of the codes; an address without a code, or none, allows nothing."""
    return F.coalesce(licence_code(url).isin(*codes), F.lit(False))


def json_hash(*columns: str) -> Column:
    """A sha256 of the columns' values as JSON, keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def without_chunk(source_id: Column | str) -> Column:
    """A recording's name without the index of its chunk."""
    return F.regexp_replace(col(source_id), r"_\d+_?$", "")


def system_name(system: Column | str) -> Column:
    """Checkpoint names keyed on ``runs/...``, whatever machine's path stands before it."""
    return posix(F.regexp_replace(col(system), r"^(ckpt|cascade):(?:.*[\\/])?(runs[\\/])", "$1:$2"))


def source_class(source_id: Column | str) -> Column:
    """``b`` of ``a:b/c``."""
    return F.get(F.split(col(source_id), "[:/]"), 1)


def words(text: Column | str) -> Column:
    """Lower-case tokens of letters, digits and apostrophes, as an array."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9' ]+", " "))
    return F.filter(F.split(spaced, " +"), lambda w: w != "")


# Decibels, levels, schedules.


def db_power(x: Column | str, floor: float = 1e-12) -> Column:
    return 10 * F.log10(col(x) + F.lit(floor))


def db_amplitude(x: Column | str, floor: float = 1e-12) -> Column:
    return 20 * F.log10(col(x) + F.lit(floor))


def from_db(x: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(x) / 20)


def a_weight_db(f: Column | str) -> Column:
    """The A weighting of a frequency in hertz (IEC 61672), zero at 1 kHz."""
    # The standard's four corner frequencies and its offset.
    f2 = col(f) * col(f)
    gain = (12194.0**2 * f2 * f2) / ((f2 + 20.6**2) * F.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194.0**2))
    return 20 * F.log10(gain) + 2.0


def air_absorption_db_per_m(f: Column | str, temp_c: float = 20.0, rh: float = 50.0, pa_kpa: float = 101.325) -> Column:
    """Atmospheric absorption of a pure tone (ISO 9613-1), in decibels a metre."""
    t, t0, t01, pr = temp_c + 273.15, 293.15, 273.16, pa_kpa / 101.325
    h = rh * 10 ** (-6.8346 * (t01 / t) ** 1.261 + 4.6151) / pr
    oxygen = pr * (24 + 4.04e4 * h * (0.02 + h) / (0.391 + h))
    nitrogen = pr * (t / t0) ** -0.5 * (9 + 280 * h * math.exp(-4.170 * ((t / t0) ** (-1 / 3) - 1)))
    f2 = col(f) * col(f)
    relaxed = 0.01275 * math.exp(-2239.1 / t) / (oxygen + f2 / oxygen) + 0.1068 * math.exp(-3352.0 / t) / (nitrogen + f2 / nitrogen)
    return 8.686 * f2 * (1.84e-11 / pr * (t / t0) ** 0.5 + (t / t0) ** -2.5 * relaxed)


def blast_spl(charge_kg: Column | str, distance_m: Column | str, surface: bool = True) -> Column:
    """Peak level of a free-air or surface blast by the Kinney-Graham fit, in decibels re 20 micropascal."""
    z = col(distance_m) / F.pow(col(charge_kg) * (1.8 if surface else 1.0), F.lit(1 / 3))
    ratio = 808 * (1 + F.pow(z / 4.5, F.lit(2.0))) / (
        F.sqrt(1 + F.pow(z / 0.048, F.lit(2.0))) * F.sqrt(1 + F.pow(z / 0.32, F.lit(2.0))) * F.sqrt(1 + F.pow(z / 1.35, F.lit(2.0)))
    )
    return 20 * F.log10(ratio * 101325.0 / 20e-6)


def ladder(x: Column | str, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step whose bound is above the value."""
    out = None
    for bound, name in steps:
        out = F.when(col(x) < bound, name) if out is None else out.when(col(x) < bound, name)
    return out.otherwise(otherwise)


def cosine_schedule(step: Column | str, warmup: int, total: int) -> Column:
    """A linear warm-up times a cosine that reaches zero at ``total`` steps."""
    rise = F.least(F.lit(1.0), (col(step) + 1) / F.lit(float(warmup))) if warmup else F.lit(1.0)
    return rise * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(col(step), F.lit(total)) / F.lit(float(total))))


def ema_decay(decay: float, step: Column | str) -> Column:
    """A moving average's decay, ramped so that the first steps do not weigh too much."""
    return F.least(F.lit(decay), (1 + col(step)) / (10.0 + col(step)))


# Reports.


def interval_text(mean: Column | str, lo: Column | str, hi: Column | str, digits: int = 3) -> Column:
    f = f"%.{digits}f"
    return F.when(finite(mean), F.format_string(f"{f} [{f},{f}]", col(mean), col(lo), col(hi))).otherwise("n/a")


def target_mark(mean: Column | str, lo: Column | str, target: float) -> Column:
    """Empty where there is no mean; a miss; met by the mean; met by the interval's lower end too."""
    return F.when(~finite(mean), "").when(col(mean) <= target, "miss").when(col(lo) > target, "met").otherwise("mean")
