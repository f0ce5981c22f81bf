"""Filters over array columns, and what each fault and condition leaves of a reference."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import references as R


@pytest.fixture(scope="module")
def channels(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *(rng.uniform(-0.4, 0.4, 160).tolist() for _ in range(3))) for k in range(60)]
    return spark.createDataFrame(rows, "k int, p array<double>, r array<double>, c array<double>").cache()


def test_convolution_is_that_of_numpy(spark, channels):
    rows = channels.select("r", R.convolved(F.col("r"), F.array(*map(F.lit, (0.5, -0.25, 0.125)))).alias("short"), R.convolved(F.col("r"), R.one_pole(F.lit(0.7), 400)).alias("pole"), R.convolved(F.col("r"), R.fractional_delay(F.lit(0.0))).alias("whole")).collect()
    for row in rows[:5]:
        x = np.array(row.r)
        assert np.allclose(row.short, np.convolve(x, [0.5, -0.25, 0.125])[:160])
        y, out = 0.0, []
        for v in x:
            y = 0.7 * y + 0.3 * v
            out.append(y)
        assert np.allclose(row.pole, out) and np.allclose(row.whole, np.concatenate([np.zeros(4), x[:-4]]))


def test_conditions_leave_what_they_should(spark, channels):
    made = F.explode(R.conditions(F.col("p"), F.col("r"), F.col("c"))).alias("made")
    rows = channels.filter("k < 3").select("p", "r", "c", made).select("p", "r", "c", "made.*").collect()
    assert len(rows) == 3 * len(R.CONDITIONS) == 45
    for row in rows:
        p, r, c, z, there = (np.array(x) for x in (row.p, row.r, row.c, row.reference, row.available))
        expected = {"present": r, "absent": 0 * r, "gain_m12": r * 10**-0.6, "delay": np.concatenate([np.zeros(24), r[:-24]]), "clipped": np.clip(r, -0.1 * abs(r).max(), 0.1 * abs(r).max()), "talker_leak": np.clip(r + c * 10**-0.1, -1, 1), "ild_-6": np.clip(p - c + c * 10**-0.3, -1, 1)}
        if row.cond in expected:
            assert np.allclose(z, expected[row.cond])
        assert there.sum() == {"absent": 0, "burst_dropout": 160 - 20 - 16}.get(row.cond, 160)
        assert row.cond != "burst_dropout" or (not z[40:60].any() and not z[100:116].any() and np.allclose(z[there], r[there]))
    with pytest.raises(ValueError):
        R.condition("unheard", F.col("p"), F.col("r"), F.col("c"))


def test_faults_are_drawn_by_weight_and_key(spark, channels):
    kinds = spark.range(4000).select(R.fault_kind(F.col("id")).alias("kind")).groupBy("kind").count().collect()
    total = sum(R.FAULT_WEIGHTS.values())
    assert all(abs(k["count"] / 4000 - R.FAULT_WEIGHTS[k.kind] / total) < 0.03 for k in kinds) and len(kinds) == 9
    names = list(R.FAULT_WEIGHTS)
    kind = F.element_at(F.array(*map(F.lit, names)), F.col("k") % 9 + 1)
    once, again = (channels.repartition(n).select("k", "r", kind.alias("kind"), R.faulty(kind, F.col("r"), F.col("c"), (F.col("k"),), rate=160.0).alias("f")).collect() for n in (1, 5))
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))
    for row in once:
        r, z, there = np.array(row.r), np.array(row.f.reference), np.array(row.f.available)
        assert abs(z).max() <= 1 and not np.allclose(z, r) and there.all() == (row.kind not in ("dropout", "burst"))
        assert not z[~there].any() and (row.kind != "polarity" or np.allclose(z, -r))
        if row.kind == "gain":
            db = 20 * math.log10(np.linalg.norm(z) / np.linalg.norm(r))
            assert -18 <= db <= -6 or 3 <= db <= 8
        if row.kind == "noise":
            assert -10.01 <= 10 * math.log10((r @ r) / ((z - r) @ (z - r))) + 0.5 and (z - r).any()


def test_level_differences_find_the_gain_between_channels(spark):
    """A tone that is speech alone lies 6 dB apart in its bins; a tone of noise lies 0 dB apart."""
    i = np.arange(256)
    speech, noise = 0.5 * np.sin(2 * np.pi * 4 * i / 32), 0.5 * np.sin(2 * np.pi * 12 * i / 32)
    df = spark.createDataFrame([((speech + noise).tolist(), (0.5 * speech + noise).tolist(), speech.tolist())], "p array<double>, r array<double>, c array<double>")
    d = df.select(R.level_differences(F.col("p"), F.col("r"), F.col("c"), 32).alias("d")).first()["d"]
    assert len(d.speech) >= 15 and np.allclose(np.median(d.speech), 20 * math.log10(2), atol=0.05) and np.allclose(np.median(d.noise), 0, atol=0.05)
