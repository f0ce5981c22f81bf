"""Known answers, refusals and equivalences of the engine's own operators."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import arrays as A
from auralake.operators import catalog as C
from auralake.operators import ordered as O
from auralake.operators import signals as G
from auralake.operators import stats as X
from auralake.operators import tables as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_stable_hash_is_the_first_eight_digits(spark):
    import hashlib

    assert one(spark, S.stable_hash(F.lit("abc")).alias("h"))["h"] == int(hashlib.sha1(b"abc").hexdigest()[:8], 16)


def test_keep_first_never_merges_blank_hashes(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "aaa"), (3, "bbb"), (4, ""), (5, ""), (6, None)], "pos int, sha1 string")
    assert sorted(r.pos for r in C.keep_first(df, ["sha1"], ["pos"], blank_is_unique=True).collect()) == [1, 3, 4, 5, 6]


def test_a_metric_not_scored_fails(spark):
    df = spark.createDataFrame([(16.0, 0.9, float("nan")), (16.0, 0.9, 2.6), (15.0, 0.9, 2.6), (16.0, None, 2.6)], "snr_out double, stoi double, pesq_wb double")
    assert [r.ok for r in df.select(X.passes().alias("ok")).collect()] == [False, True, False, False]


def test_cluster_interval_is_wider_than_rows(spark):
    rnd = random.Random(1)
    rows = [(c, i, rnd.gauss(c % 7, 0.1)) for c in range(40) for i in range(10)]
    df = spark.createDataFrame(rows, "cluster int, i int, x double").withColumn("g", F.lit("a")).withColumn("row", F.concat_ws("-", "cluster", "i"))
    clustered, by_row = X.cluster_ci(df, ["g"], "cluster", "x", 200).first(), X.cluster_ci(df, ["g"], "row", "x", 200).first()
    assert clustered["hi"] - clustered["lo"] > 1.5 * (by_row["hi"] - by_row["lo"])
    assert math.isclose(clustered["mean"], sum(r[2] for r in rows) / len(rows), rel_tol=1e-9)


def test_poisson_resampling_spreads_as_theory_says(spark):
    values = [float(c % 11) for c in range(300)]
    df = spark.createDataFrame([(c, x) for c, x in enumerate(values)], "cluster int, x double").withColumn("g", F.lit("a"))
    sd = X.interval(X.resample_poisson(X.cluster_sums(df, ["g"], "cluster", "x"), ["g"], "cluster", 2000, 1), ["g"]).first()["sd"]
    mean = sum(values) / 300
    assert abs(sd / math.sqrt(sum((x - mean) ** 2 for x in values) / 300**2) - 1) < 0.06


def test_intervals_cover_the_mean_as_often_as_they_say(spark):
    """Of 400 samples of one law, 95 % of intervals hold its mean; percentiles come out right, not only the spread."""
    rng = np.random.default_rng(5)
    rows = [(g, c, float(x)) for g in range(400) for c, x in enumerate(rng.exponential(1.0, 120))]
    df = spark.createDataFrame(rows, "g int, cluster int, x double")
    ends = X.cluster_ci(df, ["g"], "cluster", "x", 1000).collect()
    assert 0.90 < sum(r["lo"] <= 1.0 <= r["hi"] for r in ends) / 400 < 0.98


@pytest.mark.parametrize("pos, neg, auc", [([2, 3], [0, 1], 1.0), ([0, 1], [2, 3], 0.0), ([1, 1], [1, 1], 0.5), ([1, 2], [1, 3], 0.375)])
def test_rank_auc(spark, pos, neg, auc):
    df = spark.createDataFrame([(float(v), True) for v in pos] + [(float(v), False) for v in neg], "s double, p boolean").withColumn("g", F.lit(0))
    assert X.rank_auc(df, ["g"], "s", F.col("p")).first()["auc"] == auc


@pytest.mark.parametrize("lo, hi, up, verdict", [(0.1, 1, True, "superior"), (-0.4, 1, True, "non_inferior"), (-2, -0.6, True, "inferior"), (-2, 1, True, "inconclusive"), (-1, -0.1, False, "superior")])
def test_decide(spark, lo, hi, up, verdict):
    assert one(spark, X.decide(F.lit(lo), F.lit(hi), 0.5, up).alias("d"))["d"] == verdict


def test_envelope_walks_down_from_the_top(spark):
    rows = [("a", snr, 20.0 if snr >= 0 else 10.0, 0.9, 3.0) for snr in (-10.0, -5.0, 0.0, 5.0)] + [("b", 5.0, 1.0, 0.9, 3.0), ("c", float("inf"), 20.0, 0.9, 3.0)]
    df = spark.createDataFrame(rows, "s string, snr_in double, snr_out double, stoi double, pesq_wb double")
    assert {r.s: r.envelope for r in X.envelope(df, ["s"], "snr_in").collect()} == {"a": ">= 0 dB", "b": "none", "c": "met"}


def test_pareto_against_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, float(rnd.randrange(8)), float(rnd.randrange(8)) if i % 9 else float("nan")) for i in range(60)]
    found = {r.i: r.pareto for r in T.pareto(spark.createDataFrame(rows, "i int, cost double, gain double").filter("not isnan(gain)"), "cost", "gain").collect()}
    real = [r for r in rows if not math.isnan(r[2])]
    for i, c, g in real:
        assert found[i] == (not any(b <= c and h >= g and (b < c or h > g) for _, b, h in real))


def test_within_tolerance_against_all_pairs(spark):
    rnd = random.Random(3)
    a, b = ([(k, rnd.randrange(3), round(rnd.uniform(0, 20), 2)) for k in range(80)] for _ in range(2))
    left = spark.createDataFrame(a, "k int, w int, t double")
    right = spark.createDataFrame([(w, t) for _, w, t in b], "w int, t double")
    want = {k for k, w, t in a if any(w == v and abs(t - u) <= 0.5 for _, v, u in b)}
    assert {r.k for r in T.within(left, right, ["w"], "t", 0.5).collect()} == want


def test_queue_finishes_by_recursion(spark):
    rnd = random.Random(4)
    rows, t = [], 0.0
    for i in range(50):
        t += rnd.random()
        rows.append((0, i, t, rnd.random()))
    got = {r.i: r.finish for r in O.finish_times(spark.createDataFrame(rows, "g int, i int, a double, w double"), ["g"], ["i"], "a", "w").collect()}
    last = 0.0
    for _, i, a, w in rows:
        last = max(a, last) + w
        assert math.isclose(got[i], last, rel_tol=1e-9)


def test_refractory_depends_on_what_was_accepted(spark):
    df = spark.createDataFrame([(0, float(t)) for t in (0, 2, 3, 5, 6, 9)], "g int, t double")
    assert [r.t for r in O.refractory(df, ["g"], "t", 3.0).orderBy("t").collect()] == [0, 3, 6, 9]


def test_violations_name_every_broken_rule(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int")
    found = sorted((r.key, r.rule) for r in T.violations(df, F.col("k"), {"positive": F.col("v") > 0}, ["k"]).collect())
    assert found == [("a", "repeated key"), ("b", "positive")]


def test_array_measures_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=64), rng.normal(size=64)
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    r = df.select(A.snr_db(F.col("x"), F.col("y")).alias("snr"), A.si_sdr_db(F.col("x"), F.transform("x", lambda a: a * 3)).alias("gain"), A.envelope_db(F.col("x"), 8).alias("env")).first()
    assert math.isclose(r["snr"], 10 * np.log10((x @ x + 1e-10) / (((x - y) ** 2).sum() + 1e-10)), rel_tol=1e-9)
    assert r["gain"] > 80  # a gain costs nothing
    assert np.allclose(r["env"], 10 * np.log10((x.reshape(-1, 8) ** 2).mean(axis=1) + 1e-10))


@pytest.mark.parametrize("cut", [1, 17, 60])
def test_recursive_filters_may_be_cut_anywhere(cut):
    rng = np.random.default_rng(1)
    p, r = rng.normal(size=80), rng.normal(size=80)
    whole, _ = G.adaptive_residual(p, r, 8, 0.3)
    a, state = G.adaptive_residual(p[:cut], r[:cut], 8, 0.3)
    b, _ = G.adaptive_residual(p[cut:], r[cut:], 8, 0.3, state)
    assert np.allclose(np.concatenate([a, b]), whole)


@pytest.mark.parametrize("n", [16, 100, 257])
def test_transforms_give_the_signal_back(n):
    x = np.random.default_rng(2).normal(size=n)
    for size, hop, (a, s) in ((16, 8, (G.root_hann(16),) * 2), (32, 8, G.asymmetric_windows(32, 8, 12))):
        assert np.allclose(G.synthesise(G.analyse(x, size, hop, a), n, size, hop, s), x, atol=1e-9)


def test_word_error_rate():
    assert G.word_error_rate("a b c".split(), "a x c d".split()) == 0.5
    assert math.isnan(G.word_error_rate(["a"], []))


def test_stationarity():
    rng = np.random.default_rng(3)
    steady = rng.normal(size=16000)
    assert G.stationarity(steady, 512) == "stationary"
    assert G.stationarity(steady * np.repeat([1, 0.001], 8000), 512) == "changing"


def test_streamed_synthesis_equals_the_whole():
    x, (a, s) = np.random.default_rng(5).normal(size=96), G.asymmetric_windows(32, 8, 12)
    z = G.analyse(x, 32, 8, a)
    stream = G.OverlapAdd(32, 8, s)
    out = np.concatenate([*[stream.push(row) for row in z], stream.flush()])
    assert np.allclose(out[24 : 24 + len(x)], G.synthesise(z, len(x), 32, 8, s)) and np.allclose(out[24 : 24 + len(x)], x, atol=1e-9)


def test_saturation_and_fields():
    assert math.isclose(G.distortion(1.0, G.knee_for(0.05)), 0.05, rel_tol=1e-3)
    rng = np.random.default_rng(6)
    near = G.diffuse_pair(rng.normal(size=4000), rng.normal(size=4000), 0.001, 16000.0)
    far = G.diffuse_pair(rng.normal(size=4000), rng.normal(size=4000), 1.0, 16000.0)
    assert np.corrcoef(near)[0, 1] > 0.95 and abs(np.corrcoef(far)[0, 1]) < 0.3
    assert G.frame_features(np.ones(64), np.ones(64), 16, 8).shape == (7, len(G.FEATURES))
    assert np.allclose(G.band_projection(np.full((3, 33), 0.4), 16000.0, 6), 0.4)


def test_identifiers(spark):
    r = one(spark, S.sound_id(F.lit("fs:x/freesound_12345")).alias("a"), S.sound_id(F.lit("none")).alias("b"), S.licence_allows(F.lit("http://creativecommons.org/licenses/by-nc/3.0/")).alias("c"), S.licence_allows(F.lit("http://creativecommons.org/publicdomain/zero/1.0/")).alias("d"))
    assert tuple(r) == ("12345", None, False, True)
    addresses = {"https://creativecommons.org/licenses/by/4.0/": True, "http://creativecommons.org/licenses/sampling+/1.0/": False, "http://creativecommons.org/licenses/by-nc-sa/3.0/": False, "http://creativecommons.org/licenses/BY/3.0/": True, "see file": False, None: False}
    df = spark.createDataFrame([(u, ok) for u, ok in addresses.items()], "u string, ok boolean").withColumn("found", S.licence_allows("u"))
    assert df.filter("found <> ok").count() == 0 and one(spark, S.licence_allows(F.lit("x/licenses/by-sa/4.0"), ("by", "by-sa")).alias("a")).a


def test_global_ranks_and_lanes(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(5)
    assert all(r.v == r.rank for r in T.ranked(df, ["v"]).collect())
    jobs = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 1.0), (4, 1.0)], "j int, cost double")
    assert [r.lane for r in T.least_loaded(jobs, ["j"], "cost", 2).orderBy("j").collect()] == [0, 1, 1, 1]


def test_replicates_draw_as_often_as_a_poisson_law_says():
    rng = np.random.default_rng(3)
    w = X.draws(rng.integers(0, 2**64, 3000, dtype=np.uint64), np.array(X.marks(200, 7), np.uint64))
    assert all(abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.003 for k in range(5)) and abs(w.mean() - 1) < 0.01
    # Draws of two rows, and of two replicates, are independent: sums vary as sums of independent draws do.
    assert 0.7 < w.sum(axis=1).var(ddof=1) / 3000 < 1.4 and 0.85 < w.sum(axis=0).var(ddof=1) / 200 < 1.15
    # Keys in a row, too, and keys that differ in one bit.
    close = X.draws(np.arange(3000, dtype=np.uint64), np.array(X.marks(200, 7), np.uint64))
    assert abs(np.corrcoef(close[:, :-1].ravel(), close[:, 1:].ravel())[0, 1]) < 0.01


@pytest.mark.parametrize("held", [0, 64 << 20])
def test_replicate_sums_are_what_each_draw_gives(spark, held, monkeypatch):
    """However many tasks there are and whatever they may hold, sums are those of the draws; null keys and groups count."""
    monkeypatch.setattr(X, "HELD_BYTES", held)
    rows = [(None if i % 5 == 0 else "ab"[i % 2], None if i == 7 else i, float(i % 7), 1) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, k int, s double, n int")
    own, expected = np.array(X.marks(300, 7), np.uint64), {}
    for g, k, x, n in rows:
        h = np.array([int(hashlib.sha1(("" if k is None else str(k)).encode()).hexdigest()[:16], 16)], np.uint64)
        expected[g] = expected.get(g, 0) + X.draws(h, own) * [[x, n]]
    for parts in (1, 5):
        found = X.replicate_sums(df.repartition(parts), ["g"], ["k"], ["s", "n"], 300, 7).collect()
        assert len(found) == 900 and all(tuple(expected[r.g][r.b]) == (r.s, r.n) for r in found)
    assert X.replicate_sums(df.limit(0), ["g"], ["k"], ["s"], 5, 7).collect() == []


def test_paired_intervals_leave_out_what_is_not_finite(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(i % 40, float(i % 5), 1.0 + i % 3) for i in range(400)] + [(1, nan, 50.0), (2, 9.0, None)], "c int, a double, b double")
    got = X.paired_ci(rows, [], "c", ["a", "b"], 500, 1).first()
    assert got.a == 2.0 and abs(got.b - sum(1.0 + i % 3 for i in range(400)) / 400) < 1e-12
    assert got.a_lo <= got.a <= got.a_hi and got.b_lo < got.b < got.b_hi
    empty = X.paired_ci(rows.limit(0), [], "c", ["a"], 10, 1).first()
    assert empty.a is None and empty.a_lo is None


def test_validated_joins_fail_within_their_job(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, w string")
    assert {tuple(r) for r in T.many_to_one(left, right, ["k"]).collect()} == {(1, "a", "x"), (1, "b", "x"), (2, "c", None), (None, "d", None)}
    twice = right.union(spark.createDataFrame([(3, "again")], "k int, w string"))
    with pytest.raises(Exception, match="repeated key: 3"):  # though no row asks for it
        T.many_to_one(left, twice, ["k"]).select("v", "w").collect()
    with pytest.raises(Exception, match="repeated key: 1"):
        T.one_to_one(left, right, ["k"]).collect()
    assert [tuple(r) for r in T.one_to_one(left.filter("k = 2"), right.withColumn("k", F.col("k") - 1), ["k"]).collect()] == [(2, "c", "y")]
    plan = T.many_to_one(left.repartition(3), twice.repartition(3), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
