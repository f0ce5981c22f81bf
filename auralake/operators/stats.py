"""Statistics of evaluation tables: finite means, pass rates, resampled intervals, AUC, decisions."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.session import shared_dir

TARGETS = {"snr_out": 15.0, "stoi": 0.85, "pesq_wb": 2.5}


def nominal(snr: Column | str = "snr_in") -> Column:
    """Unclipped, no reference dropout, no fault, and an input SNR of 0, 5 or 10 dB."""
    return ~F.col("clipped") & ~F.col("ref_dropout") & F.col("fault").isNull() & S.col(snr).isin(0.0, 5.0, 10.0)


def passes(targets: dict[str, float] = TARGETS) -> Column:
    """Whether every metric is strictly above its target; one not scored fails."""
    out = None
    for metric, least in targets.items():
        ok = F.coalesce(S.scored(metric) > least, F.lit(False))
        out = ok if out is None else out & ok
    return out


def pass_rate(targets: dict[str, float] = TARGETS) -> Column:
    return F.avg(passes(targets).cast("double"))


def finite_mean(x: Column | str) -> Column:
    """Mean of the finite values; null where there are none."""
    return F.avg(F.when(S.finite(x), S.col(x)))


def finite_count(x: Column | str) -> Column:
    return F.count(F.when(S.finite(x), F.lit(1)))


def quantiles(x: Column | str, *at: float) -> Column:
    """Quantiles by linear interpolation, as an array; infinite values count."""
    return F.percentile(S.col(x), F.array(*map(F.lit, at)))


# Resampling. A cluster's rows are summed once; replicates weigh those sums and never see rows.


def cluster_sums(df: DataFrame, by: list[str], cluster: str, value: str) -> DataFrame:
    return df.filter(S.finite(value)).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))


#: Multipliers of the mix that turns a hash and a replicate's mark into a number. Fixed values.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Replicates and rows whose draws are made at once, and bytes of sums that a task holds before it hands them on.
DRAWN_AT_ONCE, HELD_BYTES = (256, 4_096), 64 << 20


def poisson_thresholds() -> list[int]:
    """Where, of numbers below 2^64, a Poisson draw of mean one takes its next value."""
    steps, p, total = [], math.exp(-1.0), 0.0
    while (total := total + p) < 1.0:
        steps.append(int(total * 2**64))
        p /= len(steps)
    return steps


def marks(replicates: int, seed: int) -> list[int]:
    """Each replicate's own number of 64 bits."""
    return [int(hashlib.sha1(f"{seed}|{b}".encode()).hexdigest()[:16], 16) for b in range(replicates)]


def draws(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How often each replicate (rows, by its mark) draws each key (columns, by its hash): Poisson numbers of mean one."""
    z = own[:, None] ^ hashes[None, :]
    z ^= z >> np.uint64(30)
    z *= np.uint64(MIX[0])
    z ^= z >> np.uint64(27)
    z *= np.uint64(MIX[1])
    z ^= z >> np.uint64(31)
    return np.searchsorted(np.array(poisson_thresholds(), np.uint64), z.ravel(), side="right").reshape(z.shape)


def replicate_sums(df: DataFrame, by: list[str], key: list[Column | str], columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, b, columns): each replicate's sums of the columns, in which it draws each row a Poisson number of times, mean one.

    A draw is a mix of a 64-bit hash of the row's key with the replicate's mark: the same wherever it is made, and rows of
    one key are drawn together. A task adds up a matrix of replicates and columns for each group as rows pass; matrices are
    cut into blocks of replicates, which are added where they meet. So no row is ever made for a row and replicate, and a
    task holds sums only: they are handed on when they fill ``HELD_BYTES``, however many groups there are.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws("|", *[S.col(k).cast("string") for k in key])
    hashed = df.select(*by, F.conv(F.substring(F.sha1(text), 1, 16), 16, -10).cast("long").alias("__h"), *[F.col(c).cast("double").alias(c) for c in columns])
    own, step, width = np.array(marks(replicates, seed), np.uint64), DRAWN_AT_ONCE[0], len(columns)
    types = dict(df.dtypes)
    keys = "".join(f"{c} {types[c]}, " for c in by)

    def handed(sums: dict[tuple, np.ndarray], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for group, matrix in sums.items():
            parts = [matrix[at : at + step].ravel() for at in range(0, replicates, step)]
            group_columns = [pa.array([v] * len(parts), kind) for v, kind in zip(group, kinds)]
            yield pa.record_batch([*group_columns, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=[*by, "block", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = {}, []
        for batch in batches:
            kinds = [batch.column(c).type for c in by]
            for at in range(0, batch.num_rows, DRAWN_AT_ONCE[1]):
                rows = batch.slice(at, DRAWN_AT_ONCE[1])
                places = collections.defaultdict(list)
                for i, group in enumerate(zip(*[rows.column(c).to_pylist() for c in by]) if by else [()] * rows.num_rows):
                    places[group].append(i)
                values = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
                hashes = rows.column("__h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for group in places:
                    if group not in sums:
                        sums[group] = np.zeros((replicates, width))
                for first in range(0, replicates, step):
                    w = draws(hashes, own[first : first + step]).astype(np.float64)
                    for group, found in places.items():
                        sums[group][first : first + step] += w[:, found] @ values[found]
                if len(sums) * replicates * width * 8 > HELD_BYTES:
                    yield from handed(sums, kinds)
                    sums = {}
        yield from handed(sums, kinds)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = {}, []
        for batch in batches:
            kinds = [batch.column(c).type for c in by]
            for *group, part in zip(*[batch.column(c).to_pylist() for c in [*by, "block"]], batch.column("sums")):
                matrix = part.values.to_numpy(zero_copy_only=False).reshape(-1, width)
                known = sums.get(tuple(group))
                sums[tuple(group)] = matrix.copy() if known is None else known + matrix
        for (*group, block), matrix in sums.items():
            group_columns = [pa.array([v] * len(matrix), kind) for v, kind in zip(group, kinds)]
            numbers = pa.array(np.arange(len(matrix), dtype=np.int32) + block * step)
            yield pa.record_batch([*group_columns, numbers, *(pa.array(matrix[:, i]) for i in range(width))], names=[*by, "b", *columns])

    # Sums are small and would be read by few tasks, but each row is drawn as often as there are replicates.
    matrices = hashed.repartition(tasks, "__h").mapInArrow(summed, f"{keys}block int, sums array<double>")
    return matrices.repartition(tasks, *by, "block").mapInArrow(added, f"{keys}b int, " + ", ".join(f"{c} double" for c in columns))


def resample_poisson(sums: DataFrame, by: list[str], cluster: str, replicates: int, seed: int, means: dict[str, str] | None = None, shared: bool = False) -> DataFrame:
    """(by, b, mean): the mean of each replicate, in which a cluster is drawn a Poisson number of times, mean one.

    ``means`` names several sums, which share their draws; ``shared`` gives a cluster the same draws in all groups. A
    replicate that draws nothing has a null mean.
    """
    means = means or {"mean": "s"}
    drawn = replicate_sums(sums, by, [cluster] if shared else [*by, cluster], [*dict.fromkeys(means.values()), "n"], replicates, seed)
    return drawn.select(*by, "b", *[F.try_divide(F.col(s), F.col("n")).alias(name) for name, s in means.items()])


def interval(replicates: DataFrame, by: list[str], alpha: float = 0.025) -> DataFrame:
    """(by, lo, hi, sd, var): percentiles of the replicates' means, and their spread with one degree of freedom less."""
    q = F.percentile("mean", F.array(F.lit(alpha), F.lit(1 - alpha)))
    return replicates.groupBy(*by).agg(q[0].alias("lo"), q[1].alias("hi"), F.stddev_samp("mean").alias("sd"), F.var_samp("mean").alias("var"))


def cluster_ci(df: DataFrame, by: list[str], cluster: str, value: str, replicates: int = 1000, seed: int = 0, alpha: float = 0.025) -> DataFrame:
    """(by, mean, lo, hi, n, clusters): the mean of the finite values and its interval over resampled clusters."""
    sums = cluster_sums(df, by, cluster, value)
    means = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).alias("clusters"))
    return means.join(interval(resample_poisson(sums, by, cluster, replicates, seed), by, alpha), by)


def paired_ci(pairs: DataFrame, by: list[str], cluster: str, deltas: list[str], replicates: int = 10_000, seed: int = 0, alpha: float = 0.025) -> DataFrame:
    """(by, and per delta its mean, ``_lo`` and ``_hi``): means of paired differences, all under the same draws of clusters.

    A row with a delta that isn't finite is left out of all of them.
    """
    whole = pairs.filter(functools.reduce(Column.__and__, map(S.finite, deltas)))
    # Names of its own: a delta may be called as a replicate or a count is.
    own = {d: f"__d{i}" for i, d in enumerate(deltas)}
    sums = whole.groupBy(*by, cluster).agg(*[F.sum(d).alias(o) for d, o in own.items()], F.count(F.lit(1)).cast("double").alias("n"))
    reps = resample_poisson(sums, by, cluster, replicates, seed, {o: o for o in own.values()})
    ends = reps.groupBy(*by).agg(*[F.percentile(o, F.array(F.lit(alpha), F.lit(1 - alpha))).alias(o) for o in own.values()])
    ends = ends.select(*by, *[F.col(o)[i].alias(f"{d}_{end}") for d, o in own.items() for i, end in enumerate(("lo", "hi"))])
    means = sums.groupBy(*by).agg(*[(F.sum(o) / F.sum("n")).alias(d) for d, o in own.items()])
    # Without groups both sides are one row.
    return means.join(ends, by) if by else means.crossJoin(ends)


# Quantiles of groups of any size.


def running_weights(df: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """(by, value, w, before, total) of each distinct value: its weight, that of smaller values, and its group's.

    Rows are summed by value, dealt by ranges of (by, value) and added up within their range; a window sees one row a range
    of a group. So a group of any size is spread. Ranges are checkpointed, that all sums are of the same.
    """
    shared_dir(df.sparkSession)
    sums = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.sum(weight).alias("w")).filter("w > 0")
    dealt = sums.repartitionByRange(*by, value).withColumn("__range", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy("__range", *by).agg(F.sum("w").alias("__part"))
    group = Window.partitionBy(*by).orderBy("__range")
    earlier = F.coalesce(F.sum("__part").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    parts = parts.select("__range", *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], earlier, F.sum("__part").over(Window.partitionBy(*by)).alias("total"))
    own = Window.partitionBy("__range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("__own", F.coalesce(F.sum("w").over(own), F.lit(0)))
    same = functools.reduce(Column.__and__, [rows[c].eqNullSafe(parts[f"__by{i}"]) for i, c in enumerate(by)], rows["__range"] == parts["__range"])
    return rows.join(parts, same).select(*by, value, "w", (F.col("__own") + F.col("__before")).alias("before"), "total")


def exact_quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, n, and one column for each of ``at``): quantiles by linear interpolation; nulls and NaN are left out.

    Infinite values count. For groups that are many or overlap, and for groups that hold most of the rows.
    """
    rows, out = running_weights(df, by, value, F.lit(1)), []
    for name, q in at.items():
        place = q * (F.col("total") - 1)
        # The values at the places around it: each row stands at places from ``before`` on, as often as it occurs.
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("w"))
        low, high = (F.max(F.when(holds(k), F.col(value))) for k in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return rows.groupBy(*by).agg(F.max("total").alias("n"), *out)


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, at: dict[str, float]) -> DataFrame:
    """(by, weight, and one column for each of ``at``): the least value at which the weight reaches that share of the group's.

    Rows without a positive weight are left out.
    """
    rows = running_weights(df, by, value, F.greatest(F.col(weight), F.lit(0)))
    reached = lambda q: F.min(F.when(F.col("before") + F.col("w") >= q * F.col("total"), F.col(value)))
    return rows.groupBy(*by).agg(F.max("total").alias("weight"), *[reached(q).alias(name) for name, q in at.items()])


# Areas under the curve.


def rank_auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """(by, auc, n_pos, n_neg): the share of pairs whose positive scores higher, ties counting half.

    Scores are counted before they are ordered, so the window sees one row a distinct score.
    """
    counts = df.groupBy(*by, score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2)
    return counts.withColumn("wins", wins).groupBy(*by).agg(
        (F.sum("wins") / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg")
    )


def histogram(df: DataFrame, by: list[str], value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n): counts of bins of equal width; values beyond the ends fall into the last bin there."""
    width = (hi - lo) / bins
    bin = F.floor((F.greatest(F.lit(lo), F.least(F.lit(hi - 1e-6), value)) - lo) / width).cast("long")
    return df.filter(value.isNotNull()).groupBy(*by, bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hist_auc(bins: DataFrame, by: list[str], s: str = "s", n: str = "n") -> DataFrame:
    """(by, auc) of binned counts: a bin of ``s`` beats every lower bin of ``n`` and ties, by half, with its own."""
    below = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col(s) * (F.coalesce(F.sum(n).over(below), F.lit(0)) + F.col(n) * 0.5)
    return bins.withColumn("__w", wins).groupBy(*by).agg((F.sum("__w") / (F.sum(s) * F.sum(n) + F.lit(1e-30))).alias("auc"))


# Decisions.

#: Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, and the normal one beyond. Fixed values.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z_975 = 1.959964


def t_quantile(df: Column | str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, T_975)), (S.col(df) - 1).cast("int")), F.lit(Z_975))


def seeded_interval(rows: DataFrame, by: list[str], difference: str, floor: float, clip_variance: str) -> DataFrame:
    """(by, seeds, mean, lo, hi): a t interval over seeds' differences, their spread not below ``floor``, plus the clips'."""
    each = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("seeds"), F.avg(difference).alias("mean"), F.greatest(F.stddev_samp(difference), F.lit(floor)).alias("spread"), F.max(clip_variance).alias("v"))
    half = t_quantile(F.col("seeds") - 1) * F.sqrt(F.col("spread") * F.col("spread") / F.col("seeds") + F.coalesce(S.scored("v"), F.lit(0.0)))
    return each.select(*by, "seeds", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def decide(lo: Column | str, hi: Column | str, margin: Column | float, higher_better: Column | bool = True) -> Column:
    """superior, non_inferior, inferior or inconclusive; a metric that is better lower is mirrored first."""
    up = higher_better if isinstance(higher_better, Column) else F.lit(higher_better)
    margin = margin if isinstance(margin, Column) else F.lit(margin)
    low, high = F.when(up, S.col(lo)).otherwise(-S.col(hi)), F.when(up, S.col(hi)).otherwise(-S.col(lo))
    return F.when(low > 0, "superior").when(low >= -margin, "non_inferior").when(high < -margin, "inferior").otherwise("inconclusive")


def envelope(df: DataFrame, by: list[str], snr: str, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(by, envelope): the lowest input SNR from which all mean metrics meet their targets at every higher one there is."""
    means = df.groupBy(*by, snr).agg(*[F.round(F.avg(S.scored(m)), 9).alias(m) for m in targets])
    down = Window.partitionBy(*by).orderBy(F.desc(snr)).rowsBetween(Window.unboundedPreceding, 0)
    held = means.withColumn("ok", passes(targets)).withColumn("held", F.every("ok").over(down))
    low = F.min(F.when(F.col("held"), F.col(snr)))
    return held.groupBy(*by).agg(low.alias("low")).select(*by, F.when(F.col("low").isNull(), "none").when(F.abs("low") == S.INF, "met").otherwise(F.format_string(">= %.0f dB", "low")).alias("envelope"))
