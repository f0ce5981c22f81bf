"""Evaluation statistics: pass rates, intervals, AUC, gates, envelopes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import ordered as O
from auralake.operators import stats as X
from auralake.operators import tables as T
from auralake.plans.base import FACT, NOMINAL, PASSES, Tables, query

W = "WITH " + FACT
METRICS = ["snr_out", "stoi", "pesq_wb"]
U = "(('0x' || substr(sha1({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
H = "('0x' || substr(sha1({0}), 1, 8))::BIGINT"


def r9(c) -> F.Column:
    return F.round(c, 6)


def weighed_sql(rows: str, key: str, replicates: int, seed: int) -> str:
    """CTEs ``weighed``: the rows of the CTE ``rows`` with each replicate ``b`` and its Poisson weight ``w``, drawn by ``key``."""
    number = "('0x' || substr(sha1({0}), 1, 16))::UBIGINT"
    w = " + ".join(f"(z >= {t}::UBIGINT)::INT" for t in X.poisson_thresholds())
    mixed = "xor(mark, h)"
    for shift, factor in zip((30, 27), X.MIX):
        mixed = f"(xor({mixed}, {mixed} >> {shift})::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""reps_k AS (SELECT b, {number.format(f"'{seed}|' || b")} AS mark FROM range({replicates}) r(b)),
hashed AS (SELECT *, {number.format(key)} AS h FROM {rows}),
mixed AS (SELECT hashed.* EXCLUDE (h), b, {mixed} AS y FROM hashed, reps_k),
weighed AS (SELECT * EXCLUDE (y, z), {w} AS w FROM (SELECT *, xor(y, y >> 31) AS z FROM mixed))"""


def weighted_sql(source: str, replicates: int, seed: int, key: str = "g || '|' || cluster") -> str:
    """CTEs ``sums``, ``reps`` (g, b, mean): clusters of ``source`` (g, cluster, x) weighed by Poisson draws."""
    return f"""sums AS (SELECT g, cluster, sum(x) AS s, count(*)::DOUBLE AS n FROM ({source}) GROUP BY ALL),
{weighed_sql("sums", key, replicates, seed)},
reps AS (SELECT g, b, sum(w * s) / nullif(sum(w * n), 0) AS mean FROM weighed GROUP BY g, b)"""


@query(W + f"SELECT system, count(*) AS n, round(avg(snr_out), 6) AS snr_out, round(avg(stoi), 6) AS stoi, round(avg(pesq_wb), 6) AS pesq_wb, round(avg({PASSES}::INT), 6) AS pass_rate FROM fact WHERE {NOMINAL} GROUP BY system")
def nominal_report(t: Tables) -> DataFrame:
    """Per system the means and the pass rate over the nominal envelope."""
    rows = t.fact.filter(X.nominal()).groupBy("system").agg(F.count(F.lit(1)).alias("n"), *[r9(F.avg(m)).alias(m) for m in METRICS], r9(X.pass_rate()).alias("pass_rate"))
    return rows.orderBy("system")


@query(W + f"SELECT system, bucket, id, {NOMINAL} AS nominal, {PASSES} AS passes FROM fact")
def nominal_mask(t: Tables) -> DataFrame:
    return t.fact.select("system", "bucket", "id", X.nominal().alias("nominal"), X.passes().alias("passes"))


@query(W + f"SELECT system, bucket, count(*) AS n, round(avg({PASSES}::INT), 6) AS pass_rate FROM fact GROUP BY ALL")
def pass_rate(t: Tables) -> DataFrame:
    return t.fact.groupBy("system", "bucket").agg(F.count(F.lit(1)).alias("n"), r9(X.pass_rate()).alias("pass_rate"))


MASKS = {
    "nominal": NOMINAL, "severe": f"(fault IS NULL AND NOT clipped AND NOT ref_dropout AND noise_class = 'stationary' AND snr_in <= 0)", "transient": "(fault LIKE 'fault%')",
    "clean": "(noise_class = 'changing' AND fault IS NULL)",
}


@query(W + "SELECT envelope, system, count(*) AS n, round(avg(snr_out), 6) AS snr_out FROM (SELECT *, unnest(list_filter([" + ", ".join(f"CASE WHEN {m} THEN '{k}' END" for k, m in MASKS.items()) + "], lambda x: x IS NOT NULL)) AS envelope FROM fact) GROUP BY ALL")
def headline_subsets(t: Tables) -> DataFrame:
    """Overlapping envelopes: a row counts in each that it satisfies."""
    rows = T.labelled(t.fact, {k: F.expr(m) for k, m in MASKS.items()}, "envelope")
    return rows.groupBy("envelope", "system").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("snr_out")).alias("snr_out"))


@query(W + "SELECT system, noise_class, snr_in, count(*) AS n, round(avg(snr_out), 6) AS snr_out, round(avg(stoi), 6) AS stoi FROM fact GROUP BY system, noise_class, snr_in")
def class_snr_grid(t: Tables) -> DataFrame:
    return t.fact.groupBy("system", "noise_class", "snr_in").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("snr_out")).alias("snr_out"), r9(F.avg("stoi")).alias("stoi"))


@query(W + "SELECT system, coalesce(fault, 'none') AS fault, snr_in, count(*) AS n, round(avg(pesq_wb), 6) AS pesq_wb FROM fact GROUP BY ALL")
def fault_snr_grid(t: Tables) -> DataFrame:
    return t.fact.groupBy("system", F.coalesce("fault", F.lit("none")).alias("fault"), "snr_in").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("pesq_wb")).alias("pesq_wb"))


@query(W + "SELECT system, bucket, grouping(bucket)::INT AS overall, count(*) AS n, round(avg(snr_out), 6) AS snr_out FROM fact GROUP BY GROUPING SETS ((system, bucket), (system))")
def overall_rollup(t: Tables) -> DataFrame:
    """Per bucket rows and the row over all buckets, in one pass."""
    rows = t.fact.rollup("system", "bucket").agg(F.grouping("bucket").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"), r9(F.avg("snr_out")).alias("snr_out"), F.grouping("system").alias("__all"))
    return rows.filter("__all = 0").drop("__all")


@query("""WITH v AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE WHEN event_id % 19 = 0 THEN 'inf'::DOUBLE WHEN event_id % 23 = 0 THEN NULL ELSE value END AS x FROM events)
SELECT user_id, round(avg(CASE WHEN isfinite(x) THEN x END), 6) AS mean, count(CASE WHEN isfinite(x) THEN 1 END) AS n, count(*) AS rows FROM v GROUP BY user_id""")
def finite_means(t: Tables) -> DataFrame:
    """Means over what was scored, beside how many rows were."""
    id = F.col("event_id")
    x = F.when(id % 17 == 0, float("nan")).when(id % 19 == 0, float("inf")).when(id % 23 == 0, None).otherwise(F.col("value"))
    return t.events.select("user_id", x.alias("x")).groupBy("user_id").agg(r9(X.finite_mean("x")).alias("mean"), X.finite_count("x").alias("n"), F.count(F.lit(1)).alias("rows"))


@query(W + "SELECT system, round(quantile_cont(snr_out, 0.1), 6) AS p10, round(quantile_cont(snr_out, 0.5), 6) AS p50, round(quantile_cont(snr_out, 0.95), 6) AS p95, round(max(snr_out), 6) AS most FROM fact GROUP BY system")
def quantile_summary(t: Tables) -> DataFrame:
    q = X.quantiles("snr_out", 0.1, 0.5, 0.95)
    return t.fact.groupBy("system").agg(q.alias("q"), r9(F.max("snr_out")).alias("most")).select("system", *[r9(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p95"))], "most")


@query(W + "SELECT system, count(*) AS n, round(quantile_cont(recovery_s, 0.5), 6) AS p50, count(CASE WHEN recovery_s = 'inf'::DOUBLE THEN 1 END) AS never FROM fact WHERE recovery_s IS NOT NULL GROUP BY system")
def recovery_stats(t: Tables) -> DataFrame:
    rows = t.fact.filter("recovery_s is not null").groupBy("system")
    return rows.agg(F.count(F.lit(1)).alias("n"), r9(X.quantiles("recovery_s", 0.5)[0]).alias("p50"), F.count(F.when(F.col("recovery_s") == S.INF, 1)).alias("never"))


@query(W + """SELECT id, round(b.snr_out - a.snr_out, 6) AS d_snr_out, round(b.stoi - a.stoi, 6) AS d_stoi FROM (SELECT * FROM fact WHERE system = 'A') a JOIN (SELECT * FROM fact WHERE system = 'R') b USING (bucket, id)""")
def paired_delta(t: Tables) -> DataFrame:
    rows = T.paired(t.fact.filter("system = 'A'"), t.fact.filter("system = 'R'"), ["bucket", "id"], ["snr_out", "stoi"])
    return rows.select("id", r9(F.col("d_snr_out")).alias("d_snr_out"), r9(F.col("d_stoi")).alias("d_stoi"))


@query(W + """SELECT system, round(avg(d), 6) AS d, count(*) AS n FROM (SELECT f.system, f.snr_out - p.snr_out AS d FROM fact f JOIN fact p ON p.bucket = f.bucket AND p.id = f.id AND p.system = 'N' WHERE f.system <> 'N') GROUP BY system""")
def paired_vs_present(t: Tables) -> DataFrame:
    """Each condition against the present one of the same clip."""
    base = t.fact.filter("system = 'N'").select("bucket", "id", F.col("snr_out").alias("base"))
    rows = t.fact.filter("system <> 'N'").join(base, ["bucket", "id"])
    return rows.groupBy("system").agg(r9(F.avg(F.col("snr_out") - F.col("base"))).alias("d"), F.count(F.lit(1)).alias("n"))


@query(W + """, d AS (SELECT a.bucket, b.snr_out - a.snr_out AS s, b.stoi - a.stoi AS q FROM (SELECT * FROM fact WHERE system = 'A') a JOIN (SELECT * FROM fact WHERE system = 'R') b USING (bucket, id))
SELECT bucket, round(avg(s), 6) AS d_snr, round(avg(q), 6) AS d_stoi, round(avg(q), 9) >= -0.01 - 1e-9 AS ok FROM d GROUP BY bucket""")
def bucket_gate(t: Tables) -> DataFrame:
    """Mean change per bucket against an inclusive bound."""
    rows = T.paired(t.fact.filter("system = 'A'"), t.fact.filter("system = 'R'"), ["bucket", "id"], ["snr_out", "stoi"])
    return rows.groupBy("bucket").agg(r9(F.avg("d_snr_out")).alias("d_snr"), r9(F.avg("d_stoi")).alias("d_stoi"), (F.round(F.avg("d_stoi"), 9) >= -0.01 - 1e-9).alias("ok"))


@query("WITH " + FACT + ", " + weighted_sql(f"SELECT system AS g, bucket || '|' || id AS cluster, snr_out AS x FROM fact WHERE {NOMINAL}", 1000, 3) + """
SELECT g AS system, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM reps GROUP BY g""")
def row_bootstrap(t: Tables) -> DataFrame:
    """The interval of a mean when rows are resampled: every row is its own cluster."""
    rows = t.fact.filter(X.nominal()).withColumn("cluster", F.concat_ws("|", "bucket", "id"))
    ci = X.interval(X.resample_poisson(X.cluster_sums(rows, ["system"], "cluster", "snr_out"), ["system"], "cluster", 1000, 3), ["system"])
    return ci.select("system", r9(F.col("lo")).alias("lo"), r9(F.col("hi")).alias("hi"))


@query("WITH " + FACT + ", " + weighted_sql(f"SELECT system AS g, cluster, snr_out AS x FROM fact WHERE {NOMINAL}", 1000, 0) + """
SELECT s.g AS system, round(s.mean, 6) AS mean, round(quantile_cont(r.mean, 0.025), 6) AS lo, round(quantile_cont(r.mean, 0.975), 6) AS hi, s.n, s.clusters
FROM (SELECT g, sum(s) / sum(n) AS mean, sum(n)::BIGINT AS n, count(*) AS clusters FROM sums GROUP BY g) s JOIN reps r USING (g) GROUP BY s.g, s.mean, s.n, s.clusters""")
def cluster_bootstrap(t: Tables) -> DataFrame:
    """The interval of a mean when whole clusters are resampled."""
    ci = X.cluster_ci(t.fact.filter(X.nominal()), ["system"], "cluster", "snr_out", replicates=1000)
    return ci.select("system", *[r9(F.col(c)).alias(c) for c in ("mean", "lo", "hi")], "n", "clusters")


@query("WITH " + FACT + ", " + weighted_sql("SELECT a.bucket AS g, a.cluster, b.snr_out - a.snr_out AS x FROM (SELECT * FROM fact WHERE system = 'A') a JOIN (SELECT * FROM fact WHERE system = 'R') b USING (bucket, id)", 2000, 5) + """
SELECT g AS bucket, round(var_samp(mean), 8) AS variance FROM reps GROUP BY g""")
def cluster_variance(t: Tables) -> DataFrame:
    """The variance of a mean of paired differences when whole clusters are resampled."""
    rows = T.paired(t.fact.filter("system = 'A'"), t.fact.filter("system = 'R'"), ["bucket", "id"], ["snr_out"], keep=["cluster"])
    reps = X.resample_poisson(X.cluster_sums(rows, ["bucket"], "cluster", "d_snr_out"), ["bucket"], "cluster", 2000, 5)
    return X.interval(reps, ["bucket"]).select("bucket", F.round("var", 8).alias("variance"))


@query("WITH " + FACT + ", " + weighted_sql(f"SELECT system AS g, cluster, pesq_wb AS x FROM fact WHERE {NOMINAL}", 1000, 9) + """
SELECT round(avg(a.mean - b.mean), 6) AS gap, round(quantile_cont(a.mean - b.mean, 0.025), 6) AS lo, round(quantile_cont(a.mean - b.mean, 0.975), 6) AS hi FROM (SELECT * FROM reps WHERE g = 'A') a JOIN (SELECT * FROM reps WHERE g = 'N') b USING (b)""")
def gap_bootstrap(t: Tables) -> DataFrame:
    """The interval of a difference of two means that are resampled each on its own."""
    rows = t.fact.filter(X.nominal() & F.col("system").isin("A", "N"))
    reps = X.resample_poisson(X.cluster_sums(rows, ["system"], "cluster", "pesq_wb"), ["system"], "cluster", 1000, 9)
    both = reps.filter("system = 'A'").select("b", F.col("mean").alias("a")).join(reps.filter("system = 'N'").select("b", F.col("mean").alias("n")), "b")
    q = F.percentile(F.col("a") - F.col("n"), F.array(F.lit(0.025), F.lit(0.975)))
    return both.agg(r9(F.avg(F.col("a") - F.col("n"))).alias("gap"), q.alias("q")).select("gap", r9(F.col("q")[0]).alias("lo"), r9(F.col("q")[1]).alias("hi"))


@query("WITH " + FACT + ", " + weighted_sql("SELECT metric AS g, cluster, x FROM (SELECT cluster, unnest(['snr_out', 'stoi', 'pesq_wb']) AS metric, unnest([snr_out, stoi, pesq_wb]) AS x FROM fact WHERE system = 'A')", 1000, 2, "cluster::VARCHAR") + """
SELECT g AS metric, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM reps GROUP BY g""")
def shared_resample(t: Tables) -> DataFrame:
    """All metrics under the same draws, so that their intervals are paired."""
    long = t.fact.filter("system = 'A'").select("cluster", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("m")).select("cluster", "m.*")
    ci = X.interval(X.resample_poisson(X.cluster_sums(long, ["metric"], "cluster", "x"), ["metric"], "cluster", 1000, 2, shared=True), ["metric"])
    return ci.select("metric", r9(F.col("lo")).alias("lo"), r9(F.col("hi")).alias("hi"))


@query("WITH " + FACT + ", " + weighted_sql(f"SELECT system AS g, cluster, snr_out AS x FROM fact WHERE {NOMINAL}", 2000, 1) + """
SELECT g AS system, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, round(stddev_samp(mean), 8) AS sd FROM reps GROUP BY g""")
def poisson_bootstrap(t: Tables) -> DataFrame:
    """The interval and the spread by Poisson weights: no numbering and no join, for very many clusters."""
    sums = X.cluster_sums(t.fact.filter(X.nominal()), ["system"], "cluster", "snr_out")
    ci = X.interval(X.resample_poisson(sums, ["system"], "cluster", 2000, 1), ["system"])
    return ci.select("system", r9(F.col("lo")).alias("lo"), r9(F.col("hi")).alias("hi"), F.round("sd", 8).alias("sd"))


#: Replicates, seed and one-sided share of the gate's intervals of paired differences.
GATE = (10_000, 4606, 0.025)
PAIRS = "SELECT a.bucket, a.id, b.snr_out - a.snr_out AS d_snr_out, b.stoi - a.stoi AS d_stoi, b.pesq_wb - a.pesq_wb AS d_pesq_wb FROM (SELECT * FROM fact WHERE system = 'A') a JOIN (SELECT * FROM fact WHERE system = 'R') b USING (bucket, id) WHERE " + re.sub(r"\b(clipped|ref_dropout|fault|snr_in)\b", r"a.\1", NOMINAL)
DELTAS = [f"d_{m}" for m in METRICS]
GATE_SQL = f"""sums AS (SELECT id, {", ".join(f"sum({d}) AS {d}" for d in DELTAS)}, count(*)::DOUBLE AS n FROM ({PAIRS}) GROUP BY id),
{weighed_sql("sums", "id::VARCHAR", GATE[0], GATE[1])},
reps AS (SELECT b, {", ".join(f"sum(w * {d}) / nullif(sum(w * n), 0) AS {d}" for d in DELTAS)} FROM weighed GROUP BY b),
ends AS (SELECT {", ".join(f"quantile_cont({d}, {q}) AS {d}_{end}" for d in DELTAS for end, q in (("lo", GATE[2]), ("hi", 1 - GATE[2])))} FROM reps),
means AS (SELECT {", ".join(f"sum({d}) / sum(n) AS {d}" for d in DELTAS)} FROM sums)"""


@query(W + ", " + GATE_SQL + " SELECT " + ", ".join(f"round({d}{end}, 6) AS {d}{end}" for d in DELTAS for end in ("", "_lo", "_hi")) + " FROM means, ends")
def paired_interval(t: Tables) -> DataFrame:
    """The gate's intervals of paired differences over the nominal envelope; all metrics share the draws of items."""
    rows = T.paired(t.fact.filter("system = 'A'"), t.fact.filter("system = 'R'"), ["bucket", "id"], METRICS, keep=["clipped", "ref_dropout", "fault", "snr_in"]).filter(X.nominal())
    ci = X.paired_ci(rows, [], "id", DELTAS, *GATE)
    return ci.select(*[r9(F.col(d + end)).alias(d + end) for d in DELTAS for end in ("", "_lo", "_hi")])


@query(W + """, c AS (SELECT system, snr_out, sum((fault IS NOT NULL)::INT) AS p, sum((fault IS NULL)::INT) AS q FROM fact GROUP BY ALL),
w AS (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY system ORDER BY snr_out ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS wins FROM c)
SELECT system, round(sum(wins) / (sum(p) * sum(q)), 6) AS auc, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg FROM w GROUP BY system""")
def rank_auc(t: Tables) -> DataFrame:
    return X.rank_auc(t.fact, ["system"], "snr_out", F.col("fault").isNotNull()).withColumn("auc", r9(F.col("auc")))


def bins(t: Tables) -> DataFrame:
    rows = t.fact.withColumn("is_s", F.col("fault").isNotNull())
    counted = X.histogram(rows, ["system", "noise_class", "is_s"], F.col("snr_out"), 0.0, 50.0, 25)
    return counted.groupBy("system", "noise_class", "bin").agg(F.sum(F.when(F.col("is_s"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("is_s"), 0).otherwise(F.col("n"))).alias("n"))


BINS = W + """, bins AS (SELECT system, noise_class, floor(greatest(0, least(50.0::DOUBLE - 1e-6, snr_out)) / 2)::BIGINT AS bin, sum((fault IS NOT NULL)::INT)::BIGINT AS s, sum((fault IS NULL)::INT)::BIGINT AS n FROM fact GROUP BY ALL)"""


@query(BINS + " SELECT * FROM bins")
def clipped_histogram(t: Tables) -> DataFrame:
    return bins(t)


@query(BINS + """, b AS (SELECT system, bin, sum(s) AS s, sum(n) AS n FROM bins GROUP BY ALL), w AS (SELECT *, s * (coalesce(sum(n) OVER (PARTITION BY system ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n * 0.5::DOUBLE) AS w FROM b)
SELECT system, round(sum(w) / (sum(s) * sum(n)), 6) AS auc FROM w GROUP BY system""")
def hist_auc(t: Tables) -> DataFrame:
    pooled = bins(t).groupBy("system", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return X.hist_auc(pooled, ["system"]).withColumn("auc", r9(F.col("auc")))


@query(BINS + """, tot AS (SELECT bin, sum(s) AS s, sum(n) AS n FROM bins GROUP BY bin), grp AS (SELECT noise_class, bin, sum(s) AS s, sum(n) AS n FROM bins GROUP BY ALL),
loo AS (SELECT c.noise_class, t.bin, t.s - coalesce(g.s, 0) AS s, t.n - coalesce(g.n, 0) AS n FROM tot t CROSS JOIN (SELECT DISTINCT noise_class FROM grp) c LEFT JOIN grp g ON g.bin = t.bin AND g.noise_class = c.noise_class),
halves AS (SELECT 'within' AS part, * FROM grp UNION ALL SELECT 'without', * FROM loo),
w AS (SELECT *, s * (coalesce(sum(n) OVER (PARTITION BY part, noise_class ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n * 0.5::DOUBLE) AS w FROM halves)
SELECT noise_class, part, round(sum(w) / (sum(s) * sum(n)), 6) AS auc FROM w GROUP BY ALL""")
def auc_breakdown(t: Tables) -> DataFrame:
    """Each group's own AUC, and the pooled one with the group left out."""
    own = bins(t).groupBy("noise_class", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = own.groupBy("bin").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    # As many rows as groups times bins, both fixed by the histogram.
    grid = own.select("noise_class").distinct().crossJoin(total)
    rest = grid.join(own, ["noise_class", "bin"], "left").select("noise_class", "bin", (F.col("ts") - F.coalesce("s", F.lit(0))).alias("s"), (F.col("tn") - F.coalesce("n", F.lit(0))).alias("n"))
    both = own.withColumn("part", F.lit("within")).unionByName(rest.withColumn("part", F.lit("without")))
    return X.hist_auc(both, ["noise_class", "part"]).withColumn("auc", r9(F.col("auc")))


@query("WITH " + FACT + """, items AS (SELECT id, floor(greatest(0, least(50.0::DOUBLE - 1e-6, snr_out)) / 2)::BIGINT AS bin, sum((fault IS NOT NULL)::INT) AS s, sum((fault IS NULL)::INT) AS n FROM fact WHERE system = 'A' GROUP BY ALL),
""" + weighed_sql("items", "id::VARCHAR", 1000, 4) + """,
h AS (SELECT b, bin, sum(w * s) AS s, sum(w * n) AS n FROM weighed GROUP BY ALL),
c AS (SELECT *, s * (coalesce(sum(n) OVER (PARTITION BY b ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n * 0.5::DOUBLE) AS x FROM h),
a AS (SELECT b, sum(x) / (sum(s) * sum(n) + 1e-30) AS auc FROM c GROUP BY b)
SELECT round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS sd, round(avg((round(auc, 9) <= 0.5)::INT), 6) AS share FROM a""")
def multinomial_auc(t: Tables) -> DataFrame:
    """The AUC of resampled items from their own histograms: bins stay with their item.

    Items weigh by Poisson draws, which are multinomial given their number; an area doesn't depend on that number.
    """
    bin, is_s = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(50 - 1e-6), "snr_out")) / 2).cast("long"), F.col("fault").isNotNull()
    items = t.fact.filter("system = 'A'").groupBy("id", bin.alias("bin")).agg(F.sum(is_s.cast("int")).alias("s"), F.sum((~is_s).cast("int")).alias("n"))
    auc = X.hist_auc(X.replicate_sums(items, ["bin"], ["id"], ["s", "n"], 1000, 4), ["b"])
    return auc.agg(r9(F.avg("auc")).alias("mean"), r9(F.stddev_samp("auc")).alias("sd"), r9(F.avg((F.round("auc", 9) <= 0.5).cast("int"))).alias("share"))


@query(W + """, d AS (SELECT a.noise_class, a.snr_in AS seed, avg(b.snr_out - a.snr_out) AS d FROM (SELECT * FROM fact WHERE system = 'A') a JOIN (SELECT * FROM fact WHERE system = 'R') b USING (bucket, id) GROUP BY ALL),
g AS (SELECT noise_class, count(*) AS seeds, avg(d) AS mean, greatest(stddev_samp(d), 0.05) AS s FROM d GROUP BY 1),
h AS (SELECT *, (CASE seeds WHEN 2 THEN 12.706205 WHEN 3 THEN 4.302653 WHEN 4 THEN 3.182446 WHEN 5 THEN 2.776445 WHEN 6 THEN 2.570582 END)::DOUBLE * sqrt(s * s / seeds + 0.01) AS half FROM g)
SELECT noise_class, seeds, round(mean, 6) AS mean, round(mean - half, 6) AS lo, round(mean + half, 6) AS hi,
  CASE WHEN mean - half > 0 THEN 'superior' WHEN mean - half >= -2 THEN 'non_inferior' WHEN mean + half < -2 THEN 'inferior' ELSE 'inconclusive' END AS decision FROM h""")
def interval_decide(t: Tables) -> DataFrame:
    """A t interval over seeds and what it decides."""
    rows = T.paired(t.fact.filter("system = 'A'"), t.fact.filter("system = 'R'"), ["bucket", "id"], ["snr_out"], keep=["noise_class", "snr_in"])
    seeds = rows.groupBy("noise_class", "snr_in").agg(F.avg("d_snr_out").alias("d")).withColumn("v", F.lit(0.01))
    out = X.seeded_interval(seeds, ["noise_class"], "d", 0.05, "v").withColumn("decision", X.decide("lo", "hi", 2.0))
    return out.select("noise_class", "seeds", *[r9(F.col(c)).alias(c) for c in ("mean", "lo", "hi")], "decision")


@query(W + f""", p AS (SELECT a.bucket, {NOMINAL.replace('clipped', 'a.clipped').replace('ref_dropout', 'a.ref_dropout').replace('fault', 'a.fault').replace('snr_in', 'a.snr_in')} AS nom, b.snr_out - a.snr_out AS ds, b.stoi - a.stoi AS dq, b.pesq_wb - a.pesq_wb AS dp, a.recovery_s AS ra, b.recovery_s AS rc
  FROM (SELECT * FROM fact WHERE system = 'A') a JOIN (SELECT * FROM fact WHERE system = 'R') b USING (bucket, id)),
bk AS (SELECT bool_and(s >= -0.01 - 1e-9 AND q >= -0.05 - 1e-9) AS ok FROM (SELECT bucket, avg(dq) AS s, avg(dp) AS q FROM p GROUP BY 1)),
g AS (SELECT avg(CASE WHEN nom THEN ds END) >= 0.3 - 1e-9 AS utility, avg(CASE WHEN nom THEN dq END) >= -0.003 - 1e-9 AS intelligibility, coalesce(avg(CASE WHEN NOT nom THEN ds END) >= -0.2 - 1e-9, true) AS severe,
  count(CASE WHEN rc = 'inf'::DOUBLE THEN 1 END) <= count(CASE WHEN ra = 'inf'::DOUBLE THEN 1 END) AND coalesce(quantile_cont(CASE WHEN isfinite(ra) AND isfinite(rc) THEN rc - ra END, 0.5), 0) <= 0.016 + 1e-9 AS recovery, count(*) AS pairs FROM p),
""" + GATE_SQL + """, u AS (SELECT d_snr_out_lo > 0 AND d_pesq_wb_lo > 0 AS uncertainty, d_stoi_lo > -0.005 AS held FROM ends)
SELECT pairs, utility, intelligibility AND held AS intelligibility, severe, recovery, ok AS per_bucket, uncertainty, utility AND intelligibility AND held AND severe AND recovery AND ok AND uncertainty AS pass FROM g, bk, u""")
def kill_gate(t: Tables) -> DataFrame:
    """A candidate against its anchor: every gate and their conjunction."""
    keep = ["clipped", "ref_dropout", "fault", "snr_in"]
    p = T.paired(t.fact.filter("system = 'A'"), t.fact.filter("system = 'R'"), ["bucket", "id"], [*METRICS, "recovery_s"], keep=keep).withColumn("nom", X.nominal())
    buckets = p.groupBy("bucket").agg(F.avg("d_stoi").alias("s"), F.avg("d_pesq_wb").alias("q")).agg(F.every((F.col("s") >= -0.01 - 1e-9) & (F.col("q") >= -0.05 - 1e-9)).alias("per_bucket"))
    slower = F.when(S.finite("recovery_s_a") & S.finite("recovery_s_b"), F.col("d_recovery_s"))
    never = lambda c: F.count(F.when(F.col(c) == S.INF, 1))
    gates = p.agg(
        F.count(F.lit(1)).alias("pairs"), (F.avg(F.when(F.col("nom"), F.col("d_snr_out"))) >= 0.3 - 1e-9).alias("utility"), (F.avg(F.when(F.col("nom"), F.col("d_stoi"))) >= -0.003 - 1e-9).alias("intelligibility"),
        F.coalesce(F.avg(F.when(~F.col("nom"), F.col("d_snr_out"))) >= -0.2 - 1e-9, F.lit(True)).alias("severe"),
        ((never("recovery_s_b") <= never("recovery_s_a")) & (F.coalesce(F.percentile(slower, F.lit(0.5)), F.lit(0.0)) <= 0.016 + 1e-9)).alias("recovery"),
    )
    ends = X.paired_ci(p.filter("nom"), [], "id", DELTAS, *GATE)
    sure = ends.select(((F.col("d_snr_out_lo") > 0) & (F.col("d_pesq_wb_lo") > 0)).alias("uncertainty"), (F.col("d_stoi_lo") > -0.005).alias("held"))
    # Each side is one row.
    rows = gates.crossJoin(buckets).crossJoin(sure).withColumn("intelligibility", F.col("intelligibility") & F.col("held")).drop("held")
    return rows.withColumn("pass", F.col("utility") & F.col("intelligibility") & F.col("severe") & F.col("recovery") & F.col("per_bucket") & F.col("uncertainty"))


@query(W + f""", m AS (SELECT system, noise_class, snr_in, round(avg(snr_out), 9) AS snr_out, round(avg(stoi), 9) AS stoi, round(avg(pesq_wb), 9) AS pesq_wb FROM fact WHERE fault IS NULL GROUP BY system, noise_class, snr_in),
h AS (SELECT *, bool_and({PASSES}) OVER (PARTITION BY system, noise_class ORDER BY snr_in DESC) AS held FROM m)
SELECT system, noise_class, CASE WHEN min(CASE WHEN held THEN snr_in END) IS NULL THEN 'none' ELSE '>= ' || round(min(CASE WHEN held THEN snr_in END))::INT || ' dB' END AS envelope FROM h GROUP BY ALL""")
def envelope(t: Tables) -> DataFrame:
    return X.envelope(t.fact.filter("fault is null"), ["system", "noise_class"], "snr_in")


@query(W + """, r AS (SELECT bucket, system, round(avg(snr_out), 6) AS gain, count(*) AS cost FROM fact GROUP BY ALL)
SELECT bucket, system, cost, gain, NOT EXISTS (SELECT 1 FROM r b WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain)) AS pareto FROM r a""")
def pareto(t: Tables) -> DataFrame:
    """Rows that no other beats on cost and gain."""
    rows = t.fact.groupBy("bucket", "system").agg(r9(F.avg("snr_out")).alias("gain"), F.count(F.lit(1)).alias("cost"))
    return T.pareto(rows, "cost", "gain").select("bucket", "system", "cost", "gain", "pareto")


@query(W + """, c AS (SELECT system, bucket, round(avg(snr_out), 9) AS mean FROM fact GROUP BY ALL)
SELECT system, bucket, round(mean, 6) AS mean, CASE WHEN mean <= 25.5 THEN 'miss' WHEN mean - 0.1 > 25.5 THEN 'met' ELSE 'mean' END AS mark FROM c""")
def target_marks(t: Tables) -> DataFrame:
    cells = t.fact.groupBy("system", "bucket").agg(F.round(F.avg("snr_out"), 9).alias("mean"))
    return cells.select("system", "bucket", r9(F.col("mean")).alias("mean"), S.target_mark("mean", F.col("mean") - 0.1, 25.5).alias("mark"))


@query(W + """, b AS (SELECT noise_class, system, avg(loss) AS loss FROM (SELECT noise_class, system, bucket, avg(1 - stoi) AS loss FROM fact GROUP BY ALL) GROUP BY ALL)
SELECT system, round(max(loss), 6) AS worst, round(avg(loss), 6) AS mean_loss, max(round(loss, 9)) <= 0.11 AS passes FROM b GROUP BY system""")
def composite_summary(t: Tables) -> DataFrame:
    """Two-level means and a hard bound on the worst."""
    inner = t.fact.groupBy("noise_class", "system", "bucket").agg(F.avg(1 - F.col("stoi")).alias("loss")).groupBy("noise_class", "system").agg(F.avg("loss").alias("loss"))
    return inner.groupBy("system").agg(r9(F.max("loss")).alias("worst"), r9(F.avg("loss")).alias("mean_loss"), (F.max(F.round("loss", 9)) <= 0.11).alias("passes"))


@query(W + """, v AS (SELECT system, bucket, CASE WHEN count(*) < 400 THEN NULL ELSE round(avg(snr_out), 9) > 25.4 END AS ok FROM fact WHERE noise_class = 'changing' GROUP BY ALL)
SELECT system, CASE WHEN bool_or(ok = false) THEN 'FAIL' WHEN count(CASE WHEN ok IS NULL THEN 1 END) > 0 THEN 'TBD' ELSE 'PASS' END AS verdict FROM v GROUP BY system""")
def field_verdict(t: Tables) -> DataFrame:
    """Three values: a miss fails, an open point is to be done, otherwise it passes."""
    v = t.fact.filter("noise_class = 'changing'").groupBy("system", "bucket").agg(F.when(F.count(F.lit(1)) >= 400, F.round(F.avg("snr_out"), 9) > 25.4).alias("ok"))
    return v.groupBy("system").agg(F.when(F.coalesce(F.some(~F.col("ok")), F.lit(False)), "FAIL").when(F.count(F.when(F.col("ok").isNull(), 1)) > 0, "TBD").otherwise("PASS").alias("verdict"))


@query(W + "SELECT system, bucket, count(*) AS rows, count(*) = 730 AS complete, count(DISTINCT cluster) AS clusters, count(DISTINCT id) AS items FROM fact GROUP BY ALL")
def completeness(t: Tables) -> DataFrame:
    return t.fact.groupBy("system", "bucket").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) == 730).alias("complete"), F.countDistinct("cluster").alias("clusters"), F.countDistinct("id").alias("items"))


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, count(CASE WHEN value > 100 THEN 1 END) AS misses, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY user_id""")
def telemetry(t: Tables) -> DataFrame:
    """Exact counts, mean, maximum, misses and a quantile per stream."""
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("value")).alias("mean"), F.max("value").alias("most"), F.count(F.when(F.col("value") > 100, 1)).alias("misses"), r9(X.quantiles("value", 0.99)[0]).alias("p99"))


@query(W + """SELECT bucket, round(corr(snr_out, pesq_wb), 6) AS r, round(sum((fault IS NOT NULL AND snr_out > 25)::INT) / sum((fault IS NOT NULL)::INT), 6) AS tpr, round(sum((fault IS NULL AND snr_out > 25)::INT) / sum((fault IS NULL)::INT), 6) AS fpr FROM fact GROUP BY bucket""")
def correlation_rates(t: Tables) -> DataFrame:
    hit, pos = F.col("snr_out") > 25, F.col("fault").isNotNull()
    share = lambda of: F.sum((of & hit).cast("int")) / F.sum(of.cast("int"))
    return t.fact.groupBy("bucket").agg(r9(F.corr("snr_out", "pesq_wb")).alias("r"), r9(share(pos)).alias("tpr"), r9(share(~pos)).alias("fpr"))


@query(W + """SELECT noise_class, round(sum(snr_out * stoi) / sum(stoi), 6) AS weighted, round(avg((snr_out > 25)::INT), 6) AS share, round(quantile_cont(snr_out, 0.9), 6) AS q90 FROM fact GROUP BY noise_class""")
def trace_summary(t: Tables) -> DataFrame:
    """Weighted means, shares and quantiles of a trace."""
    return t.fact.groupBy("noise_class").agg(r9(F.sum(F.col("snr_out") * F.col("stoi")) / F.sum("stoi")).alias("weighted"), r9(F.avg((F.col("snr_out") > 25).cast("int"))).alias("share"), r9(X.quantiles("snr_out", 0.9)[0]).alias("q90"))


#: Scenes that overlap: all items, those of a class, those with a fault and those at low SNR.
SCENES = """scenes AS (SELECT *, unnest(list_filter(['all', noise_class, CASE WHEN fault IS NOT NULL THEN 'fault' END, CASE WHEN snr_in < 0 THEN 'low' END], lambda x: x IS NOT NULL)) AS scene FROM fact),
cells AS (SELECT scene, id, snr_out, unnest(['snr_out', 'stoi', 'pesq_wb', 'recovery_s']) AS metric, unnest([snr_out, stoi, pesq_wb, recovery_s]) AS x FROM scenes)"""


def scene_cells(t: Tables) -> DataFrame:
    """A row for each metric of each item in each of its scenes."""
    scene = F.explode(F.array_compact(F.array(F.lit("all"), "noise_class", F.when(F.col("fault").isNotNull(), "fault"), F.when(F.col("snr_in") < 0, "low")))).alias("scene")
    cell = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in (*METRICS, "recovery_s")])).alias("cell")
    return t.fact.select("*", scene).select("scene", "id", "snr_out", cell).select("scene", "id", "snr_out", "cell.*")


@query(W + ", " + SCENES + """ SELECT scene, metric, count(x) AS n, round(quantile_cont(x, 0.1), 6) AS q10, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.9), 6) AS q90
FROM cells WHERE x IS NOT NULL AND isfinite(x) GROUP BY scene, metric""")
def scene_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles of each metric over overlapping scenes, the one of all items no window of its own."""
    found = X.exact_quantiles(scene_cells(t).filter(S.finite("x")), ["scene", "metric"], "x", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return found.select("scene", "metric", "n", *[r9(F.col(q)).alias(q) for q in ("q10", "q50", "q90")])


@query(W + ", " + SCENES + """, r AS (SELECT scene, metric, x, id % 5 AS w, sum(id % 5) OVER (PARTITION BY scene, metric ORDER BY x) AS upto, sum(id % 5) OVER (PARTITION BY scene, metric) AS total FROM cells WHERE x IS NOT NULL AND isfinite(x))
SELECT scene, metric, max(total)::BIGINT AS weight, round(min(CASE WHEN w > 0 AND upto >= 0.5::DOUBLE * total THEN x END), 6) AS median, round(min(CASE WHEN w > 0 AND upto >= 0.9::DOUBLE * total THEN x END), 6) AS q90 FROM r WHERE total > 0 GROUP BY scene, metric""")
def scene_weighted_quantiles(t: Tables) -> DataFrame:
    """Weighted quantiles over overlapping scenes."""
    rows = scene_cells(t).filter(S.finite("x")).withColumn("w", F.col("id") % 5)
    found = X.weighted_quantiles(rows, ["scene", "metric"], "x", "w", {"median": 0.5, "q90": 0.9})
    return found.select("scene", "metric", "weight", r9(F.col("median")).alias("median"), r9(F.col("q90")).alias("q90"))


@query(W + """, p AS (SELECT noise_class, CASE WHEN 25 * stoi >= snr_out AND 25 * stoi >= 10 * pesq_wb THEN 'stoi' WHEN snr_out >= 10 * pesq_wb THEN 'snr_out' ELSE 'pesq_wb' END AS part, snr_out AS w FROM fact)
SELECT noise_class, part, count(*) AS n, round(sum(w) / sum(sum(w)) OVER (PARTITION BY noise_class), 6) AS share FROM p GROUP BY noise_class, part""")
def dominance_shares(t: Tables) -> DataFrame:
    """Of each scene's weight, the share of items by the largest of their parts."""
    parts = F.array(F.struct((25 * F.col("stoi")).alias("v"), F.lit(3).alias("o"), F.lit("stoi").alias("p")), F.struct(F.col("snr_out").alias("v"), F.lit(2).alias("o"), F.lit("snr_out").alias("p")), F.struct((10 * F.col("pesq_wb")).alias("v"), F.lit(1).alias("o"), F.lit("pesq_wb").alias("p")))
    sums = t.fact.groupBy("noise_class", F.array_max(parts)["p"].alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("snr_out").alias("w"))
    return sums.withColumn("share", r9(F.col("w") / F.sum("w").over(Window.partitionBy("noise_class")))).drop("w")


@query(W + """, e AS (SELECT cluster AS run, row_number() OVER (PARTITION BY cluster ORDER BY system, bucket, id) AS epoch, stoi, snr_out > 20 AS ok FROM fact)
SELECT run, arg_max(epoch, stoi * 1000000 - epoch)::BIGINT AS epoch, round(max(stoi), 6) AS stoi FROM e WHERE ok GROUP BY run""")
def best_checkpoint(t: Tables) -> DataFrame:
    """The best epoch of each run among those that pass a filter, the earliest on ties."""
    from pyspark.sql import Window

    e = t.fact.select(F.col("cluster").alias("run"), F.row_number().over(Window.partitionBy("cluster").orderBy("system", "bucket", "id")).cast("long").alias("epoch"), "stoi", (F.col("snr_out") > 20).alias("ok"))
    return e.filter("ok").groupBy("run").agg(F.max_by("epoch", F.struct(F.col("stoi"), -F.col("epoch"))).alias("epoch"), r9(F.max("stoi")).alias("stoi"))


@query(W + """, e AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY system, bucket, id) AS epoch, stoi FROM fact), b AS (SELECT *, max(stoi) OVER (PARTITION BY cluster ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
SELECT cluster, count(*) AS epochs, (max(epoch) - max(CASE WHEN best IS NULL OR stoi > best THEN epoch END))::BIGINT AS stale FROM b GROUP BY cluster""")
def patience(t: Tables) -> DataFrame:
    """Epochs in a row without an improvement at the end of each run."""
    from pyspark.sql import Window

    e = t.fact.select("cluster", F.row_number().over(Window.partitionBy("cluster").orderBy("system", "bucket", "id")).alias("epoch"), "stoi")
    return O.stale_after(e, ["cluster"], "epoch", "stoi", 0.0).select("cluster", F.col("epochs").cast("long").alias("epochs"), F.col("stale").cast("long").alias("stale"))
