"""Results and recordings written to files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.plans.base import FACT, Tables, query
from auralake.plans.ordered_queries import HOPS, hops
from auralake.plans.stats_queries import r9
from auralake.session import shared_path
from auralake.sources import recordings, results

SAID = "'\"' || bucket || '\", ' || noise_class || chr(10) || 'a, b'"


def said() -> F.Column:
    """A text that needs quotes: it has some, a separator and a line end."""
    return F.concat(F.lit('"'), "bucket", F.lit('", '), "noise_class", F.lit("\na, b"))


@query("WITH " + FACT + f" SELECT system, bucket, id::VARCHAR AS id, snr_out, CASE WHEN id % 2 = 0 THEN stoi END AS stoi, {SAID} AS asr_text, clipped FROM fact")
def result_files(t: Tables) -> DataFrame:
    """Results in files of two headers, the columns in different orders, one lacking, read by one pattern."""
    rows, folder = t.fact.withColumn("asr_text", said()), shared_path(t.spark, "results")
    results.write_results(rows.filter("id % 2 = 0"), f"{folder}/a", ["system", "bucket", "id", "snr_out", "stoi", "asr_text", "clipped"])
    results.write_results(rows.filter("id % 2 = 1"), f"{folder}/b", ["clipped", "asr_text", "id", "snr_out", "bucket", "system"])
    return results.read_results(t.spark, [f"{folder}/*/*.csv"]).select("system", "bucket", "id", "snr_out", "stoi", "asr_text", "clipped")


@query("WITH " + FACT + " SELECT system, bucket, id::VARCHAR AS id FROM fact WHERE id % 3 > 0")
def result_resume(t: Tables) -> DataFrame:
    """Work that has no row yet in results whose texts hold separators, quotes and line ends."""
    rows, path = t.fact.withColumn("asr_text", said()).withColumn("id", F.col("id").cast("string")), shared_path(t.spark, "results")
    columns = ["asr_text", "system", "bucket", "id"]
    results.write_results(rows.filter("id % 3 = 0"), path, columns)
    return results.resume(rows.select("system", "bucket", "id"), t.spark, path, ["system", "bucket", "id"], columns)


@query("WITH " + HOPS + """, x AS (SELECT user_id, idx, least(round(value / 128 * 32768), 32767) / 32768 AS mix, least(round(value / 256 * 32768), 32767) / 32768 AS clean FROM hops)
SELECT 'u' || user_id AS item, idx // 16 * 16 AS start, count(*) AS frames, round(sum(mix), 6) AS mix, round(sum(clean), 6) AS clean FROM x WHERE idx >= 16 AND idx < 64 GROUP BY ALL""")
def recording_ranges(t: Tables) -> DataFrame:
    """A mixture and its clean signal a user, written in chunks, then some frames of both, read by their bytes and paired by name."""
    chunks = hops(t).groupBy("user_id", (F.floor(F.col("idx") / 24) * 24).alias("start")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    signal = lambda scale: F.array(F.transform("rows", lambda r: r["value"] / scale))
    both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), signal(scale).alias("samples")) for kind, scale in (("mix", 128.0), ("clean", 256.0))])).alias("s")
    path = shared_path(t.spark, "recordings")
    recordings.write_recordings(chunks.select(F.concat(F.lit("u"), "user_id").alias("item"), F.lit(16_000).alias("rate"), "start", both).select("item", "rate", "start", "s.*"), path)
    read = recordings.read_recordings(t.spark, path, frames=(16, 64), chunk_frames=16, partition_bytes=1 << 20)
    total = lambda kind: r9(F.aggregate(F.col(kind)[0], F.lit(0.0), lambda s, x: s + x)).alias(kind)
    return recordings.paired(read).select("item", "start", F.size(F.col("mix")[0]).cast("long").alias("frames"), total("mix"), total("clean"))
