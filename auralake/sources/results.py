"""Reading and writing evaluation results, manifests and run records."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from auralake.functions import scalars as S
from auralake.operators import catalog as C
from auralake.operators import tables as T

#: Columns of an evaluation result, in their order. Ids are texts: they may begin with zeros.
TEXT = ("system", "id", "bucket", "noise_class", "fault", "asr_text", "category", "speech_source", "noise_source", "impulse_source")
NUMBERS = ("snr_in", "snr_out", "si_sdr", "stoi", "pesq_wb", "dnsmos_sig", "dnsmos_bak", "dnsmos_ovrl", "recovery_s", "impulse_peak_db")
FLAGS = ("clipped", "ref_dropout")


class Refused(ValueError):
    """An input that the engine does not take: the message says why, ``rows`` which."""

    def __init__(self, why: str, rows: DataFrame | None = None):
        super().__init__(why)
        self.rows = rows


def assert_none(rows: DataFrame, why: str) -> None:
    """Refuses when there are rows; only one is read to find out."""
    if not rows.isEmpty():
        raise Refused(f"{why}: {rows.first()}", rows)


#: Quotes are doubled inside quoted values, which may hold line ends.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files at the paths by the columns that their first lines name, in each file's own order; files without a line are left out.

    Only names of files come to the driver, which lists them in any case.
    """
    # A file's first lines are read by one task, in order, so the first has the least number. Numbers are summed up by hash;
    # texts would be sorted. Both uses of the table read it by the same tasks.
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    least = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("at"))
    firsts = lines.join(F.broadcast(least), ["file", "at"]).groupBy("value").agg(F.collect_list("file").alias("files"))
    return {tuple(next(csv.reader([r["value"].lstrip("\ufeff")]))): sorted(r["files"]) for r in firsts.collect()}


def read_csv(spark: SparkSession, columns: tuple[str, ...], files: list[str]) -> DataFrame:
    """Files of one header as texts; ``torn`` where a line has too few or too many values, ``at`` orders a file's rows."""
    schema = StructType([StructField(c, StringType()) for c in (*columns, "__torn")])
    rows = spark.read.options(**CSV, columnPruning=False).option("columnNameOfCorruptRecord", "__torn").schema(schema).csv(files)
    # Spark tells a torn line only where a line's other values are read, too.
    torn = F.col("__torn").isNotNull() & (F.length(F.concat_ws("", *columns)) >= 0)
    return rows.select(*columns, torn.alias("torn"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All results at the paths, which may be patterns: typed, cleaned, one row a (system, bucket, id).

    Files with ``.partial`` in their name are snapshots of others and left out. Each file's values go by its own header,
    whatever the order of its columns. Every value is read as text, so nothing is inferred; columns that a file lacks are
    null. Repeated keys are refused, and so are torn rows, and having no file.
    """
    if not paths:
        raise Refused("no results given")
    df = None
    for columns, files in headers(spark, paths).items():
        final = [f for f in files if ".partial" not in f.rpartition("/")[2]]
        if final:
            rows = read_csv(spark, columns, final)
            df = rows if df is None else df.unionByName(rows, allowMissingColumns=True)
    if df is None or df.isEmpty():
        raise Refused("no final results at the paths")
    assert_none(df.filter("torn"), "torn rows")
    df = C.conform(df, {c: F.lit(None).cast("string") for c in (*TEXT, *NUMBERS, *FLAGS)})
    df = df.select(
        *[S.blank_to_null(c).alias(c) if c not in ("system",) else S.system_name(c).alias(c) for c in TEXT],
        *[S.number(c).alias(c) for c in NUMBERS], *[S.truthy(c).alias(c) for c in FLAGS],
    )
    assert_none(T.repeated(df, ["system", "bucket", "id"]), "repeated (system, bucket, id)")
    return df


RESULT_SCHEMA = StructType([*[StructField(c, StringType()) for c in TEXT], *[StructField(c, DoubleType()) for c in NUMBERS], *[StructField(c, BooleanType()) for c in FLAGS]])


def write_results(df: DataFrame, path: str, columns: list[str]) -> None:
    """Results as CSV with the columns in the given order; others are left out."""
    df.select(*columns).write.options(**{k: v for k, v in CSV.items() if k != "multiLine"}).mode("append").csv(path)


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the files at a path whose last line has no end: their writer was stopped within it."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.octet_length("value").alias("n"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return lines.groupBy("file", "size").agg(F.sum(F.col("n") + 1).alias("n")).filter("n > size").select("file")


def resume(work: DataFrame, spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Work that has no whole row at ``path`` yet: a row with too few values is none, nor is a last one whose line has no end.

    Results written by other columns are refused. Values may hold separators, quotes and line ends.
    """
    found = headers(spark, [path])
    if wrong := [c for c in found if list(c) != columns]:
        raise Refused(f"other columns: {wrong[0]}")
    if not found:
        return work
    rows = read_csv(spark, tuple(columns), found[tuple(columns)])
    last = F.col("at") == F.max("at").over(Window.partitionBy("file"))
    done = rows.withColumn("last", last).join(torn_files(spark, path).withColumn("cut", F.lit(True)), "file", "left")
    done = done.filter(~F.col("torn") & ~(F.col("last") & F.coalesce("cut", F.lit(False))))
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str, keys: list[str], priority: str) -> DataFrame:
    """Rows of JSON lines, one a key: the one with the least priority."""
    return C.keep_first(spark.read.schema(schema).json(path), keys, [priority])


def write_manifest(df: DataFrame, path: str) -> None:
    """A manifest in its columns, one row a known content, by corpus and split."""
    rows = C.keep_first(C.read_manifest(df), ["sha1"], ["source_id"], blank_is_unique=True)
    rows.select(*C.MANIFEST_COLUMNS).write.partitionBy("corpus", "split").parquet(path)


def read_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    df = spark.read.parquet(paths[0])
    for path in paths[1:]:
        df = df.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return C.read_manifest(df)


def is_manifest(df: DataFrame) -> bool:
    """Whether a table's columns make it a manifest; only its schema is read."""
    return {"corpus", "kind", "licence", "duration_s"} <= set(df.columns)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row an epoch of every run record at the path."""
    runs = spark.read.option("multiLine", True).json(path)
    return runs.select(F.col("_metadata.file_path").alias("run"), F.posexplode("history").alias("place", "h")).select("run", "place", "h.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files at a path; each is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def flattened_registry(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """(name, access, dest, scanner, licence, files) of a data set registry given as a mapping."""
    rows = [(n, v.get("access"), v.get("dest"), v.get("scanner"), v.get("licence"), [str(f) for f in v.get("files", [])]) for n, v in registry.items()]
    return spark.createDataFrame(rows, "name string, access string, dest string, scanner string, licence string, files array<string>")


def registry_violations(registry: DataFrame, access: list[str]) -> DataFrame:
    """What is wrong with a registry, a row a broken rule."""
    rules = {
        "access": F.col("access").isin(access), "destination": S.blank_to_null("dest").isNotNull(), "licence": S.blank_to_null("licence").isNotNull(),
        "files": F.size("files") > 0, "relative path": ~F.coalesce(F.col("dest"), F.lit("")).startswith("/"),
    }
    return T.violations(registry, F.col("name"), rules, unique=["name"])


def condition_summary(df: DataFrame, declared: list[str]) -> DataFrame:
    """Per condition, in declared order: clips, means, a percentile and failures."""
    order = Window.orderBy(*T.ordered_by_list("condition", declared))
    rows = df.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.scored("snr_out")).alias("snr_out"), F.avg(S.scored("stoi")).alias("stoi"),
        F.percentile(S.scored("speech_loss"), F.lit(0.95)).alias("speech_loss_p95"), F.sum((F.col("fail") != 0).cast("long")).alias("fails"),
    )
    return rows.withColumn("place", F.row_number().over(order))


#: Conditions under which recordings are made. Fixed values.
CONDITIONS = ("engine", "engine+burst", "env_change", "ref_fault", "quiet")


def recording_violations(table: DataFrame) -> DataFrame:
    """(key, rule) of what is wrong in a list of field recordings (id, speaker, language, condition, transcript, has_clean)."""
    rules = {
        "id": S.blank_to_null("id").isNotNull(), "speaker": S.blank_to_null("speaker").isNotNull(), "condition": F.col("condition").isin(*CONDITIONS),
        "has_clean": F.lower(F.trim(F.col("has_clean").cast("string"))).isin("0", "1", "true", "false", "yes", "no"),
    }
    return T.violations(table, F.coalesce(F.col("id"), F.lit("")), rules, unique=["id"])


def verdict(rows: DataFrame, by: list[str], ok: str) -> DataFrame:
    """Per group: FAIL if any criterion is missed, TBD if any is open, otherwise PASS."""
    missed = F.coalesce(F.some(~F.col(ok)), F.lit(False))
    opened = F.count(F.when(F.col(ok).isNull(), 1)) > 0
    return rows.groupBy(*by).agg(F.when(missed, "FAIL").when(opened, "TBD").otherwise("PASS").alias("verdict"))


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one JSON file a task; the commit replaces what was there as a whole."""
    df.write.mode("overwrite").json(path)
