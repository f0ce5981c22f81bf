"""How queries are registered, and the tables they read.

The driver's tables stand in for the engine's own: an order's lines per return flag are an evaluated item of a system,
documents are a corpus manifest, events are hop streams, embeddings are signals. `FACT` and `MANIFEST` say in SQL what
:func:`fact` and :func:`manifest` say in DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.functions import scalars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one directory, and the engine's views of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def fact(self) -> DataFrame:
        return fact(self.orders, self.lineitem)

    @property
    def manifest(self) -> DataFrame:
        return manifest(self.documents)

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        """A few constant rows, as a dimension: broadcast, as a join on it must not deal a table's rows by its few keys."""
        return F.broadcast(self.spark.createDataFrame(list(rows), schema))


def query(sql: str | None = None):
    """Registers a function of :class:`Tables` as a query, under its own name, with the SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


#: Lines that a task sums.
TASK_LINES = 500_000


def fact(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per (system, bucket, id): an order's lines of one return flag. Means are rounded, as sums have no order.

    An order has few lines, so sums in the tasks that scan them would hold nearly as many groups as lines. Lines are dealt
    by order instead, as the join needs them, to tasks whose number follows from the table's rows.
    """
    tasks = max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // TASK_LINES))
    dealt = lineitem.select("l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax").repartition(tasks, "l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_returnflag").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    id = F.col("o_orderkey")
    fault = F.when(F.col("o_orderstatus") == "P", F.lit("fault_p"))
    return rows.select(
        F.col("l_returnflag").alias("system"), F.col("o_orderpriority").alias("bucket"), id.alias("id"), F.col("o_custkey").alias("cluster"),
        ((id % 6 - 2) * F.lit(5.0)).alias("snr_in"), F.element_at(F.array(*map(F.lit, ("stationary", "changing", "impulsive"))), (id % 3 + 1).cast("int")).alias("noise_class"),
        (id % 11 == 0).alias("clipped"), (id % 13 == 0).alias("ref_dropout"), fault.alias("fault"),
        F.round("l_quantity", 9).alias("snr_out"), F.round(1 - 2 * F.col("l_discount"), 9).alias("stoi"), F.round(1 + 40 * F.col("l_tax"), 9).alias("pesq_wb"),
        F.when(fault.isNotNull(), F.when(id % 7 == 0, F.lit(float("inf"))).otherwise(F.round(F.col("l_quantity") / 10, 9))).alias("recovery_s"),
    )


FACT = """
lines AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY ALL),
fact AS (SELECT l_returnflag AS system, o_orderpriority AS bucket, o_orderkey AS id, o_custkey AS cluster, (o_orderkey % 6 - 2) * 5.0::DOUBLE AS snr_in,
  (['stationary', 'changing', 'impulsive'])[o_orderkey % 3 + 1] AS noise_class, o_orderkey % 11 = 0 AS clipped, o_orderkey % 13 = 0 AS ref_dropout,
  CASE WHEN o_orderstatus = 'P' THEN 'fault_p' END AS fault, round(q, 9) AS snr_out, round(1 - 2 * d, 9) AS stoi, round(1 + 40 * t, 9) AS pesq_wb,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'inf'::DOUBLE ELSE round(q / 10, 9) END END AS recovery_s
  FROM lines JOIN orders ON l_orderkey = o_orderkey)
"""

#: The nominal envelope and the targets, as SQL over the fact's columns.
NOMINAL = "(NOT clipped AND NOT ref_dropout AND fault IS NULL AND snr_in IN (0, 5, 10))"
PASSES = "(coalesce(snr_out > 15, false) AND coalesce(stoi > 0.85, false) AND coalesce(pesq_wb > 2.5, false))"


def manifest(documents: DataFrame) -> DataFrame:
    """Documents as a corpus manifest."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_id"), F.col("source").alias("corpus"), F.when(F.col("lang") == "en", "speech").otherwise("noise").alias("kind"),
        F.concat_ws("-", "source", "lang", F.col("doc_id") % 50).alias("group_id"), F.concat(F.lit("spk"), F.col("doc_id") % 97).alias("speaker_id"),
        F.concat_ws("\\", F.lit("data"), "source", F.concat(F.col("doc_id"), F.lit(".flac"))).alias("path"), (F.col("n_chars") / 16000.0).alias("duration_s"),
        F.element_at(F.array(*map(F.lit, ("CC BY 4.0", "CC BY-NC 4.0", "CC0 1.0", "research only", "MIT", "see repo"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("licence"),
        S.split_of(F.concat_ws("-", "source", "lang", F.col("doc_id") % 50)).alias("split"), F.when(F.length(text) < 200, "").otherwise(F.sha1(text.cast("binary"))).alias("sha1"),
        F.element_at(F.array(*map(F.lit, ("stationary", "changing", "impulsive", ""))), (F.col("doc_id") % 4 + 1).cast("int")).alias("noise_class"), F.col("doc_id").alias("pos"),
    )


HASH8 = "('0x' || substr(sha1({0}), 1, 8))::BIGINT"
MANIFEST = """
m0 AS (SELECT *, source || '-' || lang || '-' || (doc_id % 50) AS g, coalesce(text, '') AS body FROM documents),
manifest AS (SELECT 'doc:' || doc_id AS source_id, source AS corpus, CASE WHEN lang = 'en' THEN 'speech' ELSE 'noise' END AS kind, g AS group_id,
  'spk' || (doc_id % 97) AS speaker_id, 'data\\' || source || '\\' || doc_id || '.flac' AS path, n_chars / 16000.0::DOUBLE AS duration_s,
  (['CC BY 4.0', 'CC BY-NC 4.0', 'CC0 1.0', 'research only', 'MIT', 'see repo'])[doc_id % 6 + 1] AS licence,
  CASE WHEN HASH % 10 < 8 THEN 'train' WHEN HASH % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN length(body) < 200 THEN '' ELSE sha1(body) END AS sha1, (['stationary', 'changing', 'impulsive', ''])[doc_id % 4 + 1] AS noise_class, doc_id AS pos FROM m0)
""".replace("HASH", HASH8.format("g"))
