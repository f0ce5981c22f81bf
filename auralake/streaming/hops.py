"""Streams of hops: finite runs of a streaming query, windows, late rows, items that are a function of their number."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.session import shared_dir, shared_path


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events", per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, with event times that a watermark accepts."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", per_trigger).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


#: Keeps state in files of the checkpoint instead of the executors' heaps; versioned state needs it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries started meanwhile keep their state in :data:`STATE_STORE`; a query that is resumed keeps the store it began with."""
    key, provider = STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drained(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a streaming query gives for the input there is now and that it hasn't read yet, as a table.

    With a ``checkpoint`` the query resumes where an earlier run with it ended, and the table has the rows of all its runs.
    Appended rows go to files in the shared folder, so they may be as many as they like; results that are complete each time
    are aggregates and go to a table in memory.
    """
    spark = stream.sparkSession
    shared_dir(spark)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or shared_path(spark, "stream-state"))
    if mode == "append":
        path = f"{checkpoint}-rows" if checkpoint else shared_path(spark, "stream-rows")
        with state_store(spark):
            query = writer.format("parquet").option("path", path).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    name = f"drained_{uuid.uuid4().hex}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def written(*steps: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """Tables of one schema as a stream that reads them in this order; their rows are written once to the shared folder.

    A trigger reads the files of ``per_trigger`` tables on average, however many a table has, so the number of micro-batches
    doesn't grow with the tables.
    """
    spark = steps[0].sparkSession
    path = shared_path(spark, "stream-input")
    for k, rows in enumerate(steps):
        rows.write.parquet(f"{path}/{k}")
    reader = spark.readStream.schema(steps[0].schema)
    if per_trigger:
        files = len(spark.read.schema(steps[0].schema).parquet(f"{path}/*").inputFiles())
        reader = reader.option("maxFilesPerTrigger", max(1, -(-files * per_trigger // len(steps))))
    return reader.parquet(f"{path}/*")


def arriving(rows: DataFrame, time: str, by: str, most: str, steps: int, per_trigger: int = 2) -> DataFrame:
    """A table's rows as a stream in which each arrives up to ``most`` after its time, drawn from the hash of ``by``.

    Arrival is cut into ``steps`` of equal length, read one after the other; files within a step come in any order, so no
    row is later than a step and ``most`` together.
    """
    wait = F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00' + interval {most})")
    late = rows.withColumn("__at", F.unix_micros(time) + F.floor(S.uniform("arrival", F.col(by)) * wait))
    low, high = late.agg(F.coalesce(F.min("__at"), F.lit(0)), F.coalesce(F.max("__at"), F.lit(0))).first()
    step = F.floor((F.col("__at") - low) * steps / (high - low + 1))
    return written(*(late.filter(step == k).drop("__at") for k in range(steps)), per_trigger=per_trigger)


def windowed(rows: DataFrame, by: list[str], time: str, size: str, slide: str | None = None, delay: str | None = None) -> tuple[DataFrame, Column]:
    """The rows grouped by keys and windows of event time, for an aggregate; ``delay`` sets the watermark."""
    rows = rows.withWatermark(time, delay) if delay else rows
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(*by, w.alias("w")), F.col("w.start")


def items(spark: SparkSession, seed: int, epochs: int, per_epoch: int, pools: int) -> DataFrame:
    """A training stream's items: each is a function of seed, epoch and place, so any reader may start anywhere.

    ``seq`` numbers them over all epochs; ``pool``, ``snr`` and ``fault`` are drawn from their hashes.
    """
    rows = spark.range(epochs * per_epoch).select(F.col("id").alias("seq"), F.floor(F.col("id") / per_epoch).alias("epoch"), (F.col("id") % per_epoch).alias("i"))
    u = lambda what: S.uniform(seed, what, F.col("epoch"), F.col("i"))
    return rows.select("*", S.pick(F.lit(pools), seed, "pool", F.col("epoch"), F.col("i")).alias("pool"), (-5 + 20 * u("snr")).alias("snr"), (u("fault") < 0.1).alias("fault"))
