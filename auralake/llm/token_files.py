"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Files are written in ascending document order. Each row keeps where its ids start among its task's, so a reader needs only
one number a file, the ids in all files before it less its first row's place, to place any document. Spark reads the stripes of a file in parallel, and a
filter on ``doc_id`` skips files, stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm import tokens
from auralake.session import shared_dir

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.encoding.strategy": "COMPRESSION",
    "compression": "zstd",
}
FILE_SCHEMA = "doc_id long, file_start long, n_ids long, ids array<int>"
#: Files whose offsets are broadcast at most: some 200 bytes each.
FILES_BROADCAST = 50_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, options: dict[str, str] | None = None) -> None:
    """Encodes every whole text and writes (doc_id, file_start, n_ids, ids) below ``path``.

    Texts are sorted before they are encoded: they are smaller than their ids, and the sort samples no encoding. A null
    text is empty, so its ids are ``end_id`` alone. Null doc_ids come first; rows with one doc_id come in the order of
    their texts. An empty table gives files without rows. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = tokens.store(tokenizer), 0
        for batch in batches:
            texts = tokens.plain(batch.column("text"))
            for a, b in tokens.slices(texts):
                ids, offsets = encoder.encode(texts.slice(a, b - a))
                ids = np.insert(ids, offsets[1:], np.uint32(end_id))
                offsets = offsets + np.arange(len(offsets))
                lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.view(np.int32)))
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), lists], names=["doc_id", "file_start", "n_ids", "ids"])
                start += int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, FILE_SCHEMA)
    encoded.write.options(**(ORC_OPTIONS | (options or {}))).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of all documents: ``start`` counts the ids of all documents before, over all files."""
    shared_dir(spark)
    rows = spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "file_start", "n_ids", "ids", F.col("_metadata.file_path").alias("file"))
    # The least doc_id of a file orders the files; a null sorts first, as it was written.
    files = rows.groupBy("file").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.max("doc_id").alias("most"),
        F.sum("n_ids").alias("n"), F.min("file_start").alias("first"),
    )
    before = Window.orderBy(F.desc("nulls"), "least", "most", "file").rowsBetween(Window.unboundedPreceding, -1)
    # A task that writes several files goes on counting, so a file's own first place is not always zero.
    files = files.select("file", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("before")).checkpoint()
    # One row a file. Ids need not be shuffled to meet them unless there are very many files.
    files = F.broadcast(files) if files.count() <= FILES_BROADCAST else files
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "ids")


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as :func:`read_token_files` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, type=pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
