"""Extendible hashing: a directory indexed by hash-prefix bits whose oversized buckets split on one more bit.

Everything here is DataFrame code. The byte histogram is taken over a prefix deep enough to see every split that an even
spread would need; only the cells that are still too large there are counted again over longer prefixes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.session import shared_dir

#: Bits of the key's hash that the directory can use.
HASH_BITS = 32
#: Directories of at most this many bits are broadcast: 2^17 rows of three longs.
BROADCAST_BITS = 16


def key_hash(key: Column) -> Column:
    """The first 32 bits of the md5 of a key's text, as a long; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def free_prefix(docs: DataFrame) -> str:
    """What no column's name begins with, for columns that come and go."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def split_level(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """For each occupied prefix of ``depth`` bits (``cell``, ``bytes``) the bucket it belongs to.

    A cell's bucket is the shortest prefix longer than ``above`` bits whose bytes fit, or the cell itself, which is then
    ``over``. Each cell adds to one sum a level; those sums are folded before they are shuffled. All cells of a small
    directory share its shortest prefixes, so its sums go to the cells; in a deeper one at most ``2^(depth - above - 1)``
    cells share a prefix.
    """
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == depth))
    fits = F.broadcast(fits) if depth <= BROADCAST_BITS else fits
    best = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("b"))
    return best.select("cell", "b.*", (F.col("b.shard_bytes") > limit).alias("over"))


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None, first_bits: int = 12) -> DataFrame:
    """Adds ``shard`` (its hash-prefix bits), ``depth`` and ``shard_bytes`` to every row.

    The directory starts with ``first_bits`` bits. Cells that overflow there are counted again over their own rows only,
    with as many further bits as an even split of the largest needs and two to spare, until every bucket fits.

    Rows with one key always share a shard. A shard exceeds ``limit`` only if all its rows have one 32-bit hash, as one
    row larger than the limit does. A null size counts zero bytes; a null key hashes as the empty text; an empty table
    gives no rows. Columns of those names in the input are replaced.
    """
    shared_dir(docs.sparkSession)
    size = F.octet_length(F.col("text")) if size is None else size
    own = free_prefix(docs)
    docs = docs.drop("shard", "depth", "shard_bytes").withColumn(f"{own}h", key_hash(F.col(key)))
    rows = docs.select(F.col(f"{own}h").alias("h"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))
    above, depth, bucket = -1, first_bits, None
    while True:
        level = rows.groupBy(F.shiftright("h", HASH_BITS - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        level = split_level(level, above, depth, limit).checkpoint()
        final = depth == HASH_BITS
        found = level if final else level.filter(~F.col("over"))
        cell, best = f"{own}c{depth}", f"{own}b{depth}"
        found = found.select(F.col("cell").alias(cell), F.struct("depth", "prefix", "shard_bytes").alias(best))
        docs = docs.withColumn(cell, F.shiftright(f"{own}h", HASH_BITS - depth)).join(found, cell, "left").drop(cell)
        bucket = F.col(best) if bucket is None else F.coalesce(bucket, F.col(best))
        largest = None if final else level.filter("over").agg(F.max("shard_bytes").alias("m")).first()["m"]
        if largest is None:
            break
        over = level.filter("over").select(F.col("cell").alias("over"))
        rows = rows.join(over, F.shiftright("h", HASH_BITS - depth) == F.col("over"), "left_semi")
        above, depth = depth, min(HASH_BITS, depth + math.ceil(math.log2(largest / limit)) + 2)
    docs = docs.withColumn(f"{own}b", bucket)
    bits = F.when(F.col(f"{own}b.depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin({own}b.prefix), {own}b.depth, '0')"))
    docs = docs.withColumns({"shard": bits, "depth": F.col(f"{own}b.depth").cast("int"), "shard_bytes": F.col(f"{own}b.shard_bytes")})
    return docs.drop(*[c for c in docs.columns if c.startswith(own)])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard; a shard's rows meet in one task, which its byte limit bounds."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
