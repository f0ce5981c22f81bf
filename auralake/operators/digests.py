"""Digests as trees over fixed blocks: of a table's lines, and of files' bytes.

A line goes to the block that its key's hash names, whatever task reads it, so a large group is spread over as many blocks as
there are; a block's digest is of its lines' hashes in sorted order. Each node above is the digest of its children's names
and digests. Two trees are compared from the root down, and only what differs is followed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators.catalog import content_digest
from auralake.session import shared_dir
from auralake.sources.recordings import opened

#: Hexadecimal digits that name a block: 4,096 blocks a group.
DIGITS = 3
FILE_BLOCK = 8 << 20


def block_of(key: Column, digits: int = DIGITS) -> Column:
    """The name of a key's block; a null key's is the empty text's."""
    return F.substring(F.sha1(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, digits)


def line_tree(df: DataFrame, line: Column, key: Column, by: list[str], digits: int = DIGITS) -> DataFrame:
    """(by, node, digest, n) of all nodes: ``node`` is a prefix of block names, the empty one a group's root; n counts lines.

    A block's lines' hashes pass through a task sorted and are not held; a node above has at most sixteen children. The
    digest does not depend on how rows are dealt. A null line counts but is not part of the digest.
    """
    shared_dir(df.sparkSession)
    lines = df.select(*by, block_of(key, digits).alias("node"), F.sha2(line.cast("string").cast("binary"), 256).alias("hash"))
    level = content_digest(lines, F.col("hash"), [*by, "node"]).checkpoint()
    tree = level
    for depth in range(digits - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        text = F.concat_ws("\n", F.transform(children, lambda c: F.concat_ws(":", c["node"], c["digest"])))
        level = level.groupBy(*by, F.substring("node", 1, depth).alias("parent")).agg(F.sha2(text.cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))
        level = level.select(*by, F.col("parent").alias("node"), "digest", "n").checkpoint()
        tree = tree.unionByName(level)
    return tree


def changed_blocks(a: DataFrame, b: DataFrame, by: list[str], digits: int = DIGITS) -> DataFrame:
    """(by, node, n_a, n_b): blocks of two :func:`line_tree` s whose digests differ, or that only one has (the other's n is zero).

    Goes down from the roots: a level's nodes are read only below those that differ above.
    """
    shared_dir(a.sparkSession)
    found = None
    for depth in range(digits + 1):
        sides = []
        for tree, side in ((a, "a"), (b, "b")):
            nodes = tree.filter(F.length("node") == depth)
            if found is not None:
                parents = found.select(*by, F.col("node").alias("parent"))
                nodes = nodes.withColumn("parent", F.substring("node", 1, depth - 1)).join(parents, [*by, "parent"], "left_semi").drop("parent")
            sides.append(nodes.select(*by, "node", F.col("digest").alias(f"digest_{side}"), F.col("n").alias(f"n_{side}")))
        both = sides[0].join(sides[1], [*by, "node"], "full")
        differ = both.filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        found = differ.select(*by, "node", *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in "ab"]).checkpoint()
    return found


def changed_lines(a: DataFrame, b: DataFrame, line: Column, key: Column, by: list[str], digits: int = DIGITS) -> DataFrame:
    """(by, key, change) of two tables: keys whose lines differ, by way of their blocks. ``change`` is added, removed or changed."""
    blocks = changed_blocks(line_tree(a, line, key, by, digits), line_tree(b, line, key, by, digits), by, digits).select(*by, "node")
    sides = []
    for df, side in ((a, "a"), (b, "b")):
        rows = df.select(*by, key.cast("string").alias("key"), block_of(key, digits).alias("node"), line.cast("string").alias("line")).join(blocks, [*by, "node"], "left_semi")
        # Rows that share a key are compared as a whole.
        sides.append(rows.groupBy(*by, "key").agg(F.array_sort(F.collect_list("line")).alias(side)))
    both = sides[0].join(sides[1], [*by, "key"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*by, "key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def file_blocks(spark: SparkSession, path: str, block_bytes: int = FILE_BLOCK) -> DataFrame:
    """(path, at, length, digest): sha256 of each fixed block of every file below a path; tasks read blocks, not files.

    An empty file has no block.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    starts = F.expr(f"sequence(0L, greatest(length - 1, 0L), {block_bytes}L)")
    ranges = files.select("path", F.explode(starts).alias("at"), "length").select("path", "at", F.least(F.col("length") - F.col("at"), F.lit(block_bytes)).cast("long").alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, own = opened(name)
                with system.open_input_file(own) as file:
                    file.seek(at)
                    digest, left = hashlib.sha256(), length
                    while left > 0 and (data := file.read(min(left, 1 << 20))):
                        digest.update(data)
                        left -= len(data)
                digests.append(digest.hexdigest())
            yield pa.record_batch([*batch.columns, pa.array(digests, pa.string())], names=["path", "at", "length", "digest"])

    return ranges.repartition("path", "at").mapInArrow(run, "path string, at long, length long, digest string")


def file_roots(blocks: DataFrame) -> DataFrame:
    """(path, length, blocks, digest) of :func:`file_blocks`' rows: a file's digest is of its blocks' digests in order.

    A file of a terabyte has 131,072 blocks, 64 characters each.
    """
    inner = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda b: b["digest"]))
    return blocks.groupBy("path").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("blocks"), F.sha2(inner.cast("binary"), 256).alias("digest"))
