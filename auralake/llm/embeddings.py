"""Epsilon grid order join of embeddings by cosine.

Unit vectors with cosine ``c`` or more are at most ``sqrt(2 - 2c)`` apart, and no projection takes them further apart. So
vectors are put in the order of grid cells of that width on the leading principal dimensions, the order is cut into
intervals, and intervals are joined by halving: two halves whose boxes are further apart than the width are skipped, the
rest is compared exactly, in double precision. A pair of intervals gives back how many links each vector has and a
spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.llm.components import components, spanning_forest
from auralake.session import shared_dir

#: Leading principal dimensions of the grid, vectors of an interval and of what is compared at once.
GRID_DIMS, INTERVAL_ROWS, LEAF_ROWS = 4, 2048, 256
#: A grid cell's least side: where only vectors of one direction link, cells need a size all the same.
LEAST_WIDTH = 1e-3
BLOCK = "label long, dims int, block long, low array<double>, high array<double>, nodes array<long>, weights array<long>, vectors binary, places binary"


def comparable(vector: Column) -> Column:
    """Whether a vector has a direction: all components are there and finite, and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one batch as rows of doubles, shorter ones with zeros behind."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    inside = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[inside] = values[offsets[0] : offsets[-1]]
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component is from 0.5 to 1: squares neither over- nor underflow.

    No digit changes, and the cosine does not either.
    """
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0.0))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def principal_dimensions(vectors: DataFrame, dims: int) -> np.ndarray:
    """The leading eigenvectors of the unit vectors' second moments, over all of them.

    Each task sums its own moments; one row per component meets at the driver, as many as a vector has components.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            rows = unit(matrix(batch.column("embedding")))
            n = max(len(total), rows.shape[1])
            grown = np.zeros((n, n))
            grown[: len(total), : len(total)] += total
            grown[: rows.shape[1], : rows.shape[1]] += rows.T @ rows
            total = grown
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(list(total), type=pa.list_(pa.float64()))], names=["i", "row"])

    found = vectors.select("embedding").mapInArrow(moments, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    found = found.groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("row")).collect()
    n = len(found)
    total = np.array([[dict(r["row"]).get(j, 0.0) for j in range(n)] for r in sorted(found, key=lambda r: r["i"])]).reshape(n, n)
    return np.linalg.eigh(total)[1][:, ::-1][:, :dims] if n else np.zeros((0, dims))


def intervals(vectors: DataFrame, axes: np.ndarray, width: float, rows: int) -> DataFrame:
    """Vectors in grid order, by intervals of at most ``rows`` of one label and length."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unit(matrix(batch.column("embedding")))
            place = own @ axes[: own.shape[1]]
            cells = pa.array(list(np.floor(place / width).astype(np.int64)), type=pa.list_(pa.int64()))
            yield pa.record_batch([*batch.columns, cells, pa.array(list(place), type=pa.list_(pa.float64()))], names=[*batch.schema.names, "cells", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == rows or (held[0]["label"], held[0]["dims"]) != (row["label"], row["dims"])):
                    yield interval(held)
                    held = []
                held.append(row)
        if held:
            yield interval(held)

    placed = vectors.mapInArrow(place, "node long, label long, weight long, dims int, embedding array<double>, cells array<long>, place array<double>")
    ordered = placed.repartitionByRange("label", "dims", "cells", "node").sortWithinPartitions("label", "dims", "cells", "node")
    return ordered.mapInArrow(cut, BLOCK)


def interval(held: list[dict]) -> pa.RecordBatch:
    places = np.array([r["place"] for r in held])
    vectors = np.array([r["embedding"] for r in held], dtype=np.float64)
    # Nodes are unique, so an interval's first names it.
    values = [held[0]["label"], held[0]["dims"], held[0]["node"], places.min(axis=0).tolist(), places.max(axis=0).tolist(), [r["node"] for r in held], [r["weight"] for r in held], vectors.tobytes(), places.tobytes()]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], type=t) for v, t in zip(values, types)], names=[x.split()[0] for x in BLOCK.split(", ")])


class Side:
    """One interval in a task, and the boxes of its halves as far as they are asked for."""

    def __init__(self, nodes: list[int], weights: list[int], vectors: bytes, places: bytes):
        self.nodes, self.weights = np.array(nodes), np.array(weights)
        rows = scaled(np.frombuffer(vectors).reshape(len(nodes), -1))
        self.rows, self.norms = rows, np.sqrt(np.einsum("ij,ij->i", rows, rows))
        self.places = np.frombuffer(places).reshape(len(nodes), -1)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.places[a:b].min(axis=0), self.places[a:b].max(axis=0)
        return self.boxes[a, b]


def join_intervals(x: Side, y: Side, same: bool, least: float, reach: float, out: np.ndarray) -> None:
    """Marks in ``out`` which rows of the two sides have cosine ``least`` or more, halving the longer side each time."""
    stack = [(0, len(x.nodes), 0, len(y.nodes))]
    while stack:
        a, b, c, d = stack.pop()
        if same and d <= a:  # the mirror image of another pair
            continue
        (low, high), (other_low, other_high) = x.box(a, b), y.box(c, d)
        gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
        if gap @ gap > reach * reach + 1e-9:
            continue
        if max(b - a, d - c) <= LEAF_ROWS:
            cosine = (x.rows[a:b] @ y.rows[c:d].T) / (x.norms[a:b, None] * y.norms[None, c:d])
            out[a:b, c:d] = cosine >= least
            if same:
                out[c:d, a:b] = out[a:b, c:d].T
        elif b - a >= d - c:
            stack += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            stack += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]


def joined(batches: Iterator[pa.RecordBatch], least: float, reach: float) -> Iterator[pa.RecordBatch]:
    """For each pair of intervals (node, links, root): weights linked to, and the row that stands for its links here."""
    for batch in batches:
        for row in batch.to_pylist():
            same = row["block"] == row["block_2"]
            x = Side(row["nodes"], row["weights"], row["vectors"], row["places"])
            y = x if same else Side(row["nodes_2"], row["weights_2"], row["vectors_2"], row["places_2"])
            found = np.zeros((len(x.nodes), len(y.nodes)), dtype=bool)
            join_intervals(x, y, same, least, reach, found)
            if same:
                np.fill_diagonal(found, False)
                nodes, counts, adjacent = x.nodes, found @ x.weights, found
            else:
                n = len(x.nodes)
                nodes, counts = np.concatenate([x.nodes, y.nodes]), np.concatenate([found @ y.weights, found.T @ x.weights])
                adjacent = np.zeros((len(nodes), len(nodes)), dtype=bool)
                adjacent[:n, n:], adjacent[n:, :n] = found, found.T
            root = spanning_forest(adjacent)
            linked = np.nonzero(root >= 0)[0]
            yield pa.record_batch([pa.array(nodes[linked]), pa.array(counts[linked].astype(np.int64)), pa.array(nodes[root[linked]])], names=["node", "links", "root"])


def near_dedup(table: DataFrame, least: float = 0.93, grid_dims: int = GRID_DIMS, rows: int = INTERVAL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null and their lengths are equal. A vector that is null,
    empty, zero or holds a null or non-finite component links with nothing, and so does a row without vec_id; its
    component is its own vec_id. Very large and very small components count as exactly as others. Equal vectors of a label are one node of the join, however many they are, and all link
    with each other. Rows that share a vec_id share a node: their links are counted together. An empty table gives no
    rows. Other columns are left out.
    """
    shared_dir(table.sparkSession)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    width = max(reach, LEAST_WIDTH)
    table = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long"))
    usable = comparable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    nodes = table.filter(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")).checkpoint()
    distinct = nodes.select("node", "label", "weight", F.size("embedding").alias("dims"), "embedding")
    axes = principal_dimensions(distinct, grid_dims)
    blocks = intervals(distinct, axes, width, rows).checkpoint()
    # Boxes alone decide which intervals meet; their first dimension's cells make it an equality.
    def cells(more: int) -> Column:
        cell = lambda side: F.floor(F.element_at(side, 1) / width)
        return F.explode(F.sequence(cell("low") - more, cell("high") + more)).alias("cell")

    own = blocks.select("label", "dims", "block", "low", "high", cells(0))
    other = blocks.select("label", "dims", F.col("block").alias("block_2"), F.col("low").alias("low_2"), F.col("high").alias("high_2"), cells(1))
    gaps = F.zip_with(F.zip_with("low", "high_2", lambda a, b: a - b), F.zip_with("low_2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    pairs = own.join(other, ["label", "dims", "cell"]).filter((F.col("block") <= F.col("block_2")) & (apart <= reach * reach + 1e-9))
    pairs = pairs.select("label", "dims", "block", "block_2").distinct()
    payload = ["nodes", "weights", "vectors", "places"]
    right = blocks.select("label", "dims", F.col("block").alias("block_2"), *[F.col(c).alias(f"{c}_2") for c in payload])
    pairs = pairs.join(blocks.select("label", "dims", "block", *payload), ["label", "dims", "block"]).join(right, ["label", "dims", "block_2"])
    pairs = pairs.repartition("label", "dims", "block", "block_2")
    found = pairs.mapInArrow(lambda batches: joined(batches, least, reach), "node long, links long, root long").checkpoint()
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labels = nodes.join(counts, "node", "left").join(groups, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    ).checkpoint()
    out = table.withColumn("usable", usable)
    linked = out.filter("usable").join(labels, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = out.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
