"""Improbable-feature digests: what is rare in a text, in chained Bloom filters.

Every window of 8 bytes has an entropy. How often each entropy occurs in all texts is counted first; a window is the rarer
the fewer windows share its entropy. Of each 16 consecutive windows the rarest gets a vote, spans that reach over a text's
ends included, and windows with enough votes are the text's features: they depend on nothing further away than their
neighbours, so a passage keeps its features wherever it stands, and any text but the empty one has at least one. Features
go into Bloom filters of 2,048 bits, 160 to a filter; a full filter begins the next.

Two digests are compared filter by filter: each filter of the shorter chain with the one of the longer that shares most
bits, on a scale where chance is 0 and equality 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.session import shared_dir

WINDOW, NEIGHBOURS, VOTES = 8, 16, 4
#: Bits and features of a filter, bits a feature sets.
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
#: Classes of entropy that are counted, and the entropy, in bits, below which a window is mere repetition and ranks last.
CLASSES, LEAST = 256, 1.0
#: Bytes of texts worked on at once, and of one text; sorted runs a partition.
SLICE_BYTES, LONG_BYTES, RUNS_PER_PARTITION = 1_000_000, 4_000_000, 4
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

#: c log2 c for the counts a window can have, in units of 2**-20 so that sums are exact.
COUNT_LOGS = np.array([0, *(round(c * np.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1))], dtype=np.int64)


def window_entropy(data: np.ndarray) -> np.ndarray:
    """``sum(c log2 c)`` over the byte counts ``c`` of each window, in units of 2**-20.

    A window differs from the one before by a byte gone and a byte come. How the sum changes depends on how often each is
    among the bytes between.
    """
    n = len(data)
    behind, before = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for j in range(1, WINDOW):
        same = (data[j:] == data[:-j]).view(np.uint8)
        behind[:-j] += same
        before[j:] += same
    gain = np.diff(COUNT_LOGS)
    first = COUNT_LOGS[np.bincount(data[:WINDOW], minlength=256)].sum()
    return first + np.concatenate([[0], np.cumsum(gain[before[WINDOW:]] - gain[behind[: n - WINDOW]])])


class Windows:
    """Texts side by side, a gap around each, and the entropy class of each window (-1 where none begins)."""

    def __init__(self, texts: list[bytes]):
        # A gap as wide as a span keeps texts to themselves. A text shorter than a window is one, filled up with zeros.
        gap = bytes(NEIGHBOURS + WINDOW)
        texts = [t.ljust(WINDOW, b"\0") if t else t for t in texts]
        self.data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes + len(gap)) - sizes
        sums = window_entropy(self.data)
        inside = np.zeros(len(sums) + 1, dtype=np.int8)
        some = sizes > 0
        inside[self.starts[some]] = 1
        inside[(self.starts + sizes)[some] - WINDOW + 1] -= 1
        most = COUNT_LOGS[WINDOW]
        self.classes = np.where(np.cumsum(inside[:-1]) > 0, (most - sums) * (CLASSES - 1) // most, -1)


def class_ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy class, rarest first, from how many windows of all texts have it; repetition comes last."""
    repetition = np.arange(CLASSES) < LEAST / np.log2(WINDOW) * (CLASSES - 1)
    ranks = np.empty(CLASSES, dtype=np.int64)
    ranks[np.lexsort((np.arange(CLASSES), counts, repetition))] = np.arange(CLASSES)
    return ranks


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features, once each and in the order of the text; an empty one has none."""
    if len(texts) == 1 and len(texts[0]) > LONG_BYTES:  # by parts that see as far to both sides as a vote reaches
        reach, parts = NEIGHBOURS + WINDOW, []
        for a in range(0, len(texts[0]), LONG_BYTES):
            places, hashes, _ = chosen([texts[0][max(0, a - reach) : a + LONG_BYTES + reach]], ranks)
            places += max(0, a - reach)
            parts.append(hashes[(places >= a) & (places < a + LONG_BYTES)])
        return [once(np.concatenate(parts))]
    _, hashes, cuts = chosen(texts, ranks)
    return [once(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]


def once(hashes: np.ndarray) -> np.ndarray:
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def chosen(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places (from the first text's begin) and hashes of the windows with enough votes, and where each text's begin."""
    at = Windows(texts)
    n = len(at.classes)
    # Rarest first, then leftmost: one number to take the least of.
    best = (np.where(at.classes >= 0, ranks[at.classes], CLASSES) << 32) + np.arange(n)
    span = 1
    while span < NEIGHBOURS:  # least of ever wider spans
        step = min(span, NEIGHBOURS - span)
        best[: n - step] = np.minimum(best[: n - step], best[step:])
        span += step
    winners = best[best < CLASSES << 32] & ((1 << 32) - 1)
    places = np.nonzero(np.bincount(winners, minlength=n) >= VOTES)[0]
    return places - at.starts[0], window_hashes(at.data, places), [*np.searchsorted(places, at.starts).tolist(), len(places)]


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each place, by multiplying and shifting."""
    h = np.full(len(at), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(0, WINDOW, 8):
        word = np.zeros(len(at), dtype=np.uint64)
        for j in range(8):
            word |= data[at + k + j].astype(np.uint64) << np.uint64(8 * j)
        h = (h ^ word) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def chain(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters as rows of 64-bit words, and how many features each holds."""
    count = -(-len(hashes) // FILTER_FEATURES)
    bits = np.zeros((count, FILTER_BITS), dtype=np.uint8)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(FEATURE_BITS):
        bits[row, ((hashes >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return words, np.bincount(row, minlength=count)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 to 1: for each filter of the shorter chain the best normalised overlap with one of the longer, on average.

    The overlap of two filters is how far their common bits exceed what chance gives filters so full, against how far they
    could. Digests without features are alike only to each other.
    """
    (x, n_x), (y, n_y) = (a, b) if (len(a[0]), int(a[1].sum())) <= (len(b[0]), int(b[1].sum())) else (b, a)
    if not len(x):
        return float(not len(y))
    ones_x, ones_y = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best = np.empty(len(x))
    for i, (row, ones) in enumerate(zip(x, ones_x)):
        shared, most, chance = np.bitwise_count(row & y).sum(axis=1, dtype=np.int64), np.minimum(ones, ones_y), ones * ones_y / FILTER_BITS
        best[i] = np.where(shared == most, 1.0, np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)).max()
    return float(np.average(best, weights=n_x))


def written(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """A digest as text: each filter's features and bits, filters joined by commas."""
    words, counts = digest
    return ",".join(f"{n}:{base64.b64encode(row.tobytes()).decode()}" for row, n in zip(words, counts))


def sliced(texts: list[str]) -> Iterator[list[bytes]]:
    """Texts as UTF-8, a bounded number of bytes at a time; a long one by itself."""
    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def digests(texts: list[str], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The digest of each text."""
    return [chain(f) for held in sliced(texts) for f in features(held, ranks)]


def class_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each class of entropy: one short row a task, summed by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for held in sliced(t for t in batch.column("text").to_pylist() if t):
                long = held[0] if len(held[0]) > LONG_BYTES else b""
                for part in [[long[a : a + LONG_BYTES + WINDOW - 1]] for a in range(0, len(long) - WINDOW + 1, LONG_BYTES)] or [held]:
                    classes = Windows(part).classes
                    total += np.bincount(classes[classes >= 0], minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(total)], names=["class", "n"])

    counts = np.zeros(CLASSES, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[row["class"]] = row["n"]
    return counts


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What orders documents: rows without an id last, rows that share one by the hash of their text.
KEY = ["nil", "id", "h"]


def runs_by_id(docs: DataFrame) -> DataFrame:
    """(run, ahead, doc_id, nil, id, h, text): documents in sorted runs, and behind each run, as ``ahead``, the first of the next.

    Ranges of keys alone say where runs begin, so what a run needs from the next is known before any text moves, and texts
    are shuffled once. Keys are compared as the numbers they are. Behind the last run comes the first document again.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.col("doc_id").isNull().cast("long").alias("nil"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h"))
    n = RUNS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The first key of each range: as many rows as there are runs, whatever the input.
    found = keyed.select(*KEY).repartitionByRange(n, *KEY).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*KEY)).alias("first")).select("first.*").collect()
    heads = sorted(tuple(r) for r in found)
    cuts = np.array(heads[1:], dtype=np.int64).reshape(-1, len(KEY))

    @F.arrow_udf("int")
    def run_of(nil: pa.Array, ids: pa.Array, h: pa.Array) -> pa.Array:
        """How many cuts are at or before each key."""
        rows = np.stack([np.asarray(c) for c in (nil, ids, h)], axis=1)
        both = np.concatenate([cuts, rows])
        order = np.lexsort((np.arange(len(both)) >= len(cuts), *both.T[::-1]))
        runs = np.empty(len(both), dtype=np.int32)
        runs[order] = np.cumsum(order < len(cuts))
        return pa.array(runs[len(cuts) :])

    own = keyed.select(run_of(*KEY).alias("run"), F.lit(0).alias("ahead"), "doc_id", *KEY, "text")
    needed = spark.createDataFrame([(*head, (i - 1) % len(heads)) for i, head in enumerate(heads)], "nil long, id long, h long, run int")
    # One row a run.
    following = keyed.join(F.broadcast(needed), KEY).groupBy("run", *KEY).agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    return own.unionByName(following.select("run", F.lit(1).alias("ahead"), "doc_id", *KEY, "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The next document is that with the next doc_id; after the last comes the first, rows without an id come last. Rows
    that share an id (or have none) come in the order of their texts' XXH64, then of their texts; equal rows are each
    other's next. A null text is empty. One document alone is its own next. Equal texts have equal fingerprints, and
    likeness 1; an empty text has an empty fingerprint, alike only to another. Texts of any length go by one rule, a slice
    of rows at a time; comparing two digests takes time with the product of their lengths. An empty table gives no rows.
    Other columns are left out.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = class_ranks(class_counts(docs))
    ordered = runs_by_id(docs).repartition("run").sortWithinPartitions("run", "ahead", *KEY, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("run", "ahead", "doc_id", "text")))

        for number, group in groupby(rows(), key=lambda r: r[0]):
            held, size, after = [], 0, 0
            for _, ahead, doc_id, text in group:
                held.append((doc_id, text))
                size += len(text)
                after += ahead
                if size > SLICE_BYTES and len(held) > 1:
                    yield worked(held, ranks)
                    held, size = held[-1:], len(text)
            if after != 1:
                raise RuntimeError(f"run {number} has {after} documents of the next: the input changed while it was read")
            if len(held) > 1:
                yield worked(held, ranks)

    return ordered.mapInArrow(run, SCHEMA)


def worked(held: list[tuple[int | None, str]], ranks: np.ndarray) -> pa.RecordBatch:
    """The rows of all documents but the last, which is there as a next."""
    texts = [t for _, t in held]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own, other = digests(texts, ranks), digests(changed, ranks)
    return pa.record_batch(
        [
            pa.array([d for d, _ in held[:-1]], type=pa.int64()), pa.array([len(t) for t in texts[:-1]], type=pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([written(d) for d in own[:-1]]), pa.array([written(d) for d in other]),
            pa.array([1.0 if a == b else likeness(x, y) for a, b, x, y in zip(texts, changed, own, other)]),
            pa.array([1.0 if a == b else likeness(x, y) for a, b, x, y in zip(texts, texts[1:], own, own[1:])]),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )
