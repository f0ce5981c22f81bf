"""Hierarchical multi-length packing of token ids into fixed windows.

Documents go to tiers of context size, each a power of two. What a document has beyond the longest tier fills windows of
its own; the rest goes to the shortest tier that holds it. Tiers are packed from the longest: one piece of the tier opens a
window, and the gap behind it is filled from the shorter tiers, largest piece first, cutting the last one to fit. So a
window has padding only where no shorter piece is left, and of what is left last only the rest below the shortest tier.

Every task packs the documents it reads, a few million ids at a time, and a lost task's windows come out the same when its
input is read again. What would leave a window short goes on to the next few millions; the last of it, less than a window of
each tier a task, is packed once more with that of all other tasks. So few ids are shuffled, and how a table is stored hardly
matters to the padding. Windows are dealt to step groups of equal padded size.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm import tokens
from auralake.session import shared_path

TIERS = (256, 512, 1024)
#: Ids packed together: two thousand windows of the longest tier, of which one may have padding.
RUN_IDS = 2_000_000
#: Characters of text encoded at once.
SLICE_CHARS = 4_000_000
#: Windows' padded ids in a step group; bits of the windows' numbers in a task, and of tasks' numbers in each of both rounds.
STEP_IDS, WINDOW_BITS, TASK_BITS = 16 * 1024, 36, 26

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, padded_length long, "
    "step_group long, ids binary"
)


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (tier, [(document, start, length), ...]) that hold each document's ids once."""
    top = tiers[-1]
    windows: list[tuple[int, list]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        whole = n - n % top
        for start in range(0, whole, top):
            windows.append((top, [(doc, start, top)]))
        if n > whole:
            pools[tier_of(n - whole, tiers)].append((n - whole, doc, whole))
    for pool in pools.values():
        pool.sort()
    for level in range(len(tiers) - 1, -1, -1):
        tier, pool = tiers[level], pools[tiers[level]]
        while pool:
            n, doc, start = pool.pop()
            held, filled = [(doc, start, n)], n
            for lower in range(level, -1, -1):
                fill = pools[tiers[lower]]
                if lower == level and level:  # two of one tier never fit into it, but for the shortest
                    continue
                while filled < tier and fill:
                    at = bisect_right(fill, (tier - filled, 1 << 62, 0))
                    if not at:
                        break
                    n, doc, start = fill.pop(at - 1)
                    held.append((doc, start, n))
                    filled += n
            if filled < tier:  # nothing fits whole: cut the shortest piece left, of a shorter tier first
                fill = next((pools[t] for t in tiers[: level + 1] if pools[t]), None)
                if fill is not None:
                    n, doc, start = fill.pop(0)
                    gap = tier - filled
                    held.append((doc, start, gap))
                    rest = (n - gap, doc, start + gap)
                    insort(pools[tier_of(rest[0], tiers)] if tier_of(rest[0], tiers) <= tier else pool, rest)
                    filled = tier
            windows.append((tier, held))
    return windows


def tier_of(n: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if n <= t)


def step_groups(padded: list[int], target: int = STEP_IDS) -> list[int]:
    """A group per window: longest windows first, each to the group with the fewest ids, so that groups weigh the same."""
    import heapq

    groups = [(0, g) for g in range(max(1, round(sum(padded) / target)))]
    out = [0] * len(padded)
    for i in sorted(range(len(padded)), key=lambda i: (-padded[i], i)):
        n, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (n + padded[i], g))
    return out


def padded_length(filled: int, top: int) -> int:
    """A window keeps its length where that is a power of two; any other is padded to the longest tier."""
    return filled if filled & (filled - 1) == 0 else top


class Packer:
    """One task's windows: takes runs of documents' ids, gives batches of pieces."""

    def __init__(self, tiers: tuple[int, ...], step_ids: int, last_round: bool):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.tiers, self.step_ids, self.last_round = tiers, step_ids, last_round
        self.sequence = self.group = (task | last_round << TASK_BITS) << WINDOW_BITS
        #: (doc_id, where the run starts in its document, the document's ids, the run's ids)
        self.runs: list[tuple[int | None, int, int, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, start: int, total: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.runs.append((doc_id, start, total, ids))
        self.held += len(ids)
        if self.held >= RUN_IDS:
            yield self.flush(False)

    def flush(self, end: bool) -> pa.RecordBatch:
        """Full windows; those with padding too at the end of the last round, else their runs stay held."""
        # By length, then id and place: the same rows give the same windows in whatever order they were read.
        runs = sorted(self.runs, key=lambda r: (len(r[3]), r[0] is not None, r[0] or 0, r[1]))
        windows = plan_windows([len(r[3]) for r in runs], self.tiers)
        top = self.tiers[-1]
        lengths = [sum(x[2] for x in held) for _, held in windows]
        short = [not (end and self.last_round) and padded_length(n, top) != n for n in lengths]
        self.runs = [(runs[i][0], runs[i][1] + start, runs[i][2], runs[i][3][start : start + n]) for (_, held), x in zip(windows, short) if x for i, start, n in held]
        self.held = sum(len(r[3]) for r in self.runs)
        full = [(*w, n) for w, n, x in zip(windows, lengths, short) if not x]
        groups = step_groups([padded_length(n, top) for *_, n in full], self.step_ids)
        rows: list[tuple] = []
        for (tier, held, n), group in zip(full, groups):
            offset = 0
            for i, start, length in held:
                doc_id, base, total, ids = runs[i]
                rows.append((doc_id, base + start, length, total, self.sequence, offset, tier, padded_length(n, top), self.group + group, ids[start : start + length].tobytes()))
                offset += length
            self.sequence += 1
        self.group += max(groups, default=-1) + 1
        if end:  # what is left, without a window
            rows += [(doc_id, start, len(ids), total, None, None, None, None, None, ids.tobytes()) for doc_id, start, total, ids in self.runs]
        return pa.record_batch([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(PIECE_TYPES)], names=PIECE_NAMES)


PIECE_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
PIECE_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS) -> DataFrame:
    """Pieces of documents in windows; ``ids`` holds each piece's ids as little-endian unsigned 32-bit integers.

    A document is its text's ids and ``end_id``; a null text is empty, so it is that one id. Rows that repeat are packed as
    often as they come, a null doc_id is kept; documents of one length go by their ids. Every id of a row lies in exactly
    one piece. A very long text is encoded by itself and fills windows of its own. ``offset`` is where the piece stands in
    its window, ``padded_length`` what the window is padded to, ``step_group`` the batch that trains on it. An empty table
    gives no pieces. Other columns of the input are left out.
    """
    path, spark = tokenizer, docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.store(path), Packer(tiers, step_ids, False)
        for batch in batches:
            texts, doc_ids = tokens.plain(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in tokens.slices(texts, SLICE_CHARS):
                ids, offsets = encoder.encode(texts.slice(a, b - a))
                for i in range(b - a):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id))
                    yield from packer.add(doc_ids[a + i], 0, len(own), own)
        if packer.runs:
            yield packer.flush(True)
        tokens.release()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step_ids, True)
        for batch in batches:
            for row in batch.to_pylist():
                yield from packer.add(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], dtype="<u4"))
        if packer.runs:
            yield packer.flush(True)
        tokens.release()

    # Both rounds' pieces come from one encoding, which is written.
    written = shared_path(spark, "packed")
    docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(first, SCHEMA).write.parquet(written)
    pieces = spark.read.parquet(written)
    left = pieces.filter("sequence_id is null").select("doc_id", "start", "doc_tokens", "ids", "length")
    tasks = (left.agg(F.sum("length")).first()[0] or 0) // (2 * RUN_IDS) + 1
    left = left.repartition(tasks, F.xxhash64("doc_id", "start", "ids"))
    return pieces.filter("sequence_id is not null").unionByName(left.mapInArrow(again, SCHEMA))
