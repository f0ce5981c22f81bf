"""SimHash fingerprints and their exact comparison by tiles; documents alike by their shingles, by the same tiles.

A fingerprint has 64 bits a word. Links are found exactly: fingerprints within the radius agree on at least one of
``radius + 1`` blocks of bits, so rows meet by block; rows that share a block are cut into tiles by population count, and
two tiles meet only if their counts can differ by the radius or less. A tile pair is compared by exclusive-or and bit
counts in numpy, and gives back a spanning forest of its links, never the links themselves.

Majority fingerprints cannot prove how similar two sets of shingles are. :func:`one_of_each` therefore compares parity
fingerprints the same way: each shingle flips one bit, so two sets differ in at least as many shingles as their fingerprints
in bits, and no pair of the wanted similarity is further apart than a radius that their sizes give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from auralake.llm import tokens
from auralake.llm.components import components, spanning_forest
from auralake.session import shared_dir, shared_path

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Numbers of bytes, and the base and its inverse modulo 2**64, of :func:`word_hashes`.
BYTE_NUMBERS = np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) for b in range(256)], dtype=np.uint64)
BASE = xxhash.xxh64_intdigest(b"base", SEED) | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Rows of a tile; a task compares two at once, in strips.
TILE_ROWS, STRIP_ROWS = 2048, 512


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of an ASCII-lower-cased text, or of all its words where they are fewer."""
    text = text.translate(LOWER)
    words = text.split()  # of bytes: at space, tab, line feed, vertical tab, form feed and carriage return
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 15):  # long texts a strip at a time
        bits = np.unpackbits(hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint) of every whole text, the fingerprint as a signed long.

    Words are what stands between ASCII white space, A-Z in lower case; repeats of a shingle count. A text without words,
    empty or null, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [majority(shingle_hashes(t.as_py() or b"", width)) for t in batch.column("text").cast(pa.binary())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, out: np.ndarray) -> None:
    """Marks in ``out`` which of two tiles' rows, each sorted by population count, are within the radius.

    Strips of rows are compared with the rows whose counts can be close enough; the rest is skipped.
    """
    ones_a, ones_b = np.bitwise_count(a), np.bitwise_count(b)
    for i in range(0, len(a), STRIP_ROWS):
        strip = a[i : i + STRIP_ROWS]
        low = np.searchsorted(ones_b, int(ones_a[i]) - radius)
        high = np.searchsorted(ones_b, int(ones_a[i + len(strip) - 1]) + radius, side="right")
        if low < high:
            out[i : i + len(strip), low:high] = np.bitwise_count(strip[:, None] ^ b[None, low:high]) <= radius


def links(prints: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): a spanning forest of all links between the distinct fingerprints of (node, fingerprint)."""
    blocks = radius + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fingerprint", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("key"))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ])
    rows = prints.select("node", "fingerprint", F.bit_count("fingerprint").alias("ones"), F.explode(keys).alias("k"))
    rows = rows.select("node", "fingerprint", "ones", "k.block", "k.key")
    # At most blocks * 2**ceil(64 / blocks) groups, each with at most 65 counts: bounded by the fingerprint's width.
    counts = rows.groupBy("block", "key", "ones").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy("block", "key"))
    tiles = counts.withColumn("size", size).withColumn("parts", F.ceil(F.col("n") / tile_rows).cast("int"))
    crowded = tiles.filter(F.col("size") > tile_rows).select("block", "key", "ones", "parts").checkpoint()
    # In a crowded group a tile is one count's rows, or a part of them; its partners are the tiles of counts in reach.
    other = crowded.select("block", "key", F.col("ones").alias("other"), F.col("parts").alias("other_parts"))
    reach = crowded.join(other, ["block", "key"]).filter(F.abs(F.col("ones") - F.col("other")) <= radius)
    reach = reach.groupBy("block", "key", "ones", "parts").agg(F.collect_list(F.struct("other", "other_parts")).alias("partners"))
    placed = rows.join(reach, ["block", "key", "ones"], "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fingerprint"), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    mine = F.col("ones") * F.lit(1 << 32) + part
    theirs = F.flatten(F.transform("partners", lambda p: F.transform(F.sequence(F.lit(0), p["other_parts"] - 1), lambda i: p["other"] * F.lit(1 << 32) + i)))
    placed = placed.select("node", "fingerprint", "block", "key", mine.alias("tile"), F.explode(F.coalesce(theirs, F.array(F.lit(-1).cast("long")))).alias("with"))
    alone = F.col("with") < 0
    placed = placed.select(
        "node", "fingerprint", "block", "key", F.when(alone, -1).otherwise(F.least("tile", "with")).alias("low"),
        F.when(alone, -1).otherwise(F.greatest("tile", "with")).alias("high"), (~alone & (F.col("tile") > F.col("with"))).alias("second"),
    )
    units = placed.groupBy("block", "key", "low", "high").agg(F.collect_list(F.struct("second", "fingerprint", "node")).alias("rows"))
    return units.filter(F.size("rows") > 1).select("rows").mapInArrow(lambda batches: compared(batches, radius), "a long, b long")


def compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """The forest of each unit's links: one tile with itself, or two tiles with each other."""
    for batch in batches:
        lists = batch.column("rows")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        second = flat.field("second").to_numpy(zero_copy_only=False)
        prints = flat.field("fingerprint").to_numpy().view(np.uint64)
        nodes = flat.field("node").to_numpy()
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            at = np.arange(a, b)
            at = at[np.lexsort((np.bitwise_count(prints[at]), second[at]))]
            own, n = prints[at], int((~second[at]).sum())
            adjacent = np.zeros((len(at), len(at)), dtype=bool)
            if n == len(at):
                close_pairs(own, own, radius, adjacent)
                np.fill_diagonal(adjacent, False)
            else:
                close_pairs(own[:n], own[n:], radius, adjacent[:n, n:])
                adjacent[n:, :n] = adjacent[:n, n:].T
            if not adjacent.any():
                continue
            root = spanning_forest(adjacent)
            linked = np.nonzero(root >= 0)[0]
            ends.append((nodes[at[linked]], nodes[at[root[linked]]]))
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends))
            yield pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is the smallest doc_id reachable over links.

    Equal fingerprints are one node from the start, so copies are never compared with each other. Texts without words link
    with each other through their common fingerprint. Rows that share a doc_id each give a row. A null doc_id takes part
    through its fingerprint: its component is the smallest doc_id reachable, null only if it reaches none. An empty table
    gives no rows. Other columns are left out.
    """
    shared_dir(docs.sparkSession)
    prints = fingerprints(docs, width).checkpoint()
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).checkpoint()
    # The fingerprint itself is the node: it is never null, and one document may stand behind no other.
    found = components(links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), radius, tile_rows)).checkpoint()
    labels = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("group"))
    smallest = labels.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = labels.join(smallest, "group").select("fingerprint", "component_id").checkpoint()
    return prints.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


# Documents alike by their shingles: prefixes of rare shingles meet, parity fingerprints and then the shingles themselves decide.

#: Characters of texts whose words are hashed at once.
SLICE_CHARS = 2_000_000
#: Shingles are counted by the first bits of their hash. The counts only order shingles, so sharing a slot loses nothing; more
#: bits keep frequent shingles apart from rare ones in larger corpora, at a byte a slot in every worker.
SLOT_BITS = 20
#: Counts' logarithms are kept in steps of an eighth, and rows of one shingle are sorted in parts of about so many.
LEVELS, PART_ROWS = 8, 1 << 20
#: Sets of a tile, and their shingles; sets and shingles of a tile in the last check.
TILE_SETS, TILE_SHINGLES = 2048, 1 << 22
CHECK_SETS, CHECK_SHINGLES = 1024, 1 << 20
FOUND = "k1 long, k2 long, node long, n long, parity binary, slot int, times long"


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' numbers times powers of an odd base, as differences of running sums."""
    data, ends = words.buffers()[2], np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data, parts, a = np.frombuffer(data or b"", dtype=np.uint8), [], 0
    while a < len(words):  # as many words as have some 2 MB
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_CHARS, side="right")) - 1)
        own, at = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        up, down = (np.cumprod(np.full(len(own) + 1, x, dtype=np.uint64)) for x in (BASE, INVERSE))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_NUMBERS[own] * up[:-1])])
        parts.append((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]])
        a = b
    return mixed(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def distinct_shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as 64-bit hashes of their words' hashes, ascending; fewer words are one shingle."""
    factors = [np.uint64(xxhash.xxh64_intdigest(b"%d" % k, SEED) | 1) for k in range(width)]
    texts = tokens.plain(texts)
    for a, b in tokens.slices(texts, SLICE_CHARS):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a).fill_null("")))
        words, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        # Empty words stand before and behind white space at a text's ends.
        there = np.asarray(pc.binary_length(words)) > 0
        own, offsets = word_hashes(words)[there], np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
        own = np.concatenate([own, np.zeros(width, dtype=np.uint64)])
        h = mixed(sum(own[k : len(own) - width + k] * factor for k, factor in enumerate(factors)))
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if 0 < end - start < width:
                yield mixed(sum(own[start + k : start + k + 1] * factors[k] for k in range(end - start)))
            else:
                found = np.sort(h[start : max(start, end - width + 1)])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def set_hash(shingles: np.ndarray) -> int:
    """What stands for a set of shingles; a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def parity(shingles: np.ndarray) -> bytes:
    """At least two bits a shingle, a power of two; each bit says whether an odd number of shingles falls on it."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, k1, k2, node, n, parity) of every row of (doc_id, k1, k2, text), and (slot, times): how often shingles of a slot occur."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            nodes, sizes, bits = [], [], []
            for own in distinct_shingles(batch.column("text"), width):
                nodes.append(set_hash(own))
                sizes.append(len(own))
                bits.append(parity(own))
                np.add.at(total, (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
            ids = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            rows = [*ids, pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(bits, type=pa.binary())]
            yield pa.record_batch([*rows, pa.nulls(len(nodes), pa.int32()), pa.nulls(len(nodes), pa.int64())], names=schema.names)
        slots = np.nonzero(total)[0]
        for at in range(0, len(slots), 1 << 16):
            own = slots[at : at + (1 << 16)]
            nothing = [pa.nulls(len(own), c.type) for c in rows]
            yield pa.record_batch([*nothing, pa.array(own.astype(np.int32)), pa.array(total[own])], names=schema.names)
        tokens.release()

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, schema)


def record(schema: str, columns: list) -> pa.RecordBatch:
    return pa.record_batch(columns, names=[x.split()[0] for x in schema.split(", ")])


def slot_levels(slots: DataFrame) -> np.ndarray:
    """The logarithm of each slot's count: one byte a slot, so as many bytes whatever the input."""

    def pack(table: pa.Table) -> pa.Table:
        slot, times = (table.column(c).to_numpy() for c in ("slot", "times"))
        levels = np.zeros(1 << 16, dtype=np.uint8)
        levels[slot & 0xFFFF] = np.minimum(255, np.round(LEVELS * np.log2(times + 1.0)))
        return pa.table({"block": pa.array([int(slot[0]) >> 16], type=pa.int32()), "levels": pa.array([levels.tobytes()])})

    blocks = slots.groupBy("slot").agg(F.sum("times").alias("times")).groupBy(F.shiftright("slot", 16)).applyInArrow(pack, "block int, levels binary")
    out = np.zeros((1 << max(SLOT_BITS, 16)) // (1 << 16) * (1 << 16), dtype=np.uint8).reshape(-1, 1 << 16)
    for row in blocks.collect():
        out[row["block"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.ravel()


def tiles(docs: DataFrame, width: int, similarity: float, levels: np.ndarray, tile_sets: int = TILE_SETS, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, crowded, low, high, nodes): the sets that share a shingle of their prefix, by ascending size (from low to high).

    With shingles put in one order, two sets of similarity ``s`` share one of the first ``n - ceil(s n) + 1`` of each. Rare
    shingles come first in that order, so few sets meet in one. A shingle's sets are one tile unless they are ``crowded``.
    """
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = table.value
        for batch in batches:
            seen: set[int] = set()
            keys, parts, nodes, sizes = [], [], [], []
            for own in distinct_shingles(batch.column("text"), width):
                node, n = set_hash(own), len(own)
                if node in seen or not n:
                    continue
                seen.add(node)
                rank = level[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                first = np.argsort((rank.astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8)), kind="stable")[: n - least_common(n, similarity) + 1]
                many = np.ceil(np.exp2(rank[first] / LEVELS) / part_rows).astype(np.int64)
                keys.append(own[first].view(np.int64))
                parts.append(np.where(many > 1, node % many, -1))
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), n))
            if keys:
                yield record(ENTRY, [pa.array(np.concatenate(c)) for c in (keys, parts, nodes, sizes)])
        tokens.release()

    entries = docs.select("text").mapInArrow(prefixes, ENTRY)
    return entries.repartition("key", "part").sortWithinPartitions("key", "part", "n", "node").mapInArrow(lambda batches: tiled(batches, tile_sets), TILE)


ENTRY = "key long, part long, node long, n long"
TILE = "key long, crowded boolean, low long, high long, nodes array<long>"


def least_common(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares with any that is as similar."""
    return int(np.ceil(similarity * n - 1e-9))


def tiled(batches: Iterator[pa.RecordBatch], tile_sets: int) -> Iterator[pa.RecordBatch]:
    """Tiles of rows sorted by key, part, size and node; what lies alone under its key is left out."""
    held, crowded = np.zeros((0, 4), dtype=np.int64), False
    for batch in chained(batches):
        if batch is not None:
            held = np.concatenate([held, np.stack([np.asarray(batch.column(c)) for c in ("key", "part", "n", "node")], axis=1)])
        if not len(held):
            continue
        held = held[np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)])]
        starts = np.concatenate([[0], np.nonzero((held[1:, :2] != held[:-1, :2]).any(axis=1))[0] + 1, [len(held)]])
        ready = len(starts) - 1 if batch is None else len(starts) - 2  # the last group may go on
        out: list[tuple] = []
        for a, b in zip(starts[:ready].tolist(), starts[1 : ready + 1].tolist()):
            if b - a > 1 or crowded or held[a, 1] >= 0:
                out += cut(held[a:b], crowded, True, tile_sets)
            crowded = False
        held = held[starts[ready] :]
        if len(held) > 2 * tile_sets:
            full = cut(held, True, False, tile_sets)
            out += full
            held, crowded = held[sum(len(x[4]) for x in full) :], True
        if out:
            key, flag, low, high, nodes = zip(*out)
            yield record(TILE, [pa.array(key), pa.array(flag), pa.array(low), pa.array(high), pa.array(nodes, type=pa.list_(pa.int64()))])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and nothing to mark their end."""
    yield from batches
    yield None


def cut(rows: np.ndarray, crowded: bool, all_of_it: bool, tile_sets: int) -> list[tuple]:
    """One group's tiles of bounded size; without its rest where more of the group is to come."""
    shingles = np.cumsum(rows[:, 2])
    out, a = [], 0
    while a < len(rows):
        b = min(a + tile_sets, max(a + 1, int(np.searchsorted(shingles, shingles[a] - rows[a, 2] + TILE_SHINGLES, side="right"))))
        if b >= len(rows) and not all_of_it:
            break
        out.append((a, min(b, len(rows))))
        a = b
    crowded = crowded or len(out) > 1 or not all_of_it or bool(rows[0, 1] >= 0)
    return [(int(rows[a, 0]), crowded, int(rows[a, 2]), int(rows[b - 1, 2]), rows[a:b, 3].tolist()) for a, b in out]


def units_of(found: DataFrame, similarity: float) -> DataFrame:
    """(unit, nodes, others): tiles to compare with themselves (no others) or with another of the same shingle.

    Near copies share most of a prefix, so the same sets meet under many shingles: equal units are compared once.
    """
    nothing = F.array().cast("array<long>")
    alone = found.select("nodes", nothing.alias("others"))
    crowded = found.filter("crowded").select("key", "low", "high", "nodes")
    other = crowded.select("key", F.col("low").alias("low_2"), F.col("nodes").alias("others"))
    later = (F.col("low") < F.col("low_2")) | ((F.col("low") == F.col("low_2")) & (F.col("nodes") < F.col("others")))
    pairs = crowded.join(other, "key").filter(later & (F.col("low_2") * similarity <= F.col("high") + 1e-6)).select("nodes", "others")
    # Written before units are numbered, so that a lost task cannot number them anew.
    return alone.filter(F.size("nodes") > 1).unionByName(pairs).distinct().withColumn("unit", F.monotonically_increasing_id()).checkpoint()


def candidates(units: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in each unit a spanning forest of the pairs whose parity fingerprints (node, n, parity) leave them similar."""
    members = units.select("unit", F.lit(False).alias("second"), F.explode("nodes").alias("node")).unionByName(units.select("unit", F.lit(True).alias("second"), F.explode("others").alias("node")))
    gathered = members.join(sketches, "node").groupBy("unit").agg(F.collect_list(F.struct("second", "node", "n", "parity")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            ends = []
            for i in range(len(lists)):
                flat = lists[i].values
                second, nodes = flat.field("second").to_numpy(zero_copy_only=False), flat.field("node").to_numpy()
                prints = Parities(flat.field("n").to_numpy(), flat.field("parity").to_pylist())
                adjacent = np.zeros((len(nodes), len(nodes)), dtype=bool)
                for x, y, _ in prints.near(second, similarity):
                    adjacent[x, y] = adjacent[y, x] = True
                root = spanning_forest(adjacent)
                linked = np.nonzero((root >= 0) & (root != np.arange(len(root))))[0]
                ends.append((nodes[linked], nodes[root[linked]]))
            if ends:
                yield record("a long, b long", [pa.array(np.concatenate(x)) for x in zip(*ends)])
        tokens.release()

    return gathered.select("rows").mapInArrow(run, "a long, b long")


class Parities:
    """Parity fingerprints of several sets, by their length."""

    def __init__(self, sizes: np.ndarray, prints: list[bytes]):
        self.sizes = sizes
        lengths = np.array([len(p) for p in prints])
        self.rows = {n: np.nonzero(lengths == n)[0] for n in np.unique(lengths).tolist()}
        self.words = {n: np.frombuffer(b"".join(prints[i] for i in rows), dtype=np.uint64).reshape(len(rows), n // 8) for n, rows in self.rows.items()}

    def near(self, second: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows x, y and their differing bits, of all pairs that may be similar: of all rows, or of first and second ones."""
        two = bool(second.any())
        for n, rows in self.rows.items():
            for m, others in self.rows.items():
                if m < n:
                    continue
                # The longer fingerprint folded is what it would be with fewer bits.
                words = np.bitwise_xor.reduce(self.words[m].reshape(len(others), m // n, n // 8), axis=1)
                for x, y, bits in self.between(self.words[n], rows, words, others, similarity):
                    keep = second[x] != second[y] if two else (x < y if n == m else np.ones(len(x), dtype=bool))
                    yield x[keep], y[keep], bits[keep]

    def between(self, a: np.ndarray, rows: np.ndarray, b: np.ndarray, others: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        share = (1 - similarity) / (1 + similarity)
        ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
        by_a, by_b = np.argsort(ones_a, kind="stable"), np.argsort(ones_b, kind="stable")
        a, rows, ones_a, b, others, ones_b = a[by_a], rows[by_a], ones_a[by_a], b[by_b], others[by_b], ones_b[by_b]
        strip = max(1, min(STRIP_ROWS, (1 << 22) // max(1, b.size)))
        for i in range(0, len(a), strip):
            part, sizes = a[i : i + strip], self.sizes[rows[i : i + strip]]
            reach = int(share * sizes.max() * (1 + 1 / similarity) + 1e-6)
            low, high = np.searchsorted(ones_b, int(ones_a[i]) - reach), np.searchsorted(ones_b, int(ones_a[i + len(part) - 1]) + reach, side="right")
            if low == high:
                continue
            bits = np.bitwise_count(part[:, None] ^ b[None, low:high]).sum(axis=2, dtype=np.int64)
            both = sizes[:, None] + self.sizes[others[low:high]][None, :]
            x, y = np.nonzero(bits <= share * both + 1e-6)
            yield rows[i + x], others[low + y], bits[x, y]


def confirmed(texts: DataFrame, groups: DataFrame, width: int, similarity: float, check_sets: int = CHECK_SETS) -> DataFrame:
    """(a, b): links within each group of candidates (node, n, component, k1, k2) whose shingle sets really are as similar.

    A group larger than a tile is cut, and all pairs of its tiles are checked; shingles are hashed once, before. In a tile
    pair the nearest are checked first, and a pair already joined through others is not checked at all: groups stay the
    same, and a group of near copies costs about as many checks as it has members.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / check_sets), F.ceil(F.sum("n") / CHECK_SHINGLES)).cast("int")
    groups = groups.join(groups.groupBy("component").agg(parts.alias("parts")), "component")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = pa.array([own.tobytes() for own in distinct_shingles(batch.column("text"), width)], type=pa.binary())
            yield record(SETS, [batch.column(c) for c in ("node", "component", "parts")] + [shingles])

    rows = texts.join(groups, ["k1", "k2"]).select("node", "component", "parts", "text").mapInArrow(sets, SETS)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.select("node", "shingles", "component", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    units = rows.groupBy("component", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high")).agg(
        F.collect_list(F.struct((F.col("part") > F.col("with")).alias("second"), "node", "shingles")).alias("rows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            ends = []
            for i in range(len(lists)):
                flat = lists[i].values
                nodes = flat.field("node").to_numpy()
                root = joined(flat.field("second").to_numpy(zero_copy_only=False), [np.frombuffer(x, dtype=np.uint64) for x in flat.field("shingles").to_pylist()], similarity)
                linked = np.nonzero(root != np.arange(len(root)))[0]
                ends.append((nodes[linked], nodes[root[linked]]))
            if ends:
                yield record("a long, b long", [pa.array(np.concatenate(x)) for x in zip(*ends)])
        tokens.release()

    return units.select("rows").mapInArrow(run, "a long, b long")


SETS = "node long, component long, parts int, shingles binary"


def joined(second: np.ndarray, shingles: list[np.ndarray], similarity: float) -> np.ndarray:
    """Each set's root over links between sets, or between first and second ones, checked nearest first."""
    root = np.arange(len(shingles))
    pairs = list(Parities(np.array([len(s) for s in shingles]), [parity(s) for s in shingles]).near(second, similarity))
    if not pairs:
        return root
    x, y, bits = (np.concatenate(c) for c in zip(*pairs))
    order = np.argsort(bits, kind="stable")
    x, y = x[order], y[order]
    while len(x):
        for a, b in zip(x[:512].tolist(), y[:512].tolist()):
            if root[a] != root[b] and jaccard(shingles[a], shingles[b]) >= similarity:
                root[root == max(root[a], root[b])] = min(root[a], root[b])
        x, y = x[512:], y[512:]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return root


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns of a row; maps by their sorted entries."""
    columns = [F.array_sort(F.map_entries(docs[f.name])) if isinstance(f.dataType, MapType) else docs[f.name] for f in docs.schema.fields]
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile_sets: int = TILE_SETS, part_rows: int = PART_ROWS, check_sets: int = CHECK_SETS) -> DataFrame:
    """The rows that stay when each group of near-duplicates keeps the one with the smallest doc_id.

    Documents are near-duplicates when their sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or
    more, or through others that are; no such pair is missed (shingles and sets are told apart by hashes of 64 bits, rows of 128).
    Texts without words, empty or null, are one group. Rows that share a doc_id are documents of their own: only alike
    texts make a group. Where several rows of a group have its smallest doc_id, one of them stays, always the same; a null
    doc_id comes after all others. Of rows equal in all columns one stays. Very long texts make larger sets, and tiles
    hold fewer of them. An empty table stays empty; all columns stay.
    """
    shared_dir(docs.sparkSession)
    spark = docs.sparkSession
    k1, k2 = row_keys(docs)
    known = docs.withColumns({"__k1": k1, "__k2": k2})
    texts = known.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text", "doc_id")
    path = shared_path(spark, "shingle-sets")
    described(texts, width).write.parquet(path)
    found = spark.read.parquet(path)
    sets = found.filter("node is not null").select("doc_id", "k1", "k2", "node", "n")
    sketches = found.filter("node is not null").select("node", "n", "parity").dropDuplicates(["node"])
    levels = slot_levels(found.filter("slot is not null").select("slot", "times"))
    loose = components(candidates(units_of(tiles(texts, width, similarity, levels, tile_sets, part_rows), similarity), sketches, similarity)).checkpoint()
    # What stands for a set: any of its rows, by the same rule each time.
    chosen = sets.groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("k1", "k2")).alias("k"))
    groups = loose.join(chosen, "node").select("node", "n", "component", "k.*")
    # Rows equal in all columns share a key; only where there are any do texts have to be grouped.
    equal = sets.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2").checkpoint()
    some = equal.limit(1).count() > 0
    links = components(confirmed(texts.dropDuplicates(["k1", "k2"]) if some else texts, groups, width, similarity, check_sets))
    placed = sets.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("r"))
    keys = ["__k1", "__k2"]
    kept = first.select("r.k1", "r.k2").toDF(*keys).checkpoint()
    if not some:
        return known.join(kept, keys, "left_semi").select(*docs.columns)
    equal = equal.toDF(*keys)
    once = known.join(kept.join(equal, keys, "left_anti"), keys, "left_semi")
    again = known.join(kept.join(equal, keys, "left_semi"), keys, "left_semi").dropDuplicates(keys)
    return once.unionByName(again).select(*docs.columns)
