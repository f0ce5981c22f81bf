"""Which of several filters removes what, in every order they could be applied in.

Four filters look at one text; the fifth fails exact copies of an earlier text, wherever that stands. Texts are routed by
their xxhash in an RDD: a task first chains the texts that it reads, so that of its copies one is sent, and rows meet sorted
by (hash, doc_id), so that one hash's chain is held at a time and the first of equal texts has the smallest id. What a row
fails is a mask; masks are counted by part in vectors that combineByKey merges, and every order's counts follow from them.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.session import shared_dir

#: Bytes of texts that a task chains before it sends them on.
HELD_BYTES = 16 << 20
#: Bytes of texts for each task that sorts and judges them.
TASK_BYTES = 32 << 20
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = re.compile(rb"[#$%&*|]")


def few_words(text: str, data: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def few_distinct(text: str, data: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def upper_case(text: str, data: bytes, words: list[bytes]) -> bool:
    return 100 * (len(data) - len(data.translate(None, UPPER))) > 3 * len(text)


def has_signs(text: str, data: bytes, words: list[bytes]) -> bool:
    return SIGNS.search(data) is not None


#: Filters by letter: true where a text fails. They get the text, its UTF-8, and its words.
FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {"A": few_words, "B": few_distinct, "C": upper_case, "D": has_signs}
#: The letter of the filter that fails copies; its bit is the one above the others'.
COPY = "E"


class Chain:
    """Equal texts that a task has read: the smallest id so far, and how many rows of each part have it."""

    __slots__ = ("text", "doc_id", "mask", "rows", "seen")

    def __init__(self, text: str, mask: int):
        self.text, self.doc_id, self.mask, self.rows, self.seen = text, None, mask, Counter(), 0


def own_key(key: int, doc_id: int) -> int:
    """Where a decided row goes: anywhere, but not where all copies of its text would."""
    return xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=key & 0xFFFFFFFF)


def chained(rows: Iterator, filters: dict[str, Callable], held: int = HELD_BYTES) -> Iterator[tuple]:
    """((hash, no id, doc_id), (part, mask, times, text)) of a task's rows (doc_id, part, text); text is null where decided.

    A row is decided where the task has seen its text with a smaller id. Texts are sent when they fill the memory they
    may take; those seen more than once stay, so that copies met later are still decided without sending the text again.
    """
    copy_bit, chains, size = 1 << len(filters), {}, 0

    def sent(chain: Chain, key: int) -> Iterator[tuple]:
        for part, times in chain.rows.items():
            yield (key, chain.doc_id is None, chain.doc_id or 0), (part, chain.mask, times, chain.text)
        chain.rows = Counter()

    for doc_id, part, text in rows:
        data = text.encode()
        key = xxhash.xxh64_intdigest(data)
        chain = next((c for c in chains.get(key, ()) if c.text == text), None)
        if chain is None:
            words = data.split()  # bytes split at ASCII white space alone
            chain = Chain(text, sum(1 << i for i, fails in enumerate(filters.values()) if fails(text, data, words)))
            chains.setdefault(key, []).append(chain)
            size += len(data) + 500
            chain.doc_id = doc_id
        elif doc_id is None:
            # A row without an id is never a copy of anything, nor anything a copy of it.
            chain.seen += 1
            yield (own_key(key, chain.seen), True, 0), (part, chain.mask, 1, None)
            continue
        elif chain.doc_id is not None and doc_id > chain.doc_id:
            chain.seen += 1
            yield (own_key(key, doc_id), False, doc_id), (part, chain.mask | copy_bit, 1, None)
            continue
        elif chain.doc_id is None:
            yield from sent(chain, key)
            chain.doc_id = doc_id
        elif doc_id < chain.doc_id:
            chain.seen += 1
            for other, times in chain.rows.items():
                yield (own_key(key, chain.doc_id), False, chain.doc_id), (other, chain.mask | copy_bit, times, None)
            chain.rows, chain.doc_id = Counter(), doc_id
        chain.rows[part] += 1
        if size > held:
            kept, size = {}, 0
            for k, found in chains.items():
                for c in found:
                    yield from sent(c, k)
                    if c.seen and size < held // 2:
                        kept.setdefault(k, []).append(c)
                        size += len(c.text.encode()) + 500
                        c.seen = 0
            chains = kept
    for k, found in chains.items():
        for c in found:
            yield from sent(c, k)


def judged(rows: Iterator[tuple], copy_bit: int) -> Iterator[tuple]:
    """(doc_id, part, mask, times) of rows sorted by (hash, no id, doc_id): a hash's chain has its texts with their least id."""
    now, chain = None, []
    for (key, nameless, doc_id), (part, mask, times, text) in rows:
        if text is None or nameless:
            yield None if nameless else doc_id, part, mask, times
            continue
        if key != now:
            now, chain = key, []
        least = next((known for other, known in chain if other == text), None)
        if least is None:
            chain.append((text, doc_id))
        copy = least is not None and least < doc_id
        yield doc_id, part, mask | copy_bit if copy else mask, times


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def failures(docs: DataFrame, part: str = "lang", filters: dict[str, Callable] = FILTERS) -> RDD:
    """(doc_id, part, mask, times) of all rows of ``docs``: bit i of the mask is filter i, the highest is that of copies.

    A text is a copy if a smaller doc_id has the same text. Rows that share id and text are counted together and do not
    make each other copies; a null id is neither smaller nor larger than any; a null text or part is empty.
    """
    shared_dir(docs.sparkSession)
    copy_bit = 1 << len(filters)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).rdd
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(text_bytes(docs) / TASK_BYTES))
    routed = rows.mapPartitions(lambda part_rows: chained(part_rows, filters))
    ordered = routed.repartitionAndSortWithinPartitions(tasks, lambda key: key[0] % tasks)
    return ordered.mapPartitions(lambda part_rows: judged(part_rows, copy_bit))


def labelled(found: RDD, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of :func:`failures` with ``good`` and ``toxic``. Several labels of one id hold if any does."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(found, "doc_id long, part string, mask int, times long", verifySchema=False)
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    return rows.join(known, "doc_id", "left").select("part", "mask", "times", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def mask_vectors(rows: DataFrame, masks: int) -> RDD:
    """(part, vector): for each mask the number of documents, of good ones and of toxic ones."""

    def add(vector: np.ndarray, row) -> np.ndarray:
        mask, times, good, toxic = row
        vector[mask] += (times, times * good, times * toxic)
        return vector

    pairs = rows.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: add(np.zeros((masks, 3), np.int64), row), add, lambda a, b: a + b)


def reports(part: str, vector: np.ndarray, letters: str) -> Iterator[tuple]:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part's vector."""
    masks = np.arange(len(vector))
    rows, shapley = [], Counter()
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            fails, gone = (masks >> i & 1).astype(bool), (masks & before) != 0
            removed, good, toxic = (int(x) for x in vector[fails & ~gone].sum(axis=0))
            redundant, unique = int(vector[fails & gone, 0].sum()), int(vector[1 << i, 0])
            before |= 1 << i
            kept = int(vector[(masks & before) == 0, 0].sum())
            shapley[i] += removed
            rows.append((i, "".join(letters[k] for k in order), step, kept, removed, redundant, unique, good, toxic))
    for i, *row in rows:
        yield (part, *row, shapley[i])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step: what is kept, removed, failed in vain, failed alone, and lost.

    ``shapley`` is the number that a step's filter removes, summed over all orders. Nothing but one vector a part is
    gathered, in tasks. An empty table gives no rows. Other columns of ``docs`` and ``labels`` are left out.
    """
    letters = "".join(filters) + COPY
    rows = labelled(failures(docs, part, filters), docs, labels)
    found = mask_vectors(rows, 1 << len(letters)).flatMap(lambda pair: reports(*pair, letters))
    counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(found, f"part string, filter_order string, step int, {counts}", verifySchema=False)
