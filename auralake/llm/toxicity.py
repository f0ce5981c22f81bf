"""Non-negative positive-unlabelled learning of toxicity.

Confirmed toxic texts are the positives; any other text of the training fold is unlabelled, toxic or not. With the class
prior ``p``, the risk of a classifier ``f`` is ``p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])``: the second part is what
clean texts would cost, estimated without one clean label and kept from going below zero, where it only fits noise.

Features are words and word beginnings that a text holds at least so many times. Those of the positives are counted over all
unlabelled texts in parallel, and those clearly commoner among positives are kept. A logistic model is fitted to them in
numpy, its risk over all unlabelled texts: texts with the same features are one row with a count, which leaves few. Its
bias is such that unlabelled texts' mean score is the prior.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from auralake.llm import tokens
from auralake.session import shared_dir

#: Labelled toxic documents that the fit takes at most, the first by their id's hash; and the model's size in features.
POSITIVES, FEATURES = 8_000, 4_096
#: Numbers in the unlabelled texts' distinct feature sets up to which the driver sums their risk; beyond, tasks do.
DRIVER_VALUES = 2_000_000
#: Beginnings of words that count as features, by their letters.
BEGINNINGS = (4, 5, 6)
#: Occurrences from which a feature holds, each a feature of its own.
LEVELS = (1, 2, 3, 5)
#: How much commoner a feature must be among positives, and the log likelihood ratio of its count to the one expected from
#: unlabelled texts: among millions of words, chance reaches a ratio of 10 for a few dozen at most.
LIFT, EVIDENCE = 3.0, 10.0
#: Characters of texts whose features are found at once; and where all features count, not only a model's.
SLICE_CHARS, OPEN_CHARS = 4_000_000, 1_000_000
#: Words whose features a task remembers; then it starts afresh. Bounds memory, never results.
MET_WORDS = 300_000
STEPS, RATE, DECAY = 400, 0.1, 1e-4


@dataclass
class Model:
    """Weights of the features that matter, and the score of a text that has none of them."""

    bias: float = -30.0
    weights: dict[tuple[str, int], float] = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: the crc32 of the id's text leaves remainder 2 by 4. A null id is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Each text's runs of letters in lower case, as offsets and a dictionary; runs may be empty words."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\pL]+", " ")
    lists = pc.split_pattern(spaced, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return offsets - offsets[0], lists.flatten().dictionary_encode()


def present(texts: pa.Array, index: dict[str, int] | None, met: dict[str, tuple[int, ...]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text, feature, occurrences) without repeats, sorted by text; with ``index`` only the features it numbers.

    ``met`` keeps the features of words that a task has met before.
    """
    offsets, found = words(texts)
    vocabulary, codes = found.dictionary.to_pylist(), np.asarray(found.indices)
    names: dict[str, int] = {} if index is None else index
    lists = []
    met = {} if met is None else met
    if len(met) > MET_WORDS:
        met.clear()
    for word in vocabulary:
        own = met.get(word)
        if own is None:
            own = features_of(word) if word else []
            own = met[word] = tuple([names.setdefault(f, len(names)) for f in own] if index is None else [names[f] for f in own if f in names])
        lists.append(own)
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((f for own in lists for f in own), dtype=np.int64, count=int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    matter = sizes[codes] > 0
    codes, text_of = codes[matter], text_of[matter]
    n = sizes[codes]
    at = np.repeat(starts[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pairs, times = np.unique(np.repeat(text_of, n) * max(1, len(names)) + flat[at], return_counts=True)
    return *np.divmod(pairs, max(1, len(names))), times, list(names)


def levelled(rows: np.ndarray, found: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number of feature and level) for all levels reached, sorted by text."""
    pairs = [np.stack([rows[times >= least], found[times >= least] * len(LEVELS) + i]) for i, least in enumerate(LEVELS)]
    rows, found = np.concatenate(pairs, axis=1)
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


def counts(texts: DataFrame, index: dict[str, int] | None) -> DataFrame:
    """(feature, level, n): texts in which a feature reaches a level; with ``index`` only of the features it numbers."""

    def counted(names: list[str], n: np.ndarray) -> pa.RecordBatch:
        seen = np.nonzero(n)[0]
        features = pa.array(names, type=pa.string()).take(pa.array(seen // len(LEVELS)))
        return pa.record_batch([features, pa.array((seen % len(LEVELS)).astype(np.int32)), pa.array(n[seen])], names=["feature", "level", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(len(index or ()) * len(LEVELS), dtype=np.int64), {}
        for batch in batches:
            text = tokens.plain(batch.column("text"))
            for a, b in tokens.slices(text, OPEN_CHARS if index is None else SLICE_CHARS):
                rows, found, times, names = present(text.slice(a, b - a), index, None if index is None else met)
                found = levelled(rows, found, times)[1]
                if index is None:
                    yield counted(names, np.bincount(found, minlength=len(names) * len(LEVELS)))
                else:
                    total += np.bincount(found, minlength=len(total))
        if index:
            yield counted(list(index), total)
        tokens.release()

    each = texts.select("text").mapInArrow(run, "feature string, level int, n long")
    return each.groupBy("feature", "level").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the training fold of (doc_id, text) and (doc_id, toxic).

    A document labelled twice is toxic if one of its labels says so; null labels say nothing. Without confirmed toxic
    documents every text scores zero. All texts of the fold are unlabelled ones of the risk, repeats as often as they
    come, empty and null ones without features, very long ones as one text each.
    """
    shared_dir(docs.sparkSession)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not n_toxic:
        return Model()
    prior = n_toxic / n_known
    texts = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    toxic = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).select("doc_id")
    # No more ids than POSITIVES: broadcast, so that no text is shuffled to find them.
    positive = texts.join(F.broadcast(toxic), "doc_id", "left_semi").select("text").checkpoint()
    n_p, n_u = positive.count(), texts.count()
    if not n_p:
        return Model()
    strength = lambda expected: F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
    clear = lambda expected: (F.col("p") >= LIFT * expected) & (strength(expected) >= EVIDENCE)
    # What is not clear where no unlabelled text has it is never clear. The rest is counted in all of them.
    among = counts(positive, None).withColumnRenamed("n", "p").filter(clear(F.lit(n_p * 0.5 / n_u))).checkpoint()
    index = {r["feature"]: i for i, r in enumerate(among.select("feature").distinct().collect())}
    unlabelled_too = among.join(counts(texts, index).withColumnRenamed("n", "u"), ["feature", "level"], "left").fillna(0, ["u"])
    expected = n_p * (F.col("u") + 0.5) / n_u
    evidence, kept = strength(expected), unlabelled_too.filter(clear(expected))
    chosen = sorted(longest_of_each(kept.orderBy(F.desc(evidence), "feature", "level").limit(FEATURES).select("feature", "level", "p", "u").collect()))
    index = {f: i for i, f in enumerate(dict.fromkeys(f for f, _ in chosen))}
    columns = {index[f] * len(LEVELS) + level: i for i, (f, level) in enumerate(chosen)}
    of_positives = Counted.of(feature_sets(positive, index, columns).collect())
    rows = feature_sets(texts, index, columns).checkpoint()
    if (rows.agg(F.sum(F.size("features") + 2)).first()[0] or 0) <= DRIVER_VALUES:
        of_unlabelled = Counted.of(rows.collect()).sums
    else:
        of_unlabelled = summed_by_tasks(rows)
    weights, bias = non_negative_fit(of_positives, of_unlabelled, n_u, len(chosen), prior)
    return Model(bias, {feature: float(w) for feature, w in zip(chosen, weights)})


def longest_of_each(rows: list) -> list[tuple[str, int]]:
    """(feature, level) without those that hold in just the same texts as another: of a word and its beginnings the longest.

    All texts with a word have its beginnings, and all that reach a level reach those below; so equal numbers mean equal texts.
    """
    out: list[tuple[str, int]] = []
    by_numbers: dict[tuple, list] = {}
    for feature, level, p, u in sorted(rows, key=lambda r: (-len(r[0].rstrip("*")), r[0], r[1])):
        others = by_numbers.setdefault((p, u), [])
        stem = feature[:-1] if feature.endswith("*") else None
        if not any(f == feature or stem is not None and len(f.rstrip("*")) > len(stem) and f.startswith(stem) for f in others):
            others.append(feature)
            out.append((feature, level))
    return out


def feature_sets(texts: DataFrame, index: dict[str, int], columns: dict[int, int]) -> DataFrame:
    """(features, n): the sets of the model's features that texts have, and how many texts have just these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            text, found = tokens.plain(batch.column("text")), {}
            for a, b in tokens.slices(text, SLICE_CHARS):
                rows, own = levelled(*present(text.slice(a, b - a), index, met)[:3])
                column = np.array([columns.get(f, -1) for f in own.tolist()], dtype=np.int32)
                rows, column = rows[column >= 0], column[column >= 0]
                ends = np.searchsorted(rows, np.arange(b - a + 1))
                for x, y in zip(ends[:-1], ends[1:]):
                    key = np.sort(column[x:y]).tobytes()
                    found[key] = found.get(key, 0) + 1
            lists = pa.array([np.frombuffer(k, dtype=np.int32) for k in found], type=pa.list_(pa.int32()))
            yield pa.record_batch([lists, pa.array(list(found.values()), type=pa.int64())], names=["features", "n"])
        tokens.release()

    return texts.select("text").mapInArrow(run, "features array<int>, n long").groupBy("features").agg(F.sum("n").alias("n"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass
class Counted:
    """Feature sets with how often each occurs."""

    rows: np.ndarray
    columns: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, found: list) -> Counted:
        """From rows (features, n), sorted, so that the same rows give the same sums."""
        found = sorted((list(r[0]), r[1]) for r in found)
        sizes = np.array([len(f) for f, _ in found], dtype=np.int64)
        return cls(np.repeat(np.arange(len(found)), sizes), np.array([x for f, _ in found for x in f], dtype=np.int64), np.array([n for _, n in found], dtype=np.float64))

    def margin(self, theta: np.ndarray) -> np.ndarray:
        """``f`` of each set: its features' weights and the bias, which is the last of ``theta``."""
        return np.bincount(self.rows, weights=theta[self.columns], minlength=len(self.times)) + theta[-1]

    def slope(self, each: np.ndarray, n: int) -> np.ndarray:
        """What sets' derivatives by their margin mean for ``theta``."""
        each = each * self.times
        return np.append(np.bincount(self.columns, weights=each[self.rows], minlength=n), each.sum())

    def sums(self, theta: np.ndarray) -> np.ndarray:
        """The loss of taking all for clean, ``log(1 + exp(f))``, and its derivatives: sums over all texts."""
        z = self.margin(theta)
        return np.append(np.logaddexp(0, z) @ self.times, self.slope(sigmoid(z), len(theta) - 1))


def summed_by_tasks(rows: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """:meth:`Counted.sums` of all rows, each task summing its own: for more feature sets than the driver should hold."""

    def sums(theta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(theta) + 1)
            for batch in batches:
                total += Counted.of(list(zip(batch.column("features").to_pylist(), batch.column("n").to_pylist()))).sums(theta)
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        found = rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([r["x"] for r in sorted(found, key=lambda r: r["i"])])

    return sums


def risk_and_slope(theta: np.ndarray, positive: Counted, of_unlabelled: np.ndarray, n_unlabelled: int, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' part of the risk, the rest (what clean texts would cost), and where to go from ``theta``.

    ``of_unlabelled`` are the sums at ``theta``. Where the rest is below zero, the estimate is wrong: it alone is pushed up.
    """
    n, n_p = len(theta) - 1, positive.times.sum()
    z = positive.margin(theta)
    as_positive, as_negative = prior * (np.logaddexp(0, -z) @ positive.times) / n_p, prior * (np.logaddexp(0, z) @ positive.times) / n_p
    rest = of_unlabelled[0] / n_unlabelled - as_negative
    slope = of_unlabelled[1:] / n_unlabelled - prior * positive.slope(sigmoid(z), n) / n_p
    return as_positive, rest, prior * positive.slope(-sigmoid(-z), n) / n_p + slope if rest >= 0 else -slope


def non_negative_fit(positive: Counted, of_unlabelled: Callable[[np.ndarray], np.ndarray], n_unlabelled: int, n: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model under the non-negative risk, by full gradients with momentum and scaling."""
    theta, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior)) if prior < 1 else 0.0
    for step in range(1, steps + 1):
        slope = risk_and_slope(theta, positive, of_unlabelled(theta), n_unlabelled, prior)[2]
        slope[:n] += DECAY * theta[:n]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    # The fit ranks texts; its bias is moved until unlabelled texts score the prior on average.
    low, high, bias = -40.0, 40.0, theta[n]
    for _ in range(40):
        theta[n] = bias + (low + high) / 2
        low, high = (low, (low + high) / 2) if of_unlabelled(theta)[-1] / n_unlabelled > prior else ((low + high) / 2, high)
    return theta[:n], float(bias + low)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with ``toxicity``, from 0 to 1; a column of that name is replaced.

    A null text is empty; an empty text scores as any text without features does. Rows are scored one by one, so repeats
    and null ids need no care. An empty table stays empty.
    """
    index = {f: i for i, f in enumerate(dict.fromkeys(f for f, _ in model.weights))}
    weights, bias = np.zeros(len(index) * len(LEVELS) + 1), model.bias
    for (f, level), w in model.weights.items():
        weights[index[f] * len(LEVELS) + level] = w
    docs = docs.drop("toxicity")
    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            text = tokens.plain(batch.column("text"))
            for a, b in tokens.slices(text, SLICE_CHARS):
                rows, found = levelled(*present(text.slice(a, b - a), index, met)[:3])
                margin = bias + np.bincount(rows, weights=weights[found], minlength=b - a)
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.array(0.5 * (1 + np.tanh(margin / 2)))], names=[*batch.schema.names, "toxicity"])
        tokens.release()

    return docs.mapInArrow(run, schema)
