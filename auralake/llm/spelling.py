"""Spelling variants: words one edit apart, found by their three rarest bigrams.

An edit touches at most two bigrams of a word, so of the three that are rarest in one global order two words one edit apart
share at least one, at places that differ by no more than the edit moves them. The edit then lies wholly before or wholly
behind the shared bigram, and in one half of what stands there; all else is equal. That rest is what words are joined on, so
only words that agree in all but half a side meet, and every pair is verified.

The order is over bigrams, not over bigrams at places: an insertion moves places, which must not change a bigram's rank.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm import tokens
from auralake.session import shared_dir

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
#: Words that a task counts before it hands its sums on.
HELD = 300_000
#: Bigrams of a word that are joined: one more than an edit can touch.
RAREST = 3


def typed(doc_id: object, words: Counter, every: int) -> Iterator[tuple[str, int]]:
    """A document's words with their counts; where ``every`` divides the crc32 of ``<doc_id>:<word>``, one code point is gone."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in words.items():
        h = zlib.crc32(word.encode(), head)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters of whole texts with A-Z lower-cased, planted slips included, that are long and frequent enough.

    Tasks sum what they read before anything is shuffled. A null text has no words, a null doc_id is written as nothing;
    rows that are repeated count again. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            texts = tokens.plain(batch.column("text"))
            for a, b in tokens.slices(texts):
                for doc_id, text in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()):
                    # Lower-casing bytes changes A-Z alone.
                    for word, n in typed(doc_id, Counter(RUN.findall((text or "").encode().lower().decode())), every):
                        if len(word) >= shortest:
                            sums[word] = sums.get(word, 0) + n
                    if len(sums) >= HELD:
                        yield pa.record_batch([pa.array(list(sums)), pa.array(list(sums.values()))], names=["word", "n"])
                        sums = {}
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Each bigram's place in the order of rarity among distinct words. The alphabet bounds them: 90 letters make 8,100."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counts = grams.groupBy("gram").count().collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["gram"])))}


def meeting_places(word: str, ranks: dict[str, int], longer: bool) -> set[str]:
    """What a word shares with any word one edit away that shares one of its rarest bigrams.

    ``longer`` gives the places at which it meets words one code point shorter, otherwise those for words of its own length
    or longer. A place names the shorter length, the bigram's place from the side it is counted from, and the text that is
    equal: all but the half of the side with the edit.
    """
    extra = 1 if longer else 0
    length, places = len(word) - extra, set()
    for at in sorted(range(len(word) - 1), key=lambda i: (ranks[word[i : i + 2]], i))[:RAREST]:
        behind, before = len(word) - at - 2 - extra, at - extra
        if behind >= 0:
            half, start = behind // 2, at + 2
            places.add(f"{length}|{at}>{word[: start + half]}|")
            places.add(f"{length}|{at}>{word[:start]}|{word[start + half + extra :]}")
        if before >= 0:
            half = before // 2
            places.add(f"{length}|{before}<{word[half + extra :]}|")
            places.add(f"{length}|{before}<{word[at:]}|{word[:half]}")
    return places


def postings(words: DataFrame, ranks: dict[str, int], longer: bool) -> DataFrame:
    """(place, word, n), one row for each place at which a word meets others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows = [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                found = meeting_places(word, ranks, longer)
                places += found
                rows += [i] * len(found)
            taken = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(places, pa.string()), batch.column("word").take(taken), batch.column("n").take(taken)], names=["place", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "place string, word string, n long").select(F.xxhash64("place").alias("place"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of distinct words (word, n) that are exactly one edit apart.

    Words have two code points or more. A word has a bounded number of near words (each is one edit over a bounded
    alphabet), so no pair list grows with the corpus but by its words. Places are joined by hash; edits are verified.
    """
    ranks = bigram_ranks(words)
    base, longer = postings(words, ranks, False), postings(words, ranks, True)
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    of = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in "ab" for name in ("word", "n")]
    same = base.alias("a").join(base.alias("b"), (F.col("a.place") == F.col("b.place")) & (F.col("a.word") < F.col("b.word")) & one_edit).select(of)
    grown = base.alias("a").join(longer.alias("b"), (F.col("a.place") == F.col("b.place")) & one_edit).select(of)
    pairs = same.unionByName(grown).distinct()
    both = F.explode(F.array(F.struct(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b_word").alias("word"), F.col("b_n").alias("n"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each round doubles how far a word has been followed.

    A form occurs at least twice as often as its word, so a chain ends and has no more links than counts have bits.
    """
    reached = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = reached.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")).checkpoint()
        reached = step.drop("moved")
        if step.filter("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every long and frequent word of ``docs`` (doc_id, text).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) where it occurs ``ratio`` times as often
    as the word, else null; ``root`` the last word that forms lead to. ``shortest`` is 4 or more, so that a word has three
    bigrams. Empty tables, and tables without such words, give no rows.
    """
    shared_dir(docs.sparkSession)
    if shortest <= RAREST:
        raise ValueError(f"words must have more than {RAREST} code points")
    words = word_counts(docs, every, shortest, least).checkpoint()
    # The largest n comes first, then the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).checkpoint()
    leads = -F.col("best.order") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.order")).alias("form_n"))
    found = words.join(near, "word", "left").join(roots(near.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
