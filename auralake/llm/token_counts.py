"""Exact token counts at every prefix of a text.

The count of a prefix is the count at the last word's start plus the count of what the prefix has of that word. Word
starts never depend on what follows, so both parts are exact, and a text's counts are running sums of its words' own.

Inside a word a second recurrence runs over bytes: the ids of a prefix are those of a shorter prefix and one more token,
and of all tokens that end the prefix exactly one may follow the shorter prefix's last token. Whether one token may follow
another is decided once by merging both.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.llm import tokens

#: Words that the tokenizer's splitter never splits, nor any of their prefixes: letters, digits or signs without apostrophe.
SIMPLE = re.compile(r" ?(?:[^\W\d_]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)\Z")

#: Words of pieces with several that a worker remembers; then it starts afresh.
WORDS_KEPT = 200_000
#: Words whose prefixes are two words: the only ones, besides white space, that are not prefixes of words all along.
SHORTENED = ("'re", "'ve", "'ll", "'s", "'t", "'m", "'d")
#: Runs of what the splitter takes for white space. A run is one word as long as nothing follows it; then its last
#: character leaves it.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")

#: Characters of text worked on at once; each has a value here.
SLICE_CHARS = 3_000_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_tokens binary, tokens_before long, chars_within long"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of all prefixes of one word, by dynamic programming over its bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.longest = max(map(len, self.vocabulary))
        self.letters = byte_letters()
        self.plain = {i: c for i, c in self.letters.items() if i < 128}
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The vocabulary's tokens of a word, by its merges in order of rank."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, i: int, b: str, j: int) -> bool:
        """Whether token ``b`` stays itself behind token ``a``, or at a word's start where ``a`` is empty; i, j: their ids."""
        found = self.follows.get(i << 20 | j)
        if found is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            found = self.follows[i << 20 | j] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def counts(self, word: str) -> list[int]:
        """Tokens of each prefix of the word, by code points."""
        spelt = word.translate(self.plain) if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        vocabulary, follows = self.vocabulary, self.follows
        last, ids, count = [""], [(1 << 20) - 1], [0]
        for end in range(1, len(spelt) + 1):
            # The whole prefix, then the shortest ending first: most tokens are short, and just one fits.
            for start in (*((0,) if end <= self.longest else ()), *range(end - 1, max(0, end - self.longest - 1), -1)):
                token = spelt[start:end]
                j = vocabulary.get(token)
                if j is None:
                    continue
                known = follows.get(ids[start] << 20 | j)
                if self.may_follow(last[start], ids[start], token, j) if known is None else known:
                    last.append(token)
                    ids.append(j)
                    count.append(count[start] + 1)
                    break
        if len(spelt) == len(word):
            return count[1:]
        ends = np.cumsum([len(c.encode()) for c in word])
        return [count[e] for e in ends]


class PrefixStore(tokens.PieceStore):
    """Per distinct piece the change of the token count at each of its code points."""

    dtype = np.int16
    kept = 900_000

    def __init__(self, path: str):
        super().__init__(path)
        self.counter = PrefixCounter(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        #: Special tokens stand for themselves wherever their text is complete.
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.words: dict[str, list[int]] = {}
        #: A tokenizer that changes texts, or whose special tokens look around them, has all its prefixes encoded by the library.
        self.by_words = self.tokenizer.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added)

    def by_library(self, piece: str) -> list[int]:
        counts: list[int] = []
        while len(counts) < len(piece):  # a few prefixes at once where they are long
            more = range(len(counts) + 1, min(len(piece), len(counts) + max(1, SLICE_CHARS // len(piece))) + 1)
            counts += [len(e) for e in self.tokenizer.encode_batch_fast([piece[:end] for end in more], add_special_tokens=False)]
        return counts

    def of_word(self, word: str) -> list[int]:
        own = self.words.get(word)
        if own is None:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            own = self.words[word] = self.by_library(word) if word in SHORTENED else self.counter.counts(word)
        return own

    def of_words(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special tokens, from its words as the tokenizer itself splits them."""
        counts, before, total = [], {}, 0
        for _, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if text else ():
            before[start] = total
            counts += [total + c for c in self.of_word(text[start:end])]
            total = counts[-1]
        for run in SPACES.finditer(text):
            counts[run.start() : run.end()] = [before[run.start()] + c for c in self.counter.counts(run[0])]
        return counts

    def of_piece(self, piece: str) -> list[int]:
        """Tokens of each prefix. Until a special token is complete, its beginning is text like any other."""
        counts, start, total = [], 0, 0
        for found in self.special.finditer(piece) if self.special else ():
            counts += [total + c for c in self.of_words(piece[start : found.end() - 1])]
            total = 1 + (counts[found.start() - 1] if found.start() > start else total)
            counts.append(total)
            start = found.end()
        return counts + [total + c for c in self.of_words(piece[start:])]

    def runs(self, pieces: list[str]) -> list:
        one = self.counter.counts
        if self.by_words:
            found = [one(p) if SIMPLE.match(p) else self.of_piece(p) for p in pieces]
        else:
            found = map(self.by_library, pieces)
        # A change beyond 16 bits would take a single word of as many tokens; none merges so far back.
        return [[b - a for a, b in zip([0, *counts], counts)] for counts in found]


def prefix_counts(docs: DataFrame, tokenizer: str, chars: int = 1024, budget: int = 1024, prefixes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix_tokens, tokens_before, chars_within) of every whole text.

    ``prefix_tokens`` holds the change of the exact token count at each code point, as one signed byte each or, where one
    does not suffice, as four; its first byte says how many. :func:`tokens_before` and :func:`longest_within` read it. Two
    answers come along: the tokens of the first ``chars`` code points (of all where there are fewer), and the code points
    of the longest prefix of at most ``budget`` tokens. Without ``prefixes`` only the answers are kept, and ``prefix_tokens``
    is null. A null text is empty: no bytes, no tokens. Very long texts are
    worked on by themselves, words without a place to cut by the tokenizer's own words. Repeated rows are each counted; a
    null doc_id is kept. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokens.store(tokenizer, PrefixStore)
        for batch in batches:
            texts = tokens.plain(batch.column("text"))
            for a, b in tokens.slices(texts, SLICE_CHARS):
                part = texts.slice(a, b - a)
                changes, offsets = counter.encode(part)
                sums = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
                start, end = offsets[:-1], offsets[1:]
                n_tokens, before = sums[end] - sums[start], sums[np.minimum(start + chars, end)] - sums[start]
                within = end - start
                for i in np.nonzero(n_tokens > budget)[0]:
                    within[i] = np.nonzero(sums[start[i] : end[i]] - sums[start[i]] <= budget)[0][-1]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pc.fill_null(pc.binary_length(part), 0).cast(pa.int64()), pa.array(n_tokens), packed(changes, offsets) if prefixes else pa.nulls(b - a, pa.binary()), pa.array(before), pa.array(within)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def packed(changes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each text's changes behind one byte that gives their width."""
    if not len(changes) or (changes.min() >= -128 and changes.max() <= 127):
        flat = np.insert(changes.astype(np.int8), offsets[:-1], 1)
        ends = (offsets + np.arange(len(offsets))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
    rows = (changes[a:b] for a, b in zip(offsets[:-1], offsets[1:]))
    narrow = lambda x: not len(x) or (x.min() >= -128 and x.max() <= 127)
    return pa.array([b"\x01" + x.astype(np.int8).tobytes() if narrow(x) else b"\x04" + x.astype("<i4").tobytes() for x in rows], type=pa.binary())


def unpacked(value: bytes) -> np.ndarray:
    """Token counts of all prefixes, the empty one first."""
    changes = np.frombuffer(value, dtype=np.int8 if value[0] == 1 else "<i4", offset=1)
    return np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])


def tokens_before(prefix_tokens: Column, chars: Column) -> Column:
    """Exact tokens of the text's first ``chars`` code points; of the whole text where it has fewer."""

    @F.pandas_udf("long")
    def read(values: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or pd.isna(n) else int(unpacked(v)[min(int(n), (len(v) - 1) // v[0])]) for v, n in zip(values, ends)], dtype="Int64")

    return read(prefix_tokens, chars)


def longest_within(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of the longest prefix that has at most ``budget`` tokens; null for a negative budget."""

    @F.pandas_udf("long")
    def read(values: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or pd.isna(n) or n < 0 else int(np.nonzero(unpacked(v) <= n)[0][-1]) for v, n in zip(values, budgets)], dtype="Int64")

    return read(prefix_tokens, budget)
