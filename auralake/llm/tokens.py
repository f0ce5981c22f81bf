"""Token ids of whole texts, one distinct piece at a time.

Both public BPE vocabularies split a text into words before they merge anything. Two kinds of places are always such word
ends: before a single space between two other characters, and between a Latin letter and an ASCII character that is no
letter. A text cut there gives the same ids piece by piece. Pieces repeat, so a task cuts a batch of texts, encodes only the pieces
it has not met before with the tokenizer's own library, and gathers ids by numpy.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A Latin letter (not U+0130, whose lower case ends in a mark), then an ASCII character that ends the word for either
#: vocabulary. Not the bar, which stands inside the names of special tokens.
WORD_END = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])([\t\n!-@\\[-`{}~])"
#: Where Python's white space (a superset of the vocabularies') allows a cut.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
MARK = "\x00"
#: Pieces beside which a cut is not safe: empty ones, and those with white space at an end besides one leading space or tab.
SPACE = "[\\s\\x0b\\x1c-\\x1f\u0085\\pZ]"
UNSAFE = f"^$|{SPACE}$|^ {SPACE}|^[\\r\\x0b\\x0c\\x1c-\\x1f\u0085]"
#: Characters of text that a worker cuts at once, and pieces that the library encodes at once: its encodings are many times their size.
SLICE_CHARS, ENCODED_PIECES = 8_000_000, 4_096


def tokenizer_file(name: str) -> str:
    """Where the named public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer. One thread: Spark already runs one task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Offsets of each text's pieces, and the pieces. Joined, a text's pieces are the text; an empty text has one, empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    marked = pc.replace_substring(texts, " ", MARK + " ")
    marked = pc.replace_substring_regex(marked, WORD_END, "\\1" + MARK + "\\2")
    lists = pc.split_pattern(marked, MARK)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    pieces = lists.flatten().dictionary_encode()
    odd = np.asarray(pc.match_substring_regex(pieces.dictionary, UNSAFE), dtype=bool)
    again = np.array(pc.match_substring(texts, MARK), dtype=bool)
    if odd.any():
        odd_at = np.concatenate([[0], np.cumsum(odd[np.asarray(pieces.indices)])])
        again |= odd_at[offsets[1:]] - odd_at[offsets[:-1]] > 0
    if again.any():
        # White space beside a cut, or a mark in the text itself: such texts are cut again, by the stricter rule.
        whole_lists = lists.to_pylist()
        for i in np.nonzero(again)[0]:
            whole_lists[i] = SAFE_CUT.split(texts[int(i)].as_py())
        lists = pa.array(whole_lists, type=pa.list_(pa.string()))
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        pieces = lists.flatten().dictionary_encode()
    return offsets, pieces


class PieceStore:
    """Per distinct piece a run of values, remembered across batches: token ids here; subclasses keep other runs."""

    dtype = np.uint32
    #: Distinct pieces remembered; then it starts afresh. Bounds memory, never results.
    kept = 500_000

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = load(path)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.values = np.zeros(1 << 18, dtype=self.dtype)
        self.used = 0

    def key(self, piece: str) -> str:
        """What stands for the piece among those remembered."""
        return piece

    def runs(self, pieces: list[str]) -> list:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def slots_of(self, pieces: list[str]) -> np.ndarray:
        pieces = list(map(self.key, pieces)) if type(self).key is not PieceStore.key else pieces
        found = list(map(self.slots.get, pieces))
        missing = list(dict.fromkeys(p for p, s in zip(pieces, found) if s is None))
        if missing and len(self.slots) + len(missing) > self.kept and self.slots:
            self.clear()
            return self.slots_of(pieces)
        for at in range(0, len(missing), ENCODED_PIECES):
            self.learn(missing[at : at + ENCODED_PIECES])
        if missing:
            found = [self.slots[p] if s is None else s for p, s in zip(pieces, found)]
        return np.array(found, dtype=np.int64)

    def learn(self, missing: list[str]) -> None:
        runs = self.runs(missing)
        lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        n, total = len(self.slots), int(lengths.sum())
        self.starts, self.lengths = room(self.starts, n + len(runs)), room(self.lengths, n + len(runs))
        self.values = room(self.values, self.used + total)
        self.starts[n : n + len(runs)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(runs)] = lengths
        self.values[self.used : self.used + total] = np.fromiter(chain.from_iterable(runs), dtype=self.dtype, count=total)
        self.used += total
        self.slots.update(zip(missing, range(n, n + len(runs))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' values in a row, and the offsets of each text's."""
        if len(texts) == 0:
            return np.zeros(0, dtype=self.dtype), np.zeros(1, dtype=np.int64)
        offsets, pieces = cut(texts)
        # By numpy: Arrow's own to_pylist makes a scalar of each piece first.
        slots = self.slots_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(pieces.indices)]
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        take = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        take += np.repeat(self.starts[slots] - (ends - lengths), lengths)
        return self.values[take], np.concatenate([[0], ends])[offsets]


class CaselessStore(PieceStore):
    """For a vocabulary that lower-cases and drops white space: one run for all spellings of an ASCII piece.

    A word of plain lower-case letters passes normalizer and word splitter unchanged, so it goes to the library's model at
    once.
    """

    kept = 700_000

    def key(self, piece: str) -> str:
        return piece.strip(" ").lower() if piece.isascii() and "<|" not in piece else piece

    def runs(self, pieces: list[str]) -> list:
        model = self.tokenizer.model.tokenize
        plain = [p.isascii() and p.isalpha() and p.islower() for p in pieces]
        rest = iter(super().runs([p for p, is_word in zip(pieces, plain) if not is_word]))
        return [[t.id for t in model(p)] if is_word else next(rest) for p, is_word in zip(pieces, plain)]


def release() -> None:
    """Gives memory that Arrow and the C library hold ready back to the machine: a worker may idle for long after a task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's; it keeps freed blocks below any that is in use
        trim(0)


def room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


_stores: dict[tuple, PieceStore] = {}


def store(path: str, kind: type[PieceStore] | None = None) -> PieceStore:
    """The worker's store for a tokenizer; workers outlive tasks, and so does what they have learnt."""
    if (path, kind) not in _stores:
        _stores[path, kind] = (kind or (CaselessStore if lowers(path) else PieceStore))(path)
    return _stores[path, kind]


def lowers(path: str) -> bool:
    """Whether a tokenizer file's normalizer lower-cases and its splitter drops white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(x["type"] == "Lowercase" for x in steps) and any(x.get("behavior") == "Removed" for x in splits)


def slices(texts: pa.Array, chars: int = SLICE_CHARS):
    """Runs of rows that hold about so many characters, so that a batch's size in memory is bounded by one text's."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + chars, side="right")))
        yield start, end
        start = end


def plain(column) -> pa.Array:
    """A column of a batch as one array of short-offset strings."""
    return column.cast(pa.string()) if column.type != pa.string() else column
