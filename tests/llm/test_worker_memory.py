"""What a worker holds while tasks run and between them, and that its bounds change no result."""

import collections
import platform
import random
import subprocess
import sys

import pyarrow as pa
import pytest

from auralake.llm import tokens, toxicity

HELD = """
import re
import numpy as np
from auralake.llm import tokens

def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", f.read())[1]) // 1024

blocks = [np.ones(10_000) for _ in range(2_000)]
last = blocks.pop()
del blocks
before = held()
tokens.release()
print(before - held())
"""


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="other C libraries have no malloc_trim")
def test_a_task_gives_back_what_the_c_library_holds():
    # 160 MB of freed blocks below one in use.
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=60, cwd=__file__.rpartition("/tests/")[0]).stdout
    assert int(out) > 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_library_encodes_few_pieces_at_once(name, monkeypatch):
    path = tokens.tokenizer_file(name)
    rnd, whole, sizes = random.Random(1), tokens.load(path), []
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(3_000)) for _ in range(5)]
    store = tokens.CaselessStore(path) if tokens.lowers(path) else tokens.PieceStore(path)
    runs = store.runs
    monkeypatch.setattr(store, "runs", lambda pieces: sizes.append(len(pieces)) or runs(pieces))
    ids, offsets = store.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) <= 4_096 < sum(sizes)


def test_toxicity_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(toxicity, "MET_WORDS", 100, raising=False)
    rnd, index, met = random.Random(1), {"aaab": 0, "bbbb*": 1, "ab": 2}, {}
    for _ in range(20):
        texts = [" ".join("".join(rnd.choices("ab", k=rnd.randint(2, 7))) for _ in range(20)) for _ in range(3)]
        rows, found, times, _ = toxicity.present(pa.array(texts), index, met)
        each = [collections.Counter(index[f] for w in t.split() for f in toxicity.features_of(w) if f in index) for t in texts]
        assert list(zip(rows.tolist(), found.tolist(), times.tolist())) == [(i, f, n) for i, c in enumerate(each) for f, n in sorted(c.items())]
        assert len(met) <= 100 + 61  # and a slice's own, of which this one has 60 and the empty word at most
