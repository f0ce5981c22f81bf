"""The pipeline's stages against brute force on the smallest tables, each over all that the one before kept."""

import collections
import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from auralake.llm import tokens
from auralake.llm.queries import MIX_SEED, QUERIES, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect(), docs.columns)
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "mixing", "packing"]
    assert all(sorted(kept[n][2]) == sorted(columns) for n in ("toxicity", "simhash", "mixing"))

    before, after, _ = kept["toxicity"]
    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - toxic

    before, after, _ = kept["simhash"]
    sets = {}
    for r in before:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
    group = {d: d for d in sets}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == sorted({find(d) for d in ids})

    before, after, _ = kept["mixing"]
    counts = collections.Counter(r.source for r in before)
    weights = {s: math.sqrt(n) for s, n in counts.items()}
    want = collections.Counter()
    for r in before:
        rate = weights[r.source] / sum(weights.values()) * len(before) / counts[r.source]
        u = int(hashlib.sha1(f"{MIX_SEED}|draw|{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        want[r.doc_id] = k
    assert collections.Counter(r.doc_id for r in after) == +want

    before, pieces, _ = kept["packing"]
    tokenizer = tokens.load(tokens.tokenizer_file("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in before}
    copies = collections.Counter(r.doc_id for r in before)
    covered = collections.Counter()
    for p in pieces:
        assert zlib.crc32(p.ids) == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        covered[p.doc_id] += p.length
    assert covered == {d: n * len(ids[d]) for d, n in copies.items()}


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SF)
    assert out.filter(F.length("ids") != 4 * F.col("length")).count() == 0 and out.count() > 0
