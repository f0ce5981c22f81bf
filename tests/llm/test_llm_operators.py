"""The ten operators: brute force, round trips, held-out accuracy, and the awkward inputs each must take."""

import base64
import collections
import functools
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
import xxhash
from pyspark.sql import functions as F

from auralake.llm import components, embeddings, fingerprints, mixing, packing, sharding, simhash, token_counts, token_files, tokens, toxicity, warc
from auralake.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, copy int, ids string"
BYTES, WORDS = tokens.tokenizer_file("byte_bpe_50k.json"), tokens.tokenizer_file("word_bpe_49k.json")
ODD = [" ", "  ", "\n", " \n", "\n ", "a", "the", "don't", "'ll", "é", "ß", "İ", "Σ", "1", "23", ".", ",", "...", "<|endoftext|>", "<|endoftext", "\x00", "\x1c", " ", "　", "中文", "\t", "-", "_", "\x85", "😀", "́", "s"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names clash with what operators add."""
    rnd = random.Random(0)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = [text(rnd.randint(1, 120)) for _ in range(60)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), "x", 1, "y") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], None, None, None, None, None, None) for i in range(8)]
    rows += [(200, None, "en", "a", 0, None, 0, ""), (201, "", "en", "a", 0, None, 0, ""), (202, "   ", "en", "c", 3, None, 0, ""), (203, text(9000), "en", "a", 1, None, 0, "")]
    rows += [rows[3], rows[3], (None, base[5], "en", "a", 1, None, 0, ""), (None, "alone here", "en", "a", 1, None, 0, ""), (None, None, None, None, None, None, None, None)]
    rows += [(300 + i, t, "en", "b", len(t), None, 0, "") for i, t in enumerate(odd_texts(30))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@functools.cache
def loaded(path):
    return tokens.load(path)


def ids_of(path, text, end):
    return np.array([*loaded(path).encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_the_whole(path):
    texts = [*odd_texts(4000, 7), None, "", " ", "\x00", "a" * 3000]
    values, offsets = tokens.store(path).encode(pa.array(texts))
    for i, e in enumerate(tokens.load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert values[offsets[i] : offsets[i + 1]].tolist() == e.ids


def test_a_worker_that_forgets_gives_the_same_ids():
    store = tokens.PieceStore(BYTES)
    store.kept = 50
    texts = pa.array(odd_texts(200, 3))
    a, b = store.encode(texts), tokens.store(BYTES).encode(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


# 1 Packing


def test_packing_holds_every_id_once(spark, docs, empty):
    for parts in (1, 3, 40):
        check_packing(packing.pack(docs.repartition(parts), BYTES, 0).collect(), docs.collect())
    assert packing.pack(empty, BYTES, 0).count() == 0


def check_packing(pieces, rows):
    windows = collections.defaultdict(list)
    held = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length, p.padded_length, p.tier))
        assert len(p.ids) == 4 * p.length and p.length > 0 and p.start + p.length <= p.doc_tokens
        held[p.doc_id].append((p.start, bytes(p.ids)))
    for w in windows.values():
        place = 0
        for offset, length, padded, tier in sorted(w):
            assert offset == place
            place += length
        assert place <= tier <= 1024 and padded == (place if place & (place - 1) == 0 else 1024)
    wanted = collections.defaultdict(list)
    for r in rows:
        wanted[r.doc_id].append(ids_of(BYTES, r.text, 0).tobytes())
    assert set(wanted) == set(held)
    for doc_id, texts in wanted.items():
        # Each row's ids once: pieces are taken off where a text goes on with one of them, longest texts first.
        left = collections.Counter(held[doc_id])
        for text in sorted(texts, key=len, reverse=True):
            place = 0
            while place < len(text):
                fits = [p for p in left if p[0] * 4 == place and text.startswith(p[1], place) and left[p]]
                assert fits, (doc_id, place)
                piece = max(fits, key=lambda p: len(p[1]))
                left[piece] -= 1
                place += len(piece[1])
        assert not +left
    return sum(w[0][2] - sum(x[1] for x in w) for w in windows.values()) / sum(len(p.ids) // 4 for p in pieces)


def test_padding_does_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    for parts in (1, 64, 500):
        assert check_packing(packing.pack(docs.repartition(parts), BYTES, 0).collect(), rows) < 0.01
    found = QUERIES["op1_multi_length_packing"](spark, sf)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "padded_length", "step_group"]
    texts = {r.doc_id: ids_of(BYTES, r.text, 0) for r in rows}
    assert all(r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(texts[r.doc_id]) for r in found.collect())


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_full_while_shorter_pieces_last(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([1, 5, 200, 256, 300, 512, 700, 1024, 3000]) for _ in range(rnd.randint(1, 200))]
    windows = packing.plan_windows(lengths)
    covered = collections.defaultdict(list)
    for tier, held in windows:
        assert sum(n for *_, n in held) <= tier
        for doc, start, n in held:
            covered[doc].append((start, n))
    for doc, n in enumerate(lengths):
        place = 0
        for start, m in sorted(covered[doc]):
            assert start == place
            place += m
        assert place == n
    padding = sum(packing.padded_length(sum(n for *_, n in held), 1024) - sum(n for *_, n in held) for _, held in windows)
    assert padding < 1024
    groups = collections.Counter()
    sizes = [packing.padded_length(sum(n for *_, n in held), 1024) for _, held in windows]
    for g, n in zip(packing.step_groups(sizes), sizes):
        groups[g] += n
    assert max(groups.values()) - min(groups.values()) <= 1024


# 2 SimHash


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i in range(len(keys)):
        groups[find(i)].append(i)
    return {i: g for g in groups.values() for i in g}


def test_simhash_components_against_all_pairs(docs, empty):
    rows = simhash.near_dedup(docs).collect()
    texts = docs.collect()
    prints = [fingerprint(r.text) for r in texts]
    groups = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = collections.Counter()
    for i, r in enumerate(texts):
        ids = [texts[j].doc_id for j in groups[i] if texts[j].doc_id is not None]
        want[r.doc_id, prints[i], min(ids) if ids else None] += 1
    assert collections.Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in rows) == want
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_simhash_tiles_lose_no_link(spark, tile):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    values = list({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node long, fingerprint long")
    found = {r.node: r.component for r in components.components(simhash.links(df, 4, tile)).collect()}
    groups = brute_components(values, lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    assert {i: found.get(i, i) for i in range(len(values))} == {i: min(g) for i, g in groups.items()}


def test_similarity_stage_against_jaccard(spark, docs):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(6)]
    rows = []
    for b in base:
        for k in (0, 0, 1, 3, 8, 20):
            copy = list(b)
            for at in rnd.sample(range(200), k):
                copy[at] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t, _ in rows]
    groups = brute_components(rows, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(g) for g in groups.values()})
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    texts = collections.Counter((r.text or "").strip() for r in left.collect())
    assert texts[""] == 1 and all(n == 1 for t, n in texts.items() if t in {r.text for r in docs.filter("doc_id < 60").collect()})
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def kept_by_brute_force(rows):
    """Rows that stay of (doc_id, text, ...): each group's least doc_id, with as many rows as stay of each text."""
    sets = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    groups = brute_components(rows, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12)
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for i, g in groups.items() if i == g[0])


def test_similarity_stage_keeps_all_that_is_no_copy(spark):
    """Shared and missing ids, equal rows, columns named like the operator's own; only near copies go."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a"), "x", {"m": 1}), (1, text("b"), None, None), (2, text("c"), "x", None), (2, text("c") + " more", "y", {}), (None, text("d"), "x", None), (None, text("e"), "x", None), (7, text("e"), "z", None)]
    rows += [rows[0]] * 3 + [rows[4]] * 2 + [(None, None, None, None), (9, "", "", None), (9, " \t", "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, k1 map<string,int>").repartition(4)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    left = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == kept_by_brute_force(rows)
    assert {r.text for r in left if r.text and r.text.strip()} >= {text(k) for k in "abd"} and len(left) == 6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_similarity_stage_on_tables_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_each(df).collect()) == kept_by_brute_force(rows)


@pytest.mark.parametrize("sizes", [(4, 2, 8), (7, 1 << 20, 1024), (2048, 20, 40)])
def test_similarity_stage_in_crowded_tiles(spark, sizes):
    """A passage in all documents, one group of near copies, sizes that differ: tiles, parts and checks of any size lose no link."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(10**9)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(80)]
    rows = [(i, " ".join([word() for _ in range(draw.randint(1, 30))] + passage)) for i in range(60)]
    for i in range(90):
        copy = list(base)
        for at in draw.sample(range(len(copy)), draw.randint(0, 4)):
            copy[at] = word()
        rows.append((1000 + i, " ".join(copy + [word() for _ in range(draw.randint(0, 40))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((False, r.doc_id) for r in simhash.one_of_each(df, 5, 0.8, *sizes).collect()) == kept_by_brute_force(rows)


def test_similarity_stage_finds_short_pairs_at_the_limit(spark):
    """Pairs of exactly 0.8, the least that counts: a text and the same with a quarter more shingles."""
    draw, rows = random.Random(8), []
    for words, more in ((8, 1), (12, 2), (16, 3), (24, 5), (64, 15)):
        for _ in range(150):
            text = [f"w{draw.randrange(10**9)}" for _ in range(words + more)]
            rows += [(2 * len(rows), " ".join(text[:words])), (2 * len(rows) + 1, " ".join(text))]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {doc_id for doc_id, _ in rows[::2]}


def test_parity_fingerprints_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 33, 500, 4000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: 9 * n // 10], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)]))
        both = simhash.Parities(np.array([len(a), len(b)]), [simhash.parity(a), simhash.parity(b)])
        differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        bits = [int(z[0]) for x, y, z in both.near(np.array([False, False]), 0.8) if len(x)]
        assert all(k <= differ for k in bits) and (bits or simhash.jaccard(a, b) < 0.8)


# 3 Token files


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    token_files.write_token_files(docs, f"{tmp_path}/t", WORDS, 2)
    read = token_files.read_token_files(spark, f"{tmp_path}/t")
    got = token_files.digests(read).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    place = 0
    assert len(got) == len(rows)
    by_start = {r.start: r for r in got}
    for r in rows:
        ids = ids_of(WORDS, r.text, 2)
        if r.doc_id is not None and r.doc_id not in (3,):
            assert (by_start[place].doc_id, by_start[place].n_tokens, by_start[place].ids_crc32) == (r.doc_id, len(ids), zlib.crc32(ids))
        place += len(ids)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in spark.read.orc(f"{tmp_path}/t").filter("doc_id = 17")._jdf.queryExecution().toString()
    token_files.write_token_files(empty, f"{tmp_path}/e", WORDS, 2)
    assert token_files.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_token_files_have_stripes_and_filters(spark, tmp_path):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id")).alias("text")).coalesce(1)
    token_files.write_token_files(df, f"{tmp_path}/t", WORDS, 2, {"orc.stripe.size": "65536", "orc.stripe.row.count": "5000"})
    files = [pa.orc.ORCFile(str(f)) for f in tmp_path.glob("t/*.orc")]
    assert sum(f.nstripes for f in files) > len(files) and sum(f.nrows for f in files) == 20000


# 4 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\r\nb", "same"), (1, "u", "same"), (2, None, "same"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 300000), (8, "u", "x" * 300000), (None, "u", "same"), (9, "u", "ünï"), (1, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    warc.write_warc(pages, f"{tmp_path}/w")
    read = warc.read_warc(spark, f"{tmp_path}/w")
    got = collections.Counter((r.page_id, r.n, r.d, r.t, r.to) for r in read.select(warc.page_id_of("record_id").alias("page_id"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"), F.col("record_type").alias("t"), warc.page_id_of("refers_to").alias("to")).collect())
    first = {"same": 1, "": 5, "x" * 300000: 7}
    want = collections.Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = page is not None and page > first.get(html or "", page)
        want[page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None] += 1
    assert got == want
    assert {r.target_uri for r in read.collect()} == {None, "u", "http://a/\r\nb"}
    warc.write_warc(pages.limit(0), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_warc_is_whole_at_every_split_and_with_false_magics(spark, tmp_path, split):
    rnd = random.Random(split)
    payloads, data = [], b""
    for i in range(40):
        body = b"".join(rnd.choice([b"\x1f\x8b\x08", b"\x1f\x8b", b"text ", bytes([rnd.randrange(256)])]) for _ in range(rnd.randint(0, 400)))
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        z = zlib.compressobj(0 if i % 2 else 6, zlib.DEFLATED, 31)  # stored members keep the false magics in sight
        data += z.compress(head + body + b"\r\n\r\n") + z.flush()
        payloads.append(body)
    data += b"\x1f\x8b\x08 no member"
    (tmp_path / "a.warc").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {r.page: bytes(r.payload) for r in warc.read_warc(spark, f"{tmp_path}/a.warc").select(warc.page_id_of("record_id").alias("page"), "payload").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(payloads))


@pytest.mark.parametrize("split", [64, 900, 1 << 20])
def test_warc_passes_over_what_is_no_record(spark, tmp_path, split):
    """Foreign bytes before, between and behind records, full of magics, hide no record and are none."""
    rng = np.random.default_rng(3)
    foreign = lambda: b"".join(warc.MAGIC + rng.bytes(40) for _ in range(30)) + gzip.compress(b"not a record" * 9)
    payloads = [rng.bytes(300 + 50 * i) + warc.MAGIC * (i % 4) for i in range(12)]
    records = [warc.member(i, "u", p, None, "1970-01-01T00:00:00Z", 0 if i % 2 else 6) for i, p in enumerate(payloads)]
    (tmp_path / "a.warc.gz").write_bytes(foreign() + b"".join(r + (foreign() if i % 3 == 0 else b"") for i, r in enumerate(records)) + foreign())
    (tmp_path / "b.bin").write_bytes(b"".join(foreign() for _ in range(5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        read = warc.read_warc(spark, str(tmp_path)).select(warc.page_id_of("record_id").alias("page"), "payload").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.page, bytes(r.payload)) for r in read) == list(enumerate(payloads))


def test_warc_reads_gz_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(1, "u", b"x", None, "1970-01-01T00:00:00Z", 6) + warc.member(2, "u", b"x", 1, "1970-01-01T00:00:00Z", 6))
    assert sorted(r.record_type for r in warc.read_warc(spark, str(tmp_path)).collect()) == ["response", "revisit"]


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_warc_splits_gz_files(spark, tmp_path, split):
    rnd = random.Random(split)
    payloads = [rnd.randbytes(rnd.randint(0, 600)) + b"\x1f\x8b\x08" * (i % 3) for i in range(60)]
    names = ["a.warc.gz", "b .gz", "!.gz", "ü.gz", "c.warc"]
    for at, name in enumerate(names):  # uncompressed members of a level keep the false magics in sight
        (tmp_path / name).write_bytes(b"".join(warc.member(100 * at + i, "u", p, None, "1970-01-01T00:00:00Z", 0 if i % 2 else 6) for i, p in enumerate(payloads)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        read = warc.read_warc(spark, str(tmp_path))
        got = {r.page: bytes(r.payload) for r in read.select(warc.page_id_of("record_id").alias("page"), "payload").collect()}
        one = warc.read_warc(spark, f"{tmp_path}/a.warc.gz")
        assert "binaryFile" not in one._jdf.queryExecution().toString()
        assert split > 700 or spark.read.options(**warc.RAW_GZ).text(f"{tmp_path}/a.warc.gz").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {100 * at + i: p for at in range(len(names)) for i, p in enumerate(payloads)}


# 5 Toxicity


def test_toxicity_counts_features_over_all_unlabelled_texts(spark):
    rows, labels = [(i, "plain text here") for i in range(3000)], []
    train = [r.doc_id for r in spark.range(3000).withColumnRenamed("id", "doc_id").filter(~toxicity.held_out(F.col("doc_id"))).collect()]
    for at, i in enumerate(sorted(train)[:60]):
        labels.append((i, int(at < 40)))
        rows[i] = (i, "nasty" if at < 6 else "plain text here")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {feature for feature, _ in model.weights} & {"nasty", "nast*"}


def random_sets(rng, rows, n, top):
    return [(sorted(rng.choice(n, rng.integers(0, n), replace=False).tolist()), int(rng.integers(1, top))) for _ in range(rows)]


@pytest.mark.parametrize("seed", range(6))
def test_toxicity_gradient_against_finite_differences(seed):
    """Both where the rest of the risk counts and where it is below zero and only pushed up."""
    rng = np.random.default_rng(seed)
    n, prior = 5, 0.1 if seed % 2 else 0.8
    positive, rows = toxicity.Counted.of(random_sets(rng, 8, n, 4)), random_sets(rng, 30, n, 9)
    unlabelled, n_u = toxicity.Counted.of(rows), sum(m for _, m in rows)
    for scale in (0.3, 3.0):
        theta = rng.normal(size=n + 1) * scale
        at = lambda x: toxicity.risk_and_slope(x, positive, unlabelled.sums(x), n_u, prior)
        first, rest, slope = at(theta)
        z = lambda f: sum(theta[i] for i in f) + theta[-1]
        cost = lambda found, sign: sum(m * math.log1p(math.exp(sign * z(f))) for f, m in found) / sum(m for _, m in found)
        p_rows = [([int(c) for c in positive.columns[positive.rows == i]], int(m)) for i, m in enumerate(positive.times)]
        assert math.isclose(first, prior * cost(p_rows, -1)) and math.isclose(rest, cost(rows, 1) - prior * cost(p_rows, 1), abs_tol=1e-12)
        steps = np.eye(n + 1) * 1e-6
        value = (lambda x: sum(at(x)[:2])) if rest >= 0 else (lambda x: -at(x)[1])
        assert np.allclose(slope, [(value(theta + d) - value(theta - d)) / 2e-6 for d in steps], atol=1e-6)
    theta = np.append(np.full(n, 4.0), -9.0)
    assert toxicity.risk_and_slope(theta, positive, toxicity.Counted.of([([], 5)]).sums(theta), 5, 0.8)[1] < 0


def test_toxicity_sums_of_tasks_are_those_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = random_sets(rng, 200, 6, 9)
    df = spark.createDataFrame(rows, "features array<int>, n long").repartition(3)
    theta = rng.normal(size=7)
    assert np.allclose(toxicity.summed_by_tasks(df)(theta), toxicity.Counted.of(rows).sums(theta))


def test_toxicity_features_that_say_the_same():
    rows = [("nasty", 0, 9, 1), ("nast*", 0, 9, 1), ("nast*", 1, 9, 1), ("nast", 0, 9, 1), ("nastily", 0, 9, 1), ("vile", 0, 9, 1), ("nast*", 2, 4, 0)]
    assert sorted(toxicity.longest_of_each(rows)) == [("nast", 0), ("nast*", 2), ("nastily", 0), ("nasty", 0), ("vile", 0)]


def test_toxicity_never_reads_held_out_labels(spark):
    """Held-out labels turned round, and ids' languages and sources changed, leave every score as it is."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.toxicity for r in toxicity.score(d, toxicity.fit(d, known)).collect()} for d, known in ((docs, labels), (docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned))]
    assert scores[0] == scores[1]


def test_toxicity_on_held_out_documents(spark, empty, docs):
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rnd.random() < 0.15
        words = [rnd.choice(vocabulary) for _ in range(60)]
        if toxic:
            for _ in range(2):
                words[rnd.randrange(60)] = rnd.choice(["nasty", "vileword", "foulness", "vilewords"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
        rows[-1] = (*rows[-1], int(toxic))
    truth = {r[0]: r[2] for r in rows}
    df, known = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    found = {r.doc_id: (r.held, r.toxicity >= 0.3) for r in toxicity.score(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(truth[i], hit) for i, (h, hit) in found.items() if h]
    assert {i for i, (h, _) in found.items() if h} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(t and h for t, h in held) >= 0.9 * sum(t for t, _ in held)
    assert sum(not t and h for t, h in held) <= 0.03 * len(held)
    scored = toxicity.score(docs.withColumn("toxicity", F.lit("clash")), model).collect()
    assert len(scored) == docs.count() and all(0 <= r.toxicity <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(df, known.filter("toxic = 0"))
    assert not nothing.weights and toxicity.score(df, nothing).agg(F.max("toxicity")).first()[0] < 0.3


# 6 Mixing


def test_poisson_mixing(spark, docs, empty):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("common").alias("source"), F.lit("x").alias("copy"))
    targets = spark.createDataFrame([("rare", 3.0), ("common", 1.0), ("absent", 5.0)], "source string, weight double")
    got = mixing.poisson_mix(df, targets, 1)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["rare"] - 3000) < 200 and abs(counts["common"] - 1000) < 120
    copies = collections.Counter(r.doc_id for r in got.collect())
    again = collections.Counter(r.doc_id for r in mixing.poisson_mix(df.repartition(7), targets, 1).collect())
    assert copies == again
    rates = spark.createDataFrame([("a", 0.3), (None, 2.5), ("c", 900.0), ("d", 300_000.0)], "__s string, rate double")
    steps = {r["__s"]: r["__steps"] for r in mixing.poisson_steps(rates).collect()}
    assert len(steps) == 4
    for source, lam in rates.collect():
        want = np.cumsum([math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(len(steps[source]))])
        assert np.allclose(steps[source], want, atol=1e-6) and abs(steps[source][-1] - 1) < 1e-6
    assert mixing.poisson_mix(df, targets, 1, total=0).count() == 0
    out = mixing.poisson_mix(docs, mixing.tempered_targets(docs, 2.0), 3)
    assert out.filter("source is null").count() > 0 and len(set(out.columns)) == len(out.columns)
    assert mixing.poisson_mix(empty, mixing.tempered_targets(empty, 2.0), 3).count() == 0


# 7 Fingerprints


def test_window_entropy_against_counting():
    data = np.frombuffer(bytes(random.Random(1).choice(b"aaab cdefgh\x00") for _ in range(2000)), dtype=np.uint8)
    assert fingerprints.window_entropy(data).tolist() == [fingerprints.COUNT_LOGS[np.bincount(data[i : i + fingerprints.WINDOW], minlength=256)].sum() for i in range(len(data) - fingerprints.WINDOW + 1)]


def window_classes(data):
    """Each window's entropy class, by counting its bytes."""
    w, most = fingerprints.WINDOW, round(fingerprints.WINDOW * math.log2(fingerprints.WINDOW) * (1 << 20))
    data = data.ljust(w, b"\0") if data else data
    sums = [sum(round(c * math.log2(c) * (1 << 20)) for c in collections.Counter(data[i : i + w]).values()) for i in range(len(data) - w + 1)]
    return data, [(most - s) * (fingerprints.CLASSES - 1) // most for s in sums]


def brute_digest(text, ranks):
    """Filters as (features, bits as one number), by going through every span of every window."""
    data, classes = window_classes(text.encode())
    votes, n, span = collections.Counter(), len(classes), fingerprints.NEIGHBOURS
    for a in range(1 - span, n) if n else ():
        votes[min(range(max(0, a), min(n, a + span)), key=lambda i: (ranks[classes[i]], i))] += 1
    kept = dict.fromkeys(data[i : i + fingerprints.WINDOW] for i in sorted(votes) if votes[i] >= fingerprints.VOTES)
    filters = []
    for i, window in enumerate(kept):
        h = int(fingerprints.window_hashes(np.frombuffer(window, dtype=np.uint8), np.array([0]))[0])
        if i % fingerprints.FILTER_FEATURES == 0:
            filters.append([0, 0])
        filters[-1][0] += 1
        for k in range(fingerprints.FEATURE_BITS):
            filters[-1][1] |= 1 << (h >> 11 * k) % fingerprints.FILTER_BITS
    return filters


def brute_likeness(x, y):
    x, y = sorted((x, y), key=lambda d: (len(d), sum(n for n, _ in d)))
    if not x:
        return float(not y)
    total = 0.0
    for n, a in x:
        scores = []
        for _, b in y:
            both, most, chance = (a & b).bit_count(), min(a.bit_count(), b.bit_count()), a.bit_count() * b.bit_count() / fingerprints.FILTER_BITS
            scores.append(1.0 if both == most else max(0.0, (both - chance) / (most - chance)))
        total += n * max(scores)
    return total / sum(n for n, _ in x)


def brute_ranks(texts):
    counts = collections.Counter(c for t in texts for c in window_classes(t.encode())[1])
    repetition = lambda c: c < fingerprints.LEAST / math.log2(fingerprints.WINDOW) * (fingerprints.CLASSES - 1)
    return {c: i for i, c in enumerate(sorted(range(fingerprints.CLASSES), key=lambda c: (repetition(c), counts[c], c)))}


def as_written(filters):
    return ",".join(f"{n}:{base64.b64encode(bits.to_bytes(fingerprints.FILTER_BITS // 8, 'little')).decode()}" for n, bits in filters)


@pytest.mark.parametrize("long", [700, 1 << 30])
def test_digests_against_brute_force(monkeypatch, long):
    """Also where long texts go by parts; no digest depends on its neighbours."""
    monkeypatch.setattr(fingerprints, "LONG_BYTES", long)
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", 2000)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefghij klmno.,ü") for _ in range(n)) for n in [*range(30), 64, 130, 900, 699, 700, 701, 5000, 4000]]
    texts += ["a" * 500, "aaaa bbbb " * 90, texts[-1][:3000] + texts[-2][:500]]
    ranks = brute_ranks(texts)
    found = fingerprints.digests(texts, np.array([ranks[c] for c in range(fingerprints.CLASSES)]))
    want = [brute_digest(t, ranks) for t in texts]
    assert [fingerprints.written(d) for d in found] == [as_written(d) for d in want]
    assert all(d for t, d in zip(texts, want) if t)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if rnd.random() < 0.2 or i == j]
    assert np.allclose([fingerprints.likeness(found[i], found[j]) for i, j in pairs], [brute_likeness(want[i], want[j]) for i, j in pairs])
    assert fingerprints.likeness(found[-5], found[-4]) < 0.2 < 0.5 < fingerprints.likeness(found[-4], found[-1])


@pytest.mark.parametrize("nulls", [0, 5])
@pytest.mark.parametrize("start, step", [(1 << 60, 3), (-(1 << 62), 1), ((1 << 62) - 5, 1 << 54), (-500, 17)])
def test_fingerprints_keep_every_row(spark, nulls, start, step):
    """Ids that no double tells apart, with and without nulls, held against brute force over all rows."""
    rnd = random.Random(start % 97)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    rows = [(start + step * i, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 60])))) for i in range(60)]
    rows += [(None, word()) for _ in range(nulls)] + [(start + step, "a shared id"), (start + step, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]], r[1]))
    ranks = brute_ranks([t for _, t in order])
    want = collections.Counter()
    for (doc_id, text), (_, following) in zip(order, [*order[1:], order[0]]):
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, other, after = (brute_digest(t, ranks) for t in (text, changed, following))
        want[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_written(own), as_written(other), round(brute_likeness(own, other), 9), round(brute_likeness(own, after), 9)] += 1
    got = fingerprints.fingerprints(df).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


@pytest.mark.parametrize("partitions", [1, 3])
def test_fingerprints_follow_ascending_ids(spark, docs, empty, partitions):
    plain = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(partitions)
    rows = sorted(plain.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.fingerprints(plain).collect()}
    assert len(got) == len(rows)
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        text, following = r.text or "", n.text or ""
        half = len(text) // 2
        assert got[r.doc_id].n_chars == len(text)
        assert got[r.doc_id].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= got[r.doc_id].near_edited <= 1 and (got[r.doc_id].near_next == 1) >= (text == following)
    assert fingerprints.fingerprints(docs).count() == docs.count()
    assert fingerprints.fingerprints(docs.filter("doc_id is null")).count() == 3
    assert fingerprints.fingerprints(docs.filter("doc_id = 7")).first().near_next == 1.0
    assert fingerprints.fingerprints(empty).count() == 0


# 8 Sharding


@pytest.mark.parametrize("first_bits", [1, 3, 12])
def test_extendible_hashing_against_splitting(spark, docs, empty, first_bits):
    limit = 2000
    rows = docs.collect()
    key = lambda r: format(int(hashlib.md5(b"" if r.doc_id is None else str(r.doc_id).encode()).hexdigest()[:8], 16), "032b")
    size = lambda r: len((r.text or "").encode())
    buckets = {"": rows}
    while over := [p for p, b in buckets.items() if sum(map(size, b)) > limit and len(p) < 32]:
        for p in over:
            for bit in "01":
                buckets[p + bit] = [r for r in buckets[p] if key(r)[len(p)] == bit]
            del buckets[p]
    want = collections.Counter((r.doc_id, p, len(p), sum(map(size, b))) for p, b in buckets.items() for r in b)
    got = sharding.extendible_shards(docs.withColumn("depth", F.lit("clash")), limit, first_bits=first_bits)
    assert collections.Counter((r.doc_id, r.shard, r.depth, r.shard_bytes) for r in got.collect()) == want
    assert sharding.extendible_shards(empty, limit).count() == 0


def test_no_column_is_lost(spark):
    """Columns named as operators might name their own stay, whatever they begin with."""
    names = ["__h", "__c12", "__b", "__n", "__u", "__s", "__steps", "___x", "__K1"]
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), *[F.lit(n).alias(n) for n in names])
    for out in (sharding.extendible_shards(df, 7, first_bits=2), mixing.poisson_mix(df, mixing.tempered_targets(df, 2.0), 1, total=80)):
        assert set(df.columns) < set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert all(r[n] == n for r in out.collect() for n in names)


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(sharding.extendible_shards(docs, 20000), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == docs.count()


def test_token_files_of_few_rows_each_place_documents_right(spark, docs, tmp_path):
    """Spark may cut a task's rows into several files; starts count all ids before all the same."""
    rows = docs.filter("doc_id is not null").select("doc_id", "text").distinct()
    whole, cut = f"{tmp_path}/whole", f"{tmp_path}/cut"
    token_files.write_token_files(rows, whole, WORDS, 2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 7)
    try:
        token_files.write_token_files(rows, cut, WORDS, 2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    read = lambda path: sorted((tuple(r) for r in token_files.digests(token_files.read_token_files(spark, path)).collect()), key=lambda r: (r[1], r[0]))
    found = read(cut)
    assert len(list((tmp_path / "cut").glob("*.orc"))) > len(found) / 8 and found == read(whole)
    assert [r[1] for r in found] == [sum(n for _, _, n, _ in found[:i]) for i in range(len(found))]


def test_orc_files_have_what_lookups_need(spark, tmp_path):
    """Bloom filters and row indexes on doc_id, run-length encoded ids, and a lookup that reads few rows of a file."""
    df = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
    path = f"{tmp_path}/o"
    token_files.write_token_files(df, path, WORDS, 2, {"orc.stripe.size": "65536"})
    files = sorted((tmp_path / "o").glob("*.orc"))
    meta = [pyarrow.orc.ORCFile(str(f)) for f in files]
    assert sum(m.nrows for m in meta) == 40_000 and sum(m.nstripes for m in meta) > len(files)
    jvm = spark._jvm
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(jvm.org.apache.hadoop.conf.Configuration()))
        assert reader.getRowIndexStride() == 1000
        records = reader.rows()
        for stripe in reader.getStripes():
            footer = records.readStripeFooter(stripe)
            kinds = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
            assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds
            # Ids are the list's elements, column 5: integer runs of the second version.
            assert {footer.getColumnsList()[k].getKind().toString() for k in (1, 5)} == {"DIRECT_V2"}
        records.close()
    found = spark.read.schema(token_files.FILE_SCHEMA).orc(path).filter("doc_id = 20000")
    assert found.count() == 1 and spark.read.schema(token_files.FILE_SCHEMA).orc(path).filter("doc_id = 20001").count() == 0


# 9 Token counts


def test_prefix_counts_are_exact(spark, docs, empty):
    tokenizer = tokens.load(BYTES)
    rows = token_counts.prefix_counts(docs, BYTES).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == texts
    for text in [*odd_texts(150, 9), "a" * 300, "the quick'll brown  fox's\n\n 12345 ünï 中文"]:
        store = tokens.store(BYTES, token_counts.PrefixStore)
        changes, offsets = store.encode(pa.array([text]))
        counts = token_counts.unpacked(token_counts.packed(changes, offsets)[0].as_py())
        want = [len(e) for e in tokenizer.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        assert counts.tolist() == want
    assert token_counts.prefix_counts(empty, BYTES).count() == 0

@pytest.mark.parametrize("kind", ["digits", "chinese", "spaces", "word"])
def test_prefix_counts_of_long_pieces(kind):
    rnd = random.Random(3)
    text = {
        "digits": "".join(f"{rnd.randrange(1000)},{rnd.choice(['', chr(10)])}" for _ in range(26000)),
        "chinese": "".join(chr(rnd.randrange(0x4E00, 0x5000)) + rnd.choice(["", "", "，", "。"]) for _ in range(24000)),
        "spaces": "\n" * 50000 + "x" + "\t " * 25000, "word": "".join(chr(rnd.randrange(0x4E00, 0x4E80)) for _ in range(33000)),
    }[kind]
    assert len(text.encode()) > 95000
    changes, offsets = token_counts.PrefixStore(BYTES).encode(pa.array([text]))
    counts = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
    assert len(counts) == len(text) + 1
    tokenizer = tokens.load(BYTES)
    some = [*range(200), *rnd.sample(range(len(text)), 10), len(text)]
    assert [int(counts[k]) for k in some] == [len(tokenizer.encode(text[:k], add_special_tokens=False)) for k in some]


def test_prefix_counts_by_words_are_those_of_the_library():
    store = token_counts.PrefixStore(BYTES)
    hard = ["\u00a0", "\u2003", "\r", "\r\n", "'", "'s", "'S", "’s", "''ll", "<|", "|>", "<|endoftext|", " <|endoftext|>", "0", "²", "é'", "\u200d", "ﬁ", "한", " \t", "\ufeff", "A", "x9"]
    rnd = random.Random(8)
    texts = ["".join(t) for t in zip(*[odd_texts(600, s) for s in (11, 12)])] + ["".join(rnd.choice(hard + ODD) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    for text in texts:
        assert not text or store.of_piece(text) == store.by_library(text), text
    # Pieces of any length go one way: the library counts no prefix but those of words that an apostrophe begins.
    seen = []
    store = token_counts.PrefixStore(BYTES)
    store.by_library = lambda piece, by=store.by_library: seen.append(piece) or by(piece)
    store.encode(pa.array(texts))
    assert set(seen) <= set(token_counts.SHORTENED)


def test_prefix_counts_with_the_longest_tokens_inside_words():
    counter = token_counts.PrefixCounter(BYTES)
    byte_of = {c: b for b, c in token_counts.byte_letters().items()}
    store, library = tokens.store(BYTES, token_counts.PrefixStore), loaded(BYTES)
    longest = sorted(counter.vocabulary, key=lambda t: (-len(t), t))[:40]
    words = [bytes(byte_of[c] for c in t if c in byte_of).decode("utf-8", "ignore") for t in longest]
    for text in [f"{a}{w}{b}" for w in words if w for a in ("", "x", "é1") for b in ("", "y", w)]:
        changes, _ = store.encode(pa.array([text]))
        assert np.cumsum(changes).tolist() == [len(e) for e in library.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)], text


def test_prefix_query_answers_for_all_documents(spark):
    """The visible answers against the library: tokens of the first 1,024 characters, characters within 1,024 tokens."""
    sf, library = "/root/testdata/sf0.001", loaded(BYTES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = lambda t: len(library.encode(t, add_special_tokens=False))
    for r in QUERIES["op9_prefix_token_counts"](spark, sf).collect():
        text = texts[r.doc_id]
        assert (r.n_tokens, r.tokens_before) == (size(text), size(text[:1024])) and r.over_limit == (r.n_tokens > 1024)
        assert size(text[: r.chars_within]) <= 1024 and (r.chars_within == len(text) or all(size(text[: r.chars_within + k]) > 1024 for k in (1, 2, 3, 9) if r.chars_within + k <= len(text)))


def test_prefix_questions(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    p = token_counts.prefix_counts(df, BYTES).orderBy("doc_id")
    got = p.select(token_counts.tokens_before(F.col("prefix_tokens"), F.lit(7)).alias("b"), token_counts.longest_within(F.col("prefix_tokens"), F.lit(2)).alias("w"), token_counts.longest_within(F.col("prefix_tokens"), F.lit(-1)).alias("n")).collect()
    assert [tuple(r) for r in got] == [(2, 7, None), (0, 0, None)]
    wide = token_counts.packed(np.array([300, -200, 1], dtype=np.int32), np.array([0, 2, 3]))
    assert [token_counts.unpacked(v.as_py()).tolist() for v in wide] == [[0, 300, 100], [0, 1]]


# 10 Embeddings


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = [(int(i), (base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).astype("float32").tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] + [0.0] * 15, 1)]
    return rows + [(None, rows[0][1], 0)]


def test_only_one_direction_links_at_similarity_one(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 0), (2, [3.0, 4.0], 0), (3, [6.0, 8.0], 0), (4, [4.0, 3.0], 0)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.component_id for r in embeddings.near_dedup(df, least=1.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("interval", [7, 2048])
def test_embedding_links_against_all_pairs(spark, interval):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    usable = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def linked(a, b):
        x, y = rows[a], rows[b]
        if not usable(x) or not usable(y) or x[2] != y[2] or len(x[1]) != len(y[1]):
            return False
        u, v = (np.array(r[1], dtype=np.float32).astype(float) for r in (x, y))
        return u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93

    groups = brute_components(rows, linked)
    want = collections.Counter()
    for i, r in enumerate(rows):
        component = min(rows[j][0] for j in groups[i]) if r[0] is not None else None
        want[r[0], sum(linked(i, j) for j in range(len(rows)) if j != i), component, r[0] == component] += 1
    got = embeddings.near_dedup(df, rows=interval)
    assert collections.Counter(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want
    assert embeddings.near_dedup(df.limit(0)).count() == 0
    assert embeddings.near_dedup(df.filter("vec_id >= 300")).count() == 9


def test_embeddings_of_any_magnitude(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e-200, 0.0], 0), (3, [1.0, 0.0], 0), (4, [5e-324, 0.0], 0), (5, [0.0, 1.7e308], 0), (6, [1e300, 1e300], 0)]
    got = embeddings.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {tuple(r) for r in got.collect()} == {(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True), (6, 0, 6, True)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (500, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 500: 500}


def test_queries_have_all_operators():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
