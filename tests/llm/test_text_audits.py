"""Spelling variants, filter audits and license scans: brute force, SQL, and the awkward inputs each must take."""

import glob
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from auralake.llm import filter_audit, licenses, spelling
from auralake.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, word string, n int, part string, at int, words array<string>"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_filter_audit", "op13_license_scan"])
def test_queries_agree_with_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = df.collect()
    result = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = result.fetchall()
    key = lambda row: repr(row)
    assert sorted((tuple(r[c] for c in columns) for r in found), key=key) == sorted(expected, key=key)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2, ["z"]) for i, t, lang in rows], DOCS).repartition(3)


# Spelling variants.


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, every, shortest, least):
    words = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def variants(docs, **settings):
    return sorted(tuple(r) for r in spelling.spelling_variants(docs, **settings).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters,every,shortest", [("ab", 97, 5), ("abcÉé", 5, 4), ("abcdefghij", 7, 5)])
def test_variants_equal_brute_force(spark, letters, every, shortest):
    """Few letters repeat bigrams within words, which is what the order of equal bigrams must survive."""
    rnd = random.Random(len(letters))
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 9))) for _ in range(120)]
    rows = [(i, " ".join(rnd.choice(base) if rnd.random() < 0.9 else rnd.choice(base)[:-1] for _ in range(rnd.randint(0, 60))), "en") for i in range(80)]
    rows += [(None, rows[0][1], None), (None, None, None), (5, "", "en"), rows[7], rows[7], (900, "-- 12 İ 中" + rows[3][1].upper(), None)]
    expected = brute_variants(rows, every, shortest, 2)
    assert expected and any(form for _, form, *_ in expected)
    assert variants(table(spark, rows), every=every, shortest=shortest, least=2) == expected


def test_variants_follow_chains_and_break_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "xxxxx": 3, "xxxxz": 6, "xxxxy": 6, "lonely": 4}
    rows = [(1, " ".join(w for w, n in counts.items() for _ in range(n)), "en")]
    found = {w: (form, root) for w, form, root, *_ in variants(table(spark, rows), every=10**9)}
    assert found["aaaaa"] == ("aaaab", "aabbb") and found["aabbb"] == (None, "aabbb")
    assert found["xxxxx"] == ("xxxxy", "xxxxy") and found["xxxxy"] == (None, "xxxxy") and found["lonely"] == (None, "lonely")


def test_variants_of_nothing(spark):
    assert variants(table(spark, [])) == []
    assert variants(table(spark, [(1, None, None), (2, "", ""), (3, "ab cd", "")])) == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(table(spark, []), shortest=3)


def test_long_texts_and_words(spark):
    rows = [(1, "abcdefgh " * 200_000 + "y" * 50_000, "en"), (2, ("y" * 49_999 + " ") * 3 + "abcdefg " * 3, "en")]
    assert variants(table(spark, rows), every=10**9, least=1) == brute_variants(rows, 10**9, 5, 1)


# Filter audit.

UPPER = "WHY " * 50


def brute_masks(rows):
    found = Counter()
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text))]
        fails.append(doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows))
        found[doc_id, lang or "", sum(1 << i for i, f in enumerate(fails) if f)] += 1
    return found


def audit_rows():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.choice([60, 400])]) for _ in range(rnd.choice([20, 150, 260, 400]))) + rnd.choice(["", UPPER, "|", " $ ", "\x0b"]) for _ in range(25)]
    texts += [None, "", " ", "\x1c".join("ab" for _ in range(300)), "  　".join(["A"] * 300)]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    rnd.shuffle(rows)
    return rows + [(None, texts[0], "en"), (None, texts[0], "en"), (None, None, None), (3, texts[1], "en"), (3, texts[1], "en"), (3, texts[2], "de"), (-9, texts[0], "fr"), (-(2**63), texts[3], "en"), (2**63 - 1, texts[3], "en")]


@pytest.mark.parametrize("held", [0, 3_000, 1 << 24])
def test_masks_equal_brute_force(spark, held, monkeypatch):
    """Whatever a task may hold before it sends texts on, copies are the same."""
    rows = audit_rows()
    parts = [rows[i::4] for i in range(4)]
    sent = [row for p in parts for row in filter_audit.chained(iter([(i, lang or "", t or "") for i, t, lang in p]), filter_audit.FILTERS, held)]
    found = Counter()
    for doc_id, part, mask, times in filter_audit.judged(iter(sorted(sent, key=lambda r: r[0])), 16):
        found[doc_id, part, mask] += times
    assert found == brute_masks(rows)
    if held > 3_000:
        whole = Counter()
        for doc_id, part, mask, times in filter_audit.failures(table(spark, rows)).collect():
            whole[doc_id, part, mask] += times
        assert whole == found


def test_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda data, seed=0: 7)
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")]
    sent = [row for r in rows for row in filter_audit.chained(iter([(r[0], "", r[1])]), {})]
    assert sorted(filter_audit.judged(iter(sorted(sent, key=lambda r: r[0])), 1)) == [(1, "", 0, 1), (2, "", 0, 1), (3, "", 1, 1), (4, "", 1, 1), (5, "", 0, 1)]


def test_a_task_sends_one_of_its_copies():
    sent = list(filter_audit.chained(iter([(i, "en", "the same text " * 50) for i in range(1000)] * 2), filter_audit.FILTERS, 2_000))
    assert sum(text is not None for _, (*_, text) in sent) <= 2 and sum(times for _, (_, _, times, _) in sent) == 2000
    assert len({key[0] % 50 for key, (*_, text) in sent if text is None}) > 30


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(itertools.islice(itertools.cycle([(1, 0), (0, 1), (None, None), (0, 0), (1, 1)]), 100))] + [(3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    known = {r["doc_id"]: (r["q"], r["t"]) for r in labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).collect() if r["doc_id"] is not None}
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.filter_audit(table(spark, rows), labels).collect()}
    docs = [(lang, {c for i, c in enumerate("ABCDE") if mask >> i & 1}, *known.get(i, (0, 0))) for (i, lang, mask), n in brute_masks(rows).items() for _ in range(n)]
    assert len(found) == 600 * len({lang for lang, *_ in docs})
    total = Counter()
    for part in {lang for lang, *_ in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in mine if c in d[1] and not before & d[1]]
                total[part, c] += len(gone)
                expected = (sum(not (before | {c}) & d[1] for d in mine), len(gone), sum(c in d[1] and bool(before & d[1]) for d in mine), sum(d[1] == {c} for d in mine), sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone))
                assert found[part, order, step][:6] == expected
    assert all(counts[6] == total[part, order[step - 1]] for (part, order, step), counts in found.items())
    assert filter_audit.filter_audit(table(spark, []), labels).collect() == []


# License scan.


def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def scan(spark, texts):
    rows = licenses.findings(licenses.license_scan(table(spark, [(i, t, "en") for i, t in texts]))).collect()
    return sorted(((r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]), r["labels"], r["score"]) for r in rows), key=repr)


def test_phrases_equal_brute_force(spark):
    rnd = random.Random(4)
    pieces = ["under the MIT license", "Under\nThe (mit) LICENSE", "Apache License, Version 2.0", "apache license version 20", "CC BY-NC", "cc by nc nd", "cc by", "the", "K", "mİt", "Été", "under the mıt license", "中cc by nc", "x" * 30, "|"]
    texts = [(i, rnd.choice([" ", "\n", "; ", ""]).join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))) for i in range(200)]
    texts += [(None, None), (None, ""), (7, "cc by nc"), (7, "cc by nc"), (8, texts[8][1]), (900, "cc by nc " * 40_000), (901, "under the K mit license")]
    found = scan(spark, texts)
    assert [(i, base) for i, base, *_ in found] == sorted(((i, brute_base(t)) for i, t in texts), key=repr)
    assert all(set(filter(None, base[4].split(","))) <= set(labels.split(",")) and 0 <= score <= 1 for _, base, labels, score in found)
    assert scan(spark, []) == []


def test_notices_are_found_with_small_changes(spark):
    notices = [text for _, text in licenses.NOTICES]
    mit, bsd = notices[0].split(), notices[3].split()
    texts = [
        (0, "before " + notices[0].upper() + " behind"),
        (1, " ".join(mit[:9] + ["really"] + mit[9:])),
        (2, " ".join(mit[:9] + mit[10:])),
        (3, " ".join(mit[:9] + ["changed"] + mit[10:])),
        (4, " ".join(mit[: len(mit) // 2])),
        (5, " ".join(mit[:10] + ["far"] * 400 + mit[10:])),
        (6, " ".join(bsd) + " text " * 100 + " ".join(mit)),
        (7, " ".join(reversed(mit))),
        (8, "this work is licensed under the GNU General Public License, version 3."),
        (9, "the license of the software and the copy of the software"),
    ]
    labels = {i: found for i, _, found, _ in scan(spark, texts)}
    assert labels == {0: "mit", 1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "bsd,mit", 7: "", 8: "gpl-3", 9: ""}
    span = licenses.license_scan(table(spark, [(6, texts[6][1], "en")])).first()["spans"]
    assert [(s["first_word"], s["end_word"]) for s in span if s["found"]] == [(len(bsd) + 100, len(bsd) + 100 + len(mit)), (0, len(bsd))]


def test_license_scan_needs_no_python(spark):
    plan = licenses.findings(licenses.license_scan(spark.read.parquet(f"{SF}/documents.parquet")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ScanExistingRDD", plan)
    with pytest.raises(ValueError):
        licenses.template_runs(spark, phrases=[("short", "two words")])
