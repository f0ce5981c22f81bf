"""Trees of digests over lines and files, and quantiles over ranges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import digests as D
from auralake.operators import stats as X


def tree_rows(tree):
    return sorted(map(tuple, tree.collect()), key=repr)


@pytest.fixture(scope="module")
def lines(spark):
    rows = [("hot" if i % 10 else None, str(i), f"line {i % 50}") for i in range(2000)] + [("hot", None, "x"), ("hot", "7", None), ("hot", "7", "again"), ("b", "1", "")]
    return spark.createDataFrame(rows, "g string, k string, line string")


def test_a_tree_is_the_same_however_rows_are_dealt(spark, lines):
    trees = [tree_rows(D.line_tree(df, F.col("line"), F.col("k"), ["g"], 2)) for df in (lines.coalesce(1), lines.repartition(7), lines.orderBy("line"))]
    assert trees[0] == trees[1] == trees[2]
    roots = {g: n for g, node, _, n in trees[0] if node == ""}
    assert roots == {"hot": 1803, None: 200, "b": 1}
    # One root by hand.
    leaf = hashlib.sha256(hashlib.sha256(b"").hexdigest().encode()).hexdigest()
    name = hashlib.sha1(b"1").hexdigest()
    inner = hashlib.sha256(f"{name[:2]}:{leaf}".encode()).hexdigest()
    assert ("b", "", hashlib.sha256(f"{name[:1]}:{inner}".encode()).hexdigest(), 1) in trees[0]
    assert D.line_tree(lines.limit(0), F.col("line"), F.col("k"), ["g"], 2).count() == 0


def test_changed_blocks_are_named(spark, lines):
    other = lines.filter("k is null or k <> '42'").withColumn("line", F.when(F.col("k") == "99", "new").otherwise(F.col("line"))).union(spark.createDataFrame([("c", "5", "y")], "g string, k string, line string"))
    a, b = (D.line_tree(df, F.col("line"), F.col("k"), ["g"], 2) for df in (lines, other))
    name = lambda k: hashlib.sha1(k.encode()).hexdigest()[:2]
    found = {(r.g, r.node) for r in D.changed_blocks(a, b, ["g"], 2).collect()}
    assert found == {("hot", name("42")), ("hot", name("99")), ("c", name("5"))}
    assert D.changed_blocks(a, a, ["g"], 2).count() == 0
    changes = {tuple(r) for r in D.changed_lines(lines, other, F.col("line"), F.col("k"), ["g"], 2).collect()}
    assert changes == {("hot", "42", "removed"), ("hot", "99", "changed"), ("c", "5", "added")}


def test_files_are_digested_by_blocks(spark, tmp_path):
    data = bytes(random.Random(1).randrange(256) for _ in range(2500))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "sub" / "b").write_bytes(data[:1000] + b"?" + data[1001:])
    (tmp_path / "empty").write_bytes(b"")
    blocks = D.file_blocks(spark, str(tmp_path), 1000)
    found = {(r.path.rpartition("/")[2], r.at): (r.length, r.digest) for r in blocks.collect()}
    assert {k: v for k, v in found.items() if k[0] == "a"} == {("a", at): (len(data[at : at + 1000]), hashlib.sha256(data[at : at + 1000]).hexdigest()) for at in (0, 1000, 2000)}
    assert [at for at in (0, 1000, 2000) if found["a", at] != found["b", at]] == [1000]
    roots = {r.path.rpartition("/")[2]: r for r in D.file_roots(blocks).collect()}
    assert (roots["a"].length, roots["a"].blocks) == (2500, 3) and roots["a"].digest != roots["b"].digest
    assert set(roots) == {"a", "b"}


@pytest.mark.parametrize("parts", [1, 6])
def test_range_quantiles_are_exact(spark, parts):
    """A group that holds most rows spans several ranges; ties, nulls, NaN and infinite values are as they should be."""
    rng = np.random.default_rng(4)
    groups = {"hot": np.round(rng.normal(size=5000), 2), None: rng.normal(size=7), "one": np.array([3.0]), "inf": np.array([1.0, np.inf, 2.0])}
    rows = [(g, float(x), int(w)) for g, v in groups.items() for x, w in zip(v, rng.integers(0, 4, len(v)))] + [("hot", None, 1), ("hot", float("nan"), 1), ("none", None, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, x double, w int").repartition(3)
        found = {r.g: r for r in X.exact_quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
        weighted = {r.g: r for r in X.weighted_quantiles(df, ["g"], "x", "w", {"m": 0.5, "q": 0.99}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert set(found) == set(groups)
    for g, v in groups.items():
        expected = np.quantile(v, [0.1, 0.5, 1.0]) if np.isfinite(v).all() else [1.2, 2.0, np.inf]
        assert found[g].n == len(v) and np.allclose([found[g].a, found[g].b, found[g].c], expected)
        pairs = sorted((x, w) for h, x, w in rows if h == g and x is not None and x == x and w > 0)
        total = sum(w for _, w in pairs)
        for q, got in ((0.5, "m"), (0.99, "q")):
            run = 0
            for x, w in pairs:
                run += w
                if run >= q * total:
                    break
            assert not pairs or (weighted[g][got] == x and weighted[g].weight == total)
    assert X.exact_quantiles(df.limit(0), ["g"], "x", {"a": 0.5}).count() == 0
