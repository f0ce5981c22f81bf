"""Queries over tables larger or longer than those their SQL is held against: every row must count."""

import collections
import datetime
import math
import re

import duckdb

from auralake.plans.registry import ORACLE_SQL, QUERIES

FIRST = datetime.datetime(2024, 1, 1)


def saved(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def events(spark, folder, rows):
    """rows: (user, seconds from the first day)."""
    rows = [(i, u, FIRST + datetime.timedelta(seconds=s), "click", float(i % 17)) for i, (u, s) in enumerate(rows)]
    return rows, saved(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double"), folder, "events")


def test_sliding_frames_reach_the_end_of_long_streams(spark, tmp_path):
    rows, folder = events(spark, tmp_path, [(1, 60 * i) for i in range(300)] + [(2, 60 * i) for i in range(5)])
    want = collections.defaultdict(list)
    for user in (1, 2):
        for idx, value in enumerate(r[4] for r in rows if r[1] == user):
            for frame in range(max(0, math.ceil((idx - 11) / 4)), idx // 4 + 1):
                want[user, frame].append(value)
    got = {(r.user_id, r.frame): (r.n, r["mean"]) for r in QUERIES["sliding_frames"](spark, folder).collect()}
    assert got == {k: (len(v), round(sum(v) / len(v), 6)) for k, v in want.items()}


def test_periods_before_and_after_the_first_month_are_routed(spark, tmp_path):
    _, folder = events(spark, tmp_path, [(1, -2 * 86400 + 50), (1, 40 * 86400 + 80000), (2, 0)])
    got = {(r.user_id, r.k): r.route for r in QUERIES["period_routing"](spark, folder).collect()}
    want = {(u, k): "lost" for u in (1, 2) for k in range(-2, 41)}
    assert got == want | {(1, -2): "on time", (1, 40): "late", (2, 0): "on time"}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_parameter_overlap_counts_a_crowded_hash_without_pairs(spark, tmp_path):
    rows = [(i % 290, [0.0] * 8, i % 3) for i in range(300)] + [(1000, [9.0] * 8, 1), (None, [0.0] * 8, 1)]
    folder = saved(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    df = QUERIES["parameter_overlap"](spark, folder)
    want = collections.Counter(label for a, _, label in rows[:300] for b, _, _ in rows[:300] if a < b)
    assert {r.label_a: r.pairs for r in df.collect()} == dict(want)
    assert not re.search(r"vec_id#\d+L < vec_id#\d+L", plan_of(df))


def test_items_are_not_numbered_in_one_task(spark):
    plan = plan_of(QUERIES["multinomial_auc"](spark, "/root/testdata/sf0.001"))
    assert "all#" not in plan


def test_digests_and_lanes_hold_no_group_at_once(spark):
    import hashlib

    from pyspark.sql import functions as F

    from auralake.operators import catalog as C
    from auralake.operators import tables as T

    rows = [("hot", f"{i * 7919 % 30011}é") for i in range(30000)] + [("null", None), (None, "b"), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "g string, line string").repartition(3)
    found = C.content_digest(df, F.col("line"), ["g"])
    digest = lambda g: hashlib.sha256("\n".join(sorted(x for k, x in rows if k == g and x is not None)).encode()).hexdigest()
    assert {r.g: (r.digest, r.n) for r in found.collect()} == {"hot": (digest("hot"), 30000), "null": (digest("null"), 1), None: (digest(None), 3)}
    jobs = T.least_loaded(spark.range(20000).select("id", (F.col("id") * 31 % 17).alias("cost")).repartition(3), ["id"], "cost", 3)
    loads = [0.0] * 3
    for r in jobs.orderBy("id").collect():
        assert r.lane == loads.index(min(loads))
        loads[r.lane] += r.cost
    assert all("collect_list" not in plan_of(x) for x in (found, jobs))


def test_constant_rows_are_no_key_to_deal_tables_by(spark):
    """Three metrics are three keys: a shuffle by them would end in three tasks, whatever the table's size."""
    plan = QUERIES["metric_registry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [metric" in plan and "SortMergeJoin [metric" not in plan


def test_lines_are_summed_in_tasks_that_follow_from_their_number(spark, monkeypatch):
    """No sums in the tasks that scan: of few lines an order, they would hold nearly as many groups as lines."""
    from auralake.plans import base

    monkeypatch.setattr(base, "TASK_LINES", 250)
    tables = base.Tables(spark, "/root/testdata/sf0.001")
    plan, lines = tables.fact._jdf.queryExecution().executedPlan().toString(), tables.lineitem.count()
    assert "hashpartitioning(l_orderkey#" in plan and f", {-(-lines // 250)})" in plan and "hashpartitioning(l_orderkey, l_returnflag" not in re.sub(r"#\d+L?", "", plan)


def test_level_differences_are_those_of_the_sql_on_near_ties_and_odd_vectors(spark, tmp_path):
    """Two bands within a millionth of a decibel a place are a tie, which the first wins; no vector with a next one is lost."""
    base = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]
    louder = lambda *db: [v * 10 ** (db[i // 8] / 20) for i, v in enumerate(base)]
    ties = [base, louder(1, 2, 1, 2.000001, 1, 1, 1, 1), base, louder(1, 2, 1, -2.000003, 1, 1, 1, 1), base]
    odd = [None, base, base[:20], base, [], base, [9.0] * 80, [None] + base[1:], [None] * 8 + base[8:], base, base[:16] + [math.inf] + base[17:], base, [0.0] * 64]
    rows = [(i, v, 1) for i, v in enumerate(ties)] + [(10 + i, v, 2) for i, v in enumerate(odd)] + [(None, base, 3), (30, louder(*[3] * 8), 3), (31, base, 3)]
    folder = saved(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tmp_path, "embeddings")
    got = {r.vec_id: (r.dominant, r.most, r.apart) for r in QUERIES["level_differences"](spark, folder).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = {i: v for i, *v in db.execute(f"SELECT vec_id, dominant, most, apart FROM ({ORACLE_SQL['level_differences']})").fetchall()}
    assert got == {i: tuple(v) for i, v in want.items()}
    assert [got[i][0] for i in range(4)] == [1, 1, 3, 3] and len(got) == 18
