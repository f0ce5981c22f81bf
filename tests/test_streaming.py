"""The same machine over a batch and over a stream cut into files; state that is resumed, handed over or refused; late rows."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auralake.operators import ordered as O
from auralake.streaming import hops
from auralake.streaming import machines as M
from auralake.streaming import stateful as St


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def channel(spark):
    return spark.createDataFrame([(u, i, (i * 7 + u) % 5 < 2) for u in range(4) for i in range(40)], "user int, i int, bad boolean").cache()


def source(spark, df, path, *cuts):
    """Files of the rows between cuts, as a stream of a file a trigger."""
    for low, high in zip(cuts, cuts[1:]):
        df.filter(F.col("i").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("cuts", [(0, 40), (0, 3, 20, 40)])
def test_stream_equals_batch_however_it_is_cut(spark, channel, tmp_path, cuts):
    stream = source(spark, channel, f"{tmp_path}/in", *cuts)
    found = hops.drained(St.over_stream(stream, M.Hysteresis(2, 2), ["user"], "i"))
    assert sorted_rows(found) == sorted_rows(M.over_batch(channel, M.Hysteresis(2, 2), ["user"], "i"))


def test_a_stopped_stream_resumes_where_it_was(spark, channel, tmp_path):
    machine, path, kept = M.Hysteresis(2, 3), f"{tmp_path}/in", f"{tmp_path}/kept"
    first = sorted_rows(hops.drained(St.over_stream(source(spark, channel, path, 0, 17), machine, ["user"], "i"), checkpoint=kept))
    assert [(r.version, r.kind, r.position) for r in St.exported(spark, kept).collect()] == [(St.VERSION, "Hysteresis", 17)] * 4
    both = sorted_rows(hops.drained(St.over_stream(source(spark, channel, path, 17, 40), machine, ["user"], "i"), checkpoint=kept))
    assert len(first) == 68 and set(first) < set(both)
    assert both == sorted_rows(M.over_batch(channel, machine, ["user"], "i"))


def test_state_is_handed_to_another_query(spark, channel, tmp_path):
    """Exported state starts a new query with a new checkpoint; a stream that had none starts afresh."""
    machine, kept = M.Hysteresis(2, 3), f"{tmp_path}/kept"
    early = channel.filter("user < 3")
    first = sorted_rows(hops.drained(St.over_stream(source(spark, early, f"{tmp_path}/a", 0, 17), machine, ["user"], "i"), checkpoint=kept))
    late = channel.filter("i >= 17 or user = 3")
    second = hops.drained(St.over_stream(source(spark, late, f"{tmp_path}/b", 0, 40), machine, ["user"], "i", St.exported(spark, kept)))
    assert sorted(first + sorted_rows(second), key=repr) == sorted_rows(M.over_batch(channel, machine, ["user"], "i"))


@pytest.mark.parametrize("other", [M.Hysteresis(2, 4), M.Bypass(2)])
def test_state_of_other_settings_or_machines_is_refused(spark, channel, tmp_path, other):
    rows, path, kept = channel.withColumn("missed", F.col("bad")), f"{tmp_path}/in", f"{tmp_path}/kept"
    hops.drained(St.over_stream(source(spark, rows, path, 0, 17), M.Hysteresis(2, 3), ["user"], "i"), checkpoint=kept)
    with pytest.raises(StreamingQueryException):
        hops.drained(St.over_stream(source(spark, rows, path, 17, 40), other, ["user"], "i"), checkpoint=kept)
    if other.state == M.Hysteresis.state:
        with pytest.raises(StreamingQueryException, match="StateMismatch"):
            hops.drained(St.over_stream(source(spark, rows, f"{tmp_path}/b", 17, 40), other, ["user"], "i", St.exported(spark, kept)))


def test_state_of_another_version_is_refused(spark, channel, tmp_path):
    kept = f"{tmp_path}/kept"
    hops.drained(St.over_stream(source(spark, channel, f"{tmp_path}/a", 0, 17), M.Hysteresis(2, 3), ["user"], "i"), checkpoint=kept)
    older = St.exported(spark, kept).withColumn("version", F.lit(St.VERSION - 1))
    with pytest.raises(StreamingQueryException, match="StateMismatch"):
        hops.drained(St.over_stream(source(spark, channel, f"{tmp_path}/b", 17, 40), M.Hysteresis(2, 3), ["user"], "i", older))


def test_settings_change_the_digest():
    import dataclasses

    seen = {St.digest(dataclasses.asdict(m)) for m in (M.Hysteresis(2, 3), M.Hysteresis(3, 2), M.SpeechDetector(), M.NeverVanish(), M.NeverVanish(detector=M.SpeechDetector(hang_hops=3)))}
    assert len(seen) == 5 and St.digest(dataclasses.asdict(M.Hysteresis(2, 3))) in seen


@pytest.mark.parametrize("machine,columns", [(M.FrameValidity(6, 3), ["frame", "valid"]), (M.ReconnectRamp(4), ["since", "gain"])])
def test_late_rows_give_what_the_batch_gives(spark, tmp_path, machine, columns):
    """Rows of three files, shuffled within a watermark's delay, and two ends beyond it that close every stream."""
    rnd = random.Random(2)
    rows = [(u, i, (1_000 + i) * 1_000_000 + u, (i * 5 + u) % 11 > 2) for u in range(3) for i in range(60)]
    whole = spark.createDataFrame(rows, "user int, i int, micros long, available boolean").withColumn("ts", F.timestamp_micros("micros"))
    arrival = sorted(rows, key=lambda r: r[2] + rnd.randrange(9_000_000))
    ends = [(9, 900 + k, 1_900_000_000 + k, True) for k in range(2)]
    for k, part in enumerate([arrival[:50], arrival[50:120], arrival[120:], ends]):
        spark.createDataFrame(part, "user int, i int, micros long, available boolean").withColumn("ts", F.timestamp_micros("micros")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = hops.drained(St.over_late_stream(stream, machine, ["user"], "ts", "i", "10 seconds"))
    assert sorted_rows(found) == sorted_rows(M.over_batch(whole, machine, ["user"], "i"))


def test_micro_batches_do_not_grow_with_files(spark, tmp_path):
    """Steps of seven files each are read two steps a trigger, like steps of one file."""
    rows = spark.range(400).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts")).repartition(7)
    found = hops.drained(hops.arriving(rows, "ts", "id", "1 hour", 4), checkpoint=f"{tmp_path}/kept")
    assert found.count() == 400 and len([f for f in os.listdir(f"{tmp_path}/kept/commits") if f.isdigit()]) == 2


def test_late_rows_that_are_held_are_handed_over_in_one_value(spark, tmp_path):
    """What a query holds goes with its state: the next query gives the batch's rows, and none again."""
    machine, kept = M.ReconnectRamp(4), f"{tmp_path}/kept"
    rows = spark.createDataFrame([(u, i, (i * 5 + u) % 11 > 2) for u in range(3) for i in range(60)] + [(9, 900, True)], "user int, i int, available boolean")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("i") + 1_000)).cache()
    late = lambda name, *cuts, first=None: St.over_late_stream(source(spark, rows, f"{tmp_path}/{name}", *cuts), machine, ["user"], "ts", "i", "10 seconds", first)
    early = sorted_rows(hops.drained(late("a", 0, 20, 40), checkpoint=kept))
    state = St.exported(spark, kept)
    assert {(r.user, r.position, len(r.held)) for r in state.collect()} == {(u, 30, 10) for u in range(3)}
    rest = sorted_rows(hops.drained(late("b", 40, 60, 901, first=state)))
    assert sorted(early + rest, key=repr) == sorted_rows(M.over_batch(rows.filter("user < 9"), machine, ["user"], "i"))


def test_batch_machines_equal_the_windows(spark):
    rows = spark.createDataFrame([(u, i, (i * 5 + u) % 11 > 2 and i % 17 > 0) for u in range(3) for i in range(70)], "user int, i long, available boolean")
    frames = M.over_batch(rows, M.FrameValidity(6, 3), ["user"], "i").filter("frame is not null").select("user", "frame", "valid")
    assert sorted_rows(frames) == sorted_rows(O.frame_validity(rows, ["user"], "i", "available", 6, 3))
    ramp = M.over_batch(rows, M.ReconnectRamp(5), ["user"], "i").select("user", "i", "since", F.round("gain", 9))
    assert sorted_rows(ramp) == sorted_rows(O.since_reconnect(rows, ["user"], "i", "available", 5).select("user", "i", "since", F.round("gain", 9)))


def test_batch_streams_may_pass_many_batches(spark):
    """A stream longer than an Arrow batch keeps its state; null keys are a stream; an empty table gives no rows."""
    df = spark.range(25_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("user"), F.col("id").alias("i"), (F.col("id") % 7 > 1).alias("available"))
    found = M.over_batch(df, M.FrameValidity(2, 1000), ["user"], "i").filter("frame is not null").groupBy("user").agg(F.max("frame").alias("last"), F.count("*").alias("n"))
    assert sorted_rows(found) == [(1, 7, 8), (2, 7, 8), (None, 7, 8)]
    assert M.over_batch(df.limit(0).withColumn("bad", F.lit(True)), M.Hysteresis(), ["user"], "i").count() == 0


def chunked(spark, sizes, samples):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows += [(u, k, [float(v + u) for v in samples[at : at + n]], at + n >= len(samples)) for u in range(2)]
        at += n
    return spark.createDataFrame(rows, "user int, i int, samples array<double>, last boolean")


@pytest.mark.parametrize("sizes", [[30], [1] * 30, [7, 0, 11, 2, 10]])
def test_any_chunks_give_the_same_hops(spark, tmp_path, sizes):
    stream = source(spark, chunked(spark, sizes, range(30)), f"{tmp_path}/in", 0, 3, 10, 40)
    kept = f"{tmp_path}/kept"
    found = sorted_rows(hops.drained(St.frames(stream, ["user"], "i", "samples", 8), checkpoint=kept))
    assert found == [(u, h, [float(v + u) for v in range(8 * h, 8 * h + 8)]) for u in range(2) for h in range(3)]
    assert sorted((r.user, r.hops, r.rest) for r in St.exported(spark, kept).collect()) == [(u, 3, [float(v + u) for v in range(24, 30)]) for u in range(2)]


def test_the_last_chunk_is_padded_and_ends_its_stream(spark, tmp_path):
    stream = source(spark, chunked(spark, [5, 13], range(18)), f"{tmp_path}/in", 0, 5)
    found = sorted_rows(hops.drained(St.frames(stream, ["user"], "i", "samples", 8, "last")))
    assert [h for u, h, _ in found if u == 0] == [0, 1, 2] and found[2][2] == [16.0, 17.0] + [0.0] * 6


def test_hysteresis_waits():
    machine, state, out = M.Hysteresis(2, 3), (True, 0), []
    for bad in (1, 0, 1, 1, 0, 0, 1, 0, 0, 0):
        state, (valid,) = machine.step(state, bool(bad))
        out.append(valid)
    assert out == [True, True, True, False, False, False, False, False, False, True]


def test_never_vanish_counts_speech_only():
    machine = M.NeverVanish(25.0, 2, 3, M.SpeechDetector(6.0, 0.0, 0))
    state, out = machine.start(), []
    for level, result in [(0, 0), (20, -20), (0, -90), (20, -20), (20, -20), (20, 20), (20, 20), (20, 20)]:
        state, (active, _) = machine.step(state, float(level), float(result))
        out.append(active)
    assert out == [False, False, False, False, True, True, True, False]


def test_informative_holds_through_silence():
    machine = M.Informative(hold_hops=2, back_hops=2)
    state, out = machine.start(), []
    for corr, silent in [(0.99, False), (0.99, True), (0.99, False), (0.1, False), (0.1, True), (0.1, False)]:
        state, (ok,) = machine.step(state, corr, 0.0, silent)
        out.append(ok)
    assert out == [True, True, False, False, False, True]


def test_items_are_functions_of_their_number(spark):
    rows = {r.seq: r for r in hops.items(spark, 1, 2, 50, 5).collect()}
    again = {r.seq: r for r in hops.items(spark, 1, 2, 50, 5).repartition(7).collect()}
    assert rows == again and {r.pool for r in rows.values()} == set(range(5))
