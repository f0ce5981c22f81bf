"""Operators that depend on order: runs, onsets, ramps, validity, folds, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.streaming import machines as M

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, 0)


def runs(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """(by, run, length) of every run of rows for which the flag holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__n", F.row_number().over(w))
    rows = rows.filter("__f").withColumn("run", F.col("__n") - F.row_number().over(w))
    return rows.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("length"))


def longest_run(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """(by, longest): the longest run, zero where the flag never holds."""
    found = runs(df, by, order, flag).groupBy(*by).agg(F.max("length").alias("longest"))
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("longest", F.lit(0)).alias("longest"))


def rises(df: DataFrame, by: list[str], order: list[str], level: str, look: int, rise: float) -> DataFrame:
    """Rows whose level crosses the median of the ``look`` rows before it by ``rise``: candidates for onsets."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("floor", F.expr(f"percentile({level}, 0.5)").over(w.rowsBetween(-look, -1))).withColumn("prev", F.lag(level).over(w))
    return rows.filter((F.col(level) - F.col("floor") >= rise) & (F.coalesce(F.col("prev"), F.col("floor")) - F.col("floor") < rise))


def refractory(df: DataFrame, by: list[str], time: str, gap: float) -> DataFrame:
    """(by, time): candidates that lie at least ``gap`` after the last one accepted.

    What is accepted depends on what was, so each group's times are walked in order; a task holds one time.
    """
    times = df.select(*by, F.col(time).cast("double").alias("at")).filter("at is not null")
    return M.over_batch(times, M.Refractory(gap), by, "at").filter("kept").select(*by, F.col("at").alias(time))


def since_reconnect(df: DataFrame, by: list[str], order: str, available: str, ramp: int) -> DataFrame:
    """Adds ``since``, samples since the last reconnect, and ``gain``: zero while away, then a linear ramp back to one."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__back", F.col(available) & ~F.lag(available, 1, True).over(w))
    rows = rows.withColumn("since", F.col(order) - F.max(F.when(F.col("__back"), F.col(order))).over(w.rowsBetween(*UPTO)))
    gain = F.when(~F.col(available), 0.0).otherwise(F.least(F.lit(1.0), (F.coalesce("since", F.lit(ramp)) + 1) / F.lit(float(ramp))))
    return rows.withColumn("gain", gain).drop("__back")


def frame_validity(df: DataFrame, by: list[str], order: str, available: str, window: int, hop: int) -> DataFrame:
    """(by, frame, valid): a frame is valid when every sample of the window that ends with its hop is available."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(window - 1), 0)
    rows = df.withColumn("valid", F.min(F.col(available).cast("int")).over(w) == 1)
    return rows.filter((F.col(order) + 1) % hop == 0).select(*by, (((F.col(order) + 1) / hop).cast("long") - 1).alias("frame"), "valid")


def smoothed(df: DataFrame, by: list[str], order: str, value: str, attack: float, release: float) -> DataFrame:
    """(by, order, smooth): a one-pole smoother that rises with one coefficient and falls with another, from the first value on."""
    return M.over_batch(df.select(*by, order, F.col(value).cast("double").alias("x")), M.OnePole(attack, release), by, order)


def stale_after(df: DataFrame, by: list[str], order: str, value: str, min_delta: float) -> DataFrame:
    """(by, epochs, best, stale): rows in a row, up to the last, that did not beat the best before them by more than ``min_delta``."""
    walked = M.over_batch(df.select(*by, order, F.col(value).cast("double").alias("score")), M.Patience(min_delta), by, order)
    last = F.max_by(F.struct("best", "stale"), order).alias("s")
    return walked.groupBy(*by).agg(F.count(F.lit(1)).alias("epochs"), last).select(*by, "epochs", "s.best", "s.stale")


def finish_times(df: DataFrame, by: list[str], order: list[str], arrival: str, work: str) -> DataFrame:
    """Adds ``finish`` of a queue served one at a time: no earlier than arrival, no earlier than the one before.

    The recursion is a running maximum of arrivals less the work before them, plus the work so far.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__before", F.coalesce(F.sum(work).over(w.rowsBetween(*BEFORE)), F.lit(0.0)))
    slack = F.max(F.col(arrival) - F.col("__before")).over(w.rowsBetween(*UPTO))
    return rows.withColumn("finish", slack + F.col("__before") + F.col(work)).drop("__before")


def gaps(df: DataFrame, by: list[str], order: str, step: int) -> DataFrame:
    """Rows that do not follow the one before by ``step``: where samples were lost, and how many."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("missing", F.col(order) - F.lag(order).over(w) - step).filter("missing > 0")


def sessions(df: DataFrame, by: list[str], time: str, gap_s: float) -> DataFrame:
    """(by, session, start, end, n): rows no further apart than the gap are one session."""
    w = Window.partitionBy(*by).orderBy(time)
    rows = df.withColumn("__new", (F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(float("inf"))) > gap_s).cast("int"))
    rows = rows.withColumn("session", F.sum("__new").over(w.rowsBetween(*UPTO)))
    return rows.groupBy(*by, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))


def backlog(df: DataFrame, by: list[str], order: list[str], arrival: str, finish: str) -> DataFrame:
    """Adds ``depth``: items that arrived no later and have not finished when each arrives, itself included.

    Finishes are in order, so those done by an arrival are a prefix: counted by merging both kinds of times.
    """
    times = df.select(*by, *order, F.col(arrival).alias("__t"), F.lit(0).alias("__kind")).unionByName(df.select(*by, *order, F.col(finish).alias("__t"), F.lit(-1).alias("__kind")))
    w = Window.partitionBy(*by).orderBy("__t", "__kind", *order).rowsBetween(*UPTO)
    merged = times.withColumn("depth", F.sum(F.when(F.col("__kind") == 0, 1).otherwise(-1)).over(w)).filter("__kind = 0")
    return df.join(merged.select(*by, *order, "depth"), [*by, *order])
