"""Joins, sampling, reshaping and ordering of evaluation tables."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from auralake.functions import scalars as S
from auralake.session import shared_dir


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often: what a validated join or load refuses."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def single(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table, which fails the job that reads it where a key occurs more than once; a null is a key like others.

    Rows are counted by the keys that a join on them deals rows by anyway, so the check costs no shuffle of its own and
    no job beforehand.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.first(F.struct(*[F.col(c) for c in rest], F.lit(1).alias("__one"))).alias("__row"))
    said = F.concat(F.lit("repeated key: "), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    # A filter is never left out of a plan, whatever columns are asked for.
    return rows.filter(F.when(F.col("__rows") > 1, F.raise_error(said).cast("boolean")).otherwise(True)).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def many_to_one(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must not repeat a key; where it does, the job fails and names the key.

    Where no column of the right side is asked for, a left join is no join: Spark leaves the right side out, and the check.
    """
    return df.join(single(other, keys), keys, how)


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of which neither side may repeat a key."""
    return single(a, keys).join(single(b, keys), keys, how)


def paired(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], keep: list[str] = []) -> DataFrame:
    """Rows of both tables with one key: each metric as ``_a`` and ``_b`` and its difference ``d_``."""
    left = a.select(*keys, *keep, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, keys).withColumns({f"d_{m}": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def enrich(df: DataFrame, index: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The table with ``index``'s values where its own are missing or blank; rows without a match stay."""
    other = index.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(other, keys, "left")
    return joined.withColumns({c: F.coalesce(S.blank_to_null(c), S.blank_to_null(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def within(a: DataFrame, b: DataFrame, keys: list[str], time: str, tolerance: float) -> DataFrame:
    """Rows of ``a`` with a row of ``b`` of the same keys at most ``tolerance`` away in time.

    Times are cut into cells of the tolerance and each of ``b`` is put into its own and the next two, so the join is an
    equality and reads only neighbours.
    """
    cell = F.floor(F.col(time) / tolerance)
    near = b.select(*[F.col(k) for k in keys], F.col(time).alias("__t"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "__cell"]]
    close = F.abs(F.col(f"a.{time}") - F.col("b.__t")) <= tolerance
    return a.withColumn("__cell", cell).alias("a").join(near.alias("b"), [*same, close], "left_semi").drop("__cell")


def pareto(df: DataFrame, cost: str, gain: str, by: list[str] = []) -> DataFrame:
    """Rows flagged ``pareto`` when none costs as little and gains as much, and better in one.

    By sorting, not by comparing pairs: a row is dominated if a cheaper one gains as much or one of its cost gains more.
    """
    strictly = F.lag("__best", 1).over(Window.partitionBy(*by).orderBy(cost))
    best = df.groupBy(*by, cost).agg(F.max(gain).alias("__max"))
    best = best.withColumn("__best", F.max("__max").over(Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, 0)))
    best = best.withColumn("__before", strictly).select(*by, F.col(cost), "__max", "__before")
    joined = df.join(best, [*by, cost], "left")
    flag = S.finite(gain) & (F.col(gain) >= F.col("__max")) & (F.col("__before").isNull() | (F.col("__before") < F.col(gain)))
    return joined.withColumn("pareto", F.coalesce(flag, F.lit(False))).drop("__max", "__before")


def first_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def one_per_group(df: DataFrame, group: str, key: str, seed: int, most: int) -> DataFrame:
    """One row of each group and at most ``most`` in all, both chosen by hashes of the seed and the key."""
    ranked = df.withColumn("__h", S.draw(seed, F.col(key)))
    one = ranked.groupBy(group).agg(F.min_by(F.struct("*"), F.struct("__h", key)).alias("r")).select("r.*")
    return one.orderBy("__h", key).limit(most).drop("__h")


def weighted_draw(df: DataFrame, u: Column, weights: list[tuple[str, float]], name: str) -> DataFrame:
    """A column with the name that the uniform draw ``u`` falls on."""
    total, upto, out = sum(w for _, w in weights), 0.0, None
    for label, w in weights[:-1]:
        upto += w
        out = F.when(u < upto / total, label) if out is None else out.when(u < upto / total, label)
    return df.withColumn(name, F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0]))


def pool_index(pool: DataFrame, tags: str, group: str, key: str) -> DataFrame:
    """(tag, g, r, groups, rows, key): every row of every tag, numbered by its group and within it."""
    each = pool.select(F.explode(tags).alias("tag"), group, key)
    groups = each.select("tag", group).distinct().withColumn("g", F.row_number().over(Window.partitionBy("tag").orderBy(group)) - 1)
    groups = groups.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("tag")))
    rows = each.withColumn("r", F.row_number().over(Window.partitionBy("tag", group).orderBy(key)) - 1)
    rows = rows.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("tag", group)))
    return rows.join(groups, ["tag", group])


def pool_draw(requests: DataFrame, index: DataFrame, seed: int, request: str, key: str) -> DataFrame:
    """For each request (its key and its tags) a row: a tag uniformly among those with rows, then a group, then a row."""
    available = index.select("tag", "groups").distinct()
    options = requests.select(request, F.posexplode("tags").alias("p", "tag")).join(available, "tag")
    options = options.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("p", "tag", "groups"))).alias("o"))
    r = F.col(request)
    chosen = options.withColumn("c", F.get("o", S.pick(F.size("o"), seed, "tag", r).cast("int")))
    chosen = chosen.select(request, "c.tag", S.pick(F.col("c.groups"), seed, "group", r).alias("g"))
    groups = index.select("tag", "g", "rows").distinct()
    chosen = chosen.join(groups, ["tag", "g"]).withColumn("r", S.pick(F.col("rows"), seed, "row", r)).drop("rows")
    return chosen.join(index.select("tag", "g", "r", key), ["tag", "g", "r"]).select(request, "tag", key)


def sampled_snr(u: Column, v: Column, kind: str, lo: float, hi: float, bins: list[float] = [], weights: list[float] = []) -> Column:
    """An SNR from uniform draws: uniform, triangular towards the low end, or uniform within a weighted bin."""
    if kind == "uniform":
        return lo + u * (hi - lo)
    if kind == "triangular_low":
        return hi - (hi - lo) * F.sqrt(1 - u)
    total, upto, out = sum(weights), 0.0, None
    for a, b, w in zip(bins, bins[1:], weights):
        upto += w
        value = a + v * (b - a)
        out = F.when(u < upto / total, value) if out is None else out.when(u < upto / total, value)
    return out.otherwise(bins[-2] + v * (bins[-1] - bins[-2]))


def banded(x: Column | str, bands: list[tuple[float, float, str]]) -> Column:
    """The name of the half-open band that holds the value; null where none does."""
    out = None
    for lo, hi, name in bands:
        inside = (S.col(x) >= lo) & (S.col(x) < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def labelled(df: DataFrame, masks: dict[str, Column], name: str) -> DataFrame:
    """A copy of each row for every mask it satisfies: subsets may overlap."""
    hits = F.filter(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(k)) for k, m in masks.items()]), lambda x: x.isNotNull())
    return df.withColumn(name, F.explode(hits))


def ordered_by_list(column: str, declared: list[str]) -> list[Column]:
    """Sort keys: declared values in their order, all others after them by name."""
    return [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, declared)), F.col(column)), F.lit(0)), F.lit(999)), F.col(column)]


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds each row's place, from 0, in the order of the whole table, without bringing the table into one task.

    Rows are dealt by ranges of the order and numbered within their range; a window sees one row a range. The ranges are
    checkpointed, so that both counts are of the same.
    """
    shared_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn(name, own).join(sizes, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def lanes(df: DataFrame, order: list, n: int) -> DataFrame:
    """Jobs dealt round robin, in order, to ``n`` lanes."""
    return ranked(df, order, "lane").withColumn("lane", F.col("lane") % n)


def least_loaded(df: DataFrame, order: list[str], cost: str, n: int) -> DataFrame:
    """(order, cost, lane): jobs in order, each to the lane with the least work so far, the first on ties.

    Each choice depends on those before, so all jobs pass through one task, in order; it holds the lanes' work only. Without
    a cost a lane's work is unknown, and it gets no more jobs.
    """
    jobs = df.select(*order, F.col(cost).cast("double").alias("cost")).repartition(1).sortWithinPartitions(*order, "cost")
    schema = StructType([*jobs.schema.fields, StructField("lane", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(False, 0.0, lane) for lane in range(n)]  # sorted; work that is not a number comes last
        for batch in batches:
            lanes = []
            for work in batch.column("cost").to_pylist():
                lanes.append(loads[0][2] if loads else None)
                if loads:
                    odd, load, lane = heapq.heappop(loads)
                    if work is not None:
                        total = math.nan if odd else load + work
                        heapq.heappush(loads, (math.isnan(total), 0.0 if math.isnan(total) else total, lane))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lanes, type=pa.int32())], names=[*batch.schema.names, "lane"])

    return jobs.mapInArrow(run, schema)


def classified(df: DataFrame, reasons: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """Adds the first reason that applies, empty where none does, and ``accepted``."""
    out = None
    for reason, hit in reasons:
        out = F.when(F.coalesce(hit, F.lit(False)), reason) if out is None else out.when(F.coalesce(hit, F.lit(False)), reason)
    return df.withColumn(name, out.otherwise("")).withColumn("accepted", F.col(name) == "")


def violations(df: DataFrame, key: Column, rules: dict[str, Column], unique: list[str] = []) -> DataFrame:
    """(key, rule) for every rule a row breaks, in one pass; a rule that is null is broken. ``unique`` keys may not repeat."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    found = df.select(key.cast("string").alias("key"), F.explode(broken).alias("rule"))
    if unique:
        again = repeated(df, unique).select(F.concat_ws("|", *unique).alias("key"), F.lit("repeated key").alias("rule"))
        found = found.unionByName(again)
    return found
