"""Corpus catalogue: manifests, duplicates, splits, licences, tags, held-out sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auralake.functions import scalars as S

#: Columns of a manifest, in their order.
MANIFEST_COLUMNS = ("source_id", "corpus", "kind", "group_id", "speaker_id", "path", "duration_s", "licence", "split", "sha1", "noise_class")


def conform(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The table with every named column: those it lacks come as their default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def keep_first(df: DataFrame, keys: list[str], order: list[str], blank_is_unique: bool = False) -> DataFrame:
    """The first row of each key in the given order. With ``blank_is_unique`` rows whose only key is empty all stay.

    An aggregate would do for the key alone; the window keeps whole rows. Blank keys are set apart first, so that they do
    not meet in one task.
    """
    if blank_is_unique:
        known = df.filter(F.coalesce(F.col(keys[0]), F.lit("")) != "")
        return keep_first(known, keys, order).unionByName(df.filter(F.coalesce(F.col(keys[0]), F.lit("")) == ""))
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n")


def read_manifest(df: DataFrame) -> DataFrame:
    """A manifest with forward slashes in its paths."""
    return df.withColumn("path", S.posix("path"))


def classify_licence(licence: Column | str, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(use, short name) by the first rule (part of the text, use, short name) that applies; unclear where none does."""
    text, use, short = F.lower(S.col(licence)), None, None
    for part, verdict, name in rules:
        hit = text.contains(part)
        use = F.when(hit, verdict) if use is None else use.when(hit, verdict)
        short = F.when(hit, name) if short is None else short.when(hit, name)
    return use.otherwise("unclear"), short.otherwise(S.col(licence))


LICENCE_RULES = [
    ("by-nc", "no", "CC BY-NC"), ("research only", "no", "research"), ("cc by", "yes", "CC BY"), ("cc0", "yes", "CC0"), ("mit", "yes", "MIT"),
]


def licence_rollup(manifest: DataFrame) -> DataFrame:
    """Clips and hours per corpus, kind and licence; null keys are a group of their own."""
    use, short = classify_licence("licence", LICENCE_RULES)
    return manifest.groupBy("corpus", "kind", "licence").agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_s") / 3600, 9).alias("hours")).select(
        "*", use.alias("commercial"), short.alias("short")
    )


def relabel(df: DataFrame, column: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """The column with the label of the first rule that applies, itself where none does; ``was`` keeps the old label."""
    new = None
    for condition, label in rules:
        new = F.when(condition, label) if new is None else new.when(condition, label)
    return df.withColumn("was", F.col(column)).withColumn(column, new.otherwise(F.col(column)))


def contaminated(speech_s: Column | str, duration_s: Column | str, least_s: float = 0.5, least_share: float = 0.1) -> Column:
    """Whether a noise clip holds speech: long enough in seconds and as a share of the clip."""
    return (S.col(speech_s) >= least_s) & (S.col(speech_s) / F.greatest(S.col(duration_s), F.lit(1e-6)) >= least_share)


def regroup(manifest: DataFrame, video_id: Column) -> DataFrame:
    """Group by video where it is known, and split anew."""
    group = F.when(F.coalesce(video_id, F.lit("")) != "", F.concat(F.lit("video-"), video_id)).otherwise(F.col("group_id"))
    return manifest.withColumn("group_id", group).withColumn("split", S.split_of("group_id"))


def tagged(manifest: DataFrame, by_class: dict[str, list[str]], default: list[str]) -> DataFrame:
    """Scene tags from a row's noise class; impulsive rows are tagged so besides."""
    lookup = F.create_map(*[x for k, v in by_class.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    tags = F.coalesce(F.element_at(lookup, F.col("noise_class")), F.array(*map(F.lit, default)))
    return manifest.withColumn("tags", tags)


def drop_groups(df: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("group_id", "speaker_id", "source_id")) -> DataFrame:
    """Rows none of whose keys is listed in ``ids`` (id)."""
    for key in keys:
        df = df.join(ids.select(F.col("id").alias("__id")), F.col(key) == F.col("__id"), "left_anti")
    return df


def siblings(df: DataFrame, held: DataFrame, item: Column, own: str, held_out_split: str = "test") -> DataFrame:
    """Rows outside the held-out split that share an item with a held-out row without being one."""
    rows = df.withColumn("__item", item).filter("__item is not null")
    listed = rows.join(held.select(own).distinct(), own, "left_semi").select("__item").distinct()
    return rows.join(listed, "__item", "left_semi").join(held.select(own).distinct(), own, "left_anti").filter(F.col("split") != held_out_split).drop("__item")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables hold, with how often; blank keys are unknown and match nothing."""
    count = lambda df, name: df.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return count(a, "n_a").join(count(b, "n_b"), key)


def listed_check(listed: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """How many listed keys the table holds, and the verdict: all, some or none."""
    found = df.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(1))
    counts = listed.join(found, F.col(key) == F.col("__k"), "left").agg(F.count(F.lit(1)).alias("listed"), F.count("__hit").alias("found"))
    return counts.withColumn("verdict", F.when(F.col("found") == F.col("listed"), "ok").when(F.col("found") > 0, "WARN").otherwise("FAIL"))


def content_digest(df: DataFrame, line: Column, by: list[str]) -> DataFrame:
    """A sha256 of each group's sorted lines, whatever order they come in.

    A group's lines pass through one task, as a sha256 takes them in order, but are sorted on disk and never held at once.
    Null lines count but are not part of the digest.
    """
    rows = df.select(*by, line.cast("string").alias("__line")).repartition(*by).sortWithinPartitions(*by, "__line")
    schema = StructType([*rows.drop("__line").schema.fields, StructField("digest", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, done = to_arrow_schema(schema), []
        key, digest, n, any_line = None, None, 0, False
        for batch in batches:
            for *own, text in zip(*(batch.column(c).to_pylist() for c in [*by, "__line"])):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest(), n))
                    key, digest, n, any_line = own, hashlib.sha256(), 0, False
                n += 1
                if text is not None:
                    digest.update(("\n" if any_line else "").encode() + text.encode())
                    any_line = True
            if len(done) > 10_000:
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*done), target)], schema=target)
                done = []
        if key is not None:
            done.append((*key, digest.hexdigest(), n))
        if done:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*done), target)], schema=target)

    return rows.mapInArrow(run, schema)


def pending(work: DataFrame, done: DataFrame, keys: list[str], parts: int = 1) -> DataFrame:
    """Work whose key has fewer than ``parts`` finished rows."""
    complete = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= parts).select(*keys)
    return work.join(complete, keys, "left_anti")


def running_total_below(df: DataFrame, by: list[str], order: list[str], amount: str, most: float) -> DataFrame:
    """Rows of each group, in order, as long as the total before them is below ``most``."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(amount).over(before), F.lit(0.0))).filter(F.col("before") < most)


def packed_offsets(df: DataFrame, by: list[str], path: str, order: str, size: Column) -> DataFrame:
    """Where each distinct path starts in its group's pack, in order of first appearance."""
    files = df.groupBy(*by, path).agg(F.min(order).alias("first"), F.max(size).alias("size"))
    before = Window.partitionBy(*by).orderBy("first", path).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
