"""Mixing sources to target weights by Poisson replication.

A source with ``n`` documents and a share ``w`` of the mixture is repeated at the mean rate ``w * total / n``. Each
document's number of copies is the inverse of the Poisson distribution at a uniform number that its id seeds, so a document
gets the same number wherever and whenever it is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.llm.sharding import free_prefix
from auralake.session import shared_dir

#: Hexadecimal digits of a sha1 that make a uniform number: 52 bits, which a double holds exactly.
DIGITS = 13
#: Numbers of all sources' distribution functions that are broadcast at most, eight bytes each.
STEPS_BROADCAST = 500_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the sha1 of the parts' texts, joined by ``|``; a null part is the empty text."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(__s, __steps) of (__s, rate): the Poisson distribution function at 0, 1, 2, ..., to where it is 1 in double precision.

    Terms are running sums over rows, so the work grows in line with the rate, as the copies do. They are summed from their
    logarithms, so no rate is too large for exp().
    """
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    terms = rates.select("__s", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    upto = Window.partitionBy("__s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))
    summed = terms.withColumn("log", F.sum(log).over(upto)).withColumn("cdf", F.sum(F.exp("log")).over(upto))
    return summed.groupBy("__s").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("__steps"))


def tempered_targets(docs: DataFrame, temperature: float, source: str = "source") -> DataFrame:
    """(source, weight): each source's number of documents to the power ``1 / temperature``."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(1.0 / temperature)).alias("weight"))


def poisson_mix(docs: DataFrame, targets: DataFrame, seed: int, total: int | None = None, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Each document as often as its draw says, all in a hash-seeded random order over the partitions.

    ``targets`` has one row per source (``source``, ``weight``); weights need not sum to one. ``total`` is the mixture's
    expected size, by default the number of documents of the sources that have a weight. Adds ``copy`` (0, 1, ...) and
    ``shuffle_key``; columns of those names in the input are replaced.

    A source without a target, or with a null or non-positive weight, has rate 0 and leaves the mixture. A null source is
    a source of its own. Rows that share a key share a draw; a null key draws as the empty text. An empty table stays
    empty.
    """
    shared_dir(docs.sparkSession)
    docs = docs.drop("copy", "shuffle_key")
    own = free_prefix(docs)
    counts = docs.groupBy(F.col(source).alias("__s")).agg(F.count(F.lit(1)).alias("n"))
    wanted = targets.filter("weight > 0").select(F.col("source").alias("__t"), F.col("weight").cast("double").alias("weight"))
    rates = counts.join(wanted, F.col("__s").eqNullSafe(F.col("__t")))
    sums = rates.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    # One row holds the sums, whatever the input.
    rates = rates.join(F.broadcast(sums), how="cross")
    size = F.col("all_n") if total is None else F.lit(total)
    rates = rates.select("__s", (F.col("weight") / F.col("all_weight") * size / F.col("n")).alias("rate"))
    rates = poisson_steps(rates.filter("rate > 0")).checkpoint()
    # One row a source. Texts need not be shuffled to meet their rates unless there are very many sources.
    few = (rates.agg(F.sum(F.size("__steps") + 10)).first()[0] or 0) <= STEPS_BROADCAST
    rates = rates.select(F.col("__s").alias(f"{own}s"), F.col("__steps").alias(f"{own}steps"))
    rates = F.broadcast(rates) if few else rates
    drawn = docs.join(rates, docs[source].eqNullSafe(rates[f"{own}s"])).withColumn(f"{own}u", uniform(F.lit(seed), F.lit("draw"), F.col(key)))
    copies = F.size(F.filter(f"{own}steps", lambda x: x <= F.col(f"{own}u")))
    drawn = drawn.withColumn(f"{own}n", copies).drop(f"{own}s", f"{own}steps", f"{own}u").filter(F.col(f"{own}n") > 0)
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(f"{own}n") - 1))).drop(f"{own}n")
    drawn = drawn.withColumn("shuffle_key", uniform(F.lit(seed), F.lit("place"), F.col(key), F.col("copy")))
    # The key is uniform, so hashing it spreads rows evenly whatever their sources, and no sampling pass is needed.
    return drawn.repartition("shuffle_key").sortWithinPartitions("shuffle_key", key)
