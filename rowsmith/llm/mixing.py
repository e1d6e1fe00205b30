"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target rows over rows held. A document's number of copies is the inverse of
the Poisson distribution with that mean at a number in [0, 1) hashed from the seed and the id, so a rerun or a lost
executor draws the same counts. Copies are exploded and dealt out by a hash of id and copy number: a global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, unused

#: More sources than this are joined by a shuffle rather than broadcast (each row of rates is some hundred bytes).
MAX_BROADCAST_SOURCES = 4096
SALTS = 64


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the seed and the columns joined by ``#``; NULL reads ``null``."""
    text = F.concat_ws("#", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2 ... with this mean, up to where they round to 1.

    Built from logarithms of the terms, so that large means do not underflow to an empty table.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("l"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["l"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["c"] + F.exp(log)
        return F.struct(log.alias("l"), total.alias("c"), F.concat(acc["s"], F.array(total)).alias("s"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["s"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), quoted(source_col).cast("string")), F.lit("null"))


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """Per source: ``_key``, ``_rate`` and ``_steps``. See ``mix_sources`` for weights."""
    held = docs.groupBy(source_key(source_col).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        held = held.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(temperature)))
    else:
        given = {("null" if k is None else f"={k}"): float(v) for k, v in weights.items()}
        if any(v < 0 for v in given.values()) or not sum(given.values()):
            raise ValueError("weights must not be negative, and one must be above 0")
        table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        held = held.withColumn("_w", F.coalesce(table[F.col("_key")], F.lit(0.0)))
    total = held.agg(F.sum("_n").alias("all"), F.sum("_w").alias("weight")).first()
    share = float(epochs) * (total["all"] or 0) / total["weight"] if total["weight"] else 0.0
    rate = F.col("_w") / F.col("_n") * share
    return held.select("_key", rate.alias("_rate")).withColumn("_steps", poisson_steps(F.col("_rate")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Repeat or drop documents so that sources appear in proportion to their weights, in a global shuffled order.

    ``weights``: source to weight (None: rows without a source); sources not named get none. Without weights, a
    source's weight is its row count to the power ``temperature``. The expected number of rows out is ``epochs`` times
    the rows in. All columns of ``docs`` are kept as they are; added are ``copies`` (the drawn count), ``copy`` (from 0)
    and ``shuffle_key``, by which each partition is sorted and, through its hash, assigned. Where ``docs`` has a column
    of one of these names, in any case, the added one gets underscores before its name.

    Rows that share an id share the drawn count, and so do rows without one: they draw as the text ``null``. Rows of
    equal shuffle keys are dealt out by all their columns, so none of these groups meets in one task. NULL, empty and
    very long texts are as good as any. An empty table gives an empty result.
    """
    names = unused(docs, "copies", "copy", "shuffle_key", "key", "rate", "steps", "salt", "source_key", "rank")
    copies, copy, shuffle_key, own, rate, steps, salt, held, rank = names
    rates = source_rates(docs, source_col, weights, temperature, epochs).toDF(held, rate, steps)
    source, doc_id = source_key(source_col), quoted(id_col)
    keyed = docs.withColumn(own, source)
    n_sources = docs.groupBy(source.alias("k")).agg(F.lit(1)).count()
    if n_sources <= MAX_BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), F.col(own) == F.col(held))
    else:  # salted: a source with a third of all rows goes to many tasks
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = keyed.join(spread, (F.col(own) == F.col(held)) & (F.pmod(F.xxhash64(doc_id, *(quoted(c) for c in docs.columns)), F.lit(SALTS)) == F.col(salt))).drop(salt)
    u = unit_hash(seed, doc_id)
    drawn = joined.withColumn(copies, F.size(F.filter(steps, lambda c: c <= u))).filter(F.col(copies) > 0).drop(steps, rate, own, held)
    many = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    text = F.concat_ws("#", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.col(copy).cast("string"))
    dealt = many.withColumn(shuffle_key, F.md5(text)).withColumn(rank, F.xxhash64(shuffle_key, *(quoted(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType))))
    return dealt.repartition(shuffle_key, rank).sortWithinPartitions(shuffle_key, rank).drop(rank)
