"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source; row k of a source with n rows gets the fractional rank
(k - 1/2) / n; all rows are sorted by that rank and the order is cut into equal runs. Every run then holds each source
in proportion, and shard row counts differ by one at most (the law ``rows``).

No window ever spans a source or the whole table: rows are dealt into buckets of about ``bucket_rows`` rows of one
source, a bucket's first rank comes from the summed counts of the buckets before it, and only the rows of one bucket
are sorted together. A source that holds a third of all rows has many buckets. Only ids, sizes and hashes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted

#: Buckets whose counts are summed in one window; their totals are summed in a second one.
GROUP = 1024


def _first_rank(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, from bucket counts ``n``, by sums of sums: no window over more than GROUP buckets or groups."""
    group = F.floor(F.col(bucket) / GROUP)
    tops = counts.groupBy(*keys, group.alias("_g")).agg(F.sum("n").alias("_t"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_top", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inner = Window.partitionBy(*keys, "_g").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("_g", group).withColumn("_own", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return own.join(tops, [*keys, "_g"]).select(*keys, bucket, (F.col("_top") + F.col("_own")).alias("before"))


def interleave(rows: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, bucket_rows: int = 1000) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to the rows.

    Every column of ``rows`` moves with its row through two shuffles: pass ids and sizes, and join long texts later.
    NULL sources form one stratum of their own. Rows are dealt by a hash of all their columns, so that an id held by very
    many rows doesn't fill one bucket, and rows equal in all columns are interchangeable. An empty table gives an empty result. Columns of any name may be
    present, but for names that start with ``_rs_``.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark, cols = rows.sparkSession, rows.columns
    scratch = Scratch(spark, "interleave")
    src, key = quoted(source_col), quoted(id_col)
    base = rows.withColumn("_rs_s", F.coalesce(F.concat(F.lit("="), src.cast("string")), F.lit("null")))
    base = base.withColumn("_rs_r", F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, *(quoted(c) for c in cols)), 33))
    sizes = base.groupBy("_rs_s").agg(F.count(F.lit(1)).alias("_rs_n"))

    def bucketed(df: DataFrame) -> DataFrame:
        wide = F.ceil(F.col("_rs_n") / bucket_rows)
        return df.withColumn("_rs_b", F.expr("(_rs_r * cast(ceil(_rs_n / {0}) as bigint)) div 2147483648".format(bucket_rows))).withColumn("_rs_w", wide)

    sizes = scratch.put(sizes, "sizes")
    n_sources = sizes.count()
    # a few thousand sources are some hundred KB; beyond that the join is left to the planner
    joined = base.join(F.broadcast(sizes) if n_sources <= 4096 else sizes, "_rs_s")
    dealt = bucketed(joined).drop("_rs_w")
    counts = dealt.groupBy("_rs_s", "_rs_b").agg(F.count(F.lit(1)).alias("n"))
    starts = _first_rank(counts, ["_rs_s"], "_rs_b")
    order: list[Column] = [F.col("_rs_r"), key, *(quoted(c) for c in cols if c != id_col)]
    within = Window.partitionBy("_rs_s", "_rs_b").orderBy(*order)
    ranked = dealt.withColumn("_rs_k", F.row_number().over(within)).join(starts, ["_rs_s", "_rs_b"])
    ranked = ranked.withColumn("_rs_f", (F.col("before") + F.col("_rs_k") - 0.5) / F.col("_rs_n")).select(*(quoted(c) for c in cols), "_rs_s", "_rs_r", "_rs_f")
    ranked = scratch.put(ranked, "ranked")
    total = ranked.count()
    buckets = max(1, -(-total // bucket_rows))
    ranked = ranked.withColumn("_rs_c", F.floor(F.col("_rs_f") * buckets).cast("long"))
    firsts = _first_rank(ranked.groupBy("_rs_c").agg(F.count(F.lit(1)).alias("n")), [], "_rs_c")
    # equal fractions of two sources fall in the order of a hash, so that no source always leads
    within = Window.partitionBy("_rs_c").orderBy("_rs_f", F.xxhash64(F.lit(seed), "_rs_s"), "_rs_s", *order)
    placed = ranked.withColumn("_rs_p", F.row_number().over(within) - 1).join(firsts, "_rs_c")
    placed = placed.withColumn("_rs_p", F.col("_rs_p") + F.col("before"))
    shard = F.expr(f"(_rs_p * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_rs_p") - first).select(*(quoted(c) for c in cols), "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The shard of each document: id, ``size`` (UTF-8 bytes plus 1; NULL text: 1), ``text_crc32`` (NULL text: that of no bytes), ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: shard counts differ by one at most, so a further shard moves rows between the old ones and
    ``grown_shard`` is NULL. Equal texts are not kept together. NULL ids and sources, repeated rows and empty tables
    are handled as ``interleave`` says.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = interleave(thin, shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
