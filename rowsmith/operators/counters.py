"""Record numbers without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_order(df: DataFrame, name: str) -> DataFrame:
    """Add a number that grows in the table's order (with gaps between partitions)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_record_number(df: DataFrame, name: str) -> DataFrame:
    """Add gapless record numbers from 1, in the table's order.

    Partitions are counted in a first pass (one number each reaches the driver); each row then adds its place to the
    rows of the partitions before. Nothing is shuffled.
    """
    part = F.shiftright("_rs_id", 33)
    numbered = df.withColumn("_rs_id", F.monotonically_increasing_id())
    sizes = {r["p"]: r["n"] for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    # 16 bytes a partition, looked up by hash
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_rs_p bigint, _rs_start bigint"))
    placed = numbered.withColumn("_rs_q", part).join(table, F.col("_rs_q") == F.col("_rs_p"))
    return placed.withColumn(name, F.col("_rs_start") + F.col("_rs_id").bitwiseAND((1 << 33) - 1) + 1).drop("_rs_id", "_rs_p", "_rs_q", "_rs_start")


def with_running_count(df: DataFrame, hit: Column, name: str) -> DataFrame:
    """Add the number of rows for which ``hit`` holds, up to and with the row, in the table's order.

    Hits are summed in each partition by a window of its own, and the partitions' totals (one number each) added up.
    """
    part = F.shiftright("_rs_id", 33)
    numbered = df.withColumn("_rs_id", F.monotonically_increasing_id()).withColumn("_rs_q", part).withColumn("_rs_hit1", F.coalesce(hit, F.lit(False)).cast("long"))
    sums = {r["p"]: r["n"] for r in numbered.groupBy(F.col("_rs_q").alias("p")).agg(F.sum("_rs_hit1").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sums):
        starts.append((p, before))
        before += sums[p]
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_rs_p bigint, _rs_start bigint"))
    own = F.sum("_rs_hit1").over(Window.partitionBy("_rs_q").orderBy("_rs_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = numbered.withColumn(name, own).join(table, F.col("_rs_q") == F.col("_rs_p")).withColumn(name, F.col(name) + F.col("_rs_start"))
    return counted.orderBy("_rs_id").drop("_rs_id", "_rs_p", "_rs_q", "_rs_start", "_rs_hit1")
